"""CSV records over line ends, against the csv module and by hand, in pieces of a few bytes."""

import csv
import io
import random

import pytest

from closebook.sources import files


def write(path, rng, n, ends="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=ends, quoting=csv.QUOTE_MINIMAL)
    words = ["plain", "a,b", 'say "hi"', "two\nlines", "\n", "x\n\ny", "", "ünï", '"', 'q"\n"q', "1"]
    rows = [(i, rng.choice(words) + rng.choice(words), rng.choice(words)) for i in range(n)]
    for r in rows:
        writer.writerow(r)
    path.write_text(out.getvalue(), newline="")
    return rows


@pytest.fixture
def small_pieces(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_quoted_line_ends(spark, tmp_path, small_pieces, ends):
    rng = random.Random(3)
    want = []
    for name in "ab":
        want += [(i, a, b) for i, a, b in write(tmp_path / name, rng, 120, ends)]
    raw = files.read_export(spark, str(tmp_path), "id int, a string, b string", escape='"')
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    good, bad = files.split_export(raw)
    assert bad.count() == 0
    got = sorted((r["id"], r["a"] or "", r["b"] or "") for r in good.collect())
    assert got == sorted(want)


def test_records_over_many_pieces(spark, tmp_path, small_pieces):
    long = "\n".join(f"line {i}" for i in range(200))
    (tmp_path / "f").write_text(f'id,a\n1,x\n2,"{long}"\n3,"y\nz"\n')
    got = files.split_export(files.read_export(spark, str(tmp_path), "id int, a string"))
    assert {r["id"]: r["a"] for r in got[0].collect()} == {1: "x", 2: long, 3: "y\nz"} and got[1].count() == 0


def test_unclosed_quotes_are_bad_records(spark, tmp_path):
    (tmp_path / "f").write_text('1,"a\n2,b\n3,c\n')
    good, bad = files.split_export(files.read_export(spark, str(tmp_path), "id int, a string"))
    assert sorted(tuple(r) for r in good.collect()) == [(2, "b"), (3, "c")]
    assert [r[0] for r in bad.collect()] == ['1,"a']


def test_a_record_that_is_too_long_is_not_joined(spark, tmp_path):
    (tmp_path / "f").write_text('1,"a\n' + "".join(f"{i},b\n" for i in range(2, 12)) + '12,c"\n13,"d\ne"\n')
    good, bad = files.split_export(files.read_export(spark, str(tmp_path), "id int, a string", record_lines=5))
    assert sorted(r["id"] for r in good.collect()) == [*range(2, 12), 13]
    assert sorted(r[0] for r in bad.collect()) == ['1,"a', '12,c"']


def test_escaped_quotes(spark, tmp_path):
    (tmp_path / "f").write_text('1,"a \\" b"\n2,"c\n\\"d"\n3,e\n')
    good, bad = files.split_export(files.read_export(spark, str(tmp_path), "id int, a string"))
    assert {r["id"]: r["a"] for r in good.collect()} == {1: 'a " b', 2: 'c\n"d', 3: "e"} and bad.count() == 0


def test_bad_records_are_whole(spark, tmp_path):
    (tmp_path / "f").write_text('x1,"a\nb"\n2,c\n')
    good, bad = files.split_export(files.read_export(spark, str(tmp_path), "id int, a string"))
    assert [tuple(r) for r in good.collect()] == [(2, "c")] and [r[0] for r in bad.collect()] == ['x1,"a\nb"']

