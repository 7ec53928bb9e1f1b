"""Archives: records to bytes and back, byte ranges, pushed predicates, pages with awkward cases."""

import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from closebook.llm import warc
from closebook.session import scratch_path


def record(i, body, kind="response"):
    return {
        "record_type": kind, "record_id": f"tag:x/{i}", "date": "2026-01-01T00:00:00Z", "target_uri": f"http://a/{i}\r\nx",
        "payload_digest": warc.digest(body), "refers_to": None, "payload_length": len(body),
        "payload": None if kind == "revisit" else body, "headers": [("X-Number", str(i))],
    }


@pytest.fixture(scope="module")
def some():
    rng = random.Random(5)
    sizes = [0, 1, 10, 3000, 200_000]
    return [record(i, rng.randbytes(rng.choice(sizes)), rng.choice(["response", "revisit", "metadata"])) for i in range(60)]


@pytest.mark.parametrize("gzipped", [True, False])
@pytest.mark.parametrize("payload", [True, False])
def test_round_trip(some, gzipped, payload):
    data = b"".join(warc.member(warc.record_bytes(r)) if gzipped else warc.record_bytes(r) for r in some)
    got = list(warc.records(io.BytesIO(data), 0, len(data), gzipped, payload=payload))
    assert [g["record_id"] for g in got] == [r["record_id"] for r in some]
    for g, r in zip(got, some, strict=True):
        assert g["payload"] == (r["payload"] if payload else None)
        assert g["target_uri"] == r["target_uri"].replace("\r\n", "%0D%0A")
        assert dict(g["headers"])["x-number"] == r["headers"][0][1]
        assert g["intact"] is (True if payload and r["record_type"] != "revisit" else None)


@pytest.mark.parametrize("step", [999, 70_001])
@pytest.mark.parametrize("own", [True, False])
def test_ranges_read_each_record_once(some, step, own):
    """Files of this writer, and of others that leave no lengths in the gzip header."""
    data = b"".join(warc.member(warc.record_bytes(r)) if own else gzip.compress(warc.record_bytes(r)) for r in some)
    got = [
        g["record_id"] for at in range(0, len(data), step)
        for g in warc.records(io.BytesIO(data), at, min(at + step, len(data)), True)]
    assert got == [r["record_id"] for r in some]


def test_members_are_plain_gzip(some):
    records = [warc.record_bytes(r) for r in some]
    assert gzip.decompress(b"".join(map(warc.member, records))) == b"".join(records)


def test_payloads_of_rejected_records_are_not_read(some):
    """With lengths in the gzip header the reader jumps over a large payload."""
    big = record(1, random.Random(1).randbytes(5_000_000))
    data = warc.member(warc.record_bytes(big)) + warc.member(warc.record_bytes(some[0]))

    class Counting(io.BytesIO):
        total = 0

        def read(self, n=-1):
            out = super().read(n)
            Counting.total += len(out)
            return out

    got = list(warc.records(Counting(data), 0, len(data), True, payload=False))
    assert len(got) == 2 and Counting.total < 600_000


def test_damage_between_members(some):
    parts = [warc.member(warc.record_bytes(r)) for r in some[:3]]
    assert warc.digest(b"") == base64.b32encode(hashlib.sha1(b"").digest()).decode()
    changed = bytearray(warc.record_bytes(some[0] | {"payload": b"other", "record_type": "response"}))
    got = list(warc.records(io.BytesIO(parts[1] + warc.member(bytes(changed))), 0, 10**9, True))
    assert got[1]["intact"] is False


def pages(spark):
    rows = [
        (1, "http://a/1", "<p>one</p>", "x"), (2, "http://a/2", "<p>one</p>", "x"), (0, "http://a/0\n", "<p>one</p>", "x"),
        (5, "http://a/5", None, "x"), (6, None, "", "x"), (7, "http://a/7", "ünï 日本 \U0001F600", None), (8, "http://a/8", "x" * 300_000, "x"),
        (9, "http://a/9", "x" * 300_000, "x"), (9, "http://a/9", "x" * 300_000, "x"), (None, "n", "<p>one</p>", "x"), (None, "n", "alone", "x"),
        (0, "http://a/0", "<p>one</p>", "x"), (-3, "u", "tie", "x"),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type string")


def expected(rows, least):
    first = {}
    for i, _, html, _ in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    for i, _, html, _ in rows:
        body = (html or "").encode()
        again = len(body) >= least and (html or "") in first and i != first[html or ""]
        yield i, len(body), warc.digest(body), "revisit" if again else "response", first[html or ""] if again else None


@pytest.mark.parametrize("least", [0, 8, 10**6])
def test_pages(spark, least):
    df = pages(spark)
    path = scratch_path(spark, "warc-test")
    warc.write_pages(df, path, least)
    got = sorted(map(tuple, warc.read_pages(spark, path).collect()), key=repr)
    assert got == sorted(expected([tuple(r) for r in df.collect()], least), key=repr)
    texts = {r["payload"].decode() for r in spark.read.format("warc").load(path).where("record_type = 'response'").collect()}
    assert texts == {r["html"] or "" for r in df.collect()}


def test_hot_payload_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 10)
    df = spark.range(200).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 > 0, "same").alias("html"))
    out = warc.archive_records(df).groupBy("record_type", "refers_to").count().collect()
    assert {tuple(r) for r in out} == {
        ("response", None, 2), ("revisit", warc.ID + "0", 66), ("revisit", warc.ID + "1", 132)}


def test_empty_table_and_predicates(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_pages(pages(spark).limit(0), path)
    assert warc.read_pages(spark, path).count() == 0
    warc.write_pages(pages(spark), path)  # appended
    source = spark.read.format("warc").option("split_bytes", "500").load(path)
    assert source.count() == 13
    for condition in (
        "record_type = 'revisit'", "record_type IN ('response', 'x')", "target_uri LIKE 'http://a/%'", "refers_to IS NULL",
        "NOT (record_type = 'revisit')", "payload_length = 10", "refers_to <=> NULL", "target_uri LIKE '%9' AND record_type <> 'x'",
    ):
        want = [r for r in source.collect()]
        kept = spark.createDataFrame(want, source.schema).where(condition).count()
        assert source.where(condition).count() == kept, condition
    assert source.where("record_type = 'none'").count() == 0
    plan = source.where("record_type = 'revisit' AND length(target_uri) > 3")._jdf.queryExecution().executedPlan().toString()
    assert "length(target_uri" in plan.split("PushedFilters")[0] and "record_type" not in plan.split("Filter", 1)[1].split("\n")[0]


def test_files_of_lost_tasks_do_not_show(spark, tmp_path):
    warc.register(spark)
    warc.write_pages(pages(spark), str(tmp_path))
    (tmp_path / "leftover.warc.gz").write_bytes(warc.member(warc.record_bytes(record(99, b"lost"))))
    assert spark.read.format("warc").load(str(tmp_path)).where("record_id LIKE '%99'").count() == 0
    assert spark.read.format("warc").load(str(tmp_path / "leftover.warc.gz")).count() == 1
