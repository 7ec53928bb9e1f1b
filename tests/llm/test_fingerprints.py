import hashlib

from pyspark.sql import functions as F

from closebook.llm import fingerprints as f
from tests.llm import cases


def vector(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(f.fingerprint(F.col("t"))).first()[0]


def test_order_does_not_count_and_parts_add_up(spark):
    a, b, c = "first line", "second", "third one"
    assert vector(spark, "\n".join([a, b, c])) == vector(spark, "\n".join([c, a, "", b]))
    assert vector(spark, f"{a}\n{a}") != vector(spark, a)
    rows = spark.createDataFrame([(f"{a}\n{b}", c, f"{b}\n{c}\n{a}")], "x string, y string, z string")
    x, y, z = (f.fingerprint(F.col(n)) for n in "xyz")
    assert rows.select((f.plus(x, y) == z) & (f.minus(z, y) == x)).first()[0]


def test_likeness(spark):
    lines = [f"line {i} of text" for i in range(60)]
    pairs = [("\n".join(lines), "\n".join(lines[::-1])), ("\n".join(lines), "\n".join(lines[:30] + [f"x{i}" for i in range(30)])),
             ("\n".join(lines), "\n".join(f"y{i}" for i in range(60))), ("", None), ("", "a")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x string, y string")
    df = df.select("i", f.fingerprint(F.col("x")).alias("a"), f.fingerprint(F.col("y")).alias("b"))
    near = [r["near"] for r in f.with_likeness(df, {"near": ("a", "b")}).orderBy("i").collect()]
    assert near[0] == near[3] == 1.0 and near[4] == 0.0
    assert 0.3 < near[1] < 0.7 and near[2] < 0.25


def test_next_in_id_order_with_nulls_ties_and_clashing_names(spark):
    docs = cases.documents(spark)
    got = f.with_next(docs.select("doc_id", "bucket", F.coalesce("text", F.lit("")).alias("text")), "doc_id", ["text"])
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    hashes = {r["t"]: r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), -hashes[r[1]]))
    want = sorted((str(a), t, rows[(i + 1) % len(rows)][1]) for i, (a, t) in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["text"], r["next_text"]) for r in got.collect()) == want


def test_next_without_ids_and_of_nothing(spark):
    none = spark.createDataFrame([(None, "a"), (None, "b")], "doc_id bigint, text string")
    assert sorted((r["text"], r["next_text"]) for r in f.with_next(none, "doc_id", ["text"]).collect()) == [("a", "b"), ("b", "a")]
    assert f.with_next(none.limit(0), "doc_id", ["text"]).count() == 0


def test_query_takes_every_case(spark, tmp_path):
    cases.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = f.op1(spark, str(tmp_path)).collect()
    assert len(rows) == cases.documents(spark).count()
    by_text = {}
    for r in rows:
        by_text.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
        assert 0.0 <= r["near_edited"] <= 1.0 and 0.0 <= r["near_next"] <= 1.0
    assert any(r["edited_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)


def test_main_path_has_no_python(spark, folder):
    plan = f.op1(spark, folder)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
