from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from closebook.llm import packing, quality
from tests.llm import cases
from tests.llm.test_decontaminate import benchmark, planted
from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_minhash import brute as brute_near
from tests.llm.test_packing import check


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs, items = planted(spark)
    docs.write.parquet(f"{path}/documents.parquet")
    benchmark(spark, items).write.parquet(f"{path}/benchmark.parquet")
    cases.labels(spark, [(i, int(i % 9 > 0), 0) for i in range(40)]).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_keep_columns_and_take_no_documents(spark, docs, sf_dir):
    for name, stage in pipeline.STAGES:
        none = stage(spark, docs.limit(0), sf_dir)
        assert none.count() == 0, name
        if name != "packing":
            assert none.dtypes == docs.dtypes, name


def test_quality_stage_keeps_what_the_classifier_accepts(spark, docs, sf_dir):
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = quality.score_quality(docs.select("doc_id", "lang", "source", "n_chars", "text"), model).where("accepted")
    got = pipeline.quality_stage(spark, docs, sf_dir)
    assert as_rows(got.select("doc_id", "text")) == as_rows(want.select("doc_id", "text"))
    assert as_rows(got) - as_rows(docs) == Counter() and got.dtypes == docs.dtypes


def test_line_stage(spark, docs, sf_dir):
    rows = [(r["doc_id"], r["text"], r["h"]) for r in docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    kept = brute_lines(rows)
    want = Counter((i, kept[(i, t)][0]) for i, t, _ in rows)
    got = pipeline.line_stage(spark, docs, sf_dir)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want and got.dtypes == docs.dtypes
    before = {(r["doc_id"], r["text"]): r["n_chars"] for r in docs.collect()}
    for r in got.collect():
        assert r["n_chars"] == before.get((r["doc_id"], r["text"]), len(r["text"] or ""))


def test_near_stage_keeps_one_of_each_group(spark, docs, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = brute_near(rows)
    named = [(i, t) for (i, t), (n, c) in zip(rows, found, strict=True) if n and i is not None and i == c]
    wordless = [(i, t) for (i, t), (n, _) in zip(rows, found, strict=True) if not n]
    unnamed = {t for (i, t), (n, c) in zip(rows, found, strict=True) if n and c is None}
    got = pipeline.near_stage(spark, docs, sf_dir)
    assert got.dtypes == docs.dtypes and as_rows(got) - as_rows(docs) == Counter()
    out = Counter((r["doc_id"], r["text"]) for r in got.collect())
    want = Counter(set(named)) + Counter(wordless) + Counter((None, t) for t in unnamed)
    # Rows of one id whose texts are near each other count once; which of them is not the point.
    assert {k[0] for k in out} == {k[0] for k in want}
    left = list(out.elements())
    assert all(c == i for (i, _), (n, c) in zip(left, brute_near(left), strict=True) if n)


def test_decontamination_stage(spark, docs, sf_dir):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = Counter((r["doc_id"], r["text"]) for r in docs.collect() if not brute_contamination(r["text"], items)[4])
    got = pipeline.decontaminate_stage(spark, docs, sf_dir)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want and got.dtypes == docs.dtypes
    assert sum(want.values()) < docs.count()


def test_run(spark, docs, sf_dir):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rest = docs
    for _, stage in pipeline.STAGES[:-1]:
        rest = spark.createDataFrame(stage(spark, rest, sf_dir).collect(), docs.schema)
    rows = [(r["doc_id"], r["text"]) for r in rest.select("doc_id", "text").collect()]
    assert 0 < len(rows) < docs.count()
    check(pipeline.run(spark, sf_dir).collect(), rows, tokenizer, packing.LENGTH)


def test_line_stage_cuts_repeated_paragraphs(spark, sf_dir):
    paragraph = " ".join(f"word{i}" for i in range(51))
    docs = spark.createDataFrame([(1, paragraph, 1), (2, f"own\n{paragraph}\nend", 1)], "doc_id bigint, text string, n_chars bigint")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.line_stage(spark, docs, sf_dir).collect()}
    assert got == {1: (paragraph, 1), 2: ("own\nend", 7)}


def test_emptied_copies_go_and_empty_documents_stay(spark, sf_dir):
    text = "a b\nc d\ne f"
    rows = [(1, text, 11), (2, text, 11), (3, "", 0), (4, None, None), (5, " \n\n\n", 4), (6, f"{text}\nown", 15), (7, " \n\n\n", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    stage = dict(pipeline.STAGES)["line_dedup"]
    got = {r["doc_id"]: r["text"] for r in stage(spark, docs, sf_dir).collect()}
    assert got == {1: text, 3: "", 4: None, 5: " \n\n\n", 6: "own", 7: ""}
