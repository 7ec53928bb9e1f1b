"""The filter audit against a run of every order over plain rows, stream and state included."""

import re
from collections import Counter
from itertools import permutations

import pytest

from closebook.llm import filteraudit
from closebook.session import scratch_path
from tests.llm import cases

LABELS = [(0, 1, 0), (1, 0, 1), (2, 1, 1), (3, None, 1), (3, 1, None), (40, 1, 0), (41, 1, 1), (9, 1, 1), (None, 1, 1), (999, 1, 1)]


def failures(rows):
    lowest = {}
    for r in rows:
        if r["doc_id"] is not None:
            lowest[r["text"] or ""] = min(lowest.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    for r in rows:
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found = set()
        if len(words) < 200:
            found.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            found.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            found.add("C")
        if re.search(r"[#$%&*|]", text):
            found.add("D")
        if r["doc_id"] is not None and r["doc_id"] > lowest[text]:
            found.add("E")
        yield r["source"] or "", found, r["doc_id"]


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    judged = list(failures(rows))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {j[0] for j in judged}:
            alive = [j for j in judged if j[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                falls = [j for j in alive if letter in j[1]]
                redundant = sum(letter in j[1] for j in gone)
                alive = [j for j in alive if letter not in j[1]]
                gone += falls
                shapley[part, letter] += len(falls)
                out[part, order, step] = (
                    len(alive), len(falls), redundant, sum(j[0] == part and j[1] == {letter} for j in judged),
                    sum(j[2] in good for j in falls), sum(j[2] in toxic for j in falls))
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def written(spark, df, files):
    """Files of descending ids, so that later micro-batches bring smaller ones."""
    path = scratch_path(spark, "audit-input")
    df.withColumn("text", df.text).repartitionByRange(files, df.doc_id.desc()).write.parquet(path)
    return path


@pytest.mark.parametrize("files", [1, 6])
def test_brute_force(spark, files):
    docs = cases.documents(spark, 3)
    rows = [r.asDict() for r in docs.collect()]
    counters = filteraudit.mask_counters(spark, written(spark, docs, files), cases.labels(spark, LABELS), batch_bytes=1, pages=3)
    assert {tuple(r) for r in filteraudit.audit(counters).select(*COLUMNS).collect()} == brute(rows, LABELS)


def test_smaller_ids_retract(spark):
    """The same text under ever smaller ids, in parts of its own: only the last one is kept."""
    path, target = scratch_path(spark, "audit-input"), scratch_path(spark, "audit-target")
    for doc_id, part in ((30, "a"), (20, "b"), (10, "c")):
        spark.createDataFrame([(doc_id, "one text", part)] * 2, "doc_id bigint, text string, source string").coalesce(1).write.mode(
            "append").parquet(path)
        # Each run goes on where the one before stopped.
        counters = filteraudit.mask_counters(spark, path, cases.labels(spark), pages=1, target=target)
    assert {(r["part"], r["mask"], r["n"]) for r in counters.collect()} == {("a", 17, 2), ("b", 17, 2), ("c", 1, 2)}


def test_hot_text_is_counted_before_the_shuffle():
    import pyarrow as pa

    n = 5000
    batch = pa.RecordBatch.from_pydict({
        "page": [0] * n, "twin": [b"x"] * n, "id": list(range(n)), "has": [True] * n, "part": ["p"] * n, "mask": [1] * n, "kind": [0] * n,
    }, schema=pa.schema([("page", pa.int64()), ("twin", pa.binary()), ("id", pa.int64()), ("has", pa.bool_()), ("part", pa.string()),
                         ("mask", pa.int32()), ("kind", pa.int32())]))
    out = next(iter(filteraudit._combine([batch]))).to_pylist()
    assert [(r["role"], r["n"]) for r in out] == [(filteraudit.LEAST, 1), (filteraudit.LATE, n - 1)]


def test_long_and_empty_tables(spark):
    none = scratch_path(spark, "audit-input")
    cases.no_documents(spark).write.parquet(none)
    assert filteraudit.audit(filteraudit.mask_counters(spark, none, cases.labels(spark))).count() == 0
    raw = ("wörd # " * 400_000).encode()
    assert filteraudit.text_mask(raw) == 2 + 8
    assert filteraudit.text_mask(b"") == 1
    assert filteraudit.text_mask("ÀÉ A".encode() * 300) == 2 + 4
