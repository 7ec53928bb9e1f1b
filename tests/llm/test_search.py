"""Ranked search against exhaustive scoring in plain Python, over whole small tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from closebook.llm import search
from tests.llm import cases

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall(text.translate(LOW)) if text else []


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    N = sum(bool(b) for _, b in bags)
    L = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, ts in wanted.items():
        scores = []
        for i, b in bags:
            n = sum(b.values())
            s = 0
            for t in ts & set(b):
                m = 100 - 90 + (90 * n * N) // L
                s += math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def items(spark, texts):
    rng = random.Random(9)
    words = [w for t in texts if t for w in terms(t)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(12)]
    rows += [(20, None), (21, ""), (22, "... !"), (23, "NA na Ünï 日本語 one"), (24, "nosuchword"), (5, rows[5][1]), (6, "changed one two"), (None, "one two")]
    return spark.createDataFrame(rows, "item_id bigint, text string"), rows


@pytest.mark.parametrize(("postings", "vocabulary", "k"), [(4_000_000, 16_000_000, 10), (60, 16_000_000, 3), (500, 300, 10)])
def test_brute_force(spark, postings, vocabulary, k):
    docs = cases.documents(spark, 4)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    wanted, plain = items(spark, [t for _, t in rows])
    got = search.search(docs, wanted, k=k, block_postings=postings, vocabulary_bytes=vocabulary)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, plain, k)


def test_ties_go_to_the_smaller_id(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(50, 0, -1)] + [(None, "same words here"), (99, "else")], "doc_id bigint, text string")
    wanted = spark.createDataFrame([(1, "words same")], "item_id int, text string")
    got = search.search(docs.repartition(7), wanted).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == list(range(1, 11)) and len({r["score"] for r in got}) == 1


def test_empty_tables(spark):
    wanted = spark.createDataFrame([(1, "words")], "item_id int, text string")
    assert search.search(cases.no_documents(spark), wanted).count() == 0
    assert search.search(cases.documents(spark), wanted.limit(0)).count() == 0
    assert search.search(cases.documents(spark), spark.createDataFrame([(1, None)], "item_id int, text string")).count() == 0


def block(rng, n_docs, vocabulary):
    """Documents with a few rare terms and many frequent ones."""
    p = 1 / np.arange(1, vocabulary + 1)
    p /= p.sum()
    bags = [Counter(rng.choice(vocabulary, rng.integers(5, 120), p=p).tolist()) for _ in range(n_docs)]
    sizes = np.array([len(b) for b in bags])
    flat = np.array([t for b in bags for t in b], np.int64)
    tfs = np.array([c for b in bags for c in b.values()], np.int64)
    lengths = np.array([sum(b.values()) for b in bags], np.int64)
    df = np.bincount(flat, minlength=vocabulary)
    weights = np.array([search.weight(n_docs, int(d)) for d in df], np.int64)
    N, L = n_docs, int(lengths.sum())
    made = search.Block(np.arange(n_docs), np.ones(n_docs, bool), lengths, flat, tfs, sizes, weights, N, L)
    return made, bags, lengths, df, weights, N, L


def test_accumulators_are_limited_and_scores_exact():
    rng = np.random.default_rng(3)
    made, bags, lengths, df, weights, N, L = block(rng, 4000, 3000)
    touched = whole = 0
    for _ in range(30):
        ts = np.unique(np.concatenate([rng.integers(0, 3000, 6), rng.integers(0, 30, 12)]))
        wanted = ts[np.lexsort((ts, df[ts]))]
        found, scores = made.best(wanted, 10)
        touched += made.touched
        whole += int(df[ts].sum())
        want = sorted(
            (-sum(search.part(int(weights[t]), b[t], int(lengths[i]), N, L) for t in ts.tolist() if t in b), i) for i, b in enumerate(bags))[:10]
        assert [(-s, i) for s, i in want if s] == list(zip(scores.tolist(), found.tolist(), strict=True))
        assert not made.scores.any()
    assert touched < 0.5 * whole  # postings read or looked up, of all there are


def test_bounds_that_tie_still_create_accumulators():
    """A document whose bound equals the k-th score may win by its id."""
    ids = np.array([9, 1])
    made = search.Block(ids, np.ones(2, bool), np.array([1, 1]), np.array([0, 1]), np.array([1, 1]), np.array([1, 1]), np.array([5, 5]), 2, 2)
    found, _ = made.best(np.array([0, 1]), 1)
    assert ids[found].tolist() == [1]


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "rare " + "word " * 1_000_000), (2, "word")], "doc_id bigint, text string")
    wanted = spark.createDataFrame([(7, "rare word")], "item_id int, text string")
    got = [tuple(r) for r in search.search(docs, wanted).collect()]
    assert sorted(got, key=repr) == brute([(1, "rare " + "word " * 1_000_000), (2, "word")], [(7, "rare word")])
