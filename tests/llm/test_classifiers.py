import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from closebook.llm import quality as q
from closebook.llm import toxicity as t
from tests.llm import cases


def toxic_corpus(spark, n=2400, seed=2):
    """An insult word, or a word that is bad only together with a group name."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words, kind = cases.sentence(rng, rng.randint(5, 120)).split(), i % 6
        toxic = 0
        if kind == 0:
            words.insert(rng.randrange(len(words)), "scumbag" + rng.choice(["", "ly", "ness", "zi"]))
            toxic = 1
        elif kind == 1:
            words += ["vermin", "foreigners"]
            toxic = 1
        elif kind == 2:
            words.append("vermin")
        elif kind == 3:
            words.append("foreigners")
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, None, toxic))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), cases.labels(spark, labels)


def test_pairs_that_additive_weights_miss(spark):
    docs, labels = toxic_corpus(spark)
    scored = t.score_toxicity(docs, t.train(docs, labels)).join(labels, "doc_id").withColumn("held_out", t.held_out())
    rows = scored.where("held_out").collect()
    right = sum((r["score"] >= t.THRESHOLD) == bool(r["toxic"]) for r in rows)
    assert right >= 0.97 * len(rows)


def test_held_out_rows_and_other_columns_have_no_part(spark):
    docs, labels = toxic_corpus(spark, 300)
    model = t.train(docs, labels)
    other = labels.withColumn("toxic", F.when(t.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = t.train(docs.withColumn("lang", F.lit("x")), other)
    assert model["known"] == again["known"] and np.array_equal(model["weights"], again["weights"])


@pytest.mark.parametrize("rows", [[], [(0, 1, 1), (1, 1, 1), (2, 0, None)], [(None, 1, 1), (3, None, None)]])
def test_toxicity_without_both_classes(spark, rows):
    docs = cases.documents(spark)
    scored = t.score_toxicity(docs, t.train(docs, cases.labels(spark, rows)))
    assert scored.count() == docs.count()
    assert set(docs.columns) < set(scored.columns) and scored.where("_score < 0 OR _score > 1 OR _score IS NULL").count() == 0


def test_toxicity_takes_every_case(spark):
    docs = cases.documents(spark)
    labels = cases.labels(spark, [(i, 1, int(i % 3 == 0)) for i in range(40)] + [(4, 1, 1), (None, 1, 1)])
    scored = t.score_toxicity(docs, t.train(docs, labels)).collect()
    assert len(scored) == docs.count()
    empty = {r["_score"] for r in scored if not r["text"]}
    assert len(empty) == 1
    assert t.score_toxicity(cases.no_documents(spark), t.train(docs, labels)).count() == 0
    t.train(cases.no_documents(spark), labels)


def quality_corpus(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        if good:
            text = cases.prose(rng, rng.randint(2, 9))
        else:
            text = {0: lambda: " | ".join(cases.sentence(rng, 40).split()), 1: lambda: cases.prose(rng, 4).upper().replace(" ", "!! "),
                    2: lambda: " ".join(w for w in cases.sentence(rng, 6).split() for _ in range(12))}[i // 4 % 3]()
        rows.append((i, text, "en", f"s{i % 7}", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    labels += [(i, int(i % 4 > 0), 0) for i in range(0, n, 8)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), cases.labels(spark, labels)


def test_quality_on_documents_without_label(spark):
    docs, labels = quality_corpus(spark)
    rows = q.score_quality(docs, q.train(docs, labels)).join(labels, "doc_id", "left_anti").collect()
    right = sum(r["accepted"] == (r["doc_id"] % 4 > 0) for r in rows)
    assert len(rows) > 100 and right >= 0.97 * len(rows)


def test_views_teach_each_other():
    """One view is read with ease, the other has few labels for its many features."""
    gains = []
    few, free, test = slice(0, 160), slice(160, 1400), slice(1400, 2400)
    for seed in range(3):
        rng = np.random.default_rng(seed)
        y = (rng.random(2400) < 0.5).astype(float)
        views = [rng.normal(0, 1, (2400, 4)) + y[:, None] * 3, rng.normal(0, 1, (2400, 200)) + y[:, None] * 0.2]
        right = []
        for rounds in (0, 4):
            model = q.cotrain([v[few] for v in views], y[few], [v[free] for v in views], rounds)
            scores = q.score_views(model, [v[test] for v in views])
            right.append(((scores[1] > 0.5) == y[test]).mean())
            assert ((scores[2] > 0.5) == y[test]).mean() > 0.95
        gains.append(right[1] - right[0])
    assert min(gains) > 0.03


@pytest.mark.parametrize("rows", [[], [(0, 1, 1), (1, 1, 1), (2, None, 0)]])
def test_nothing_is_rejected_without_evidence(spark, rows):
    docs = cases.documents(spark)
    scored = q.score_quality(docs, q.train(docs, cases.labels(spark, rows)))
    assert scored.count() == docs.count() and scored.where("NOT accepted").count() == 0


def test_quality_takes_every_case(spark):
    docs = cases.documents(spark)
    labels = cases.labels(spark, [(i, int(i % 3 > 0), 0) for i in range(45)] + [(4, 0, 0), (None, 0, 1)])
    model = q.train(docs, labels)
    scored = q.score_quality(docs, model)
    assert scored.count() == docs.count() and scored.where("score IS NULL OR accepted IS NULL").count() == 0
    assert q.score_quality(cases.no_documents(spark), model).count() == 0
    q.train(cases.no_documents(spark), labels)
