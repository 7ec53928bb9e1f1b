"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its lower-case words and their first four, five and six letters,
hashed to 2**22 numbers; a term counts once. On the training sample the terms that tell
the classes apart are chosen; the machine learns a weight for each and a vector of eight
factors, so that a pair of terms (an insult with the name of a group, say) has a weight
of its own: the inner product of their vectors. Scores are calibrated on a part of the
sample that the weights have not seen.

Training takes at most `SAMPLE` labelled rows, in the order of a hash of the id; terms are
extracted in tasks, and only their hashes come to the driver. Every whole text is scored.

Null and empty texts have no terms and get the score of none. Labels that are null count
as no label; of several labels of one id the largest counts. Without rows of both classes
every score is the share of class 1 (0 without any label). An empty table gives none.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closebook.llm.common import free_name, query, table, worker_cache

SAMPLE = 6_000
BUCKETS = 1 << 22
TERMS = 2048
FACTORS = 8
EPOCHS, LEAST_STEPS = 40, 2_000
LEAST_EVIDENCE = 30.0  # chi-square a term must reach
CLEAR = 6.0
HIDDEN = 0.5  # share of terms hidden in a step of training
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
CACHED_WORDS = 200_000
WORD = re.compile(r"[^\W_]+")


def _buckets(word: str) -> list[int]:
    raw = [word] + ["^" + word[:n] for n in PREFIXES if len(word) >= n]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in raw]


class Terms:
    """Numbers of the terms of a text; `known` maps buckets to them (None: the buckets)."""

    def __init__(self, known: dict[int, int] | None = None):
        self.known, self.cache = known, {}

    def __call__(self, text: str | None) -> list[int]:
        found: set[int] = set()
        cache = self.cache
        for word in set(WORD.findall((text or "").lower())):
            some = cache.get(word)
            if some is None:
                some = _buckets(word)
                if self.known is not None:
                    some = [self.known[b] for b in some if b in self.known]
                if len(cache) >= CACHED_WORDS:
                    cache.clear()
                cache[word] = some
            if some:
                found.update(some)
        return sorted(found)


def _extract(batches):
    terms = Terms()
    for batch in batches:
        at = batch.schema.get_field_index
        yield pa.RecordBatch.from_arrays(
            [batch.column(at("label")), batch.column(at("turn")),
             pa.array([terms(t.as_py()) for t in batch.column(at("text"))], pa.list_(pa.int32()))],
            names=["label", "turn", "terms"])


def choose_terms(rows: list, labels: np.ndarray, limit: int = TERMS) -> dict[int, int]:
    """The buckets that tell the classes apart most, by the chi-square of their presence."""
    n, positive = len(labels), max(int(labels.sum()), 1)
    counts = np.zeros((2, BUCKETS), np.int32)
    for row, label in zip(rows, labels, strict=True):
        counts[int(label), row] += 1
    total = counts.sum(axis=0)
    seen = np.flatnonzero((total >= 3) & (total < n))
    share = total[seen] / n
    expected = share * positive
    score = (counts[1, seen] - expected) ** 2 / np.maximum(expected * (1 - positive / n) * (1 - share), 1e-9)
    best = np.argsort(-score, kind="stable")[:limit]
    return {int(b): i for i, b in enumerate(seen[best[score[best] >= LEAST_EVIDENCE]])}


def logits(model: dict, rows: list) -> np.ndarray:
    """Machine output for rows of term numbers."""
    out = np.full(len(rows), model["bias"])
    for i, row in enumerate(rows):
        if len(row):
            v = model["factors"][row]
            out[i] += model["weights"][row].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum())
    # Pairs add up with the square of their terms; beyond this nothing is left to tell.
    return np.clip(out, -CLEAR, CLEAR)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def calibrate(scores: np.ndarray, labels: np.ndarray, numbers: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of a logistic curve through scores (Newton steps, smoothed targets);
    with `numbers`, each stands for that many."""
    numbers = np.ones(len(labels)) if numbers is None else numbers
    positive, negative = (numbers * labels).sum(), (numbers * (1 - labels)).sum()
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * scores + b)
        w = numbers * np.maximum(p * (1 - p), 1e-9)
        off = numbers * (p - target)
        g = np.array([(off * scores).sum() + 1e-3 * (a - 1), off.sum()])
        h = np.array([[(w * scores * scores).sum() + 1e-3, (w * scores).sum()], [(w * scores).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        move = np.clip(move, -1, 1)
        a, b = max(a - move[0], 1e-3), b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return float(a), float(b)


def fit(rows: list, labels: np.ndarray, seed: int = 7) -> dict:
    """A machine fitted on rows of buckets; every fifth row is kept for calibration."""
    rows = [np.asarray(row, np.int32) for row in rows]
    labels = np.asarray(labels, float)
    share = float(labels.mean()) if len(labels) else 0.0
    if not len(labels) or share in (0.0, 1.0):
        return {"known": {}, "share": share}
    held = np.arange(len(labels)) % 5 == 4
    if len(set(labels[~held])) < 2 or len(set(labels[held])) < 2:
        held[:] = False
    train = np.flatnonzero(~held)
    known = choose_terms([rows[i] for i in train], labels[train])
    number = np.full(BUCKETS, -1, np.int32)
    number[list(known)] = list(known.values())
    numbers = [found[found >= 0] for found in (number[row] for row in rows)]
    x = np.zeros((len(train), len(known)), np.float32)
    for i, at in enumerate(train):
        x[i, numbers[at]] = 1
    y = labels[train]
    rng = np.random.default_rng(seed)
    p = {"bias": np.zeros(1), "weights": np.zeros(len(known)), "factors": rng.normal(0, 0.05, (len(known), FACTORS))}
    p["bias"][0] = np.log(share / (1 - share))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    step = 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * 128 // len(train)))):
        order = rng.permutation(len(train))
        for at in range(0, len(order), 128):
            some = order[at:at + 128]
            # Part of the terms is hidden, so that each one has to tell by itself if it can.
            xs = x[some] * (rng.random(x[some].shape) >= HIDDEN)
            s = xs @ p["factors"]
            z = p["bias"][0] + xs @ p["weights"] + 0.5 * ((s * s).sum(axis=1) - xs @ (p["factors"] ** 2).sum(axis=1))
            e = (sigmoid(z) - y[some]) / len(some)
            slope = {
                "bias": np.array([e.sum()]),
                "weights": xs.T @ e + 3e-4 * p["weights"],
                "factors": xs.T @ (e[:, None] * s) - (xs.T @ e)[:, None] * p["factors"] + 3e-4 * p["factors"],
            }
            step += 1
            for k, g in slope.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] -= 0.02 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    model = {"known": known, "bias": float(p["bias"][0]), "weights": p["weights"], "factors": p["factors"], "share": share}
    at = np.flatnonzero(held) if held.any() else train
    model["slope"], model["offset"] = calibrate(logits(model, [numbers[i] for i in at]), labels[at])
    return model


def score_rows(model: dict, rows: list) -> np.ndarray:
    if not model["known"]:
        return np.full(len(rows), model["share"])
    return sigmoid(model["slope"] * logits(model, rows) + model["offset"])


def _score(sent, text_column, name):
    def step(batches):
        worker_cache("toxicity")  # those of other operators go
        model = sent.value
        terms = Terms(model["known"])
        for batch in batches:
            at = batch.schema.get_field_index
            rows = [terms(t.as_py()) for t in batch.column(at(text_column))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score_rows(model, rows), pa.float64())], names=[*batch.schema.names, name])

    return step


def held_out(id_column: str = "doc_id"):
    """Rows whose labels are never learned: crc32 of the id's text leaves 1 over 3."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "toxic", sample: int = SAMPLE,
) -> dict:
    """A machine fitted on at most `sample` labelled rows that are not held out."""
    chosen = (
        labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
        .where("id IS NOT NULL AND label IS NOT NULL").where(~held_out("id"))
        .groupBy("id").agg(F.max("label").alias("label"))
        .withColumn("turn", F.xxhash64("id")).orderBy("turn", "id").limit(sample)
    )
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = (
        texts.join(F.broadcast(chosen), "id").select("label", "turn", "text")
        .mapInArrow(_extract, "label int, turn bigint, terms array<int>").toPandas()
        .sort_values("turn", kind="stable")
    )
    return fit([np.asarray(r, np.int32) for r in rows["terms"]], (rows["label"].to_numpy() > 0).astype(float))


def score_toxicity(docs: DataFrame, model: dict, text_column: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the score of each whole text, from 0 to 1."""
    name = free_name(docs, name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_score(sent, text_column, name), f"{schema}, `{name}` double")


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
