"""Quality classifier by co-training of two views.

- Text content: frequencies of token shapes (`Xx.`, `x|`, `X!!`) and of their pairs,
  hashed, and how often a token repeats the one before it.
- Page metadata: language, source and length as given, and layout figures: lines, line
  and word lengths, shares of capitals, digits, marks, white space, distinct words.

Each view has a logistic classifier. It starts from labelled rows; in each round both
score a pool of unlabelled rows, and the rows a view is most sure of are added, with that
label, to what the other one learns. Each view is calibrated on labelled rows that were
never learned, and all documents are scored by the sum of the views' calibrated log odds,
weighted by how well each does on those rows.

Training takes at most `LABELLED` labelled and `POOL` unlabelled rows, in the order of a
hash of the id; features are made in tasks. Every whole text is scored.

Nulls in any column count as empty; an empty text has features like any other. Null
labels count as none, of several labels of an id the largest counts. Without rows of
both classes every document gets the share of class 1 (1 without any label: nothing is
rejected without evidence). Columns of `docs` named as a new one make way for it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closebook.llm.common import query, table, worker_cache
from closebook.llm.toxicity import calibrate, sigmoid

LABELLED = 4_000
POOL = 4_000
ROUNDS = 4
ADDED = 400
SURE = 0.95
CONTENT_BUCKETS = 256
NAMED_BUCKETS = 64
THRESHOLD = 0.5

_SHAPE = bytes(
    88 if 65 <= i <= 90 else 120 if 97 <= i <= 122 or i >= 128 else 57 if 48 <= i <= 57 else i for i in range(256)
)
_SAME = re.compile(rb"(x|X|9)\1+")


def _bucket(raw: bytes, buckets: int) -> int:
    return zlib.crc32(raw) % buckets


def content_features(text: str) -> np.ndarray:
    """Square roots of the shares of token shapes and shape pairs, and the share of repeats."""
    out = np.zeros(2 * CONTENT_BUCKETS + 1, np.float32)
    raw = text.encode("utf-8", "surrogatepass")
    tokens = raw.split()
    if not tokens:
        return out
    shapes = _SAME.sub(rb"\1", raw.translate(_SHAPE)).split()
    n = len(shapes)
    for shape, k in Counter(shapes).items():
        out[_bucket(shape[:12], CONTENT_BUCKETS)] += k / n
    for (a, b), k in Counter(zip(shapes, shapes[1:])).items():
        out[CONTENT_BUCKETS + _bucket(a[:12] + b" " + b[:12], CONTENT_BUCKETS)] += k / n
    out[-1] = sum(map(eq, tokens, tokens[1:])) / n
    return np.sqrt(out)


def metadata_features(lang: str, source: str, n_chars: int, text: str) -> np.ndarray:
    """Named buckets of language and source, and layout figures."""
    out = np.zeros(NAMED_BUCKETS + 12, np.float32)
    out[_bucket(f"lang {lang}".encode(), NAMED_BUCKETS)] = 1
    out[_bucket(f"source {source}".encode(), NAMED_BUCKETS)] = 1
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(len(raw), 1)
    kinds = np.bincount(raw, minlength=256)
    words = text.split()
    lines = text.split("\n")
    letters = kinds[65:91].sum() + kinds[97:123].sum() + kinds[128:].sum()
    blanks = kinds[[9, 10, 13, 32]].sum()
    digits = kinds[48:58].sum()
    out[NAMED_BUCKETS:] = (
        np.log1p(max(n_chars, 0)), np.log1p(len(lines)), np.log1p(n / len(lines)), np.log1p(len(words)),
        sum(map(len, words)) / max(len(words), 1) / 10, len(set(words)) / max(len(words), 1),
        kinds[65:91].sum() / max(letters, 1), digits / n, (n - letters - blanks - digits) / n, blanks / n,
        len(set(lines)) / len(lines), 1.0 if not text else 0.0,
    )
    return out


def _features(batch):
    at = batch.schema.get_field_index
    columns = [batch.column(at(c)).to_pylist() for c in ("lang", "source", "n_chars", "text")]
    content, metadata = [], []
    for lang, source, n_chars, text in zip(*columns, strict=True):
        text = text or ""
        content.append(content_features(text))
        metadata.append(metadata_features(lang or "", source or "", len(text) if n_chars is None else n_chars, text))
    wide = (2 * CONTENT_BUCKETS + 1, NAMED_BUCKETS + 12)
    return [np.array(x, np.float32).reshape(-1, w) for x, w in zip((content, metadata), wide, strict=True)]


def _extract(batches):
    for batch in batches:
        at = batch.schema.get_field_index
        for start in range(0, len(batch), 512):
            some = batch.slice(start, 512)
            content, metadata = _features(some)
            yield pa.RecordBatch.from_arrays(
                [some.column(at("label")), some.column(at("turn")),
                 pa.array([x.tobytes() for x in content], pa.binary()), pa.array([x.tobytes() for x in metadata], pa.binary())],
                names=["label", "turn", "content", "metadata"])


class Logistic:
    """L2-regularised logistic regression on standardised features, by Adam on all rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: float = 1e-3, steps: int = 300):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.02)
        z = ((x - self.mean) / self.scale).astype(np.float32)
        w, b = np.zeros(x.shape[1]), 0.0
        m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
        for t in range(1, steps + 1):
            e = (sigmoid(z @ w.astype(np.float32) + b) - y) / len(y)
            g = np.append(z.T @ e.astype(np.float32) + weight * w, e.sum())
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            move = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
            w -= move[:-1]
            b -= move[-1]
        self.w, self.b = w, b

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -20, 20) @ self.w + self.b


def cotrain(labelled: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS) -> dict:
    """Both classifiers, their calibration and weights. `labelled` and `pool` hold a matrix per view."""
    share = float(y.mean()) if len(y) else 1.0
    held = np.arange(len(y)) % 4 == 3
    if share in (0.0, 1.0) or len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return {"share": share}
    own = [[x[~held]] for x in labelled]
    target = [[y[~held]], [y[~held]]]
    free = [np.ones(len(p), bool) for p in pool]
    for turn in range(rounds + 1):
        models = [Logistic(np.concatenate(own[v]), np.concatenate(target[v])) for v in (0, 1)]
        curves = [calibrate(models[v].logits(labelled[v][held]), y[held]) for v in (0, 1)]
        if turn == rounds or not len(pool[0]):
            break
        for v in (0, 1):
            other = 1 - v
            p = sigmoid(curves[v][0] * models[v].logits(pool[v]) + curves[v][1])
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                rows = np.flatnonzero((sure >= SURE) & free[other])
                # As many of each class as its share, so that the classes stay as they are.
                number = int(round(ADDED * (share if label else 1 - share)))
                rows = rows[np.argsort(-sure[rows], kind="stable")[:number]]
                own[other].append(pool[other][rows])
                target[other].append(np.full(len(rows), label))
                free[other][rows] = False
    views = []
    for v in (0, 1):
        p = sigmoid(curves[v][0] * models[v].logits(labelled[v][held]) + curves[v][1])
        loss = -np.mean(np.where(y[held] > 0, np.log(np.maximum(p, 1e-12)), np.log(np.maximum(1 - p, 1e-12))))
        views.append({"model": models[v], "curve": curves[v], "trust": 1 / (loss + 0.02)})
    total = sum(v["trust"] for v in views)
    return {"share": share, "views": [{**v, "trust": v["trust"] / total} for v in views]}


def score_views(model: dict, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated scores of the views and of both together."""
    if "views" not in model:
        flat = np.full(len(features[0]), model["share"])
        return flat, flat, flat
    odds = [v["curve"][0] * v["model"].logits(x) + v["curve"][1] for v, x in zip(model["views"], features, strict=True)]
    both = sum(2 * v["trust"] * o for v, o in zip(model["views"], odds, strict=True))
    prior = np.log(model["share"] / (1 - model["share"]))
    return sigmoid(odds[0]), sigmoid(odds[1]), sigmoid(both - prior)


_ADDED = ("content_score", "metadata_score", "score")
#: Columns of the result that replace columns of the same name.
NEW = {*_ADDED, "accepted"}


def _score(sent, names):
    def step(batches):
        worker_cache("quality")  # those of other operators go
        model = sent.value
        for batch in batches:
            for start in range(0, len(batch), 512):
                some = batch.slice(start, 512)
                scores = score_views(model, _features(some))
                rest = [some.column(some.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(s, pa.float64()) for s in scores)], names=[*names, *_ADDED])

    return step


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float32) for x in column]) if len(column) else np.zeros((0, 1), np.float32)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> dict:
    """Co-trained views from bounded samples of labelled and of unlabelled documents."""
    marks = (
        labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    turn = F.xxhash64("doc_id")
    known = marks.withColumn("turn", turn).orderBy("turn", "doc_id").limit(labelled)
    rest = (
        docs.select("doc_id").where("doc_id IS NOT NULL").distinct().join(marks, "doc_id", "left_anti")
        .select("doc_id", F.lit(-1).alias("label"), turn.alias("turn")).orderBy("turn", "doc_id").limit(pool)
    )
    wanted = known.select("doc_id", "label", "turn").union(rest)
    rows = (
        docs.select("doc_id", "lang", "source", "n_chars", "text").join(F.broadcast(wanted), "doc_id").drop("doc_id")
        .mapInArrow(_extract, "label int, turn bigint, content binary, metadata binary").toPandas()
        .sort_values("turn", kind="stable")
    )
    has = rows[rows["label"] >= 0]
    free = rows[rows["label"] < 0]
    return cotrain(
        [_matrix(has["content"]), _matrix(has["metadata"])], (has["label"].to_numpy() > 0).astype(float),
        [_matrix(free["content"]), _matrix(free["metadata"])],
    )


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """`docs` with `content_score`, `metadata_score`, `score` and `accepted`."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in NEW])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.mapInArrow(_score(sent, docs.columns), schema + "".join(f", {n} double" for n in _ADDED))
    return scored.withColumn("accepted", F.col("score") >= THRESHOLD)


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", *_ADDED, F.col("accepted").cast("int").alias("predicted"))
