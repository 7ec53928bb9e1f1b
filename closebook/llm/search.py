"""Ranked lexical search: accumulator-limited term-at-a-time over blocks of documents.

The items of the benchmark are the stated query set; their distinct terms are the
vocabulary. Every document is scored against every item it can still win for:

1. One pass over the texts counts, in tasks, the terms of each document (`n`) and the
   occurrences of vocabulary terms. The counts are written; texts are read once.
2. Sums over them are the statistics: N documents with a term, L terms, and df of each
   vocabulary term (combined before the shuffle; at most a row a term and task).
3. Blocks of `BLOCK_POSTINGS` counts are inverted in a task. An item takes its terms one at
   a time, rarest first. A term that may create accumulators adds its part to every document
   that holds it. The bound of a term is the largest part it has in the block. Once
   the bounds of the terms left sum to less than the tenth best partial score, no document
   without an accumulator can reach the ten, and no more are created; from then on also those
   survivors go whose partial score and bound cannot reach it. The others are updated
   exactly, by looking them up in the postings.
4. The best ten of a block hold every one of the best ten of all that lies in the block.
   Each task keeps ten of its blocks by item, then a window ranks what tasks found.

A score is exact integer arithmetic, so the order of terms does not matter. The vocabulary
is broadcast, as are weights and items: they grow with the benchmark, not with the
documents. Above `VOCABULARY_BYTES` of item texts the items are taken in blocks, each with a
pass of its own.

Null and empty texts, and items without a term, match nothing. Equal scores rank by
ascending doc_id, rows without an id last and rows of one id in any order, each in its own
rank. Rows that repeat an item count as one where texts are equal; an id with several
texts has the terms of all. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from closebook.llm.common import LOWER, UPPER, query, table, worker_cache, written

TOP = 10
BLOCK_POSTINGS = 4_000_000
VOCABULARY_BYTES = 16_000_000
COUNTS = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"
#: Bytes of UTF-8 to terms: A-Z in lower case, what is neither letter, digit nor non-ASCII to a space.
_TERM_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TERM_BYTES).split()


def weight(N: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * N + 2) / (2 * df + 1)))


def part(w, tf, n, N: int, L: int):
    """What a term adds to the score of a document, in 64-bit integers."""
    m = 100 - 90 + (90 * n * N) // L
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _count(sent):
    def step(batches):
        worker_cache("search")  # those of other operators go
        numbers = sent.value
        for batch in batches:
            n, terms, tfs = [], [], []
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
            for text in texts:
                words = text.as_buffer().to_pybytes().translate(_TERM_BYTES).split() if text.is_valid else []
                held: dict[int, int] = {}
                for word in words:
                    at = numbers.get(word)
                    if at is not None:
                        held[at] = held.get(at, 0) + 1
                n.append(len(words))
                terms.append(list(held))
                tfs.append(list(held.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "tfs"])

    return step


class Block:
    """Documents inverted: postings of a term are positions of documents, ascending, and parts."""

    def __init__(self, ids, named, lengths, terms, tfs, sizes, weights, N, L):
        self.ids, self.named = ids, named
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(terms, kind="stable")
        terms, self.docs, tf = terms[order], owner[order], tfs[order]
        self.parts = part(weights[terms], tf, lengths[self.docs], N, L)
        self.terms, begins = np.unique(terms, return_index=True)
        self.begins = np.append(begins, len(terms))
        self.bounds = np.maximum.reduceat(self.parts, begins) if len(terms) else np.zeros(0, np.int64)
        self.scores = np.zeros(len(sizes), np.int64)

    def best(self, wanted: np.ndarray, k: int):
        """Positions and scores of the best k for terms in order of rarity; see the module.

        `touched` counts postings and look-ups, which tests hold against exhaustive scoring.
        """
        at = np.searchsorted(self.terms, wanted)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == wanted)] if len(self.terms) else at[:0]
        left = np.append(np.cumsum(self.bounds[at][::-1])[::-1], 0)  # bound of the terms from here on
        scores, held, threshold, touched = self.scores, None, 0, 0
        seen: list[np.ndarray] = []
        for turn, t in enumerate(at):
            docs = self.docs[self.begins[t]:self.begins[t + 1]]
            if held is None and left[turn] < threshold:
                held = np.flatnonzero(scores) if len(seen) > 8 else np.unique(np.concatenate(seen))
            if held is None:
                scores[docs] += self.parts[self.begins[t]:self.begins[t + 1]]
                seen.append(docs)
                touched += len(docs)
                partial = scores[docs]
                if len(partial) >= k:  # the k-th best of some accumulators bounds that of all from below
                    threshold = max(threshold, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
                continue
            alive = scores[held] + left[turn] >= threshold
            if not alive.all():
                scores[held[~alive]] = 0
                held = held[alive]
            if len(held) * 16 < len(docs):
                place = np.searchsorted(docs, held)
                place[place == len(docs)] = 0
                hit = docs[place] == held
                scores[held[hit]] += self.parts[self.begins[t]:self.begins[t + 1]][place[hit]]
                touched += len(held)
            else:
                has = np.zeros(len(scores), bool)
                has[held] = True
                hit = has[docs]
                scores[docs[hit]] += self.parts[self.begins[t]:self.begins[t + 1]][hit]
                touched += len(docs)
            if len(held) >= k:
                partial = scores[held]
                threshold = max(threshold, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
        self.touched = touched
        found = held if held is not None else (np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64))
        values = scores[found]
        for docs in seen:
            scores[docs] = 0
        found, values = found[values > 0], values[values > 0]
        order = np.lexsort((self.ids[found], ~self.named[found], -values))[:k]
        return found[order], values[order]


def _search(sent, N, L, k, block_postings):
    def finish(batches, best):
        items, weights = sent.value
        ids = pa.chunked_array([b.column("doc_id") for b in batches])
        named = ids.is_valid().to_numpy()
        numbers = ids.fill_null(0).to_numpy()
        lists = [b.column("terms") for b in batches]
        sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in lists])
        terms = np.concatenate([c.flatten().to_numpy() for c in lists])
        tfs = np.concatenate([b.column("tfs").flatten().to_numpy() for b in batches])
        lengths = pa.chunked_array([b.column("n") for b in batches]).to_numpy()
        block = Block(numbers, named, lengths, terms, tfs, sizes, weights, N, L)
        for item, wanted in enumerate(items):
            found, scores = block.best(wanted, k)
            if len(found):
                old = best.get(item)
                new = [numbers[found], ~named[found], scores]
                if old is not None:
                    new = [np.concatenate(pair) for pair in zip(old, new, strict=True)]
                    order = np.lexsort((new[0], new[1], -new[2]))[:k]
                    new = [column[order] for column in new]
                best[item] = new

    def step(batches):
        held, postings, best = [], 0, {}
        for batch in batches:
            # Batches are cut, so that one of very long documents does not exceed a block.
            at = 0
            while at < batch.num_rows:
                counts = np.diff(batch.column("terms").slice(at).offsets.to_numpy())
                fits = int(np.searchsorted(np.cumsum(counts), block_postings - postings, side="right"))
                rows = min(batch.num_rows - at, max(fits, 0 if held else 1))
                if rows:
                    held.append(batch.slice(at, rows))
                    postings += int(counts[:rows].sum())
                    at += rows
                if at < batch.num_rows:
                    finish(held, best)
                    held, postings = [], 0
        if held:
            finish(held, best)
        out = [(item, None if unnamed else int(i), int(s)) for item, found in best.items() for i, unnamed, s in zip(*found, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())],
            names=["item", "doc_id", "score"])

    return step


def _item_blocks(items: DataFrame, item_id: str, text: str, limit: int):
    """Blocks of (item id, terms) with at most `limit` bytes of text, one held at a time."""
    rows = items.where(F.col(text).isNotNull()).groupBy(F.col(item_id).alias("i")).agg(F.collect_set(text).alias("texts"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        terms = sorted({t for one in row["texts"] for t in terms_of(one)})
        if not terms:
            continue
        size += sum(map(len, row["texts"]))
        if block and size > limit:
            yield block
            block, size = [], sum(map(len, row["texts"]))
        block.append((row["i"], terms))
    if block:
        yield block


def _search_block(docs: DataFrame, block: list, k: int, block_postings: int) -> DataFrame:
    """Best k documents (item number, doc_id, score) of each task for each item of a block."""
    context = docs.sparkSession.sparkContext
    vocabulary = sorted({t for _, terms in block for t in terms})
    numbers = {t: i for i, t in enumerate(vocabulary)}
    counts = written(docs.mapInArrow(_count(context.broadcast(numbers)), COUNTS), "counts")
    N, L = counts.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[r["t"]] = r["count"]
    weights = np.array([weight(N, int(d)) for d in df], np.int64)
    order = np.lexsort((np.arange(len(df)), df))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    wanted = [np.array(sorted((numbers[t] for t in terms), key=place.__getitem__), np.int64) for _, terms in block]
    sent = context.broadcast((wanted, weights))
    busy = counts.where(F.size("terms") > 0)
    return busy.mapInArrow(_search(sent, N or 0, L or 1, k, block_postings), "item int, doc_id bigint, score bigint")


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_postings: int = BLOCK_POSTINGS, vocabulary_bytes: int = VOCABULARY_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    schema = f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id bigint, score bigint"
    out = None
    for block in _item_blocks(items, item_id, item_text, vocabulary_bytes):
        found = _search_block(rows, block, k, block_postings)
        best = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        named = spark.createDataFrame(
            [(n, i) for n, (i, _) in enumerate(block)], f"item int, item_id {items.schema[item_id].dataType.simpleString()}")
        best = best.join(named, "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.union(written(best, "ranked"))
    return out if out is not None else spark.createDataFrame([], schema)


_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents WHERE text IS NOT NULL),
tfs AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY doc_id, t),
lengths AS (SELECT doc_id, sum(tf) AS n FROM tfs GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
dfs AS (SELECT t, count(*) AS df FROM tfs GROUP BY t),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark WHERE text IS NOT NULL),
parts AS (
    SELECT item_id, doc_id, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT)
        * CAST((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * CAST(n AS BIGINT) * docs) // terms)) AS BIGINT) AS part
    FROM wanted JOIN tfs USING (t) JOIN dfs USING (t) JOIN lengths USING (doc_id), total),
scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM parts GROUP BY item_id, doc_id),
ranked AS (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""


@query("op13_ranked_search", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
