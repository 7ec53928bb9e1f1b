"""Suffix-array dedup: bytes covered by a 400-byte string that also starts elsewhere.

Texts are UTF-8 bytes; matches never cross documents; a string may recur in its own
document; overlaps count; everything is judged on the input. Every byte of a repeated
string goes, the first occurrence included.

The corpus is cut so that equal strings meet in one task:

1. Each 400-byte window is assigned to the least of the hashes of its 100-byte
   substrings (the leftmost one on a tie), which only its own bytes decide. Consecutive
   windows with one hash make a segment.
2. Hashes that occur at one place only are dropped. Documents with equal texts are one.
   Equal segments are one, with their number; if it is two or more, all its windows
   are repeated.
3. The segments of a hash that has several different ones, or one that may repeat
   itself, are concatenated, with those
   of other hashes, to blocks. In each block threshold-bounded interval expansion on the
   Burrows-Wheeler transform finds which windows are equal: from the interval of the
   empty string, breadth first, each interval is extended backward by every byte before
   it; the first interval to end at a place sets the common prefix there to the length
   so far. Values come in increasing order, and at 400 it stops: places still without a
   value share 400 bytes.
4. A hash with more bytes than a block is dealt over several by a hash of the segment.
   Each block then also reports the digests of its distinct windows, and digests that
   meet from several blocks join them.
5. Repeated windows go back to their places, documents and rows.

Null and empty texts have no bytes. Texts under 400 bytes keep everything. An empty
table gives an empty result. Rows that repeat a text or an id are each reported.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closebook.llm.common import query, table, whole, written
from closebook.llm.shingles import _powers, mix64

LENGTH = 400
GRAM = 100
STARTS = 1 << 19
BLOCK_BYTES = 2_000_000
SEPARATOR = 0xFF  # in no UTF-8 text
_INDEX_BITS = 20


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(hash, first start, last start, again) of the segments of a text, in order, as four arrays.

    `again` tells that the hash is that of several substrings of the segment (periodic text),
    so that its windows may be equal to each other.
    """
    keys, firsts, lasts, again = [], [], [], []
    for at in range(0, max(len(data) - length + 1, 0), STARTS):
        piece = data[at:at + STARTS + length - 1]
        n = len(piece)
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        hashes = mix64((total[gram:] - total[:-gram]) * down[:n - gram + 1])
        index = np.arange(len(hashes), dtype=np.uint64)
        least = (hashes >> np.uint64(_INDEX_BITS) << np.uint64(_INDEX_BITS)) | index
        width, window = 1, length - gram + 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < window:
            least = np.minimum(least[:len(least) - (window - width)], least[window - width:])
        place = (least & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64)
        key = hashes[place]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        keys.append(key[new].view(np.int64))
        firsts.append(new + at)
        last = np.concatenate([new[1:], [len(key)]]) - 1
        lasts.append(last + at)
        again.append(place[last] != place[new])
    if not keys:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, bool)
    return np.concatenate(keys), np.concatenate(firsts), np.concatenate(lasts), np.concatenate(again)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of `text` in the order of at least their first `depth` bytes, by prefix doubling."""
    n = len(text)
    words = np.zeros(n, np.uint64)
    for j in range(8):
        words = (words << np.uint64(8)) | np.roll(text, -j)
    order = np.argsort(words, kind="stable")
    ranks = np.empty(n, np.int64)
    ranks[order] = np.concatenate([[0], np.cumsum(words[order][1:] != words[order][:-1])])
    known = 8
    while known < depth and ranks[order[-1]] < n - 1:
        pair = ranks * n + np.roll(ranks, -known)
        order = np.argsort(pair, kind="stable")
        at = pair[order]
        ranks[order] = np.concatenate([[0], np.cumsum(at[1:] != at[:-1])])
        known *= 2
    return order


def equal_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each place in it the class of suffixes with equal first `length` bytes.

    Interval expansion: an interval [a, b) holds the suffixes that begin with some string;
    extended backward by a byte c it becomes the interval of those that begin with c and
    that string, whose bounds the transform gives.
    """
    n = len(text)
    order = suffix_order(text, length + 1)
    before = text[order - 1]
    by_byte = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)  # place of the suffix that is one byte longer
    step[by_byte] = np.arange(n)
    differs = np.zeros(n + 1, bool)  # the suffix here and the one before it: common prefix known, under `length`
    differs[0] = differs[n] = True
    begins, ends = np.array([0]), np.array([n])
    for _ in range(length):
        sizes = ends - begins
        owner = np.repeat(np.arange(len(begins)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[owner]
        kind = owner * 256 + before[place]
        if len(place) > len(begins):
            grouped = np.argsort(kind, kind="stable")
            kind, place = kind[grouped], place[grouped]
        head = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        count = np.diff(np.concatenate([head, [len(kind)]]))
        begins = step[place[head]]
        ends = begins + count
        fresh = ~differs[ends]
        differs[ends[fresh]] = True
        begins, ends = begins[fresh], ends[fresh]
        if not len(begins):
            break
    return order, np.cumsum(differs[:n]) - 1


def repeated_windows(pieces: list[np.ndarray], length: int = LENGTH):
    """For each piece, a boolean per window start: does it recur among the pieces?
    And the class number of each window."""
    lengths = np.array([len(p) + 1 for p in pieces])
    text = np.full(int(lengths.sum()), SEPARATOR, np.uint8)
    begins = np.cumsum(lengths) - lengths
    for b, p in zip(begins, pieces, strict=True):
        text[b:b + len(p)] = p
    order, classes = equal_prefixes(text, length)
    size = np.bincount(classes)
    own = np.empty(len(text), np.int64)
    own[order] = classes
    out = []
    for b, p in zip(begins, pieces, strict=True):
        mine = own[b:b + len(p) - length + 1]
        out.append((size[mine] > 1, mine))
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def _anchors(length, gram):
    """Of each text its digest, and the hash and first start of each segment; a segment
    that may repeat itself counts as two places."""

    def step(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            digests, texts = batch.column(at("digest")), batch.column(at("text"))
            owner, keys, firsts = [], [], []
            for n, text in enumerate(texts):
                k, f, _, again = segments(_bytes(text.as_py()), length, gram)
                owner.append(np.full(len(k) + again.sum(), n))
                keys += [k, k[again]]
                firsts += [f, f[again] + 1]
            owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [digests.take(pa.array(owner, pa.int64())),
                 pa.array(np.concatenate(keys) if keys else [], pa.int64()),
                 pa.array(np.concatenate(firsts) if firsts else [], pa.int64())],
                names=["digest", "key", "first"])

    return step


def _cut(length, gram):
    """The segments of a text whose hash is among its `keys`."""

    def step(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            columns = (batch.column(at(c)) for c in ("digest", "text", "keys"))
            rows, held = [[] for _ in _CUT], 0
            for digest, text, wanted in zip(*columns, strict=True):
                data = _bytes(text.as_py())
                keys, firsts, lasts, again = segments(data, length, gram)
                for i in np.flatnonzero(np.isin(keys, np.array(wanted.as_py(), np.int64))):
                    piece = data[firsts[i]:lasts[i] + length].tobytes()
                    for column, value in zip(rows, (
                        digest.as_py(), int(keys[i]), int(firsts[i]), hashlib.blake2b(piece, digest_size=16).digest(),
                        bool(again[i]), piece,
                    ), strict=True):
                        column.append(value)
                    held += len(piece)
                    if held > 8_000_000:
                        yield _cut_batch(rows)
                        rows, held = [[] for _ in _CUT], 0
            yield _cut_batch(rows)

    return step


_CUT = ("digest", "key", "first", "piece_id", "again", "piece")


def _cut_batch(rows):
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=list(_CUT))


_FOUND = ("key", "piece_id", "a", "b", "window")


def _expand(length, block_bytes):
    """Blocks of segments, streamed in the order of (key, salt); one block is held at a time.

    Comes out: runs [a, b) of repeated window starts of a segment (`window` null), and
    for hashes dealt over several blocks the digest of each distinct window, with the
    place of a window that is alone in its block (a) or null.
    """

    def finish(held):
        rows = [[] for _ in _FOUND]

        def add(*values):
            for column, value in zip(rows, values, strict=True):
                column.append(value)

        if held:
            for (key, piece_id, data, blocks), (again, classes) in zip(
                held, repeated_windows([h[2] for h in held], length), strict=True
            ):
                for a, b in _runs(again):
                    add(key, piece_id, a, b, None)
                if blocks > 1:
                    for i, (more, number) in enumerate(zip(again.tolist(), classes.tolist(), strict=True)):
                        if not more or number not in told:
                            if more:
                                told.add(number)
                            window = hashlib.blake2b(data[i:i + length].tobytes(), digest_size=16).digest()
                            add(key, piece_id, None if more else i, None, window)
        told.clear()
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=list(_FOUND))

    told: set[int] = set()

    def step(batches):
        held, size, unit = [], 0, None
        for batch in batches:
            at = batch.schema.get_field_index
            columns = (batch.column(at(c)) for c in ("key", "salt", "piece_id", "piece", "blocks"))
            for key, salt, piece_id, piece, blocks in zip(*columns, strict=True):
                mark = (key.as_py(), salt.as_py())
                if mark != unit and size > block_bytes:
                    yield finish(held)
                    held, size = [], 0
                unit = mark
                data = np.frombuffer(piece.as_py(), np.uint8)
                held.append((mark[0], piece_id.as_py(), data, blocks.as_py()))
                size += len(data)
        yield finish(held)

    return step


def _strip(length):
    """Counts and digest of what is left of each text when the windows of `runs` go."""

    def step(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            digests = batch.column(at("digest"))
            removed, spans, left = [], [], []
            for text, runs in zip(batch.column(at("text")), batch.column(at("runs")), strict=True):
                data = _bytes(text.as_py())
                edges = np.zeros(len(data) + 1, np.int32)
                for r in runs.as_py():
                    edges[r["a"]] += 1
                    edges[r["b"] - 1 + length] -= 1
                gone = np.cumsum(edges[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(len(_runs(gone)))
                left.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [digests, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.string())],
                names=["digest", "n_removed", "n_spans", "kept_sha256"])

    return step


def repeated_runs(
    docs: DataFrame, text_column: str = "text", length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """For each distinct text that has some: its runs [a, b) of repeated window starts.

    Returns (digest, text, keys) of texts that may have repeats and (digest, a, b); the digest is
    the binary MD5 of the text. Repeats between rows of equal text are not among the runs.
    """
    text = whole(text_column)
    own = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))
    long = own.where(F.octet_length("text") >= length)
    anchors = written(long.mapInArrow(_anchors(length, gram), "digest binary, key bigint, first bigint"), "anchors")
    place = F.xxhash64("digest", "first")
    shared = (
        anchors.select("key", place.alias("place")).groupBy("key")
        .agg(F.min("place").alias("p"), F.max("place").alias("q")).where("p <> q").select("key")
    )
    wanted = anchors.select("digest", "key").join(shared, "key").groupBy("digest").agg(F.collect_set("key").alias("keys"))
    texts = long.groupBy("digest").agg(F.any_value("text").alias("text"))
    chosen = written(texts.join(wanted, "digest"), "candidates")

    cut = written(
        chosen.mapInArrow(_cut(length, gram), "digest binary, key bigint, first bigint, piece_id binary, again boolean, piece binary"), "segments")
    pieces = cut.groupBy("key", "piece_id").agg(
        F.count("*").alias("copies"), F.any_value("again").alias("again"), F.any_value("piece").alias("piece"))
    pieces = written(pieces, "pieces")
    size = F.octet_length("piece")
    shape = pieces.groupBy("key").agg(
        F.count("*").alias("kinds"), F.bool_or("again").alias("again"), F.sum(size).alias("bytes"),
    ).where("kinds > 1 OR again").select(
        "key", F.ceil(F.col("bytes") / block_bytes).cast("int").alias("blocks"))
    dealt = (
        pieces.join(shape, "key")
        .select("key", "piece_id", "piece", "blocks", F.pmod(F.xxhash64("piece_id"), F.col("blocks")).cast("int").alias("salt"))
        .repartition("key", "salt").sortWithinPartitions("key", "salt")
    )
    found = written(
        dealt.mapInArrow(_expand(length, block_bytes), "key bigint, piece_id binary, a bigint, b bigint, window binary"), "found")
    inside = found.where("window IS NULL").select("key", "piece_id", "a", "b")
    across = found.where("window IS NOT NULL")
    met = across.groupBy("window").agg(F.count("*").alias("k")).where("k > 1").select("window")
    alone = across.where("a IS NOT NULL").join(met, "window").select("key", "piece_id", "a", (F.col("a") + 1).alias("b"))
    copied = pieces.where("copies > 1").select(
        "key", "piece_id", F.lit(0).cast("bigint").alias("a"), (size - length + 1).cast("bigint").alias("b"))
    runs = cut.select("digest", "key", "first", "piece_id").join(inside.union(alone).union(copied), ["key", "piece_id"])
    return chosen, runs.select("digest", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_removed, n_spans, kept_sha256, removed_share
    (removed bytes of all, 0 for an empty text)."""
    chosen, runs = repeated_runs(docs, text_column, length, gram, block_bytes)
    listed = runs.groupBy("digest").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    stripped = chosen.select("digest", "text").join(listed, "digest").mapInArrow(
        _strip(length), "digest binary, n_removed bigint, n_spans bigint, kept_sha256 string")
    text = whole(text_column)
    rows = docs.select(
        F.col(id_column).alias(id_column), F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    copies = rows.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")
    facts = stripped.join(copies, "digest", "full")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    out = rows.join(facts, "digest", "left").select(
        id_column, "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )
    return out.withColumn("removed_share", F.col("n_removed") / F.greatest("n_bytes", F.lit(1)))


@query("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without its repeated 400-byte strings."""
    return remove_repeats(table(spark, sf_dir, "documents"))
