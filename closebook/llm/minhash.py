"""MinHash near-dedup: circulant signatures, banding, exact Jaccard.

A document is its set of distinct 5-word shingles. Two permutations of the numbers
below 2**32 make all signature coordinates: coordinate k is the least value, over the
set, of the second permutation at the first one's value shifted circularly by k.
24 bands of 4 coordinates propose candidates; a pair that is 0.85 alike is proposed
with probability 1 - (1 - 0.85**4)**24 > 0.9999999, and every link is confirmed on the
full sets: 100 * |a & b| >= 85 * |a | b|.

No group is expanded into all its pairs and none has to fit one task:

1. Documents with equal sets are one class; only its first document goes on.
2. In each bucket every member is compared with the bucket's centre, two rounds with
   different centres. Members are streamed past the set of their centre; a centre
   with many members is salted.
3. Components of these links leave few buckets whose members are still apart. Buckets
   with equal members count once; their members are cut into blocks by hash, each pair
   of blocks is one unit of work, and within it all pairs of different components
   are compared exactly. Only links that join something come out.

Nulls and texts without words have an empty set and link with nothing. Rows of equal
text are alike. A component's id is its smallest doc_id; rows without doc_id count only
where no row of the component has one (the id is then null and the rows are kept). Rows
that repeat a doc_id are each reported. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closebook.llm.common import query, table, whole, written
from closebook.llm.components import components
from closebook.llm.shingles import common, mix64, shingle_set

BANDS, ROWS = 24, 4
SHINGLE = 5
LIKE = 85
ROUNDS = 2
MEMBERS_PER_SALT = 2048
BLOCK_MEMBERS, BLOCK_BYTES = 512, 2_000_000


def _permute32(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection on 32-bit numbers, in place."""
    for shift, factor in ((16, a), (15, b)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash coordinates of a set that is not empty."""
    first = _permute32((shingles >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(coordinates, dtype=np.uint32)
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(first), 512):
        values = _permute32(first[at:at + 512, None] + shifts[None, :], 0x21F0AAAD, 0xD35A2D97)
        np.minimum(least, values.min(axis=0), out=least)
    return least


def band_hashes(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature(shingles, bands * rows).reshape(bands, rows).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return out.view(np.int64)


def _sign(size, bands, rows):
    def step(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            n, cls, hashes = [], [], []
            for text in texts:
                s = shingle_set(text.as_py(), size)
                n.append(len(s))
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                hashes.append(band_hashes(s, bands, rows) if len(s) else None)
            rest = [i for i, f in enumerate(batch.schema) if f.name != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in rest]
                + [pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
                names=[batch.schema.field(i).name for i in rest] + ["n", "cls", "bands"],
            )

    return step


def _sets(size):
    def step(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            sets = [shingle_set(t.as_py(), size).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("rep")), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return step


def _verify(like):
    """Stream rows of a centre and its members, sorted so that the centre comes first."""

    def step(batches):
        centre, own = None, None
        for batch in batches:
            u, v = [], []
            for c, member, raw in zip(*(batch.column(batch.schema.get_field_index(x)) for x in ("centre", "rep", "shingles")), strict=True):
                c, member = c.as_py(), member.as_py()
                s = np.frombuffer(raw.as_py(), np.uint64)
                if member == c:
                    centre, own = c, s
                elif c == centre:
                    both = common(own, s)
                    if 100 * both >= like * (len(own) + len(s) - both):
                        u.append(c)
                        v.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return step


def _unit_links(reps, labels, sets, like):
    """Links between members of different labels that join something, for one unit of work."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    values, begins, counts = np.unique(flat[order], return_index=True, return_counts=True)
    shared = counts > 1
    if not shared.any():
        return
    postings = owner[order]
    group = {label: label for label in labels}

    def root(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for i, own in enumerate(sets):
        at = np.searchsorted(values, own)
        at = at[shared[at]]
        if not len(at):
            continue
        total = int(counts[at].sum())
        steps = np.arange(total) - np.repeat(np.cumsum(counts[at]) - counts[at], counts[at])
        both = np.bincount(postings[np.repeat(begins[at], counts[at]) + steps], minlength=len(sets))
        both[:i + 1] = 0
        for j in np.flatnonzero(100 * both >= like * (sizes[i] + sizes - both)):
            if both[j] and root(labels[i]) != root(labels[j]):
                group[root(labels[i])] = root(labels[j])
                yield reps[i], reps[j]


def _compare_units(like):
    """Stream rows of units (h, i, j), sorted by unit; one unit is held at a time."""

    def step(batches):
        unit, held, found = None, {}, []

        def finish():
            rows = list(held.values())
            if len({r[1] for r in rows}) > 1:
                found.extend(_unit_links([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], like))

        names = ("h", "i", "j", "rep", "label", "shingles")
        for batch in batches:
            for h, i, j, rep, label, raw in zip(*(batch.column(batch.schema.get_field_index(x)) for x in names), strict=True):
                key = (h.as_py(), i.as_py(), j.as_py())
                if key != unit:
                    finish()
                    unit, held = key, {}
                held[rep.as_py()] = (rep.as_py(), label.as_py(), np.frombuffer(raw.as_py(), np.uint64))
            yield _links(found)
            found = []
        finish()
        yield _links(found)

    return step


def _links(found):
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["u", "v"])


def _fits(a: str, b: str, like: int):
    """Sets of these sizes can be alike at all."""
    return 100 * F.least(a, b) >= like * F.greatest(a, b)


def _star_links(members: DataFrame, sets: DataFrame, salt_round: int, like: int) -> DataFrame:
    """Confirmed links of bucket members (h, rep, n) with the centre of their bucket."""
    rank = F.lit(0).cast("bigint") if salt_round == 0 else F.xxhash64(F.col("rep"), F.lit(salt_round))
    centres = (
        members.groupBy("h").agg(F.min(F.struct(rank.alias("r"), "rep", "n")).alias("c"), F.max("rep").alias("last"), F.min("rep").alias("first"))
        .where("first < last").select("h", F.col("c.rep").alias("centre"), F.col("c.n").alias("m"))
    )
    pairs = members.join(centres, "h").where("rep <> centre").where(_fits("n", "m", like)).select("centre", "rep").distinct()
    pairs = written(pairs, "pairs")
    salts = pairs.groupBy("centre").agg(F.count("*").alias("k")).select(
        "centre", F.ceil(F.col("k") / MEMBERS_PER_SALT).cast("int").alias("salts"))
    member = pairs.join(salts, "centre").select(
        "centre", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"), "rep")
    centre = salts.select("centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("centre").alias("rep"))
    rows = (
        member.union(centre).join(sets, "rep")
        .repartition("centre", "salt")
        .sortWithinPartitions("centre", "salt", F.when(F.col("rep") == F.col("centre"), 0).otherwise(1))
        .select("centre", "rep", "shingles")
    )
    return rows.mapInArrow(_verify(like), "u bigint, v bigint")


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (h, rep, n, label) of the buckets that more than one component meets in."""
    labelled = members.join(labels, members.rep == labels.node, "left").select(
        "h", "rep", "n", F.coalesce("label", "rep").alias("label"))
    open_ones = labelled.groupBy("h").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("h")
    return labelled.join(open_ones, "h")


def _block_links(apart: DataFrame, sets: DataFrame, like: int) -> DataFrame:
    """Links across components within buckets, by pairs of blocks of members."""
    shape = apart.groupBy("h").agg(
        F.count("*").alias("k"), F.sum("n").alias("words"), F.bit_xor(F.xxhash64("rep")).alias("x"),
        F.sum(F.xxhash64("rep", F.lit(1)).bitwiseAND(F.lit((1 << 31) - 1))).alias("s"),
    )
    once = shape.groupBy("k", "words", "x", "s").agg(F.min("h").alias("h")).select(
        "h", F.greatest(F.ceil(F.col("k") / BLOCK_MEMBERS), F.ceil(F.col("words") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks")).cast("int")
    placed = (
        apart.join(once, "h").withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "label")
    )
    rows = placed.join(sets, "rep").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return rows.mapInArrow(_compare_units(like), "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE,
    like: int = LIKE, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per row of `docs`: `row`, its id, `n_shingles`, `component` (the smallest
    row number it can reach), `component_id` (the smallest id), `text_key`."""
    text = whole(text_column)
    keyed = docs.select(F.col(id_column).alias("id"), F.sha2(text, 256).alias("text_key"), text.alias("text"))
    signed = keyed.mapInArrow(
        _sign(size, bands, rows), f"id {docs.schema[id_column].dataType.simpleString()}, text_key string, n bigint, cls binary, bands array<bigint>")
    signed = written(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")

    classes = written(
        signed.where("cls IS NOT NULL").groupBy("cls").agg(
            F.min(F.struct("row", "text_key")).alias("first"), F.min("id").alias("id"), F.any_value("n").alias("n"),
            F.any_value("bands").alias("bands"),
        ).select("cls", F.col("first.row").alias("rep"), F.col("first.text_key").alias("text_key"), "id", "n", "bands"),
        "classes",
    )
    buckets = classes.select("rep", "n", F.explode("bands").alias("h"))
    shared = buckets.groupBy("h").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("h")
    members = written(buckets.join(shared, "h").select("h", "rep", "n"), "buckets")

    wanted = members.select("rep").distinct().join(classes.select("rep", "text_key"), "rep")
    texts = docs.select(F.sha2(text, 256).alias("text_key"), text.alias("text")).join(wanted, "text_key", "right")
    texts = texts.groupBy("rep").agg(F.any_value("text").alias("text"))
    sets = written(texts.mapInArrow(_sets(size), "rep bigint, shingles binary"), "sets")

    links, apart = None, members
    for turn in range(ROUNDS):
        more = _star_links(apart.select("h", "rep", "n"), sets, turn, like)
        links = written(more if links is None else links.union(more), "linked")
        labels = components(links)
        apart = written(_apart(members if turn == 0 else apart.drop("label"), labels), "apart")
    links = links.union(_block_links(apart, sets, like))
    labels = components(links)

    named = classes.join(labels, classes.rep == labels.node, "left").select(
        "cls", "id", F.coalesce("label", "rep").alias("component"))
    ids = named.groupBy("component").agg(F.min("id").alias("component_id"))
    known = named.select("cls", "component").join(ids, "component")
    return signed.join(known, "cls", "left").select(
        "row", F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "text_key",
        F.coalesce("component", "row").alias("component"),
        F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


@query("op9_minhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents; one row per document."""
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
