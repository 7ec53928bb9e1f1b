"""Filter interaction audit by incremental retraction streaming.

Filters on the text are conditions A to D; filter E fails for a text that some smaller
doc_id has, wherever in the table. A document's failures are a mask of five bits, and all
numbers of the audit, in any order of the filters, follow from how many documents of a
part have each of the 32 masks.

The masks are kept by a stream. All files go through it as available-now micro-batches:

1. Each row becomes (digest of its text, id, part, mask of A to D, label bits). Equal rows
   of an Arrow batch are counted together before any shuffle, and those above the least id
   of their text in that batch are marked: they fail E whatever comes. So a text that a
   third of the table holds reaches the state as a few counts per task.
2. The state of a text is its least id so far and the counts of the rows with that id. A
   smaller id retracts them: their masks leave the part's counters and return with bit E.
   A call of Python for each text costs 6 ms, so the state is keyed by pages of texts, by
   digest, and a page is settled in one vectorized step. Pages grow in number with the
   input, not in size.
3. Every micro-batch writes the sum of its changes under its batch number, so a batch that
   runs twice is counted once. The state is in RocksDB, not in the heap.

The counters are then the sum over batches: at most 128 rows a part, whatever the input.

Null texts are empty. Null sources are the part ''. Rows of equal text and id are all the
least or all not. Rows without an id have no smaller id and are smaller than none: they
never fail E. Labels of one id count as good or toxic if any row of it says so; rows
without a label are neither. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from closebook.llm.common import query, table
from closebook.session import scratch_path

#: The text filters in bit order; E, bit 16, is the one on equal texts.
LETTERS = "ABCDE"
TWIN = 16
GOOD, TOXIC = 1, 2
#: Between these many micro-batches, none above this size unless there would be too many.
LEAST_BATCHES, MOST_BATCHES, BATCH_BYTES = 4, 64, 64 << 30
#: A page for so many bytes of files, about 1,000 to 2,000 texts.
LEAST_PAGES, PAGE_BYTES = 16, 2 << 20
STATE = "spark.sql.streaming.stateStore."
#: The state outside the heap; a commit writes what changed, and no file is allocated ahead
#: of its data, which costs megabytes for each partition of the state.
STATE_SETTINGS = {
    f"{STATE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STATE}rocksdb.changelogCheckpointing.enabled": "true",
    f"{STATE}rocksdb.allowFAllocate": "false",
}
KEYED = "page bigint, twin binary, id bigint, role int, part string, mask int, kind int, n bigint"
DELTAS = "part string, mask int, kind int, n bigint"


def text_mask(raw: bytes) -> int:
    """Bits 1, 2, 4 and 8: which of the conditions A to D a text in UTF-8 meets."""
    words = raw.split()  # of bytes: at space and \x09 to \x0D
    code_points = len(raw.translate(None, _CONTINUING))
    return (
        (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words))
        + 4 * (100 * len(raw.translate(None, _NOT_CAPITAL)) > 2 * code_points)
        + 8 * (len(raw.translate(None, b"#$%&*|")) < len(raw))
    )


_NOT_CAPITAL = bytes(c for c in range(256) if not 0x41 <= c <= 0x5A)
_CONTINUING = bytes(range(0x80, 0xC0))


def _judge(pages):
    def step(batches):
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text").cast(pa.large_binary())]
            twins = [hashlib.sha256(t).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int.from_bytes(t[:7]) % pages for t in twins], pa.int64()), pa.array(twins, pa.binary()),
                 batch.column("id"), batch.column("part"), pa.array([text_mask(t) for t in texts], pa.int32())],
                names=["page", "twin", "id", "part", "mask"])

    return step


#: What a row is to its text: it may be the least, it is surely not, or it has no id.
LEAST, LATE, NAMELESS = 0, 1, 2
_COUNTED = pa.schema([
    ("page", pa.int64()), ("twin", pa.binary()), ("id", pa.int64()), ("role", pa.int32()), ("part", pa.string()),
    ("mask", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()),
])


def _combine(batches):
    """Count equal rows of a batch together; rows above the least id of their text are late."""
    for batch in batches:
        rows = batch.to_pandas()
        rows["role"] = np.where(rows.pop("has"), LEAST, NAMELESS)
        lowest = rows["id"].where(rows["role"] == LEAST, _MOST).groupby(rows["twin"]).transform("min")
        rows.loc[(rows["role"] == LEAST) & (rows["id"] > lowest), "role"] = LATE
        rows.loc[rows["role"] != LEAST, "id"] = 0
        counted = rows.groupby(["page", "twin", "id", "role", "part", "mask", "kind"], sort=False).size().reset_index(name="n")
        yield pa.RecordBatch.from_pandas(counted, schema=_COUNTED, preserve_index=False)


_MOST = np.iinfo(np.int64).max


def _retract(key, frames, state):
    """Changes to the counters by new rows of the texts on one page of the state."""
    new = pd.concat(list(frames))
    own = _HELD.names
    came = new[new["role"] == LEAST][own].assign(old=False)
    held = pa.ipc.open_stream(bytes(state.get[0])).read_pandas().assign(old=True) if state.exists else came[:0]
    rows = pd.concat([held, came])
    least = rows["id"] == rows.groupby("twin")["id"].transform("min")
    out = [
        new[new["role"] == NAMELESS], new[new["role"] == LATE].assign(mask=lambda d: d["mask"] | TWIN),
        came_first := rows[least & ~rows["old"]], (came_later := rows[~least & ~rows["old"]]).assign(mask=came_later["mask"] | TWIN),
        (beaten := rows[~least & rows["old"]]).assign(n=-beaten["n"]), beaten.assign(mask=beaten["mask"] | TWIN),
    ]
    if len(came_first):
        stay = rows[least].groupby(["twin", "id", "mask", "part", "kind"], sort=False)["n"].sum().reset_index()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _HELD) as file:
            file.write_table(pa.Table.from_pandas(stay, schema=_HELD, preserve_index=False))
        state.update((sink.getvalue().to_pybytes(),))
    changes = pd.concat([o[["part", "mask", "kind", "n"]] for o in out])
    yield changes.groupby(["part", "mask", "kind"], sort=False)["n"].sum().reset_index()


_HELD = pa.schema([
    ("twin", pa.binary()), ("id", pa.int64()), ("mask", pa.int32()), ("part", pa.string()), ("kind", pa.int32()), ("n", pa.int64())])


def _label_bits(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(
        (F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0))).alias("bits"))


def _files(spark: SparkSession, path: str, batch_bytes: int | None):
    """A stream of the files at `path`, a folder or one file, and the pages for its texts."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    total = system.getContentSummary(at).getLength()
    size = batch_bytes or max(1, -(-total // MOST_BATCHES), min(-(-total // LEAST_BATCHES), BATCH_BYTES))
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", size)
    if system.getFileStatus(at).isFile():  # streams read folders
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return reader.parquet(path), max(LEAST_PAGES, -(-total // PAGE_BYTES))


def mask_counters(
    spark: SparkSession, path: str, labels: DataFrame, batch_bytes: int | None = None, pages: int | None = None,
    target: str | None = None,
) -> DataFrame:
    """Counters (part, mask, kind, n) of the documents in the Parquet files at `path`.

    `batch_bytes` bounds the files of one micro-batch, `pages` is the number of pages that
    hold the state. `target` is a folder for checkpoint and counters: a run with the folder
    and the pages of an earlier one goes on where that one stopped and takes up only files
    it has not seen.
    """
    target = target or scratch_path(spark, "filteraudit")
    # The folder of an earlier run keeps its own batches; this one always holds a schema.
    spark.createDataFrame([], DELTAS).write.mode("overwrite").parquet(f"{target}/counters/batch=-1")
    docs, enough = _files(spark, path, batch_bytes)
    rows = docs.select("text", F.col("doc_id").cast("bigint").alias("id"), F.coalesce("source", F.lit("")).alias("part"))
    rows = rows.mapInArrow(_judge(pages or enough), "page bigint, twin binary, id bigint, part string, mask int")
    # Rows without an id join no label; dealt by their text they do not meet in one task.
    known = _label_bits(labels).withColumn("has", F.lit(True))
    keyed = rows.withColumn("has", F.col("id").isNotNull()).withColumn("of", F.coalesce("id", F.xxhash64("twin")))
    keyed = keyed.join(known, ["has", "of"], "left").select(
        "page", "twin", F.coalesce("id", F.lit(0)).alias("id"), "has", "part", "mask", F.coalesce("bits", F.lit(0)).alias("kind"))
    changes = keyed.mapInArrow(_combine, KEYED).groupBy("page").applyInPandasWithState(
        _retract, DELTAS, "rows binary", "append", GroupStateTimeout.NoTimeout)

    def add(batch: DataFrame, number: int) -> None:
        total = batch.groupBy("part", "mask", "kind").agg(F.sum("n").alias("n")).where("n <> 0")
        total.write.mode("overwrite").parquet(f"{target}/counters/batch={number}")

    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        run = changes.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{target}/checkpoint")
        run.foreachBatch(add).start().awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    summed = spark.read.schema(DELTAS).parquet(f"{target}/counters").groupBy("part", "mask", "kind").agg(F.sum("n").alias("n"))
    return summed.where("n <> 0")


def audit(counters: DataFrame) -> DataFrame:
    """The audit of every order of the filters, from counters (part, mask, kind, n).

    What precedes a step matters only as a set of filters, so a part needs one sum for each
    of the 32 sets: the documents that fail none of it.
    """
    sets = range(1 << len(LETTERS))
    bits = [1 << i for i in range(len(LETTERS))]

    def left(counted):  # of each set, documents that fail no filter in it
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) == 0, counted).otherwise(0)) for s in sets])

    n = F.col("n")
    good = F.when(F.col("kind").bitwiseAND(F.lit(GOOD)) > 0, n).otherwise(0)
    toxic = F.when(F.col("kind").bitwiseAND(F.lit(TOXIC)) > 0, n).otherwise(0)
    parts = counters.groupBy("part").agg(
        left(n).alias("all"), left(good).alias("good"), left(toxic).alias("toxic"),
        F.array(*[F.sum(F.when(F.col("mask") == b, n).otherwise(0)) for b in bits]).alias("only"))
    # A filter follows the set s in |s|! * (4 - |s|)! orders.
    shapley = (
        "transform(sequence(0, 4), f -> aggregate(filter(sequence(0, 31), s -> (s & shiftleft(1, f)) = 0), 0L, (sum, s) -> "
        "sum + factorial(bit_count(s)) * factorial(4 - bit_count(s)) * (`all`[s] - `all`[s | shiftleft(1, f)])))"
    )
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    steps = (
        parts.withColumn("shapleys", F.expr(shapley))
        .withColumn("filter_order", F.explode(orders))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
        .withColumn("f", F.expr("ascii(substring(filter_order, step, 1)) - 65"))
        .withColumn("before", F.expr(
            "aggregate(split(substring(filter_order, 1, step - 1), ''), 0, (s, x) -> if(x = '', s, s | shiftleft(1, ascii(x) - 65)))"))
        .withColumn("after", F.expr("before | shiftleft(1, f)"))
    )
    removed = F.expr("`all`[before] - `all`[after]")
    return steps.select(
        "part", "filter_order", "step", F.expr("`all`[after]").alias("kept"), removed.alias("removed"),
        (F.expr("`all`[0] - `all`[shiftleft(1, f)]") - removed).alias("redundant"), F.expr("only[f]").alias("unique_fails"),
        F.expr("good[before] - good[after]").alias("good_lost"), F.expr("toxic[before] - toxic[after]").alias("toxic_lost"),
        F.expr("shapleys[f]").alias("shapley"),
    )


_ORDERS = ", ".join(f"'{''.join(p)}'" for p in permutations(LETTERS))
SQL = rf"""
WITH texts AS (
    SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS t,
        regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
judged AS (
    SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
        100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
        COALESCE(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
    FROM texts),
fails AS (
    SELECT doc_id, part, list_concat(CASE WHEN a THEN ['A'] ELSE [] END, CASE WHEN b THEN ['B'] ELSE [] END,
        CASE WHEN c THEN ['C'] ELSE [] END, CASE WHEN d THEN ['D'] ELSE [] END, CASE WHEN e THEN ['E'] ELSE [] END) AS f
    FROM judged),
marked AS (
    SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM fails LEFT JOIN (
        SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
    GROUP BY part, f),
orders AS (SELECT unnest([{_ORDERS}]) AS filter_order),
runs AS (
    SELECT part, f, n, good, toxic, filter_order,
        COALESCE(list_min(list_transform(f, lambda x: instr(filter_order, x))), 6) AS falls
    FROM marked, orders),
steps AS (
    SELECT part, filter_order, step, substring(filter_order, step, 1) AS letter,
        sum(n) FILTER (falls > step) AS kept, sum(n) FILTER (falls = step) AS removed,
        sum(n) FILTER (falls < step AND list_contains(f, substring(filter_order, step, 1))) AS redundant,
        sum(n) FILTER (f = [substring(filter_order, step, 1)]) AS unique_fails,
        sum(good) FILTER (falls = step) AS good_lost, sum(toxic) FILTER (falls = step) AS toxic_lost
    FROM runs, (SELECT unnest(range(1, 6)) AS step)
    GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(COALESCE(kept, 0) AS BIGINT) AS kept,
    CAST(COALESCE(removed, 0) AS BIGINT) AS removed, CAST(COALESCE(redundant, 0) AS BIGINT) AS redundant,
    CAST(COALESCE(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(COALESCE(good_lost, 0) AS BIGINT) AS good_lost,
    CAST(COALESCE(toxic_lost, 0) AS BIGINT) AS toxic_lost,
    CAST(sum(COALESCE(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM steps"""


@query("op11_filter_interaction_audit", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes at each step of each order, per source."""
    return audit(mask_counters(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels")))
