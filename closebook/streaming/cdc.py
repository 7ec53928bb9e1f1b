"""Change events: state, history, volume and stream status, in batch and as streams.

The reference holds configuration and status of a managed service; how events
are applied is this package's own definition: the newest (event_time,
event_id) of a key wins, a DELETE stays as a tombstone so that a late UPDATE
cannot bring a key back.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from closebook.functions.skew import with_neighbor
from closebook.model import CDC_TABLES, END_OF_TIME, ENTITIES, REPLICATION_MODES
from closebook.sources.files import remove

KEYS = ["table_name", "pk"]
ORDER = ["event_time", "event_id"]
OPERATIONS = ["INSERT", "UPDATE", "DELETE"]


def latest_per_key(events: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    """Newest event of every key, tombstones included; combines before the shuffle."""
    rest = [c for c in events.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return events.groupBy(*keys).agg(newest).select(*keys, "row.*")


def current_state(events: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    """Rows as they are now: newest event per key, deleted keys left out."""
    return latest_per_key(events, keys, order).where(F.col("operation") != "DELETE")


def with_backfill(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """Snapshot rows as inserts before every event, then the events."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    inserts = snapshot.withColumns(
        {"operation": F.lit("INSERT"), "event_time": epoch, "event_id": F.lit(0).cast("bigint")}
    )
    return inserts.unionByName(events, allowMissingColumns=True)


def history(events: DataFrame, keys=KEYS, order=ORDER, values=("value",), task_rows=None) -> DataFrame:
    """Date-effective versions: each holds from its event to the next of its key.

    Events of one key at the same instant make one version, the last by id. A
    DELETE closes the version before it and makes none. Open versions end at
    the sentinel date.
    """
    rows = events.select(*keys, *order, "operation", *values)
    followed = with_neighbor(rows, keys, order, {"next_time": order[0]}, task_rows=task_rows)
    return _versions(followed, keys, order, values)


def _versions(followed: DataFrame, keys, order, values) -> DataFrame:
    """Versions of events that know the time of the next event of their key."""
    at = order[0]
    last_of_instant = F.col("next_time").isNull() | (F.col("next_time") > F.col(at))
    end = F.lit(END_OF_TIME).cast("timestamp_ntz")
    return followed.where(last_of_instant & (F.col("operation") != "DELETE")).select(
        *keys, *values,
        F.col(at).alias("valid_from"),
        F.coalesce("next_time", end).alias("valid_to"),
        F.col("next_time").isNull().alias("is_current"),
    )


def volume(events: DataFrame, width="900 seconds") -> DataFrame:
    """Events and changed rows per table, operation and tumbling window."""
    return events.groupBy(
        F.window("event_time", width).alias("w"), "stream_name", "table_name", "operation"
    ).agg(F.count("*").alias("events"), F.sum("row_count").alias("row_count")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "stream_name", "table_name", "operation", "events", "row_count",
    )


# ---- Stream status ----


def is_healthy() -> Column:
    """Running, without errors, with at least one table synced."""
    return (
        (F.col("status") == "RUNNING") & (F.col("error_count") == 0) & (F.col("tables_synced") > 0)
    )


def sync_progress() -> Column:
    """Share of tables synced, at most 1, and 0 when no table is configured."""
    total = F.col("total_tables")
    return F.when(total <= 0, F.lit(0.0)).otherwise(
        F.least(F.col("tables_synced") / F.greatest(total, F.lit(1)), F.lit(1.0))
    )


def stream_module(stream="stream_name") -> Column:
    """Module in a stream name of the form cdc-<module>-<schema>."""
    return F.upper(F.get(F.split(F.col(stream), "-"), F.lit(1)))


def stream_status(events: DataFrame, status: Column | None = None) -> DataFrame:
    """Tables and rows synced, last event, errors, health and progress per stream.

    An event of an unknown operation or of a table outside the module's list
    is an error and syncs nothing.
    """
    module_tables = F.create_map(
        *[x for m, ts in CDC_TABLES.items() for x in (F.lit(m), F.array(*map(F.lit, ts)))]
    )
    listed = F.coalesce(
        F.element_at(module_tables, stream_module()), F.array().cast("array<string>")
    )
    good = F.col("operation").isin(OPERATIONS) & F.array_contains(listed, F.col("table_name"))
    per_table = (
        events.withColumn("good", F.coalesce(good, F.lit(False)))
        .groupBy("stream_name", "table_name", "good")
        .agg(F.sum("row_count").alias("rows"), F.max("event_time").alias("last"),
             F.count("*").alias("n"))
    )
    per_stream = per_table.groupBy("stream_name").agg(
        F.count_if("good").alias("tables_synced"),
        F.coalesce(F.sum(F.when(F.col("good"), F.col("rows"))), F.lit(0)).alias("rows_synced"),
        F.max(F.when(F.col("good"), F.col("last"))).alias("last_sync_time"),
        F.coalesce(F.sum(F.when(~F.col("good"), F.col("n"))), F.lit(0)).alias("error_count"),
    )
    return per_stream.withColumns(
        {"total_tables": F.size(listed), "status": status if status is not None else F.lit("RUNNING")}
    ).withColumns({"healthy": is_healthy(), "progress": sync_progress()})


# ---- Streams ----


def read_changes(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Change events as they arrive in a folder, oldest files first.

    The event time is cast to a timestamp with zone, as watermarks need one;
    run with the session zone UTC.
    """
    reader = spark.readStream.schema(ENTITIES["cdc_event"])
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).withColumn("event_time", F.col("event_time").cast("timestamp"))


def trigger_for(mode: str, interval="900 seconds") -> dict:
    """Trigger of a replication mode; a snapshot is a batch job and has none."""
    if mode not in REPLICATION_MODES:
        raise ValueError(f"replication mode must be one of {', '.join(REPLICATION_MODES)}")
    if mode == "snapshot":
        raise ValueError("a snapshot is a batch overwrite, not a stream: load_snapshot")
    return {"processingTime": interval} if mode == "continuous" else {"availableNow": True}


# A folder is replaced whole, partitions that no longer get rows too.
_WHOLE = ("partitionOverwriteMode", "static")


def _stream(checkpoint: str) -> str:
    """Short name of a checkpoint: batch numbers belong to it."""
    return "s" + hashlib.sha256(checkpoint.encode()).hexdigest()[:12]


def _start(changes, path, checkpoint, prepare, parts, mode, interval):
    """Stream whose micro-batches each replace a folder of their own, then mark it done.

    A batch that runs again gives the same folder; one that has not ended is not read.
    """
    stream = _stream(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        at = f"stream={stream}/batch_id={batch_id}"
        prepare(batch).write.mode("overwrite").option(*_WHOLE).partitionBy(*parts).parquet(f"{path}/delta/{at}")
        mark = batch.sparkSession.createDataFrame([(batch_id,)], "mark bigint")
        mark.coalesce(1).write.mode("overwrite").parquet(f"{path}/done/{at}")

    return (
        changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**trigger_for(mode, interval)).start()
    )


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the stream, empty before its first row."""
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


_BATCH = "stream string, batch_id bigint"


def _finished(spark: SparkSession, path: str, folded: dict[str, int]) -> dict[str, int]:
    """Last finished batch of each stream, of those that are not folded yet."""
    done = _read(spark, f"{path}/done", f"mark bigint, {_BATCH}")
    last = dict(done.groupBy("stream").agg(F.max("batch_id")).collect())
    return {s: n for s, n in last.items() if n > folded.get(s, -1)}


def _open_deltas(spark, path, schema, finished, folded) -> DataFrame:
    """Rows of finished batches that are in no base; unread folders are pruned."""
    wanted = F.lit(False)
    for stream, last in finished.items():
        wanted = wanted | (
            (F.col("stream") == stream) & F.col("batch_id").between(folded.get(stream, -1) + 1, last)
        )
    return _read(spark, f"{path}/delta", schema).where(wanted)


# ---- Volume ----

VOLUME_SCHEMA = (
    "window_start timestamp, window_end timestamp, stream_name string, table_name string, "
    "events bigint, row_count bigint"
)


def start_volume(changes, path, checkpoint, *, width="900 seconds", mode="incremental",
                 interval="900 seconds"):
    """Stream of volume windows: each micro-batch adds what it counted.

    Counts are summed on read (`read_volume`), so an event counts however late it comes.
    """
    return _start(changes, path, checkpoint, lambda b: volume(b, width), ["operation"], mode, interval)


def read_volume(spark: SparkSession, path: str) -> DataFrame:
    """Events and changed rows per window, table and operation of all finished batches."""
    deltas = _open_deltas(
        spark, path, f"{VOLUME_SCHEMA}, {_BATCH}, operation string", _finished(spark, path, {}), {}
    )
    by = ["window_start", "window_end", "stream_name", "table_name", "operation"]
    return deltas.groupBy(*by).agg(
        F.sum("events").alias("events"), F.sum("row_count").alias("row_count")
    )


# ---- State ----

# Parts of a state table, by a hash of the key; the same for the life of a table.
BUCKETS = 64


def _bucket(keys) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


# The event time as streams have it.
STATE_SCHEMA = ENTITIES["cdc_event"].replace("timestamp_ntz", "timestamp")


def start_state(changes, path, checkpoint, *, keys=KEYS, order=ORDER, mode="incremental",
                interval="900 seconds"):
    """Stream that keeps the newest event per key in a table of deltas.

    Each micro-batch writes its newest events to its own folder, in buckets by a hash of
    the key; the work is that of the batch, not of the table. `read_state` merges on read
    and `compact_state` folds deltas into a base. With a new checkpoint the changes are
    read from the start, which gives the same state again.
    """

    def prepare(batch):
        return latest_per_key(batch, keys, order).withColumn("bucket", _bucket(keys))

    return _start(changes, path, checkpoint, prepare, ["bucket"], mode, interval)


_MANIFEST = "kind string, name string, number bigint, version bigint"


class _State:
    """What a state table holds now: base version of each bucket, and open deltas.

    The manifest of a version lists both; the newest one counts, so a reader sees a
    compaction whole or not at all.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        log = _read(spark, f"{path}/manifest", _MANIFEST)
        self.version = log.agg(F.max("version")).first()[0] or 0
        rows = log.where(F.col("version") == self.version).collect()
        self.bases = {int(r["name"]): r["number"] for r in rows if r["kind"] == "bucket"}
        self.folded = {r["name"]: r["number"] for r in rows if r["kind"] == "stream"}
        self.finished = _finished(spark, path, self.folded)
        self.deltas = _open_deltas(
            spark, path, f"{schema}, {_BATCH}, bucket int", self.finished, self.folded
        )

    def touched(self) -> list[int]:
        """Buckets with open deltas: from folder names, at most one per bucket."""
        return sorted(r[0] for r in self.deltas.select("bucket").distinct().collect())

    def base(self, touched: list[int], inside: bool) -> DataFrame:
        """Base rows of the buckets that deltas touch, or of all others."""
        wanted = F.lit(False)
        for bucket, version in self.bases.items():
            if (bucket in touched) == inside:
                wanted = wanted | ((F.col("bucket") == bucket) & (F.col("version") == version))
        base = _read(self.spark, f"{self.path}/base", f"{self.schema}, version bigint, bucket int")
        return base.where(wanted).drop("version")

    def merged(self, touched, keys, order) -> DataFrame:
        """Newest event per key in the touched buckets."""
        deltas = self.deltas.drop("stream", "batch_id")
        return latest_per_key(self.base(touched, True).unionByName(deltas), [*keys, "bucket"], order)


def read_state(spark: SparkSession, path: str, keys=KEYS, order=ORDER, schema=STATE_SCHEMA) -> DataFrame:
    """Current rows from base and deltas, deleted keys left out; no rows before the first batch.

    Only buckets with open deltas are merged; base rows of the others pass as they are.
    """
    state = _State(spark, path, schema)
    touched = state.touched()
    rows = state.base(touched, False).unionByName(state.merged(touched, keys, order))
    return rows.drop("bucket").where(F.col("operation") != "DELETE")


def compact_state(spark: SparkSession, path: str, keys=KEYS, order=ORDER, schema=STATE_SCHEMA) -> int:
    """Fold all finished deltas into the bases of their buckets; returns the version.

    Tombstones are kept. Bases are written before the manifest that names them. What the
    version before had already replaced is removed, so readers of that version still
    find all they need; readers of older ones do not.
    """
    state = _State(spark, path, schema)
    if not state.finished:
        return state.version
    touched = state.touched()
    return _rebase(state, state.merged(touched, keys, order), touched)


def load_snapshot(rows: DataFrame, path: str, keys=KEYS, order=ORDER, schema=STATE_SCHEMA) -> int:
    """Replication mode `snapshot`: the state becomes `rows`, whatever it was; returns the version.

    `rows` have the columns of change events. Batches of streams that were finished before
    the snapshot count as part of it; later ones are changes to it.
    """
    names = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema]
    state = _State(rows.sparkSession, path, schema)
    whole = latest_per_key(rows.withColumn("event_time", F.col("event_time").cast("timestamp")).select(*names), keys, order)
    return _rebase(state, whole.withColumn("bucket", _bucket(keys)), range(BUCKETS))


# ---- History ----

#: Events as a history keeps them: with the time of the next event of their key.
HISTORY_SCHEMA = f"{STATE_SCHEMA}, next_time timestamp"


def start_history(changes, path, checkpoint, *, keys=KEYS, mode="incremental", interval="900 seconds"):
    """Stream that keeps every event of every key, for `read_history`.

    A micro-batch writes its own events in buckets by a hash of the key; late ones and those
    that come again may be among them. `compact_history` folds them into the buckets.
    """
    def prepare(batch):
        once = batch.dropDuplicates([*keys, "event_id"])
        return once.withColumn("next_time", F.lit(None).cast("timestamp")).withColumn("bucket", _bucket(keys))

    return _start(changes, path, checkpoint, prepare, ["bucket"], mode, interval)


def _followed(state: _State, touched: list[int], keys, order) -> DataFrame:
    """All events of the touched buckets, each with the time of the next of its key."""
    deltas = state.deltas.drop("stream", "batch_id")
    events = state.base(touched, True).unionByName(deltas).drop("next_time").dropDuplicates([*keys, "event_id"])
    plain = events.withColumn(order[0], F.col(order[0]).cast("timestamp_ntz"))
    followed = with_neighbor(plain, keys, order, {"next_time": order[0]})
    return followed.withColumns({c: F.col(c).cast("timestamp") for c in (order[0], "next_time")})


def read_history(spark: SparkSession, path: str, keys=KEYS, order=ORDER, values=("value",)) -> DataFrame:
    """The versions of `history` from the events of a stream, whatever order they came in.

    Only keys in buckets with open deltas are put in order; events of the others know what
    follows them.
    """
    state = _State(spark, path, HISTORY_SCHEMA)
    touched = state.touched()
    rows = state.base(touched, False).unionByName(_followed(state, touched, keys, order))
    rows = rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in (order[0], "next_time")})
    return _versions(rows, keys, order, values)


def compact_history(spark: SparkSession, path: str, keys=KEYS, order=ORDER) -> int:
    """Fold finished deltas into their buckets, as `compact_state` does; returns the version."""
    state = _State(spark, path, HISTORY_SCHEMA)
    if not state.finished:
        return state.version
    touched = state.touched()
    return _rebase(state, _followed(state, touched, keys, order), touched)


def _rebase(state: _State, rows: DataFrame, buckets) -> int:
    """Write new bases of these buckets and the manifest that names them."""
    spark, path, version = state.spark, state.path, state.version + 1
    rows.hint("rebalance", "bucket").write.mode("overwrite").option(*_WHOLE).partitionBy(
        "bucket"
    ).parquet(f"{path}/base/version={version}")
    bases = {**state.bases, **dict.fromkeys(buckets, version)}
    folded = {**state.folded, **state.finished}
    log = [("bucket", str(b), v) for b, v in bases.items()] + [("stream", s, n) for s, n in folded.items()]
    spark.createDataFrame(log, "kind string, name string, number bigint").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/manifest/version={version}")
    _trim(spark, path, state)
    return version


def _trim(spark: SparkSession, path: str, state: _State) -> None:
    """Remove bases, deltas, marks and manifests that `state` does not need."""
    bases = _read(spark, f"{path}/base", f"{state.schema}, version bigint, bucket int")
    stale = [
        f"{path}/base/version={r['version']}/bucket={r['bucket']}"
        for r in bases.select("version", "bucket").distinct().collect()
        if r["version"] < state.bases.get(r["bucket"], 0)
    ]
    done = _read(spark, f"{path}/done", f"mark bigint, {_BATCH}")
    for r in done.select("stream", "batch_id").collect():
        if r["batch_id"] <= state.folded.get(r["stream"], -1):
            at = f"stream={r['stream']}/batch_id={r['batch_id']}"
            stale += [f"{path}/delta/{at}", f"{path}/done/{at}"]
    log = _read(spark, f"{path}/manifest", _MANIFEST)
    stale += [
        f"{path}/manifest/version={r[0]}"
        for r in log.where(F.col("version") < state.version).select("version").distinct().collect()
    ]
    remove(spark, stale)
