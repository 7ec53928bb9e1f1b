"""Change events in batch, and streams that must end with the batch result."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from closebook.sources.fixtures import Tables
from closebook.streaming import cdc
from tests.util import rows

COLUMNS = ["event_id", "stream_name", "table_name", "operation", "pk", "value", "event_time", "row_count"]
SCHEMA = ("event_id bigint, stream_name string, table_name string, operation string, pk bigint, "
          "value double, event_time timestamp_ntz, row_count int")
T0 = dt.datetime(2026, 1, 1)


def events(spark, items):
    """Items are (id, pk, operation, minute, value)."""
    return spark.createDataFrame(
        [(i, "cdc-gl-apps", "GL_JE_LINES", op, pk, v, T0 + dt.timedelta(minutes=m), 1) for i, pk, op, m, v in items],
        SCHEMA,
    )


def state(df):
    return {r["pk"]: r["value"] for r in df.collect()}


def test_newest_event_wins(spark):
    df = events(spark, [(1, 1, "INSERT", 0, 1.0), (3, 1, "UPDATE", 5, 3.0), (2, 1, "UPDATE", 5, 2.0),
                        (4, 2, "INSERT", 0, 4.0), (5, 2, "DELETE", 9, 0.0), (6, 2, "UPDATE", 3, 6.0)])
    assert state(cdc.current_state(df)) == {1: 3.0}
    assert cdc.latest_per_key(df).where("operation = 'DELETE'").count() == 1


def test_history(spark):
    df = events(spark, [(1, 1, "INSERT", 0, 1.0), (2, 1, "UPDATE", 5, 2.0), (3, 1, "UPDATE", 5, 3.0),
                        (4, 1, "DELETE", 8, 0.0), (5, 1, "INSERT", 9, 5.0)])
    got = [tuple(r)[2:] for r in cdc.history(df).orderBy("valid_from").collect()]

    def at(m):
        return T0 + dt.timedelta(minutes=m)

    assert got == [
        (1.0, at(0), at(5), False), (3.0, at(5), at(8), False),
        (5.0, at(9), dt.datetime(4712, 12, 31), True),
    ]


def test_backfill_then_changes(spark):
    snapshot = spark.createDataFrame([("GL_JE_LINES", 1, 10.0), ("GL_JE_LINES", 2, 20.0), ("GL_JE_LINES", 3, 30.0)],
                                     "table_name string, pk bigint, value double")
    changes = events(spark, [(1, 1, "UPDATE", 0, 11.0), (2, 2, "DELETE", 0, 0.0), (3, 4, "INSERT", 0, 40.0)])
    merged = cdc.with_backfill(snapshot, changes.select("table_name", "pk", "value", "operation", "event_time", "event_id"))
    assert state(cdc.current_state(merged)) == {1: 11.0, 3: 30.0, 4: 40.0}


def test_status(spark):
    df = events(spark, [(1, 1, "INSERT", 0, 1.0), (2, 1, "UPDATE", 5, 2.0)])
    row = cdc.stream_status(df).first()
    assert (row["tables_synced"], row["total_tables"], row["rows_synced"], row["healthy"]) == (1, 5, 2, True)
    assert row["progress"] == pytest.approx(0.2)
    odd = df.withColumn("table_name", F.when(F.col("event_id") == 2, "NOT_LISTED").otherwise(F.col("table_name")))
    row = cdc.stream_status(odd).first()
    assert (row["error_count"], row["rows_synced"], row["healthy"]) == (1, 1, False)
    assert cdc.stream_status(df, F.lit("PAUSED")).first()["healthy"] is False
    unknown = df.withColumn("stream_name", F.lit("other"))
    row = cdc.stream_status(unknown).first()
    assert (row["total_tables"], row["progress"], row["healthy"]) == (0, 0.0, False)


def test_health_and_progress(spark):
    cases = [("RUNNING", 3, 6, 0, True, 0.5), ("PAUSED", 3, 6, 0, False, 0.5), ("RUNNING", 5, 5, 1, False, 1.0),
             ("RUNNING", 0, 0, 0, False, 0.0), ("RUNNING", 10, 5, 0, True, 1.0)]
    df = spark.createDataFrame([c[:4] for c in cases], "status string, tables_synced int, total_tables int, error_count int")
    got = [tuple(r) for r in df.select(cdc.is_healthy(), cdc.sync_progress()).collect()]
    assert got == [c[4:] for c in cases]


def test_triggers():
    assert cdc.trigger_for("incremental") == {"availableNow": True}
    assert cdc.trigger_for("continuous", "5 seconds") == {"processingTime": "5 seconds"}
    for mode in ("snapshot", "hourly"):
        with pytest.raises(ValueError):
            cdc.trigger_for(mode)


# ---- Streams ----


@pytest.fixture(scope="module")
def slices(spark, folder):
    """The events in four parts by id, oldest first."""
    df = Tables(spark, folder)["fx_cdc_events"].select(*COLUMNS)
    df = df.withColumn("event_id", F.col("event_id").cast("bigint"))
    return [_quarter(df, i) for i in range(4)], df


def _quarter(df, i):
    low, high = df.agg(F.min("event_id"), F.max("event_id")).first()
    step = (high - low) // 4 + 1
    return df.where((F.col("event_id") >= low + i * step) & (F.col("event_id") < low + (i + 1) * step))


def feed(part, inbox, number):
    """Write one part as one file, later ones with a later time."""
    os.makedirs(inbox, exist_ok=True)
    path = os.path.join(inbox, f"part{number}.parquet")
    part.toPandas().astype({"row_count": "int32"}).to_parquet(path, index=False, coerce_timestamps="us")
    os.utime(path, (1_700_000_000 + number * 60,) * 2)


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None


def comparable(df):
    return rows(df.select("table_name", "pk", "operation", "value", "event_id"))


def test_stream_state_is_batch_state(spark, slices, tmp_path):
    parts, every = slices
    inbox, out, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    expected = every.limit(0)
    # Newest part first, so the others arrive late.
    for n, part in enumerate(reversed(parts)):
        feed(part, inbox, n)
        expected = expected.unionByName(part)
        # Each round starts the query again on the same checkpoint.
        finish(cdc.start_state(cdc.read_changes(spark, inbox, 1), out, check))
        got = comparable(cdc.read_state(spark, out))
        assert got == comparable(cdc.current_state(expected))
        if n == 1:
            assert cdc.compact_state(spark, out) == 1
            assert cdc.compact_state(spark, out) == 1
            assert comparable(cdc.read_state(spark, out)) == got
    assert cdc.compact_state(spark, out) == 2
    assert comparable(cdc.read_state(spark, out)) == comparable(cdc.current_state(every))


def test_late_update_does_not_bring_a_key_back(spark, tmp_path):
    inbox, out, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    feed(events(spark, [(1, 1, "INSERT", 0, 1.0), (9, 1, "DELETE", 9, 0.0)]), inbox, 0)
    finish(cdc.start_state(cdc.read_changes(spark, inbox), out, check))
    cdc.compact_state(spark, out)
    feed(events(spark, [(5, 1, "UPDATE", 5, 5.0)]), inbox, 1)
    finish(cdc.start_state(cdc.read_changes(spark, inbox), out, check))
    assert cdc.read_state(spark, out).count() == 0


def test_new_checkpoint_gives_the_same_state(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "state")
    feed(events(spark, [(1, 1, "INSERT", 0, 1.0), (2, 2, "INSERT", 0, 2.0)]), inbox, 0)
    finish(cdc.start_state(cdc.read_changes(spark, inbox), out, str(tmp_path / "check0")))
    cdc.compact_state(spark, out)
    feed(events(spark, [(3, 2, "DELETE", 5, 0.0), (4, 3, "INSERT", 5, 3.0)]), inbox, 1)
    # Batch numbers start again at 0, below what was folded.
    finish(cdc.start_state(cdc.read_changes(spark, inbox), out, str(tmp_path / "check1")))
    assert state(cdc.read_state(spark, out)) == {1: 1.0, 3: 3.0}
    cdc.compact_state(spark, out)
    assert state(cdc.read_state(spark, out)) == {1: 1.0, 3: 3.0}


def test_unfinished_batch_is_not_read(spark, tmp_path):
    inbox, out, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    feed(events(spark, [(1, 1, "INSERT", 0, 1.0)]), inbox, 0)
    finish(cdc.start_state(cdc.read_changes(spark, inbox), out, check))
    delta = next((tmp_path / "state" / "delta").iterdir())
    half = events(spark, [(2, 2, "INSERT", 0, 2.0)]).withColumn("event_time", F.col("event_time").cast("timestamp"))
    half.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(delta / "batch_id=1"))
    assert state(cdc.read_state(spark, out)) == {1: 1.0}
    # The batch runs again and is replaced.
    feed(events(spark, [(3, 3, "INSERT", 0, 3.0)]), inbox, 1)
    finish(cdc.start_state(cdc.read_changes(spark, inbox), out, check))
    assert state(cdc.read_state(spark, out)) == {1: 1.0, 3: 3.0}


def test_stream_volume_is_batch_volume_however_late(spark, slices, tmp_path):
    parts, every = slices
    inbox, out, check = (str(tmp_path / n) for n in ("in", "volume", "check"))
    # Newest part first: the others are days late.
    for n, part in enumerate(reversed(parts)):
        feed(part, inbox, n)
    names = ["table_name", "operation", "events", "row_count"]

    def plain(df):
        return rows(df.select(F.col("window_start").cast("string").alias("w"), *names))

    assert cdc.read_volume(spark, out).count() == 0
    # A pause and a resume without new events add nothing.
    for _ in range(2):
        finish(cdc.start_volume(cdc.read_changes(spark, inbox, 1), out, check, width="1 day"))
        assert plain(cdc.read_volume(spark, out)) == plain(cdc.volume(every, "1 day"))


def test_state_before_the_first_batch(spark, tmp_path):
    assert cdc.read_state(spark, str(tmp_path / "none")).count() == 0
    assert cdc.compact_state(spark, str(tmp_path / "none")) == 0


def test_compaction_folds_touched_buckets_and_trims(spark, tmp_path):
    inbox, out, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    for n in range(4):
        feed(events(spark, [(10 + n, n, "INSERT", n, float(n)), (20 + n, 100, "UPDATE", n, float(n))]), inbox, n)
        finish(cdc.start_state(cdc.read_changes(spark, inbox), out, check))
        assert cdc.compact_state(spark, out) == n + 1
        assert state(cdc.read_state(spark, out)) == {**{k: float(k) for k in range(n + 1)}, 100: float(n)}
    bases = {p.name: sorted(b.name for b in p.iterdir() if b.is_dir()) for p in (tmp_path / "state" / "base").iterdir()}
    assert len(bases["version=4"]) == 2
    left = [p.name for p in (tmp_path / "state" / "delta").rglob("batch_id=*")]
    assert left == ["batch_id=3"]
    assert sorted(p.name for p in (tmp_path / "state" / "manifest").iterdir()) == ["version=3", "version=4"]


def test_continuous_stream_can_be_paused(spark, tmp_path):
    inbox, out, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    feed(events(spark, [(1, 1, "INSERT", 0, 1.0)]), inbox, 0)
    query = cdc.start_state(
        cdc.read_changes(spark, inbox), out, check, mode="continuous", interval="1 second"
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    feed(events(spark, [(2, 2, "INSERT", 0, 2.0)]), inbox, 1)
    finish(cdc.start_state(cdc.read_changes(spark, inbox), out, check))
    assert state(cdc.read_state(spark, out)) == {1: 1.0, 2: 2.0}
    assert spark.read.parquet(f"{out}/delta").count() == 2


def versions(df):
    return rows(df.select("pk", "value", F.col("valid_from").cast("string"), F.col("valid_to").cast("string"), "is_current"))


def test_stream_history_takes_late_events(spark, tmp_path):
    """Late, repeated and deleting events, with folds between; equal to the history in batch."""
    inbox, out, check = (str(tmp_path / n) for n in ("in", "history", "check"))
    parts = [
        [(10, 1, "INSERT", 10, 1.0), (11, 2, "INSERT", 0, 5.0)], [(9, 1, "INSERT", 5, 0.5), (12, 1, "DELETE", 20, 0.0)],
        [(13, 1, "INSERT", 15, 2.0), (10, 1, "INSERT", 10, 1.0)], [(14, 3, "INSERT", 1, 7.0), (15, 1, "UPDATE", 15, 3.0)],
    ]
    seen = []
    for n, part in enumerate(parts):
        feed(events(spark, part), inbox, n)
        seen += part
        finish(cdc.start_history(cdc.read_changes(spark, inbox), out, check))
        want = versions(cdc.history(events(spark, sorted(set(seen)))))
        assert versions(cdc.read_history(spark, out)) == want
        if n % 2:
            cdc.compact_history(spark, out)
            assert versions(cdc.read_history(spark, out)) == want
    assert cdc.read_history(spark, str(tmp_path / "none")).count() == 0


def test_snapshot_overwrites_the_state(spark, tmp_path):
    inbox, out, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    feed(events(spark, [(1, 1, "INSERT", 0, 1.0), (2, 2, "INSERT", 0, 2.0)]), inbox, 0)
    finish(cdc.start_state(cdc.read_changes(spark, inbox), out, check))
    cdc.load_snapshot(events(spark, [(3, 2, "INSERT", 0, 20.0), (4, 3, "INSERT", 0, 30.0)]), out)
    assert state(cdc.read_state(spark, out)) == {2: 20.0, 3: 30.0}
    feed(events(spark, [(5, 3, "DELETE", 9, 0.0), (6, 4, "INSERT", 9, 40.0)]), inbox, 1)
    finish(cdc.start_state(cdc.read_changes(spark, inbox), out, check))
    assert state(cdc.read_state(spark, out)) == {2: 20.0, 4: 40.0}
