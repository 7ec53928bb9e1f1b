"""Lineage edges and the run log."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from closebook.functions.skew import checked_join, with_neighbor
from closebook.session import scratch_path

EDGE_SCHEMA = "source string, target string, transformation string"


def document_lineage(spark, path: str, edges: list[tuple[str, str, str]]) -> None:
    """Append edges (source, target, transformation), the few of one run.

    They are written in a folder of their own and moved: runs that write into one folder at
    once would clear each other's attempts.
    """
    own = f"{path}/_run-{uuid.uuid4().hex}"
    spark.createDataFrame(edges, EDGE_SCHEMA).coalesce(1).write.parquet(own)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(own)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for file in system.listStatus(at):
        name = file.getPath().getName()
        if name.startswith("part-"):  # named by the job, so no other has it
            system.rename(file.getPath(), hadoop.Path(f"{path}/{name}"))
    system.delete(at, True)


def observed(seen: Observation) -> dict:
    """What an observation has taken; nothing where the plan was found to be empty."""
    try:
        return seen.get
    except Py4JJavaError as e:
        # Known: a plan found empty drops its observation, whose row then has no schema.
        if e.java_exception.getClass().getName() != "java.lang.AssertionError" or "toPyRow" not in str(e):
            raise
        return {}


def lineage_graph(edges: DataFrame, asset: str, direction="upstream") -> DataFrame:
    """Assets an asset is made from (upstream) or feeds (downstream), with their distance.

    Goes level by level; assets already found are not followed again, so it ends with the
    graph, cycles or not. Each level is written to the shared folder in one job that also
    counts it, which cuts its lineage.
    """
    if direction not in ("upstream", "downstream"):
        raise ValueError(f"no direction {direction}")
    near, far = ("target", "source") if direction == "upstream" else ("source", "target")
    spark, path = edges.sparkSession, scratch_path(edges.sparkSession, "lineage")
    steps = edges.select(F.col(near).alias("asset"), F.col(far).alias("next"))

    def level(rows, depth):
        seen = Observation()
        rows.observe(seen, F.count("*").alias("n")).write.parquet(f"{path}/depth={depth}")
        return spark.read.schema("asset string").parquet(f"{path}/depth={depth}"), observed(seen).get("n", 0)

    frontier, size = level(spark.createDataFrame([(asset,)], "asset string"), 0)
    depth = 0
    while size:
        depth += 1
        found = spark.read.schema("asset string, depth int").parquet(path)
        reached = checked_join(steps, frontier, "asset", "left_semi")
        new = reached.select(F.col("next").alias("asset")).distinct()
        frontier, size = level(new.join(found.select("asset"), "asset", "left_anti"), depth)
    return found.where("depth > 0")


RUN_EVENT_SCHEMA = (
    "run_id string, event_id bigint, event_name string, module string, period_name string, org_id bigint, "
    "event_time timestamp_ntz, tables array<string>, dry_run boolean, rows bigint, layer string, "
    "passed boolean, total_checks int, passed_checks int, certificate_id string, "
    "success boolean, errors array<string>"
)


def run_timeline(events: DataFrame, task_rows=None) -> DataFrame:
    """Events of every run in order, with the seconds since the one before.

    Events of one instant go by their number in the run.
    """
    order = ["event_time", "event_id"]
    rows = with_neighbor(
        events, ["run_id"], order, {"previous_time": "event_time", "previous_event": "event_name"},
        "previous", task_rows=task_rows,
    )
    micros = F.timestamp_diff("MICROSECOND", F.col("previous_time"), F.col("event_time"))
    return rows.withColumn("seconds_since", micros / F.lit(1_000_000.0))
