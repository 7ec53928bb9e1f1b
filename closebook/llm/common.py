"""Shared by the training-data operators: registry, tables, written intermediates."""

from __future__ import annotations

import ctypes
import gc
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closebook.session import scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Characters a query counts as one ASCII upper or lower case alphabet.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) as a query, with its SQL twin if it has one."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: later stages read it again instead of
    computing it, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most `rows` rows in what is run inside; the setting before comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(rows if before <= 0 else min(rows, before)))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def whole(column: str = "text"):
    """A text with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores before it until no column of `df` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_WORKER: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What the tasks of one operator keep in a Python worker; that of the one before goes.

    Workers live on between stages, and a pipeline would gather all its stages' caches.
    What is freed goes back to the system where the C library can do that.
    """
    if owner not in _WORKER:
        if _WORKER:
            _WORKER.clear()
            gc.collect()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)
        _WORKER[owner] = {}
    return _WORKER[owner]
