"""Joins of one fact with one dimension, and neighbour lookups on keys with long histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from closebook.session import scratch_path

# Rows of one key that a single window group may hold; a longer history is cut.
TASK_ROWS = 1_000_000


def checked_join(fact: DataFrame, dim: DataFrame, on, how="inner") -> DataFrame:
    """Equi join of a `fact` with a `dim` on columns of one type.

    Small dimensions are broadcast by Spark's own measure. Otherwise adaptive execution
    splits the fact side of a hot key by its map output, whatever the key, null included,
    so no rows need a salt. Joins that would split the other side are refused.
    """
    on = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"checked_join cannot do a {how} join")
    for key in on:
        left, right = fact.schema[key].dataType, dim.schema[key].dataType
        if left != right:
            raise TypeError(f"join key {key}: {left.simpleString()} and {right.simpleString()}")
    return fact.join(dim, on, how)


def _micros(column: str) -> Column:
    return F.timestamp_diff(
        "MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column)
    )


_CUT = "array<struct<at:bigint,id:bigint>>"
_CUTS = f"key_hash bigint, cuts {_CUT}, strides {_CUT}"


def history_cuts(df: DataFrame, keys, order, task_rows: int) -> DataFrame | None:
    """Cuts of every key with more than `task_rows` rows: (key_hash, points, every n-th point).

    Rows of such keys are range-partitioned by key, time and second order column, so
    they fall in even ranges however they share keys or instants; each range gives one
    cut per key in it. That is a table of at most the number of shuffle partitions plus the
    number of such keys, written once by Spark so that all uses see one; it does not pass
    through the driver.
    None when no key is that long.
    """
    spark = df.sparkSession
    tied = len(order) > 1 and isinstance(df.schema[order[1]].dataType, T.IntegralType)
    light = df.select(
        F.xxhash64(*keys).alias("key_hash"), _micros(order[0]).alias("at"),
        (F.col(order[1]).cast("bigint") if tied else F.lit(0).cast("bigint")).alias("id"),
    )
    long_ones = light.groupBy("key_hash").agg(F.count("*").alias("n")).where(F.col("n") > task_rows)
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = (
        light.join(long_ones.select("key_hash"), "key_hash", "left_semi")
        .repartitionByRange(pieces, "key_hash", "at", "id")
        .groupBy("key_hash", F.spark_partition_id().alias("range"))
        .agg(F.min(F.struct("at", "id")).alias("cut"))
        .groupBy("key_hash").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
        .select("key_hash", "cuts", F.filter("cuts", lambda c, i: i % _stride() == 0).alias("strides"))
    )
    path = scratch_path(spark, "cuts")
    ranges.write.parquet(path)
    cuts = spark.read.schema(_CUTS).parquet(path)
    return None if cuts.isEmpty() else cuts


def _stride() -> Column:
    """Cuts of one stride: the root of their number."""
    return F.greatest(F.lit(1), F.floor(F.sqrt(F.size("cuts").cast("double"))).cast("int"))


def with_piece(df: DataFrame, keys, order, cuts: DataFrame, name: str) -> DataFrame:
    """`df` with the number of cuts at or before a row, 0 for keys without cuts."""
    tied = len(order) > 1 and isinstance(df.schema[order[1]].dataType, T.IntegralType)
    here = F.struct(
        _micros(order[0]).alias("at"),
        (F.col(order[1]).cast("bigint") if tied else F.lit(0).cast("bigint")).alias("id"),
    )
    hashed = df.withColumn("__key_hash", F.xxhash64(*keys))
    joined = hashed.join(cuts, hashed["__key_hash"] == cuts["key_hash"], "left")
    # Whole strides first, then within one stride: about twice the root of the cuts.
    stride = _stride()
    passed = F.size(F.filter("strides", lambda c: c <= here))
    start = F.greatest((passed - 1) * stride, F.lit(0))
    inside = F.size(F.filter(F.slice("cuts", start + 1, stride), lambda c: c <= here))
    piece = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(start + inside)
    return joined.withColumn(name, piece.cast("int")).drop("__key_hash", "key_hash", "cuts", "strides")


def with_neighbor(
    df: DataFrame, keys, order, values: dict[str, str], direction="next", *, task_rows=None
) -> DataFrame:
    """Add values of the next or previous row of the same key.

    `order` is a list of columns, the first a timestamp without zone; `values`
    maps new column -> column of the neighbour.

    A key with more than `task_rows` rows is cut at points of its time (and of the second
    order column when that is a whole number). Each piece is a window group of its own,
    and rows at a cut take their neighbour from a table of one row per piece. The plan has
    one size whatever the number of keys and cuts; without long keys it is the plain window.
    """
    if direction not in ("next", "previous"):
        raise ValueError(f"no direction {direction}")
    keys, order = list(keys), list(order)
    step = F.lead if direction == "next" else F.lag
    cuts = history_cuts(df, keys, order, TASK_ROWS if task_rows is None else task_rows)
    if cuts is None:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({new: step(old).over(window) for new, old in values.items()})

    rows = with_piece(df, keys, order, cuts, "__piece")
    window = Window.partitionBy(*keys, "__piece").orderBy(*order)
    inner = rows.withColumns(
        {
            **{f"__{new}": step(old).over(window) for new, old in values.items()},
            "__edge": step(F.lit(1)).over(window).isNull(),
        }
    )
    pick = F.min_by if direction == "next" else F.max_by
    payload = F.struct(*[F.col(old).alias(new) for new, old in values.items()])
    # Only keys with cuts have more than one piece.
    long_rows = rows.join(cuts, F.xxhash64(*keys) == F.col("key_hash"), "left_semi")
    heads = long_rows.groupBy(*keys, "__piece").agg(pick(payload, F.struct(*order)).alias("head"))
    along = Window.partitionBy(*keys).orderBy("__piece")
    heads = heads.select(
        *[F.col(k).alias(f"__h_{k}") for k in keys],
        F.col("__piece").alias("__h_piece"),
        step("head").over(along).alias("__head"),
    )
    same = F.col("__edge") & (F.col("__piece") == F.col("__h_piece"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__h_{k}"))
    joined = inner.join(heads, same, "left")
    return joined.select(
        *df.columns,
        *[
            F.when(F.col("__edge"), F.col(f"__head.{new}")).otherwise(F.col(f"__{new}")).alias(new)
            for new in values
        ],
    )
