"""Long histories: the same rows as a plain window, in a plan of one size."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from closebook.functions import skew
from closebook.functions.skew import checked_join, with_neighbor
from tests.util import rows


def test_join_wants_equal_types(spark):
    fact = spark.range(4).select(F.col("id").alias("k"))
    other = spark.range(3).select(F.col("id").cast("int").alias("k"))
    with pytest.raises(TypeError):
        checked_join(fact, other, "k")
    with pytest.raises(ValueError):
        checked_join(fact, fact, "k", "full")
    assert checked_join(fact, spark.range(2).select(F.col("id").alias("k")), "k", "left_anti").count() == 2


def test_hot_key_is_split_by_adaptive_execution(spark):
    """A join whose fact has one key in most rows runs as a skew join, without a salt."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        fact = spark.range(0, 60_000, 1, 8).select(
            F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 400).cast("bigint").alias("k"),
            F.sha2(F.col("id").cast("string"), 256).alias("v"))
        dim = spark.range(0, 300).select(F.col("id").alias("k"), F.lit("x").alias("w"))
        joined = checked_join(fact, dim, "k")
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan


@pytest.fixture(scope="module")
def events(spark):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return spark.range(0, 3000, 1, 5).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.timestamp_add("SECOND", F.pmod(F.hash("id"), F.lit(900)), start).alias("at"),
        F.col("id"),
    )


@pytest.mark.parametrize("direction", ["next", "previous"])
@pytest.mark.parametrize("task_rows", [1, 20, 500, 100_000])
def test_neighbor_is_the_window(events, direction, task_rows):
    step = F.lead if direction == "next" else F.lag
    window = Window.partitionBy("k").orderBy("at", "id")
    plain = events.withColumns({"at2": step("at").over(window), "id2": step("id").over(window)})
    got = with_neighbor(
        events, ["k"], ["at", "id"], {"at2": "at", "id2": "id"}, direction, task_rows=task_rows
    )
    assert got.columns == plain.columns
    assert rows(got) == rows(plain)


def test_one_instant_of_a_long_history_is_cut_by_id(spark):
    """Two thirds of the rows have one key, most of them one time."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    df = spark.range(0, 3000, 1, 5).select(
        F.when(F.col("id") % 3 != 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"),
        F.when(F.col("id") % 10 != 1, start)
        .otherwise(F.timestamp_add("SECOND", F.col("id").cast("int") - 1500, start)).alias("at"),
        F.col("id"),
    )
    window = Window.partitionBy("k").orderBy("at", "id")
    for direction, step in (("next", F.lead), ("previous", F.lag)):
        got = with_neighbor(df, ["k"], ["at", "id"], {"id2": "id"}, direction, task_rows=100)
        assert rows(got) == rows(df.withColumn("id2", step("id").over(window)))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        cuts = skew.history_cuts(df, ["k"], ["at", "id"], 100)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sizes = skew.with_piece(df, ["k"], ["at", "id"], cuts, "p").where("k = 'hot'").groupBy("p").count()
    assert sizes.count() > 12 and sizes.agg(F.max("count")).first()[0] < 400


def test_plan_has_one_size(spark):
    def plan(keys):
        start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        df = spark.range(0, 6000, 1, 4).select(
            (F.col("id") % keys).alias("k"), F.timestamp_add("SECOND", F.col("id").cast("int"), start).alias("at"), "id")
        got = with_neighbor(df, ["k"], ["at", "id"], {"id2": "id"}, task_rows=10)
        return len(got._jdf.queryExecution().optimizedPlan().toString())

    few, many = plan(3), plan(150)
    assert many < 20_000 and abs(many - few) < 200
