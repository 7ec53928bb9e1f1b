"""Export files in, lake tables out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from closebook.sources import lake

CORRUPT = "_corrupt_record"


#: Lines a quoted field may reach over.
RECORD_LINES = 1000


def read_export(spark: SparkSession, path: str, schema: str, fmt: str = "csv", record_lines=RECORD_LINES, **options):
    """Legacy export files with a declared schema, one record a line.

    Lines are read as text and parsed by expression. One that does not fit keeps its text in
    `_corrupt_record`, so nothing is lost on the way in and the bad lines alone can be read,
    counted or written; `split_export` parts the two. A CSV line that is the list of the
    schema's columns is a header; blank lines are none.

    A quoted CSV field may hold line ends: its record is joined again (`csv_records`),
    without reading a file in one task. A quote that nothing closes, within `record_lines`
    lines, makes its line a bad record, and the lines after it stand for themselves.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"no line format {fmt}")
    fields = f"{schema}, {CORRUPT} string"
    own = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **options}
    if fmt == "json":
        lines = spark.read.text(path).where(F.trim("value") != "")
        return lines.select(F.from_json("value", fields, own).alias("row")).select("row.*")
    lines = csv_records(spark, path, options.get("quote", '"'), options.get("escape", "\\"), record_lines)
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    separator = options.get("sep", ",")
    plain = F.regexp_replace(F.lower("value"), '["\\s]', "")
    lines = lines.where(F.trim("value") != "").where(plain != separator.join(n.lower() for n in names))
    parsed = F.from_csv("value", fields, own)
    bad = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema).schema],
                   F.col("value").alias(CORRUPT))
    return lines.select(F.when(F.col("open"), bad).otherwise(parsed).alias("row")).select("row.*")


def csv_records(spark: SparkSession, path: str, quote='"', escape="\\", record_lines=RECORD_LINES) -> DataFrame:
    """(value, open) of the CSV records in text files; `open` where a quote is not closed.

    A line with an odd number of quotes opens or closes a field that holds line ends: of the
    odd lines of a file the first opens, the second closes, and so on. Which is which is a
    prefix count over the pieces files are read in, a row a piece, and a rank within a
    piece. Only odd lines are ranked, and only lines between a pair are looked up and
    joined; every other line is a record as it is read, without a shuffle.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"),
        # Lines of a piece have consecutive numbers: they are read in order by one task.
        F.monotonically_increasing_id().alias("line"))
    if not quote:
        return lines.select("value", F.lit(False).alias("open"))
    escaped = F.regexp_replace("value", "\\Q" + escape + "\\E.", "") if escape and escape != quote else F.col("value")
    odd = (F.length(escaped) - F.length(F.replace(escaped, F.lit(quote), F.lit("")))) % 2 == 1
    lines = lines.withColumn("odd", odd)
    pieces = lines.groupBy("file", "piece").agg(
        F.min("line").alias("low"), F.max("line").alias("high"), F.count_if("odd").alias("n"))
    in_file = Window.partitionBy("file").orderBy("piece")
    pieces = pieces.select(
        "file", "piece", "low", "high", F.row_number().over(in_file).alias("turn"),
        F.coalesce(F.sum("n").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("file", "piece").orderBy("line"))
    odds = lines.where("odd").select("file", "piece", "line").join(pieces, ["file", "piece"])
    pair = F.floor((F.col("before") + rank - 1) / 2).alias("pair")
    ends = odds.select("file", pair, "turn", "line", "low", "high").groupBy("file", "pair").agg(
        F.count("*").alias("n"), F.min(F.struct("turn", "line", "high")).alias("a"), F.max(F.struct("turn", "line", "low")).alias("b"))
    ends = ends.where("n = 2")
    near = ends.where("a.turn = b.turn").select("file", "pair", F.col("a.line").alias("first"), F.col("b.line").alias("last"))
    # Pairs over pieces: at most one for each end of a piece.
    far = ends.where("a.turn < b.turn").withColumn("turn", F.explode(F.sequence("a.turn", "b.turn")))
    far = far.join(pieces.select("file", "turn", "low", "high"), ["file", "turn"]).select(
        "file", "pair", F.when(F.col("turn") == F.col("a.turn"), F.col("a.line")).otherwise(F.col("low")).alias("first"),
        F.when(F.col("turn") == F.col("b.turn"), F.col("b.line")).otherwise(F.col("high")).alias("last"))
    spans = near.union(far)
    short = spans.groupBy("file", "pair").agg(F.sum(F.col("last") - F.col("first") + 1).alias("size")).where(F.col("size") <= record_lines)
    members = spans.join(short.select("file", "pair"), ["file", "pair"]).select(
        F.struct("file", "pair").alias("record"), F.explode(F.sequence("first", "last")).alias("line"))
    placed = lines.join(members, "line", "left")
    alone = placed.where("record IS NULL").select("value", F.col("odd").alias("open"))
    joined = placed.where("record IS NOT NULL").groupBy("record").agg(
        F.sort_array(F.collect_list(F.struct("piece", "line", "value")))["value"].alias("parts"))
    return alone.unionByName(joined.select(F.array_join("parts", "\n").alias("value"), F.lit(False).alias("open")))


def split_export(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the text of bad ones."""
    good = raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = raw.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)
    return good, bad


def load_table(
    df: DataFrame, path: str, partition_by=(), whole=False,
    scope: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Write rows to a lake table; a run that is repeated leaves the same rows.

    With `partition_by`, only the partitions the rows fall in are replaced, unless `whole`
    says the rows are the whole table. `scope` picks from the table what a run stands for:
    partitions in it that no longer get any row are removed. The rebalance hint gathers the
    rows of a partition value and lets AQE split a value that holds most of them into even
    files. Without `partition_by` rows are written where they are.
    """
    parts = list(partition_by)
    rows = df.hint("rebalance", *parts) if parts else df
    mode = "static" if whole or not parts else "dynamic"
    out = rows.write.mode("overwrite").option("partitionOverwriteMode", mode)
    if parts:
        out = out.partitionBy(*parts)
    before = _files(df.sparkSession, path, df, scope) if mode == "dynamic" and scope else set()
    out.parquet(path)
    if before:
        # Files of a replaced partition are new ones: those that are still there are stale.
        remove(df.sparkSession, before & _files(df.sparkSession, path, df, scope))


def _files(spark: SparkSession, path: str, like: DataFrame, scope) -> set[str]:
    """Files of a lake table that hold rows of the scope; none before the first load."""
    try:
        table = scope(read_table(spark, path, like))
        return {r[0] for r in table.select("_metadata.file_path").distinct().collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()


def remove(spark: SparkSession, paths) -> None:
    """Remove files or folders, wherever the session's file systems have them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = hadoop.Path(path)
        at.getFileSystem(conf).delete(at, True)


def read_table(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """A lake table, with the columns of `like` when given instead of looking for them.

    Of a table with versions it is the newest one.
    """
    version = lake.read_version(spark, path)
    if version:
        return lake.table_of(spark, path, version, like)
    return (spark.read.schema(like.schema) if like is not None else spark.read).parquet(path)
