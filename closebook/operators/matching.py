"""Which lines of two sides settle each other, and which are left.

No line is compared with another. A pass puts lines into cells that hold only lines that
may match, ranks each side within its cells, and the n-th line of one side settles the n-th
of the other, as long as both have one:

1. `exact`: cells of equal amounts.
2. `near`: cells as wide as the tolerance, so what meets is within it; a second pass with
   cells moved by half their width finds what the first one's edges part. Afterwards no cell
   of either pass holds lines of both sides: two lines left are over half a tolerance apart.
3. `sum`: lines of the source that belong to one group, of at most `largest` lines, settle a
   line of the target with the amount of their sum.

Cells are sorted whole, in one shuffle a pass. Lines are first counted by buckets of cells: in
buckets with over `CROWD` lines, or 8 times the mean, ranks are taken within parts of a cell and
counted on from part to part, so a cell that holds a third of all lines is dealt over `PARTS` tasks.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from closebook.session import scratch_path

AMOUNT = "decimal(28,6)"
PARTS = 64
BUCKETS = 1 << 16
CROWD = 200_000
LARGEST = 50


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """Rows as a table: a pass is read for what it settled and for what it left."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _crowded(keyed: DataFrame) -> list[int]:
    """Buckets of cells that hold more lines than one task should sort."""
    counts = keyed.groupBy(_bucket().alias("bucket")).agg(F.count("*").alias("n")).collect()
    limit = max(CROWD, 8 * sum(r["n"] for r in counts) // BUCKETS)
    return sorted(r["bucket"] for r in counts if r["n"] > limit)


def _bucket() -> Column:
    return F.pmod("hash", F.lit(BUCKETS))


def _ranked(keyed: DataFrame, at: list[str]) -> DataFrame:
    """Lines with `rank` and the `pairs` of their cell, by one sort. The hash comes first in
    it, so that it settles nearly all comparisons."""
    order = Window.partitionBy("hash", *at).orderBy("part", "amount", "line_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    source, target = (F.count_if(F.col("side") == s) for s in ("source", "target"))
    ranked = keyed.select(
        "*", source.over(so_far).alias("s"), target.over(so_far).alias("t"), F.least(source.over(every), target.over(every)).alias("pairs"))
    return ranked.withColumn("rank", F.when(F.col("side") == "source", F.col("s")).otherwise(F.col("t"))).drop("s", "t")


def _ranked_in_parts(keyed: DataFrame, at: list[str]) -> DataFrame:
    """The same, cells dealt over `PARTS` tasks."""
    counts = keyed.groupBy(*at, "side", "part").agg(F.count("*").alias("n"))
    both = counts.groupBy(*at).agg(
        F.least(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)) for s in ("source", "target")]).alias("pairs"))
    earlier = Window.partitionBy(*at, "side").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n").join(both.where("pairs > 0"), at)
    ranked = keyed.join(base, [*at, "side", "part"], "left")
    rank = F.col("base") + F.row_number().over(Window.partitionBy(*at, "side", "part").orderBy("amount", "line_id"))
    return ranked.withColumn("rank", rank).drop("base")


def _pass(rows: DataFrame, by: list[str], cell: Column) -> DataFrame:
    """`rows` with their rank in their cell where the pass settles them."""
    at = [*by, "cell"]
    keyed = rows.withColumn("cell", cell).withColumn("part", F.pmod("line_id", F.lit(PARTS)).cast("int")).withColumn("hash", F.xxhash64(*at))
    crowded = _crowded(keyed)
    columns = [*keyed.columns, "rank", "pairs"]
    if crowded:
        full = _bucket().isin(crowded)
        ranked = _ranked(keyed.where(~full), at).select(*columns).unionByName(_ranked_in_parts(keyed.where(full), at).select(*columns))
    else:
        ranked = _ranked(keyed, at)
    settled = (F.col("rank") <= F.col("pairs")) & F.col("part").isNotNull()
    return ranked.select(*rows.columns, F.when(settled, F.col("rank")).alias("rank"))


def _matched(rows: DataFrame, by: list[str], cell: Column, name: str) -> DataFrame:
    """Rows of a pass with `match` and `match_key` in place of their rank. The key's text is not
    kept, who reads it puts it together."""
    key = F.concat_ws(":", F.lit(name), *[F.col(c).cast("string") for c in by], cell.cast("string"), F.col("rank").cast("string"))
    settled = F.col("rank").isNotNull()
    return rows.select(
        *[c for c in rows.columns if c != "rank"], F.when(settled, name).alias("match"), F.when(settled, key).alias("match_key"))


def _amount_type(*sides: DataFrame) -> str:
    """The type amounts are sorted in: one that a number holds where theirs allow it."""
    types = [side.schema["amount"].dataType for side in sides]
    if all(isinstance(t, T.DecimalType) and t.scale <= 6 for t in types):
        whole, scale = max(t.precision - t.scale for t in types), max(t.scale for t in types)
        if whole + scale <= 18:
            return f"decimal({whole + scale},{scale})"
    return AMOUNT


def match_lines(
    source: DataFrame, target: DataFrame, by, tolerance, group: str | None = None, largest: int = LARGEST,
) -> DataFrame:
    """Lines (side, `by`, line_id, amount, match, match_key) of both sides; match is null where
    nothing settles a line.

    Both sides have `by`, `line_id` and `amount`, the source also `group`. Lines of one match
    share `match_key`. Lines without an amount or with a null in `by` settle nothing.
    """
    by = list(by)
    columns = [*by, F.col("line_id").cast("bigint"), F.col("amount").cast(_amount_type(source, target)).alias("amount")]
    lines = source.select(
        F.lit("source").alias("side"), *columns, (F.col(group) if group else F.lit(None).cast("string")).alias("group")
    ).unionByName(target.select(F.lit("target").alias("side"), *columns), allowMissingColumns=True)
    whole = F.col("amount").isNotNull()
    for c in by:
        whole = whole & F.col(c).isNotNull()
    none = [F.lit(None).cast("string").alias("match"), F.lit(None).cast("string").alias("match_key")]
    done = [lines.where(~whole).select("*", *none)]
    width = F.lit(Decimal(str(tolerance))).cast("decimal(18,6)")
    amount = F.col("amount").cast(AMOUNT)
    passes = [("exact", F.col("amount"), amount)]
    if tolerance:
        passes += [(name, cell, cell) for name, cell in (("near", F.floor(amount / width)), ("moved", F.floor((amount + width / 2) / width)))]
    left = lines.where(whole)
    for name, cell, shown in passes:
        out = _matched(_kept(_pass(left, by, cell), f"match-{name}"), by, shown, name)
        done.append(out.where("match IS NOT NULL"))
        left = out.where("match IS NULL").drop("match", "match_key")
    if group:
        in_group = left.where("side = 'source' AND `group` IS NOT NULL").groupBy(*by, "group").agg(
            F.count("*").alias("n"), F.sum("amount").cast(AMOUNT).alias("amount"), F.min("line_id").alias("line_id"))
        sums = in_group.where(F.col("n").between(2, largest)).select(F.lit("source").alias("side"), *by, "line_id", "amount", "group")
        out = _matched(_kept(_pass(sums.unionByName(left.where("side = 'target'")), by, F.col("amount")), "match-sum"), by, amount, "sum")
        done.append(out.where("side = 'target'"))
        groups = out.where("side = 'source' AND match IS NOT NULL").select(*by, "group", "match", "match_key")
        done.append(left.where("side = 'source'").join(groups, [*by, "group"], "left").select(*lines.columns, "match", "match_key"))
    else:
        done.append(left.select("*", *none))
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.withColumns({
        "amount": amount, "match": F.when(F.col("match") == "moved", "near").otherwise(F.col("match"))}).drop("group")
