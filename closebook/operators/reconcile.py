"""Source against target: counts, sums, checksums, row differences, certificates.

All measures of one table and side come from one aggregate. The two sides are
stacked as (check, side, value) rows and grouped, so no join is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebook.functions.scalars import (
    AMOUNT,
    row_digest,
    table_checksum,
    variance,
    variance_pct,
)
from closebook.model import Check, module_checks
from closebook.session import scratch_path

CHECK_SCHEMA = (
    "module string, check_type string, source_label string, target_label string, "
    "source_value decimal(38,9), target_value decimal(38,9), tolerance decimal(38,9)"
)
# 48-bit digests add up to more digits than an amount holds before the point.
_VALUE = "decimal(38,9)"


def measure(check: Check) -> Column:
    """The value a check takes of a table."""
    if check.check_type == "row_count":
        return F.count("*").cast(_VALUE)
    if check.check_type == "aggregate_balance":
        return F.coalesce(F.sum(check.column), F.lit(0)).cast(_VALUE)
    if check.check_type == "checksum":
        return table_checksum(list(check.columns)).cast(_VALUE)
    raise ValueError(f"no check type {check.check_type}")


def labels(check: Check, source="Oracle", target="Lake", layer="bronze") -> tuple[str, str]:
    if check.check_type == "aggregate_balance":
        return (
            f"{source} {check.source_table}.{check.column}",
            f"{target} {check.target_table}.{check.column.lower()}",
        )
    return f"{source} {check.source_table}", f"{target} {layer}.{check.target_table}"


def _side(tables: dict[str, DataFrame], checks: list[Check], side: str) -> list[DataFrame]:
    """(check number, side, value) rows, one aggregate per table."""
    by_table: dict[str, list[tuple[int, Check]]] = {}
    for i, check in enumerate(checks):
        name = check.source_table if side == "source" else check.target_table
        by_table.setdefault(name, []).append((i, check))
    out = []
    for name, group in by_table.items():
        if name not in tables:
            raise ValueError(f"no {side} table {name}")
        measures = [measure(c).alias(f"m{i}") for i, c in group]
        rows = F.array(
            *[
                F.struct(F.lit(i).alias("check"), F.lit(side).alias("side"),
                         F.col(f"m{i}").alias("value"))
                for i, _ in group
            ]
        )
        out.append(tables[name].agg(*measures).select(F.inline(rows)))
    return out


def run_checks(module, source, target, checks=None, spark=None, **label_options) -> DataFrame:
    """One row per check with the value of both sides.

    `source` maps source table names, `target` lake table names, to DataFrames
    that hold the same slice of the data. A module without checks gives no rows.
    """
    checks = module_checks(module) if checks is None else list(checks)
    if not checks:
        return (spark or next(iter(source.values())).sparkSession).createDataFrame([], CHECK_SCHEMA)
    stacked = reduce(
        DataFrame.unionByName, _side(source, checks, "source") + _side(target, checks, "target")
    )
    both = stacked.groupBy("check").agg(
        F.max(F.when(F.col("side") == "source", F.col("value"))).alias("source_value"),
        F.max(F.when(F.col("side") == "target", F.col("value"))).alias("target_value"),
    )
    described = F.create_map(
        *[
            x
            for i, c in enumerate(checks)
            for x in (
                F.lit(i),
                F.struct(
                    F.lit(c.check_type).alias("check_type"),
                    F.lit(labels(c, **label_options)[0]).alias("source_label"),
                    F.lit(labels(c, **label_options)[1]).alias("target_label"),
                    F.lit(c.tolerance).cast(_VALUE).alias("tolerance"),
                ),
            )
        ]
    )
    about = F.element_at(described, F.col("check"))
    # A checksum check compares 1 with 1 on a match and 1 with 0 otherwise.
    is_sum = F.col("check_type") != "checksum"
    match = F.when(F.col("source_value") == F.col("target_value"), 1).otherwise(0).cast(_VALUE)
    return (
        both.select(F.lit(module.upper()).alias("module"), about.alias("a"),
                    "source_value", "target_value")
        .select("module", "a.check_type", "a.source_label", "a.target_label",
                "source_value", "target_value", "a.tolerance")
        .withColumns(
            {
                "source_value": F.when(is_sum, F.col("source_value")).otherwise(F.lit(1).cast(_VALUE)),
                "target_value": F.when(is_sum, F.col("target_value")).otherwise(match),
            }
        )
    )


def evaluate_checks(checks: DataFrame) -> DataFrame:
    """Checks with variance, percentage and whether they are within tolerance."""
    off = variance("source_value", "target_value")
    return checks.withColumns(
        {
            "variance": off,
            "variance_pct": variance_pct("source_value", "target_value"),
            "passed": off <= F.col("tolerance"),
        }
    )


def compare_groups(source, target, by, count=True, sums=(), checksum=(), tolerance="0.01"):
    """Counts, sums and checksum of both sides per group, in one grouping."""
    need = list(dict.fromkeys([*by, *sums, *checksum]))
    tagged = source.select(*need, F.lit("s").alias("side")).unionByName(
        target.select(*need, F.lit("t").alias("side"))
    )
    measures = []
    for side in ("s", "t"):
        here = F.col("side") == side
        if count:
            measures.append(F.count_if(here).alias(f"{side}_count"))
        for c in sums:
            zero = F.lit(0).cast(source.schema[c].dataType)
            measures.append(F.sum(F.when(here, F.coalesce(c, zero)).otherwise(zero)).alias(f"{side}_{c}"))
        if checksum:
            measures.append(F.coalesce(F.sum(F.when(here, F.col("__digest"))), F.lit(0)).alias(f"{side}_checksum"))
    if checksum:
        tagged = tagged.withColumn("__digest", row_digest(list(checksum)))
    out = tagged.groupBy(*by).agg(*measures)
    passed = F.lit(True)
    if count:
        passed = passed & (F.col("s_count") == F.col("t_count"))
    for c in sums:
        passed = passed & (variance(f"s_{c}", f"t_{c}") <= F.lit(tolerance).cast(AMOUNT))
    if checksum:
        passed = passed & (F.col("s_checksum") == F.col("t_checksum"))
    return out.withColumn("passed", passed)


def row_differences(source, target, key, columns) -> DataFrame:
    """Keys that are missing, extra, changed or repeated, with the changed columns.

    Both sides are stacked and grouped by key: rows of a repeated key are counted and
    their digests summed, not paired, and the key is reported as `repeated` when that
    differs between the sides. `multiset_differences` lists the rows.
    """
    key = list(key)
    stacked = source.select(*key, *columns, F.lit(1).alias("__s")).unionByName(
        target.select(*key, *columns, F.lit(0).alias("__s"))
    )
    in_source = F.col("__s") == 1
    aggs = [
        F.count_if(in_source).alias("source_rows"),
        F.count_if(~in_source).alias("target_rows"),
        F.sum(F.when(in_source, F.col("__digest"))).alias("__s_digest"),
        F.sum(F.when(~in_source, F.col("__digest"))).alias("__t_digest"),
    ]
    stacked = stacked.withColumn("__digest", row_digest(list(columns)))
    for c in columns:
        aggs.append(F.max(F.when(in_source, F.col(c))).alias(f"__s_{c}"))
        aggs.append(F.max(F.when(~in_source, F.col(c))).alias(f"__t_{c}"))
    grouped = stacked.groupBy(*key).agg(*aggs)
    changed = F.array_compact(
        F.array(
            *[F.when(~F.col(f"__s_{c}").eqNullSafe(F.col(f"__t_{c}")), F.lit(c)) for c in columns]
        )
    )
    one_each = (F.col("source_rows") <= 1) & (F.col("target_rows") <= 1)
    same_rows = (F.col("source_rows") == F.col("target_rows")) & (
        F.col("__s_digest") == F.col("__t_digest")
    )
    status = (
        F.when(F.col("target_rows") == 0, "missing")
        .when(F.col("source_rows") == 0, "extra")
        .when(~one_each, F.when(~same_rows, "repeated"))
        .when(F.size(changed) > 0, "changed")
    )
    changed_text = F.when(status == "changed", F.array_join(changed, ",")).otherwise(F.lit(""))
    return grouped.select(
        *key, status.alias("status"), changed_text.alias("changed_columns"),
        "source_rows", "target_rows",
    ).where(F.col("status").isNotNull())


#: Groups of keys whose sums are compared first; what is broadcast is at most a number each.
BUCKETS = 1 << 16


def _hash(columns) -> Column:
    """64 bits of values and of which of them are null."""
    absent = reduce(Column.bitwiseOR, [
        F.when(F.col(c).isNull(), F.lit(1 << i % 63)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(columns)])
    return F.xxhash64(*columns, absent)


def differing_keys(source, target, key, columns, buckets=BUCKETS) -> DataFrame:
    """Hashes of the keys whose rows differ between the sides, found by digests alone.

    Two levels of a digest tree: sums over buckets of keys, combined before the shuffle;
    then, of the buckets that differ, the digest of each row, 16 bytes however wide the row
    is. Rows that both sides have cancel out.
    """
    key, columns = list(key), list(columns)
    digests = [
        side.select(_hash(key).alias("key_hash"), _hash([*key, *columns]).alias("digest"), F.lit(sign).alias("side"))
        for side, sign in ((source, 1), (target, -1))
    ]
    rows = digests[0].unionByName(digests[1]).withColumn("bucket", F.pmod("key_hash", F.lit(buckets)).cast("int"))
    half = F.lit((1 << 31) - 1)
    sums = rows.groupBy("bucket").agg(
        F.sum("side").alias("n"), F.sum(F.col("side") * F.col("digest").bitwiseAND(half)).alias("low"),
        F.sum(F.col("side") * F.shiftrightunsigned("digest", 33)).alias("high"))
    apart = sums.where("n <> 0 OR low <> 0 OR high <> 0").select("bucket")
    return (
        rows.join(F.broadcast(apart), "bucket", "left_semi").groupBy("key_hash", "digest").agg(F.sum("side").alias("n"))
        .where("n <> 0").select("key_hash").distinct()
    )


def located_differences(source, target, key, columns, buckets=BUCKETS) -> DataFrame:
    """The rows of `row_differences`, of which only keys that differ are shuffled whole.

    The hashes of those keys are written once: their number is that of the differences, and
    Spark joins by their measured size.
    """
    spark, path = source.sparkSession, scratch_path(source.sparkSession, "differing")
    differing_keys(source, target, key, columns, buckets).write.parquet(path)
    found = spark.read.schema("key_hash bigint").parquet(path)
    sides = [
        side.select(*key, *columns).withColumn("key_hash", _hash(list(key))).join(found, "key_hash", "left_semi").drop("key_hash")
        for side in (source, target)
    ]
    return row_differences(*sides, key, columns)


def multiset_differences(source, target, columns) -> DataFrame:
    """Rows whose number of copies differs; works for tables without a key."""
    stacked = source.select(*columns, F.lit(1).alias("__n")).unionByName(
        target.select(*columns, F.lit(-1).alias("__n"))
    )
    return (
        stacked.groupBy(*columns)
        .agg(
            F.count_if(F.col("__n") == 1).alias("source_rows"),
            F.count_if(F.col("__n") == -1).alias("target_rows"),
        )
        .where(F.col("source_rows") != F.col("target_rows"))
    )


def certificate(checks: DataFrame, module, period_name, period_year, period_num, run_id) -> DataFrame:
    """One certificate row over evaluated checks; without checks it is NO_CHECKS."""
    total = F.count("*")
    passed = F.count_if("passed")
    status = (
        F.when(total == 0, "NO_CHECKS").when(passed == total, "CERTIFIED").otherwise("FAILED")
    )
    cert_id = f"CERT-{module.upper()}-{period_year}-{period_num:02d}-{run_id}"
    out = checks.agg(
        total.alias("total_checks"), passed.alias("passed_checks"), status.alias("status")
    )
    # Fixed value: the wording of the summary.
    summary = F.format_string(
        "Certificate %s: %s %s — %d/%d checks passed — Status: %s",
        F.lit(cert_id), F.lit(module.upper()), F.lit(period_name),
        F.col("passed_checks"), F.col("total_checks"), F.col("status"),
    )
    return out.select(
        F.lit(cert_id).alias("certificate_id"),
        F.lit(module.upper()).alias("module"),
        F.lit(period_name).alias("period_name"),
        "total_checks",
        "passed_checks",
        (F.col("total_checks") - F.col("passed_checks")).alias("failed_checks"),
        "status",
        summary.alias("summary"),
    )


def run_summary(runs: DataFrame, by=()) -> DataFrame:
    """Runs, rows moved, and the share of runs that reconciled, in percent."""
    total = F.count("*")
    return runs.groupBy(*by).agg(
        total.alias("total_runs"),
        F.coalesce(F.sum("rows_extracted"), F.lit(0)).alias("rows_extracted"),
        F.coalesce(F.sum("rows_loaded"), F.lit(0)).alias("rows_loaded"),
        F.when(total == 0, F.lit(0.0))
        .otherwise(F.count_if("reconciliation_passed") / F.greatest(total, F.lit(1)) * 100)
        .alias("pass_rate"),
    )
