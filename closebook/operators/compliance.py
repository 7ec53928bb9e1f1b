"""Personal data: columns by name, values by pattern, masking, consent, report.

The reference checks e-mail columns only and stubs the rest; what the other
functions do is this package's own definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kind of personal data -> part of a column name.
NAME_PARTS = {
    "EMAIL": "EMAIL",
    "NATIONAL_ID": "NATIONAL_ID",
    "BIRTH": "BIRTH",
    "PHONE": "PHONE",
}

# Kind of personal data -> a text every match holds; a cheap test before the pattern.
NEEDED_TEXT = {"EMAIL": "@", "PHONE": "+", "IPV4": "."}

# Kind of personal data -> pattern of a value; valid in Java and RE2.
VALUE_PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "PHONE": r"\+[0-9]{1,3}[ -][0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,4}",
    "NATIONAL_ID": r"\b[12][0-9]{9}\b",
    "IPV4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
}


def pii_kind(column="column_name") -> Column:
    """Kind of personal data a column name tells of, null for none."""
    name, out = F.upper(F.col(column)), F.lit(None).cast("string")
    for kind, part in reversed(NAME_PARTS.items()):
        out = F.when(F.contains(name, F.lit(part)), kind).otherwise(out)
    return out


def pii_columns(columns: DataFrame) -> DataFrame:
    """Catalog columns whose name tells of personal data."""
    return columns.withColumn("pii_kind", pii_kind()).where(F.col("pii_kind").isNotNull())


def pii_values(rows: DataFrame, text_columns, by=()) -> DataFrame:
    """Rows and matches per column and kind, over the whole text."""
    counts, sums, out = {}, [], []
    for i, column in enumerate(text_columns):
        for j, (kind, pattern) in enumerate(VALUE_PATTERNS.items()):
            name, found = f"__{i}_{j}", F.regexp_count(F.col(column), F.lit(pattern))
            if kind in NEEDED_TEXT:
                found = F.when(F.contains(F.col(column), F.lit(NEEDED_TEXT[kind])), found)
            counts[name] = F.coalesce(found, F.lit(0))
            sums += [
                F.count_if(F.col(name) > 0).alias(f"r{name}"),
                F.coalesce(F.sum(name), F.lit(0)).alias(f"m{name}"),
            ]
            out.append(
                F.struct(
                    F.lit(column).alias("column_name"), F.lit(kind).alias("pii_kind"),
                    F.col(f"r{name}").alias("rows_with_match"), F.col(f"m{name}").alias("matches"),
                )
            )
    counted = rows.select(*by, *[c.alias(n) for n, c in counts.items()])
    return counted.groupBy(*by).agg(*sums).select(*by, F.inline(F.array(*out)))


def mask_email(column) -> Column:
    """First letter and domain stay; what is no address is hidden whole."""
    c = F.col(column)
    masked = F.regexp_replace(c, "^([^@])[^@]*@", "$1***@")
    return F.when(c.rlike("^[^@\\s]+@[^@\\s]+$"), masked).otherwise(F.regexp_replace(c, "(?s).", "*"))


def mask_id(column, keep: int = 4) -> Column:
    """The last `keep` characters stay; shorter values are hidden whole."""
    c = F.col(column)
    shown = F.when(F.length(c) > keep, F.right(c, F.lit(keep))).otherwise(F.lit(""))
    return F.concat(F.repeat(F.lit("*"), F.length(c) - F.length(shown)), shown)


def mask_key(column, secret: str) -> Column:
    """Keyed digest: equal values stay equal, so joins still work."""
    return F.sha2(F.concat(F.lit(secret), F.col(column).cast("string")).cast("binary"), 256)


def mask(rows: DataFrame, *, emails=(), ids=(), keys=(), hide=(), secret="") -> DataFrame:
    """Rows with personal columns masked; `hide` columns become null.

    `keys` need a secret: without one their digests could be looked up.
    """
    if keys and not secret:
        raise ValueError("keys are masked with a secret only")
    changes = {c: mask_email(c) for c in emails}
    changes |= {c: mask_id(c) for c in ids}
    changes |= {c: mask_key(c, secret) for c in keys}
    changes |= {c: F.lit(None).cast(rows.schema[c].dataType) for c in hide}
    return rows.withColumns(changes)


CONSENT_SCHEMA = "person_id bigint, action string, details string, logged_at timestamp_ntz"


def log_consent(actions: DataFrame, path: str) -> None:
    """Append consent actions to the log."""
    actions.write.mode("append").parquet(path)


def latest_consent(log: DataFrame) -> DataFrame:
    """Newest action per person; equal times go by the action's text."""
    newest = F.max(F.struct("logged_at", "action", "details")).alias("c")
    return log.groupBy("person_id").agg(newest).select(
        "person_id", "c.action", "c.details", "c.logged_at"
    )


def compliance_report(standard, pii: DataFrame, masked: DataFrame, rule_results, certificates):
    """One row per control with its findings, and the status.

    Controls: personal columns without masking, failed ERROR rules, runs
    without a certificate. COMPLIANT means no findings.
    """
    unmasked = pii.join(masked, ["table_name", "column_name"], "left_anti")

    def control(name, rows):
        return rows.agg(F.count("*").alias("findings")).select(
            F.lit(standard).alias("standard"), F.lit(name).alias("control"), "findings"
        )

    bad_rules = rule_results.where(~F.col("passed") & (F.col("severity") == "ERROR"))
    bad_runs = certificates.where(F.col("status") != "CERTIFIED")
    return (
        control("unmasked_pii_columns", unmasked)
        .unionByName(control("failed_error_rules", bad_rules))
        .unionByName(control("uncertified_runs", bad_runs))
        .withColumn(
            "status", F.when(F.col("findings") == 0, "COMPLIANT").otherwise("NON_COMPLIANT")
        )
    )
