"""Audit of stored procedure code, as expressions over a table of code objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: patterns and texts must equal the reference's. ----
UNSUPPORTED = {
    r"\bDBMS_SQL\b": "DBMS_SQL dynamic SQL package",
    r"\bUTL_FILE\b": "UTL_FILE file I/O package",
    r"\bDBMS_PIPE\b": "DBMS_PIPE inter-session messaging",
    r"\bDBMS_JOB\b": "DBMS_JOB scheduling (use pg_cron)",
    r"\bDBMS_LOB\b": "DBMS_LOB large object manipulation",
    r"\bAUTONOMOUS_TRANSACTION\b": "Autonomous transactions (use dblink)",
    r"\bBULK\s+COLLECT\b": "BULK COLLECT (use array aggregation)",
    r"\bFORALL\b": "FORALL bulk DML (use INSERT...SELECT)",
    r"\bPIPELINED\b": "Pipelined table functions (use RETURNS TABLE)",
    r"\bRESULT_CACHE\b": "Result cache (not supported in PG)",
}
# Applied in this order; groups are written $1 as in Java.
REWRITES = [
    (r"\bNVL\(", "COALESCE("),
    (r"\bNVL2\(([^,]+),\s*([^,]+),\s*([^)]+)\)", "CASE WHEN $1 IS NOT NULL THEN $2 ELSE $3 END"),
    (r"\bDECODE\(", "-- DECODE requires manual conversion: DECODE("),
    (r"\bSYSDATE\b", "CURRENT_TIMESTAMP"),
    (r"\bSYSTIMESTAMP\b", "CURRENT_TIMESTAMP"),
    (r"\bTO_DATE\(", "TO_TIMESTAMP("),
    (r"\bTO_CHAR\(", "TO_CHAR("),
    (r"\bDBMS_OUTPUT\.PUT_LINE\(", "RAISE NOTICE '%', ("),
    (r"\bRAISE_APPLICATION_ERROR\s*\(\s*-?\d+\s*,\s*", "RAISE EXCEPTION "),
    (r":NEW\.", "NEW."),
    (r":OLD\.", "OLD."),
    (r"\bIS\s+TABLE\s+OF\b", "[]"),
    (r"\bVARCHAR2\b", "VARCHAR"),
    (r"\bNUMBER\b", "NUMERIC"),
    (r"\bINTEGER\b", "INTEGER"),
]
# ---- End of fixed values. ----


def unsupported_constructs(body="body") -> Column:
    """Descriptions of constructs that need work by hand, in list order."""
    return F.array_compact(
        F.array(*[F.when(F.rlike(F.col(body), F.lit(f"(?i){p}")), d) for p, d in UNSUPPORTED.items()])
    )


def rewrite(body="body") -> Column:
    """Body with every rewrite applied, any case."""
    out = F.col(body)
    for pattern, replacement in REWRITES:
        out = F.regexp_replace(out, f"(?i){pattern}", replacement)
    return out


def findings(objects: DataFrame) -> DataFrame:
    """One row per object and unsupported construct."""
    return objects.select(
        "schema_name", "object_name", F.explode(unsupported_constructs()).alias("construct")
    )


def translate(objects: DataFrame) -> DataFrame:
    """Objects with the rewritten body and what is left to do by hand."""
    return objects.withColumns(
        {"translated": rewrite(), "unsupported": unsupported_constructs()}
    ).withColumn("has_decode", F.contains(F.col("translated"), F.lit("DECODE(")))


def summary(objects: DataFrame) -> DataFrame:
    """Objects per schema: all, clean, with unsupported constructs, with DECODE left."""
    found = translate(objects)
    blocked = F.size("unsupported") > 0
    return found.groupBy("schema_name").agg(
        F.count("*").alias("objects"),
        F.count_if(~blocked & ~F.col("has_decode")).alias("clean"),
        F.count_if(blocked).alias("with_unsupported"),
        F.count_if("has_decode").alias("with_decode"),
        F.sum(F.size("unsupported")).cast("bigint").alias("findings"),
    )
