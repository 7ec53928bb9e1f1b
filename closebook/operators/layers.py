"""Bronze flattening, staging casts, intermediate select and mart union."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from closebook.model import DEFAULT_TARGET_TYPE, TARGET_TYPES


def iso_text(column) -> Column:
    """Timestamp as ISO text, fractions of a second only when there are some."""
    c = F.col(column) if isinstance(column, str) else column
    whole = F.date_trunc("SECOND", c) == c
    return F.when(whole, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def _is_money(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.names == ["amount", "currency"]


def flatten(entities: DataFrame) -> DataFrame:
    """Entities as flat bronze rows.

    Money becomes a double and its currency, other structs JSON text, lists
    their length, timestamps ISO text; the rest stays.
    """
    out = []
    for field in entities.schema:
        c, name, t = F.col(f"`{field.name}`"), field.name, field.dataType
        if _is_money(t):
            out += [c["amount"].cast("double").alias(name),
                    c["currency"].alias(f"{name}_currency")]
        elif isinstance(t, T.StructType):
            out.append(F.to_json(c).alias(name))
        elif isinstance(t, T.ArrayType):
            out.append(F.coalesce(F.size(c), F.lit(0)).alias(f"{name}_count"))
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            out.append(iso_text(c).alias(name))
        else:
            out.append(c)
    return entities.select(*out)


_SPARK_TYPES = {
    "STRING": "string", "NUMERIC": "decimal(38,9)", "FLOAT64": "double",
    "TIMESTAMP": "timestamp_ntz", "BYTES": "binary",
}


def spark_type(source_type: str) -> str:
    """Spark type of a source column; NUMBER(p,s) keeps its precision and scale."""
    base = source_type.split("(")[0].strip().upper()
    target = TARGET_TYPES.get(base, DEFAULT_TARGET_TYPE)
    exact = re.search(r"\(\s*(\d+)\s*,\s*(\d+)\s*\)", source_type)
    if target == "NUMERIC" and exact and int(exact[2]) <= int(exact[1]) <= 38:
        return f"decimal({exact[1]},{exact[2]})"
    return _SPARK_TYPES[target]


def staging(raw: DataFrame, columns: list[tuple]) -> DataFrame:
    """Raw columns cast by their source type, names in lower case; bad values become null.

    `columns` holds (name, source type, ...) as `catalog.table_columns` reads it.
    """
    return raw.select(
        *[F.col(f"`{name}`").try_cast(spark_type(t)).alias(name.lower()) for name, t, *_ in columns]
    )


def intermediate(staged: DataFrame) -> DataFrame:
    """Lower-case columns, and `<segment>_value` for every account segment."""
    names = [c.lower() for c in staged.columns]
    segments = [c for c in names if "segment" in c]
    return staged.select(
        *[F.col(f"`{c}`").alias(c.lower()) for c in staged.columns],
        *[F.col(f"`{c}`").alias(f"{c}_value") for c in segments],
    )


def model_of(tables: list[str]) -> dict[str, str]:
    """Staging model -> table; two tables that would share a model are an error."""
    out: dict[str, str] = {}
    for table in tables:
        name = "stg_" + table.lower().replace("_all", "").rstrip("_")
        if name in out:
            raise ValueError(f"{out[name]} and {table} both make the model {name}")
        out[name] = table
    return out


def mart_union(models: dict[str, DataFrame]) -> DataFrame:
    """All staging models of a module under each other, named by their source table.

    Columns a model lacks are null; `source_table` tells where a row is from.
    """
    out = None
    for name, table in model_of(list(models)).items():
        df = models[table]
        tagged = df.withColumn("source_table", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def check_model_names(names: DataFrame) -> DataFrame:
    """Model names more than one table gives; empty when all are usable."""
    return names.groupBy("model_name").agg(
        F.count("*").alias("tables"), F.min("table_name").alias("first_table"),
        F.max("table_name").alias("last_table"),
    ).where(F.col("tables") > 1)
