"""Scalar expressions of the finance and catalog logic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from closebook.model import DEFAULT_TARGET_TYPE, LAYER_PREFIXES, MONTHS, TARGET_TYPES

AMOUNT = "decimal(38,9)"
_DAY_MICROS = 86_400_000_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_segments(*segments) -> Column:
    """Account segments joined with dots, empty and null ones left out."""
    return F.concat_ws(".", *[F.nullif(_col(s), F.lit("")) for s in segments])


def period_year(text) -> Column:
    """Year of a period name such as Jan-26; no year gives 2026, a bad one null."""
    parts = F.split(_col(text), "-")
    year = F.get(parts, F.lit(1)).try_cast("int")
    return F.when(F.size(parts) < 2, F.lit(2026)).otherwise(
        F.when(year < 100, year + 2000).otherwise(year)
    )


def period_number(text) -> Column:
    """Month number of a period name; an unknown month gives 1, an empty one 0."""
    month = F.initcap(F.substring(F.get(F.split(_col(text), "-"), F.lit(0)), 1, 3))
    months = F.array(*[F.lit(m) for m in MONTHS])
    found = F.array_position(months, month).cast("int")
    return F.when(month == "", F.lit(0)).otherwise(
        F.when(found > 0, found).when(month.isNotNull(), F.lit(1))
    )


def elapsed_days(start, end) -> Column:
    """Whole days from start to end, rounded down, so minus one hour is -1 day."""
    micros = F.timestamp_diff("MICROSECOND", _col(start), _col(end))
    down = micros - F.pmod(micros, F.lit(_DAY_MICROS))
    return F.call_function("div", down, F.lit(_DAY_MICROS))


def is_blank(column, data_type: T.DataType) -> Column:
    """Null, or text with nothing but white space, that of Unicode included."""
    c = _col(column)
    if isinstance(data_type, T.StringType):
        return c.isNull() | ~c.rlike(r"(?U)\S")
    return c.isNull()


def to_amount(column) -> Column:
    """Value as decimal, null where it is not a number."""
    return _col(column).try_cast(AMOUNT)


def variance(source, target) -> Column:
    return F.abs(_col(source) - _col(target))


def variance_pct(source, target) -> Column:
    """Variance in percent of the source; 0 against 0 is 0, 0 against more is 100."""
    s, t = _col(source).cast("double"), _col(target).cast("double")
    return F.when(s == 0, F.when(t == 0, F.lit(0.0)).otherwise(F.lit(100.0))).otherwise(
        F.abs(s - t) / F.abs(s) * 100
    )


def target_type(source_type) -> Column:
    """Warehouse type of a source type; the text before the first bracket decides."""
    base = F.trim(F.upper(F.split(_col(source_type), r"\(")[0]))
    pairs = [F.lit(x) for pair in TARGET_TYPES.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), base), F.lit(DEFAULT_TARGET_TYPE))


def model_name(table, layer: str) -> Column:
    """Name of the model of a table in a layer."""
    clean = F.replace(F.lower(_col(table)), F.lit("_all"), F.lit(""))
    return F.concat(
        F.lit(LAYER_PREFIXES.get(layer, layer) + "_"), F.regexp_replace(clean, "_+$", "")
    )


def row_digest(columns) -> Column:
    """First 48 bits of an md5 over the columns, as a whole decimal.

    Every value is written with its length and null with a mark of its own,
    so ('a', '') and ('', 'a') differ. Cast floating columns to decimal first:
    engines write doubles in different ways.
    """
    parts = []
    for c in columns:
        text = _col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("N")))
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(20,0)")


def table_checksum(columns) -> Column:
    """Order-free checksum of a table: the sum of its row digests, 0 when empty."""
    total = F.sum(row_digest(columns))
    return F.coalesce(total, F.lit(0).cast("decimal(30,0)"))
