"""The source dictionary: classification, keys, flexfields, relationships, casts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from closebook.functions.scalars import target_type
from closebook.model import MODULE_PREFIXES
from closebook.operators.layers import spark_type
from closebook.session import scratch_path

# An Oracle table has at most 1,000 columns, so lists per table stay small.


def module_of(table="table_name") -> Column:
    """Module by the prefix of the table name."""
    out = F.lit("UNKNOWN")
    for prefix, module in reversed(MODULE_PREFIXES.items()):
        out = F.when(F.startswith(F.col(table), F.lit(prefix)), module).otherwise(out)
    return out


def flexfield_type(column="column_name") -> Column:
    """KFF for segment columns, else DFF for attribute columns, else null."""
    name = F.col(column)
    return F.when(F.contains(name, F.lit("SEGMENT")), "KFF").when(
        F.contains(name, F.lit("ATTRIBUTE")), "DFF"
    )


def live_tables(tables: DataFrame) -> DataFrame:
    """Tables outside the recycle bin."""
    return tables.where(~F.col("table_name").like("BIN$%"))


def matching(tables: DataFrame, pattern: str) -> DataFrame:
    """Tables whose name has the pattern anywhere, in any case; percent signs are dropped."""
    part = pattern.replace("%", "").upper()
    return tables.where(F.contains(F.upper("table_name"), F.lit(part)))


def custom_objects(objects: DataFrame, owner: str) -> DataFrame:
    """Triggers, indexes, sequences and synonyms of an owner that the system did not make.

    The underscore in the pattern stands for any character, as in the source.
    """
    return objects.where(
        (F.col("owner") == owner)
        & F.col("object_type").isin("TRIGGER", "INDEX", "SEQUENCE", "SYNONYM")
        & ~F.col("object_name").like("SYS_%")
    )


def primary_keys(constraints: DataFrame, cons_columns: DataFrame) -> DataFrame:
    """Key columns per table; a constraint is known by its name and owner."""
    keys = constraints.where(F.col("constraint_type") == "P").select("owner", "constraint_name")
    return cons_columns.join(keys, ["owner", "constraint_name"]).select(
        "owner", "table_name", "column_name", "position"
    )


TABLE = ["owner", "table_name"]


def classify(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Module, number of columns and estimated rows per table of an owner."""
    counts = columns.groupBy(*TABLE).agg(F.count("*").alias("column_count"))
    return live_tables(tables).join(counts, TABLE, "left").select(
        *TABLE, module_of().alias("module"),
        F.coalesce("column_count", F.lit(0)).alias("column_count"),
        F.coalesce("num_rows", F.lit(0)).alias("estimated_rows"),
    )


def schema_metadata(tables, columns, keys) -> DataFrame:
    """Tables of an owner with their columns in order, key columns, module and flexfields."""
    cols = columns.groupBy(*TABLE).agg(
        F.sort_array(
            F.collect_list(F.struct("column_id", "column_name", "data_type", "data_length",
                                    "data_precision", "data_scale",
                                    (F.col("nullable") == "Y").alias("nullable")))
        ).alias("columns")
    )
    pk = keys.groupBy(*TABLE).agg(
        F.sort_array(F.collect_list(F.struct("position", "column_name"))).alias("pk")
    )
    joined = live_tables(tables).join(cols, TABLE, "left").join(pk, TABLE, "left")
    no_columns = F.array().cast(cols.schema["columns"].dataType)
    return joined.select(
        *TABLE, module_of().alias("module"),
        F.coalesce("columns", no_columns).alias("columns"),
        F.coalesce(F.col("pk.column_name"), F.array().cast("array<string>")).alias("primary_key"),
        F.coalesce("num_rows", F.lit(0)).alias("estimated_rows"),
    )


def table_columns(columns: DataFrame, owner: str, table: str) -> list[tuple[str, str, int | None]]:
    """(name, source type, length of text) of one table's columns, in order.

    What staging and cast profiles are made from. A number's type is written with its
    precision and scale; only text has a length that a value can break.
    """
    rows = (
        columns.where((F.col("owner") == owner) & (F.col("table_name") == table))
        .orderBy("column_id").collect()
    )
    out = []
    for r in rows:
        base, text = r["data_type"].split("(")[0].strip().upper(), None
        full = r["data_type"]
        if base == "NUMBER" and r["data_precision"] is not None and "(" not in full:
            full = f"NUMBER({r['data_precision']},{r['data_scale'] or 0})"
        elif base in ("VARCHAR2", "CHAR", "NVARCHAR2", "NCHAR"):
            text = r["data_length"]
        out.append((r["column_name"], full, text))
    return out


def flexfields(columns: DataFrame) -> DataFrame:
    """Segment and attribute columns per table of an owner, in column order."""
    found = columns.withColumn("flexfield_type", flexfield_type()).where(
        F.col("flexfield_type").isNotNull()
    )
    listed = F.sort_array(F.collect_list(F.struct("column_id", "column_name")))
    return found.groupBy(*TABLE, "flexfield_type").agg(
        F.count("*").alias("column_count"), listed["column_name"].alias("columns")
    )


def type_usage(columns: DataFrame) -> DataFrame:
    """How often each source type is used and what it becomes."""
    return columns.groupBy("data_type").agg(F.count("*").alias("columns")).withColumn(
        "target_type", target_type("data_type")
    )


def key_description(pk="is_pk", fk_table="fk_target_table", fk_column="fk_target_column") -> Column:
    """What a column is: primary key, foreign key to a column, both or neither."""
    primary = F.when(F.col(pk), F.lit("Primary key.")).otherwise(F.lit(None))
    foreign = F.when(
        F.col(fk_table).isNotNull(),
        F.concat(F.lit("Foreign key to "), F.col(fk_table), F.lit("."), F.col(fk_column), F.lit(".")),
    )
    return F.concat_ws(" ", primary, foreign)


def _comparable(a: T.DataType, b: T.DataType) -> bool:
    """Of one type, or both exact numbers: those meet in the wider type."""
    exact = (T.IntegralType, T.DecimalType)
    return a == b or (isinstance(a, exact) and isinstance(b, exact))


def relationships(
    tables: dict[str, DataFrame], keys: dict[str, str], threshold: float = 0.95
) -> DataFrame:
    """Columns that look like references to a key of the same name.

    For each key name the values of all tables that have the column are grouped by value
    and table, whatever the number of tables, and marked where the key's table has the
    value. `keys` maps a table to its key column. Whole numbers and decimals of any width
    are compared; a column of another kind than the key is no reference.
    """
    out = None
    for key_table, key in keys.items():
        key_type = tables[key_table].schema[key].dataType
        users = [
            n for n, df in tables.items()
            if n != key_table and key in df.columns and _comparable(df.schema[key].dataType, key_type)
        ]
        if not users:
            continue

        def values(name, key=key):
            return tables[name].select(F.col(key).alias("v"), F.lit(name).alias("source_table"))

        rows = reduce(DataFrame.unionByName, [values(n) for n in (key_table, *users)])
        pairs = rows.where(F.col("v").isNotNull()).distinct()
        known = F.bool_or(F.col("source_table") == key_table)
        # At most one entry per table and value: the names of the tables that have it.
        by_value = pairs.groupBy("v").agg(known.alias("known"), F.collect_set("source_table").alias("names"))
        part = by_value.select("known", F.explode("names").alias("source_table")).groupBy("source_table").agg(
            F.count("*").alias("distinct_values"), F.count_if("known").alias("matched_values")
        ).where(F.col("source_table") != key_table)
        part = part.select(
            "source_table", F.lit(key).alias("column_name"), F.lit(key_table).alias("target_table"),
            "distinct_values", "matched_values",
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no two tables share a key column")
    contained = F.col("matched_values") / F.col("distinct_values")
    return out.withColumn("containment", contained).where(F.col("containment") >= threshold)


#: Values a sketch of a column keeps, as a power of 2, and the standard errors a containment is
#: allowed to be off by.
SKETCH = 12
ERRORS = 5


def _kind(data_type: T.DataType) -> str | None:
    if isinstance(data_type, (T.IntegralType, T.DecimalType)):
        return "number"
    return "text" if isinstance(data_type, T.StringType) else None


def _value(name: str, data_type: T.DataType) -> Column:
    """A value as text that is the same in every column that can hold it."""
    c = F.col(f"`{name}`")
    return c.cast("decimal(38,6)").cast("string") if _kind(data_type) == "number" else c


def column_sketches(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, kind, sketch) of every number and text column, by one
    aggregate over each table."""
    out = None
    for name, df in tables.items():
        own = [f for f in df.schema if _kind(f.dataType)]
        if not own:
            continue
        sums = [F.theta_sketch_agg(_value(f.name, f.dataType), F.lit(SKETCH)).alias(f"s{i}") for i, f in enumerate(own)]
        rows = F.array(*[
            F.struct(F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(_kind(f.dataType)).alias("kind"), F.col(f"s{i}").alias("sketch"))
            for i, f in enumerate(own)])
        part = df.agg(*sums).select(F.inline(rows))
        out = part if out is None else out.unionByName(part)
    return out


def implied_references(tables: dict[str, DataFrame], keys: dict[str, str], threshold: float = 0.95) -> DataFrame:
    """Columns whose values are, to `threshold`, those of a key of another table, under any name.

    Each table is scanned once for sketches of its columns. A sketch is a bounded number of
    hashes, so every column meets every key by an intersection of sketches, of which there
    are as many as the dictionary has columns and keys. The pairs that come within `SLACK`
    of the threshold are then counted exactly, all pairs in one grouping by value.
    """
    spark = next(iter(tables.values())).sparkSession
    path = scratch_path(spark, "sketches")
    sketches = column_sketches(tables)
    sketches.write.parquet(path)
    every = spark.read.schema(sketches.schema).parquet(path).where("sketch IS NOT NULL")
    is_key = F.lit(False)
    for table, key in keys.items():
        is_key = is_key | ((F.col("table_name") == table) & (F.col("column_name") == key))
    of_keys = every.where(is_key).select(
        F.col("table_name").alias("target_table"), F.col("column_name").alias("target_column"), "kind", F.col("sketch").alias("key_sketch"))
    both = F.theta_sketch_estimate(F.theta_intersection("sketch", "key_sketch"))
    likely = every.join(of_keys, "kind").where("table_name <> target_table").withColumn("own", F.theta_sketch_estimate("sketch"))
    # Share of the values below the largest hash that both sketches keep.
    kept = F.least(F.lit(1.0), F.lit(float(1 << SKETCH)) / F.greatest("own", F.theta_sketch_estimate("key_sketch"), F.lit(1)))
    error = F.sqrt((1 / kept - 1) / F.greatest("own", F.lit(1)) + F.lit(1.0 / (1 << SKETCH)))
    likely = likely.where(F.col("own") > 0).where(both >= (F.lit(threshold) - ERRORS * error) * F.col("own"))
    # Names of columns and keys, as many as the dictionary has.
    pairs = [tuple(r) for r in likely.select("table_name", "column_name", "target_table", "target_column").collect()]
    if not pairs:
        return spark.createDataFrame([], "source_table string, source_column string, target_table string, target_column string, "
                                         "distinct_values bigint, matched_values bigint, containment double")
    contained = F.col("matched_values") / F.col("distinct_values")
    return _counted_pairs(tables, pairs).withColumn("containment", contained).where(F.col("containment") >= threshold)


#: Columns in a number of `_counted_pairs`.
COLUMNS = 62


def _counted_pairs(tables: dict[str, DataFrame], pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """Values of a column, and those that a key has too, for pairs (table, column, key's table,
    key). A value is marked with a bit for each column that has it, each table is read once,
    and pairs are counted from the patterns of bits, of which there are few."""
    out = None
    for kind in ("number", "text"):
        mine = [p for p in pairs if _kind(tables[p[0]].schema[p[1]].dataType) == kind]
        if not mine:
            continue
        turns = {c: n for n, c in enumerate(dict.fromkeys(c for p in mine for c in ((p[2], p[3]), (p[0], p[1]))))}
        words = [f"bits{w}" for w in range(-(-len(turns) // COLUMNS))]
        rows = None
        for table in dict.fromkeys(t for t, _ in turns):
            cells = [
                F.struct(
                    (F.col(f"`{c}`").cast("decimal(38,6)") if kind == "number" else F.col(f"`{c}`")).alias("v"),
                    *[F.lit(1 << n % COLUMNS if n // COLUMNS == w else 0).cast("bigint").alias(word) for w, word in enumerate(words)])
                for (t, c), n in turns.items() if t == table]
            part = tables[table].select(F.inline(F.array(*cells)))
            rows = part if rows is None else rows.unionByName(part)
        by_value = rows.where(F.col("v").isNotNull()).groupBy("v").agg(*[F.bit_or(w).alias(w) for w in words])
        patterns = by_value.groupBy(*words).agg(F.count("*").alias("n"))

        def has(turn):
            word, bit = F.array(*words)[F.floor(turn / COLUMNS).cast("int")], F.pmod(turn, F.lit(COLUMNS))
            return F.call_function("shiftright", word, bit).bitwiseAND(F.lit(1)) == 1

        asked = F.array(*[F.struct(
            *[F.lit(x).alias(n) for n, x in zip(("source_table", "source_column", "target_table", "target_column"), p, strict=True)],
            F.lit(turns[p[:2]]).alias("own"), F.lit(turns[p[2:]]).alias("key")) for p in mine])
        part = patterns.select("n", *words, F.inline(asked)).where(has(F.col("own"))).groupBy(
            "source_table", "source_column", "target_table", "target_column").agg(
            F.sum("n").alias("distinct_values"), F.coalesce(F.sum(F.when(has(F.col("key")), F.col("n"))), F.lit(0)).alias("matched_values"))
        out = part if out is None else out.unionByName(part)
    return out


def cast_profile(raw: DataFrame, columns: list[tuple[str, str, int | None]]) -> DataFrame:
    """Per column: rows, nulls, values lost by the staging cast, text longer than allowed.

    `columns` holds (name, source type, length); one aggregate over the table.
    """
    sums, rows = [], []
    for i, (name, source_type, length) in enumerate(columns):
        c = F.col(f"`{name}`")
        lost = c.isNotNull() & c.try_cast(spark_type(source_type)).isNull()
        too_long = F.length(c.cast("string")) > F.lit(length) if length else F.lit(False)
        sums += [
            F.count("*").alias(f"r{i}"),
            F.count_if(c.isNull()).alias(f"n{i}"),
            F.count_if(lost).alias(f"l{i}"),
            F.count_if(F.coalesce(too_long, F.lit(False))).alias(f"t{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(name.lower()).alias("column_name"), F.lit(source_type).alias("data_type"),
                F.col(f"r{i}").alias("row_count"), F.col(f"n{i}").alias("null_count"),
                F.col(f"l{i}").alias("lost_count"), F.col(f"t{i}").alias("too_long_count"),
            )
        )
    return raw.agg(*sums).select(F.inline(F.array(*rows)))


def sample_rows(table: DataFrame, key, n: int = 10) -> DataFrame:
    """The first `n` rows by key, the same ones on every run."""
    return table.orderBy(*key).limit(n)
