"""Data-quality rules over DataFrames.

All row rules and balances of one table are sums in one aggregate, so a table
is scanned once for them. Uniqueness and referential rules group by their
column first: each value then counts once in the shuffle, however many rows
hold it.
"""

from __future__ import annotations

from decimal import Context, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from closebook.functions.scalars import AMOUNT, is_blank
from closebook.functions.skew import checked_join
from closebook.model import Rule, default_rules
from closebook.operators.catalog import module_of

ROW_RULES = ("not_null", "any_not_null", "all_not_null", "range", "custom_sql")
RULE_TYPES = (*ROW_RULES, "balance", "uniqueness", "referential")
SAMPLES = 10

RESULT_SCHEMA = (
    "rule_id string, rule_name string, module string, severity string, rule_type string, "
    "table_name string, column_name string, passed boolean, violations_count bigint, "
    "message string"
)


def _column(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    """Column by name in any case; an absent one is null."""
    for field in df.schema:
        if field.name.lower() == name.lower():
            return F.col(f"`{field.name}`"), field.dataType
    return F.lit(None).cast("string"), T.StringType()


def violates(rule: Rule, df: DataFrame) -> Column:
    """True for rows that break a row rule, never null."""
    if rule.rule_type == "not_null":
        return is_blank(*_column(df, rule.column_name))
    if rule.rule_type == "any_not_null":
        return F.coalesce(*[_column(df, c)[0].cast("string") for c in rule.columns]).isNull()
    if rule.rule_type == "all_not_null":
        return reduce(Column.__or__, [_column(df, c)[0].isNull() for c in rule.columns])
    if rule.rule_type == "range":
        raw, data_type = _column(df, rule.column_name)
        return raw.isNotNull() & ~_within(raw, data_type, rule.min_value, rule.max_value)
    if rule.rule_type == "custom_sql":
        return F.coalesce(~F.expr(rule.expression), F.lit(False))
    raise ValueError(f"{rule.rule_type} is not a row rule")


_PRECISE = Context(prec=400)
# Digits before and after the point that the exact comparison looks at.
_WHOLE, _FRACTION = 19, 19
_NUMBER = r"^\s*([+-]?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]{1,4}))?\s*$"


def _once(value: Column, then) -> Column:
    """`then` of a value that is computed once a row, however often `then` names it."""
    return F.transform(F.array(value), then)[0]


def _digits(text: Column) -> Column:
    """A number's text as (sign, length of the whole part, whole part, places), without zeros
    that change nothing; structs of one sign order as the numbers' sizes do."""
    zeros = F.lit("0")

    def pointed(parts):
        shift = F.coalesce(parts["power"].try_cast("int"), F.lit(0))
        return F.struct(
            parts["sign"].alias("sign"), F.concat(parts["whole"], parts["places"]).alias("digits"),
            (F.length(parts["whole"]) + shift).alias("point"))

    def split(number):
        digits, point = number["digits"], number["point"]
        before = (
            F.when(point <= 0, F.lit("")).when(point >= F.length(digits), F.concat(digits, F.repeat(zeros, point - F.length(digits))))
            .otherwise(F.substring(digits, F.lit(1), point))
        )
        after = (
            F.when(point <= 0, F.concat(F.repeat(zeros, -point), digits)).when(point >= F.length(digits), F.lit(""))
            .otherwise(F.substring(digits, point + 1, F.length(digits)))
        )
        return F.struct(
            number["sign"].alias("sign"), F.regexp_replace(before, "^0+", "").alias("whole"), F.regexp_replace(after, "0+$", "").alias("places"))

    def ordered(number):
        whole, places = number["whole"], number["places"]
        return F.struct(
            F.when((whole == "") & (places == ""), 0).when(number["sign"] == "-", -1).otherwise(1).alias("sign"),
            F.struct(F.length(whole).alias("size"), whole.alias("whole"), places.alias("places")).alias("amount"),
        )

    names = ("sign", "whole", "places", "power")
    parts = F.struct(*[F.regexp_extract(text, _NUMBER, i).alias(n) for i, n in enumerate(names, 1)])
    return _once(_once(_once(parts, pointed), split), ordered)


def _bound_digits(bound: str) -> tuple[int, Column]:
    """What `_digits` gives for a bound: its sign and its amount."""
    number = Decimal(bound)
    whole, _, places = f"{number.copy_abs():f}".partition(".")
    whole, places = whole.lstrip("0"), places.rstrip("0")
    sign = 0 if not whole and not places else -1 if number.is_signed() else 1
    return sign, F.struct(F.lit(len(whole)).alias("size"), F.lit(whole).alias("whole"), F.lit(places).alias("places"))


def _order(value: Column, bound: str) -> Column:
    """-1, 0 or 1: the digits of a number below, equal to or above the bound."""
    sign, limit = _bound_digits(bound)
    by_amount = F.when(value["amount"] < limit, -1).when(value["amount"] > limit, 1).otherwise(0)
    return (
        F.when(value["sign"] < sign, -1).when(value["sign"] > sign, 1)
        .otherwise(value["sign"] * by_amount)
    )


def _within(raw: Column, data_type: T.DataType, least: str | None, most: str | None) -> Column:
    """Is a value a number from `least` to `most`, without rounding it; false for other text.

    A value that decimal(38,19) holds exactly is compared as that. Others are larger than
    it holds, or have more places: their digits are compared as text, whatever their number.
    """
    exact_type = f"decimal({_WHOLE + _FRACTION},{_FRACTION})"
    text = raw.cast("string")
    if isinstance(data_type, (T.DecimalType, T.IntegralType)):
        is_number, rounded, double = F.lit(True), raw.try_cast(exact_type), raw.cast("double")
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        is_number, rounded, double = ~F.isnan(raw), raw.try_cast(exact_type), raw.cast("double")
    else:
        is_number, rounded, double = (
            text.rlike(_NUMBER) & text.rlike("[0-9]"), text.try_cast(exact_type), text.try_cast("double"))
    # What the rounding has changed: compared as text digits it is the sign of value - rounded.
    lost = (double != rounded.cast("double")) | rounded.isNull()
    bounds = [(bound, above) for bound, above in ((least, True), (most, False)) if bound is not None]

    def between(side) -> Column:
        return reduce(Column.__and__, [side(bound, above) for bound, above in bounds], F.lit(True))

    def by_decimal(bound, above):
        limit = F.lit(bound).try_cast(exact_type)
        return rounded >= limit if above else rounded <= limit

    def by_double(bound, above):
        limit = F.lit(bound).cast("double")
        return double >= limit if above else double <= limit

    def by_digits(value):
        return between(lambda bound, above: _order(value, bound) >= 0 if above else _order(value, bound) <= 0)

    # Only a double has text that is no digits: an infinite one.
    wide = F.when(text.rlike(_NUMBER), _once(_digits(text), by_digits)).otherwise(between(by_double))
    exact = all(
        Decimal(bound) == Decimal(bound).quantize(Decimal(1).scaleb(-_FRACTION), context=_PRECISE) and abs(Decimal(bound)) < 10**_WHOLE
        for bound, _ in bounds)
    inside = F.when(lost, wide).otherwise(between(by_decimal)) if exact else wide
    return is_number & F.coalesce(inside, F.lit(False))


def _result(rule: Rule, count: Column, message: Column) -> Column:
    passed = count == 0
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.rule_name).alias("rule_name"),
        F.lit(rule.module).alias("module"),
        F.lit(rule.severity).alias("severity"),
        F.lit(rule.rule_type).alias("rule_type"),
        F.lit(rule.table_name).alias("table_name"),
        F.lit(rule.column_name).cast("string").alias("column_name"),
        passed.alias("passed"),
        count.cast("bigint").alias("violations_count"),
        F.when(passed, F.lit("")).otherwise(message).alias("message"),
    )


def _total(df: DataFrame, name: str) -> Column:
    column, data_type = _column(df, name)
    amount = column if isinstance(data_type, T.DecimalType) else column.try_cast(AMOUNT)
    total = F.sum(amount)
    return F.coalesce(total, F.lit(0).cast("decimal(1,0)"))


def _scan_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Row rules and balances of one table in one aggregate."""
    sums, results = [], []
    for i, rule in enumerate(rules):
        if rule.rule_type == "balance":
            debit, credit = rule.columns
            sums += [_total(df, debit).alias(f"dr{i}"), _total(df, credit).alias(f"cr{i}")]
            dr, cr = F.col(f"dr{i}"), F.col(f"cr{i}")
            message = F.concat(
                F.lit("Imbalance: DR="), dr.cast("string"), F.lit(" CR="), cr.cast("string"),
                F.lit(" diff="), (dr - cr).cast("string"),
            )
            results.append(_result(rule, F.when(dr == cr, 0).otherwise(1), message))
        else:
            sums.append(F.count_if(violates(rule, df)).alias(f"v{i}"))
            count = F.col(f"v{i}")
            message = F.concat(
                count.cast("string"), F.lit(f" row(s) violate {rule.rule_name}")
            )
            results.append(_result(rule, count, message))
    return df.agg(*sums).select(F.inline(F.array(*results)))


def _counted(rule: Rule, counts: DataFrame, noun: str) -> DataFrame:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    message = F.concat(F.col("n").cast("string"), F.lit(f" {noun} for {rule.column_name}"))
    return total.select(F.inline(F.array(_result(rule, F.col("n"), message))))


def _value_counts(df: DataFrame, name: str) -> DataFrame:
    value, _ = _column(df, name)
    return (
        df.select(value.alias("value")).where(F.col("value").isNotNull())
        .groupBy("value").agg(F.count("*").alias("n"))
    )


def _uniqueness(df: DataFrame, rule: Rule) -> DataFrame:
    """Of a rule over several columns rows with a null in any do not count."""
    if rule.columns:
        parts = [_column(df, c)[0].alias(f"v{i}") for i, c in enumerate(rule.columns)]
        names = [f"v{i}" for i in range(len(parts))]
        counts = df.select(*parts).dropna().groupBy(*names).agg(F.count("*").alias("n"))
    else:
        counts = _value_counts(df, rule.column_name)
    repeats = counts.select((F.col("n") - 1).alias("n"))
    return _counted(rule, repeats, "duplicate(s) found")


def _referential(df: DataFrame, rule: Rule, reference: DataFrame | None) -> DataFrame:
    counts = _value_counts(df, rule.column_name)
    if reference is not None:
        known, _ = _column(reference, rule.reference_column or rule.column_name)
        counts = counts.join(reference.select(known.alias("value")), "value", "left_anti")
    return _counted(rule, counts, "orphan(s)")


def _tables(data, rules) -> list[tuple[DataFrame, list[Rule]]]:
    """Rules with the DataFrame they run on: by table, or all on the one given."""
    if isinstance(data, DataFrame):
        return [(data, rules)]
    by_name = {name.upper(): df for name, df in data.items()}
    grouped: dict[str, list[Rule]] = {}
    for rule in rules:
        grouped.setdefault(rule.table_name.upper(), []).append(rule)
    missing = sorted(set(grouped) - set(by_name))
    if missing:
        raise ValueError(f"no data for {', '.join(missing)}")
    return [(by_name[name], group) for name, group in grouped.items()]


def evaluate_rules(module, data, rules=None, reference_data=None, spark=None) -> DataFrame:
    """One result row per rule.

    `data` is a DataFrame all rules run on, or a dict of table name to
    DataFrame; `reference_data` maps reference tables to DataFrames, an absent
    one makes every value an orphan. Rules of unknown type are left out.
    """
    rules = default_rules(module) if rules is None else list(rules)
    rules = [r for r in rules if r.rule_type in RULE_TYPES]
    reference = {k.upper(): v for k, v in (reference_data or {}).items()}
    parts = []
    for df, group in _tables(data, rules):
        scanned = [r for r in group if r.rule_type in (*ROW_RULES, "balance")]
        if scanned:
            parts.append(_scan_rules(df, scanned))
        for rule in group:
            if rule.rule_type == "uniqueness":
                parts.append(_uniqueness(df, rule))
            elif rule.rule_type == "referential":
                parts.append(
                    _referential(df, rule, reference.get((rule.reference_table or "").upper()))
                )
    if not parts:
        frame = data if isinstance(data, DataFrame) else next(iter(data.values()), None)
        session = spark or frame.sparkSession
        return session.createDataFrame([], RESULT_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def summarize(results: DataFrame, by=()) -> DataFrame:
    """Rules run, passed, failed (ERROR) and warned (WARNING, INFO), and the pass rate."""
    failed = ~F.col("passed")
    evaluated = F.count("*")
    return results.groupBy(*by).agg(
        evaluated.alias("rules_evaluated"),
        F.count_if("passed").alias("rules_passed"),
        F.count_if(failed & (F.col("severity") == "ERROR")).alias("rules_failed"),
        F.count_if(failed & F.col("severity").isin("WARNING", "INFO")).alias("rules_warned"),
        F.when(evaluated == 0, F.lit(0.0))
        .otherwise(F.count_if("passed") / F.greatest(evaluated, F.lit(1)))
        .alias("pass_rate"),
        F.coalesce(F.bool_or(failed & (F.col("severity") == "ERROR")), F.lit(False))
        .alias("has_errors"),
    )


def violations(rule: Rule, df: DataFrame, key=(), reference: DataFrame | None = None) -> DataFrame:
    """The rows that break a rule.

    For uniqueness that is every row but the first of its value, by `key`.
    """
    if rule.rule_type in ROW_RULES:
        return df.where(violates(rule, df))
    named = {f.name.lower(): f.name for f in df.schema}
    if rule.rule_type == "uniqueness":
        own = [named[c.lower()] for c in rule.columns or (rule.column_name,)]
        first = df.dropna(subset=own).groupBy(*own).agg(
            F.min(F.struct(*key)).alias("__first"), F.count("*").alias("__n")
        )
        repeated = checked_join(df, first.where("__n > 1"), own)
        return repeated.where(F.struct(*key) != F.col("__first")).select(*df.columns)
    if rule.rule_type == "referential":
        column = named[rule.column_name.lower()]
        rows = df.where(F.col(column).isNotNull())
        if reference is None:
            return rows
        known, _ = _column(reference, rule.reference_column or rule.column_name)
        return checked_join(
            rows, reference.select(known.alias(column)).distinct(), column, "left_anti"
        )
    raise ValueError(f"{rule.rule_type} has no violating rows")


def sample_violations(rule, df, key, reference=None, limit=SAMPLES) -> DataFrame:
    """The first violating rows by key, as JSON text."""
    bad = violations(rule, df, key, reference).orderBy(*key).limit(limit)
    return bad.select(
        F.lit(rule.rule_id).alias("rule_id"),
        *key,
        F.to_json(F.struct(*[c for c in df.columns])).alias("row"),
    )


def with_samples(results, data, rules, keys, reference_data=None, limit=SAMPLES) -> DataFrame:
    """Result rows with `samples`: the first violating rows of each rule, as JSON texts.

    `keys` maps a table to the columns its rows are ordered by. Rules over a whole table
    (balance) have none.
    """
    reference = {k.upper(): v for k, v in (reference_data or {}).items()}
    parts = []
    for df, group in _tables(data, list(rules)):
        for rule in group:
            if rule.rule_type in (*ROW_RULES, "uniqueness", "referential"):
                key = keys[rule.table_name]
                found = sample_violations(
                    rule, df, key, reference.get((rule.reference_table or "").upper()), limit)
                parts.append(found.select("rule_id", F.struct(*key).alias("key"), "row")
                             .select("rule_id", "row", F.row_number().over(Window.partitionBy("rule_id").orderBy("key")).alias("n")))
    none = F.array().cast("array<string>")
    if not parts:
        return results.withColumn("samples", none)
    # At most `limit` rows of each rule.
    listed = reduce(DataFrame.unionByName, parts).groupBy("rule_id").agg(
        F.sort_array(F.collect_list(F.struct("n", "row")))["row"].alias("samples"))
    return results.join(listed, "rule_id", "left").withColumn("samples", F.coalesce("samples", none))


def key_rules(keys: DataFrame) -> list[Rule]:
    """A unique rule for the key of each table of the dictionary, over all its columns, and a
    not-null rule for each of them.

    `keys` is what `catalog.primary_keys` gives, of the tables that rules are wanted for.
    Tables of one name under several owners are named `OWNER.TABLE`.
    """
    rows = keys.select("owner", "table_name", "column_name", "position", module_of().alias("module")).distinct()
    tables: dict[tuple[str, str], list] = {}
    for r in rows.orderBy("table_name", "owner", "position").collect():
        tables.setdefault((r["table_name"], r["owner"]), []).append(r)
    owners: dict[str, int] = {}
    for table, _ in tables:
        owners[table] = owners.get(table, 0) + 1
    rules = []
    for (table, owner), columns in tables.items():
        name = f"{owner}.{table}" if owners[table] > 1 else table
        module, own = columns[0]["module"], [r["column_name"] for r in columns]

        def rule(kind, rule_type, columns, name=name, module=module):
            text = ",".join(columns)
            return Rule(
                f"{kind}_{name}_{'_'.join(columns)}".lower(), f"{name}.{text} {kind}", module, "ERROR", rule_type, name, text,
                tuple(columns) if len(columns) > 1 else (),
            )

        rules.append(rule("unique", "uniqueness", own))
        rules += [rule("not_null", "not_null", [c]) for c in own]
    return rules
