from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from closebook.model import Rule, default_rules
from closebook.operators import catalog, quality


def rule(rule_type, column="A", table="T", severity="ERROR", **more):
    return Rule("r", "The Rule", "GL", severity, rule_type, table, column, **more)


def check(spark, r, data, schema, reference=None):
    df = spark.createDataFrame(data, schema)
    out = quality.evaluate_rules("GL", df, [r], reference).collect()
    assert len(out) == 1
    return out[0]["violations_count"], out[0]["message"]


@pytest.mark.parametrize(
    "values, bad", [(["x", "y"], 0), (["x", None, "z"], 1), (["  "], 1), (["\t", "a"], 1), ([], 0)]
)
def test_not_null(spark, values, bad):
    count, message = check(spark, rule("not_null"), [(v,) for v in values], "A string")
    assert (count, message) == (bad, f"{bad} row(s) violate The Rule" if bad else "")


def test_absent_column_is_null(spark):
    assert check(spark, rule("not_null", "NOT_THERE"), [(1,), (2,)], "A int")[0] == 2


def test_any_and_all(spark):
    both = {"columns": ("A", "B")}
    data = [(1, None), (None, 2), (None, None), (3, 4)]
    assert check(spark, rule("any_not_null", **both), data, "A int, B int")[0] == 1
    assert check(spark, rule("all_not_null", **both), data, "A int, B int")[0] == 3


@pytest.mark.parametrize(
    "values, schema, bad",
    [
        ([500, 0, 1000], "A int", 0), ([-1], "A int", 1), ([1001], "A int", 1), ([None], "A int", 0),
        (["12.5", "abc", "", None, "1e2", "NaN", "1001"], "A string", 4),
        ([0.5, float("nan")], "A double", 1),
        ([True], "A boolean", 1),
        ([Decimal("1000.01"), Decimal("-0.01"), Decimal("0")], "A decimal(18,2)", 2),
    ],
)
def test_range(spark, values, schema, bad):
    r = rule("range", min_value="0", max_value="1000")
    assert check(spark, r, [(v,) for v in values], schema)[0] == bad


@pytest.mark.parametrize(
    "values, bad",
    [(["1", "2", "3"], 0), (["1", "2", "1"], 1), ([None, None], 0), (["1"] * 4 + ["2"] * 2, 4)],
)
def test_uniqueness(spark, values, bad):
    count, message = check(spark, rule("uniqueness"), [(v,) for v in values], "A string")
    assert (count, message) == (bad, f"{bad} duplicate(s) found for A" if bad else "")


def test_referential(spark):
    data = [(1,), (99,), (99,), (None,)]
    reference = spark.createDataFrame([(1,), (2,), (2,), (None,)], "B int")
    r = rule("referential", reference_table="REF", reference_column="B")
    assert check(spark, r, data, "A int", {"REF": reference}) == (2, "2 orphan(s) for A")
    assert check(spark, r, data, "A int")[0] == 3
    own = spark.createDataFrame([(99,)], "a int")
    r = rule("referential", reference_table="REF")
    assert check(spark, r, data, "A int", {"ref": own})[0] == 1


def test_balance(spark):
    r = rule("balance", None, columns=("DR", "CR"))
    schema = "DR decimal(18,0), CR decimal(18,0)"
    d = Decimal
    assert check(spark, r, [(d(100), None), (None, d(100))], schema) == (0, "")
    assert check(spark, r, [], schema) == (0, "")
    off = [(d(5000), None), (d(3000), None), (None, d(7000))]
    assert check(spark, r, off, schema) == (1, "Imbalance: DR=8000 CR=7000 diff=1000")
    assert check(spark, r, [("1.5", "x"), ("0.5", "2")], "DR string, CR string")[0] == 0


def test_custom_sql(spark):
    r = rule("custom_sql", None, expression="A < B")
    assert check(spark, r, [(1, 2), (2, 1), (None, 1)], "A int, B int")[0] == 1


def test_default_rules():
    assert [len(default_rules(m)) for m in ("gl", "AP", "hcm", "ALL", "XX")] == [3, 3, 3, 9, 0]


def test_module_report_on_one_frame(spark):
    schema = "ACCOUNTED_DR decimal(9,2), ACCOUNTED_CR decimal(9,2), PERIOD_NAME string"
    good = [(Decimal(100), None, "Jan-26"), (None, Decimal(100), "Jan-26")]
    summary = quality.summarize(quality.evaluate_rules("GL", spark.createDataFrame(good, schema)))
    row = summary.first()
    assert tuple(row) == (3, 3, 0, 0, 1.0, False)
    bad = [(Decimal(100), None, "Jan-26"), (None, Decimal(50), None)]
    row = quality.summarize(quality.evaluate_rules("GL", spark.createDataFrame(bad, schema))).first()
    assert (row["rules_passed"], row["rules_failed"], row["has_errors"]) == (1, 2, True)
    assert row["pass_rate"] == pytest.approx(1 / 3)


def test_warnings_are_not_errors(spark):
    df = spark.createDataFrame([(None,)], "A int")
    for severity in ("WARNING", "INFO"):
        row = quality.summarize(
            quality.evaluate_rules("GL", df, [rule("not_null", severity=severity)])
        ).first()
        assert (row["rules_failed"], row["rules_warned"], row["has_errors"]) == (0, 1, False)


def test_unknown_types_are_not_counted(spark):
    df = spark.createDataFrame([(1,)], "A int")
    out = quality.evaluate_rules("GL", df, [rule("regex"), rule("not_null")])
    assert out.count() == 1
    none = quality.evaluate_rules("XX", df)
    assert none.count() == 0
    assert tuple(quality.summarize(none).first()) == (0, 0, 0, 0, 0.0, False)


def test_rules_go_to_their_table(spark):
    a, b = spark.createDataFrame([(None,)], "A int"), spark.createDataFrame([(1,)], "A int")
    rules = [rule("not_null", table="ONE"), rule("not_null", table="TWO")]
    got = quality.evaluate_rules("GL", {"one": a, "two": b}, rules).collect()
    assert {r["table_name"]: r["passed"] for r in got} == {"ONE": False, "TWO": True}
    with pytest.raises(ValueError):
        quality.evaluate_rules("GL", {"one": a}, rules)


def test_violating_rows_and_samples(spark):
    df = spark.createDataFrame(
        [(i, "same" if i % 2 else f"v{i}") for i in range(60)] + [(60, None)], "id int, A string"
    )
    r = rule("uniqueness")
    repeats = quality.violations(r, df, ["id"])
    assert sorted(x["id"] for x in repeats.collect()) == list(range(3, 60, 2))
    sample = quality.sample_violations(r, df, ["id"]).collect()
    assert [x["id"] for x in sample] == list(range(3, 23, 2))
    assert sample[0]["row"] == '{"id":3,"A":"same"}'
    reference = spark.createDataFrame([("same",)], "A string")
    orphans = quality.violations(rule("referential"), df, ["id"], reference)
    assert orphans.count() == 30
    assert quality.violations(rule("not_null"), df).count() == 1
    with pytest.raises(ValueError):
        quality.violations(rule("balance"), df)


def test_key_rules_from_the_dictionary(spark):
    constraints = spark.createDataFrame([("O", "PK", "P"), ("O", "NN", "C")], "owner string, constraint_name string, constraint_type string")
    columns = spark.createDataFrame(
        [("O", "PK", "GL_T", "ID", 1), ("O", "NN", "GL_T", "X", 1), ("Q", "PK", "GL_T", "Y", 2)],
        "owner string, constraint_name string, table_name string, column_name string, position int")
    got = [(r.rule_id, r.rule_type, r.module) for r in quality.key_rules(catalog.primary_keys(constraints, columns))]
    assert got == [("unique_gl_t_id", "uniqueness", "GL"), ("not_null_gl_t_id", "not_null", "GL")]


def test_bounds_are_exact(spark):
    cases = {"-0.0000000001": False, "0": True, "1e30": False, "400000": True, "400000.00000000000001": False, "-1e-30": False,
             "1e5": True, "n/a": False, "": False, " 7 ": True, "NaN": False, "12345678901234567890123": False}
    df = spark.createDataFrame(list(cases.items()), "v string, ok boolean")
    rule = Rule("r", "R", "AP", "ERROR", "range", "T", "V", min_value="0", max_value="400000")
    assert df.where(quality.violates(rule, df) == F.col("ok")).collect() == []
    least = Rule("r", "R", "AP", "ERROR", "range", "T", "V", min_value="0")
    large = spark.createDataFrame([(1e30,), (-1e-300,), (float("nan"),)], "v double")
    assert [r[0] for r in large.select(quality.violates(least, large)).collect()] == [False, True, True]


def test_white_space_of_unicode_is_blank(spark):
    df = spark.createDataFrame([("\u00a0",), ("\u2003 \u3000",), ("x\u00a0",), ("",), (None,)], "v string")
    rule = Rule("r", "R", "AP", "ERROR", "not_null", "T", "V")
    assert [r[0] for r in df.select(quality.violates(rule, df)).collect()] == [True, True, False, True, True]


def test_a_key_of_several_columns_is_one_rule(spark):
    keys = spark.createDataFrame(
        [("A", "GL_T", "H", 1), ("A", "GL_T", "N", 2), ("A", "AP_X", "ID", 1), ("B", "AP_X", "ID", 1)],
        "owner string, table_name string, column_name string, position int")
    rules = {r.rule_id: r for r in quality.key_rules(keys)}
    assert set(rules) == {
        "unique_gl_t_h_n", "not_null_gl_t_h", "not_null_gl_t_n", "unique_a.ap_x_id", "not_null_a.ap_x_id", "unique_b.ap_x_id", "not_null_b.ap_x_id"}
    assert rules["unique_b.ap_x_id"].table_name == "B.AP_X"
    own = [r for r in rules.values() if r.table_name == "GL_T"]
    good = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "h int, n int")
    assert all(r["passed"] for r in quality.evaluate_rules("GL", good, own).collect())
    bad = good.union(spark.createDataFrame([(1, 2), (None, 1), (None, 1)], "h int, n int"))
    got = {r["rule_id"]: r["violations_count"] for r in quality.evaluate_rules("GL", bad, own).collect()}
    assert got == {"unique_gl_t_h_n": 1, "not_null_gl_t_h": 2, "not_null_gl_t_n": 0}
    rows = bad.withColumn("k", bad.h * 0 + 1)
    assert quality.violations(rules["unique_gl_t_h_n"], bad.withColumn("k", F.monotonically_increasing_id()), ["k"]).count() == 1 and rows.count() == 6


def test_bounds_of_any_length_are_exact(spark):
    big = 10**25
    cases = [(str(big), True), (str(big + 1), False), (str(big - 1), True), (f"{big}.{'0' * 40}1", False), ("1e25", True), ("1.0000000000000000000000000000001e25", False),
             (f"-{big}", True), (f"-{big + 1}", False), (f"-{big}.5", False), ("0", True), ("-0.0", True), ("1e26", False), ("-1e-400", True), ("9" * 26, False), (f" {big} ", True),
             ("0" * 50 + "7", True), ("x", False), (None, True)]
    rule = Rule("r", "R", "AP", "ERROR", "range", "T", "V", min_value=str(-big), max_value=f"{big}")
    df = spark.createDataFrame(cases, "v string, ok boolean")
    assert df.where(quality.violates(rule, df) == F.col("ok")).collect() == []
    decimals = spark.createDataFrame([(Decimal(big + 1),), (Decimal(big),)], "v decimal(38,0)")
    assert [r[0] for r in decimals.select(quality.violates(rule, decimals)).collect()] == [True, False]
    doubles = spark.createDataFrame([(1e25,), (1.0000000000000002e25,), (float("inf"),), (float("-inf"),), (5.0,)], "v double")
    assert [r[0] for r in doubles.select(quality.violates(rule, doubles)).collect()] == [False, True, True, True, False]


def test_bounds_name_a_value_once(spark):
    """Digits are taken once a value: named again and again they grew past what can be compiled."""
    df = spark.createDataFrame([("1e30",), ("5",), (None,)], "v string")
    rule = Rule("r", "R", "AP", "ERROR", "range", "T", "V", min_value="-1e25", max_value="1e25")
    bad = quality.violates(rule, df).alias("bad")
    assert [r[0] for r in df.select(bad).collect()] == [True, False, False]
    # Four of them are the parts of a number.
    plan = df.select(bad)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 4
