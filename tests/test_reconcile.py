from decimal import Decimal

import pytest

from closebook.model import Check, module_checks
from closebook.operators import reconcile


def evaluated(spark, cases):
    rows = [("GL", "x", "s", "t", Decimal(a), Decimal(b), Decimal(tol)) for a, b, tol in cases]
    return reconcile.evaluate_checks(spark.createDataFrame(rows, reconcile.CHECK_SCHEMA))


def test_variance_and_tolerance(spark):
    cases = [
        ("1000000", "1000000", "0"), ("500000", "499000", "0.01"), ("15000", "14998", "0"),
        ("1000", "990", "0.01"), ("0", "0", "0"), ("0", "100", "0"), ("10", "10.01", "0.01"),
    ]
    got = [(float(r["variance"]), r["passed"], r["variance_pct"]) for r in evaluated(spark, cases).collect()]
    assert [g[:2] for g in got] == [
        (0.0, True), (1000.0, False), (2.0, False), (10.0, False), (0.0, True), (100.0, False),
        (0.01, True),
    ]
    assert [round(g[2], 6) for g in got] == [0, 0.2, 0.013333, 1.0, 0, 100, 0.1]


def test_certificate(spark):
    good = evaluated(spark, [("1", "1", "0"), ("2", "2", "0")])
    cert = reconcile.certificate(good, "gl", "Jan-26", 2026, 1, "abc").first()
    assert cert["certificate_id"] == "CERT-GL-2026-01-abc"
    assert cert["status"] == "CERTIFIED"
    assert cert["summary"] == (
        "Certificate CERT-GL-2026-01-abc: GL Jan-26 — 2/2 checks passed — Status: CERTIFIED"
    )
    bad = evaluated(spark, [("1", "1", "0"), ("2", "3", "0")])
    cert = reconcile.certificate(bad, "GL", "Jan-26", 2026, 12, "abc").first()
    assert (cert["status"], cert["passed_checks"], cert["failed_checks"]) == ("FAILED", 1, 1)
    none = reconcile.certificate(evaluated(spark, []), "XX", "Jan-26", 2026, 1, "abc").first()
    assert (none["status"], none["total_checks"]) == ("NO_CHECKS", 0)


def test_module_plans():
    assert [len(module_checks(m)) for m in ("GL", "ap", "HCM", "XX")] == [4, 3, 1, 0]


def people(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "person_id int, last_name string")


def test_run_checks(spark):
    checks = [
        Check("HCM", "row_count", "PER_ALL_PEOPLE_F"),
        Check("HCM", "checksum", "PER_ALL_PEOPLE_F", columns=("person_id", "last_name")),
        Check("HCM", "aggregate_balance", "PER_ALL_PEOPLE_F", "PERSON_ID", tolerance="0.01"),
    ]
    source = {"PER_ALL_PEOPLE_F": people(spark, ["a", "b"])}

    def run(names):
        target = {"per_all_people_f": people(spark, names)}
        out = reconcile.evaluate_checks(reconcile.run_checks("HCM", source, target, checks))
        return {r["check_type"]: r["passed"] for r in out.collect()}

    assert run(["a", "b"]) == {"row_count": True, "checksum": True, "aggregate_balance": True}
    assert run(["a", "x"]) == {"row_count": True, "checksum": False, "aggregate_balance": True}
    assert run(["a"]) == {"row_count": False, "checksum": False, "aggregate_balance": False}
    assert run([]) == {"row_count": False, "checksum": False, "aggregate_balance": False}
    with pytest.raises(ValueError):
        reconcile.run_checks("HCM", {}, {}, checks, spark=spark)
    assert reconcile.run_checks("XX", source, {}).count() == 0


def test_row_differences(spark):
    schema = "id int, a string, b int"
    source = spark.createDataFrame(
        [(1, "x", 1), (2, "x", None), (3, "x", 1), (4, None, 1), (6, "p", 1), (6, "q", 1), (7, "p", 1), (7, "p", 1), (None, "n", 1)],
        schema,
    )
    target = spark.createDataFrame(
        [(1, "x", 1), (2, "y", 5), (4, None, 1), (5, "x", 1), (6, "q", 1), (6, "p", 1), (7, "p", 1), (7, "q", 1), (None, "n", 2)],
        schema,
    )
    got = {
        r["id"]: (r["status"], r["changed_columns"], r["source_rows"], r["target_rows"])
        for r in reconcile.row_differences(source, target, ["id"], ["a", "b"]).collect()
    }
    assert got == {
        2: ("changed", "a,b", 1, 1), 3: ("missing", "", 1, 0), 5: ("extra", "", 0, 1),
        7: ("repeated", "", 2, 2), None: ("changed", "b", 1, 1),
    }
    rest = reconcile.multiset_differences(source, target, ["id", "a", "b"])
    assert sorted((r["id"] or 0, r["source_rows"], r["target_rows"]) for r in rest.collect()) == [
        (0, 0, 1), (0, 1, 0), (2, 0, 1), (2, 1, 0), (3, 1, 0), (5, 0, 1), (7, 0, 1), (7, 2, 1),
    ]


def test_multiset_counts_copies(spark):
    source = spark.createDataFrame([("a",)] * 5 + [("b",)], "v string")
    target = spark.createDataFrame([("a",)] * 3 + [("b",)], "v string")
    got = [tuple(r) for r in reconcile.multiset_differences(source, target, ["v"]).collect()]
    assert got == [("a", 5, 3)]


def test_group_on_one_side_only(spark):
    source = spark.createDataFrame([(1, Decimal(5))], "g int, v decimal(9,2)")
    target = spark.createDataFrame([(2, Decimal(5)), (2, None)], "g int, v decimal(9,2)")
    got = {
        r["g"]: (r["s_count"], r["t_count"], float(r["s_v"]), float(r["t_v"]), r["passed"])
        for r in reconcile.compare_groups(source, target, ["g"], sums=["v"]).collect()
    }
    assert got == {1: (1, 0, 5.0, 0.0, False), 2: (0, 2, 0.0, 5.0, False)}


def test_run_summary(spark):
    schema = "module string, rows_extracted long, rows_loaded long, reconciliation_passed boolean"
    runs = spark.createDataFrame([("GL", 10, 10, True), ("AP", 5, 4, False)], schema)
    assert tuple(reconcile.run_summary(runs).first()) == (2, 15, 14, 50.0)
    assert tuple(reconcile.run_summary(runs.limit(0)).first()) == (0, 0, 0, 0.0)
