import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from closebook.operators import finance
from closebook.sources.fixtures import Tables

NOW = dt.datetime(2026, 3, 8, 12)


def invoices(spark, items):
    """Items are (age in days, amount, paid, flag)."""
    return spark.createDataFrame(
        [
            (i, f"INV-{i}", 1, NOW - dt.timedelta(days=age), Decimal(amount), Decimal(paid), "USD", flag)
            for i, (age, amount, paid, flag) in enumerate(items)
        ],
        "invoice_id int, invoice_num string, vendor_id int, invoice_date timestamp_ntz, "
        "invoice_amount decimal(18,2), amount_paid decimal(18,2), invoice_currency_code string, "
        "payment_status_flag string",
    )


def buckets(df, by=()):
    rows = finance.aging(df, str(NOW), by).collect()
    return {r["bucket"]: float(r["amount"]) for r in rows}


def test_aging(spark):
    df = invoices(
        spark,
        [(10, 45000, 0, "N"), (5, 12500, 12500, "Y"), (45, 87000, 50000, "P"), (75, 23000, 0, "N"),
         (120, 9500, 0, "N")],
    )
    assert buckets(df) == {
        "0-30 days": 45000, "31-60 days": 37000, "61-90 days": 23000, "91+ days": 9500
    }


def test_aging_edges(spark):
    df = invoices(spark, [(30, 1, 0, "N"), (31, 2, 0, "N"), (60, 4, 0, "N"), (61, 8, 0, "N"),
                          (90, 16, 0, "N"), (91, 32, 0, "N"), (-5, 64, 0, "P"), (1, 128, 0, "Y")])
    assert list(buckets(df).values()) == [65, 6, 24, 32]


def test_aging_keeps_all_buckets(spark):
    empty = invoices(spark, [(1, 1, 0, "Y")])
    assert buckets(empty) == {
        "0-30 days": 0, "31-60 days": 0, "61-90 days": 0, "91+ days": 0
    }


HEADERS = "je_header_id int, status string, period_name string, ledger_id int"
LINES = ("je_header_id int, je_line_num int, code_combination_id int, currency_code string, "
         "accounted_dr decimal(18,2), accounted_cr decimal(18,2)")


@pytest.fixture
def books(spark):
    d = Decimal
    headers = spark.createDataFrame(
        [(1, "P", "Jan-26", 1), (2, "POSTED", "Jan-26", 1), (3, "U", "Jan-26", 1), (4, "P", None, 1)],
        HEADERS,
    )
    lines = spark.createDataFrame(
        [(1, 1, 10, "USD", d(100), None), (1, 2, 11, "USD", None, d(100)), (2, 1, 10, "USD", d(50), None),
         (2, 2, 11, "USD", None, d(0)), (3, 1, 10, "USD", d(999), None), (4, 1, 10, "USD", d(999), None)],
        LINES,
    )
    return headers, lines


def test_period_totals(books):
    rows = finance.period_totals(*books).collect()
    assert [(r["ledger_id"], r["period_name"], float(r["net"]), r["line_count"]) for r in rows] == [
        (1, "Jan-26", 50.0, 4), (1, None, 999.0, 1)
    ]


def test_no_posted_line_is_lost(spark, folder):
    t = Tables(spark, folder)
    headers, lines = t["fx_gl_je_headers"], t["fx_gl_je_lines"]
    posted = lines.join(headers.where("status IN ('P', 'POSTED')"), "je_header_id", "left_semi")
    want = posted.agg(F.count("*"), F.sum("accounted_dr"), F.sum("accounted_cr")).first()
    got = finance.period_totals(headers, lines).agg(F.sum("line_count"), F.sum("total_dr"), F.sum("total_cr")).first()
    assert tuple(got) == tuple(want)
    close = finance.period_close(headers, lines, t["fx_gl_balances_close"])
    assert close.agg(F.sum("line_count")).first()[0] == want[0]


def test_vendor_with_equal_amounts_has_no_outliers(spark):
    rows = [(i, 1, Decimal("0.10")) for i in range(30)] + [(100 + i, 2, Decimal("5")) for i in range(20)] + [(200, 2, Decimal("500")), (201, 3, Decimal("9"))]
    df = spark.createDataFrame(rows, "invoice_id int, vendor_id int, invoice_amount decimal(18,2)")
    assert [r["invoice_id"] for r in finance.outlier_invoices(df).collect()] == [200]


def test_three_decimals_and_periods_with_balances_only(spark):
    headers = spark.createDataFrame([(1, 1, "Jan-26", "P")], "je_header_id int, ledger_id int, period_name string, status string")
    lines = spark.createDataFrame(
        [(1, 10, "KWD", Decimal("1.000"), Decimal("1.000"))],
        "je_header_id int, code_combination_id int, currency_code string, accounted_dr decimal(18,3), accounted_cr decimal(18,3)")
    balance = spark.createDataFrame(
        [(1, 10, "KWD", "Jan-26", Decimal("5.000"), None, Decimal("5.008")), (1, 10, "KWD", "Adj-26", Decimal("2"), None, Decimal("3")),
         (1, 10, "KWD", "Adj-26", Decimal("2"), None, Decimal("2"))],
        "ledger_id int, code_combination_id int, currency_code string, period_name string, "
        "begin_balance_dr decimal(18,3), begin_balance_cr decimal(18,3), reported_end_balance decimal(18,3)")
    proofs = finance.balance_proof(balance, headers, lines).collect()
    assert sorted((r["period_name"], r["proved"], str(r["difference"])) for r in proofs) == [
        ("Adj-26", False, "-1.000"), ("Adj-26", True, "0.000"), ("Jan-26", True, "-0.008")]
    close = {r["period_name"]: tuple(r)[3:] for r in finance.period_close(headers, lines, balance).collect()}
    assert close == {"Jan-26": (1, 1, 0, True), "Adj-26": (0, 2, 1, False)}


def balances(spark, items):
    return spark.createDataFrame(
        [(1, account, "USD", "Jan-26", Decimal(begin), None, Decimal(end)) for account, begin, end in items],
        "ledger_id int, code_combination_id int, currency_code string, period_name string, "
        "begin_balance_dr decimal(18,2), begin_balance_cr decimal(18,2), reported_end_balance decimal(18,2)",
    )


def test_balance_proof(spark, books):
    df = balances(spark, [(10, "100", "250"), (11, "200", "100.01"), (12, "7", "7"), (13, "0", "0.009")])
    got = {r["code_combination_id"]: r["proved"] for r in finance.balance_proof(df, *books).collect()}
    # A difference of exactly 0.01 is not proved.
    assert got == {10: True, 11: False, 12: True, 13: False}


def test_close(spark, books):
    row = finance.period_close(*books, balances(spark, [(10, "100", "250")])).first()
    assert (float(row["discrepancy_amount"]), row["accounts_not_proved"], row["is_balanced"]) == (50.0, 0, False)


def test_unbalanced_journals(books):
    assert sorted(r["je_header_id"] for r in finance.unbalanced_journals(books[1]).collect()) == [2, 3, 4]


def test_duplicates_are_groups_not_pairs(spark):
    base = invoices(spark, [(1, 10, 0, "N")] * 4 + [(1, 20, 0, "N")])
    from pyspark.sql import functions as F

    df = base.withColumn("invoice_num", F.lit("same"))
    rows = finance.duplicate_invoices(df).collect()
    assert [(r["copies"], r["first_invoice_id"], r["last_invoice_id"]) for r in rows] == [(4, 0, 3)]


def test_outliers(spark):
    df = invoices(spark, [(1, 100 + i % 3, 0, "N") for i in range(40)] + [(1, 5000, 0, "N")])
    assert [r["invoice_id"] for r in finance.outlier_invoices(df).collect()] == [40]
    same = invoices(spark, [(1, 100, 0, "N")] * 5)
    assert finance.outlier_invoices(same).count() == 0


def test_headcount_of_dated_versions(spark):
    """Day by day over every version: moves are no joins, a gap is a leave and a join."""
    day = dt.date
    versions = [
        (1, "a", day(2021, 1, 1), day(4712, 12, 31)), (2, "a", day(2021, 1, 15), day(2021, 2, 28)), (3, "a", day(2021, 2, 1), day(2021, 2, 10)),
        (3, "b", day(2021, 2, 11), day(2021, 4, 30)), (4, "b", day(2020, 5, 1), day(2021, 1, 31)), (4, "b", day(2021, 3, 2), day(4712, 12, 31)),
        (5, "c", day(2021, 6, 1), day(4712, 12, 31)), (None, "a", day(2021, 1, 1), day(4712, 12, 31)),
    ]
    people = spark.createDataFrame(versions, "person_id int, first_name string, effective_start_date date, effective_end_date date")
    got = {(r["first_name"], r["month"].month): (r["active"], r["joined"], r["left"]) for r in finance.gold_headcount(people, "2021-01-01", "2021-04-01").collect()}
    held = {}
    for who, group, a, b in versions:
        d = max(a, day(2020, 12, 31))
        while who is not None and d <= min(b, day(2021, 5, 1)):
            held[who, d] = group
            d += dt.timedelta(1)
    want = {}
    for month in range(1, 5):
        last = day(2021, month + 1, 1) - dt.timedelta(1)
        for (who, d), group in held.items():
            if (d.year, d.month) != (2021, month):
                continue
            n = want.setdefault((group, month), [0, 0, 0])
            n[0] += d == last
            n[1] += (who, d - dt.timedelta(1)) not in held
            n[2] += (who, d + dt.timedelta(1)) not in held
    assert got == {k: tuple(v) for k, v in want.items() if any(v)}
    assert finance.gold_headcount(people.limit(0), "2021-01-01", "2021-04-01").count() == 0


def test_headcount_groups_people_once_for_all_months(spark):
    """A row a person and group is shuffled, not one a month; also over more months than a number has bits."""
    day = dt.date
    people = spark.createDataFrame(
        [(1, "a", day(2001, 1, 31), day(4712, 12, 31)), (1, "a", day(2005, 1, 1), day(2005, 2, 28)), (2, "a", day(2008, 5, 2), day(2008, 5, 30)),
         (3, "a", day(2012, 1, 1), day(2011, 1, 1)), (4, "b", day(1990, 1, 1), day(2006, 4, 30)), (5, "b", None, day(2006, 4, 30))],
        "person_id int, first_name string, effective_start_date date, effective_end_date date")
    found = finance.gold_headcount(people, "2001-01-01", "2012-12-01")
    got = {(r["first_name"], r["month"]): r["active"] for r in found.collect() if r["active"]}
    months = [day(y, m, 1) for y in range(2001, 2013) for m in range(1, 13)]
    assert got == {**{("a", m): 1 for m in months}, **{("b", m): 1 for m in months if m <= day(2006, 4, 1)}}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan and "count(distinct" not in plan
