import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from closebook.sources import extract
from closebook.sources.fixtures import Tables


def test_period_and_ledger_filters(spark, folder):
    t = Tables(spark, folder)
    args = (t["fx_gl_je_headers"], t["fx_gl_je_batches"], t["fx_gl_je_lines"], t["fx_gl_code_combinations"])
    every = extract.journals_with_line_totals(*args)
    some = extract.journals_with_line_totals(*args, period="Jan-96", ledger_id=2001)
    wanted = every.where("period_name = 'Jan-96' AND ledger_id = 2001")
    assert some.count() == wanted.count() > 0
    assert sorted(some.collect()) == sorted(wanted.select(some.columns).collect())


def test_filter_is_pushed_to_the_scan(spark, folder):
    scan = extract.ap_invoices(spark.read.parquet(f"{folder}/orders.parquet").selectExpr(
        "o_orderkey invoice_id", "o_custkey org_id", "cast(0 as decimal(18,2)) amount_paid"), 7)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan
    assert "o_totalprice" not in plan


def test_hcm_current(spark):
    day = dt.date
    df = spark.createDataFrame(
        [(1, "Y", day(4712, 12, 31)), (2, "N", day(4712, 12, 31)), (3, "Y", day(2020, 1, 1)), (4, None, day(4712, 12, 31))],
        "person_id int, current_employee_flag string, effective_end_date date",
    )
    assert [r["person_id"] for r in extract.current_employees(df).collect()] == [1]


def test_employee_name_fallback(spark):
    df = spark.createDataFrame(
        [(1, "Sara Ibrahim", "Sara", "I."), (2, None, "Omar", "Hassan"), (3, None, None, "Ali")],
        "person_id int, full_name string, first_name string, last_name string",
    )
    names = [r["full_name"] for r in extract.resolve_employees(df).orderBy("person_id").collect()]
    assert names == ["Sara Ibrahim", "Omar Hassan", " Ali"]
    without = extract.resolve_employees(df.drop("full_name")).orderBy("person_id").collect()
    assert without[0]["full_name"] == "Sara I."
    assert without[0]["employee_number"] == ""


def test_journal_fallbacks(spark):
    raw = spark.createDataFrame([(1, "Jan-26", 9, "Journal")], "je_header_id int, period_name string, set_of_books_id int, journal_name string")
    row = extract.resolve_journal_headers(raw).first()
    assert (row["ledger_id"], row["journal_name"], row["status"], row["period_year"]) == (9, "Journal", "UNPOSTED", 2026)
    raw = spark.createDataFrame(
        [(1, 3, "0", "x", "", Decimal(0), None)],
        "je_header_id int, line_num int, segment1 string, segment2 string, segment3 string, accounted_dr decimal(9,2), accounted_cr decimal(9,2)",
    )
    row = extract.resolve_journal_lines(raw).first()
    assert row["line_num"] == 3 and row["account_id"] == 0
    assert [s["segment_num"] for s in row["segments"]] == [1, 2]
    assert row["concatenated_segments"] == "0.x"
    # A zero amount is kept, an absent one is null; the currency falls back to USD.
    assert row["accounted_dr"]["amount"] == 0 and row["accounted_dr"]["currency"] == "USD"
    assert row["accounted_cr"] is None and row["entered_dr"] is None


def test_line_pages_bound_rows(spark):
    lines = spark.range(2500).select(
        F.lit(1).alias("h"), (F.col("id") + 1).cast("int").alias("n"), F.lit("x").alias("d")
    )
    lines = lines.unionByName(lines.where("n = 7")).unionByName(spark.range(5000).select(
        F.lit(2).alias("h"), F.lit(1).alias("n"), F.lit("same").alias("d")))
    pages = extract.line_pages(lines, "h", "n", ["d"], page_size=1000)
    got = {(r["h"], r["page"]): (len(r["lines"]), r["line_count"]) for r in pages.collect()}
    assert got == {(1, 0): (1000, 1001), (1, 1): (1000, 1000), (1, 2): (500, 500), (2, 0): (1, 5000)}
    first = pages.where("h = 1 AND page = 0").first()["lines"]
    assert [x["n"] for x in first] == list(range(1, 1001))
    assert first[6]["copies"] == 2


@pytest.mark.parametrize("number", [5, None])
def test_one_line_number_many_times(spark, number):
    """A flood of lines of one number, or of none, makes no long list."""
    lines = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50 + 2).cast("int").alias("h"),
        F.lit(number).cast("int").alias("n"), F.col("id").alias("amount"),
    )
    wanted = {}
    for r in lines.collect():
        wanted.setdefault(r["h"], []).append(r["amount"])
    pages = extract.line_pages(lines, "h", "n", ["amount"], page_size=100).collect()
    got = {}
    for r in pages:
        assert len(r["lines"]) < 300 and r["page"] == (0 if number else extract.NO_NUMBER)
        got.setdefault(r["h"], []).extend(x["amount"] for x in r["lines"])
    assert {h: sorted(v) for h, v in got.items()} == wanted
    assert len([r for r in pages if r["h"] == 1]) == 7


def test_org_lookup(spark, folder):
    orgs = Tables(spark, folder)["fx_org"]
    assert extract.resolve_org_id(orgs, "ASIA").count() == 1
    assert extract.resolve_org_id(orgs, "NOWHERE").count() == 0
    rows = spark.createDataFrame([(101,), (999,)], "org_id int")
    got = {r["org_id"]: r["ledger_id"] for r in extract.with_org_context(rows, orgs).collect()}
    assert got == {101: 2001, 999: None}


def test_run_query_binds_values(spark):
    df = spark.createDataFrame([("a' OR 1=1",), ("b",)], "name string")
    out = extract.run_query(spark, "SELECT * FROM {t} WHERE name = :n", {"n": "a' OR 1=1"}, t=df)
    assert [r["name"] for r in out.collect()] == ["a' OR 1=1"]


def test_jdbc_options():
    got = extract.jdbc_options("jdbc:x", "gl_je_lines", "je_header_id", 1, 10**9, 400, user="u")
    assert (got["partitionColumn"], got["numPartitions"], got["user"]) == ("je_header_id", "400", "u")
