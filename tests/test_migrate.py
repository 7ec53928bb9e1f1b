from decimal import Decimal

import pytest

from closebook.plans import migrate as runs
from closebook.sources import extract
from closebook.sources.fixtures import Tables
from tests.util import rows


@pytest.fixture(scope="module")
def sources(spark, folder):
    t = Tables(spark, folder)
    return {
        "AP_INVOICES_ALL": t["fx_ap_invoices"], "AP_INVOICE_LINES_ALL": t["fx_ap_invoice_lines"],
        "AP_SUPPLIERS": t["fx_ap_suppliers"], "PER_ALL_PEOPLE_F": t["fx_people"],
        "GL_JE_HEADERS": t["fx_gl_je_headers"], "GL_JE_LINES": t["fx_gl_je_lines"],
        "GL_BALANCES": t["fx_gl_balances"], "GL_CODE_COMBINATIONS": t["fx_gl_code_combinations"],
    }


def log(spark, lake):
    events = spark.read.parquet(f"{lake}/run_events").collect()
    return [e["event_name"] for e in sorted(events, key=lambda e: e["event_time"])]


def test_payables(spark, sources, tmp_path):
    lake = str(tmp_path)
    for _ in range(2):
        row = runs.migrate(spark, "ap", sources, lake, period_year=2026, period_num=1, run_id="r1").first()
        assert (row["module"], row["success"], row["certificate_status"]) == ("AP", True, "CERTIFIED")
        assert row["certificate_id"] == "CERT-AP-2026-01-r1"
        assert row["rows_extracted"] == row["rows_loaded"] > 0
        assert row["steps"] == "extract,load_bronze,reconcile,certify"
        # A second run leaves the same rows.
        loaded = spark.read.parquet(f"{lake}/bronze/ap_invoices")
        want = extract.ap_invoices(sources["AP_INVOICES_ALL"])
        assert rows(loaded.select(want.columns)) == rows(want)
    assert log(spark, lake) == ["MigrationStarted", "ExtractionComplete", "LoadComplete",
                                "ReconciliationComplete", "MigrationComplete"]
    assert spark.read.parquet(f"{lake}/lineage").distinct().count() == 3


def test_one_organization_keeps_the_others(spark, sources, tmp_path):
    lake = str(tmp_path)
    every = runs.migrate(spark, "AP", sources, lake).first()
    one = runs.migrate(spark, "AP", sources, lake, org_id=101).first()
    assert one["success"] and one["rows_loaded"] < every["rows_loaded"]
    total = spark.read.parquet(f"{lake}/bronze/ap_invoices").count()
    assert total == sources["AP_INVOICES_ALL"].count()


def test_ledger_of_one_period(spark, sources, tmp_path):
    row = runs.migrate(spark, "GL", sources, str(tmp_path), period_name="Jan-96", ledger_id=2001).first()
    assert row["success"], row["errors"]
    headers = spark.read.parquet(f"{tmp_path}/bronze/gl_je_headers")
    assert headers.select("ledger_id", "period_name").distinct().collect() == [(2001, "Jan-96")]
    lines = spark.read.parquet(f"{tmp_path}/bronze/gl_je_lines")
    assert lines.join(headers, "je_header_id", "left_anti").count() == 0


def test_people(spark, sources, tmp_path):
    row = runs.migrate(spark, "HCM", sources, str(tmp_path)).first()
    assert row["success"]
    assert row["rows_loaded"] == extract.current_employees(sources["PER_ALL_PEOPLE_F"]).count()


def test_dry_run_writes_no_table(spark, sources, tmp_path):
    row = runs.migrate(spark, "AP", sources, str(tmp_path), dry_run=True).first()
    assert row["success"] and row["rows_loaded"] == row["rows_extracted"]
    assert "load_bronze (dry_run)" in row["steps"]
    assert not (tmp_path / "bronze").exists()
    assert "LoadComplete" not in log(spark, str(tmp_path))


def test_unknown_module_is_not_certified(spark, sources, tmp_path):
    row = runs.migrate(spark, "XX", sources, str(tmp_path)).first()
    assert (row["success"], row["certificate_status"]) == (False, "NO_CHECKS")


def test_bad_source_ends_the_run(spark, sources, tmp_path):
    broken = {**sources, "AP_INVOICES_ALL": sources["AP_INVOICES_ALL"].drop("amount_paid")}
    row = runs.migrate(spark, "AP", broken, str(tmp_path)).first()
    assert not row["success"] and row["errors"].startswith("Extraction failed")
    assert log(spark, str(tmp_path)) == ["MigrationStarted"]


def test_lost_rows_fail_the_certificate(spark, sources, tmp_path, monkeypatch):
    real = runs.files.read_table

    def lossy(session, path, like=None):
        df = real(session, path, like)
        return df.where("invoice_id <> 100") if path.endswith("ap_invoices") else df

    monkeypatch.setattr(runs.files, "read_table", lossy)
    row = runs.migrate(spark, "AP", sources, str(tmp_path)).first()
    lost = sources["AP_INVOICES_ALL"].where("invoice_id = 100").count()
    assert lost == 1
    assert (row["success"], row["certificate_status"]) == (False, "FAILED")
    assert row["rows_extracted"] - row["rows_loaded"] == lost
    assert Decimal(row["rows_loaded"]) > 0


def test_lines_on_unknown_accounts_fail_the_certificate(spark, tmp_path):
    """Ten posted lines, six of them on accounts the source does not have."""
    import datetime as dt

    headers = spark.createDataFrame(
        [(1, 1, "J", "Jan-26", "P", 2001, 101, dt.datetime(2026, 1, 1))],
        "je_header_id int, je_batch_id int, journal_name string, period_name string, status string, ledger_id int, org_id int, posted_date timestamp_ntz")
    lines = spark.createDataFrame(
        [(1, i, i, "USD", Decimal(5), None) for i in range(10)],
        "je_header_id int, je_line_num int, code_combination_id int, currency_code string, accounted_dr decimal(18,2), accounted_cr decimal(18,2)")
    accounts = spark.createDataFrame(
        [(i, "a", "b", "c", "d", "e", "Y") for i in range(4)],
        "code_combination_id int, segment1 string, segment2 string, segment3 string, segment4 string, segment5 string, enabled_flag string")
    balances = spark.createDataFrame(
        [], "ledger_id int, code_combination_id int, currency_code string, period_name string, actual_flag string, "
        "begin_balance_dr decimal(18,2), begin_balance_cr decimal(18,2), period_net_dr decimal(18,2), period_net_cr decimal(18,2)")
    tables = {"GL_JE_HEADERS": headers, "GL_JE_LINES": lines, "GL_BALANCES": balances, "GL_CODE_COMBINATIONS": accounts}
    row = runs.migrate(spark, "GL", tables, str(tmp_path), run_id="r1").first()
    assert (row["success"], row["certificate_status"]) == (False, "FAILED"), row["errors"]
    assert "row_count of Oracle GL_JE_LINES: 10 in the source, 4 in the lake" in row["errors"]
    assert row["duration_seconds"] > 0
    kept = spark.read.parquet(f"{tmp_path}/checks").where("source_label = 'Oracle GL_JE_LINES'").first()
    assert (kept["source_value"], kept["extract_value"], kept["target_value"], kept["passed"]) == (10, 4, 4, False)
    assert spark.read.parquet(f"{tmp_path}/certificates").first()["status"] == "FAILED"
    # The journal is unposted: the next run of the period takes its lines out of the lake.
    tables["GL_JE_HEADERS"] = headers.withColumn("status", headers["status"].substr(2, 1))
    again = runs.migrate(spark, "GL", tables, str(tmp_path), period_name="Jan-26", ledger_id=2001).first()
    assert again["success"], again["errors"]
    assert spark.read.schema(lines.schema).parquet(f"{tmp_path}/bronze/gl_je_lines").count() == 0


def test_two_ledgers_at_once_keep_their_accounts(spark, sources, tmp_path):
    """Each ledger has accounts of its own; both run at once into one lake, the first one twice."""
    from concurrent.futures import ThreadPoolExecutor

    lake, accounts = str(tmp_path), sources["GL_CODE_COMBINATIONS"]
    own = {2001: accounts.where("code_combination_id % 2 = 0"), 2002: accounts.where("code_combination_id % 2 = 1")}

    def run(ledger):
        keep = own[ledger].select("code_combination_id")
        tables = {
            "GL_JE_HEADERS": sources["GL_JE_HEADERS"], "GL_CODE_COMBINATIONS": own[ledger],
            "GL_JE_LINES": sources["GL_JE_LINES"].join(keep, "code_combination_id", "left_semi"),
            "GL_BALANCES": sources["GL_BALANCES"].join(keep, "code_combination_id", "left_semi"),
        }
        return runs.migrate(spark, "GL", tables, lake, ledger_id=ledger).first()

    for ledgers in ((2001, 2002), (2001,)):
        with ThreadPoolExecutor(2) as pool:
            for row in pool.map(run, ledgers):
                assert (row["success"], row["certificate_status"]) == (True, "CERTIFIED"), row["errors"]
        held = runs.files.read_table(spark, f"{lake}/bronze/gl_code_combinations", accounts)
        assert rows(held) == rows(accounts)
        headers = runs.files.read_table(spark, f"{lake}/bronze/gl_je_headers")
        assert {r[0] for r in headers.select("ledger_id").distinct().collect()} == {2001, 2002}


@pytest.mark.parametrize("at_once", [extract.ACCOUNTS_AT_ONCE, 0])
def test_rows_are_gathered_before_they_get_derived_columns(spark, sources, monkeypatch, at_once):
    """Few accounts are joined behind the shuffle; the joined text and the nets are made there anyhow."""
    monkeypatch.setattr(extract, "ACCOUNTS_AT_ONCE", at_once)
    plain, gathered = (runs.extract_module("GL", sources, to_write=w) for w in (False, True))
    for name, late in (("GL_JE_LINES", ["concatenated_segments"]), ("GL_BALANCES", ["concatenated_segments", "end_balance_net"])):
        assert gathered[name].schema == plain[name].schema
        assert rows(gathered[name]) == rows(plain[name])
        plan = gathered[name]._jdf.queryExecution().optimizedPlan().toString()
        before, after = plan.split("RebalancePartitions", 1)
        at = after.split("\n")[0].index("[")
        assert "ledger_id" in after.split("\n")[0][at:]
        assert all(c in before and f"AS {c}#" in before for c in late if at_once == 0 or c not in ("concatenated_segments",))
        assert ("Join Inner, " in before) == (at_once > 0)


def test_a_view_is_computed_once_for_a_migration(spark, folder):
    from closebook.plans import checks

    t = Tables(spark, folder)
    held = checks._as_table(t, "fx_gl_balances")
    assert held.dtypes == t["fx_gl_balances"].dtypes and rows(held) == rows(t["fx_gl_balances"])
    assert "Join" not in held._jdf.queryExecution().optimizedPlan().toString()
