"""One migration run: extract, load to bronze, reconcile, certify, and log."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from closebook.functions.skew import checked_join
from closebook.model import MODULE_TABLES, Check, module_checks
from closebook.operators import lineage, reconcile
from closebook.sources import extract, files
from closebook.sources import lake as versions

RESULT_SCHEMA = (
    "run_id string, module string, period_name string, success boolean, rows_extracted bigint, "
    "rows_loaded bigint, reconciliation_passed boolean, certificate_id string, "
    "certificate_status string, steps string, errors string, duration_seconds double"
)
# Evaluated checks as the lake keeps them; the extract's own value stands beside both sides.
CHECKED_SCHEMA = (
    f"run_id string, {reconcile.CHECK_SCHEMA}, variance decimal(38,9), variance_pct double, "
    "passed boolean, extract_value decimal(38,9)"
)


# What a lake table is partitioned by, so that a run replaces its own scope only.
PARTITIONS = {
    "GL_JE_HEADERS": ["ledger_id", "period_name"],
    "GL_JE_LINES": ["ledger_id", "period_name"],
    "GL_BALANCES": ["ledger_id", "period_name"],
    "AP_INVOICES_ALL": ["org_id"],
    "AP_INVOICE_LINES_ALL": ["org_id"],
}

# Extracts that gather their rows by those columns themselves, before they are joined.
GATHERED = {"GL_JE_LINES", "GL_BALANCES"}

# Keys of tables without such columns: scopes share them, a row counts once.
KEYS = {
    "GL_CODE_COMBINATIONS": ["code_combination_id"],
    "AP_SUPPLIERS": ["vendor_id"],
    "PER_ALL_PEOPLE_F": ["person_id", "effective_start_date"],
}


def extract_module(module, sources, period=None, ledger_id=None, org_id=None, to_write=False) -> dict:
    """Source table -> extract, for every table of the module that is in `sources`.

    Extracts `to_write` that are `GATHERED` come rebalanced by their `PARTITIONS`.
    """
    s = sources

    def gather(name):
        return PARTITIONS[name] if to_write else ()

    if module == "GL":
        return {
            "GL_JE_HEADERS": extract.posted_headers(s["GL_JE_HEADERS"], period, ledger_id),
            "GL_JE_LINES": extract.journal_lines(
                s["GL_JE_LINES"], s["GL_CODE_COMBINATIONS"], s["GL_JE_HEADERS"], period, ledger_id,
                gather("GL_JE_LINES"),
            ),
            "GL_BALANCES": extract.gl_balances(
                s["GL_BALANCES"], s["GL_CODE_COMBINATIONS"], period, ledger_id, gather("GL_BALANCES")
            ),
            "GL_CODE_COMBINATIONS": s["GL_CODE_COMBINATIONS"],
        }
    if module == "AP":
        return {
            "AP_INVOICES_ALL": extract.ap_invoices(s["AP_INVOICES_ALL"], org_id),
            "AP_INVOICE_LINES_ALL": extract.ap_invoice_lines_with_org(
                s["AP_INVOICE_LINES_ALL"], s["AP_INVOICES_ALL"], org_id
            ),
            "AP_SUPPLIERS": s["AP_SUPPLIERS"],
        }
    if module == "HCM":
        out = {"PER_ALL_PEOPLE_F": extract.current_employees(s["PER_ALL_PEOPLE_F"])}
        if "PAY_PAYROLL_ACTIONS" in s:
            out["PAY_PAYROLL_ACTIONS"] = s["PAY_PAYROLL_ACTIONS"]
        return out
    return {}


def source_scope(module, sources, period=None, ledger_id=None, org_id=None) -> dict:
    """The same tables by the predicates of the scope alone, without any other join.

    This is the side an extract is measured against: a row that extraction or load lose
    is still here.
    """
    s = sources
    if module == "GL":
        headers = extract.posted_headers(s["GL_JE_HEADERS"], period, ledger_id)
        return {
            "GL_JE_HEADERS": headers,
            "GL_JE_LINES": checked_join(
                s["GL_JE_LINES"], headers.select("je_header_id"), "je_header_id", "left_semi"
            ),
            "GL_BALANCES": extract.actual_balances(s["GL_BALANCES"], period, ledger_id),
            "GL_CODE_COMBINATIONS": s["GL_CODE_COMBINATIONS"],
        }
    if module == "AP":
        return {
            "AP_INVOICES_ALL": extract.ap_invoices(s["AP_INVOICES_ALL"], org_id),
            "AP_INVOICE_LINES_ALL": extract.ap_invoice_lines(
                s["AP_INVOICE_LINES_ALL"], s["AP_INVOICES_ALL"], org_id
            ),
            "AP_SUPPLIERS": s["AP_SUPPLIERS"],
        }
    return extract_module(module, sources, period, ledger_id, org_id)


def in_scope(rows: DataFrame, partitions, period=None, ledger_id=None, org_id=None) -> DataFrame:
    """Rows of a lake table that a run of this scope wrote; prunes partitions."""
    for column, value in (("period_name", period), ("ledger_id", ledger_id), ("org_id", org_id)):
        if column in partitions and value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def migrate(
    spark: SparkSession,
    module: str,
    sources: dict[str, DataFrame],
    lake: str,
    *,
    period_name: str = "all",
    period_year: int = 0,
    period_num: int = 0,
    ledger_id: int | None = None,
    org_id: int | None = None,
    dry_run: bool = False,
    run_id: str | None = None,
) -> DataFrame:
    """Run a module's migration and return its result row.

    `period_name` "all" takes every period; ledgers and organizations are all
    taken when not given. Each extract is computed once, as it is written; its own
    numbers are observed on the way. Reconciliation compares the source tables, by the
    predicates of the scope, with what was written; the certificate covers every check,
    and the errors of the result name those that failed. A dry run writes no table and
    reconciles the extracts. The first error ends the run. Checks, certificate and events
    are in the lake, in a folder of the run. Each table gets a new version, so runs of
    several scopes may load at once, and a table that ledgers or organizations share keeps
    the rows of the others.
    """
    began = time.monotonic()
    module, run_id = module.upper(), run_id or uuid.uuid4().hex[:8]
    period = None if period_name == "all" else period_name
    scope = (period, ledger_id, org_id)
    table_map = MODULE_TABLES.get(module, {})
    steps, events, errors = [], [], []
    result = {"success": False, "rows_extracted": 0, "rows_loaded": 0, "passed": False}

    def event(name, **fields):
        events.append({"run_id": run_id, "event_id": len(events) + 1, "event_name": name,
                       "module": module, "period_name": period_name, "org_id": org_id,
                       "event_time": dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
                       **fields})

    event("MigrationStarted", tables=list(table_map), dry_run=dry_run)
    stage = "Extraction"
    try:
        extracts = extract_module(module, sources, *scope, to_write=not dry_run)
        source = source_scope(module, sources, *scope)
        # Reading the schema resolves every column, so a bad source fails here.
        bronze = {table_map[name]: df for name, df in extracts.items()}
        checks = module_checks(module)
        counted = {c.source_table for c in checks if c.check_type == "row_count"}
        checks += [Check(module, "row_count", t) for t in extracts if t not in counted]
        steps.append("extract")
        event("ExtractionComplete", tables=list(extracts))

        stage = "Bronze load"
        observed = {}
        if dry_run:
            target = bronze
            steps.append("load_bronze (dry_run)")
        else:
            named = {"period_name": period, "ledger_id": ledger_id, "org_id": org_id}

            def load(name):
                path, parts = f"{lake}/bronze/{table_map[name]}", PARTITIONS.get(name, [])
                own = [c for c in checks if c.source_table == name]
                seen = Observation()
                rows = extracts[name].observe(
                    seen, *[reconcile.measure(c).alias(f"m{i}") for i, c in enumerate(own)]
                )
                key = None if parts else KEYS.get(name)
                mine = {c: v for c, v in named.items() if v is not None and (c in parts or key)}
                done = versions.load_version(rows, path, parts, mine, key, gathered=name in GATHERED)
                if key:
                    newest = versions.read_version(spark, path)
                    table = versions.table_of(spark, path, newest, extracts[name], done)
                else:
                    table = in_scope(files.read_table(spark, path, extracts[name]), parts, *scope)
                taken = lineage.observed(seen)
                values = {
                    reconcile.labels(c)[0]: taken.get(f"m{i}", Decimal(0)) for i, c in enumerate(own)
                }
                # Counting a Parquet table reads its footers only.
                return table_map[name], table, table.count(), values

            # The tables are jobs of their own: small ones fill the gaps of large ones.
            with ThreadPoolExecutor(max(1, len(extracts))) as pool:
                loaded = list(pool.map(load, extracts))
            target = {name: table for name, table, *_ in loaded}
            result["rows_loaded"] = sum(n for _, _, n, _ in loaded)
            for *_, values in loaded:
                observed |= values
            edges = [(f"oracle.{n}", f"bronze.{table_map[n]}", "load_bronze") for n in extracts]
            if edges:
                lineage.document_lineage(spark, f"{lake}/lineage", edges)
            steps.append("load_bronze")
            event("LoadComplete", layer="bronze", rows=result["rows_loaded"])

        stage = "Reconciliation"
        # A handful of rows: the module's checks, and row counts of its other tables.
        rows = reconcile.evaluate_checks(
            reconcile.run_checks(module, source, target, checks, spark=spark)
        ).collect()
        if dry_run:
            observed = {r["source_label"]: r["target_value"] for r in rows}
        is_count = {r["source_label"] for r in rows if r["check_type"] == "row_count"}
        result["rows_extracted"] = int(sum(v for k, v in observed.items() if k in is_count))
        if dry_run:
            result["rows_loaded"] = result["rows_extracted"]
        steps.append("reconcile")
        evaluated = spark.createDataFrame(
            [(run_id, *r, observed.get(r["source_label"])) for r in rows], CHECKED_SCHEMA
        )
        certificate = reconcile.certificate(
            evaluated, module, period_name, period_year, period_num, run_id
        )
        cert = certificate.first()
        _keep(evaluated, f"{lake}/checks", run_id)
        _keep(certificate.withColumn("run_id", F.lit(run_id)), f"{lake}/certificates", run_id)
        result["passed"] = result["success"] = cert["status"] == "CERTIFIED"
        result["certificate"] = cert
        errors = [
            f"{r['check_type']} of {r['source_label']}: {_plain(r['source_value'])} in the source, "
            f"{_plain(r['target_value'])} in the lake" for r in rows if not r["passed"]
        ]
        event("ReconciliationComplete", passed=result["passed"],
              total_checks=cert["total_checks"], passed_checks=cert["passed_checks"],
              certificate_id=cert["certificate_id"])
        steps.append("certify")
        event("MigrationComplete", success=result["success"], rows=result["rows_extracted"],
              certificate_id=cert["certificate_id"])
    except Exception as e:
        errors = [f"{stage} failed: {e}"]
    _log(spark, lake, run_id, events)
    cert = result.get("certificate")
    return spark.createDataFrame(
        [(
            run_id, module, period_name, result["success"], result["rows_extracted"],
            result["rows_loaded"], result["passed"],
            cert["certificate_id"] if cert else None, cert["status"] if cert else None,
            ",".join(steps), "; ".join(errors), round(time.monotonic() - began, 2),
        )],
        RESULT_SCHEMA,
    )


def _plain(value) -> str:
    """A decimal without the zeros after its point."""
    text = f"{value:f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def _keep(rows: DataFrame, path: str, run_id: str) -> None:
    """Rows of one run in a folder of its own; the same run again replaces them."""
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/log_run={run_id}")


def _log(spark, lake, run_id, events) -> None:
    names = [c.split(" ", 1)[0] for c in lineage.RUN_EVENT_SCHEMA.split(", ")]
    rows = [tuple(e.get(n) for n in names) for e in events]
    _keep(spark.createDataFrame(rows, lineage.RUN_EVENT_SCHEMA), f"{lake}/run_events", run_id)
