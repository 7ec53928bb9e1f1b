"""Queries: extraction, entity mapping and layers."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from closebook.functions.scalars import join_segments, period_number, period_year
from closebook.operators import catalog, layers
from closebook.plans.registry import big, moment, money, query
from closebook.session import scratch_path
from closebook.sources import extract, files, lake


@query("q_gl_journals", """
SELECT h.je_header_id, b.batch_name, h.journal_name, h.period_name, h.ledger_id,
       COALESCE(t.n, 0) AS line_count, COALESCE(t.dr, 0.0) AS total_dr, COALESCE(t.cr, 0.0) AS total_cr,
       t.first_line, t.last_line
FROM fx_gl_je_headers h JOIN fx_gl_je_batches b ON h.je_batch_id = b.je_batch_id
LEFT JOIN (SELECT l.je_header_id, count(*) AS n, CAST(sum(accounted_dr) AS DOUBLE) AS dr,
                  CAST(sum(accounted_cr) AS DOUBLE) AS cr, min(je_line_num) AS first_line, max(je_line_num) AS last_line
           FROM fx_gl_je_lines l JOIN fx_gl_code_combinations c ON l.code_combination_id = c.code_combination_id
           GROUP BY l.je_header_id) t ON t.je_header_id = h.je_header_id
WHERE h.status IN ('P', 'POSTED')""")
def gl_journals(t):
    rows = extract.journals_with_line_totals(
        t["fx_gl_je_headers"], t["fx_gl_je_batches"], t["fx_gl_je_lines"], t["fx_gl_code_combinations"]
    )
    return rows.select(
        "je_header_id", "batch_name", "journal_name", "period_name", "ledger_id", "line_count",
        money("total_dr").alias("total_dr"), money("total_cr").alias("total_cr"),
        "first_line", "last_line",
    )


@query("q_gl_journal_pages", """
SELECT je_header_id, CAST((je_line_num - 1) // 1000 AS INTEGER) AS page, CAST(0 AS INTEGER) AS part, CAST(sum(copies) AS BIGINT) AS line_count,
       CAST(count(*) AS INTEGER) AS entries,
       string_agg(CAST(je_line_num AS VARCHAR) || ':' || CAST(code_combination_id AS VARCHAR) || 'x' || CAST(copies AS VARCHAR), ','
                  ORDER BY je_line_num, code_combination_id) AS line_text
FROM (SELECT je_header_id, je_line_num, code_combination_id, count(*) AS copies FROM fx_gl_je_lines GROUP BY 1, 2, 3)
GROUP BY 1, 2""")
def gl_journal_pages(t):
    pages = extract.line_pages(
        t["fx_gl_je_lines"], "je_header_id", "je_line_num", ["code_combination_id"]
    )
    text = F.transform(
        "lines",
        lambda x: F.concat(
            x["je_line_num"].cast("string"), F.lit(":"), x["code_combination_id"].cast("string"),
            F.lit("x"), x["copies"].cast("string"),
        ),
    )
    return pages.select(
        "je_header_id", "page", "part", "line_count", F.size("lines").alias("entries"),
        F.array_join(text, ",").alias("line_text"),
    )


@query("q_gl_lines_account", """
SELECT l.je_header_id, l.je_line_num, l.code_combination_id,
       concat_ws('.', nullif(c.segment1, ''), nullif(c.segment2, ''), nullif(c.segment3, ''), nullif(c.segment4, ''), nullif(c.segment5, '')) AS account,
       CAST(l.accounted_dr AS DOUBLE) AS accounted_dr, CAST(l.accounted_cr AS DOUBLE) AS accounted_cr
FROM fx_gl_je_lines l JOIN fx_gl_code_combinations c ON l.code_combination_id = c.code_combination_id""")
def gl_lines_account(t):
    rows = extract.lines_with_account(t["fx_gl_je_lines"], t["fx_gl_code_combinations"])
    return rows.select(
        "je_header_id", "je_line_num", "code_combination_id",
        F.col("concatenated_segments").alias("account"),
        money("accounted_dr").alias("accounted_dr"), money("accounted_cr").alias("accounted_cr"),
    )


@query("q_gl_balances", """
SELECT b.ledger_id, b.code_combination_id, b.period_name, b.currency_code,
       CAST(begin_balance_dr - begin_balance_cr AS DOUBLE) AS begin_net,
       CAST(period_net_dr - period_net_cr AS DOUBLE) AS period_net,
       CAST(begin_balance_dr - begin_balance_cr + period_net_dr - period_net_cr AS DOUBLE) AS end_net,
       concat_ws('.', nullif(c.segment1, ''), nullif(c.segment2, ''), nullif(c.segment3, ''), nullif(c.segment4, ''), nullif(c.segment5, '')) AS account
FROM fx_gl_balances b JOIN fx_gl_code_combinations c ON b.code_combination_id = c.code_combination_id
WHERE b.actual_flag = 'A' AND b.currency_code <> 'STAT'""")
def gl_balances(t):
    rows = extract.gl_balances(t["fx_gl_balances"], t["fx_gl_code_combinations"])
    return rows.select(
        "ledger_id", "code_combination_id", "period_name", "currency_code",
        money("begin_balance_net").alias("begin_net"), money("period_net").alias("period_net"),
        money("end_balance_net").alias("end_net"), F.col("concatenated_segments").alias("account"),
    )


@query("q_gl_resolve", """
SELECT je_header_id AS header_id, '' AS batch_name, journal_name, period_name, 2026 AS period_year, 1 AS period_num,
       CAST(ledger_id AS BIGINT) AS ledger_id, CAST(org_id AS BIGINT) AS org_id, status
FROM fx_gl_je_headers""")
def gl_resolve(t):
    return extract.resolve_journal_headers(t["fx_gl_je_headers"]).select(
        "header_id", "batch_name", "journal_name", "period_name", "period_year", "period_num",
        "ledger_id", "org_id", "status",
    )


@query("q_gl_resolve_lines", """
SELECT l.je_header_id AS header_id, l.je_line_num AS line_num, l.code_combination_id AS account_id,
       concat_ws('.', nullif(c.segment1, ''), nullif(c.segment2, ''), nullif(c.segment3, ''), nullif(c.segment4, ''), nullif(c.segment5, '')) AS account,
       CAST(3 + (CASE WHEN c.segment4 <> '' THEN 1 ELSE 0 END) + (CASE WHEN c.segment5 IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS segment_count,
       CAST(l.accounted_dr AS DOUBLE) AS dr, CASE WHEN l.accounted_dr IS NOT NULL THEN l.currency_code END AS dr_currency,
       CAST(l.accounted_cr AS DOUBLE) AS cr
FROM fx_gl_je_lines l JOIN fx_gl_code_combinations c ON l.code_combination_id = c.code_combination_id""")
def gl_resolve_lines(t):
    raw = extract.lines_with_account(t["fx_gl_je_lines"], t["fx_gl_code_combinations"], lists=True)
    return extract.resolve_journal_lines(raw).select(
        "header_id", "line_num", "account_id", F.col("concatenated_segments").alias("account"),
        F.size("segments").alias("segment_count"), money("accounted_dr.amount").alias("dr"),
        F.col("accounted_dr.currency").alias("dr_currency"), money("accounted_cr.amount").alias("cr"),
    )


@query("q_ap_invoices_nested", """
SELECT i.invoice_id, i.invoice_num, i.vendor_id, CAST(i.invoice_amount AS DOUBLE) AS invoice_amount,
       CAST(i.amount_paid AS DOUBLE) AS amount_paid, CAST(i.invoice_amount - i.amount_paid AS DOUBLE) AS amount_remaining,
       COALESCE(t.n, 0) AS line_count, COALESCE(t.s, 0.0) AS line_total, t.first_line, t.last_line
FROM fx_ap_invoices i
LEFT JOIN (SELECT invoice_id, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS s, min(line_number) AS first_line, max(line_number) AS last_line
           FROM fx_ap_invoice_lines GROUP BY 1) t ON t.invoice_id = i.invoice_id""")
def ap_invoices_nested(t):
    rows = extract.invoices_with_line_totals(t["fx_ap_invoices"], t["fx_ap_invoice_lines"])
    return rows.select(
        "invoice_id", "invoice_num", "vendor_id", money("invoice_amount").alias("invoice_amount"),
        money("amount_paid").alias("amount_paid"),
        money(F.col("invoice_amount") - F.col("amount_paid")).alias("amount_remaining"),
        "line_count", money("line_total").alias("line_total"), "first_line", "last_line",
    )


@query("q_ap_lines_semi", """
SELECT invoice_id, line_number, CAST(amount AS DOUBLE) AS amount, dist_code_combination_id
FROM fx_ap_invoice_lines WHERE invoice_id IN (SELECT invoice_id FROM fx_ap_invoices_tgt)""")
def ap_lines_semi(t):
    rows = extract.ap_invoice_lines(t["fx_ap_invoice_lines"], t["fx_ap_invoices_tgt"])
    return rows.select(
        "invoice_id", "line_number", money("amount").alias("amount"), "dist_code_combination_id"
    )


@query("q_hcm_current", """
SELECT person_id, employee_number, email_address, strftime(effective_end_date, '%Y-%m-%d') AS effective_end_date
FROM fx_people WHERE current_employee_flag = 'Y' AND effective_end_date = DATE '4712-12-31'""")
def hcm_current(t):
    return extract.current_employees(t["fx_people"]).select(
        "person_id", "employee_number", "email_address",
        F.date_format("effective_end_date", "yyyy-MM-dd").alias("effective_end_date"),
    )


@query("q_hcm_resolve", """
SELECT person_id, employee_number, first_name || ' ' || last_name AS full_name, email_address FROM fx_people""")
def hcm_resolve(t):
    return extract.resolve_employees(t["fx_people"]).select(
        "person_id", "employee_number", "full_name", "email_address"
    )


@query("q_param_sql", """
SELECT org_id, invoice_currency_code, count(*) AS invoices, CAST(sum(invoice_amount) AS DOUBLE) AS amount
FROM fx_ap_invoices WHERE invoice_amount >= 100000 AND payment_status_flag <> 'Y'
GROUP BY org_id, invoice_currency_code""")
def param_sql(t):
    return extract.run_query(
        t.spark,
        """
        SELECT org_id, invoice_currency_code, count(*) AS invoices,
               CAST(sum(invoice_amount) AS DOUBLE) AS amount
        FROM {invoices} WHERE invoice_amount >= :least AND payment_status_flag <> :closed
        GROUP BY org_id, invoice_currency_code""",
        {"least": 100000, "closed": "Y"},
        invoices=t["fx_ap_invoices"],
    )


@query("q_org_context", """
SELECT i.invoice_id, i.org_id, o.set_of_books_id, o.ledger_id, o.org_name
FROM fx_ap_invoices i LEFT JOIN fx_org o ON i.org_id = o.org_id""")
def org_context(t):
    rows = extract.with_org_context(t["fx_ap_invoices"].select("invoice_id", "org_id"), t["fx_org"])
    return rows.select("invoice_id", "org_id", "set_of_books_id", "ledger_id", "org_name")


@query("q_bronze_flatten", """
SELECT i.invoice_id, i.invoice_num, i.vendor_id, strftime(i.invoice_date, '%Y-%m-%dT%H:%M:%S') AS invoice_date,
       strftime(i.gl_date, '%Y-%m-%dT%H:%M:%S') AS gl_date,
       CAST(i.invoice_amount AS DOUBLE) AS invoice_amount, i.invoice_currency_code AS invoice_amount_currency,
       CAST(i.amount_paid AS DOUBLE) AS amount_paid, i.invoice_currency_code AS amount_paid_currency,
       i.invoice_currency_code, i.payment_status_flag,
       '{"org_id":' || CAST(i.org_id AS VARCHAR) || ',"set_of_books_id":' || CAST(i.set_of_books_id AS VARCHAR) || '}' AS context,
       COALESCE(p.n, 0) AS lines_count
FROM fx_ap_invoices i
LEFT JOIN (SELECT invoice_id, count(*) AS n FROM fx_ap_invoice_lines_rough GROUP BY 1) p ON p.invoice_id = i.invoice_id""")
def bronze_flatten(t):
    return layers.flatten(extract.resolve_invoices(t["fx_ap_invoices"], t["fx_ap_invoice_lines_rough"]))


@query("q_ap_invoice_pages", """
WITH d AS (
  SELECT invoice_id, COALESCE((line_number - 1) // 1000, -1) AS page, line_number, amount, description, dist_code_combination_id, count(*) AS copies
  FROM fx_ap_invoice_lines_rough GROUP BY ALL)
SELECT d.invoice_id, CAST(d.page AS INTEGER) AS page, CAST(0 AS INTEGER) AS part, CAST(sum(copies) AS BIGINT) AS line_count,
       CAST(count(*) AS INTEGER) AS entries, CAST(sum(amount * copies) AS DOUBLE) AS amount, min(i.invoice_currency_code) AS currency
FROM d JOIN (SELECT DISTINCT invoice_id, invoice_currency_code FROM fx_ap_invoices) i ON i.invoice_id = d.invoice_id
GROUP BY 1, 2""")
def ap_invoice_pages(t):
    pages = extract.line_pages(
        t["fx_ap_invoice_lines_rough"], "invoice_id", "line_number",
        ["amount", "description", "dist_code_combination_id"],
    )
    resolved = extract.resolve_invoice_pages(t["fx_ap_invoices"], pages)
    amount = F.aggregate(
        "lines", F.lit(0).cast("decimal(38,2)"),
        lambda acc, x: (acc + x["amount"]["amount"] * x["copies"]).cast("decimal(38,2)"),
    )
    return resolved.select(
        "invoice_id", "page", "part", "line_count", F.size("lines").alias("entries"),
        money(amount).alias("amount"), F.col("lines")[0]["amount"]["currency"].alias("currency"),
    )


# ---- Scoped extracts ----

SCOPE = {"period": "Jan-95", "ledger_id": 2001}
_IN_SCOPE = "period_name = 'Jan-95' AND ledger_id = 2001"


@query("q_gl_journals_scoped", f"""
SELECT h.je_header_id, b.batch_name, h.period_name, h.ledger_id, COALESCE(t.n, 0) AS line_count,
       COALESCE(t.dr, 0.0) AS total_dr, COALESCE(t.cr, 0.0) AS total_cr
FROM fx_gl_je_headers h JOIN fx_gl_je_batches b ON h.je_batch_id = b.je_batch_id
LEFT JOIN (SELECT l.je_header_id, count(*) AS n, CAST(sum(accounted_dr) AS DOUBLE) AS dr, CAST(sum(accounted_cr) AS DOUBLE) AS cr
           FROM fx_gl_je_lines l JOIN fx_gl_code_combinations c ON l.code_combination_id = c.code_combination_id
           GROUP BY l.je_header_id) t ON t.je_header_id = h.je_header_id
WHERE h.status IN ('P', 'POSTED') AND {_IN_SCOPE}""")
def gl_journals_scoped(t):
    rows = extract.journals_with_line_totals(
        t["fx_gl_je_headers"], t["fx_gl_je_batches"], t["fx_gl_je_lines"],
        t["fx_gl_code_combinations"], **SCOPE,
    )
    return rows.select(
        "je_header_id", "batch_name", "period_name", "ledger_id", "line_count",
        money("total_dr").alias("total_dr"), money("total_cr").alias("total_cr"),
    )


@query("q_gl_lines_scoped", f"""
SELECT l.je_header_id, l.je_line_num, l.code_combination_id, h.ledger_id, h.period_name, CAST(l.accounted_dr AS DOUBLE) AS accounted_dr
FROM fx_gl_je_lines l JOIN fx_gl_je_headers h ON l.je_header_id = h.je_header_id
JOIN fx_gl_code_combinations c ON l.code_combination_id = c.code_combination_id
WHERE h.status IN ('P', 'POSTED') AND {_IN_SCOPE}""")
def gl_lines_scoped(t):
    rows = extract.journal_lines(
        t["fx_gl_je_lines"], t["fx_gl_code_combinations"], t["fx_gl_je_headers"], **SCOPE
    )
    return rows.select(
        "je_header_id", "je_line_num", "code_combination_id", "ledger_id", "period_name",
        money("accounted_dr").alias("accounted_dr"),
    )


@query("q_gl_balances_scoped", f"""
SELECT b.ledger_id, b.code_combination_id, b.period_name, CAST(begin_balance_dr - begin_balance_cr + period_net_dr - period_net_cr AS DOUBLE) AS end_net
FROM fx_gl_balances b JOIN fx_gl_code_combinations c ON b.code_combination_id = c.code_combination_id
WHERE b.actual_flag = 'A' AND b.currency_code <> 'STAT' AND {_IN_SCOPE}""")
def gl_balances_scoped(t):
    rows = extract.gl_balances(t["fx_gl_balances"], t["fx_gl_code_combinations"], **SCOPE)
    return rows.select(
        "ledger_id", "code_combination_id", "period_name", money("end_balance_net").alias("end_net")
    )


@query("q_ap_invoices_scoped", """
SELECT i.invoice_id, i.org_id, COALESCE(t.n, 0) AS line_count, COALESCE(t.s, 0.0) AS line_total
FROM fx_ap_invoices i
LEFT JOIN (SELECT invoice_id, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS s FROM fx_ap_invoice_lines GROUP BY 1) t ON t.invoice_id = i.invoice_id
WHERE i.org_id = 102""")
def ap_invoices_scoped(t):
    rows = extract.invoices_with_line_totals(t["fx_ap_invoices"], t["fx_ap_invoice_lines"], 102)
    return rows.select("invoice_id", "org_id", "line_count", money("line_total").alias("line_total"))


def raw_invoices(invoices):
    """Invoices as an untyped export has them, some amounts and dates unreadable."""
    bad_amount, bad_date = F.col("invoice_id") % 41 == 0, F.col("invoice_id") % 43 == 0
    return invoices.select(
        F.col("invoice_id").cast("string").alias("INVOICE_ID"),
        F.col("invoice_num").alias("INVOICE_NUM"),
        F.col("vendor_id").cast("string").alias("VENDOR_ID"),
        F.when(bad_amount, "n/a").otherwise(F.col("invoice_amount").cast("string")).alias("INVOICE_AMOUNT"),
        F.when(bad_date, "31/12/99").otherwise(moment("invoice_date")).alias("INVOICE_DATE"),
        F.lit("1.5").alias("RATE"),
        F.col("org_id").cast("string").alias("ORG_ID"),
    )


STAGED_SQL = """
  SELECT CAST(invoice_id AS BIGINT) AS invoice_id, invoice_num, CAST(vendor_id AS BIGINT) AS vendor_id,
         CASE WHEN invoice_id % 41 <> 0 THEN CAST(invoice_amount AS DOUBLE) END AS invoice_amount,
         CASE WHEN invoice_id % 43 <> 0 THEN strftime(invoice_date, '%Y-%m-%d %H:%M:%S') END AS invoice_date,
         CAST(1.5 AS DOUBLE) AS rate, CAST(org_id AS VARCHAR) AS org_id
  FROM fx_ap_invoices"""


@query("q_staging_cast", STAGED_SQL)
def staging_cast(t):
    columns = catalog.table_columns(t["fx_dict_columns"], "AP", "AP_INVOICES_ALL")
    staged = layers.staging(raw_invoices(t["fx_ap_invoices"]), columns)
    return staged.withColumns(
        {
            "invoice_id": big("invoice_id"), "vendor_id": big("vendor_id"),
            "invoice_amount": money("invoice_amount"), "invoice_date": moment("invoice_date"),
        }
    )


def staged_accounts(t):
    columns = catalog.table_columns(t["fx_dict_columns"], "GL", "GL_CODE_COMBINATIONS")
    raw = t["fx_gl_code_combinations"]
    raw = raw.select(*[F.col(n.lower()).cast("string").alias(n) for n, *_ in columns])
    return layers.staging(raw, columns)


@query("q_intermediate", """
SELECT code_combination_id, segment1, segment2, segment3, segment4, segment5, segment1 AS segment1_value,
       segment2 AS segment2_value, segment3 AS segment3_value, segment4 AS segment4_value, segment5 AS segment5_value
FROM fx_gl_code_combinations""")
def intermediate(t):
    return layers.intermediate(staged_accounts(t)).withColumn(
        "code_combination_id", big("code_combination_id")
    )


@query("q_export_files", """
SELECT 'good' AS kind, invoice_id, CAST(invoice_amount AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS line
FROM fx_ap_invoices WHERE invoice_id % 41 <> 0
UNION ALL
SELECT 'bad', NULL, NULL, CAST(invoice_id AS VARCHAR) || ',oops' FROM fx_ap_invoices WHERE invoice_id % 41 = 0""")
def export_files(t):
    """Export files, some lines of them unreadable, read back and parted."""
    path = scratch_path(t.spark, "export")
    line = F.concat(
        F.col("invoice_id").cast("string"), F.lit(","),
        F.when(F.col("invoice_id") % 41 == 0, "oops").otherwise(F.col("invoice_amount").cast("string")),
    )
    header = t.spark.createDataFrame([("invoice_id,amount",)], "value string")
    header.coalesce(1).unionByName(t["fx_ap_invoices"].select(line.alias("value"))).write.text(path)
    good, bad = files.split_export(
        files.read_export(t.spark, path, "invoice_id bigint, amount decimal(18,2)")
    )
    return good.select(
        F.lit("good").alias("kind"), "invoice_id", money("amount").alias("amount"),
        F.lit(None).cast("string").alias("line"),
    ).unionByName(bad.select(
        F.lit("bad").alias("kind"), F.lit(None).cast("bigint").alias("invoice_id"),
        F.lit(None).cast("double").alias("amount"), F.col(files.CORRUPT).alias("line"),
    ))


@query("q_sink_rerun", """
SELECT org_id, count(*) AS invoices, CAST(sum(invoice_amount) AS DOUBLE) AS amount FROM fx_ap_invoices WHERE org_id <> 103 GROUP BY 1""")
def sink_rerun(t):
    """A lake table after a second load of one organization that has no invoice left."""
    path = scratch_path(t.spark, "sink")
    rows = t["fx_ap_invoices"].select("org_id", "invoice_id", "invoice_amount")
    files.load_table(rows, path, ["org_id"], whole=True)
    files.load_table(
        rows.where("org_id = 103 AND invoice_id < 0"), path, ["org_id"],
        scope=lambda table: table.where("org_id = 103"),
    )
    loaded = files.read_table(t.spark, path, rows)
    return loaded.groupBy("org_id").agg(
        F.count("*").alias("invoices"), F.sum("invoice_amount").alias("amount")
    ).withColumn("amount", money("amount"))


@query("q_export_quoted", """
SELECT invoice_id, CASE WHEN invoice_id % 7 = 0 THEN 'note of' || chr(10) || invoice_num || ', "quoted"' || chr(10) ELSE invoice_num END AS note,
       CAST(NULL AS VARCHAR) AS line
FROM fx_ap_invoices WHERE invoice_id % 43 <> 0
UNION ALL
SELECT NULL, NULL, 'x' || CAST(invoice_id AS VARCHAR) || ',"two' || chr(10) || 'lines"' FROM fx_ap_invoices WHERE invoice_id % 43 = 0""")
def export_quoted(t):
    """Export files whose quoted fields hold line ends; bad records come back whole."""
    path = scratch_path(t.spark, "export")
    note = F.concat(F.lit('"note of\n'), "invoice_num", F.lit(', ""quoted""\n"'))
    number = F.col("invoice_id").cast("string")
    record = (
        F.when(F.col("invoice_id") % 43 == 0, F.concat(F.lit("x"), number, F.lit(',"two\nlines"')))
        .when(F.col("invoice_id") % 7 == 0, F.concat(number, F.lit(","), note))
        .otherwise(F.concat(number, F.lit(","), "invoice_num"))
    )
    t["fx_ap_invoices"].select(record.alias("value")).write.text(path)
    good, bad = files.split_export(files.read_export(t.spark, path, "invoice_id bigint, note string", escape='"'))
    return good.select("invoice_id", "note", F.lit(None).cast("string").alias("line")).unionByName(
        bad.select(F.col(files.CORRUPT).alias("line")), allowMissingColumns=True)


@query("q_sink_concurrent", """
SELECT 'accounts' AS table_name, segment2 AS part, count(*) AS rows, CAST(sum(code_combination_id) AS BIGINT) AS ids FROM fx_gl_code_combinations
WHERE (code_combination_id % 3 <> 0 AND code_combination_id % 7 <> 0) OR code_combination_id % 3 <> 1 GROUP BY segment2
UNION ALL
SELECT 'headers', CAST(ledger_id AS VARCHAR), count(*), CAST(sum(je_header_id) AS BIGINT) FROM fx_gl_je_headers
WHERE CASE ledger_id WHEN 2001 THEN je_header_id % 2 = 0 WHEN 2002 THEN je_header_id % 5 = 0 ELSE true END GROUP BY ledger_id""")
def sink_concurrent(t):
    """Two ledgers load at once, into a table of their own parts and one they share.

    One run of each fails half way, and the first ledger loads its accounts again without
    some of them.
    """
    path = scratch_path(t.spark, "sink")
    accounts = t["fx_gl_code_combinations"].select("code_combination_id", "segment2")
    headers = t["fx_gl_je_headers"].select("je_header_id", "ledger_id")
    own, shared, key = f"{path}/headers", f"{path}/accounts", ["code_combination_id"]
    lake.load_version(headers, own, ["ledger_id"])

    def load(ledger, rows, account_rows):
        lake.load_version(headers.where(F.col("ledger_id") == ledger).where(rows), own, ["ledger_id"], {"ledger_id": ledger}, retain=9)
        lake.load_version(accounts.where(account_rows), shared, scope={"ledger_id": ledger}, key=key, retain=9)

    def fails(ledger):
        lost = accounts.withColumn("segment2", F.raise_error(F.lit("lost connection")).cast("string"))
        try:
            lake.load_version(lost, shared, scope={"ledger_id": ledger}, key=key, retain=9)
        except PySparkException:
            return True
        raise AssertionError("a failed load went through")

    with ThreadPoolExecutor(4) as pool:
        runs = [
            pool.submit(load, 2001, "je_header_id % 2 = 0", "code_combination_id % 3 <> 0"),
            pool.submit(load, 2002, "je_header_id % 5 = 0", "code_combination_id % 3 <> 1"),
            pool.submit(fails, 2003), pool.submit(fails, 2001),
        ]
        for run in runs:
            run.result()
    lake.load_version(
        accounts.where("code_combination_id % 3 <> 0 AND code_combination_id % 7 <> 0"), shared, scope={"ledger_id": 2001}, key=key)
    held = files.read_table(t.spark, shared, accounts).select(F.lit("accounts").alias("table_name"), F.col("segment2").alias("part"),
                                                              big("code_combination_id").alias("id"))
    held = held.unionByName(files.read_table(t.spark, own, headers).select(
        F.lit("headers").alias("table_name"), F.col("ledger_id").cast("string").alias("part"), big("je_header_id").alias("id")))
    return held.groupBy("table_name", "part").agg(F.count("*").alias("rows"), F.sum("id").alias("ids"))


@query("q_mart_union", """
SELECT 'stg_ap_invoices' AS source_table, invoice_id, vendor_id, CAST(NULL AS INTEGER) AS line_number, CAST(invoice_amount AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS vendor_name FROM fx_ap_invoices
UNION ALL
SELECT 'stg_ap_invoice_lines', invoice_id, NULL, line_number, CAST(amount AS DOUBLE), NULL FROM fx_ap_invoice_lines
UNION ALL
SELECT 'stg_ap_suppliers', NULL, vendor_id, NULL, NULL, vendor_name FROM fx_ap_suppliers""")
def mart_union(t):
    return layers.mart_union(
        {
            "AP_INVOICES_ALL": t["fx_ap_invoices"].select(
                "invoice_id", "vendor_id", money("invoice_amount").alias("amount")
            ),
            "AP_INVOICE_LINES_ALL": t["fx_ap_invoice_lines"].select(
                "invoice_id", "line_number", money("amount").alias("amount")
            ),
            "AP_SUPPLIERS": t["fx_ap_suppliers"].select("vendor_id", "vendor_name"),
        }
    )


@query("q_gl_segments", """
SELECT code_combination_id,
       concat_ws('.', nullif(segment1, ''), nullif(segment2, ''), nullif(segment3, ''), nullif(segment4, ''), nullif(segment5, '')) AS account
FROM fx_gl_code_combinations""")
def gl_segments(t):
    return t["fx_gl_code_combinations"].select(
        "code_combination_id", join_segments(*extract.SEGMENTS).alias("account")
    )


PERIOD_TEXT = """CASE je_header_id % 5 WHEN 0 THEN upper(period_name) WHEN 1 THEN substr(period_name, 1, 3)
                 WHEN 2 THEN 'Adj-' || substr(period_name, 5, 2) WHEN 3 THEN substr(period_name, 1, 3) || 'x-20' || substr(period_name, 5, 2)
                 ELSE period_name END"""


@query("q_period_parse", f"""
SELECT je_header_id, period_text,
       CASE WHEN period_text IS NULL THEN NULL WHEN strpos(period_text, '-') = 0 THEN 2026
            ELSE (SELECT CASE WHEN y < 100 THEN y + 2000 ELSE y END FROM (SELECT TRY_CAST(split_part(period_text, '-', 2) AS INTEGER) AS y))
       END AS period_year,
       CASE WHEN period_text IS NULL THEN NULL
            ELSE COALESCE(nullif(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substr(split_part(period_text, '-', 1), 1, 3))), 0), 1)
       END AS period_num
FROM (SELECT je_header_id, {PERIOD_TEXT} AS period_text FROM fx_gl_je_headers)""")
def period_parse(t):
    rows = t["fx_gl_je_headers"].select("je_header_id", F.expr(PERIOD_TEXT).alias("period_text"))
    return rows.select(
        "je_header_id", "period_text", period_year("period_text").alias("period_year"),
        period_number("period_text").alias("period_num"),
    )
