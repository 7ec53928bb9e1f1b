"""Queries: aging, period totals, proofs, close, odd invoices, gold marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from closebook.operators import finance, matching
from closebook.plans.registry import moment, money, query

AS_OF = "2001-08-01"


@query("q_ap_aging", f"""
WITH u AS (
  SELECT org_id, invoice_currency_code, invoice_amount - amount_paid AS due,
         floor((epoch_us(TIMESTAMP '{AS_OF} 00:00:00') - epoch_us(invoice_date)) / 86400000000.0) AS days
  FROM fx_ap_invoices WHERE payment_status_flag IN ('N', 'P')),
g AS (SELECT DISTINCT org_id, invoice_currency_code FROM u),
b AS (SELECT * FROM (VALUES ('0-30 days', -1000000000, 30), ('31-60 days', 30, 60), ('61-90 days', 60, 90), ('91+ days', 90, 1000000000)) AS v(bucket, low, high))
SELECT g.org_id, g.invoice_currency_code, b.bucket, CAST(COALESCE(sum(u.due), 0) AS DOUBLE) AS amount
FROM g CROSS JOIN b LEFT JOIN u ON u.org_id = g.org_id AND u.invoice_currency_code = g.invoice_currency_code AND u.days > b.low AND u.days <= b.high
GROUP BY 1, 2, 3""")
def ap_aging(t):
    rows = finance.aging(t["fx_ap_invoices"], AS_OF, ("org_id", "invoice_currency_code"))
    return rows.withColumn("amount", money("amount"))


POSTED_SQL = """
  SELECT h.ledger_id, h.period_name, l.code_combination_id, l.currency_code,
         COALESCE(sum(l.accounted_dr), 0) AS dr, COALESCE(sum(l.accounted_cr), 0) AS cr, count(*) AS n
  FROM fx_gl_je_lines l JOIN fx_gl_je_headers h ON l.je_header_id = h.je_header_id
  WHERE h.status IN ('P', 'POSTED')
  GROUP BY 1, 2, 3, 4"""


@query("q_gl_period_totals", f"""
SELECT ledger_id, period_name, currency_code, CAST(sum(dr) AS DOUBLE) AS total_dr, CAST(sum(cr) AS DOUBLE) AS total_cr,
       CAST(sum(dr) - sum(cr) AS DOUBLE) AS net, CAST(sum(n) AS BIGINT) AS line_count
FROM ({POSTED_SQL}) GROUP BY 1, 2, 3""")
def gl_period_totals(t):
    rows = finance.period_totals(t["fx_gl_je_headers"], t["fx_gl_je_lines"])
    return rows.withColumns({c: money(c) for c in ("total_dr", "total_cr", "net")})


PROOF_SQL = f"""
  SELECT b.ledger_id, b.code_combination_id, b.currency_code, b.period_name,
         b.begin_balance_dr - b.begin_balance_cr + COALESCE(p.dr - p.cr, 0) AS expected_end, b.reported_end_balance AS reported_end
  FROM fx_gl_balances_close b LEFT JOIN ({POSTED_SQL}) p
    ON b.ledger_id = p.ledger_id AND b.code_combination_id = p.code_combination_id
   AND b.currency_code = p.currency_code AND b.period_name IS NOT DISTINCT FROM p.period_name"""


def exact(column):
    """A decimal of any scale as double for output."""
    return F.col(column).cast("double")


@query("q_gl_balance_proof", f"""
SELECT ledger_id, code_combination_id, currency_code, period_name, CAST(expected_end AS DOUBLE) AS expected_end,
       CAST(reported_end AS DOUBLE) AS reported_end, CAST(expected_end - reported_end AS DOUBLE) AS difference,
       abs(expected_end - reported_end) < 0.01 AS proved
FROM ({PROOF_SQL})""")
def gl_balance_proof(t):
    rows = finance.balance_proof(t["fx_gl_balances_close"], t["fx_gl_je_headers"], t["fx_gl_je_lines"])
    return rows.withColumns({c: exact(c) for c in ("expected_end", "reported_end", "difference")})


@query("q_gl_close", f"""
SELECT COALESCE(x.ledger_id, y.ledger_id) AS ledger_id, COALESCE(x.period_name, y.period_name) AS period_name,
       CAST(COALESCE(x.net, 0) AS DOUBLE) AS discrepancy_amount, COALESCE(x.line_count, 0) AS line_count, COALESCE(y.accounts, 0) AS accounts,
       COALESCE(y.bad, 0) AS accounts_not_proved, abs(COALESCE(x.net, 0)) < 0.01 AND COALESCE(y.bad, 0) = 0 AS is_balanced
FROM (SELECT ledger_id, period_name, sum(dr) - sum(cr) AS net, CAST(sum(n) AS BIGINT) AS line_count FROM ({POSTED_SQL}) GROUP BY 1, 2) x
FULL JOIN (SELECT ledger_id, period_name, count(*) AS accounts,
                  CAST(sum(CASE WHEN abs(expected_end - reported_end) < 0.01 THEN 0 ELSE 1 END) AS BIGINT) AS bad
           FROM ({PROOF_SQL}) GROUP BY 1, 2) y ON x.ledger_id = y.ledger_id AND x.period_name IS NOT DISTINCT FROM y.period_name""")
def gl_close(t):
    rows = finance.period_close(t["fx_gl_je_headers"], t["fx_gl_je_lines"], t["fx_gl_balances_close"])
    return rows.withColumn("discrepancy_amount", money("discrepancy_amount"))


@query("q_gl_unbalanced", """
SELECT je_header_id, CAST(COALESCE(sum(accounted_dr), 0) AS DOUBLE) AS total_dr, CAST(COALESCE(sum(accounted_cr), 0) AS DOUBLE) AS total_cr, count(*) AS line_count
FROM fx_gl_je_lines GROUP BY 1 HAVING COALESCE(sum(accounted_dr), 0) <> COALESCE(sum(accounted_cr), 0)""")
def gl_unbalanced(t):
    rows = finance.unbalanced_journals(t["fx_gl_je_lines"])
    return rows.withColumns({c: money(c) for c in ("total_dr", "total_cr")})


@query("q_ap_duplicates", """
SELECT vendor_id, invoice_num, CAST(invoice_amount AS DOUBLE) AS invoice_amount, count(*) AS copies,
       min(invoice_id) AS first_invoice_id, max(invoice_id) AS last_invoice_id
FROM fx_ap_invoices WHERE vendor_id IS NOT NULL
GROUP BY vendor_id, invoice_num, invoice_amount HAVING count(*) > 1""")
def ap_duplicates(t):
    rows = finance.duplicate_invoices(t["fx_ap_invoices"])
    return rows.withColumn("invoice_amount", money("invoice_amount"))


@query("q_ap_near_duplicates", """
WITH k AS (SELECT vendor_id, invoice_num, invoice_amount, count(*) AS copies, min(invoice_id) AS first_id FROM fx_ap_invoices_typo
           WHERE vendor_id IS NOT NULL AND invoice_num IS NOT NULL AND invoice_amount IS NOT NULL GROUP BY 1, 2, 3)
SELECT a.vendor_id, a.invoice_num, CAST(a.invoice_amount AS DOUBLE) AS invoice_amount, any_value(a.copies) AS copies, count(*) AS near, min(b.first_id) AS first_near_id
FROM k a JOIN k b ON a.vendor_id = b.vendor_id AND a.invoice_num <> b.invoice_num
WHERE levenshtein(a.invoice_num, b.invoice_num) <= 1 AND abs(a.invoice_amount - b.invoice_amount) <= 1.00
GROUP BY a.vendor_id, a.invoice_num, a.invoice_amount""")
def ap_near_duplicates(t):
    return finance.near_duplicate_invoices(t["fx_ap_invoices_typo"]).withColumn("invoice_amount", money("invoice_amount"))


@query("q_ap_outliers", """
WITH s AS (
  SELECT vendor_id, avg(CAST(invoice_amount AS DOUBLE)) AS mean, stddev_samp(CAST(invoice_amount AS DOUBLE)) AS spread
  FROM fx_ap_invoices_regular WHERE vendor_id IS NOT NULL AND invoice_amount IS NOT NULL
  GROUP BY 1 HAVING min(invoice_amount) < max(invoice_amount))
SELECT i.invoice_id, i.vendor_id, CAST(i.invoice_amount AS DOUBLE) AS invoice_amount
FROM fx_ap_invoices_regular i JOIN s ON i.vendor_id = s.vendor_id
WHERE abs(CAST(i.invoice_amount AS DOUBLE) - s.mean) > 3.0 * s.spread""")
def ap_outliers(t):
    return finance.outlier_invoices(t["fx_ap_invoices_regular"]).select(
        "invoice_id", "vendor_id", money("invoice_amount").alias("invoice_amount")
    )


@query("q_gold_trial_balance", f"""
SELECT p.ledger_id, p.period_name, c.segment1 AS company,
       CAST(GROUPING(p.ledger_id) * 4 + GROUPING(p.period_name) * 2 + GROUPING(c.segment1) AS BIGINT) AS level,
       CAST(sum(p.dr) AS DOUBLE) AS total_dr, CAST(sum(p.cr) AS DOUBLE) AS total_cr, CAST(sum(p.dr) - sum(p.cr) AS DOUBLE) AS net
FROM ({POSTED_SQL}) p JOIN fx_gl_code_combinations c ON p.code_combination_id = c.code_combination_id
GROUP BY ROLLUP (p.ledger_id, p.period_name, c.segment1)""")
def gold_trial_balance(t):
    rows = finance.trial_balance(
        t["fx_gl_je_headers"], t["fx_gl_je_lines"], t["fx_gl_code_combinations"]
    )
    return rows.withColumns({c: money(c) for c in ("total_dr", "total_cr", "net")})


@query("q_gold_ap_vendor", """
SELECT i.vendor_id, i.invoice_currency_code, s.vendor_name, i.invoice_count, i.invoice_amount, i.amount_paid, i.amount_open,
       i.first_invoice, i.last_invoice
FROM (SELECT vendor_id, invoice_currency_code, count(*) AS invoice_count, CAST(sum(invoice_amount) AS DOUBLE) AS invoice_amount,
             CAST(sum(amount_paid) AS DOUBLE) AS amount_paid, CAST(sum(invoice_amount - amount_paid) AS DOUBLE) AS amount_open,
             strftime(min(invoice_date), '%Y-%m-%d %H:%M:%S') AS first_invoice, strftime(max(invoice_date), '%Y-%m-%d %H:%M:%S') AS last_invoice
      FROM fx_ap_invoices GROUP BY 1, 2) i
LEFT JOIN fx_ap_suppliers s ON i.vendor_id = s.vendor_id""")
def gold_ap_vendor(t):
    rows = finance.vendor_mart(t["fx_ap_invoices"], t["fx_ap_suppliers"])
    return rows.withColumns(
        {
            **{c: money(c) for c in ("invoice_amount", "amount_paid", "amount_open")},
            "first_invoice": moment("first_invoice"), "last_invoice": moment("last_invoice"),
        }
    )


def _settled(name, rows, cell):
    """The lines of `rows` with the rank and the pairs of their cell, as text of a query."""
    return f"""
{name} AS (SELECT *, row_number() OVER (PARTITION BY side, account, cell ORDER BY line_id % 64, amount, line_id) AS r,
                  least(count(*) FILTER (side = 'source') OVER (PARTITION BY account, cell), count(*) FILTER (side = 'target') OVER (PARTITION BY account, cell)) AS pairs
           FROM (SELECT side, account, line_id, amount, grp, {cell} AS cell FROM ({rows}) AS x) AS y)"""


def _left(name):
    return f"SELECT side, account, line_id, amount, grp FROM {name} WHERE r > pairs"


_CENTS = "CAST(amount * 100 AS BIGINT)"
UNRECONCILED_SQL = f"""
WITH lines AS (
  SELECT 'source' AS side, account, line_id, amount, je_header_id AS grp FROM fx_ledger_lines
  UNION ALL SELECT 'target', account, line_id, amount, NULL FROM fx_statement_lines),
{_settled("e", "SELECT * FROM lines WHERE amount IS NOT NULL", _CENTS)},
{_settled("n", _left("e"), f"floor({_CENTS} / 5.0)")},
{_settled("m", _left("n"), f"floor(({_CENTS} + 2.5) / 5.0)")},
l AS ({_left("m")}),
g AS (SELECT account, grp, count(*) AS n, sum(amount) AS amount, min(line_id) AS line_id FROM l WHERE side = 'source' GROUP BY account, grp),
{_settled("s", "SELECT 'source' AS side, account, line_id, amount, grp FROM g WHERE n BETWEEN 2 AND 50 UNION ALL SELECT * FROM l WHERE side = 'target'", _CENTS)}
SELECT side, account, line_id, CAST(amount AS DOUBLE) AS amount, 'left' AS match FROM s WHERE side = 'target' AND r > pairs
UNION ALL
SELECT 'source', account, line_id, CAST(amount AS DOUBLE), 'left' FROM l
WHERE side = 'source' AND (account, grp) NOT IN (SELECT (account, grp) FROM s WHERE side = 'source' AND r <= pairs)
UNION ALL
SELECT side, account, line_id, NULL, 'left' FROM lines WHERE amount IS NULL
UNION ALL
SELECT side, NULL, count(*), CAST(sum(amount) AS DOUBLE), 'near' FROM (SELECT * FROM n WHERE r <= pairs UNION ALL SELECT * FROM m WHERE r <= pairs) GROUP BY side
UNION ALL
SELECT side, NULL, count(*), CAST(sum(amount) AS DOUBLE), 'exact' FROM e WHERE r <= pairs GROUP BY side
UNION ALL
SELECT 'target', NULL, count(*), CAST(sum(amount) AS DOUBLE), 'sum' FROM s WHERE side = 'target' AND r <= pairs HAVING count(*) > 0"""


@query("q_gl_unreconciled_lines", UNRECONCILED_SQL)
def gl_unreconciled_lines(t):
    """Ledger lines and statement lines that nothing settles, and totals of the others."""
    found = matching.match_lines(t["fx_ledger_lines"], t["fx_statement_lines"], ["account"], "0.05", group="je_header_id")
    left = found.where("match IS NULL").select("side", "account", "line_id", money("amount").alias("amount"), F.lit("left").alias("match"))
    counted = found.where("match IS NOT NULL AND NOT (match = 'sum' AND side = 'source')")
    totals = counted.groupBy("side", "match").agg(F.count("*").alias("line_id"), F.sum("amount").alias("amount"))
    return left.unionByName(
        totals.select("side", F.lit(None).cast("bigint").alias("account"), "line_id", money("amount").alias("amount"), "match"))


@query("q_gold_hcm_headcount", """
WITH m AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2021-01-01', TIMESTAMP '2022-02-01', INTERVAL 1 MONTH)) AS DATE) AS month),
v AS (SELECT *, CAST(effective_start_date AS DATE) AS s, CAST(effective_end_date AS DATE) AS e FROM fx_people_versions),
a AS (SELECT first_name, month, count(DISTINCT person_id) AS n FROM m JOIN v ON last_day(month) BETWEEN s AND e GROUP BY 1, 2),
j AS (SELECT first_name, CAST(date_trunc('month', s) AS DATE) AS month, count(*) AS n FROM v x
      WHERE s BETWEEN DATE '2021-01-01' AND DATE '2022-02-28' AND NOT EXISTS (SELECT 1 FROM v y WHERE y.person_id = x.person_id AND y.e = x.s - 1) GROUP BY 1, 2),
l AS (SELECT first_name, CAST(date_trunc('month', e) AS DATE) AS month, count(*) AS n FROM v x
      WHERE e BETWEEN DATE '2021-01-01' AND DATE '2022-02-28' AND NOT EXISTS (SELECT 1 FROM v y WHERE y.person_id = x.person_id AND y.s = x.e + 1) GROUP BY 1, 2)
SELECT first_name, CAST(month AS VARCHAR) AS month, CAST(sum(act) AS BIGINT) AS active, CAST(sum(j) AS BIGINT) AS joined, CAST(sum(l) AS BIGINT) AS "left"
FROM (SELECT first_name, month, n AS act, 0 AS j, 0 AS l FROM a UNION ALL SELECT first_name, month, 0, n, 0 FROM j UNION ALL SELECT first_name, month, 0, 0, n FROM l)
GROUP BY first_name, month""")
def gold_hcm_headcount(t):
    found = finance.gold_headcount(t["fx_people_versions"], "2021-01-01", "2022-02-01")
    return found.withColumn("month", F.col("month").cast("string"))
