"""Queries: data quality, reconciliation, certificates, a whole migration run."""

from __future__ import annotations

from pyspark.sql import functions as F

from closebook.model import DEFAULT_RULES, Rule
from closebook.operators import catalog, lineage, quality, reconcile
from closebook.plans.migrate import migrate
from closebook.plans.registry import money, query
from closebook.session import scratch_path

RULES = {r.rule_id: r for r in DEFAULT_RULES}


def source_tables(t):
    return {
        "GL_JE_HEADERS": t["fx_gl_je_headers"],
        "GL_JE_LINES": t["fx_gl_je_lines"],
        "AP_INVOICES_ALL": t["fx_ap_invoices"],
        "PER_ALL_PEOPLE_F": t["fx_people"],
    }


def _rule_sql(rule: Rule, count: str, table: str, message: str) -> str:
    """SQL for one rule result from a count and the message of a failure."""
    column = f"'{rule.column_name}'" if rule.column_name else "CAST(NULL AS VARCHAR)"
    return f"""SELECT '{rule.rule_id}' AS rule_id, '{rule.rule_name}' AS rule_name, '{rule.module}' AS module, '{rule.severity}' AS severity,
       '{rule.rule_type}' AS rule_type, '{rule.table_name}' AS table_name, {column} AS column_name, n = 0 AS passed, n AS violations_count,
       CASE WHEN n = 0 THEN '' ELSE {message} END AS message
FROM (SELECT {count} FROM {table})"""


def _row_sql(rule, condition, table):
    return _rule_sql(
        rule, f"CAST(COALESCE(sum(CASE WHEN {condition} THEN 1 ELSE 0 END), 0) AS BIGINT) AS n", table,
        f"CAST(n AS VARCHAR) || ' row(s) violate {rule.rule_name}'",
    )


def _unique_sql(rule, column, table):
    return _rule_sql(
        rule, f"CAST(count({column}) - count(DISTINCT {column}) AS BIGINT) AS n", table,
        f"CAST(n AS VARCHAR) || ' duplicate(s) found for {rule.column_name}'",
    )


def _orphan_sql(rule, column, table, ref_column, ref_table):
    return _rule_sql(
        rule, "CAST(count(*) AS BIGINT) AS n",
        f"(SELECT * FROM {table} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {ref_column} FROM {ref_table}))",
        f"CAST(n AS VARCHAR) || ' orphan(s) for {rule.column_name}'",
    )


def _balance_sql(rule, table):
    return _rule_sql(
        rule,
        "CAST(CASE WHEN dr = cr THEN 0 ELSE 1 END AS BIGINT) AS n, dr, cr",
        f"(SELECT COALESCE(sum(accounted_dr), 0) AS dr, COALESCE(sum(accounted_cr), 0) AS cr FROM {table})",
        "'Imbalance: DR=' || CAST(dr AS VARCHAR) || ' CR=' || CAST(cr AS VARCHAR) || ' diff=' || CAST(dr - cr AS VARCHAR)",
    )


VENDOR_RULE = Rule("ap_known_vendor", "AP Known Vendor", "AP", "ERROR", "referential",
                   "AP_INVOICES_ALL", "VENDOR_ID", reference_table="AP_SUPPLIERS")
RANGE_RULE = Rule("ap_amount_range", "AP Amount Range", "AP", "ERROR", "range",
                  "AP_INVOICES_ALL", "INVOICE_AMOUNT", min_value="0", max_value="400000")
TEXT_RANGE_RULE = Rule("ap_text_amount", "AP Text Amount", "AP", "WARNING", "range",
                       "AP_INVOICES_ALL", "AMOUNT_TEXT", min_value="0")
CUSTOM_RULE = Rule("ap_paid_at_most", "AP Paid At Most Invoiced", "AP", "WARNING", "custom_sql",
                   "AP_INVOICES_ALL", expression="amount_paid <= invoice_amount")
NUMBER_RULE = Rule("ap_unique_num", "AP Unique Invoice Number", "AP", "WARNING", "uniqueness",
                   "AP_INVOICES_ALL", "INVOICE_NUM")

SQL = {
    "gl_balance_check": _balance_sql(RULES["gl_balance_check"], "fx_gl_je_lines"),
    "gl_no_null_amounts": _row_sql(
        RULES["gl_no_null_amounts"], "accounted_dr IS NULL AND accounted_cr IS NULL", "fx_gl_je_lines"),
    "gl_valid_period": _row_sql(
        RULES["gl_valid_period"], "period_name IS NULL OR trim(period_name) = ''", "fx_gl_je_headers"),
    "ap_positive_amounts": _row_sql(RULES["ap_positive_amounts"], "invoice_amount < 0", "fx_ap_invoices"),
    "ap_valid_vendor": _row_sql(RULES["ap_valid_vendor"], "vendor_id IS NULL", "fx_ap_invoices"),
    "ap_valid_dates": _row_sql(
        RULES["ap_valid_dates"], "invoice_date IS NULL OR gl_date IS NULL", "fx_ap_invoices"),
    "hcm_unique_employee_num": _unique_sql(
        RULES["hcm_unique_employee_num"], "employee_number", "fx_people"),
    "hcm_valid_names": _row_sql(
        RULES["hcm_valid_names"], "last_name IS NULL OR trim(last_name, ' ' || chr(160)) = ''", "fx_people"),
    "hcm_valid_hire_date": _row_sql(
        RULES["hcm_valid_hire_date"], "original_date_of_hire IS NULL", "fx_people"),
    "ap_known_vendor": _orphan_sql(
        VENDOR_RULE, "vendor_id", "fx_ap_invoices", "vendor_id", "fx_ap_suppliers"),
    "ap_amount_range": _row_sql(
        RANGE_RULE, "invoice_amount < 0 OR invoice_amount > 400000", "fx_ap_invoices"),
    "ap_text_amount": _row_sql(
        TEXT_RANGE_RULE, "invoice_id % 41 = 0 OR invoice_amount < 0", "fx_ap_invoices"),
    "ap_paid_at_most": _row_sql(
        CUSTOM_RULE, "NOT (amount_paid <= invoice_amount)", "fx_ap_invoices"),
    "ap_unique_num": _unique_sql(NUMBER_RULE, "invoice_num", "fx_ap_invoices"),
}


@query("q_dq_not_null", SQL["ap_valid_vendor"] + "\nUNION ALL\n" + SQL["hcm_valid_names"])
def dq_not_null(t):
    return quality.evaluate_rules(
        "ALL", source_tables(t), [RULES["ap_valid_vendor"], RULES["hcm_valid_names"]]
    )


@query("q_dq_any_of", SQL["gl_no_null_amounts"])
def dq_any_of(t):
    return quality.evaluate_rules("GL", t["fx_gl_je_lines"], [RULES["gl_no_null_amounts"]])


@query("q_dq_all_of", SQL["ap_valid_dates"])
def dq_all_of(t):
    return quality.evaluate_rules("AP", t["fx_ap_invoices"], [RULES["ap_valid_dates"]])


@query("q_dq_range", SQL["ap_amount_range"] + "\nUNION ALL\n" + SQL["ap_text_amount"])
def dq_range(t):
    text = F.when(F.col("invoice_id") % 41 == 0, "n/a").otherwise(F.col("invoice_amount").cast("string"))
    return quality.evaluate_rules(
        "AP", t["fx_ap_invoices"].withColumn("amount_text", text), [RANGE_RULE, TEXT_RANGE_RULE]
    )


@query("q_dq_unique", SQL["hcm_unique_employee_num"] + "\nUNION ALL\n" + SQL["ap_unique_num"])
def dq_unique(t):
    return quality.evaluate_rules(
        "ALL", source_tables(t), [RULES["hcm_unique_employee_num"], NUMBER_RULE]
    )


@query("q_dq_referential", SQL["ap_known_vendor"])
def dq_referential(t):
    return quality.evaluate_rules(
        "AP", t["fx_ap_invoices"], [VENDOR_RULE], {"AP_SUPPLIERS": t["fx_ap_suppliers"]}
    )


@query("q_dq_orphan_rows", """
SELECT invoice_id, vendor_id, invoice_num FROM fx_ap_invoices
WHERE vendor_id IS NOT NULL AND vendor_id NOT IN (SELECT vendor_id FROM fx_ap_suppliers)""")
def dq_orphan_rows(t):
    return quality.violations(
        VENDOR_RULE, t["fx_ap_invoices"], ["invoice_id"], t["fx_ap_suppliers"]
    ).select("invoice_id", "vendor_id", "invoice_num")


@query("q_dq_repeat_rows", """
SELECT invoice_id, invoice_num FROM (
  SELECT invoice_id, invoice_num, row_number() OVER (PARTITION BY invoice_num ORDER BY invoice_id) AS rn
  FROM fx_ap_invoices WHERE invoice_num IS NOT NULL) WHERE rn > 1""")
def dq_repeat_rows(t):
    return quality.violations(NUMBER_RULE, t["fx_ap_invoices"], ["invoice_id"]).select(
        "invoice_id", "invoice_num"
    )


@query("q_dq_samples", """
SELECT 'ap_positive_amounts' AS rule_id, invoice_id FROM fx_ap_invoices WHERE invoice_amount < 0 ORDER BY invoice_id LIMIT 10""")
def dq_samples(t):
    return quality.sample_violations(
        RULES["ap_positive_amounts"], t["fx_ap_invoices"], ["invoice_id"]
    ).select("rule_id", "invoice_id")


SAMPLED = ["ap_positive_amounts", "ap_valid_vendor", "ap_known_vendor"]
_BROKEN = {
    "ap_positive_amounts": "invoice_amount < 0", "ap_valid_vendor": "vendor_id IS NULL",
    "ap_known_vendor": "vendor_id IS NOT NULL AND vendor_id NOT IN (SELECT vendor_id FROM fx_ap_suppliers)",
}


@query("q_dq_report_samples", "\nUNION ALL\n".join(f"""
SELECT '{rule}' AS rule_id, (SELECT count(*) FROM fx_ap_invoices WHERE {_BROKEN[rule]}) AS violations_count,
       COALESCE(string_agg(CAST(invoice_id AS VARCHAR), ',' ORDER BY invoice_id), '') AS first_invoices
FROM (SELECT invoice_id FROM fx_ap_invoices WHERE {_BROKEN[rule]} ORDER BY invoice_id LIMIT 10)""" for rule in SAMPLED))
def dq_report_samples(t):
    rules = [RULES["ap_positive_amounts"], RULES["ap_valid_vendor"], VENDOR_RULE]
    reference = {"AP_SUPPLIERS": t["fx_ap_suppliers"]}
    results = quality.evaluate_rules("AP", t["fx_ap_invoices"], rules, reference)
    rows = quality.with_samples(
        results, t["fx_ap_invoices"], rules, {"AP_INVOICES_ALL": ["invoice_id"]}, reference
    )
    ids = F.transform("samples", lambda x: F.get_json_object(x, "$.invoice_id"))
    return rows.select("rule_id", "violations_count", F.array_join(ids, ",").alias("first_invoices"))


@query("q_dq_balance", SQL["gl_balance_check"])
def dq_balance(t):
    return quality.evaluate_rules("GL", t["fx_gl_je_lines"], [RULES["gl_balance_check"]])


@query("q_dq_custom", SQL["ap_paid_at_most"])
def dq_custom(t):
    return quality.evaluate_rules("AP", t["fx_ap_invoices"], [CUSTOM_RULE])


REPORT_RULES = [*DEFAULT_RULES, VENDOR_RULE, RANGE_RULE, CUSTOM_RULE, NUMBER_RULE]
REPORT_SQL = "\nUNION ALL\n".join(SQL[r.rule_id] for r in REPORT_RULES)


def report(t):
    return quality.evaluate_rules(
        "ALL", source_tables(t), REPORT_RULES, {"AP_SUPPLIERS": t["fx_ap_suppliers"]}
    )


@query("q_dq_report", REPORT_SQL)
def dq_report(t):
    return report(t)


@query("q_dq_summary", f"""
SELECT module, count(*) AS rules_evaluated, CAST(count(*) FILTER (passed) AS BIGINT) AS rules_passed,
       CAST(count(*) FILTER (NOT passed AND severity = 'ERROR') AS BIGINT) AS rules_failed,
       CAST(count(*) FILTER (NOT passed AND severity IN ('WARNING', 'INFO')) AS BIGINT) AS rules_warned,
       CAST(count(*) FILTER (passed) AS DOUBLE) / count(*) AS pass_rate,
       count(*) FILTER (NOT passed AND severity = 'ERROR') > 0 AS has_errors
FROM ({REPORT_SQL}) GROUP BY module""")
def dq_summary(t):
    return quality.summarize(report(t), ["module"])


def _key_rule(kind, rule_type, module, table, column):
    return Rule(f"{kind}_{table}_{column}".lower(), f"{table}.{column} {kind}", module, "ERROR", rule_type, table, column)


KEY_SQL = [
    _unique_sql(_key_rule("unique", "uniqueness", "AP", "AP_INVOICES_ALL", "INVOICE_ID"), "invoice_id", "fx_ap_invoices"),
    _row_sql(_key_rule("not_null", "not_null", "AP", "AP_INVOICES_ALL", "INVOICE_ID"), "invoice_id IS NULL", "fx_ap_invoices"),
    _unique_sql(_key_rule("unique", "uniqueness", "GL", "GL_JE_HEADERS", "JE_HEADER_ID"), "je_header_id", "fx_gl_je_headers"),
    _row_sql(_key_rule("not_null", "not_null", "GL", "GL_JE_HEADERS", "JE_HEADER_ID"), "je_header_id IS NULL", "fx_gl_je_headers"),
    _unique_sql(_key_rule("unique", "uniqueness", "GL", "GL_JE_LINES", "JE_HEADER_ID"), "je_header_id", "fx_gl_je_lines"),
    _row_sql(_key_rule("not_null", "not_null", "GL", "GL_JE_LINES", "JE_HEADER_ID"), "je_header_id IS NULL", "fx_gl_je_lines"),
    _unique_sql(_key_rule("unique", "uniqueness", "HCM", "PER_ALL_PEOPLE_F", "PERSON_ID"), "person_id", "fx_people"),
    _row_sql(_key_rule("not_null", "not_null", "HCM", "PER_ALL_PEOPLE_F", "PERSON_ID"), "person_id IS NULL", "fx_people"),
]


@query("q_dq_from_catalog", "\nUNION ALL\n".join(KEY_SQL))
def dq_from_catalog(t):
    keys = catalog.primary_keys(t["fx_dict_constraints"], t["fx_dict_cons_columns"])
    return quality.evaluate_rules("ALL", source_tables(t), quality.key_rules(keys))


COMPOSITE = [
    Rule("unique_gl_je_lines_je_header_id_je_line_num", "GL_JE_LINES.JE_HEADER_ID,JE_LINE_NUM unique", "GL", "ERROR", "uniqueness",
         "GL_JE_LINES", "JE_HEADER_ID,JE_LINE_NUM", ("JE_HEADER_ID", "JE_LINE_NUM")),
    Rule("not_null_gl_je_lines_je_header_id", "GL_JE_LINES.JE_HEADER_ID not_null", "GL", "ERROR", "not_null", "GL_JE_LINES", "JE_HEADER_ID"),
    Rule("not_null_gl_je_lines_je_line_num", "GL_JE_LINES.JE_LINE_NUM not_null", "GL", "ERROR", "not_null", "GL_JE_LINES", "JE_LINE_NUM"),
]


@query("q_dq_composite_key", "\nUNION ALL\n".join([
    _rule_sql(
        COMPOSITE[0], "CAST(count(*) - count(DISTINCT (je_header_id, je_line_num)) AS BIGINT) AS n",
        "(SELECT * FROM fx_gl_je_lines WHERE je_header_id IS NOT NULL AND je_line_num IS NOT NULL)",
        "CAST(n AS VARCHAR) || ' duplicate(s) found for JE_HEADER_ID,JE_LINE_NUM'"),
    _row_sql(COMPOSITE[1], "je_header_id IS NULL", "fx_gl_je_lines"), _row_sql(COMPOSITE[2], "je_line_num IS NULL", "fx_gl_je_lines"),
]))
def dq_composite_key(t):
    """A key of two columns is one rule over both; the table's rows repeat in neither alone."""
    keys = t.spark.createDataFrame(
        [("APPS", "GL_JE_LINES", "JE_HEADER_ID", 1), ("APPS", "GL_JE_LINES", "JE_LINE_NUM", 2)],
        "owner string, table_name string, column_name string, position int")
    return quality.evaluate_rules("ALL", source_tables(t), quality.key_rules(keys))


WIDE_RULE = Rule("ap_wide_number", "Wide Numbers", "AP", "ERROR", "range", "AP_INVOICES_ALL", "WIDE", min_value="1e25",
                 max_value="10000000000000000000000000.0000000000000000000000000002")


@query("q_dq_range_wide", _row_sql(WIDE_RULE, "invoice_id % 5 IN (0, 3, 4)", "fx_ap_invoices"))
def dq_range_wide(t):
    """Bounds and values of more digits than any number type holds."""
    whole, n = "1" + "0" * 25, F.col("invoice_id") % 5
    wide = (
        F.when(n == 0, F.lit("9" * 25 + "." + "9" * 30)).when(n == 1, F.lit(whole)).when(n == 2, F.lit(f"+{whole}." + "0" * 27 + "20"))
        .when(n == 3, F.lit(f"{whole}." + "0" * 27 + "3")).otherwise(F.lit("1.00000000000000000000000000000001E25").substr(1, 40))
    )
    return quality.evaluate_rules("AP", t["fx_ap_invoices"].withColumn("wide", wide), [WIDE_RULE])


# ---- Reconciliation ----


@query("q_recon_counts", """
SELECT COALESCE(s.org_id, x.org_id) AS org_id, COALESCE(s.n, 0) AS s_count, COALESCE(x.n, 0) AS t_count, COALESCE(s.n, 0) = COALESCE(x.n, 0) AS passed
FROM (SELECT org_id, count(*) AS n FROM fx_ap_invoices GROUP BY 1) s
FULL JOIN (SELECT org_id, count(*) AS n FROM fx_ap_invoices_tgt GROUP BY 1) x ON s.org_id = x.org_id""")
def recon_counts(t):
    return reconcile.compare_groups(t["fx_ap_invoices"], t["fx_ap_invoices_tgt"], ["org_id"])


@query("q_recon_sums", """
SELECT COALESCE(s.org_id, x.org_id) AS org_id, COALESCE(s.cur, x.cur) AS invoice_currency_code,
       CAST(COALESCE(s.v, 0) AS DOUBLE) AS s_invoice_amount, CAST(COALESCE(x.v, 0) AS DOUBLE) AS t_invoice_amount,
       abs(COALESCE(s.v, 0) - COALESCE(x.v, 0)) <= 0.01 AS passed
FROM (SELECT org_id, invoice_currency_code AS cur, sum(invoice_amount) AS v FROM fx_ap_invoices GROUP BY 1, 2) s
FULL JOIN (SELECT org_id, invoice_currency_code AS cur, sum(invoice_amount) AS v FROM fx_ap_invoices_tgt GROUP BY 1, 2) x
  ON s.org_id = x.org_id AND s.cur = x.cur""")
def recon_sums(t):
    rows = reconcile.compare_groups(
        t["fx_ap_invoices"], t["fx_ap_invoices_tgt"], ["org_id", "invoice_currency_code"],
        count=False, sums=["invoice_amount"],
    )
    return rows.withColumns(
        {c: money(c) for c in ("s_invoice_amount", "t_invoice_amount")}
    )


SUMMED = ["invoice_id", "invoice_num", "vendor_id", "invoice_amount", "payment_status_flag"]


def _digest_sql(columns):
    parts = " || '|' || ".join(
        f"COALESCE(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), 'N')"
        for c in columns
    )
    return f"CAST('0x' || substr(md5({parts}), 1, 12) AS BIGINT)"


@query("q_recon_checksum", f"""
SELECT s.org_id, CAST(s.v AS VARCHAR) AS s_checksum, CAST(x.v AS VARCHAR) AS t_checksum, s.v = x.v AND s.n = x.n AS passed
FROM (SELECT org_id, count(*) AS n, sum({_digest_sql(SUMMED)}) AS v FROM fx_ap_invoices GROUP BY 1) s
JOIN (SELECT org_id, count(*) AS n, sum({_digest_sql(SUMMED)}) AS v FROM fx_ap_invoices_tgt GROUP BY 1) x ON s.org_id = x.org_id""")
def recon_checksum(t):
    rows = reconcile.compare_groups(
        t["fx_ap_invoices"], t["fx_ap_invoices_tgt"], ["org_id"], checksum=SUMMED
    )
    return rows.select(
        "org_id", F.col("s_checksum").cast("string").alias("s_checksum"),
        F.col("t_checksum").cast("string").alias("t_checksum"), "passed",
    )


@query("q_recon_checks", """
WITH c AS (
  SELECT s.vendor_id, CAST(s.v AS DECIMAL(38,9)) AS sv, CAST(COALESCE(x.v, 0) AS DECIMAL(38,9)) AS tv
  FROM (SELECT vendor_id, sum(invoice_amount) AS v FROM fx_ap_invoices WHERE vendor_id IS NOT NULL GROUP BY 1) s
  LEFT JOIN (SELECT vendor_id, sum(invoice_amount) AS v FROM fx_ap_invoices_tgt GROUP BY 1) x ON s.vendor_id = x.vendor_id)
SELECT vendor_id, CAST(CAST(sv AS DECIMAL(38,2)) AS DOUBLE) AS source_value, CAST(CAST(tv AS DECIMAL(38,2)) AS DOUBLE) AS target_value,
       CAST(CAST(abs(sv - tv) AS DECIMAL(38,2)) AS DOUBLE) AS variance,
       round(CASE WHEN sv = 0 THEN CASE WHEN tv = 0 THEN 0.0 ELSE 100.0 END
            ELSE abs(CAST(CAST(sv AS DECIMAL(38,2)) AS DOUBLE) - CAST(CAST(tv AS DECIMAL(38,2)) AS DOUBLE)) / abs(CAST(CAST(sv AS DECIMAL(38,2)) AS DOUBLE)) * 100 END, 6) AS variance_pct,
       abs(sv - tv) <= 0.01 AS passed
FROM c""")
def recon_checks(t):
    """One sum check per vendor."""
    both = reconcile.compare_groups(
        t["fx_ap_invoices"].where("vendor_id IS NOT NULL"),
        t["fx_ap_invoices_tgt"].where("vendor_id IS NOT NULL"),
        ["vendor_id"], count=False, sums=["invoice_amount"],
    )
    checks = both.select(
        "vendor_id",
        F.col("s_invoice_amount").cast("decimal(38,9)").alias("source_value"),
        F.col("t_invoice_amount").cast("decimal(38,9)").alias("target_value"),
        F.lit("0.01").cast("decimal(38,9)").alias("tolerance"),
    )
    return reconcile.evaluate_checks(checks).select(
        "vendor_id", money("source_value").alias("source_value"),
        money("target_value").alias("target_value"), money("variance").alias("variance"),
        F.round("variance_pct", 6).alias("variance_pct"), "passed",
    )


def module_tables(t):
    """Source and lake side of the three modules; the lake's invoices have drifted."""
    source = {
        "GL_JE_HEADERS": t["fx_gl_je_headers"], "GL_JE_LINES": t["fx_gl_je_lines"],
        "AP_INVOICES_ALL": t["fx_ap_invoices"], "AP_INVOICE_LINES_ALL": t["fx_ap_invoice_lines"],
        "PER_ALL_PEOPLE_F": t["fx_people"],
    }
    target = {
        "gl_je_headers": t["fx_gl_je_headers"], "gl_je_lines": t["fx_gl_je_lines"],
        "ap_invoices": t["fx_ap_invoices_tgt"], "ap_invoice_lines": t["fx_ap_invoice_lines_tgt"],
        "per_all_people_f": t["fx_people"],
    }
    return source, target


def _check_sql(module, check_type, source_label, target_label, s, x, tolerance):
    return f"""SELECT '{module}' AS module, '{check_type}' AS check_type, '{source_label}' AS source_label, '{target_label}' AS target_label,
       CAST(({s}) AS DOUBLE) AS source_value, CAST(({x}) AS DOUBLE) AS target_value, ({s}) - ({x}) BETWEEN -{tolerance} AND {tolerance} AS passed"""


def _count(view):
    return f"SELECT count(*) FROM {view}"


def _sum(view, column):
    return f"SELECT COALESCE(sum({column}), 0) FROM {view}"


MODULE_SQL = "\nUNION ALL\n".join([
    _check_sql("GL", "row_count", "Oracle GL_JE_HEADERS", "Lake bronze.gl_je_headers", _count("fx_gl_je_headers"), _count("fx_gl_je_headers"), 0),
    _check_sql("GL", "row_count", "Oracle GL_JE_LINES", "Lake bronze.gl_je_lines", _count("fx_gl_je_lines"), _count("fx_gl_je_lines"), 0),
    _check_sql("GL", "aggregate_balance", "Oracle GL_JE_LINES.ACCOUNTED_DR", "Lake gl_je_lines.accounted_dr", _sum("fx_gl_je_lines", "accounted_dr"), _sum("fx_gl_je_lines", "accounted_dr"), 0.01),
    _check_sql("GL", "aggregate_balance", "Oracle GL_JE_LINES.ACCOUNTED_CR", "Lake gl_je_lines.accounted_cr", _sum("fx_gl_je_lines", "accounted_cr"), _sum("fx_gl_je_lines", "accounted_cr"), 0.01),
    _check_sql("AP", "row_count", "Oracle AP_INVOICES_ALL", "Lake bronze.ap_invoices", _count("fx_ap_invoices"), _count("fx_ap_invoices_tgt"), 0),
    _check_sql("AP", "row_count", "Oracle AP_INVOICE_LINES_ALL", "Lake bronze.ap_invoice_lines", _count("fx_ap_invoice_lines"), _count("fx_ap_invoice_lines_tgt"), 0),
    _check_sql("AP", "aggregate_balance", "Oracle AP_INVOICES_ALL.INVOICE_AMOUNT", "Lake ap_invoices.invoice_amount", _sum("fx_ap_invoices", "invoice_amount"), _sum("fx_ap_invoices_tgt", "invoice_amount"), 0.01),
    _check_sql("HCM", "row_count", "Oracle PER_ALL_PEOPLE_F", "Lake bronze.per_all_people_f", _count("fx_people"), _count("fx_people"), 0),
])


def all_module_checks(t):
    source, target = module_tables(t)
    out = None
    for module in ("GL", "AP", "HCM"):
        rows = reconcile.evaluate_checks(reconcile.run_checks(module, source, target))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("q_recon_module", MODULE_SQL)
def recon_module(t):
    return all_module_checks(t).select(
        "module", "check_type", "source_label", "target_label",
        money("source_value").alias("source_value"), money("target_value").alias("target_value"),
        "passed",
    )


@query("q_certificate", f"""
SELECT 'CERT-AP-2001-08-r1' AS certificate_id, 'AP' AS module, 'Aug-01' AS period_name, count(*) AS total_checks,
       CAST(count(*) FILTER (passed) AS BIGINT) AS passed_checks, CAST(count(*) FILTER (NOT passed) AS BIGINT) AS failed_checks,
       CASE WHEN count(*) FILTER (NOT passed) = 0 THEN 'CERTIFIED' ELSE 'FAILED' END AS status,
       'Certificate CERT-AP-2001-08-r1: AP Aug-01 — ' || CAST(count(*) FILTER (passed) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR)
       || ' checks passed — Status: ' || CASE WHEN count(*) FILTER (NOT passed) = 0 THEN 'CERTIFIED' ELSE 'FAILED' END AS summary
FROM ({MODULE_SQL}) WHERE module = 'AP'""")
def certificate(t):
    source, target = module_tables(t)
    checks = reconcile.evaluate_checks(reconcile.run_checks("AP", source, target))
    return reconcile.certificate(checks, "AP", "Aug-01", 2001, 8, "r1")


COMPARED = ["invoice_num", "vendor_id", "invoice_amount", "payment_status_flag"]


def _rows_of(view):
    """Rows of each key as a sorted list of texts, with the number of them."""
    row = " || '|' || ".join(f"COALESCE(CAST({c} AS VARCHAR), 'null')" for c in COMPARED)
    return f"(SELECT invoice_id, count(*) AS n, list_sort(list({row})) AS r FROM {view} GROUP BY 1)"


ROWDIFF_SQL = f"""
SELECT * FROM (
  SELECT COALESCE(s.invoice_id, x.invoice_id) AS invoice_id,
         CASE WHEN x.invoice_id IS NULL THEN 'missing' WHEN s.invoice_id IS NULL THEN 'extra'
              WHEN s.n > 1 OR x.n > 1 THEN CASE WHEN s.r <> x.r THEN 'repeated' END
              WHEN s.r <> x.r THEN 'changed' END AS status,
         CASE WHEN s.n = 1 AND x.n = 1 THEN 'invoice_amount' ELSE '' END AS changed_columns,
         COALESCE(s.n, 0) AS source_rows, COALESCE(x.n, 0) AS target_rows
  FROM {_rows_of('fx_ap_invoices_rep')} s FULL JOIN {_rows_of('fx_ap_invoices_rep_tgt')} x ON s.invoice_id = x.invoice_id)
WHERE status IS NOT NULL"""


@query("q_recon_rowdiff", ROWDIFF_SQL)
def recon_rowdiff(t):
    return reconcile.row_differences(
        t["fx_ap_invoices_rep"], t["fx_ap_invoices_rep_tgt"], ["invoice_id"], COMPARED
    )


@query("q_recon_located", ROWDIFF_SQL)
def recon_located(t):
    """The same differences, found by digests before whole rows are shuffled."""
    return reconcile.located_differences(
        t["fx_ap_invoices_rep"], t["fx_ap_invoices_rep_tgt"], ["invoice_id"], COMPARED
    )


@query("q_recon_multiset", """
WITH u AS (
  SELECT invoice_id, line_number, amount, description, dist_code_combination_id, 1 AS s, 0 AS x FROM fx_ap_invoice_lines
  UNION ALL
  SELECT invoice_id, line_number, amount, description, dist_code_combination_id, 0, 1 FROM fx_ap_invoice_lines_tgt)
SELECT invoice_id, line_number, CAST(amount AS DOUBLE) AS amount, description, dist_code_combination_id,
       CAST(sum(s) AS BIGINT) AS source_rows, CAST(sum(x) AS BIGINT) AS target_rows
FROM u GROUP BY invoice_id, line_number, amount, description, dist_code_combination_id HAVING sum(s) <> sum(x)""")
def recon_multiset(t):
    rows = reconcile.multiset_differences(
        t["fx_ap_invoice_lines"], t["fx_ap_invoice_lines_tgt"],
        ["invoice_id", "line_number", "amount", "description", "dist_code_combination_id"],
    )
    return rows.withColumn("amount", money("amount"))


@query("q_run_summary", """
SELECT module, count(*) AS total_runs, CAST(sum(rows_extracted) AS BIGINT) AS rows_extracted, CAST(sum(rows_loaded) AS BIGINT) AS rows_loaded,
       round(CAST(count(*) FILTER (reconciliation_passed) AS DOUBLE) / count(*) * 100, 6) AS pass_rate
FROM fx_runs GROUP BY module""")
def run_summary(t):
    return reconcile.run_summary(t["fx_runs"], ["module"]).withColumn(
        "pass_rate", F.round("pass_rate", 6)
    )


@query("q_migration_run", """
SELECT 'check' AS run_id, 'AP' AS module, 'all' AS period_name, true AS success,
       CAST((SELECT count(*) FROM fx_ap_invoices) + (SELECT count(*) FROM fx_ap_invoice_lines WHERE invoice_id IN (SELECT invoice_id FROM fx_ap_invoices))
            + (SELECT count(*) FROM fx_ap_suppliers) AS BIGINT) AS rows_extracted,
       CAST((SELECT count(*) FROM fx_ap_invoices) + (SELECT count(*) FROM fx_ap_invoice_lines WHERE invoice_id IN (SELECT invoice_id FROM fx_ap_invoices))
            + (SELECT count(*) FROM fx_ap_suppliers) AS BIGINT) AS rows_loaded,
       true AS reconciliation_passed, 'CERT-AP-2001-08-check' AS certificate_id, 'CERTIFIED' AS certificate_status,
       'extract,load_bronze,reconcile,certify' AS steps, '' AS errors""")
def migration_run(t):
    sources = {
        "AP_INVOICES_ALL": t["fx_ap_invoices"], "AP_INVOICE_LINES_ALL": t["fx_ap_invoice_lines"],
        "AP_SUPPLIERS": t["fx_ap_suppliers"],
    }
    return migrate(
        t.spark, "AP", sources, scratch_path(t.spark, "migration"), period_year=2001, period_num=8,
        run_id="check",
    ).drop("duration_seconds")


def _as_table(t, name):
    """A view written as a table of its own: extraction and reconciliation both read it."""
    path = scratch_path(t.spark, name)
    t[name].write.parquet(path)
    return t.spark.read.schema(t[name].schema).parquet(path)


@query("q_migration_ledger", """
WITH h AS (SELECT * FROM fx_gl_je_headers WHERE status IN ('P', 'POSTED')),
n AS (SELECT (SELECT count(*) FROM h)
  + (SELECT count(*) FROM fx_gl_je_lines WHERE je_header_id IN (SELECT je_header_id FROM h) AND code_combination_id IN (SELECT code_combination_id FROM fx_gl_code_combinations))
  + (SELECT count(*) FROM fx_gl_balances WHERE code_combination_id IN (SELECT code_combination_id FROM fx_gl_code_combinations))
  + (SELECT count(*) FROM fx_gl_code_combinations) AS n)
SELECT 'check' AS run_id, 'GL' AS module, 'all' AS period_name, true AS success, CAST(n AS BIGINT) AS rows_extracted, CAST(n AS BIGINT) AS rows_loaded,
       true AS reconciliation_passed, 'CERT-GL-2001-08-check' AS certificate_id, 'CERTIFIED' AS certificate_status,
       'extract,load_bronze,reconcile,certify' AS steps, '' AS errors FROM n""")
def migration_ledger(t):
    sources = {
        "GL_JE_HEADERS": t["fx_gl_je_headers"], "GL_JE_LINES": t["fx_gl_je_lines"],
        "GL_BALANCES": _as_table(t, "fx_gl_balances"), "GL_CODE_COMBINATIONS": t["fx_gl_code_combinations"],
    }
    return migrate(
        t.spark, "GL", sources, scratch_path(t.spark, "migration"), period_year=2001, period_num=8,
        run_id="check",
    ).drop("duration_seconds")


@query("q_migration_lost", """
WITH h AS (SELECT * FROM fx_gl_je_headers WHERE status IN ('P', 'POSTED')),
l AS (SELECT l.*, l.code_combination_id IN (SELECT code_combination_id FROM fx_gl_code_combinations WHERE code_combination_id % 50 <> 0) AS known
      FROM fx_gl_je_lines l WHERE je_header_id IN (SELECT je_header_id FROM h)),
b AS (SELECT b.code_combination_id IN (SELECT code_combination_id FROM fx_gl_code_combinations WHERE code_combination_id % 50 <> 0) AS known FROM fx_gl_balances b)
SELECT 'row_count' AS check_type, 'Oracle GL_JE_HEADERS' AS source_label, CAST((SELECT count(*) FROM h) AS DOUBLE) AS source_value,
       CAST((SELECT count(*) FROM h) AS DOUBLE) AS extract_value, CAST((SELECT count(*) FROM h) AS DOUBLE) AS target_value, true AS passed, 'FAILED' AS status
UNION ALL
SELECT 'row_count', 'Oracle GL_JE_LINES', CAST(count(*) AS DOUBLE), CAST(count(*) FILTER (known) AS DOUBLE), CAST(count(*) FILTER (known) AS DOUBLE), bool_and(known), 'FAILED' FROM l
UNION ALL
SELECT 'aggregate_balance', 'Oracle GL_JE_LINES.ACCOUNTED_DR', CAST(sum(accounted_dr) AS DOUBLE), CAST(sum(accounted_dr) FILTER (known) AS DOUBLE),
       CAST(sum(accounted_dr) FILTER (known) AS DOUBLE), abs(sum(accounted_dr) - sum(accounted_dr) FILTER (known)) <= 0.01, 'FAILED' FROM l
UNION ALL
SELECT 'aggregate_balance', 'Oracle GL_JE_LINES.ACCOUNTED_CR', CAST(sum(accounted_cr) AS DOUBLE), CAST(sum(accounted_cr) FILTER (known) AS DOUBLE),
       CAST(sum(accounted_cr) FILTER (known) AS DOUBLE), abs(sum(accounted_cr) - sum(accounted_cr) FILTER (known)) <= 0.01, 'FAILED' FROM l
UNION ALL
SELECT 'row_count', 'Oracle GL_BALANCES', CAST(count(*) AS DOUBLE), CAST(count(*) FILTER (known) AS DOUBLE), CAST(count(*) FILTER (known) AS DOUBLE), bool_and(known), 'FAILED' FROM b
UNION ALL
SELECT 'row_count', 'Oracle GL_CODE_COMBINATIONS', CAST(count(*) AS DOUBLE), CAST(count(*) AS DOUBLE), CAST(count(*) AS DOUBLE), true, 'FAILED'
FROM fx_gl_code_combinations WHERE code_combination_id % 50 <> 0""")
def migration_lost(t):
    """A run whose lines and balances are partly on accounts the source no longer has."""
    accounts = t["fx_gl_code_combinations"].where("code_combination_id % 50 <> 0")
    sources = {
        "GL_JE_HEADERS": t["fx_gl_je_headers"], "GL_JE_LINES": t["fx_gl_je_lines"],
        "GL_BALANCES": _as_table(t, "fx_gl_balances"), "GL_CODE_COMBINATIONS": accounts,
    }
    lake = scratch_path(t.spark, "migration")
    migrate(t.spark, "GL", sources, lake, run_id="check")
    status = t.spark.read.parquet(f"{lake}/certificates").select("run_id", "status")
    checks = t.spark.read.parquet(f"{lake}/checks").join(status, "run_id")
    return checks.select(
        "check_type", "source_label", money("source_value").alias("source_value"),
        money("extract_value").alias("extract_value"), money("target_value").alias("target_value"),
        "passed", "status",
    )


@query("q_lineage_log", """
SELECT * FROM (VALUES ('oracle.AP_INVOICES_ALL', 'bronze.ap_invoices', 'load_bronze'), ('oracle.AP_INVOICE_LINES_ALL', 'bronze.ap_invoice_lines', 'load_bronze'),
                      ('oracle.AP_SUPPLIERS', 'bronze.ap_suppliers', 'load_bronze')) AS v(source, target, transformation)
WHERE (SELECT count(*) FROM fx_ap_invoices WHERE org_id = 101) > 0""")
def lineage_log(t):
    """The edges a migration of one organization leaves in the lake."""
    sources = {
        "AP_INVOICES_ALL": t["fx_ap_invoices"], "AP_INVOICE_LINES_ALL": t["fx_ap_invoice_lines"],
        "AP_SUPPLIERS": t["fx_ap_suppliers"],
    }
    lake = scratch_path(t.spark, "migration")
    migrate(t.spark, "AP", sources, lake, org_id=101, run_id="check")
    return t.spark.read.schema(lineage.EDGE_SCHEMA).parquet(f"{lake}/lineage")


@query("q_run_timeline_own", """
SELECT 'check' AS run_id, CAST(n AS BIGINT) AS event_id, e AS event_name, lag(e) OVER (ORDER BY n) AS previous_event, r AS rows
FROM (SELECT * FROM (VALUES (1, 'MigrationStarted', NULL), (2, 'ExtractionComplete', NULL),
        (3, 'LoadComplete', (SELECT count(*) FROM fx_people WHERE current_employee_flag = 'Y' AND effective_end_date = DATE '4712-12-31')),
        (4, 'ReconciliationComplete', NULL),
        (5, 'MigrationComplete', (SELECT count(*) FROM fx_people WHERE current_employee_flag = 'Y' AND effective_end_date = DATE '4712-12-31'))) AS v(n, e, r))""")
def run_timeline_own(t):
    """The timeline of the log a migration wrote."""
    lake = scratch_path(t.spark, "migration")
    migrate(t.spark, "HCM", {"PER_ALL_PEOPLE_F": t["fx_people"]}, lake, run_id="check")
    events = t.spark.read.schema(lineage.RUN_EVENT_SCHEMA).parquet(f"{lake}/run_events")
    return lineage.run_timeline(events).select("run_id", "event_id", "event_name", "previous_event", "rows")
