"""Queries: catalog, personal data, code audit, change events, lineage."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from closebook.functions.scalars import model_name
from closebook.operators import catalog, codeaudit, compliance, lineage
from closebook.plans.checks import REPORT_SQL, report
from closebook.plans.extracts import raw_invoices
from closebook.plans.registry import moment, money, query
from closebook.session import scratch_path
from closebook.streaming import cdc

# ---- Catalog ----


@query("q_catalog_filter", """
SELECT owner, object_name, object_type FROM fx_objects
WHERE owner = 'APPS' AND object_type IN ('TRIGGER', 'INDEX', 'SEQUENCE', 'SYNONYM') AND object_name NOT LIKE 'SYS_%'""")
def catalog_filter(t):
    return catalog.custom_objects(t["fx_objects"], "APPS")


@query("q_catalog_pattern", """
SELECT table_name, num_rows FROM fx_catalog_tables WHERE contains(upper(table_name), 'AP_')""")
def catalog_pattern(t):
    return catalog.matching(t["fx_catalog_tables"], "ap_%").select("table_name", "num_rows")


@query("q_catalog_pk", """
SELECT c.owner, k.table_name, k.column_name, k.position
FROM fx_constraints c JOIN fx_cons_columns k ON c.constraint_name = k.constraint_name AND c.owner = k.owner
WHERE c.constraint_type = 'P'""")
def catalog_pk(t):
    return catalog.primary_keys(t["fx_constraints"], t["fx_cons_columns"])


MODULE_CASE = """CASE WHEN table_name LIKE 'GL\\_%' ESCAPE '\\' THEN 'GL' WHEN table_name LIKE 'AP\\_%' ESCAPE '\\' THEN 'AP'
       WHEN table_name LIKE 'PER\\_%' ESCAPE '\\' OR table_name LIKE 'PAY\\_%' ESCAPE '\\' THEN 'HCM' ELSE 'UNKNOWN' END"""


@query("q_catalog_columns", f"""
SELECT t.owner, t.table_name, {MODULE_CASE.replace('table_name', 't.table_name')} AS module, c.columns, COALESCE(k.pk, '') AS primary_key, t.num_rows AS estimated_rows
FROM fx_catalog_tables t
LEFT JOIN (SELECT owner, table_name, string_agg(column_name || ' ' || data_type || ' ' || COALESCE(CAST(data_length AS VARCHAR), '-') || ' '
                                              || COALESCE(CAST(data_precision AS VARCHAR) || '.' || CAST(data_scale AS VARCHAR), '-'), ',' ORDER BY column_id) AS columns
           FROM fx_catalog_columns GROUP BY 1, 2) c ON c.owner = t.owner AND c.table_name = t.table_name
LEFT JOIN (SELECT owner, table_name, string_agg(column_name, ',' ORDER BY column_id) AS pk FROM fx_catalog_columns WHERE is_pk GROUP BY 1, 2) k
  ON k.owner = t.owner AND k.table_name = t.table_name
WHERE t.table_name NOT LIKE 'BIN$%'""")
def catalog_columns(t):
    keys = catalog.primary_keys(t["fx_constraints"], t["fx_cons_columns"])
    rows = catalog.schema_metadata(t["fx_catalog_tables"], t["fx_catalog_columns"], keys)
    text = F.transform("columns", lambda c: F.concat_ws(
        " ", c["column_name"], c["data_type"], F.coalesce(c["data_length"].cast("string"), F.lit("-")),
        F.coalesce(F.concat(c["data_precision"].cast("string"), F.lit("."), c["data_scale"].cast("string")), F.lit("-")),
    ))
    return rows.select(
        "owner", "table_name", "module", F.array_join(text, ",").alias("columns"),
        F.array_join("primary_key", ",").alias("primary_key"), "estimated_rows",
    )


@query("q_classify", f"""
SELECT t.owner, t.table_name, {MODULE_CASE.replace('table_name', 't.table_name')} AS module, COALESCE(c.n, 0) AS column_count, t.num_rows AS estimated_rows
FROM fx_catalog_tables t LEFT JOIN (SELECT owner, table_name, count(*) AS n FROM fx_catalog_columns GROUP BY 1, 2) c ON c.owner = t.owner AND c.table_name = t.table_name
WHERE t.table_name NOT LIKE 'BIN$%'""")
def classify(t):
    return catalog.classify(t["fx_catalog_tables"], t["fx_catalog_columns"])


@query("q_flexfields", """
SELECT owner, table_name, CASE WHEN contains(column_name, 'SEGMENT') THEN 'KFF' ELSE 'DFF' END AS flexfield_type,
       count(*) AS column_count, string_agg(column_name, ',' ORDER BY column_id) AS columns
FROM fx_catalog_columns WHERE contains(column_name, 'SEGMENT') OR contains(column_name, 'ATTRIBUTE') GROUP BY 1, 2, 3""")
def flexfields(t):
    return catalog.flexfields(t["fx_catalog_columns"]).withColumn(
        "columns", F.array_join("columns", ",")
    )


@query("q_type_map", """
SELECT data_type, count(*) AS columns,
       CASE upper(trim(split_part(data_type, '(', 1)))
         WHEN 'VARCHAR2' THEN 'STRING' WHEN 'CLOB' THEN 'STRING' WHEN 'CHAR' THEN 'STRING' WHEN 'ROWID' THEN 'STRING' WHEN 'XMLTYPE' THEN 'STRING'
         WHEN 'NUMBER' THEN 'NUMERIC' WHEN 'BINARY_DOUBLE' THEN 'FLOAT64' WHEN 'DATE' THEN 'TIMESTAMP' WHEN 'TIMESTAMP' THEN 'TIMESTAMP'
         WHEN 'BLOB' THEN 'BYTES' ELSE 'STRING' END AS target_type
FROM fx_catalog_columns GROUP BY 1""")
def type_map(t):
    return catalog.type_usage(t["fx_catalog_columns"])


@query("q_model_names", """
SELECT table_name, 'stg_' || rtrim(replace(lower(table_name), '_all', ''), '_') AS staging, 'int_' || rtrim(replace(lower(table_name), '_all', ''), '_') AS intermediate,
       'mart_' || rtrim(replace(lower(table_name), '_all', ''), '_') AS mart
FROM fx_catalog_tables""")
def model_names(t):
    return t["fx_catalog_tables"].select(
        "table_name", *[model_name("table_name", x).alias(x) for x in ("staging", "intermediate", "mart")]
    )


KEYED = {
    "AP_INVOICES_ALL": ("fx_ap_invoices", "invoice_id"),
    "AP_SUPPLIERS": ("fx_ap_suppliers", "vendor_id"),
    "GL_JE_HEADERS": ("fx_gl_je_headers", "je_header_id"),
    "GL_CODE_COMBINATIONS": ("fx_gl_code_combinations", "code_combination_id"),
}
UNKEYED = {
    "AP_INVOICE_LINES_ALL": "fx_ap_invoice_lines", "GL_JE_LINES": "fx_gl_je_lines",
    "GL_BALANCES": "fx_gl_balances", "AP_INVOICES_COPY": "fx_ap_invoices_tgt",
}


def _containment_sql(source, column, target):
    view, key_view = {**UNKEYED, **{k: v[0] for k, v in KEYED.items()}}[source], KEYED[target][0]
    return f"""SELECT '{source}' AS source_table, '{column}' AS column_name, '{target}' AS target_table,
       count(DISTINCT {column}) AS distinct_values,
       count(DISTINCT CASE WHEN {column} IN (SELECT {column} FROM {key_view}) THEN {column} END) AS matched_values
FROM {view}"""


RELATIONSHIP_PAIRS = [
    ("AP_INVOICE_LINES_ALL", "invoice_id", "AP_INVOICES_ALL"),
    ("AP_INVOICES_COPY", "invoice_id", "AP_INVOICES_ALL"),
    ("AP_INVOICES_ALL", "vendor_id", "AP_SUPPLIERS"),
    ("AP_INVOICES_COPY", "vendor_id", "AP_SUPPLIERS"),
    ("GL_JE_LINES", "je_header_id", "GL_JE_HEADERS"),
    ("GL_JE_LINES", "code_combination_id", "GL_CODE_COMBINATIONS"),
    ("GL_BALANCES", "code_combination_id", "GL_CODE_COMBINATIONS"),
]


@query("q_relationships", f"""
SELECT source_table, column_name, target_table, distinct_values, matched_values, CAST(matched_values AS DOUBLE) / distinct_values AS containment
FROM ({' UNION ALL '.join(_containment_sql(*p) for p in RELATIONSHIP_PAIRS)})
WHERE distinct_values > 0 AND CAST(matched_values AS DOUBLE) / distinct_values >= 0.95""")
def relationships(t):
    tables = {name: t[view] for name, (view, _) in KEYED.items()}
    tables |= {name: t[view] for name, view in UNKEYED.items()}
    return catalog.relationships(tables, {name: key for name, (_, key) in KEYED.items()})


#: Columns of whole numbers and amounts of the views, for the SQL that counts every pair.
NUMBERS = {
    "AP_INVOICES_ALL": "invoice_id vendor_id invoice_amount amount_paid org_id set_of_books_id",
    "AP_SUPPLIERS": "vendor_id",
    "GL_JE_HEADERS": "je_header_id je_batch_id ledger_id org_id",
    "GL_CODE_COMBINATIONS": "code_combination_id",
    "AP_INVOICE_LINES_ALL": "invoice_id line_number amount dist_code_combination_id",
    "GL_JE_LINES": "je_header_id je_line_num code_combination_id accounted_dr accounted_cr",
    "GL_BALANCES": "ledger_id code_combination_id period_net_dr period_net_cr begin_balance_dr begin_balance_cr reported_end_balance",
}


def _view(table):
    return {**UNKEYED, **{k: v[0] for k, v in KEYED.items()}}[table]


IMPLIED_SQL = " UNION ALL ".join(
    f"SELECT '{table}' AS source_table, '{column}' AS source_column, '{target}' AS target_table, '{key}' AS target_column, "
    f"count(DISTINCT {column}) AS distinct_values, count(DISTINCT CASE WHEN {column} IN (SELECT {key} FROM {view}) THEN {column} END) AS matched_values FROM {_view(table)}"
    for target, (view, key) in KEYED.items() for table, columns in NUMBERS.items() if table != target for column in columns.split()
)


@query("q_implied_references", f"""
SELECT *, CAST(matched_values AS DOUBLE) / distinct_values AS containment FROM ({IMPLIED_SQL})
WHERE distinct_values > 0 AND CAST(matched_values AS DOUBLE) / distinct_values >= 0.95""")
def implied_references(t):
    """References under other names, found by sketches of all columns and counted exactly."""
    tables = {name: t[_view(name)] for name in NUMBERS}
    return catalog.implied_references(tables, {name: key for name, (_, key) in KEYED.items()})


@query("q_key_descriptions", """
SELECT owner, table_name, column_name,
       concat_ws(' ', CASE WHEN is_pk THEN 'Primary key.' END,
                 CASE column_name WHEN 'ORG_ID' THEN 'Foreign key to HR_ORGANIZATIONS.ORG_ID.' WHEN 'INVOICE_AMOUNT' THEN 'Foreign key to XX_LIMITS.AMOUNT.' END) AS description
FROM fx_catalog_columns""")
def key_descriptions(t):
    targets = t["fx_catalog_columns"].withColumns({
        "fk_target_table": F.when(F.col("column_name") == "ORG_ID", "HR_ORGANIZATIONS")
        .when(F.col("column_name") == "INVOICE_AMOUNT", "XX_LIMITS"),
        "fk_target_column": F.when(F.col("column_name") == "ORG_ID", "ORG_ID")
        .when(F.col("column_name") == "INVOICE_AMOUNT", "AMOUNT"),
    })
    return targets.select(
        "owner", "table_name", "column_name", catalog.key_description().alias("description")
    )


@query("q_cast_profile", """
WITH r AS (
  SELECT invoice_id, invoice_num, vendor_id, CASE WHEN invoice_id % 41 = 0 THEN 'n/a' ELSE CAST(invoice_amount AS VARCHAR) END AS amount_text FROM fx_ap_invoices)
SELECT 'invoice_num' AS column_name, 'VARCHAR2' AS data_type, count(*) AS row_count, CAST(count(*) FILTER (invoice_num IS NULL) AS BIGINT) AS null_count,
       CAST(0 AS BIGINT) AS lost_count, CAST(count(*) FILTER (length(invoice_num) > 8) AS BIGINT) AS too_long_count FROM r
UNION ALL
SELECT 'invoice_amount', 'NUMBER(15,2)', count(*), CAST(0 AS BIGINT), CAST(count(*) FILTER (invoice_id % 41 = 0) AS BIGINT), CAST(0 AS BIGINT) FROM r
UNION ALL
SELECT 'vendor_id', 'NUMBER(18,0)', count(*), CAST(count(*) FILTER (vendor_id IS NULL) AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM r
UNION ALL
SELECT 'invoice_date', 'DATE', count(*), CAST(0 AS BIGINT), CAST(count(*) FILTER (invoice_id % 43 = 0) AS BIGINT), CAST(0 AS BIGINT) FROM r""")
def cast_profile(t):
    wanted = ("INVOICE_NUM", "INVOICE_AMOUNT", "VENDOR_ID", "INVOICE_DATE")
    columns = catalog.table_columns(t["fx_dict_columns"], "AP", "AP_INVOICES_ALL")
    columns = [c for c in columns if c[0] in wanted]
    return catalog.cast_profile(raw_invoices(t["fx_ap_invoices"]), columns)


@query("q_table_sample", """
SELECT invoice_id, invoice_num, vendor_id, CAST(invoice_amount AS DOUBLE) AS invoice_amount FROM fx_ap_invoices ORDER BY invoice_id LIMIT 10""")
def table_sample(t):
    return catalog.sample_rows(t["fx_ap_invoices"], ["invoice_id"]).select(
        "invoice_id", "invoice_num", "vendor_id", money("invoice_amount").alias("invoice_amount")
    )


# ---- Personal data ----


@query("q_pii_columns", """
SELECT table_name, column_name, CASE WHEN contains(upper(column_name), 'EMAIL') THEN 'EMAIL' WHEN contains(upper(column_name), 'NATIONAL_ID') THEN 'NATIONAL_ID'
       WHEN contains(upper(column_name), 'BIRTH') THEN 'BIRTH' ELSE 'PHONE' END AS pii_kind
FROM fx_catalog_columns
WHERE contains(upper(column_name), 'EMAIL') OR contains(upper(column_name), 'NATIONAL_ID') OR contains(upper(column_name), 'BIRTH') OR contains(upper(column_name), 'PHONE')""")
def pii_columns(t):
    return compliance.pii_columns(t["fx_catalog_columns"]).select(
        "table_name", "column_name", "pii_kind"
    )


@query("q_mask_people", """
SELECT sha256('pepper' || CAST(person_id AS VARCHAR)) AS person_id,
       CASE WHEN contains(email_address, '@') THEN substr(email_address, 1, 1) || '***@' || split_part(email_address, '@', 2)
            ELSE repeat('*', length(email_address)) END AS email_address,
       repeat('*', length(national_identifier) - 4) || right(national_identifier, 4) AS national_identifier,
       CAST(NULL AS VARCHAR) AS first_name, employee_number
FROM fx_people""")
def mask_people(t):
    return compliance.mask(
        t["fx_people"], emails=["email_address"], ids=["national_identifier"], keys=["person_id"],
        hide=["first_name"], secret="pepper",
    ).select("person_id", "email_address", "national_identifier", "first_name", "employee_number")


@query("q_consent_latest", """
SELECT person_id, arg_max(operation, (event_time, operation, details)) AS action, arg_max(details, (event_time, operation, details)) AS details,
       strftime(max(event_time), '%Y-%m-%d %H:%M:%S') AS logged_at
FROM (SELECT pk AS person_id, operation, table_name AS details, event_time FROM fx_cdc_events) GROUP BY 1""")
def consent_latest(t):
    """The newest action of each person, from a log written in two parts."""
    path = scratch_path(t.spark, "consent")
    actions = t["fx_cdc_events"].select(
        F.col("pk").alias("person_id"), F.col("operation").alias("action"),
        F.col("table_name").alias("details"), F.col("event_time").alias("logged_at"), "event_id",
    )
    for part in (0, 1):
        compliance.log_consent(actions.where(F.col("event_id") % 2 == part).drop("event_id"), path)
    latest = compliance.latest_consent(t.spark.read.parquet(path))
    return latest.withColumn("logged_at", moment("logged_at"))


def _pii_sql(table, column, by):
    parts = [
        f"""SELECT {by}, '{column}' AS column_name, '{kind}' AS pii_kind,
       CAST(count(*) FILTER (len(regexp_extract_all({column}, '{p}')) > 0) AS BIGINT) AS rows_with_match,
       CAST(COALESCE(sum(len(regexp_extract_all({column}, '{p}'))), 0) AS BIGINT) AS matches FROM {table} GROUP BY 1"""
        for kind, p in compliance.VALUE_PATTERNS.items()
    ]
    return "\nUNION ALL\n".join(parts)


@query("q_pii_values", _pii_sql("documents", "text", "lang"))
def pii_values(t):
    return compliance.pii_values(t["documents"], ["text"], ["lang"])


@query("q_pii_values_turns", _pii_sql("conversations", "text", "role"))
def pii_values_turns(t):
    return compliance.pii_values(t["conversations"], ["text"], ["role"])


@query("q_compliance_report", f"""
WITH c AS (
  SELECT 'unmasked_pii_columns' AS control, count(*) AS findings FROM fx_catalog_columns
  WHERE contains(upper(column_name), 'NATIONAL_ID') OR contains(upper(column_name), 'BIRTH') OR contains(upper(column_name), 'PHONE')
  UNION ALL
  SELECT 'failed_error_rules', count(*) FROM ({REPORT_SQL}) WHERE NOT passed AND severity = 'ERROR'
  UNION ALL
  SELECT 'uncertified_runs', count(*) FROM fx_runs WHERE NOT reconciliation_passed)
SELECT 'PDPL' AS standard, control, findings, CASE WHEN findings = 0 THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS status FROM c""")
def compliance_report(t):
    pii = compliance.pii_columns(t["fx_catalog_columns"])
    masked = pii.where("pii_kind = 'EMAIL'").select("table_name", "column_name")
    runs = t["fx_runs"].select(
        F.when(F.col("reconciliation_passed"), "CERTIFIED").otherwise("FAILED").alias("status")
    )
    return compliance.compliance_report("PDPL", pii, masked, report(t), runs)


# ---- Code audit ----


def _construct_sql():
    return "\nUNION ALL\n".join(
        f"SELECT schema_name, object_name, '{text}' AS construct FROM fx_plsql_objects WHERE regexp_matches(body, '{pattern}', 'i')"
        for pattern, text in codeaudit.UNSUPPORTED.items()
    )


@query("q_plsql_findings", _construct_sql())
def plsql_findings(t):
    return codeaudit.findings(t["fx_plsql_objects"])


def _rewrite_sql(column="body"):
    out = column
    for pattern, text in codeaudit.REWRITES:
        text = text.replace("'", "''").replace("$", "\\")
        out = f"regexp_replace({out}, '{pattern}', '{text}', 'gi')"
    return out


@query("q_plsql_rewrite", f"""
SELECT schema_name, object_name, {_rewrite_sql()} AS translated FROM fx_plsql_objects""")
def plsql_rewrite(t):
    return codeaudit.translate(t["fx_plsql_objects"]).select(
        "schema_name", "object_name", "translated"
    )


@query("q_plsql_summary", f"""
WITH f AS (SELECT object_name, count(*) AS n FROM ({_construct_sql()}) GROUP BY 1),
o AS (SELECT p.schema_name, COALESCE(f.n, 0) AS n, contains({_rewrite_sql('p.body')}, 'DECODE(') AS decode FROM fx_plsql_objects p LEFT JOIN f ON f.object_name = p.object_name)
SELECT schema_name, count(*) AS objects, CAST(count(*) FILTER (n = 0 AND NOT decode) AS BIGINT) AS clean, CAST(count(*) FILTER (n > 0) AS BIGINT) AS with_unsupported,
       CAST(count(*) FILTER (decode) AS BIGINT) AS with_decode, CAST(sum(n) AS BIGINT) AS findings
FROM o GROUP BY 1""")
def plsql_summary(t):
    return codeaudit.summary(t["fx_plsql_objects"])


# ---- Change events ----


CURRENT_SQL = """
SELECT table_name, pk, operation, value, event_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time FROM (
  SELECT *, row_number() OVER (PARTITION BY table_name, pk ORDER BY event_time DESC, event_id DESC) AS rn FROM fx_cdc_events)
WHERE rn = 1 AND operation <> 'DELETE'"""


@query("q_cdc_current", CURRENT_SQL)
def cdc_current(t):
    return cdc.current_state(t["fx_cdc_events"]).select(
        "table_name", "pk", "operation", "value", "event_id", moment("event_time").alias("event_time")
    )


HISTORY_SQL = """
WITH v AS (
  SELECT table_name, pk, event_time, arg_max(operation, event_id) AS operation, arg_max(value, event_id) AS value FROM fx_cdc_events GROUP BY 1, 2, 3),
w AS (SELECT *, lead(event_time) OVER (PARTITION BY table_name, pk ORDER BY event_time) AS nxt FROM v)
SELECT table_name, pk, value, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS valid_from,
       COALESCE(strftime(nxt, '%Y-%m-%d %H:%M:%S'), '4712-12-31 00:00:00') AS valid_to, nxt IS NULL AS is_current
FROM w WHERE operation <> 'DELETE'"""


@query("q_cdc_history", HISTORY_SQL)
def cdc_history(t):
    rows = cdc.history(t["fx_cdc_events"])
    return rows.withColumns({c: moment(c) for c in ("valid_from", "valid_to")})


@query("q_cdc_history_cut", HISTORY_SQL)
def cdc_history_cut(t):
    """The same with every history of more than 15 events cut into pieces."""
    rows = cdc.history(t["fx_cdc_events"], task_rows=15)
    return rows.withColumns({c: moment(c) for c in ("valid_from", "valid_to")})


@query("q_cdc_stream_history", HISTORY_SQL)
def cdc_stream_history(t):
    """The history of a stream whose newest events come first, folded half way."""
    out, check, inbox = scratch_path(t.spark, "history"), scratch_path(t.spark, "offsets"), scratch_path(t.spark, "changes")
    whole = t.spark.read.schema(cdc.ENTITIES["cdc_event"]).parquet(_inbox(t))
    for late in (False, True):
        whole.where((F.col("event_id") % 4 == 0) == F.lit(late)).write.mode("append").parquet(inbox)
        _ended(cdc.start_history(cdc.read_changes(t.spark, inbox, 4), out, check))
        if not late:
            cdc.compact_history(t.spark, out)
    # Some events come once more, by another checkpoint.
    _ended(cdc.start_history(cdc.read_changes(t.spark, inbox), out, scratch_path(t.spark, "offsets")))
    rows = cdc.read_history(t.spark, out)
    return rows.withColumns({c: moment(c) for c in ("valid_from", "valid_to")})


VOLUME_SQL = """
SELECT strftime(time_bucket(INTERVAL '15 minutes', event_time), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(time_bucket(INTERVAL '15 minutes', event_time) + INTERVAL '15 minutes', '%Y-%m-%d %H:%M:%S') AS window_end,
       stream_name, table_name, operation, count(*) AS events, CAST(sum(row_count) AS BIGINT) AS row_count
FROM fx_cdc_events GROUP BY 1, 2, 3, 4, 5"""


@query("q_cdc_volume", VOLUME_SQL)
def cdc_volume(t):
    rows = cdc.volume(t["fx_cdc_events"])
    return rows.withColumns({c: moment(c) for c in ("window_start", "window_end")})


def _inbox(t) -> str:
    """The change events as files of a folder, the newest ones first."""
    path = scratch_path(t.spark, "changes")
    events = t["fx_cdc_events"].select(
        F.col("event_id").cast("bigint").alias("event_id"), "stream_name", "table_name", "operation",
        F.col("pk").cast("bigint").alias("pk"), F.col("value").cast("double").alias("value"), "event_time",
        F.col("row_count").cast("int").alias("row_count"),
    )
    for turn in (2, 1, 0):
        events.where(F.col("event_id") % 3 == turn).write.mode("append").parquet(path)
    return path


def _ended(stream) -> None:
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


@query("q_cdc_stream_state", CURRENT_SQL)
def cdc_stream_state(t):
    """The state of a stream over the same events, folded half way."""
    inbox, out, check = _inbox(t), scratch_path(t.spark, "state"), scratch_path(t.spark, "offsets")
    _ended(cdc.start_state(cdc.read_changes(t.spark, inbox, 4), out, check))
    cdc.compact_state(t.spark, out)
    # The same changes once more, by another checkpoint: the state stays what it is.
    _ended(cdc.start_state(cdc.read_changes(t.spark, inbox), out, scratch_path(t.spark, "offsets")))
    return cdc.read_state(t.spark, out).select(
        "table_name", "pk", "operation", "value", "event_id", moment("event_time").alias("event_time")
    )


@query("q_cdc_stream_resume", CURRENT_SQL)
def cdc_stream_resume(t):
    """The state of a stream that is stopped half way and goes on from its checkpoint."""
    inbox, out, check = scratch_path(t.spark, "inbox"), scratch_path(t.spark, "state"), scratch_path(t.spark, "offsets")
    late = F.col("event_id") % 3 == 0
    t["fx_cdc_events"].where(~late).repartition(4).write.parquet(inbox)
    stream = cdc.start_state(cdc.read_changes(t.spark, inbox, 1), out, check, mode="continuous", interval="0 seconds")
    try:
        while not stream.recentProgress and stream.isActive:  # stopped after its first batch or later
            time.sleep(0.05)
    finally:
        stream.stop()
    t["fx_cdc_events"].where(late).write.mode("append").parquet(inbox)
    for _ in range(2):  # the second run finds nothing new
        _ended(cdc.start_state(cdc.read_changes(t.spark, inbox), out, check))
        cdc.compact_state(t.spark, out)
    return cdc.read_state(t.spark, out).select(
        "table_name", "pk", "operation", "value", "event_id", moment("event_time").alias("event_time")
    )


@query("q_cdc_snapshot", """
WITH a AS (SELECT * FROM fx_cdc_events WHERE event_id % 2 = 0 OR event_id % 5 = 0),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_name, pk ORDER BY event_time DESC, event_id DESC) AS rn FROM a WHERE event_id % 2 = 0) WHERE rn = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY table_name, pk ORDER BY event_time DESC, event_id DESC) AS n
      FROM (SELECT * EXCLUDE (rn) FROM s UNION ALL SELECT * FROM a WHERE event_id % 2 <> 0))
SELECT table_name, pk, operation, value, event_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time FROM r WHERE n = 1 AND operation <> 'DELETE'""")
def cdc_snapshot(t):
    """A state that a snapshot overwrites, and the changes that come after it."""
    inbox, out, check = scratch_path(t.spark, "inbox"), scratch_path(t.spark, "state"), scratch_path(t.spark, "offsets")
    t["fx_cdc_events"].where("event_id % 2 <> 0 AND event_id % 5 <> 0").write.parquet(inbox)
    _ended(cdc.start_state(cdc.read_changes(t.spark, inbox), out, check))
    cdc.load_snapshot(t["fx_cdc_events"].where("event_id % 2 = 0"), out)
    t["fx_cdc_events"].where("event_id % 2 <> 0 AND event_id % 5 = 0").write.mode("append").parquet(inbox)
    _ended(cdc.start_state(cdc.read_changes(t.spark, inbox), out, check))
    return cdc.read_state(t.spark, out).select(
        "table_name", "pk", "operation", "value", "event_id", moment("event_time").alias("event_time")
    )


@query("q_cdc_stream_volume", VOLUME_SQL)
def cdc_stream_volume(t):
    """Volume windows of a stream over the same events, the newest ones first."""
    out = scratch_path(t.spark, "volume")
    _ended(cdc.start_volume(cdc.read_changes(t.spark, _inbox(t), 4), out, scratch_path(t.spark, "offsets")))
    rows = cdc.read_volume(t.spark, out)
    return rows.withColumns({c: moment(c) for c in ("window_start", "window_end")})


@query("q_cdc_status", """
SELECT stream_name, count(DISTINCT table_name) AS tables_synced, CAST(sum(row_count) AS BIGINT) AS rows_synced,
       strftime(max(event_time), '%Y-%m-%d %H:%M:%S') AS last_sync_time, CAST(0 AS BIGINT) AS error_count, 5 AS total_tables,
       'RUNNING' AS status, true AS healthy, least(count(DISTINCT table_name) / 5.0, 1.0) AS progress
FROM fx_cdc_events GROUP BY 1""")
def cdc_status(t):
    return cdc.stream_status(t["fx_cdc_events"]).withColumn("last_sync_time", moment("last_sync_time"))


@query("q_cdc_backfill", """
WITH a AS (
  SELECT 'GL_JE_HEADERS' AS table_name, c_custkey AS pk, 'INSERT' AS operation, CAST(c_acctbal AS DOUBLE) AS value, TIMESTAMP '1970-01-01 00:00:00' AS event_time, 0 AS event_id FROM customer
  UNION ALL SELECT table_name, pk, operation, value, event_time, event_id FROM fx_cdc_events),
r AS (SELECT *, row_number() OVER (PARTITION BY table_name, pk ORDER BY event_time DESC, event_id DESC) AS rn FROM a)
SELECT table_name, pk, operation, value FROM r WHERE rn = 1 AND operation <> 'DELETE'""")
def cdc_backfill(t):
    snapshot = t["customer"].select(
        F.lit("GL_JE_HEADERS").alias("table_name"), F.col("c_custkey").alias("pk"),
        F.col("c_acctbal").alias("value"),
    )
    events = t["fx_cdc_events"].select(
        "table_name", "pk", "operation", "value", "event_time", "event_id"
    )
    merged = cdc.with_backfill(snapshot, events)
    return cdc.current_state(merged).select("table_name", "pk", "operation", "value")


# ---- Lineage and run log ----


@query("q_lineage", """
WITH RECURSIVE up(asset, depth) AS (
  SELECT DISTINCT source, 1 FROM fx_lineage_edges WHERE target = 'gold.board_report'
  UNION
  SELECT e.source, up.depth + 1 FROM up JOIN fx_lineage_edges e ON e.target = up.asset)
SELECT asset, CAST(min(depth) AS INTEGER) AS depth FROM up GROUP BY 1""")
def lineage_upstream(t):
    return lineage.lineage_graph(t["fx_lineage_edges"], "gold.board_report", "upstream")


@query("q_run_timeline", """
SELECT event_id, run_id, event_name, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time,
       lag(event_name) OVER w AS previous_event, (epoch_us(event_time) - epoch_us(lag(event_time) OVER w)) / 1000000.0 AS seconds_since
FROM fx_run_events WINDOW w AS (PARTITION BY run_id ORDER BY event_time, event_id)""")
def run_timeline(t):
    return lineage.run_timeline(t["fx_run_events"]).select(
        "event_id", "run_id", "event_name", moment("event_time").alias("event_time"),
        "previous_event", "seconds_since",
    )
