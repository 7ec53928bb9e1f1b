"""Views that give the driver tables the shape of source ledger tables.

Each view is plain SQL that reads base tables and earlier views, with known
defects planted by key (nulls, orphans, repeats, drift). The same text serves
as a common table expression in another engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS = {
    "fx_org": """
SELECT 101 + r_regionkey AS org_id, 1 + r_regionkey AS set_of_books_id,
       2001 + r_regionkey AS ledger_id, r_name AS org_name
FROM region""",
    "fx_ap_invoices": """
WITH b AS (
  SELECT o_orderkey AS invoice_id,
         'INV-' || CAST(o_orderkey AS STRING) AS invoice_num,
         CASE WHEN o_orderkey % 211 = 0 THEN NULL
              WHEN o_orderkey % 307 = 0 THEN o_custkey + 900000000
              ELSE o_custkey END AS vendor_id,
         o_orderdate AS invoice_date,
         CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderdate END AS gl_date,
         CAST(CASE WHEN o_orderkey % 53 = 0 THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18,2)) AS invoice_amount,
         CAST(CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'P' THEN 100.0 ELSE 0.0 END AS DECIMAL(18,2)) AS amount_paid,
         CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'SAR' ELSE 'QAR' END AS invoice_currency_code,
         CASE o_orderstatus WHEN 'F' THEN 'Y' WHEN 'P' THEN 'P' ELSE 'N' END AS payment_status_flag,
         101 + n_regionkey AS org_id, 1 + n_regionkey AS set_of_books_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT * FROM b
UNION ALL
SELECT invoice_id + 100000000, invoice_num, vendor_id, invoice_date, gl_date, invoice_amount,
       amount_paid, invoice_currency_code, payment_status_flag, org_id, set_of_books_id
FROM b WHERE invoice_id % 97 = 0""",
    "fx_ap_invoice_lines": """
SELECT l_orderkey AS invoice_id, l_linenumber AS line_number,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
       l_returnflag AS description, l_partkey AS dist_code_combination_id
FROM lineitem""",
    # Equal copies of lines, and lines without a number.
    "fx_ap_invoice_lines_rough": """
SELECT invoice_id, CASE WHEN invoice_id % 41 = 0 THEN NULL ELSE line_number END AS line_number,
       amount, description, dist_code_combination_id
FROM fx_ap_invoice_lines
UNION ALL
SELECT invoice_id, CASE WHEN invoice_id % 41 = 0 THEN NULL ELSE line_number END,
       amount, description, dist_code_combination_id
FROM fx_ap_invoice_lines WHERE invoice_id % 37 = 0""",
    # Vendors that always bill the same amount.
    "fx_ap_invoices_regular": """
SELECT invoice_id, vendor_id, invoice_amount FROM fx_ap_invoices
UNION ALL
SELECT invoice_id + 200000000, 800000000 + invoice_id % 40, CAST(0.10 AS DECIMAL(18,2))
FROM fx_ap_invoices WHERE invoice_id % 5 = 0""",
    # Invoices that were typed again with a character added, dropped or replaced.
    "fx_ap_invoices_typo": """
SELECT invoice_id, invoice_num, vendor_id, invoice_amount FROM fx_ap_invoices
UNION ALL
SELECT invoice_id + 300000000,
       CASE invoice_id % 3 WHEN 0 THEN invoice_num || '7' WHEN 1 THEN replace(invoice_num, 'INV-', 'INV') ELSE 'JNV-' || substr(invoice_num, 5) END,
       vendor_id, CAST(invoice_amount + CASE invoice_id % 2 WHEN 0 THEN 0.50 ELSE 1.01 END AS DECIMAL(18,2))
FROM fx_ap_invoices WHERE invoice_id % 31 = 0""",
    "fx_ap_suppliers": """
SELECT c_custkey AS vendor_id, c_name AS vendor_name, CAST(c_custkey AS STRING) AS segment1, 'Y' AS enabled_flag
FROM customer""",
    "fx_gl_je_batches": """
SELECT DISTINCT o_orderkey % 50 AS je_batch_id, 'BATCH-' || CAST(o_orderkey % 50 AS STRING) AS batch_name
FROM orders""",
    "fx_gl_je_headers": """
SELECT o_orderkey AS je_header_id, o_orderkey % 50 AS je_batch_id,
       'JE-' || CAST(o_orderkey AS STRING) AS journal_name,
       CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE
         substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * month(o_orderdate) - 2 AS INT), 3)
         || '-' || substr(CAST(year(o_orderdate) AS STRING), 3, 2) END AS period_name,
       CASE WHEN o_orderstatus = 'O' THEN 'U' ELSE 'P' END AS status,
       2001 + o_custkey % 3 AS ledger_id, 101 + o_custkey % 5 AS org_id, o_orderdate AS posted_date
FROM orders""",
    "fx_gl_je_lines": """
SELECT l_orderkey AS je_header_id, l_linenumber AS je_line_num, l_partkey AS code_combination_id,
       'USD' AS currency_code,
       CAST(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END AS DECIMAL(18,2)) AS accounted_dr,
       CAST(CASE WHEN l_linestatus = 'F' AND l_orderkey % 401 <> 0 THEN l_extendedprice END AS DECIMAL(18,2)) AS accounted_cr
FROM lineitem""",
    "fx_gl_code_combinations": """
SELECT p_partkey AS code_combination_id, p_brand AS segment1, CAST(p_size AS STRING) AS segment2,
       CAST(p_partkey % 10 AS STRING) AS segment3,
       CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'D4' END AS segment4,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'E5' END AS segment5, 'Y' AS enabled_flag
FROM part""",
    "fx_gl_balances": """
WITH n AS (
  SELECT h.ledger_id, l.code_combination_id, l.currency_code, h.period_name,
         CAST(coalesce(sum(l.accounted_dr), 0) AS DECIMAL(18,2)) AS period_net_dr,
         CAST(coalesce(sum(l.accounted_cr), 0) AS DECIMAL(18,2)) AS period_net_cr
  FROM fx_gl_je_lines l JOIN fx_gl_je_headers h ON l.je_header_id = h.je_header_id
  WHERE h.status = 'P' AND h.period_name IS NOT NULL
  GROUP BY h.ledger_id, l.code_combination_id, l.currency_code, h.period_name)
SELECT n.*, 'A' AS actual_flag, CAST(code_combination_id % 1000 AS DECIMAL(18,2)) AS begin_balance_dr,
       CAST(0 AS DECIMAL(18,2)) AS begin_balance_cr,
       CAST(code_combination_id % 1000 + period_net_dr - period_net_cr
            + CASE WHEN code_combination_id % 20 = 0 THEN 0.01 WHEN code_combination_id % 21 = 0 THEN 5.00 ELSE 0.00 END
            AS DECIMAL(18,2)) AS reported_end_balance
FROM n""",
    # Amounts of three decimals, some off by 0.008; a period with balances only, some of one
    # account more than once, and a period that has lost its balances.
    "fx_gl_balances_close": """
SELECT ledger_id, code_combination_id, currency_code, period_name,
       CAST(begin_balance_dr AS DECIMAL(18,3)) AS begin_balance_dr, CAST(begin_balance_cr AS DECIMAL(18,3)) AS begin_balance_cr,
       CAST(reported_end_balance + CASE WHEN code_combination_id % 22 = 0 THEN 0.008 ELSE 0.000 END AS DECIMAL(18,3)) AS reported_end_balance
FROM fx_gl_balances WHERE period_name <> 'Feb-95'
UNION ALL
SELECT ledger_id, code_combination_id, currency_code, 'Adj-99', CAST(begin_balance_dr AS DECIMAL(18,3)),
       CAST(begin_balance_cr AS DECIMAL(18,3)), CAST(begin_balance_dr + code_combination_id % 3 AS DECIMAL(18,3))
FROM fx_gl_balances WHERE code_combination_id % 10 = 0""",
    # Ledger lines and the statement they should settle: some lines are missing, off by cents,
    # new, or paid together with others of their journal.
    "fx_ledger_lines": """
SELECT je_header_id * 10 + je_line_num AS line_id, code_combination_id % 100 AS account, je_header_id,
       coalesce(accounted_dr, -accounted_cr) AS amount
FROM fx_gl_je_lines""",
    "fx_statement_lines": """
SELECT line_id + 1000000000 AS line_id, account,
       CAST(amount + CASE je_header_id % 13 WHEN 1 THEN 0.02 WHEN 2 THEN -0.03 WHEN 3 THEN 0.30 ELSE 0.00 END AS DECIMAL(18,2)) AS amount
FROM fx_ledger_lines WHERE je_header_id % 17 <> 0 AND je_header_id % 19 <> 0 AND amount IS NOT NULL
UNION ALL
SELECT min(line_id) + 2000000000, account, CAST(sum(amount) AS DECIMAL(18,2))
FROM fx_ledger_lines WHERE je_header_id % 19 = 0 AND je_header_id % 17 <> 0 AND amount IS NOT NULL GROUP BY je_header_id, account
UNION ALL
SELECT line_id + 3000000000, account, amount FROM fx_ledger_lines WHERE je_header_id % 41 = 0""",
    "fx_people": """
SELECT c_custkey AS person_id,
       'EMP' || CAST(CASE WHEN c_custkey % 100 = 99 THEN c_custkey - 1 ELSE c_custkey END AS STRING) AS employee_number,
       c_mktsegment AS first_name, CASE WHEN c_custkey % 97 = 0 THEN '  ' WHEN c_custkey % 79 = 0 THEN chr(160) || ' ' ELSE c_name END AS last_name,
       CASE WHEN c_custkey % 83 = 0 THEN 'no address ' || CAST(c_custkey AS STRING)
            ELSE lower(c_mktsegment) || CAST(c_custkey AS STRING) || '@example.com' END AS email_address,
       CAST(1000000000 + c_custkey AS STRING) AS national_identifier,
       CASE WHEN c_custkey % 89 = 0 THEN NULL ELSE DATE '2020-03-15' END AS original_date_of_hire,
       CASE WHEN c_custkey % 10 = 0 THEN 'N' ELSE 'Y' END AS current_employee_flag,
       DATE '2020-01-01' AS effective_start_date,
       CASE WHEN c_custkey % 7 = 0 THEN DATE '2023-06-30' ELSE DATE '4712-12-31' END AS effective_end_date
FROM customer""",
    # Versions of people: some changed group once, some left and came back.
    "fx_people_versions": """
SELECT person_id, first_name, DATE '2020-01-01' AS effective_start_date,
       CASE WHEN person_id % 5 = 0 THEN DATE '2021-03-14' WHEN person_id % 7 = 0 THEN DATE '2021-06-30' ELSE DATE '4712-12-31' END AS effective_end_date
FROM fx_people
UNION ALL
SELECT person_id, 'MOVED', DATE '2021-03-15', CASE WHEN person_id % 2 = 0 THEN DATE '2021-12-31' ELSE DATE '4712-12-31' END
FROM fx_people WHERE person_id % 5 = 0
UNION ALL
SELECT person_id, first_name, DATE '2021-09-10', DATE '4712-12-31' FROM fx_people WHERE person_id % 7 = 0 AND person_id % 5 <> 0""",
    "fx_cdc_events": """
SELECT event_id, 'cdc-gl-apps' AS stream_name,
       CASE user_id % 5 WHEN 0 THEN 'GL_JE_HEADERS' WHEN 1 THEN 'GL_JE_LINES' WHEN 2 THEN 'GL_BALANCES'
                        WHEN 3 THEN 'GL_CODE_COMBINATIONS' ELSE 'GL_PERIODS' END AS table_name,
       CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation,
       user_id AS pk, value, ts AS event_time, 1 AS row_count
FROM events""",
    "fx_ap_invoices_tgt": """
SELECT invoice_id, invoice_num, vendor_id, invoice_date, gl_date,
       CAST(invoice_amount + CASE WHEN invoice_id % 777 = 0 THEN 1.00 ELSE 0.00 END AS DECIMAL(18,2)) AS invoice_amount,
       amount_paid, invoice_currency_code, payment_status_flag, org_id, set_of_books_id
FROM fx_ap_invoices WHERE invoice_id % 500 <> 0""",
    "fx_ap_invoice_lines_tgt": """
SELECT invoice_id, line_number,
       CAST(amount + CASE WHEN invoice_id % 613 = 0 THEN 0.50 ELSE 0.00 END AS DECIMAL(18,2)) AS amount,
       description, dist_code_combination_id
FROM fx_ap_invoice_lines""",
    # Both sides with repeated keys, some repeats changed on the way.
    "fx_ap_invoices_rep": """
SELECT invoice_id, invoice_num, vendor_id, invoice_amount, payment_status_flag FROM fx_ap_invoices
UNION ALL
SELECT invoice_id, invoice_num, vendor_id, invoice_amount, payment_status_flag FROM fx_ap_invoices WHERE invoice_id % 29 = 0""",
    "fx_ap_invoices_rep_tgt": """
SELECT invoice_id, invoice_num, vendor_id, invoice_amount, payment_status_flag FROM fx_ap_invoices_tgt
UNION ALL
SELECT invoice_id, invoice_num, vendor_id,
       CAST(invoice_amount + CASE WHEN invoice_id % 58 = 0 THEN 1.00 ELSE 0.00 END AS DECIMAL(18,2)), payment_status_flag
FROM fx_ap_invoices_tgt WHERE invoice_id % 29 = 0""",
    "fx_plsql_objects": """
SELECT 'APPS' AS schema_name, 'PROC_' || CAST(p_partkey AS STRING) AS object_name,
       CASE p_partkey % 6
         WHEN 0 THEN 'v := NVL(amt, 0) + SYSDATE;'
         WHEN 1 THEN 'v NUMBER; DBMS_OUTPUT.PUT_LINE(v);'
         WHEN 2 THEN 'SELECT c BULK COLLECT INTO t FROM x; UTL_FILE.FOPEN(f);'
         WHEN 3 THEN 'v := DECODE(a, 1, 2); :NEW.amount := :OLD.amount;'
         WHEN 4 THEN 'PRAGMA AUTONOMOUS_TRANSACTION; FORALL i IN 1..n;'
         ELSE 'UPDATE e SET s = s * 1.1 WHERE d = p;' END AS body
FROM part""",
    # The source dictionary: eight columns per table, one table per eight parts.
    "fx_catalog_columns": """
WITH k AS (
  SELECT p_partkey % 8 AS slot, CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT) AS tno FROM part),
o AS (SELECT 'APPS' AS owner, slot, tno FROM k UNION ALL SELECT 'XX', slot, tno FROM k WHERE tno % 10 = 0 AND slot < 4)
SELECT owner, CASE tno % 9 WHEN 0 THEN 'GL_CODE_COMBINATIONS' WHEN 1 THEN 'GL_JE_LINES' WHEN 2 THEN 'AP_INVOICES_ALL'
                    WHEN 3 THEN 'AP_SUPPLIERS' WHEN 4 THEN 'PER_ALL_PEOPLE_F' WHEN 5 THEN 'PAY_ACTIONS'
                    WHEN 6 THEN 'FND_LOBS' WHEN 7 THEN 'BIN$X' ELSE 'XX_AP_STAGE' END
         || '_' || CAST(tno AS STRING) || CASE WHEN tno % 2 = 0 THEN '_ALL' ELSE '' END AS table_name,
       CAST(slot + 1 AS INT) AS column_id,
       CASE slot WHEN 0 THEN 'ROW_KEY'
                 WHEN 1 THEN 'SEGMENT' || CAST(tno % 5 + 1 AS STRING)
                 WHEN 2 THEN 'ATTRIBUTE' || CAST(tno % 15 + 1 AS STRING)
                 WHEN 3 THEN CASE WHEN tno % 3 = 0 THEN 'EMAIL_ADDRESS' ELSE 'DESCRIPTION' END
                 WHEN 4 THEN 'INVOICE_AMOUNT'
                 WHEN 5 THEN CASE WHEN tno % 6 = 0 THEN 'DATE_OF_BIRTH' ELSE 'CREATION_DATE' END
                 WHEN 6 THEN CASE tno % 4 WHEN 0 THEN 'NATIONAL_IDENTIFIER' WHEN 1 THEN 'Phone_Number' ELSE 'ORG_ID' END
                 ELSE 'SEGMENT_ATTRIBUTE1' END AS column_name,
       CASE slot WHEN 0 THEN 'NUMBER' WHEN 1 THEN 'VARCHAR2(25)' WHEN 2 THEN 'varchar2 (150)'
                 WHEN 3 THEN 'CLOB' WHEN 4 THEN 'NUMBER(15,2)'
                 WHEN 5 THEN CASE tno % 4 WHEN 0 THEN 'DATE' WHEN 1 THEN 'TIMESTAMP(6)'
                                          WHEN 2 THEN 'TIMESTAMP(6) WITH TIME ZONE' ELSE 'TIMESTAMP WITH TIME ZONE' END
                 WHEN 6 THEN CASE tno % 3 WHEN 0 THEN 'INTEGER' WHEN 1 THEN 'BINARY_DOUBLE' ELSE 'CHAR(30)' END
                 ELSE CASE tno % 4 WHEN 0 THEN 'BLOB' WHEN 1 THEN 'LONG RAW' WHEN 2 THEN 'ROWID' ELSE 'XMLTYPE' END
       END AS data_type,
       CAST(CASE slot WHEN 1 THEN 25 WHEN 2 THEN 150 END AS INT) AS data_length,
       CAST(CASE slot WHEN 4 THEN 15 END AS INT) AS data_precision, CAST(CASE slot WHEN 4 THEN 2 END AS INT) AS data_scale,
       CASE WHEN slot IN (0, 4, 5) THEN 'N' ELSE 'Y' END AS nullable,
       slot = 0 OR (slot = 4 AND tno % 10 = 0) AS is_pk
FROM o""",
    "fx_catalog_tables": """
SELECT DISTINCT owner, table_name, CAST(length(table_name) * 1000 AS BIGINT) AS num_rows
FROM fx_catalog_columns""",
    "fx_constraints": """
SELECT DISTINCT owner, 'PK_' || table_name AS constraint_name, 'P' AS constraint_type
FROM fx_catalog_columns WHERE is_pk
UNION ALL
SELECT DISTINCT owner, 'CK_' || table_name, 'C' FROM fx_catalog_columns WHERE nullable = 'N'""",
    "fx_cons_columns": """
SELECT owner, 'PK_' || table_name AS constraint_name, table_name, column_name, column_id AS position
FROM fx_catalog_columns WHERE is_pk
UNION ALL
SELECT owner, 'CK_' || table_name, table_name, column_name, column_id FROM fx_catalog_columns WHERE nullable = 'N'""",
    # The dictionary's entries for the tables above, as the source keeps them.
    "fx_dict_columns": """
SELECT 'AP' AS owner, 'AP_INVOICES_ALL' AS table_name, 1 AS column_id, 'INVOICE_ID' AS column_name, 'NUMBER' AS data_type,
       22 AS data_length, 18 AS data_precision, 0 AS data_scale, 'N' AS nullable
UNION ALL SELECT 'AP', 'AP_INVOICES_ALL', 2, 'INVOICE_NUM', 'VARCHAR2', 8, NULL, NULL, 'Y'
UNION ALL SELECT 'AP', 'AP_INVOICES_ALL', 3, 'VENDOR_ID', 'NUMBER', 22, 18, 0, 'Y'
UNION ALL SELECT 'AP', 'AP_INVOICES_ALL', 4, 'INVOICE_AMOUNT', 'NUMBER', 22, 15, 2, 'Y'
UNION ALL SELECT 'AP', 'AP_INVOICES_ALL', 5, 'INVOICE_DATE', 'DATE', 7, NULL, NULL, 'Y'
UNION ALL SELECT 'AP', 'AP_INVOICES_ALL', 6, 'RATE', 'BINARY_DOUBLE', 8, NULL, NULL, 'Y'
UNION ALL SELECT 'AP', 'AP_INVOICES_ALL', 7, 'ORG_ID', 'INTEGER', 22, NULL, NULL, 'Y'
UNION ALL SELECT 'XX', 'AP_INVOICES_ALL', 1, 'OTHER_ID', 'NUMBER', 22, 18, 0, 'N'
UNION ALL SELECT 'GL', 'GL_CODE_COMBINATIONS', 1, 'CODE_COMBINATION_ID', 'NUMBER', 22, 18, 0, 'N'
UNION ALL SELECT 'GL', 'GL_CODE_COMBINATIONS', 2, 'SEGMENT1', 'VARCHAR2', 25, NULL, NULL, 'Y'
UNION ALL SELECT 'GL', 'GL_CODE_COMBINATIONS', 3, 'SEGMENT2', 'VARCHAR2', 25, NULL, NULL, 'Y'
UNION ALL SELECT 'GL', 'GL_CODE_COMBINATIONS', 4, 'SEGMENT3', 'VARCHAR2', 25, NULL, NULL, 'Y'
UNION ALL SELECT 'GL', 'GL_CODE_COMBINATIONS', 5, 'SEGMENT4', 'VARCHAR2', 25, NULL, NULL, 'Y'
UNION ALL SELECT 'GL', 'GL_CODE_COMBINATIONS', 6, 'SEGMENT5', 'VARCHAR2', 25, NULL, NULL, 'Y'""",
    "fx_dict_constraints": """
SELECT 'AP' AS owner, 'AP_INVOICES_PK' AS constraint_name, 'P' AS constraint_type
UNION ALL SELECT 'AP', 'AP_INVOICES_NN', 'C'
UNION ALL SELECT 'GL', 'GL_JE_HEADERS_PK', 'P'
UNION ALL SELECT 'GL', 'GL_JE_LINES_PK', 'P'
UNION ALL SELECT 'HR', 'PER_PEOPLE_PK', 'P'""",
    "fx_dict_cons_columns": """
SELECT 'AP' AS owner, 'AP_INVOICES_PK' AS constraint_name, 'AP_INVOICES_ALL' AS table_name, 'INVOICE_ID' AS column_name, 1 AS position
UNION ALL SELECT 'AP', 'AP_INVOICES_NN', 'AP_INVOICES_ALL', 'VENDOR_ID', 1
UNION ALL SELECT 'GL', 'GL_JE_HEADERS_PK', 'GL_JE_HEADERS', 'JE_HEADER_ID', 1
UNION ALL SELECT 'GL', 'GL_JE_LINES_PK', 'GL_JE_LINES', 'JE_HEADER_ID', 1
UNION ALL SELECT 'XX', 'GL_JE_LINES_PK', 'GL_JE_LINES', 'JE_LINE_NUM', 2
UNION ALL SELECT 'HR', 'PER_PEOPLE_PK', 'PER_ALL_PEOPLE_F', 'PERSON_ID', 1""",
    # One source, bronze and silver table per part; facts per size and marts per brand.
    "fx_lineage_edges": """
SELECT 'oracle.T' || CAST(p_partkey AS STRING) AS source, 'bronze.t' || CAST(p_partkey AS STRING) AS target, 'load_bronze' AS transformation FROM part
UNION ALL
SELECT 'bronze.t' || CAST(p_partkey AS STRING), 'silver.stg_t' || CAST(p_partkey AS STRING), 'cast_rename' FROM part
UNION ALL
SELECT 'silver.stg_t' || CAST(p_partkey AS STRING), 'gold.fact_' || CAST(p_size AS STRING), 'star_join' FROM part
UNION ALL
SELECT DISTINCT 'gold.fact_' || CAST(p_size AS STRING), 'gold.mart_' || p_brand, 'aggregate' FROM part
UNION ALL
SELECT DISTINCT 'gold.mart_' || p_brand, 'gold.board_report', 'publish' FROM part""",
    "fx_objects": """
SELECT CASE WHEN p_partkey % 11 = 0 THEN 'HR' ELSE 'APPS' END AS owner,
       CASE p_partkey % 4 WHEN 0 THEN 'SYS_C' WHEN 1 THEN 'XX_AP_' WHEN 2 THEN 'XXGL_' ELSE 'SYSLOG' END || CAST(p_partkey AS STRING) AS object_name,
       CASE p_partkey % 5 WHEN 0 THEN 'TRIGGER' WHEN 1 THEN 'INDEX' WHEN 2 THEN 'SEQUENCE' WHEN 3 THEN 'SYNONYM' ELSE 'TABLE' END AS object_type
FROM part""",
    "fx_runs": """
SELECT CASE o_custkey % 3 WHEN 0 THEN 'GL' WHEN 1 THEN 'AP' ELSE 'HCM' END AS module,
       CAST(year(o_orderdate) AS INT) AS period_year, CAST(month(o_orderdate) AS INT) AS period_num,
       CAST(count(*) AS BIGINT) AS rows_extracted,
       CAST(count(*) - sum(CASE WHEN o_orderkey % 997 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS rows_loaded,
       sum(CASE WHEN o_orderkey % 997 = 0 THEN 1 ELSE 0 END) = 0 AS reconciliation_passed
FROM orders GROUP BY 1, 2, 3""",
    "fx_run_events": """
SELECT event_id, user_id AS run_id,
       CASE event_type WHEN 'signup' THEN 'MigrationStarted' WHEN 'view' THEN 'ExtractionComplete'
                       WHEN 'click' THEN 'LoadComplete' WHEN 'purchase' THEN 'ReconciliationComplete'
                       ELSE 'MigrationComplete' END AS event_name, ts AS event_time
FROM events""",
}


def _reads(sql: str) -> list[str]:
    """The views a statement reads, in the order they are defined above."""
    words = set(re.findall(r"\bfx_\w+", sql))
    return [name for name in VIEWS if name in words]


def needed_views(sql: str) -> list[str]:
    """All views a statement needs, earlier ones first."""
    need, todo = set(), _reads(sql)
    while todo:
        name = todo.pop()
        if name not in need:
            need.add(name)
            todo += _reads(VIEWS[name])
    return [name for name in VIEWS if name in need]


def with_views(sql: str) -> str:
    """The statement with every view it needs put in front as a table expression."""
    views = ",\n".join(f"{n} AS ({VIEWS[n].strip()}\n)" for n in needed_views(sql))
    sql = sql.strip()
    if not views:
        return sql
    if re.match(r"(?i)with\s+recursive\b", sql):
        return f"WITH RECURSIVE {views},\n{sql[len('WITH RECURSIVE'):].strip()}"
    if re.match(r"(?i)with\b", sql):
        return f"WITH {views},\n{sql[4:].strip()}"
    return f"WITH {views}\n{sql}"


class Tables:
    """The base tables and views of one data folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._known: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in VIEWS:
                inputs = {t: self[t] for t in self._inputs(VIEWS[name])}
                named = r"\b(" + "|".join(inputs) + r")\b" if inputs else r"(?!)"
                text = re.sub(named, lambda m: "{" + m.group(1) + "}", VIEWS[name])
                self._known[name] = self.spark.sql(text, **inputs)
            else:
                self._known[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._known[name]

    @staticmethod
    def _inputs(sql: str) -> list[str]:
        words = set(re.findall(r"(?i)\b(?:from|join)\s+(\w+)", sql))
        return [t for t in (*BASE_TABLES, *VIEWS) if t in words]
