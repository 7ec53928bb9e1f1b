"""Schemas, fixed lists and rule tables of the three modules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---- Fixed values: must equal the reference's for the same results. ----

MONTHS = [
    "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
]

TARGET_TYPES = {
    "VARCHAR2": "STRING",
    "NVARCHAR2": "STRING",
    "CHAR": "STRING",
    "NCHAR": "STRING",
    "CLOB": "STRING",
    "NCLOB": "STRING",
    "NUMBER": "NUMERIC",
    "FLOAT": "FLOAT64",
    "BINARY_FLOAT": "FLOAT64",
    "BINARY_DOUBLE": "FLOAT64",
    "DATE": "TIMESTAMP",
    "TIMESTAMP": "TIMESTAMP",
    "RAW": "BYTES",
    "BLOB": "BYTES",
    "LONG": "STRING",
    "XMLTYPE": "STRING",
    "ROWID": "STRING",
}
DEFAULT_TARGET_TYPE = "STRING"

LAYER_PREFIXES = {"staging": "stg", "intermediate": "int", "mart": "mart"}

# Source table -> lake table, per module.
MODULE_TABLES = {
    "GL": {
        "GL_JE_HEADERS": "gl_je_headers",
        "GL_JE_LINES": "gl_je_lines",
        "GL_BALANCES": "gl_balances",
        "GL_CODE_COMBINATIONS": "gl_code_combinations",
    },
    "AP": {
        "AP_INVOICES_ALL": "ap_invoices",
        "AP_INVOICE_LINES_ALL": "ap_invoice_lines",
        "AP_SUPPLIERS": "ap_suppliers",
    },
    "HCM": {
        "PER_ALL_PEOPLE_F": "per_all_people_f",
        "PAY_PAYROLL_ACTIONS": "pay_payroll_actions",
    },
}

# Tables change events are taken from, per module.
CDC_TABLES = {
    "GL": [
        "GL_JE_HEADERS",
        "GL_JE_LINES",
        "GL_BALANCES",
        "GL_CODE_COMBINATIONS",
        "GL_PERIODS",
    ],
    "AP": [
        "AP_INVOICES_ALL",
        "AP_INVOICE_LINES_ALL",
        "AP_INVOICE_DISTRIBUTIONS_ALL",
        "AP_SUPPLIERS",
        "AP_SUPPLIER_SITES_ALL",
        "AP_CHECKS_ALL",
    ],
    "HCM": [
        "PER_ALL_PEOPLE_F",
        "PER_ALL_ASSIGNMENTS_F",
        "PAY_PAYROLL_ACTIONS",
        "PER_ADDRESSES_F",
    ],
}
REPLICATION_MODES = ["continuous", "snapshot", "incremental"]

# Table name prefix -> module.
MODULE_PREFIXES = {"GL_": "GL", "AP_": "AP", "PER_": "HCM", "PAY_": "HCM"}

# Open end of a date-effective row.
END_OF_TIME = "4712-12-31"

# Aging bucket -> highest number of days in it.
AGING_BUCKETS = {"0-30 days": 30, "31-60 days": 60, "61-90 days": 90, "91+ days": None}
UNPAID_FLAGS = ["N", "P"]
# ---- End of fixed values. ----

POSTED_STATUSES = ["P", "POSTED"]


@dataclass(frozen=True)
class Rule:
    """One data-quality rule."""

    rule_id: str
    rule_name: str
    module: str
    severity: str  # ERROR, WARNING or INFO
    rule_type: str
    table_name: str
    column_name: str | None = None
    columns: tuple[str, ...] = ()  # any_not_null, all_not_null, balance (debit, credit), uniqueness of several
    expression: str | None = None  # custom_sql: condition every row must meet
    min_value: str | None = None
    max_value: str | None = None
    reference_table: str | None = None
    reference_column: str | None = None


_DR_CR = ("ACCOUNTED_DR", "ACCOUNTED_CR")

# Ids, names, severities and columns of the default rules.
DEFAULT_RULES = [
    Rule("gl_balance_check", "GL Debits Equal Credits", "GL", "ERROR", "balance",
         "GL_JE_LINES", columns=_DR_CR),
    Rule("gl_no_null_amounts", "GL No Null Amounts", "GL", "ERROR", "any_not_null",
         "GL_JE_LINES", "ACCOUNTED_DR", columns=_DR_CR),
    Rule("gl_valid_period", "GL Valid Period Name", "GL", "ERROR", "not_null",
         "GL_JE_HEADERS", "PERIOD_NAME"),
    Rule("ap_positive_amounts", "AP Positive Invoice Amounts", "AP", "ERROR", "range",
         "AP_INVOICES_ALL", "INVOICE_AMOUNT", min_value="0"),
    Rule("ap_valid_vendor", "AP Valid Vendor ID", "AP", "ERROR", "not_null",
         "AP_INVOICES_ALL", "VENDOR_ID"),
    Rule("ap_valid_dates", "AP Valid Invoice/GL Dates", "AP", "WARNING", "all_not_null",
         "AP_INVOICES_ALL", "INVOICE_DATE", columns=("INVOICE_DATE", "GL_DATE")),
    Rule("hcm_unique_employee_num", "HCM Unique Employee Number", "HCM", "ERROR", "uniqueness",
         "PER_ALL_PEOPLE_F", "EMPLOYEE_NUMBER"),
    Rule("hcm_valid_names", "HCM Valid Last Name", "HCM", "ERROR", "not_null",
         "PER_ALL_PEOPLE_F", "LAST_NAME"),
    Rule("hcm_valid_hire_date", "HCM Valid Hire Date", "HCM", "WARNING", "not_null",
         "PER_ALL_PEOPLE_F", "ORIGINAL_DATE_OF_HIRE"),
]


def default_rules(module: str) -> list[Rule]:
    """The default rules of a module; ALL gives every one, an unknown module none."""
    module = module.upper()
    return [r for r in DEFAULT_RULES if module in ("ALL", r.module)]


@dataclass(frozen=True)
class Check:
    """One reconciliation check: a row count, or the sum of a column."""

    module: str
    check_type: str  # row_count, aggregate_balance or checksum
    source_table: str
    column: str | None = None
    columns: tuple[str, ...] = ()  # checksum
    tolerance: str = "0"

    @property
    def target_table(self) -> str:
        return MODULE_TABLES[self.module][self.source_table]


# Checks per module, and the tolerance of a sum.
SUM_TOLERANCE = "0.01"
MODULE_CHECKS = [
    Check("GL", "row_count", "GL_JE_HEADERS"),
    Check("GL", "row_count", "GL_JE_LINES"),
    Check("GL", "aggregate_balance", "GL_JE_LINES", "ACCOUNTED_DR", tolerance=SUM_TOLERANCE),
    Check("GL", "aggregate_balance", "GL_JE_LINES", "ACCOUNTED_CR", tolerance=SUM_TOLERANCE),
    Check("AP", "row_count", "AP_INVOICES_ALL"),
    Check("AP", "row_count", "AP_INVOICE_LINES_ALL"),
    Check("AP", "aggregate_balance", "AP_INVOICES_ALL", "INVOICE_AMOUNT", tolerance=SUM_TOLERANCE),
    Check("HCM", "row_count", "PER_ALL_PEOPLE_F"),
]


def module_checks(module: str) -> list[Check]:
    return [c for c in MODULE_CHECKS if c.module == module.upper()]


# ---- Entity schemas, as DDL text for readers and casts ----

MONEY = "struct<amount:decimal(38,9),currency:string>"
PERIOD = "struct<period_name:string,period_year:int,period_num:int>"
ORG_CONTEXT = (
    "struct<org_id:bigint,set_of_books_id:bigint,ledger_id:bigint,business_group_id:bigint>"
)
ACCOUNT_SEGMENT = "struct<segment_num:int,segment_name:string,segment_value:string>"
ACCOUNT = (
    f"struct<ledger_id:bigint,segments:array<{ACCOUNT_SEGMENT}>,concatenated_segments:string>"
)
INVOICE_LINE = (
    f"struct<line_number:int,amount:{MONEY},description:string,dist_code_combination_id:bigint>"
)
JOURNAL_LINE = (
    f"struct<line_num:int,account_id:bigint,account_structure:{ACCOUNT},entered_dr:{MONEY},"
    f"entered_cr:{MONEY},accounted_dr:{MONEY},accounted_cr:{MONEY},description:string>"
)
ENTITIES = {
    "supplier": (
        "vendor_id bigint, vendor_name string, segment1 string, vat_registration_num string, "
        "enabled_flag string, summary_flag string"
    ),
    "invoice": (
        "invoice_id bigint, invoice_num string, vendor_id bigint, invoice_date timestamp_ntz, "
        f"gl_date timestamp_ntz, invoice_amount {MONEY}, amount_paid {MONEY}, "
        f"invoice_currency_code string, payment_status_flag string, context {ORG_CONTEXT}, "
        f"base_amount {MONEY}, lines array<{INVOICE_LINE}>"
    ),
    "payment": (
        f"check_id bigint, check_number string, check_date timestamp_ntz, amount {MONEY}, "
        "currency_code string, vendor_id bigint, payment_method_lookup_code string, "
        f"status_lookup_code string, context {ORG_CONTEXT}"
    ),
    "journal": (
        f"header_id bigint, batch_name string, journal_name string, period {PERIOD}, "
        f"ledger_id bigint, context {ORG_CONTEXT}, posted_date timestamp_ntz, status string, "
        f"lines array<{JOURNAL_LINE}>"
    ),
    "gl_balance": (
        f"ledger_id bigint, account_id bigint, account_structure {ACCOUNT}, period {PERIOD}, "
        f"currency_code string, begin_balance {MONEY}, period_net {MONEY}, end_balance {MONEY}, "
        f"context {ORG_CONTEXT}"
    ),
    "employee": (
        "person_id bigint, employee_number string, full_name string, first_name string, "
        "last_name string, email_address string, date_of_birth timestamp_ntz, "
        "original_date_of_hire timestamp_ntz, effective_start_date timestamp_ntz, "
        "effective_end_date timestamp_ntz"
    ),
    "assignment": (
        "assignment_id bigint, person_id bigint, organization_id bigint, job_id bigint, "
        "location_id bigint, supervisor_id bigint, assignment_number string, "
        f"assignment_status string, base_salary {MONEY}, context {ORG_CONTEXT}"
    ),
    "payroll_summary": (
        f"payroll_id bigint, person_id bigint, period {PERIOD}, gross_pay {MONEY}, "
        f"net_pay {MONEY}, deductions {MONEY}, currency_code string, context {ORG_CONTEXT}"
    ),
    "cdc_event": (
        "event_id bigint, stream_name string, table_name string, operation string, pk bigint, "
        "value double, event_time timestamp_ntz, row_count int"
    ),
}
