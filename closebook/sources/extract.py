"""Extraction of journals, balances, invoices, people and the source dictionary.

Lines stay a flat table next to their headers, as one header may have more
lines than a row can hold. `*_with_line_totals` gives one row per header with
totals of its lines; `line_pages` nests lines in arrays of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from closebook.functions.scalars import AMOUNT, join_segments
from closebook.functions.skew import checked_join
from closebook.model import END_OF_TIME, POSTED_STATUSES

SEGMENTS = [f"segment{i}" for i in range(1, 6)]
# Accounts that are broadcast so that rows can be gathered before they get their account.
ACCOUNTS_AT_ONCE = 1_500_000


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: int,
    upper: int,
    partitions: int,
    **options,
) -> DataFrame:
    """A live source table, read in `partitions` ranges of a numeric column."""
    return spark.read.format("jdbc").options(
        **jdbc_options(url, table, partition_column, lower, upper, partitions, **options)
    ).load()


def jdbc_options(url, table, partition_column, lower, upper, partitions, **options) -> dict:
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": "10000",
        "pushDownPredicate": "true",
        **options,
    }


def run_query(spark: SparkSession, text: str, params: dict | None = None, **tables) -> DataFrame:
    """SQL with named parameters (:name) over the given DataFrames ({name})."""
    return spark.sql(text, args=params or {}, **tables)


# ---- General ledger ----


def posted_headers(headers: DataFrame, period: str | None = None, ledger_id: int | None = None):
    """Posted journal headers, of one period and ledger when given."""
    rows = headers.where(F.col("status").isin(POSTED_STATUSES))
    if period is not None:
        rows = rows.where(F.col("period_name") == period)
    if ledger_id is not None:
        rows = rows.where(F.col("ledger_id") == ledger_id)
    return rows


def journal_headers(headers, batches, period=None, ledger_id=None) -> DataFrame:
    """Posted headers with the name of their batch; headers without a batch drop out."""
    posted = posted_headers(headers, period, ledger_id)
    return checked_join(posted, batches, "je_batch_id")


def segment_list(present) -> Column:
    """Account segments that are there, as (number, name, value)."""
    if not present:
        return F.array().cast("array<struct<segment_num:int,segment_name:string,segment_value:string>>")
    return F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(s).isNotNull() & (F.col(s) != ""),
                    F.struct(
                        F.lit(int(s[-1])).alias("segment_num"),
                        F.lit(s.capitalize()).alias("segment_name"),
                        F.col(s).cast("string").alias("segment_value"),
                    ),
                )
                for s in present
            ]
        )
    )


def lines_with_account(lines: DataFrame, accounts: DataFrame, lists=False, gather=()) -> DataFrame:
    """Journal or balance rows with the segments of their account.

    With `lists` also the segment list: it hangs on the account alone, so it is built
    once per account and not once per line. With `gather` the rows come rebalanced by those
    columns, to be written by them: before the join where the accounts can be broadcast, so
    that account columns are not shuffled, otherwise after it, without the joined text.
    """
    if gather and accounts.limit(ACCOUNTS_AT_ONCE + 1).count() > ACCOUNTS_AT_ONCE:
        joined = checked_join(lines, accounts.select("code_combination_id", *SEGMENTS), "code_combination_id")
        rows = joined.hint("rebalance", *gather).withColumn("concatenated_segments", join_segments(*SEGMENTS))
        return rows.withColumn("segments", segment_list(SEGMENTS)) if lists else rows
    more = [segment_list(SEGMENTS).alias("segments")] if lists else []
    dims = accounts.select(
        "code_combination_id", *SEGMENTS, join_segments(*SEGMENTS).alias("concatenated_segments"), *more
    )
    if gather:
        lines, dims = lines.hint("rebalance", *gather), F.broadcast(dims)
    return checked_join(lines, dims, "code_combination_id")


def journal_lines(lines, accounts, headers, period=None, ledger_id=None, gather=()) -> DataFrame:
    """Lines of the posted headers, with account segments, ledger and period."""
    scope = posted_headers(headers, period, ledger_id).select(
        "je_header_id", "ledger_id", "period_name"
    )
    wanted = checked_join(lines, scope.dropDuplicates(["je_header_id"]), "je_header_id")
    return lines_with_account(wanted, accounts, gather=gather)


def journals_with_line_totals(
    headers, batches, lines, accounts, period=None, ledger_id=None
) -> DataFrame:
    """One row per posted journal; journals without lines keep zero totals.

    Lines of other journals go before they are grouped; join and grouping share a shuffle.
    """
    head = journal_headers(headers, batches, period, ledger_id)
    known = checked_join(
        lines, accounts.select("code_combination_id"), "code_combination_id", "left_semi"
    )
    scope = posted_headers(headers, period, ledger_id).select("je_header_id")
    found = checked_join(known, scope, "je_header_id", "left_semi")
    totals = found.groupBy("je_header_id").agg(
        F.count("*").alias("line_count"),
        F.sum("accounted_dr").alias("total_dr"),
        F.sum("accounted_cr").alias("total_cr"),
        F.min("je_line_num").alias("first_line"),
        F.max("je_line_num").alias("last_line"),
    )
    zero = F.lit(0).cast(totals.schema["total_dr"].dataType)
    return head.join(totals, "je_header_id", "left").withColumns(
        {
            "line_count": F.coalesce("line_count", F.lit(0)),
            "total_dr": F.coalesce("total_dr", zero),
            "total_cr": F.coalesce("total_cr", zero),
        }
    )


def resolve_journal_headers(raw: DataFrame) -> DataFrame:
    """Raw headers to journal headers, with the fallbacks of absent columns."""
    have = {c.lower() for c in raw.columns}

    def first(default, *names):
        found = [F.col(n) for n in names if n in have]
        return F.coalesce(*found, F.lit(default))

    return raw.select(
        F.col("je_header_id").alias("header_id"),
        first("", "batch_name").alias("batch_name"),
        first("", "name", "journal_name").alias("journal_name"),
        F.col("period_name"),
        first(2026, "period_year").alias("period_year"),
        first(1, "period_num").alias("period_num"),
        first(0, "ledger_id", "set_of_books_id").cast("bigint").alias("ledger_id"),
        first(0, "org_id").cast("bigint").alias("org_id"),
        first(0, "set_of_books_id").cast("bigint").alias("set_of_books_id"),
        (F.col("posted_date") if "posted_date" in have else F.lit(None).cast("timestamp_ntz"))
        .alias("posted_date"),
        first("UNPOSTED", "status").alias("status"),
    )


def resolve_journal_lines(raw: DataFrame) -> DataFrame:
    """Raw lines to journal lines; amounts keep zero, absent ones are null."""
    have = {c.lower() for c in raw.columns}

    def first(default, *names):
        found = [F.col(n) for n in names if n in have]
        return F.coalesce(*found, F.lit(default))

    currency = first("USD", "currency_code")

    def money(name):
        if name not in have:
            return F.lit(None).cast("struct<amount:decimal(38,9),currency:string>").alias(name)
        value = F.struct(F.col(name).cast(AMOUNT).alias("amount"), currency.alias("currency"))
        return F.when(F.col(name).isNotNull(), value).alias(name)

    present = [s for s in SEGMENTS if s in have]
    segments = F.col("segments") if "segments" in have else segment_list(present)
    joined = "concatenated_segments" if "concatenated_segments" in have else None
    return raw.select(
        F.col("je_header_id").alias("header_id"),
        first(0, "je_line_num", "line_num").cast("int").alias("line_num"),
        first(0, "code_combination_id").cast("bigint").alias("account_id"),
        segments.alias("segments"),
        (F.col(joined) if joined else join_segments(*present) if present else F.lit(""))
        .alias("concatenated_segments"),
        money("entered_dr"),
        money("entered_cr"),
        money("accounted_dr"),
        money("accounted_cr"),
        (F.col("description") if "description" in have else F.lit(None).cast("string"))
        .alias("description"),
    )


def actual_balances(balances, period=None, ledger_id=None) -> DataFrame:
    """Actual balances outside the statistical currency."""
    rows = balances.where((F.col("actual_flag") == "A") & (F.col("currency_code") != "STAT"))
    if period is not None:
        rows = rows.where(F.col("period_name") == period)
    if ledger_id is not None:
        rows = rows.where(F.col("ledger_id") == ledger_id)
    return rows


def gl_balances(balances, accounts, period=None, ledger_id=None, gather=()) -> DataFrame:
    """Actual balances outside the statistical currency, with net begin and end."""
    rows = actual_balances(balances, period, ledger_id)

    def amount(name):
        return F.coalesce(name, F.lit(0).cast(balances.schema[name].dataType))

    begin = amount("begin_balance_dr") - amount("begin_balance_cr")
    net = amount("period_net_dr") - amount("period_net_cr")
    nets = {"begin_balance_net": begin, "period_net": net, "end_balance_net": begin + net}
    if not gather:
        return lines_with_account(rows.withColumns(nets), accounts)
    # Rows are shuffled without the nets.
    placed = lines_with_account(rows, accounts, gather=gather).withColumns(nets)
    own = dict.fromkeys(["code_combination_id", *rows.columns, *nets])
    return placed.select(*own, *SEGMENTS, "concatenated_segments")


# ---- Payables ----


def ap_invoices(invoices: DataFrame, org_id: int | None = None) -> DataFrame:
    """Invoice headers, of one organization when given; nothing paid counts as 0."""
    rows = invoices if org_id is None else invoices.where(F.col("org_id") == org_id)
    zero = F.lit(0).cast(invoices.schema["amount_paid"].dataType)
    return rows.withColumn("amount_paid", F.coalesce("amount_paid", zero))


def ap_invoice_lines(lines: DataFrame, invoices: DataFrame, org_id: int | None = None):
    """Invoice lines whose header is in the extract."""
    ids = ap_invoices(invoices, org_id).select("invoice_id")
    return checked_join(lines, ids, "invoice_id", "left_semi")


def ap_invoice_lines_with_org(lines, invoices, org_id=None) -> DataFrame:
    """The same lines with the organization of their header."""
    orgs = ap_invoices(invoices, org_id).select("invoice_id", "org_id")
    return checked_join(lines, orgs.dropDuplicates(["invoice_id"]), "invoice_id")


def invoices_with_line_totals(invoices, lines, org_id=None) -> DataFrame:
    """One row per invoice with totals of its lines; invoices without lines stay.

    Lines of other organizations go before they are grouped.
    """
    wanted = lines if org_id is None else ap_invoice_lines(lines, invoices, org_id)
    totals = wanted.groupBy("invoice_id").agg(
        F.count("*").alias("line_count"),
        F.sum("amount").alias("line_total"),
        F.min("line_number").alias("first_line"),
        F.max("line_number").alias("last_line"),
    )
    zero = F.lit(0).cast(totals.schema["line_total"].dataType)
    return ap_invoices(invoices, org_id).join(totals, "invoice_id", "left").withColumns(
        {
            "line_count": F.coalesce("line_count", F.lit(0)),
            "line_total": F.coalesce("line_total", zero),
        }
    )


def _invoice_money(column: str, currency: str = "invoice_currency_code") -> Column:
    return F.struct(F.col(column).cast(AMOUNT).alias("amount"), F.col(currency).alias("currency")).alias(column)


def resolve_invoices(raw: DataFrame, lines: DataFrame, org_id: int | None = None) -> DataFrame:
    """Raw headers to invoices, one row each, with the number of their lines.

    The lines themselves stay a table of their own (`resolve_invoice_pages`): one invoice
    may have more of them than a row can hold.
    """
    rows = invoices_with_line_totals(raw, lines, org_id)
    return rows.select(
        "invoice_id", "invoice_num", "vendor_id", "invoice_date", "gl_date",
        _invoice_money("invoice_amount"), _invoice_money("amount_paid"), "invoice_currency_code",
        "payment_status_flag",
        F.struct(
            F.col("org_id").cast("bigint").alias("org_id"),
            F.col("set_of_books_id").cast("bigint").alias("set_of_books_id"),
        ).alias("context"),
        F.col("line_count").alias("lines_count"),
    )


def resolve_invoice_pages(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of invoice lines with amounts in the currency of their invoice.

    Equal lines are one entry with its number of `copies`; `line_count` counts them all.
    """
    currency = ap_invoices(raw).select("invoice_id", "invoice_currency_code").dropDuplicates(["invoice_id"])
    lines = F.transform(
        "lines",
        lambda x: F.struct(
            x["line_number"].alias("line_number"),
            F.struct(
                x["amount"].cast(AMOUNT).alias("amount"),
                F.col("invoice_currency_code").alias("currency"),
            ).alias("amount"),
            x["description"].alias("description"),
            x["dist_code_combination_id"].alias("dist_code_combination_id"),
            x["copies"].alias("copies"),
        ),
    )
    return checked_join(pages, currency, "invoice_id").select(
        "invoice_id", "page", "part", "line_count", lines.alias("lines")
    )


#: Page of lines without a number.
NO_NUMBER = -1


def line_pages(
    lines: DataFrame, key: str, number: str, fields: list[str], page_size: int = 1000
) -> DataFrame:
    """Lines nested under their header in pages of `page_size` line numbers.

    Equal copies are counted first and kept as one entry with its number of copies. As
    numbers repeat or are null (page -1), a page may still have many entries: it has a
    part for every `2 * page_size` of them, and a hash deals them out. So neither a long
    document nor a flood of copies, of one number or of none makes a row or a task large.
    """
    entry = [number, *[f for f in fields if f != number]]
    page = F.call_function("div", F.col(number) - 1, F.lit(page_size)).cast("int")
    distinct = (
        lines.withColumn("page", F.coalesce(page, F.lit(NO_NUMBER)))
        .groupBy(key, "page", *entry).agg(F.count("*").alias("copies"))
    )
    sizes = distinct.groupBy(F.col(key).alias("__key"), F.col("page").alias("__page")).agg(
        F.ceil(F.count("*") / (2 * page_size)).alias("__parts")
    )
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("page") == F.col("__page"))
    part = F.pmod(F.xxhash64(*entry), F.col("__parts")).cast("int")
    return (
        distinct.join(sizes, same)
        .withColumn("part", part)
        .groupBy(key, "page", "part")
        .agg(
            F.sort_array(F.collect_list(F.struct(*entry, "copies"))).alias("lines"),
            F.sum("copies").alias("line_count"),
        )
    )


# ---- People and organizations ----


def current_employees(people: DataFrame) -> DataFrame:
    """People flagged current whose row is still open."""
    return people.where(
        (F.col("current_employee_flag") == "Y")
        & (F.col("effective_end_date") == F.lit(END_OF_TIME).cast("date"))
    )


def resolve_employees(raw: DataFrame) -> DataFrame:
    """Raw people to employees; the full name falls back to first and last name."""
    have = {c.lower() for c in raw.columns}

    def text(name, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)

    joined = F.concat(text("first_name", ""), F.lit(" "), text("last_name", ""))
    full = F.coalesce(F.col("full_name"), joined) if "full_name" in have else joined
    kept = [
        c
        for c in (
            "email_address",
            "date_of_birth",
            "original_date_of_hire",
            "effective_start_date",
            "effective_end_date",
        )
        if c in have
    ]
    return raw.select(
        "person_id",
        text("employee_number", "").alias("employee_number"),
        full.alias("full_name"),
        text("first_name", "").alias("first_name"),
        text("last_name", "").alias("last_name"),
        *kept,
    )


def resolve_org_id(orgs: DataFrame, name: str) -> DataFrame:
    """Organization id of a name; no row when unknown."""
    return orgs.where(F.col("org_name") == name).select("org_id")


def with_org_context(rows: DataFrame, orgs: DataFrame) -> DataFrame:
    """Rows with the ledger and set of books of their organization, null when unknown."""
    context = orgs.select("org_id", "set_of_books_id", "ledger_id", "org_name")
    return checked_join(
        rows.drop("set_of_books_id", "ledger_id", "org_name"), context, "org_id", "left"
    )
