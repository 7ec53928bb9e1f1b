"""Aging, period totals, balance proof, close, odd invoices and star-schema marts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closebook.functions.scalars import elapsed_days
from closebook.functions.skew import checked_join
from closebook.model import AGING_BUCKETS, POSTED_STATUSES, UNPAID_FLAGS
from closebook.session import scratch_path


def amount_remaining():
    return F.col("invoice_amount") - F.col("amount_paid")


def aging(invoices: DataFrame, as_of: str, by=("invoice_currency_code",)) -> DataFrame:
    """Unpaid amount per aging bucket, four rows per group.

    Days are whole elapsed days; invoices dated later than `as_of` fall in the
    first bucket. Amounts stay decimal and are kept apart by `by`.
    """
    as_of_time = F.lit(as_of).cast("timestamp_ntz")
    days = elapsed_days(F.col("invoice_date").cast("timestamp_ntz"), as_of_time)
    unpaid = invoices.where(F.col("payment_status_flag").isin(UNPAID_FLAGS)).select(
        *by, days.alias("days"), amount_remaining().alias("remaining")
    )
    zero = F.lit(0).cast(unpaid.schema["remaining"].dataType)
    sums, rows, above = [], [], None
    for i, (label, top) in enumerate(AGING_BUCKETS.items()):
        inside = F.lit(True) if above is None else F.col("days") > above
        if top is not None:
            inside = inside & (F.col("days") <= top)
        sums.append(F.coalesce(F.sum(F.when(inside, F.col("remaining"))), zero).alias(f"b{i}"))
        rows.append(F.struct(F.lit(label).alias("bucket"), F.col(f"b{i}").alias("amount")))
        above = top
    return unpaid.groupBy(*by).agg(*sums).select(*by, F.inline(F.array(*rows)))


TOTAL_KEYS = ["ledger_id", "period_name", "code_combination_id", "currency_code"]
# Proved and balanced mean a difference below this; a reconciliation check allows it.
DIFFERENCE = "0.01"


def posted_line_totals(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Debit and credit per ledger, period, account and currency of posted journals.

    Journals without a period are a group of their own, so that no posted line is lost.
    """
    posted = headers.where(F.col("status").isin(POSTED_STATUSES)).select(
        "je_header_id", "ledger_id", "period_name"
    )
    wanted = lines.select(
        "je_header_id", "code_combination_id", "currency_code", "accounted_dr", "accounted_cr"
    )
    joined = checked_join(wanted, posted, "je_header_id")
    zero = F.lit(0).cast(lines.schema["accounted_dr"].dataType)
    return joined.groupBy(*TOTAL_KEYS).agg(
        F.coalesce(F.sum("accounted_dr"), zero).alias("total_dr"),
        F.coalesce(F.sum("accounted_cr"), zero).alias("total_cr"),
        F.count("*").alias("line_count"),
    )


def period_totals(headers: DataFrame, lines: DataFrame, totals: DataFrame | None = None):
    """Net of all posted lines per ledger, period (null: none given) and currency."""
    totals = posted_line_totals(headers, lines) if totals is None else totals
    return totals.groupBy("ledger_id", "period_name", "currency_code").agg(
        F.sum("total_dr").alias("total_dr"),
        F.sum("total_cr").alias("total_cr"),
        (F.sum("total_dr") - F.sum("total_cr")).alias("net"),
        F.sum("line_count").alias("line_count"),
    )


def _same_keys(left: str, right: str) -> Column:
    """Equal total keys of two aliases; a period may be absent on both sides."""
    same = F.lit(True)
    for k in TOTAL_KEYS:
        same = same & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return same


def _begin() -> Column:
    return F.coalesce("begin_balance_dr", F.lit(0)) - F.coalesce("begin_balance_cr", F.lit(0))


def balance_proof(balances, headers, lines, totals: DataFrame | None = None) -> DataFrame:
    """Begin plus posted net against the reported end, per balance row.

    Amounts keep the scale of the source: a currency may have more than two decimals.
    """
    totals = posted_line_totals(headers, lines) if totals is None else totals
    nets = totals.select(*TOTAL_KEYS, (F.col("total_dr") - F.col("total_cr")).alias("net"))
    joined = balances.alias("b").join(nets.alias("t"), _same_keys("b", "t"), "left")
    expected = _begin() + F.coalesce("net", F.lit(0))
    difference = expected - F.col("reported_end_balance")
    keys = ["ledger_id", "code_combination_id", "currency_code", "period_name"]
    return joined.select(
        *[F.col(f"b.{k}").alias(k) for k in keys],
        expected.alias("expected_end"),
        F.col("reported_end_balance").alias("reported_end"),
        difference.alias("difference"),
        (F.abs(difference) < F.lit(DIFFERENCE).cast("decimal(3,2)")).alias("proved"),
    )


def period_close(headers, lines, balances, totals: DataFrame | None = None) -> DataFrame:
    """Close state per ledger and period: are debits and credits equal, do balances prove.

    Line totals and balances are each grouped once by ledger, period, account and currency
    and meet in one full join, so periods with balances only, or without any, are there.
    A balance row enters as what its begin lacks to its reported end; equal ones of an
    account are counted.
    """
    posted = posted_line_totals(headers, lines) if totals is None else totals
    lacking = balances.select(*TOTAL_KEYS, (_begin() - F.col("reported_end_balance")).alias("lack"))
    reported = (
        lacking.groupBy(*TOTAL_KEYS, "lack").agg(F.count("*").alias("n"))
        .groupBy(*TOTAL_KEYS).agg(
            F.sum("n").alias("accounts"), F.collect_list(F.struct("lack", "n")).alias("lacks"))
    )
    joined = posted.alias("p").join(reported.alias("r"), _same_keys("p", "r"), "full")
    net = F.coalesce(F.col("total_dr") - F.col("total_cr"), F.lit(0))
    limit = F.lit(DIFFERENCE).cast("decimal(3,2)")
    # A balance without begin or end cannot prove.
    missed = F.aggregate(
        F.coalesce("lacks", F.array().cast(reported.schema["lacks"].dataType)),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + F.when(F.coalesce(F.abs(F.col("net") + x["lack"]) < limit, F.lit(False)), 0).otherwise(x["n"]),
    )
    keyed = joined.select(
        F.coalesce("p.ledger_id", "r.ledger_id").alias("ledger_id"),
        F.coalesce("p.period_name", "r.period_name").alias("period_name"),
        net.alias("net"), "line_count", "accounts", "lacks",
    )
    return (
        keyed.select("*", missed.alias("missed"))
        .groupBy("ledger_id", "period_name")
        .agg(
            F.sum("net").alias("discrepancy_amount"),
            F.coalesce(F.sum("line_count"), F.lit(0)).alias("line_count"),
            F.coalesce(F.sum("accounts"), F.lit(0)).alias("accounts"),
            F.sum("missed").alias("accounts_not_proved"),
        )
        .withColumn(
            "is_balanced",
            (F.abs(F.col("discrepancy_amount")) < limit) & (F.col("accounts_not_proved") == 0),
        )
    )


def unbalanced_journals(lines: DataFrame) -> DataFrame:
    """Journals whose debits and credits differ; candidates for unreconciled items."""
    totals = lines.groupBy("je_header_id").agg(
        F.coalesce(F.sum("accounted_dr"), F.lit(0)).alias("total_dr"),
        F.coalesce(F.sum("accounted_cr"), F.lit(0)).alias("total_cr"),
        F.count("*").alias("line_count"),
    )
    return totals.where(F.col("total_dr") != F.col("total_cr"))


DUPLICATE_KEY = ["vendor_id", "invoice_num", "invoice_amount"]


def duplicate_invoices(invoices: DataFrame) -> DataFrame:
    """Groups of invoices with the same vendor, number and amount, one row per group."""
    return (
        invoices.where(F.col("vendor_id").isNotNull())
        .groupBy(*DUPLICATE_KEY)
        .agg(
            F.count("*").alias("copies"),
            F.min("invoice_id").alias("first_invoice_id"),
            F.max("invoice_id").alias("last_invoice_id"),
        )
        .where(F.col("copies") > 1)
    )


def near_duplicate_invoices(invoices: DataFrame, width="1.00") -> DataFrame:
    """Invoices of one vendor whose numbers are one edit apart and whose amounts differ by at
    most `width`: a row for each number and amount, with how many others are near it.

    Two numbers one edit apart are equal after one character is dropped from one of them or
    from both, so each number goes to the blocks of its own text and of every text with one
    character less; amounts go to two cells of the width. Numbers are only spelled out in
    cells where the vendor has another invoice. A block holds one text with one
    character more at most, which bounds it whatever the vendor: no vendor is compared
    within itself. Blocks go by a hash; candidates are checked by vendor and edit distance.
    Equal invoices count once, as copies.
    """
    whole = invoices.dropna(subset=DUPLICATE_KEY).withColumn("invoice_amount", F.col("invoice_amount").cast("decimal(18,2)"))
    known = whole.groupBy(*DUPLICATE_KEY).agg(F.count("*").alias("copies"), F.min("invoice_id").alias("first_id"))
    # Kept as a table: it is read for the cells, for their rows and for the result.
    path = scratch_path(known.sparkSession, "invoices")
    known.write.parquet(path)
    known = known.sparkSession.read.schema(known.schema).parquet(path)
    cell = F.floor(F.col("invoice_amount") / F.lit(width).cast("decimal(18,2)"))
    billed = known.drop("copies").withColumn("cell", F.explode(F.array(cell, cell + 1)))
    at = ["vendor_id", "cell"]
    met = billed.groupBy(*at).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    shorter = F.expr(
        "array_distinct(array_append(transform(sequence(1, greatest(length(invoice_num), 1)), "
        "i -> concat(substring(invoice_num, 1, i - 1), substring(invoice_num, i + 1))), invoice_num))")
    blocks = F.transform(shorter, lambda text: F.xxhash64("vendor_id", "cell", text))
    placed = billed.join(met, at, "left_semi").select(*DUPLICATE_KEY, "first_id", F.explode(blocks).alias("block"))
    placed = placed.withColumn("n", F.count("*").over(Window.partitionBy("block"))).where("n > 1").drop("n")
    other = placed.select(
        "block", F.col("vendor_id").alias("o_vendor"), F.col("invoice_num").alias("o_num"), F.col("invoice_amount").alias("o_amount"),
        F.col("first_id").alias("o_id"))
    near = placed.join(other, "block").where(
        ((F.col("vendor_id") == F.col("o_vendor")) & (F.col("invoice_num") != F.col("o_num")) & (F.levenshtein("invoice_num", "o_num") <= 1))
        & (F.abs(F.col("invoice_amount") - F.col("o_amount")) <= F.lit(width).cast("decimal(18,2)")))
    # The blocks two numbers share make one of it. `first_id` keeps both sides of the join one shuffle.
    once = near.groupBy(*DUPLICATE_KEY, "first_id", "o_num", "o_amount").agg(F.min("o_id").alias("o_id"))
    found = once.groupBy(*DUPLICATE_KEY).agg(F.count("*").alias("near"), F.min("o_id").alias("first_near_id"))
    return known.join(found, DUPLICATE_KEY).select(*DUPLICATE_KEY, "copies", "near", "first_near_id")


def outlier_invoices(invoices: DataFrame, deviations: float = 3.0) -> DataFrame:
    """Invoices more than `deviations` sample standard deviations off their vendor's mean.

    The first pass takes exact totals, the second sums squares of what each invoice is off
    the mean, so nothing cancels. Deviations are taken times the vendor's number of
    invoices, which keeps them exact decimals. A vendor whose amounts are all equal, or who
    has one invoice, has no outliers.
    """
    amount = F.col("invoice_amount").cast("decimal(18,2)")
    rows = invoices.where(F.col("vendor_id").isNotNull() & F.col("invoice_amount").isNotNull())
    totals = rows.groupBy("vendor_id").agg(
        F.count("*").alias("n"), F.sum(amount).alias("total"),
        F.min(amount).alias("least"), F.max(amount).alias("largest"),
    ).where(F.col("least") < F.col("largest"))
    off = (amount * F.col("n") - F.col("total")).cast("double")
    apart = checked_join(
        rows.select("invoice_id", "vendor_id", "invoice_amount"), totals, "vendor_id"
    ).select("invoice_id", "vendor_id", "invoice_amount", "n", off.alias("off"))
    spread = apart.groupBy("vendor_id").agg(
        F.sqrt(F.sum(F.col("off") * F.col("off")) / (F.max("n") - 1)).alias("spread")
    )
    return checked_join(apart, spread, "vendor_id").where(
        F.abs("off") > F.lit(deviations) * F.col("spread")
    ).select(
        "vendor_id", "invoice_id", "invoice_amount", (F.col("spread") / F.col("n")).alias("vendor_stddev")
    )


def trial_balance(headers, lines, accounts) -> DataFrame:
    """Posted totals by ledger, period and the first segment, with subtotals (rollup).

    Accounts are summed to companies first, so the rollup only multiplies those.
    """
    totals = posted_line_totals(headers, lines)
    company = accounts.select("code_combination_id", F.col("segment1").alias("company"))
    by_company = checked_join(totals, company, "code_combination_id").groupBy(
        "ledger_id", "period_name", "company"
    ).agg(F.sum("total_dr").alias("dr"), F.sum("total_cr").alias("cr"))
    return by_company.rollup("ledger_id", "period_name", "company").agg(
        F.grouping_id().alias("level"),
        F.sum("dr").alias("total_dr"),
        F.sum("cr").alias("total_cr"),
        (F.sum("dr") - F.sum("cr")).alias("net"),
    )


def vendor_mart(invoices, suppliers) -> DataFrame:
    """Payables fact by vendor: invoices, amounts and what is open, per currency."""
    facts = invoices.groupBy("vendor_id", "invoice_currency_code").agg(
        F.count("*").alias("invoice_count"),
        F.sum("invoice_amount").alias("invoice_amount"),
        F.sum("amount_paid").alias("amount_paid"),
        F.sum(amount_remaining()).alias("amount_open"),
        F.min("invoice_date").alias("first_invoice"),
        F.max("invoice_date").alias("last_invoice"),
    )
    # Grouped facts have at most one row per vendor and currency.
    return facts.join(suppliers.select("vendor_id", "vendor_name"), "vendor_id", "left")


#: Months in a number of `_active`.
MONTHS = 62


def _active(rows: DataFrame, by, first: dt.date, last: dt.date) -> DataFrame:
    """People (`by`, month, active) whose versions (person_id, s, e) hold at a month's end."""
    begin = 12 * first.year + first.month
    months = 12 * last.year + last.month - begin + 1

    def turn(day):
        return 12 * F.year(day) + F.month(day) - begin

    # A version that ends within a month does not hold at its end.
    held = rows.dropna(subset=["s", "e"]).select(
        "person_id", *by, F.greatest(turn("s"), F.lit(0)).alias("low"), F.least(turn(F.date_add("e", 1)) - 1, F.lit(months - 1)).alias("high"),
    ).where("low <= high")
    words = range(-(-months // MONTHS))

    def bits(word):
        low, high = F.greatest(F.col("low"), F.lit(word * MONTHS)), F.least(F.col("high"), F.lit(word * MONTHS + MONTHS - 1))
        one = F.lit(1).cast("bigint")
        run = F.call_function("shiftleft", one, high - low + 1) - 1
        return F.when(low <= high, F.call_function("shiftleft", run, low - word * MONTHS)).otherwise(F.lit(0).cast("bigint"))

    people = held.groupBy("person_id", *by).agg(*[F.bit_or(bits(w)).alias(f"bits{w}") for w in words])

    def held_in(word):
        turns = F.sequence(F.lit(word * MONTHS), F.lit(min(months, (word + 1) * MONTHS) - 1))
        return F.filter(turns, lambda i: F.call_function("shiftright", F.col(f"bits{word}"), i - word * MONTHS).bitwiseAND(F.lit(1)) == 1)

    turns = F.concat(*[held_in(w) for w in words])
    counts = people.select(*by, F.explode(turns).alias("turn")).groupBy(*by, "turn").agg(F.count("*").alias("active"))
    month = F.add_months(F.lit(first.replace(day=1)), F.col("turn"))
    return counts.select(*by, month.alias("month"), "active")


def gold_headcount(people: DataFrame, first: str, last: str, by=("first_name",)) -> DataFrame:
    """People per month and `by`: active at the month's end, joined and left in it.

    `people` is date-effective: a version holds from its start to its end, both included, and
    a person has several. The months a version holds at the end of, from `first` to `last`, are
    bits of a few numbers, so the interval join is one row a person and group, however many
    months and versions there are. A person counts once a month, in the group of the version of its
    last day. A version that starts where none of the person held the day before has joined;
    one that ends where none follows has left.
    """
    start, end = F.col("effective_start_date").cast("date"), F.col("effective_end_date").cast("date")
    low, high = F.lit(first).cast("date"), F.lit(last).cast("date")
    rows = people.where(F.col("person_id").isNotNull()).select("person_id", *by, start.alias("s"), end.alias("e"))
    # Days a person is in, from and to, as edges: what starts the day after an end cancels it.
    edges = rows.select("person_id", *by, F.col("s").alias("day"), F.lit(1).alias("step")).unionByName(
        rows.select("person_id", *by, F.date_add("e", 1).alias("day"), F.lit(-1).alias("step")))
    moved = edges.where(F.col("day").between(low, F.date_add(F.last_day(high), 1))).groupBy("person_id", "day").agg(
        F.sum("step").alias("step"), *[F.max_by(c, F.struct("step", c)).alias(c) for c in by])
    # A leaver's day is the last one held.
    moved = moved.where("step <> 0").select(
        *by, F.trunc(F.when(F.col("step") > 0, F.col("day")).otherwise(F.date_sub("day", 1)), "MM").alias("month"),
        F.when(F.col("step") > 0, 1).otherwise(0).alias("joined"), F.when(F.col("step") < 0, 1).otherwise(0).alias("left"))
    moved = moved.where(F.col("month").between(low, high)).groupBy(*by, "month").agg(F.sum("joined").alias("joined"), F.sum("left").alias("left"))
    active = _active(rows, by, dt.date.fromisoformat(first), dt.date.fromisoformat(last))
    both = active.unionByName(moved, allowMissingColumns=True)
    return both.groupBy(*by, "month").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("active", "joined", "left")])
