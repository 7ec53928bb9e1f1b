import calendar
import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from closebook.functions import scalars


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_segments_skip_empty(spark):
    df = spark.createDataFrame(
        [("01", "100", "1110"), ("01", "", "6100"), (None, "200", None), ("", None, "")],
        "a string, b string, c string",
    )
    got = [r[0] for r in df.select(scalars.join_segments("a", "b", "c")).collect()]
    assert got == ["01.100.1110", "01.6100", "200", ""]


def test_period_text(spark):
    cases = {
        "Jan-26": (2026, 1), "DEC-99": (2099, 12), "feb": (2026, 2), "March-2031": (2031, 3),
        "Adj-25": (2025, 1), "-26": (2026, 0), "May-x": (None, 5),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    rows = df.select("t", scalars.period_year("t"), scalars.period_number("t")).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == cases
    none = one(spark, y=scalars.period_year(F.lit(None).cast("string")),
               n=scalars.period_number(F.lit(None).cast("string")))
    assert none == (None, None)


def test_months_are_the_calendar():
    assert scalars.MONTHS == list(calendar.month_abbr)[1:]


@settings(max_examples=25, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.datetimes(dt.datetime(1900, 1, 1), dt.datetime(2200, 1, 1)),
            st.datetimes(dt.datetime(1900, 1, 1), dt.datetime(2200, 1, 1)),
        ),
        min_size=1, max_size=20,
    )
)
def test_elapsed_days_is_floor(spark, pairs):
    df = spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a timestamp_ntz, b timestamp_ntz"
    )
    got = {r["i"]: r["d"] for r in df.select("i", scalars.elapsed_days("a", "b").alias("d")).collect()}
    assert got == {i: (b - a).days for i, (a, b) in enumerate(pairs)}


def test_elapsed_days_crossing_midnight(spark):
    a, b = "2026-01-01 23:00:00", "2026-02-01 01:00:00"
    row = one(
        spark,
        d=scalars.elapsed_days(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")),
        back=scalars.elapsed_days(F.lit(b).cast("timestamp_ntz"), F.lit(a).cast("timestamp_ntz")),
    )
    assert row == (30, -31)


def test_variance(spark):
    cases = [(1000, 990, 1.0), (0, 0, 0.0), (0, 100, 100.0), (-200, -100, 50.0)]
    df = spark.createDataFrame([(s, t) for s, t, _ in cases], "s int, t int")
    got = [r[0] for r in df.select(scalars.variance_pct("s", "t")).collect()]
    assert got == [p for *_, p in cases]


def test_target_types(spark):
    cases = {
        "VARCHAR2(25)": "STRING", "number(15,2)": "NUMERIC", "DATE": "TIMESTAMP", "BLOB": "BYTES",
        "TIMESTAMP(6) WITH TIME ZONE": "TIMESTAMP", "TIMESTAMP WITH TIME ZONE": "STRING",
        "LONG RAW": "STRING", "INTEGER": "STRING", " clob ": "STRING", "BINARY_FLOAT": "FLOAT64",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", scalars.target_type("t")).collect()} == cases


def test_model_names(spark):
    df = spark.createDataFrame(
        [("GL_JE_HEADERS",), ("AP_INVOICES_ALL",), ("PER_ALL_PEOPLE_F",), ("X__",)], "t string"
    )
    got = [r[0] for r in df.select(scalars.model_name("t", "staging")).collect()]
    assert got == ["stg_gl_je_headers", "stg_ap_invoices", "stg_per_people_f", "stg_x"]
    assert df.select(scalars.model_name("t", "gold")).first()[0] == "gold_gl_je_headers"


def test_checksum_ignores_order_and_sees_moved_text(spark):
    def checksum(rows):
        df = spark.createDataFrame(rows, "a string, b string")
        return df.agg(scalars.table_checksum(["a", "b"])).first()[0]

    assert checksum([("a", "b"), ("c", None)]) == checksum([("c", None), ("a", "b")])
    assert checksum([("a", "")]) != checksum([("", "a")])
    assert checksum([("a", None)]) != checksum([("a", "")])
    assert checksum([("a|1:b", "c")]) != checksum([("a", "b|1:c")])
    assert checksum([]) == 0
