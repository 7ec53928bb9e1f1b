import datetime as dt
from decimal import Decimal

import pytest

from closebook.model import ENTITIES
from closebook.operators import layers
from closebook.sources import extract, files
from tests.util import rows


def test_entity_schemas_parse(spark):
    for ddl in ENTITIES.values():
        assert spark.createDataFrame([], ddl).count() == 0


def test_flatten(spark):
    at = dt.datetime(2026, 1, 2, 3, 4, 5)
    df = spark.createDataFrame(
        [(1, (Decimal("45000.00"), "USD"), at, at.replace(microsecond=120000), (101, 1), [1, 2], dt.date(2026, 1, 2)),
         (2, None, None, None, None, None, None)],
        "id int, amount struct<amount:decimal(18,2),currency:string>, at timestamp_ntz, fine timestamp_ntz, "
        "context struct<org_id:int,sob:int>, lines array<int>, day date",
    )
    out = layers.flatten(df)
    assert out.columns == ["id", "amount", "amount_currency", "at", "fine", "context", "lines_count", "day"]
    first, second = out.orderBy("id").collect()
    assert tuple(first) == (
        1, 45000.0, "USD", "2026-01-02T03:04:05", "2026-01-02T03:04:05.120000",
        '{"org_id":101,"sob":1}', 2, dt.date(2026, 1, 2),
    )
    assert tuple(second) == (2, None, None, None, None, None, 0, None)


def test_resolved_invoice_without_lines(spark):
    raw = spark.createDataFrame(
        [(1, "N1", 5, None, None, Decimal(10), None, "USD", "N", 101, 1)],
        "invoice_id int, invoice_num string, vendor_id int, invoice_date timestamp_ntz, gl_date timestamp_ntz, "
        "invoice_amount decimal(18,2), amount_paid decimal(18,2), invoice_currency_code string, "
        "payment_status_flag string, org_id int, set_of_books_id int",
    )
    lines = spark.createDataFrame(
        [], "invoice_id int, line_number int, amount decimal(18,2), description string, dist_code_combination_id long"
    )
    row = extract.resolve_invoices(raw, lines).first()
    assert row["lines_count"] == 0 and row["amount_paid"]["amount"] == 0 and row["context"]["org_id"] == 101
    # Equal lines count one by one, on one row per invoice, however many there are.
    line = (1, 1, Decimal(10), "x", 7)
    many = spark.createDataFrame([line, line] + [(1, None, Decimal(1), None, None)] * 2500, lines.schema)
    flat = layers.flatten(extract.resolve_invoices(raw, many)).collect()
    assert [(r["lines_count"], r["invoice_amount"]) for r in flat] == [(2502, 10.0)]
    pages = extract.line_pages(many, "invoice_id", "line_number", ["amount", "description", "dist_code_combination_id"])
    resolved = extract.resolve_invoice_pages(raw, pages).collect()
    assert sorted((r["page"], r["line_count"], len(r["lines"])) for r in resolved) == [(-1, 2500, 1), (0, 2, 1)]
    assert {(x["copies"], x["amount"]["currency"]) for r in resolved for x in r["lines"]} == {(2, "USD"), (2500, "USD")}


def test_spark_types():
    cases = {
        "VARCHAR2(25)": "string", "NUMBER": "decimal(38,9)", "number(15,2)": "decimal(15,2)",
        "NUMBER(*,2)": "decimal(38,9)", "DATE": "timestamp_ntz", "BLOB": "binary", "FLOAT": "double",
        "INTEGER": "string", "NUMBER(60,2)": "decimal(38,9)",
    }
    assert {k: layers.spark_type(k) for k in cases} == cases


def test_staging_and_intermediate(spark):
    raw = spark.createDataFrame([("1", "a", "12.345", "bad"), ("x", None, "n/a", "2026-01-02 03:04:05")],
                                "ID string, SEGMENT1 string, AMT string, AT string")
    staged = layers.staging(raw, [("ID", "NUMBER"), ("SEGMENT1", "VARCHAR2(5)"), ("AMT", "NUMBER(9,2)"), ("AT", "DATE")])
    assert staged.columns == ["id", "segment1", "amt", "at"]
    assert rows(staged) == {
        (Decimal(1), "a", Decimal("12.35"), None): 1,
        (None, None, None, dt.datetime(2026, 1, 2, 3, 4, 5)): 1,
    }
    inter = layers.intermediate(staged)
    assert inter.columns == ["id", "segment1", "amt", "at", "segment1_value"]


def test_mart_union_of_different_widths(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([(2, 3.0)], "id int, b double")
    out = layers.mart_union({"A_ALL": a, "B": b})
    with pytest.raises(ValueError):
        layers.mart_union({"A_ALL": a, "A": b})
    assert rows(out.select("source_table", "id", "a", "b")) == {("stg_a", 1, "x", None): 1, ("stg_b", 2, None, 3.0): 1}


def test_model_names_that_clash(spark):
    df = spark.createDataFrame([("X_ALL", "stg_x"), ("X", "stg_x"), ("Y", "stg_y")], "table_name string, model_name string")
    assert [r["model_name"] for r in layers.check_model_names(df).collect()] == ["stg_x"]


def test_load_twice_same_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    jan = spark.createDataFrame([(1, "Jan-26"), (2, "Jan-26"), (3, None)], "id int, period_name string")
    feb = spark.createDataFrame([(4, "Feb-26")], "id int, period_name string")
    for _ in range(2):
        files.load_table(jan, path, ["period_name"])
        files.load_table(feb, path, ["period_name"])
    assert rows(files.read_table(spark, path)) == rows(jan.unionByName(feb))
    files.load_table(feb, path, ["period_name"], whole=True)
    assert rows(files.read_table(spark, path, feb)) == rows(feb)
    plain = str(tmp_path / "p")
    for _ in range(2):
        files.load_table(jan, plain)
    assert files.read_table(spark, plain).count() == 3


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_export_files(spark, tmp_path, fmt):
    text = {
        "csv": "id,amount\n1,10.50\n2,oops\n3,1.25\n",
        "json": '{"id":1,"amount":10.50}\n{"id":2,"amount":\n{"id":3,"amount":1.25}\n',
    }[fmt]
    (tmp_path / "f").write_text(text)
    raw = files.read_export(spark, str(tmp_path), "id int, amount decimal(9,2)", fmt)
    good, bad = files.split_export(raw)
    assert rows(good) == {(1, Decimal("10.50")): 1, (3, Decimal("1.25")): 1}
    assert [r[0] for r in bad.collect()] == [{"csv": "2,oops", "json": '{"id":2,"amount":'}[fmt]]
    assert bad.count() == 1
