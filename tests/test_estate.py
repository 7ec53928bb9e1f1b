"""Catalog, personal data, code audit, lineage."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from closebook.operators import catalog, codeaudit, compliance, lineage
from tests.util import rows


def test_modules_by_prefix(spark):
    cases = {"GL_X": "GL", "AP_X": "AP", "PER_X": "HCM", "PAY_X": "HCM", "XX_GL_": "UNKNOWN", "GLX": "UNKNOWN"}
    df = spark.createDataFrame([(k,) for k in cases], "table_name string")
    assert {r[0]: r[1] for r in df.select("table_name", catalog.module_of()).collect()} == cases


def test_pattern_matches_inside_names(spark):
    df = spark.createDataFrame([("GL_A",), ("XX_gl_b",), ("AP_A",)], "table_name string")
    assert catalog.matching(df, "gl_%").count() == 2
    assert catalog.matching(df, "%").count() == 3


def test_system_objects_are_left_out(spark):
    df = spark.createDataFrame(
        [("APPS", "SYS_C1", "INDEX"), ("APPS", "SYSLOG", "INDEX"), ("APPS", "XSYS_1", "INDEX"),
         ("APPS", "T1", "TABLE"), ("HR", "X", "TRIGGER")],
        "owner string, object_name string, object_type string",
    )
    # The underscore is a wildcard, so SYSLOG is left out too.
    assert [r["object_name"] for r in catalog.custom_objects(df, "APPS").collect()] == ["XSYS_1"]


def test_flexfields(spark):
    df = spark.createDataFrame(
        [("A", "T", 2, "SEGMENT2"), ("A", "T", 1, "SEGMENT1"), ("A", "T", 3, "ATTRIBUTE1"), ("A", "T", 4, "SEGMENT_ATTRIBUTE"),
         ("A", "U", 1, "ID"), ("B", "T", 1, "SEGMENT9")],
        "owner string, table_name string, column_id int, column_name string",
    )
    got = {(r["owner"], r["table_name"], r["flexfield_type"]): r["columns"] for r in catalog.flexfields(df).collect()}
    assert got == {("A", "T", "KFF"): ["SEGMENT1", "SEGMENT2", "SEGMENT_ATTRIBUTE"], ("A", "T", "DFF"): ["ATTRIBUTE1"],
                   ("B", "T", "KFF"): ["SEGMENT9"]}


def test_schema_metadata(spark):
    tables = spark.createDataFrame(
        [("O", "GL_T", 10), ("O", "BIN$1", 1), ("O", "E", None), ("P", "GL_T", 3)], "owner string, table_name string, num_rows long")
    columns = spark.createDataFrame(
        [("O", "GL_T", 2, "B", "DATE", 7, None, None, "Y"), ("O", "GL_T", 1, "A", "NUMBER", 22, 9, 2, "N"),
         ("P", "GL_T", 1, "C", "VARCHAR2", 5, None, None, "Y")],
        "owner string, table_name string, column_id int, column_name string, data_type string, data_length int, "
        "data_precision int, data_scale int, nullable string",
    )
    keys = spark.createDataFrame([("O", "GL_T", "B", 2), ("O", "GL_T", "A", 1)],
                                 "owner string, table_name string, column_name string, position int")
    both = {(r["owner"], r["table_name"]): r for r in catalog.schema_metadata(tables, columns, keys).collect()}
    assert set(both) == {("O", "GL_T"), ("O", "E"), ("P", "GL_T")}
    assert [c["column_name"] for c in both["P", "GL_T"]["columns"]] == ["C"]
    counts = {(r["owner"], r["table_name"]): r["column_count"] for r in catalog.classify(tables, columns).collect()}
    assert counts == {("O", "GL_T"): 2, ("O", "E"): 0, ("P", "GL_T"): 1}
    assert catalog.table_columns(columns, "O", "GL_T") == [("A", "NUMBER(9,2)", None), ("B", "DATE", None)]
    assert catalog.table_columns(columns, "P", "GL_T") == [("C", "VARCHAR2", 5)]
    got = {t: r for (o, t), r in both.items() if o == "O"}
    assert [c["column_name"] for c in got["GL_T"]["columns"]] == ["A", "B"]
    assert got["GL_T"]["primary_key"] == ["A", "B"]
    assert (got["E"]["columns"], got["E"]["primary_key"], got["E"]["estimated_rows"]) == ([], [], 0)


def test_key_description(spark):
    df = spark.createDataFrame(
        [(True, None, None), (False, "AP_SUPPLIERS", "VENDOR_ID"), (True, "T", "C"), (False, None, None)],
        "is_pk boolean, fk_target_table string, fk_target_column string",
    )
    assert [r[0] for r in df.select(catalog.key_description()).collect()] == [
        "Primary key.", "Foreign key to AP_SUPPLIERS.VENDOR_ID.",
        "Primary key. Foreign key to T.C.", "",
    ]


def test_relationships(spark):
    vendors = spark.range(100).select(F.col("id").alias("vendor_id"))
    invoices = spark.range(400).select(F.col("id").alias("invoice_id"), (F.col("id") % 98).alias("vendor_id"))
    loose = spark.range(200).select(F.col("id").alias("vendor_id"))
    other_type = spark.createDataFrame([("1",)], "vendor_id string")
    got = catalog.relationships(
        {"V": vendors, "I": invoices, "L": loose, "S": other_type}, {"V": "vendor_id"}
    ).collect()
    assert [(r["source_table"], r["distinct_values"], r["matched_values"]) for r in got] == [("I", 98, 98)]
    narrow = invoices.select(F.col("vendor_id").cast("int").alias("vendor_id"))
    money = invoices.select(F.col("vendor_id").cast("decimal(12,2)").alias("vendor_id"))
    many = {f"T{i}": narrow if i % 2 else money for i in range(70)}
    found = catalog.relationships({"V": vendors, **many}, {"V": "vendor_id"}).collect()
    assert len(found) == 70 and all(r["matched_values"] == 98 for r in found)
    all_of_them = catalog.relationships({"V": vendors, "L": loose}, {"V": "vendor_id"}, threshold=0.0)
    assert all_of_them.first()["containment"] == 0.5
    with pytest.raises(ValueError):
        catalog.relationships({"V": vendors}, {"V": "vendor_id"})


def test_cast_profile(spark):
    df = spark.createDataFrame([("1", "abc"), ("x", None), (None, "abcdef")], "N string, T string")
    got = {r["column_name"]: tuple(r)[2:] for r in catalog.cast_profile(df, [("N", "NUMBER", None), ("T", "VARCHAR2(5)", 5)]).collect()}
    assert got == {"n": (3, 1, 1, 0), "t": (3, 1, 0, 1)}


# ---- Personal data ----


def test_pii_kinds(spark):
    cases = {"EMAIL_ADDRESS": "EMAIL", "email": "EMAIL", "National_Identifier": "NATIONAL_ID",
             "DATE_OF_BIRTH": "BIRTH", "PHONE1": "PHONE", "NAME": None}
    df = spark.createDataFrame([(k,) for k in cases], "column_name string")
    assert {r[0]: r[1] for r in df.select("column_name", compliance.pii_kind()).collect()} == cases


def test_pii_values(spark):
    df = spark.createDataFrame(
        [("a", "mail x@y.co and z@w.org"), ("a", "none at all"), ("b", "10.0.0.1 +966 55 123 4567 1234567890"), ("b", None)],
        "g string, text string",
    )
    got = {(r["g"], r["pii_kind"]): (r["rows_with_match"], r["matches"]) for r in compliance.pii_values(df, ["text"], ["g"]).collect()}
    assert got == {
        ("a", "EMAIL"): (1, 2), ("a", "PHONE"): (0, 0), ("a", "NATIONAL_ID"): (0, 0), ("a", "IPV4"): (0, 0),
        ("b", "EMAIL"): (0, 0), ("b", "PHONE"): (1, 1), ("b", "NATIONAL_ID"): (1, 1), ("b", "IPV4"): (1, 1),
    }


def test_needed_text_never_loses_a_match(spark, folder):
    """The cheap test before a pattern must not change the count."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("text")
    for kind, text in compliance.NEEDED_TEXT.items():
        found = F.regexp_count("text", F.lit(compliance.VALUE_PATTERNS[kind]))
        assert docs.where((found > 0) & ~F.contains("text", F.lit(text))).count() == 0


def test_masking(spark):
    df = spark.createDataFrame([(7, "sara@x.sa", "1234567890", "Sara"), (7, "@", "12", None), (None, None, None, "x")],
                               "person_id int, email string, nid string, first_name string")
    out = compliance.mask(df, emails=["email"], ids=["nid"], keys=["person_id"], hide=["first_name"], secret="s").collect()
    key = hashlib.sha256(b"s7").hexdigest()
    assert [tuple(r) for r in out] == [(key, "s***@x.sa", "******7890", None), (key, "*", "**", None), (None, None, None, None)]
    odd = spark.createDataFrame([("no address",), ("a b@c",), ("@x.sa",), ("s@x.sa",), ("two\nlines",)], "email string")
    assert [r[0] for r in compliance.mask(odd, emails=["email"]).collect()] == ["*" * 10, "*" * 5, "*" * 5, "s***@x.sa", "*" * 9]
    with pytest.raises(ValueError):
        compliance.mask(df, keys=["person_id"])


def test_consent_log(spark, tmp_path):
    path = str(tmp_path / "consent")
    at = dt.datetime(2026, 1, 1)
    for hour, action in ((0, "GRANT"), (2, "REVOKE"), (1, "AMEND")):
        compliance.log_consent(
            spark.createDataFrame([(1, action, "", at + dt.timedelta(hours=hour)), (2, "GRANT", "", at)], compliance.CONSENT_SCHEMA), path
        )
    got = {r["person_id"]: r["action"] for r in compliance.latest_consent(spark.read.parquet(path)).collect()}
    assert got == {1: "REVOKE", 2: "GRANT"}


def test_compliance_report(spark):
    pii = spark.createDataFrame([("T", "EMAIL"), ("T", "PHONE")], "table_name string, column_name string")
    rules = spark.createDataFrame([(False, "ERROR"), (False, "WARNING"), (True, "ERROR")], "passed boolean, severity string")
    certs = spark.createDataFrame([("CERTIFIED",)], "status string")
    got = {r["control"]: (r["findings"], r["status"]) for r in compliance.compliance_report("NDMO", pii, pii.limit(1), rules, certs).collect()}
    assert got == {
        "unmasked_pii_columns": (1, "NON_COMPLIANT"), "failed_error_rules": (1, "NON_COMPLIANT"),
        "uncertified_runs": (0, "COMPLIANT"),
    }


# ---- Code audit ----

BODIES = {
    "select nvl(a, 0), Nvl2(b, 1, 2) from t": "select COALESCE(a, 0), CASE WHEN b IS NOT NULL THEN 1 ELSE 2 END from t",
    "d := SYSDATE; e := systimestamp;": "d := CURRENT_TIMESTAMP; e := CURRENT_TIMESTAMP;",
    ":new.x := :OLD.y;": "NEW.x := OLD.y;",
    "v VARCHAR2(10); n NUMBER; i INTEGER;": "v VARCHAR(10); n NUMERIC; i INTEGER;",
    "DBMS_OUTPUT.PUT_LINE('a');": "RAISE NOTICE '%', ('a');",
    "RAISE_APPLICATION_ERROR(-20001, 'no');": "RAISE EXCEPTION 'no');",
    "TYPE t IS TABLE OF x;": "TYPE t [] x;",
    "x := DECODE(a, 1, 2);": "x := -- DECODE requires manual conversion: DECODE(a, 1, 2);",
    "to_date(s) my_nvl(s)": "TO_TIMESTAMP(s) my_nvl(s)",
    "PHONE_NUMBER NUMBERS": "PHONE_NUMBER NUMBERS",
}


def test_rewrites(spark):
    df = spark.createDataFrame([(k,) for k in BODIES], "body string")
    assert {r[0]: r[1] for r in df.select("body", codeaudit.rewrite()).collect()} == BODIES


def test_unsupported_constructs(spark):
    words = ["dbms_sql.x", "UTL_FILE.x", "DBMS_PIPE", "DBMS_JOB", "DBMS_LOB", "AUTONOMOUS_TRANSACTION",
             "bulk \n collect", "FORALL i", "PIPELINED", "RESULT_CACHE"]
    df = spark.createDataFrame([(w,) for w in words], "body string")
    got = [r[0] for r in df.select(codeaudit.unsupported_constructs()).collect()]
    assert got == [[d] for d in codeaudit.UNSUPPORTED.values()]
    clean = spark.createDataFrame([("UPDATE e SET s = s * 1.1;",), (None,)], "body string")
    assert [r[0] for r in clean.select(codeaudit.unsupported_constructs()).collect()] == [[], []]


# ---- Lineage ----

EDGES = [("a", "b", "x"), ("b", "c", "x"), ("a", "c", "x"), ("c", "d", "x"), ("d", "b", "x"), ("z", "y", "x")]


def test_lineage_ends_on_cycles(spark):
    edges = spark.createDataFrame(EDGES, lineage.EDGE_SCHEMA)
    assert rows(lineage.lineage_graph(edges, "a", "downstream")) == {("b", 1): 1, ("c", 1): 1, ("d", 2): 1}
    assert rows(lineage.lineage_graph(edges, "c", "upstream")) == {("a", 1): 1, ("b", 1): 1, ("d", 2): 1}
    assert lineage.lineage_graph(edges, "nothing").count() == 0
    long = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "x") for i in range(12)], lineage.EDGE_SCHEMA)
    assert lineage.lineage_graph(long, "n0", "downstream").agg(F.max("depth")).first()[0] == 12
    with pytest.raises(ValueError):
        lineage.lineage_graph(edges, "a", "sideways")


def test_documented_edges_are_kept(spark, tmp_path):
    path = str(tmp_path / "edges")
    lineage.document_lineage(spark, path, EDGES[:2])
    lineage.document_lineage(spark, path, EDGES[2:])
    assert rows(spark.read.parquet(path)) == rows(spark.createDataFrame(EDGES, lineage.EDGE_SCHEMA))


def test_references_under_other_names_are_found(spark):
    """Planted references, exact and nearly so, of numbers and texts, and columns that are none."""
    n = 20_000
    people = spark.range(n).select(F.col("id").alias("person_id"), F.concat(F.lit("E"), F.col("id")).alias("number"))
    orders = spark.range(30_000).select(
        (F.col("id") % n).cast("decimal(20,0)").alias("buyer"), F.when(F.col("id") % 40 == 0, -F.col("id")).otherwise(F.col("id") % n).alias("mostly"),
        F.when(F.col("id") % 3 == 0, F.col("id") + n).otherwise(F.col("id") % n).alias("seldom"), F.concat(F.lit("E"), F.col("id") % 9).alias("badge"),
        (F.col("id") + 10 * n).alias("other"), F.lit(None).cast("int").alias("nothing"), F.lit(1.5).alias("rate"))
    found = catalog.implied_references({"PEOPLE": people, "ORDERS": orders}, {"PEOPLE": "person_id"}).collect()
    assert {(r["source_table"], r["source_column"], r["target_column"]) for r in found} == {("ORDERS", "buyer", "person_id"), ("ORDERS", "mostly", "person_id")}
    assert {r["source_column"]: r["distinct_values"] for r in found}["buyer"] == n
    texts = catalog.implied_references({"PEOPLE": people, "ORDERS": orders}, {"PEOPLE": "number"})
    assert [(r["source_column"], r["containment"]) for r in texts.collect()] == [("badge", 1.0)]
    assert catalog.implied_references({"PEOPLE": people}, {"PEOPLE": "person_id"}).count() == 0


def test_implied_references_read_a_table_once_for_all_keys(spark):
    """Columns that look like several keys are grouped once, also with more columns than a number has bits."""
    n = 300
    keys = {f"K{i}": "id" for i in range(3)}
    tables = {name: spark.range(n + int(name[1])) for name in keys}
    tables["WIDE"] = spark.range(n).select(*[(F.col("id") % (n - c)).alias(f"c{c}") for c in range(70)])
    found = catalog.implied_references(tables, keys)
    got = {(r["source_table"], r["source_column"], r["target_table"]): (r["distinct_values"], r["matched_values"]) for r in found.collect()}
    want = {("WIDE", f"c{c}", k): (n - c, n - c) for c in range(70) for k in keys}
    want |= {(a, "id", b): (n + int(a[1]), n + min(int(a[1]), int(b[1]))) for a in keys for b in keys if a != b}
    assert got == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == len(tables)
