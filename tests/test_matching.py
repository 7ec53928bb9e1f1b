"""Lines that settle each other, and invoices typed twice."""

import random
from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from closebook.operators import finance, matching, reconcile
from tests.util import rows


def side(spark, data):
    return spark.createDataFrame([(a, i, None if v is None else Decimal(str(v)), g) for a, i, v, g in data], "account int, line_id long, amount decimal(18,2), grp int")


def matched(spark, source, target, **more):
    found = matching.match_lines(side(spark, source), side(spark, target).drop("grp"), ["account"], "0.10", group="grp", **more).collect()
    assert len(found) == len(source) + len(target)
    return {(r["side"][0], r["line_id"]): r["match"] for r in found}, found


def test_each_line_settles_one(spark):
    got, found = matched(
        spark,
        [(1, 1, 5, None), (1, 2, 5, None), (1, 3, 5, None), (1, 4, "7.04", None), (2, 5, 5, None), (1, 6, 9, 1), (1, 7, 2, 1), (1, 8, 1, 2), (None, 9, 5, None), (1, 10, None, None)],
        [(1, 11, 5, None), (1, 12, 5, None), (1, 13, "7.09", None), (1, 14, 11, None), (1, 15, 100, None), (None, 16, 5, None)])
    assert Counter(got[s, i] for s, i in got) == {"exact": 4, "near": 2, "sum": 3, None: 7}
    assert got["s", 4] == got["t", 13] == "near" and got["s", 6] == got["s", 7] == got["t", 14] == "sum"
    assert got["s", 5] is got["t", 15] is got["s", 9] is got["t", 16] is got["s", 10] is got["s", 8] is None
    keys = Counter(r["match_key"] for r in found if r["match_key"] and r["match"] != "sum")
    assert set(keys.values()) == {2}


def test_matches_are_within_the_tolerance_and_nothing_close_is_left(spark):
    rng = random.Random(4)
    source = [(rng.randint(1, 3), i, round(rng.uniform(-20, 20), 2), None) for i in range(400)]
    target = [(a, 1000 + i, round(v + rng.choice([0, 0.01, -0.04, 0.5]), 2), None) for a, i, v, _ in source if rng.random() < 0.9]
    got, found = matched(spark, source, target)
    pairs = {}
    for r in found:
        if r["match_key"]:
            pairs.setdefault(r["match_key"], []).append(r)
    for a, b in pairs.values():
        assert {a["side"], b["side"]} == {"source", "target"} and a["account"] == b["account"]
        assert abs(a["amount"] - b["amount"]) < Decimal("0.10")
    left = [r for r in found if r["match"] is None]
    for r in left:
        for o in left:
            if (r["side"], o["side"]) == ("source", "target") and r["account"] == o["account"]:
                assert abs(r["amount"] - o["amount"]) >= Decimal("0.05")
    assert sum(m == "exact" for m in got.values()) > 150


def test_a_hot_cell_is_dealt_out(spark):
    """All lines of one account and amount: counts decide, ranks are taken in parts."""
    n = 20_000
    base = spark.range(n).select(F.lit(1).alias("account"), F.col("id").alias("line_id"), F.lit(5).cast("decimal(18,2)").alias("amount"))
    found = matching.match_lines(base, base.where("line_id % 4 > 0"), ["account"], "0.10")
    assert rows(found.groupBy("side", "match").count()) == {("source", "exact", n * 3 // 4): 1, ("source", None, n // 4): 1, ("target", "exact", n * 3 // 4): 1}
    assert found.where("match_key IS NOT NULL").groupBy("match_key").count().where("count <> 2").count() == 0


def test_a_pass_sorts_lines_once(spark, monkeypatch):
    """One shuffle of the lines a pass, and the same matches where buckets are taken in parts."""
    rng = random.Random(8)
    source = [(rng.randint(1, 2), i, rng.randint(1, 9), rng.randint(1, 90)) for i in range(300)]
    target = [(rng.randint(1, 2), 1000 + i, rng.randint(1, 9), None) for i in range(260)]
    whole = rows(matching.match_lines(side(spark, source), side(spark, target).drop("grp"), ["account"], "0.10", group="grp"))
    lines = side(spark, source).withColumn("side", F.lit("source")).unionByName(side(spark, target).withColumn("side", F.lit("target")))
    plan = matching._pass(lines, ["account"], F.col("amount"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Join") == 0
    monkeypatch.setattr(matching, "CROWD", 1)
    monkeypatch.setattr(matching, "BUCKETS", 97)
    assert rows(matching.match_lines(side(spark, source), side(spark, target).drop("grp"), ["account"], "0.10", group="grp")) == whole


def test_empty_sides(spark):
    one = [(1, 1, 5, None)]
    assert matched(spark, one, [])[0] == {("s", 1): None}
    assert matched(spark, [], one)[0] == {("t", 1): None}


def test_planted_typos_are_found(spark):
    rng = random.Random(2)
    data, want = [], set()
    for i in range(300):
        num = f"A{rng.randrange(10**7):07d}"
        data.append((i, num, i % 4, Decimal(100 + i)))
        if i % 3 == 0:
            at = rng.randrange(len(num))
            typo = rng.choice([num[:at] + num[at + 1:], num[:at] + "X" + num[at:], num[:at] + "Y" + num[at + 1:]])
            data.append((1000 + i, typo, i % 4, Decimal(100 + i) + Decimal(rng.choice(["0", "0.99", "-1"]))))
            want |= {num, typo}
    df = spark.createDataFrame(data + [(5000, None, 1, Decimal(1)), (5001, "", 1, Decimal(1)), (5002, "A", 1, Decimal(1))],
                               "invoice_id int, invoice_num string, vendor_id int, invoice_amount decimal(18,2)")
    got = finance.near_duplicate_invoices(df)
    assert {r["invoice_num"] for r in got.collect()} == want | {"", "A"}
    apart = df.withColumn("vendor_id", F.col("invoice_id"))
    assert finance.near_duplicate_invoices(apart).count() == 0


def test_numbers_are_spelled_out_in_shared_cells_only(spark):
    """Invoices of one vendor far apart in amount never reach the blocks of their texts."""
    far = spark.range(20_000).select(
        F.col("id").alias("invoice_id"), F.concat(F.lit("INV-"), F.col("id")).alias("invoice_num"), F.lit(1).alias("vendor_id"),
        (F.col("id") * 10).cast("decimal(18,2)").alias("invoice_amount"))
    assert finance.near_duplicate_invoices(far).count() == 0
    # All blocks of an invoice, about 20, were shuffled three times.
    assert shuffled(spark, lambda: finance.near_duplicate_invoices(far)) < 4_000_000


def shuffled(spark, df) -> int:
    """Bytes the stages of a run write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        stages = store.stageList(None, False, False, store.stageList.__class__ and spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    df().write.format("noop").mode("overwrite").save()
    return total() - before


def test_located_differences_shuffle_little(spark):
    """Wide rows of which 1 % differ: the same differences for less than a tenth of the shuffle."""
    wide = [F.sha2(F.concat(F.col("id").cast("string"), F.lit(c)), 512).alias(c) for c in "abcdef"]
    source = spark.range(40_000).select("id", *wide)
    target = source.where("id % 1000 <> 7").withColumn("c", F.when(F.col("id") % 100 == 3, "x").otherwise(F.col("c")))
    key, columns = ["id"], list("abcdef")
    want = rows(reconcile.row_differences(source, target, key, columns))
    assert rows(reconcile.located_differences(source, target, key, columns)) == want and len(want) > 400
    plain = shuffled(spark, lambda: reconcile.row_differences(source, target, key, columns))
    little = shuffled(spark, lambda: reconcile.located_differences(source, target, key, columns))
    assert little < 0.1 * plain, (little, plain)


def test_located_differences_of_repeated_keys_and_nulls(spark):
    s = spark.createDataFrame([(1, "a", None), (1, "b", "x"), (2, None, "a"), (3, "a", None), (4, "q", "q"), (None, "n", "n"), (5, "z", "z")], "k int, v string, w string")
    t = spark.createDataFrame([(1, "a", None), (1, "c", "x"), (2, "a", None), (3, "a", None), (4, "q", "q"), (4, "q", "q"), (None, "n", "m"), (6, "z", "z")], "k int, v string, w string")
    want = rows(reconcile.row_differences(s, t, ["k"], ["v", "w"]))
    for buckets in (1, 7, 1 << 16):
        assert rows(reconcile.located_differences(s, t, ["k"], ["v", "w"], buckets)) == want
    assert reconcile.located_differences(s, s, ["k"], ["v", "w"]).count() == 0
