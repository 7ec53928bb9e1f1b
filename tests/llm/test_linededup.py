import random

from pyspark.sql import functions as F

from closebook.llm import linededup as l
from tests.llm import cases


def brute(rows, run=3):
    """Kept texts by (id, text); rows equal in both are one place."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    seen, kept = set(), {}
    for doc_id, text, _ in order:
        lines = (text or "").split("\n")
        gone = set()
        for i in range(len(lines) - run + 1):
            window = tuple(lines[i:i + run])
            if window in seen:
                gone.update(range(i, i + run))
            seen.add(window)
        kept[(doc_id, text)] = (
            text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone),
            sum(1 for i in gone if i - 1 not in gone))
    return kept


def compare(docs):
    rows = [(r["doc_id"], r["text"], r["h"]) for r in docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    want = brute(rows)
    keyed = docs.withColumn("before", F.col("text"))
    got = l.delete_repeated_runs(keyed).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["text"], r["n_lines"], r["n_removed"], r["n_runs"]) == want[(r["doc_id"], r["before"])]


def test_every_case(spark):
    compare(cases.documents(spark))


def test_random_lines(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 25)))) for i in range(60)]
    compare(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_no_documents(spark):
    assert l.delete_repeated_runs(cases.no_documents(spark)).count() == 0


def test_main_path_has_no_python(spark, folder):
    plan = l.op7(spark, folder)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def brute_words(text, run, words, seen):
    """Lines of `text` in windows of `run` lines, and in shorter ones of over `words` words, that `seen` has."""
    lines, gone = (text or "").split("\n"), set()
    for size in range(1, run + 1):
        for i in range(len(lines) - size + 1):
            window = tuple(lines[i:i + size])
            if size == run or sum(len(x.split()) for x in window) > words:
                if window in seen:
                    gone.update(range(i, i + size))
                seen.add(window)
    return text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)


def test_short_runs_of_many_words(spark):
    rng = random.Random(5)
    passage, half, other = cases.sentence(rng, 51), cases.sentence(rng, 26), cases.sentence(rng, 25)
    short = cases.sentence(rng, 50)
    texts = [passage, passage, f"a\n{passage}\nb", f"c\n{half}\n{other}\nd", f"{half}\n{other}", f"e\n{other}\n{half}",
             short, short, f"{passage}\n{passage}", f"{half}\n{half}\n{half}", "", None, "x"]
    pool = [cases.sentence(rng, n) for n in (3, 20, 30, 40, 55)]
    texts += ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    seen, want = set(), []
    for text in texts:
        want.append(brute_words(text, l.RUN, l.WORDS, seen))
    got = {r["doc_id"]: r for r in l.delete_repeated_runs(docs, words=l.WORDS).collect()}
    assert [got[i]["text"] for i in range(len(texts))] == want
    assert want[:8] == [passage, "", "a\nb", f"c\n{half}\n{other}\nd", "", f"e\n{other}\n{half}", short, short]
    assert got[1]["n_removed"] == 1 and got[4]["n_removed"] == 2
