import hashlib
import random
import re

from closebook.llm import decontaminate as d
from tests.llm import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute(text, items, size=13):
    words = WORD.findall(lower(text))
    hit, ids = set(), set()
    for item_id, item in items:
        own = WORD.findall(lower(item))
        k = min(size, len(own))
        for i in range(len(own) - k + 1 if own else 0):
            for j in range(len(words) - k + 1):
                if words[j:j + k] == own[i:i + k]:
                    hit.update(range(j, j + k))
                    ids.add(item_id)
    ids = sorted(str(i) for i in ids if i is not None)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def planted(spark):
    rng = random.Random(5)
    items = [(i, cases.sentence(rng, rng.randint(13, 30))) for i in range(12)]
    items += [(20, "Short Item"), (21, None), (22, ""), (23, "!!"), (24, items[0][1]), (None, cases.sentence(rng, 14)), (3, items[4][1])]
    docs = cases.documents(spark)
    texts = [r["text"] for r in docs.collect()][:20]
    more = []
    for i in range(30):
        base = (texts[i % len(texts)] or "").split(" ")
        item = (items[i % len(items)][1] or "").split(" ")
        start = rng.randint(0, max(0, len(item) - 14))
        base[len(base) // 2:len(base) // 2] = [w.upper() for w in item[start:start + rng.choice([12, 13, 14, 40])]]
        more.append((1000 + i, ", ".join(base)))
    more.append((2000, "x short  item. SHORT-ITEM short item"))
    extra = spark.createDataFrame(more, "doc_id bigint, text string")
    return docs.unionByName(extra, allowMissingColumns=True), items


def check(spark, docs, items, **kwargs):
    found = d.find_contamination(docs, benchmark(spark, items), **kwargs).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert len(found) == sum(map(len, texts.values()))
    for r in found:
        want = brute(r["text"], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want
        for span in r["spans"]:
            part = r["text"][span["start"]:span["end"]]
            assert WORD.findall(lower(part)) and WORD.match(lower(part)[0]) and WORD.match(lower(part)[-1])
        assert sum(len(WORD.findall(lower(r["text"][s["start"]:s["end"]]))) for s in r["spans"]) == r["n_hit"]
    return found


def test_against_brute_force(spark):
    docs, items = planted(spark)
    found = check(spark, docs, items)
    assert any(r["contaminated"] for r in found) and not all(r["contaminated"] for r in found)


def test_benchmark_in_blocks_gives_the_same(spark):
    docs, items = planted(spark)
    check(spark, docs.where("doc_id >= 1000"), items, block_chars=400)


def test_empty_tables(spark):
    docs, items = planted(spark)
    assert d.find_contamination(cases.no_documents(spark), benchmark(spark, items)).count() == 0
    found = d.find_contamination(docs, benchmark(spark, [])).collect()
    assert not any(r["contaminated"] or r["n_hit"] for r in found)


def test_a_task_takes_one_python_worker(spark):
    docs, items = planted(spark)
    found = d.find_contamination(docs, benchmark(spark, items))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
