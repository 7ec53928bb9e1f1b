import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from closebook.llm import minhash as m
from closebook.llm.components import components
from closebook.llm.shingles import common, shingle_set
from tests.llm import cases


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x.group().lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """(n_shingles, smallest id of the component) for each row."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    places = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            places[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in places[x] if j > i).items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                group[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = root(i)
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return [(len(s), least.get(root(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def compare(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = Counter((doc_id, *x) for (doc_id, _), x in zip(rows, brute(rows), strict=True))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in m.near_duplicates(docs).collect())
    assert got == want


def family(rng, size, edits, words=160):
    """Copies of one text, each with words of its own changed."""
    base = [cases.word(rng) for _ in range(words)]
    out = []
    for _ in range(size):
        own = base[:]
        for at in rng.sample(range(words), rng.randint(0, edits)):
            own[at] = cases.word(rng) + "q"
        out.append(" ".join(own))
    return out


def test_every_case(spark):
    compare(cases.documents(spark))


def test_families_whose_copies_link_through_others(spark):
    rng = random.Random(4)
    texts = [t for size, edits in ((60, 4), (50, 2), (40, 7), (30, 1)) for t in family(rng, size, edits)]
    texts += [cases.prose(rng, 10) for _ in range(30)]
    rng.shuffle(texts)
    compare(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(m, "BLOCK_MEMBERS", 5)
    monkeypatch.setattr(m, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(m, "MEMBERS_PER_SALT", 3)


def test_small_blocks_and_salts_lose_no_link(spark, small_blocks):
    rng = random.Random(9)
    texts = family(rng, 50, 6) + family(rng, 40, 3)
    compare(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


def test_no_documents(spark):
    assert m.near_duplicates(cases.no_documents(spark)).count() == 0


def test_signature_estimates_jaccard():
    rng = random.Random(2)
    a, b = family(rng, 2, 12)
    x, y = shingle_set(a), shingle_set(b)
    both = common(x, y)
    true = both / (len(x) + len(y) - both)
    assert both == len(shingles(a) & shingles(b))
    seen = np.mean(m.signature(x, 512) == m.signature(y, 512))
    assert abs(seen - true) < 0.08


def test_words_over_pieces_of_a_long_text(monkeypatch):
    from closebook.llm import shingles as s

    text = cases.prose(random.Random(3), 200)
    want = shingle_set(text)
    monkeypatch.setattr(s, "CHUNK", 64)
    assert np.array_equal(shingle_set(text), want) and len(want) == len(shingles(text))


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(500, i) for i in range(501, 560)]
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in links:
        if a != b:
            a, b = root(a), root(b)
            group[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {x: root(x) for x in group}
