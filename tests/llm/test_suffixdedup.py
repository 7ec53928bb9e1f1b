import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from closebook.llm import suffixdedup as s
from tests.llm import cases


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def compare(docs, length, **kwargs):
    rows = docs.select("doc_id", "text").collect()
    want = Counter(zip([r["doc_id"] for r in rows], brute([r["text"] for r in rows], length), strict=True))
    got = s.remove_repeats(docs, length=length, **kwargs).collect()
    assert Counter((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got) == want


@pytest.mark.parametrize("length", [3, 9, 20, 60, 150])
def test_expansion_finds_equal_windows(length):
    rng = random.Random(length)
    base = bytes(rng.choice(b"abc") for _ in range(600))
    for _ in range(15):
        pieces = set()
        for _ in range(6):
            at = rng.randint(0, 400)
            piece = bytearray(base[at:at + rng.randint(length, length + 200)])
            if rng.random() < 0.6:
                piece[rng.randrange(len(piece))] = 120
            pieces.add(bytes(piece))
        pieces.add(b"a" * (length + 20))
        pieces = [np.frombuffer(p, np.uint8) for p in sorted(pieces) if len(p) >= length]
        seen = Counter(bytes(p[i:i + length]) for p in pieces for i in range(len(p) - length + 1))
        for p, (again, _) in zip(pieces, s.repeated_windows(pieces, length), strict=True):
            assert again.tolist() == [seen[bytes(p[i:i + length])] > 1 for i in range(len(p) - length + 1)]


def test_segments_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(s, "STARTS", 50)
    data = s._bytes(cases.prose(random.Random(1), 30) + "za" * 200)
    keys, firsts, lasts, _ = s.segments(data, 40, 10)
    starts = [i for a, b in zip(firsts, lasts, strict=True) for i in range(a, b + 1)]
    assert starts == list(range(len(data) - 39))
    assert len(s.segments(data[:39], 40, 10)[0]) == 0


def test_every_case(spark):
    compare(cases.documents(spark), 120, gram=30)


def test_contract_length(spark):
    compare(cases.documents(spark), 400)


def test_repeats_within_a_document_and_over_edges(spark):
    rng = random.Random(3)
    unit = cases.prose(rng, 3)
    rows = [(0, unit + cases.prose(rng, 2) + unit), (1, "x" * 500), (2, "ab" * 300), (3, cases.prose(rng, 3)), (4, "é" * 300), (5, None)]
    rows += [(10 + i, cases.prose(rng, 1) + unit[i:] + cases.prose(rng, 1)) for i in range(8)]
    compare(spark.createDataFrame(rows, "doc_id bigint, text string"), 100, gram=25)


def test_a_hash_dealt_over_many_blocks(spark):
    rng = random.Random(7)
    passage = cases.sentence(rng, 30)
    rows = [(i, f"{cases.sentence(rng, 20)} {passage} {cases.sentence(rng, 20)}") for i in range(40)]
    compare(spark.createDataFrame(rows, "doc_id bigint, text string"), 60, gram=15, block_bytes=400)


def test_no_documents(spark):
    assert s.remove_repeats(cases.no_documents(spark)).count() == 0
