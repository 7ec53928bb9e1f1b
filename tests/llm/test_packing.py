import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from closebook.llm import packing as p
from tests.llm import cases


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(p.TOKENIZER))


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, p.END_ID]


def check(rows, docs, tokenizer, size):
    want = defaultdict(int)
    for doc_id, text in docs:
        whole = ids(tokenizer, text)
        for piece, at in enumerate(range(0, len(whole), size)):
            part = whole[at:at + size]
            want[(doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        got[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(sequences)


@pytest.mark.parametrize("size", [4096, 64])
def test_every_case(spark, tokenizer, size):
    docs = cases.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    n = check(p.pack(docs, size=size).collect(), rows, tokenizer, size)
    bound = -(-sum(len(ids(tokenizer, t)) for _, t in rows) // size)
    assert bound <= n <= 1.05 * bound + 2


def test_no_documents(spark):
    assert p.pack(cases.no_documents(spark)).count() == 0


def test_cached_words_give_the_ids_of_whole_texts(tokenizer, monkeypatch):
    own = p.tokenizer(public_tokenizers.path(p.TOKENIZER))
    texts = [t or "" for t in cases.texts()]
    texts += ["don't we'll I'M x'y", "ÀÉ é́ İstanbul ΑΣ ς", "a b c\x1cd\x0be", "<|endoftext|> x", "1,234.5 a.b.c ... ,,, .a", "é ≠ ́x", "ſK Å Å"]
    want = [ids(tokenizer, text)[:-1] for text in texts]
    for cached in (p.CACHED_WORDS, 2000, 8):
        monkeypatch.setattr(p, "CACHED_WORDS", cached)
        own.cache.clear()
        own.older.clear()
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in own.ids(texts)] == want
        assert [np.frombuffer(own.ids([t])[0], "<u4").tolist() for t in texts] == want


@pytest.mark.parametrize("kind", ["even", "halves", "large", "one", "small"])
def test_plan_holds_every_piece(kind):
    rng = random.Random(5)
    draw = {
        "even": lambda: rng.randint(1, 4096), "halves": lambda: rng.choice([2048, 2049, 1365]), "large": lambda: rng.randint(1400, 4096),
        "one": lambda: 700, "small": lambda: rng.randint(1, 300),
    }[kind]
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[draw()] += 1
    runs = p.plan(dict(counts))
    packed, n, sequences = defaultdict(int), 0, set()
    for first, number, lengths in runs:
        assert sum(lengths) <= 4096 and number > 0
        n += number
        sequences.add((first, first + number))
        for x in lengths:
            packed[x] += number
    assert packed == counts
    ends = sorted(sequences)
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    total = sum(k * v for k, v in counts.items())
    best = {"halves": None, "large": None, "one": 20_000 // 5}.get(kind, -(-total // 4096))
    if best:
        assert n <= 1.01 * best + 1


def test_plan_does_not_grow_with_the_number_of_pieces():
    rng = random.Random(1)
    counts = {n: rng.randint(1, 50) for n in range(1, 4097)}
    small = p.plan(counts)
    large = p.plan({n: k * 1_000_003 for n, k in counts.items()})
    assert len(large) < 4 * len(small)
    assert sum(number * sum(lengths) for _, number, lengths in large) == sum(n * k * 1_000_003 for n, k in counts.items())


def test_special_tokens_are_those_of_the_tokenizer(spark, tokenizer):
    """Found in the text as it stands; in another case they are ordinary text."""
    texts = ["a b <|endoftext|> c", "a<|startoftext|>b <|ENDOFTEXT|> c", "<|endoftext|>", "x <|endoftext|><|endoftext|>. Y", "<|endof text|>", "no", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    check(p.pack(docs).collect(), list(enumerate(texts)), tokenizer, 4096)
    own = p.tokenizer(public_tokenizers.path(p.TOKENIZER))
    assert np.frombuffer(own.ids([texts[0]])[0], "<u4").tolist() == [320, 321, 49407, 322]


def test_two_generations_of_words(tokenizer, monkeypatch):
    monkeypatch.setattr(p, "CACHED_WORDS", 7)
    own = p.WordTokenizer(public_tokenizers.path(p.TOKENIZER))
    rng = random.Random(2)
    for _ in range(40):
        texts = [cases.sentence(rng, rng.randint(0, 12)) + ("." if rng.random() < 0.5 else "") for _ in range(3)] + ["the same words each time"]
        got = [np.frombuffer(x, "<u4").tolist() for x in own.ids(texts)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(own.cache) <= 3 * 7 and len(own.older) <= 3 * 7


def test_letters_and_marks_are_learned_apart(tokenizer, monkeypatch):
    """A word that comes again with other marks behind it costs the tokenizer its marks only."""
    own = p.WordTokenizer(public_tokenizers.path(p.TOKENIZER))
    marks = [m for m in "###|!!|?.|)|_|<=>|$%|.,;:|**|~`|@[]{}".split("|")]
    words = [f"{w}{m}" for w in ("house", "stra\u00dfe", "\u0130x", "\u0958a", "x\u0301", "caf\u00e9") for m in ("", *marks)]
    text = " ".join([*words, "don't!", "we'll##", "a'", "'s!", "x'##", "9###"])
    assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == ids(tokenizer, text)[:-1]
    sent = []
    real = own.own

    class Counted:
        def encode_batch_fast(self, texts, **more):
            sent.extend(texts)
            return real.encode_batch_fast(texts, **more)

        def encode_batch(self, texts, **more):
            sent.extend(texts)
            return real.encode_batch(texts, **more)

    own.own = Counted()
    again = "house&& caf\u00e9&&"
    assert np.frombuffer(own.ids([again])[0], "<u4").tolist() == ids(tokenizer, again)[:-1]
    assert sent == ["&&"]


def test_texts_come_in_bounded_calls_and_batches(spark, monkeypatch):
    calls, sizes = [], []

    def ids(texts):
        calls.append(sum(len(t or "") for t in texts))
        return [b""] * len(texts)

    texts = pa.array(["word " * 20_000, None, ""] * 30)
    assert len(list(p._by_size(ids, texts))) == 90 and max(calls) <= 1_100_000 and sum(calls) == 3_000_000

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    def counted(df, name):
        sizes.extend(r["n"] for r in spark.range(5_000).coalesce(1).mapInArrow(rows, "n bigint").collect())
        return written(df, name)

    written, name = p.written, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(p, "written", counted)
    assert p.pack(spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")).count() == 1
    assert sum(sizes) == 5_000 and max(sizes) <= 1_000 and spark.conf.get(name) == before
