import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from closebook.llm import secrets as s
from tests.llm import cases

ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def value(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


HEX, BASE62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def corpus(spark, n=400, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = cases.prose(rng, 3)
        put = [
            lambda: f'token = "{value(rng, HEX, 40)}"', lambda: f"password={value(rng, HEX, 18)}", lambda: f"AKIA{value(rng, BASE62[:26] + BASE62[52:], 16)}",
            lambda: f"{value(rng, BASE62[26:52], 6)}.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com",
            lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), lambda: str(rng.randint(10 ** 15, 10 ** 16)),
            lambda: f"https://example.org/{rng.randint(2000, 2026)}/page-{rng.randint(1, 99)}.html", lambda: value(rng, BASE62, 32),
        ][i % 8]()
        rows.append((i, text.replace("\n", f" {put} ", 1), put))
    return rows, spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")


def test_base_spans_against_the_patterns():
    texts = [t or "" for t in cases.texts()]
    texts += ["Token:abcdef", "token=abc", 'api_key" : "a.b/c=d', "TOKEN=token=secret", "secret='x' password = yyyyyy", "AKIA" + "A" * 15, "AKIA" * 6,
              "a" * 23 + "g" + "b" * 24, "password=" + "f" * 30, "passwd:  " + "0" * 24 + "AKIA" + "Z" * 20, "apikey==abcdefg"]
    rng = random.Random(1)
    texts += ["".join(rng.choice(["token", "=", ":", " ", '"', "abcdef", "12", "AKIA", "Q", "secret", "api_key"]) for _ in range(40)) for _ in range(300)]
    for text in texts:
        assert s.base_findings(text) == brute(text)
        base = s.base_findings(text)
        for a, b in s.candidates(text, base):
            assert b - a >= s.MIN_CANDIDATE and re.fullmatch(r"[A-Za-z0-9+/_=.-]+", text[a:b]) and re.search("[0-9]", text[a:b])
            assert not any(x < b and a < y for x, _, y in base)


def test_added_spans(spark):
    rows, docs = corpus(spark)
    got = {r["doc_id"]: r for r in s.scan_secrets(docs, s.train(docs)).collect()}
    added, wrong = 0, 0
    for i, text, put in rows:
        base = brute(text)
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))
        spelled = ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest()
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert {(k, int(a), int(b)) for k, a, b in spans} >= {(s.KINDS[k], a, b) for a, k, b in base}
        model = [text[int(a):int(b)] for k, a, b in spans if k == "model"]
        added += i % 8 == 7 and put in model
        wrong += i % 8 != 7 and bool(model)
    assert added >= 40 and wrong <= 20


def test_every_case(spark):
    docs = cases.documents(spark)
    model = s.train(docs)
    assert model is None
    rows = s.scan_secrets(docs, model).collect()
    assert len(rows) == docs.count() and not any(r["spans"] for r in rows)
    assert s.scan_secrets(cases.no_documents(spark), s.train(cases.no_documents(spark))).count() == 0


def test_windows_read_whole_candidates():
    rng = random.Random(2)
    for n in [*range(12, 130), 1000]:
        text = "see " + value(rng, BASE62, n) + " there"
        windows = s.windows_of(text, 4, 4 + n)
        assert all(len(w) == s.WIDTH for w in windows) and windows[0] == s.window(text, 4, min(4 + n, 4 + s.OWN))
        own = [w[s.LEFT:s.LEFT + s.OWN].rstrip("\0") for w in windows]
        assert {i for x in own for i in range(text.index(x), text.index(x) + len(x))} == set(range(4, 4 + n))
        assert len(s.windows_of(text, 4, 4 + n, 3)) <= 3


def test_candidates_without_a_digit():
    for text in (t or "" for t in cases.texts()):
        base = s.base_findings(text)
        both = s.candidates(text, base) + s.undigited(text, base)
        want = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=.-]{12,}", text)]
        assert sorted(both) == [(a, b) for a, b in want if not any(x < b and a < y for x, _, y in base)]
    assert s.undigited("x abcdefghijkl mnopqrstuvw1x abc", []) == [(2, 14)]


def test_secrets_at_the_end_of_paths_and_without_digits(spark):
    rng = random.Random(9)
    _, docs = corpus(spark)
    model = s.train(docs)
    letters = BASE62[:52]
    paths = [f"call //hooks.example.com/services/T{value(rng, BASE62[:26], 8)}/B{value(rng, BASE62[:26], 8)}/{value(rng, BASE62, 24)} now" for _ in range(40)]
    plain = [f"use {value(rng, letters, 32)} now" for _ in range(40)]
    words = [cases.sentence(rng, 60) for _ in range(40)]
    rows = s.scan_secrets(spark.createDataFrame(list(enumerate(paths + plain + words)), "doc_id bigint, text string"), model).collect()
    found = [bool(r["spans"]) for r in sorted(rows, key=lambda r: r["doc_id"])]
    assert sum(found[:40]) >= 30 and sum(found[40:80]) >= 30 and sum(found[80:]) <= 4


def test_threshold_is_that_of_the_recall():
    rng = random.Random(3)

    def shown(own):
        return [s.window(f"see {own} there", 4, 4 + len(own))]

    def words(n):
        return [shown((cases.word(rng) * 12)[:24]) for _ in range(n)]

    # A tenth of the secrets looks like the others.
    secrets = [shown(value(rng, HEX, 30)) for _ in range(360)] + words(40)
    rng.shuffle(secrets)
    assert s.fit(secrets, words(400))["threshold"] < 0.5


def test_tasks_learn_from_all_findings(spark):
    rows, _ = corpus(spark)
    # Ids play no part in it.
    docs = spark.createDataFrame([(None, text) for _, text, _ in rows], "doc_id bigint, text string")
    assert s.train(docs) is not None
    model = s.train(docs.repartition(5), small=0, shard=300)
    again = s.train(docs.repartition(3), small=0, shard=300)
    assert model["threshold"] == again["threshold"] and (model["network"].flat() == again["network"].flat()).all()
    got = {r["doc_id"]: r["spans"] for r in s.scan_secrets(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), model).collect()}
    spans = {i: [text[int(x.split(":")[1]):int(x.split(":")[2])] for x in got[i].split(",") if x.startswith("model")] for i, text, _ in rows}
    assert sum(put in spans[i] for i, _, put in rows if i % 8 == 7) >= 40 and sum(bool(spans[i]) for i, _, _ in rows if i % 8 != 7) <= 20


def test_findings_are_counted_and_dealt_once(spark):
    rows, docs = corpus(spark)
    found = docs.select("text").mapInArrow(s._findings, "windows array<string>, label int")
    want = sum(len(s.base_findings(t)) + len(s.candidates(t, b := s.base_findings(t))) + len(s.undigited(t, b)) for _, t, _ in rows)
    assert found.count() == want
    keyed = found.distinct().withColumn("key", F.xxhash64("windows", "label")).withColumn("half", F.lit(0)).withColumn("held", F.lit(False))
    others = keyed.where("label <> 1").count()
    dealt = s._dealt(keyed, 2, {0: 10 ** 9, 1: 1, 2: 10 ** 9}, True)
    assert dealt.where("label <> 1").count() == others
    # Rare ones go to every slot of both networks.
    assert dealt.where("label = 1").count() == keyed.where("label = 1").count() * 2 * 2 * s.ROUNDS
    assert dealt.where("slot < 0 OR slot >= 8").count() == 0


def test_counted_calibration_is_that_of_repeated_scores():
    rng = np.random.default_rng(1)
    z, y, n = rng.normal(size=60), rng.integers(2, size=60).astype(float), rng.integers(1, 5, size=60)
    assert np.allclose(s.calibrate(z, y, n), s.calibrate(np.repeat(z, n), np.repeat(y, n)))
