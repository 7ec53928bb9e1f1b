"""Small tables with the awkward cases every operator has to take."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SYLLABLES = "ka lo mi ne pu ra si to ve zu bra fle gri".split()

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use for columns of their own.
    T.StructField("score", T.StringType()), T.StructField("bucket", T.StringType()), T.StructField("n_words", T.StringType()),
    T.StructField("text_key", T.StringType()), T.StructField("copies", T.StringType()), T.StructField("n_removed", T.StringType()),
])


def word(rng) -> str:
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def sentence(rng, n) -> str:
    return " ".join(word(rng) for _ in range(n))


def prose(rng, lines: int = 6) -> str:
    return "\n".join(sentence(rng, rng.randint(5, 15)).capitalize() + "." for _ in range(lines))


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    plain = [prose(rng, rng.randint(1, 12)) for _ in range(40)]
    shared = prose(rng, 8)
    near = prose(rng, 14).split(" ")
    changed = near[:]
    changed[len(near) // 2] = "changed"
    out: list[str | None] = [*plain, plain[3], plain[3], plain[7], " ".join(near), " ".join(changed)]
    out += [prose(rng, 2) + "\n" + shared + "\n" + prose(rng, 2) for _ in range(4)]
    out += [None, "", " ", "\n\n\n", "one", "One two", "a b c d e", "A B C D E", "same line\n" * 30, "na " * 900]
    out += [prose(rng, 3).upper(), "Ünï çödé 日本語 𝒳 " * 60, "tail without end \U0001F600" * 40, prose(rng, 1500)]
    return out


def documents(spark, seed: int = 1):
    """Documents with nulls in every column, repeated rows and ids, and extra columns."""
    rows = []
    for i, text in enumerate(texts(seed)):
        n = None if text is None else len(text)
        rows.append((i, text, "en", f"s{i % 3}", n, "x", None, "y", "z", "1", "2"))
    rows[5] = (5, rows[5][1], None, None, None, None, None, None, None, None, None)
    rows.append(rows[9])
    rows.append((11, rows[12][1], "en", "s1", 1, "x", "x", "x", "x", "x", "x"))
    rows += [(None, rows[14][1], "en", "s1", 1, "x", "x", "x", "x", "x", "x")] * 2
    rows.append((None, None, None, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")
