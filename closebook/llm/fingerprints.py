"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph (a non-empty line) is hashed to 480 bits, read as eight numbers
of 60 bits. A fingerprint is a vector of 73 numbers, summed over the paragraphs
modulo 2**60:

- the number of paragraphs,
- the eight numbers themselves (wide lanes: equality),
- 64 numbers of three bits each, 20 bits apart (sign lanes: likeness).

Order does not count, a paragraph can be added (`plus`) or taken away (`minus`)
without the rest of the text, and fingerprints of parts add up to that of the
whole. The sign lanes hold 192 sums of random signs, so the cosine of two
fingerprints estimates that of the two paragraph multisets (standard error about
0.07; a document with over a million paragraphs blurs its own likeness, not its
equality).

Null and empty texts have no paragraphs: their vector is all 0, alike (1.0) among
themselves and unlike (0.0) any other text. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closebook.llm.common import free_name, partitions, query, table

BITS = 60
MODULUS_MASK = (1 << BITS) - 1
FIELD = 20
FIELDS = (0, 20, 40)
FIELD_MASK = (1 << FIELD) - 1
SPREAD = sum(1 << f for f in FIELDS)
SHIFTS = 8
WIDE = 8
SIZE = 1 + WIDE + WIDE * SHIFTS


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p != "")


def _wide(paragraph: Column) -> Column:
    """Eight numbers of 60 bits from the digests of a paragraph."""
    digests = (F.sha2(paragraph, 256), F.sha2(F.concat(F.lit("+"), paragraph), 256))
    return F.array(*[
        F.conv(F.substring(d, 15 * j + 1, 15), 16, 10).cast("bigint") for d in digests for j in range(WIDE // 2)
    ])


def _vector(wide: Column) -> Column:
    signs = F.flatten(F.transform(wide, lambda v: F.array(*[
        F.shiftright(v, k).bitwiseAND(F.lit(SPREAD)) for k in range(SHIFTS)
    ])))
    return F.concat(F.array(F.lit(1).cast("bigint")), wide, signs)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(MODULUS_MASK)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(MODULUS_MASK)))


def fingerprint(text: Column) -> Column:
    """The vector of a text, as an array of 73 longs."""
    zero = F.array_repeat(F.lit(0).cast("bigint"), SIZE)
    wide = F.transform(paragraphs(text), _wide)
    return F.aggregate(wide, zero, lambda acc, w: plus(acc, _vector(w)))


def spelled(vector: Column) -> Column:
    """A vector as text: its numbers in hexadecimal, separated by dots."""
    return F.array_join(F.transform(vector, lambda x: F.lower(F.hex(x))), ".")


def signs(vector: Column) -> Column:
    """The 192 sign sums of a vector, as whole doubles."""
    n = F.element_at(vector, 1)
    return F.flatten(F.transform(F.slice(vector, 2 + WIDE, SIZE), lambda x: F.array(*[
        (F.shiftright(x, s).bitwiseAND(F.lit(FIELD_MASK)) * 2 - n).cast("double") for s in FIELDS
    ])))


def _dot(a: Column, b: Column) -> Column:
    """Inner product of sign sums, exact as long as it fits a double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def with_likeness(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """`df` with a column per pair of vector columns: the estimated cosine of the two
    paragraph multisets, from 0 to 1; 1 for equal fingerprints, 0 beside an empty text.

    Sign sums and norms are columns of their own, so that each is computed once.
    """
    vectors = sorted({v for pair in pairs.values() for v in pair})
    own = {v: free_name(df, f"{v}_signs") for v in vectors}
    norm = {v: free_name(df, f"{v}_norm") for v in vectors}
    out = df.select("*", *[signs(F.col(v)).alias(own[v]) for v in vectors])
    out = out.select("*", *[_dot(F.col(own[v]), F.col(own[v])).alias(norm[v]) for v in vectors])
    near = []
    for name, (a, b) in pairs.items():
        size = F.col(norm[a]) * F.col(norm[b])
        cosine = F.col(f"{name}_dot") / F.sqrt(size)
        near.append(
            F.when(F.col(a) == F.col(b), 1.0).when(size == 0, 0.0)
            .otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)), 6)).alias(name)
        )
    out = out.select("*", *[_dot(F.col(own[a]), F.col(own[b])).alias(f"{name}_dot") for name, (a, b) in pairs.items()])
    return out.select(*df.columns, *near)


def with_next(df: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """Each row with `next_<column>` of the row of the next smaller id, the last with those of the first.

    Rows go by id, largest first; rows of one id go by the hash of their columns,
    and rows without id come last. The ids are cut into as many ranges as there are
    shuffle partitions; the first row of a range is also dealt to the range before
    it, so one shuffle is enough and no task sees more than its range. Only the
    first id of each range comes to the driver.
    """
    spark = df.sparkSession
    n = partitions(spark)
    ids = df.select(F.col(id_column).cast("bigint").alias("id")).where("id IS NOT NULL")
    found = (
        ids.repartitionByRange(n, F.col("id").desc())
        .groupBy(F.spark_partition_id().alias("p")).agg(F.max("id").alias("first")).collect()
    )
    firsts = sorted({r["first"] for r in found}, reverse=True)
    last = max(len(firsts) - 1, 0)
    taken = {name: free_name(df, name) for name in ("bucket", "guest", "tie")}
    bucket, guest, tie = taken["bucket"], taken["guest"], taken["tie"]
    key = F.col(id_column).cast("bigint")

    def place(at, is_guest):
        return F.struct(F.lit(at).cast("int").alias("b") if isinstance(at, int) else at.cast("int").alias("b"),
                        F.lit(is_guest).alias("g"))

    if firsts:
        step = max(1, int(len(firsts) ** 0.5))

        def longs(values):
            # A cast is folded to one constant array; a function over its elements would not be.
            return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

        coarse = (F.size(F.filter(longs(firsts[::step]), lambda x: x >= key)) - 1) * step
        fine = F.size(F.filter(F.slice(longs(firsts), coarse + 1, F.lit(step)), lambda x: x >= key))
        own = F.when(key.isNull(), last).otherwise(coarse + fine - 1)
        is_first = key == F.element_at(longs(firsts), own + 1)
        before = F.when(own == 0, last).otherwise(own - 1)
        places = F.when(is_first, F.array(place(own, False), place(before, True))).otherwise(F.array(place(own, False)))
    else:
        places = F.array(place(0, False), place(0, True))
    dealt = (
        df.withColumn(tie, F.xxhash64(*columns))
        .select("*", F.explode(places).alias(bucket))
        .select(*df.columns, tie, F.col(f"{bucket}.b").alias(bucket), F.col(f"{bucket}.g").alias(guest))
    )
    order = Window.partitionBy(bucket).orderBy(F.col(guest), key.desc_nulls_last(), F.col(tie).desc())
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in columns]
    return dealt.select(*df.columns, guest, *following).where(~F.col(guest)).drop(guest)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` with `fingerprint`: the vector of each whole text."""
    return docs.withColumn("fingerprint", fingerprint(F.col(text_column)))


def _sums() -> str:
    words = ["sum(1)"]
    words += [f"sum(v{j})" for j in range(WIDE)]
    words += [f"sum((v{j} >> {k}) & {SPREAD})" for j in range(WIDE) for k in range(SHIFTS)]
    return ", ".join(f"CAST(COALESCE({w}, 0) % {1 << BITS} AS BIGINT)" for w in words)


def _digits(digest: str) -> str:
    return ", ".join(f"CAST('0x' || substr({digest}, {15 * j + 1}, 15) AS BIGINT)" for j in range(WIDE // 2))


_NUMBERS = ", ".join(f"v{j}" for j in range(WIDE))
_SQL_DOT = f"""list_sum(list_transform(range({2 + WIDE}, {SIZE + 1}), lambda i: {" + ".join(
    f"CAST(2 * (({{a}}[i] >> {s}) & {FIELD_MASK}) - {{a}}[1] AS DOUBLE) * CAST(2 * (({{b}}[i] >> {s}) & {FIELD_MASK}) - {{b}}[1] AS DOUBLE)"
    for s in FIELDS)}))"""


def _sql_likeness(a: str, b: str) -> str:
    aa, bb, ab = (_SQL_DOT.format(a=x, b=y) for x, y in ((a, a), (b, b), (a, b)))
    return f"""CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {aa} = 0 OR {bb} = 0 THEN 0.0::DOUBLE
        ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {ab} / sqrt({aa} * {bb}))), 6) END"""


SQL = f"""
WITH own AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
named AS (
    SELECT doc_id, text, COALESCE(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following
    FROM own),
texts AS (
    SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n_chars,
        left(text, length(text) - length(text) // 2) || left(following, length(text) // 2) AS edited, following
    FROM named),
lines AS (
    SELECT kind, doc_id, line FROM (
        SELECT 'own' AS kind, doc_id, unnest(string_split(text, chr(10))) AS line FROM texts
        UNION ALL SELECT 'edited', doc_id, unnest(string_split(edited, chr(10))) FROM texts
        UNION ALL SELECT 'next', doc_id, unnest(string_split(following, chr(10))) FROM texts)
    WHERE line <> ''),
digests AS (SELECT kind, doc_id, sha256(line) AS a, sha256('+' || line) AS b FROM lines),
numbers AS (SELECT kind, doc_id, [{_digits('a')}, {_digits('b')}] AS r FROM digests),
wide AS (SELECT kind, doc_id, {", ".join(f"r[{j + 1}] AS v{j}" for j in range(WIDE))} FROM numbers),
summed AS (SELECT kind, doc_id, [{_sums()}] AS v FROM wide GROUP BY kind, doc_id),
vectors AS (
    SELECT t.doc_id, t.n_chars, t.edited,
        COALESCE(o.v, list_transform(range({SIZE}), lambda x: 0::BIGINT)) AS o,
        COALESCE(e.v, list_transform(range({SIZE}), lambda x: 0::BIGINT)) AS e,
        COALESCE(f.v, list_transform(range({SIZE}), lambda x: 0::BIGINT)) AS f
    FROM texts t
    LEFT JOIN summed o ON o.kind = 'own' AND o.doc_id = t.doc_id
    LEFT JOIN summed e ON e.kind = 'edited' AND e.doc_id = t.doc_id
    LEFT JOIN summed f ON f.kind = 'next' AND f.doc_id = t.doc_id)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256,
    array_to_string(list_transform(o, lambda x: lower(to_hex(x))), '.') AS fingerprint,
    array_to_string(list_transform(e, lambda x: lower(to_hex(x))), '.') AS edited_fingerprint,
    {_sql_likeness('o', 'e')} AS near_edited, {_sql_likeness('o', 'f')} AS near_next
FROM vectors"""


@query("op1_document_fingerprints", SQL)
def op1(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts, with likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = docs.select("doc_id", "text", fingerprint(F.col("text")).alias("own"))
    pairs = with_next(hashed, "doc_id", ["text", "own"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half))
    done = (
        pairs.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "own", "next_own")
        .withColumn("changed", fingerprint(F.col("edited")))
    )
    near = with_likeness(done, {"near_edited": ("own", "changed"), "near_next": ("own", "next_own")})
    return near.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        spelled(F.col("own")).alias("fingerprint"), spelled(F.col("changed")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
