"""Line dedup: winnowing over line hashes, DataFrame functions only.

A document is its lines, cut at line feeds. A run of `RUN` consecutive lines that has
occurred before - earlier in the same document, or in a document that comes before - is
deleted, and so is every longer run, as all its windows are such runs. Documents come in
the order of their ids, rows without id last, rows of one id by the hash of their text.

1. Winnowing: of each window of `RUN` lines the least line hash is a fingerprint. Equal
   runs have a fingerprint in common, at the same line of the run.
2. Fingerprints at one place only are dropped, with the windows that chose them.
3. The others are joined to their positions and extended both ways to whole windows;
   positions whose windows agree form one group, whatever their number. Only the least
   place of a group is looked up, so no pairs arise.
4. Windows after the least place are deleted, with all lines they cover. Where a run
   overlaps its own repeat (one line many times over), only what precedes the repeat stays.

With `words` given, runs of fewer than `RUN` lines that hold more words than that are
deleted in the same way, so the least repeat follows words where lines are long. Each
length has windows of its own; the least hash of a short window is its fingerprint too.
`op7_line_dedup` and the pipeline take `WORDS`.

Null and empty texts are one empty line and stay as they are. Rows equal in id and text
are one place: neither goes because of the other. Without `words`, texts of fewer lines
than `RUN` stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from closebook.llm.common import query, table, whole

RUN = 3
WORDS = 50
#: Columns of the result that replace columns of the same name.
NEW = {"n_lines", "n_removed", "n_runs"}
#: Words stand between these.
BLANK = r"[\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keyed(docs: DataFrame, id_column: str, text: Column) -> DataFrame:
    """Order and identity of a row: (no id, id, hash of the text)."""
    return docs.select(
        F.struct(
            F.col(id_column).isNull().alias("unnamed"),
            F.coalesce(F.col(id_column).cast("bigint"), F.lit(0)).alias("id"),
            F.xxhash64(text).alias("text"),
        ).alias("doc"),
        text.alias("text"),
    )


def _windows(docs: DataFrame, size: int, run: int, words: int | None) -> DataFrame:
    """Windows of `size` lines, with zeros for the lines that `run` has more; with `words`,
    only those that hold more."""
    lines = _lines(F.col("text"))
    hashed = docs.where(F.size(lines) >= size).select(
        "doc", F.transform(lines, lambda x: F.xxhash64(x)).alias("hashes"),
        *([F.transform(lines, lambda x: F.size(F.filter(F.split(x, BLANK), lambda w: w != ""))).alias("held")] if words is not None else []))
    starts = F.sequence(F.lit(0), F.size("hashes") - size)
    if words is not None:
        starts = F.filter(starts, lambda at: sum((F.get("held", at + j) for j in range(size)), F.lit(0)) > words)
    return hashed.select("doc", "hashes", F.explode(starts).alias("at")).select(
        "doc", "at", F.lit(size).alias("size"),
        *[(F.element_at("hashes", F.col("at") + j + 1) if j < size else F.lit(0).cast("bigint")).alias(f"h{j}") for j in range(run)])


def later_windows(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", run: int = RUN, words: int | None = None,
) -> DataFrame:
    """(doc, starts): the first lines, from 0, and sizes of windows that have occurred before."""
    keyed = _keyed(docs, id_column, whole(text_column))
    windows = _windows(keyed, run, run, None)
    for size in range(1, run) if words is not None else ():
        windows = windows.unionByName(_windows(keyed, size, run, words))
    lines = [f"h{j}" for j in range(run)]
    used = [F.when(F.col("size") > j, F.col(h)) for j, h in enumerate(lines)]
    windows = windows.withColumn("fingerprint", F.least(*used))
    # Equal windows choose the line of the same number; the least of equal ones is the first.
    chosen = F.coalesce(*[F.when(h == F.col("fingerprint"), F.col("at") + j) for j, h in enumerate(used)])
    position = F.xxhash64("doc.unnamed", "doc.id", "doc.text", chosen)
    shared = (
        windows.select("fingerprint", position.alias("p")).groupBy("fingerprint")
        .agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a <> b").select("fingerprint")
    )
    extended = windows.join(shared, "fingerprint").select(
        "size", *lines, F.struct("doc.unnamed", "doc.id", "doc.text", "at").alias("place"))
    first = extended.groupBy("size", *lines).agg(
        F.min("place").alias("first"), F.max("place").alias("last")).where("first < last")
    later = extended.join(first.drop("last"), ["size", *lines]).where("place > first")
    return later.groupBy(
        F.struct(F.col("place.unnamed"), F.col("place.id"), F.col("place.text")).alias("doc")
    ).agg(F.collect_set(F.struct("place.at", "size")).alias("starts"))


def delete_repeated_runs(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", run: int = RUN, words: int | None = None,
) -> DataFrame:
    """`docs` with the text without repeated runs, and `n_lines`, `n_removed`, `n_runs`.

    Texts that lose nothing stay as they are, null included. Columns of `docs` with the
    name of a new one make way for it.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in NEW])
    found = later_windows(docs, id_column, text_column, run, words)
    text = whole(text_column)
    rows = docs.select(F.struct("*").alias("row"), F.struct(
        F.col(id_column).isNull().alias("unnamed"),
        F.coalesce(F.col(id_column).cast("bigint"), F.lit(0)).alias("id"),
        F.xxhash64(text).alias("text"),
    ).alias("doc"))
    joined = rows.join(found, "doc", "left").select("row", F.col("starts").alias("starts"))
    own = _lines(whole(f"row.{text_column}"))
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))
    cut = joined.select("row", own.alias("lines"), F.when(F.col("starts").isNotNull(), gone).alias("gone"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept_text = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    beginnings = F.array_except("gone", F.transform("gone", lambda i: i + 1))
    columns = [
        F.when(F.col("gone").isNotNull(), kept_text).otherwise(F.col(f"row.{text_column}")).alias(c)
        if c == text_column else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ]
    return cut.select(
        *columns, F.size("lines").cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias("n_removed"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size(beginnings)).cast("bigint").alias("n_runs"),
    )


def _sql_windows(source: str, size: int, words: int | None) -> str:
    """SQL for (doc_id, p, k, w): the windows of `size` lines, those of over `words` words."""
    enough = "" if words is None else (
        f" WHERE list_sum(list_transform(w, lambda x: len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')))) > {words}")
    return f"""
SELECT doc_id, p, {size} AS k, w FROM (
    SELECT doc_id, unnest(range(1, len(lines) - {size} + 2)) AS p,
        unnest(list_transform(range(1, len(lines) - {size} + 2), lambda i: list_slice(lines, i, i + {size - 1}))) AS w
    FROM (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS lines FROM {source}) WHERE len(lines) >= {size}){enough}"""


def sql_later(source: str, run: int = RUN, words: int | None = WORDS) -> str:
    """SQL for (doc_id, text, lines, gone, n_runs) of a table of documents with distinct ids."""
    sizes = [(run, None)] + ([(k, words) for k in range(1, run)] if words is not None else [])
    windows = " UNION ALL ".join(_sql_windows(source, *size) for size in sizes)
    return f"""
SELECT l.doc_id, l.text, l.lines, COALESCE(g.gone, []::BIGINT[]) AS gone, COALESCE(g.n_runs, 0) AS n_runs FROM
    (SELECT doc_id, text, string_split(COALESCE(text, ''), chr(10)) AS lines FROM {source}) l
LEFT JOIN (
    SELECT doc_id, list(i) AS gone, CAST(sum(CASE WHEN i - 1 = before THEN 0 ELSE 1 END) AS BIGINT) AS n_runs FROM (
        SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (
            SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS i FROM (
                SELECT doc_id, p, k, row_number() OVER (PARTITION BY k, w ORDER BY doc_id, p) AS n FROM ({windows}))
            WHERE n > 1))
    GROUP BY doc_id) g ON g.doc_id = l.doc_id"""


SQL_KEPT = "array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i)), chr(10))"

SQL = f"""
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(gone) AS BIGINT) AS n_removed, n_runs,
    sha256({SQL_KEPT}) AS kept_sha256
FROM ({sql_later('documents')})"""


@query("op7_line_dedup", SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without runs that occurred before: of three lines, or of
    one or two that hold over 50 words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = delete_repeated_runs(docs, words=WORDS)
    return done.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(whole(), 256).alias("kept_sha256"))
