"""Benchmark decontamination: Aho-Corasick over normalised benchmark windows.

Texts are normalised to lower-case (A-Z only) words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`
joined by single spaces. A window is 13 consecutive words of an item; an item with
fewer words, but at least one, is one window. All windows go into one automaton that
scans each document once; hits come back as word numbers and, for documents with a
hit, as code point offsets of the original text.

The benchmark is the stated query set. Its text is broadcast in blocks of at most
`BLOCK_CHARS` characters. Usually that is one block and one automaton; a larger
benchmark makes one scan per block, chained without a shuffle, each in a Python worker
of its own with its own automaton. Documents need no shuffle at all.

Null and empty texts have no words, no hits and are not contaminated. Items with null
text have no windows. Items of one id count once; items without an id mark words but
are not listed. An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closebook.llm.common import LOWER, UPPER, free_name, query, table, worker_cache

WINDOW = 13
BLOCK_CHARS = 200_000  # an automaton of about 200 MB
#: Columns of the result that replace columns of the same name.
NEW = {"n_words", "n_hit", "n_items", "items_sha256", "item_ids", "spans", "contaminated"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TO_LOWER = str.maketrans(UPPER, LOWER)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(_TO_LOWER) if not text.isascii() else text.lower())


def windows_of(words: list[str], size: int = WINDOW) -> set[str]:
    if not words:
        return set()
    if len(words) < size:
        return {" ".join(words)}
    return {" ".join(words[i:i + size]) for i in range(len(words) - size + 1)}


def automaton(items, size: int = WINDOW):
    """An automaton over ` window ` with the window's word count and the ids of its items."""
    ids: dict[str, set] = {}
    for item_id, text in items:
        for window in windows_of(words_of(text or ""), size):
            ids.setdefault(window, set()).add(item_id)
    found = ahocorasick.Automaton()
    for window, owners in ids.items():
        found.add_word(f" {window} ", (window.count(" ") + 1, tuple(owners - {None})))
    if ids:
        found.make_automaton()
    return found if ids else None


def hit_words(machine, words: list[str]) -> tuple[list[tuple[int, int]], set]:
    """Maximal runs [first, end) of hit words, and the ids of the items that hit."""
    line = f" {' '.join(words)} "
    runs: list[tuple[int, int]] = []
    owners: set = set()
    at, spaces = 0, 0
    for end, (size, ids) in machine.iter(line):
        spaces += line.count(" ", at, end + 1)
        at = end + 1
        last = spaces - 1  # words that end before the space at `end`
        first = last - size
        while runs and runs[-1][1] >= first:
            a, b = runs.pop()
            first, last = min(a, first), max(b, last)
        runs.append((first, last))
        owners.update(ids)
    return runs, owners


def _machine(key, items, size):
    """The automaton of a block, built once in each Python worker."""
    held = worker_cache("automata")
    if key not in held:
        held.clear()
        held[key] = automaton(items.value, size)
    return held[key]


def _scan(items, key, size, text_column, names):
    """A function for mapInArrow that adds what one block of the benchmark hits."""
    n_name, spans_name, ids_name = names

    def step(batches):
        machine = _machine(key, items, size)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_column)).to_pylist()
            n_words, spans, ids = [], [], []
            old = batch.schema.get_field_index(spans_name)
            before = (
                (batch.column(old).to_pylist(), batch.column(batch.schema.get_field_index(ids_name)).to_pylist())
                if old >= 0 else ([[] for _ in texts], [[] for _ in texts])
            )
            for text, known_spans, known_ids in zip(texts, *before, strict=True):
                words = words_of(text or "")
                n_words.append(len(words))
                runs, owners = hit_words(machine, words) if machine and words else ([], set())
                spans.append(known_spans + [{"first": a, "last": b} for a, b in runs])
                ids.append(sorted(set(known_ids) | {str(i) for i in owners}))
            kept = [i for i, f in enumerate(batch.schema) if f.name not in names]
            arrays = [batch.column(i) for i in kept]
            fields = [batch.schema.field(i) for i in kept]
            span = pa.struct([("first", pa.int64()), ("last", pa.int64())])
            arrays += [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(ids, pa.list_(pa.string()))]
            fields += [pa.field(n_name, pa.int64()), pa.field(spans_name, pa.list_(span)), pa.field(ids_name, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

    return step


def _merged(runs):
    out = []
    for r in sorted((r["first"], r["last"]) for r in runs):
        if out and out[-1][1] >= r[0]:
            out[-1] = (out[-1][0], max(out[-1][1], r[1]))
        else:
            out.append(r)
    return out


def _finish(text_column, names, added):
    """Counts, original offsets and the digest of item ids from the hits of all blocks."""
    n_name, spans_name, ids_name = names
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(span))

    def step(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            texts = batch.column(at(text_column)).to_pylist()
            rows = ([], [], [], [], [])
            for text, runs, ids in zip(
                texts, batch.column(at(spans_name)).to_pylist(), batch.column(at(ids_name)).to_pylist(), strict=True
            ):
                merged = _merged(runs)
                spans = []
                if merged:
                    places = [m.span() for m in WORD.finditer(text.translate(_TO_LOWER))]
                    spans = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in merged]
                rows[0].append(sum(b - a for a, b in merged))
                rows[1].append(len(ids))
                rows[2].append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                rows[3].append(ids)
                rows[4].append(spans)
            kept = [i for i, f in enumerate(batch.schema) if f.name not in (spans_name, ids_name)]
            arrays = [batch.column(i) for i in kept] + [pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]
            fields = [batch.schema.field(i) for i in kept] + [pa.field(n, k) for n, k in zip(added, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

    return step


def _then(first, second):
    """Two functions for mapInArrow in one. In two steps a task takes two Python workers, and as
    workers are used in turn, all of them gather what the stages that follow keep in one."""

    def step(batches):
        return second(first(batches))

    return step


def blocks(benchmark: DataFrame, id_column: str, text_column: str, block_chars: int):
    """Lists of (id, text), each of at most `block_chars` characters unless it is one item.

    The items stream through the driver one block at a time.
    """
    block, chars = [], 0
    rows = benchmark.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).where("t IS NOT NULL")
    for row in rows.toLocalIterator():
        if block and chars + len(row["t"]) > block_chars:
            yield block
            block, chars = [], 0
        block.append((row["i"], row["t"]))
        chars += len(row["t"])
    if block:
        yield block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_id: str = "item_id",
    item_text: str = "text", size: int = WINDOW, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """`docs` with `n_words`, `n_hit`, `n_items`, `items_sha256`, `contaminated`, `item_ids`
    (as sorted strings) and `spans` (hit code points of the original text, end exclusive).

    Columns of `docs` with one of these names make way for the new ones.
    """
    added = ["n_hit", "n_items", "items_sha256", "item_ids", "spans"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in NEW])
    names = ("n_words", free_name(docs, "hit_runs"), free_name(docs, "hit_ids"))
    state = (
        f"n_words bigint, `{names[1]}` array<struct<first:bigint,last:bigint>>, `{names[2]}` array<string>"
    )
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    context = docs.sparkSession.sparkContext
    out = docs
    parts = list(blocks(benchmark, item_id, item_text, block_chars)) or [[]]
    ended = "n_hit bigint, n_items bigint, items_sha256 string, item_ids array<string>, spans array<struct<start:bigint,`end`:bigint>>"
    for at, part in enumerate(parts):
        sent = context.broadcast(part)
        scan = _scan(sent, (id(sent), len(part), str(sent._jbroadcast.id())), size, text_column, names)
        if at < len(parts) - 1:
            out = out.mapInArrow(scan, f"{own}, {state}")
        else:
            out = out.mapInArrow(_then(scan, _finish(text_column, names, added)), f"{own}, n_words bigint, {ended}")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


_SQL_WORDS = (
    f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
SQL = f"""
WITH item_words AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
    SELECT DISTINCT item_id, array_to_string(g, ' ') AS g, len(g) AS k FROM (
        SELECT item_id, unnest(CASE WHEN len(w) < {WINDOW} THEN [w]
            ELSE list_transform(range(1, len(w) - {WINDOW} + 2), lambda i: list_slice(w, i, i + {WINDOW - 1})) END) AS g
        FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
doc_words AS (SELECT doc_id, COALESCE({_SQL_WORDS}, []::VARCHAR[]) AS w FROM documents),
grams AS (
    SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i,
        unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS g
    FROM doc_words, sizes WHERE len(w) >= k),
hits AS (SELECT doc_id, i, k, item_id FROM grams JOIN windows USING (g, k)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
    SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(h.n, 0) AS BIGINT) AS n_hit,
    CAST(COALESCE(x.n, 0) AS BIGINT) AS n_items, sha256(COALESCE(x.ids, '')) AS items_sha256,
    COALESCE(h.n, 0) > 0 AND 20 * COALESCE(h.n, 0) >= len(w) AS contaminated
FROM doc_words d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items x USING (doc_id)"""


@query("op2_benchmark_decontamination", SQL)
def op2(spark, sf_dir):
    """Words of each document that a benchmark window covers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
