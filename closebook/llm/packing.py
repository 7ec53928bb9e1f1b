"""Best-fit packing of tokenized documents by the linear grouping scheme.

A document is its token ids and the end id 1; one longer than the sequence is cut into
pieces. Only lengths decide the packing, and there are at most 4096 of them, so the plan
is made from their counts, a table of that size whatever the number of documents:

1. Large lengths (over a half, a quarter or an eighth of a sequence) are sorted and cut
   into groups of equal cardinality; each is rounded up to the largest of its group.
2. Configurations of the few rounded sizes are optimised: column generation, with a
   knapsack that prices new configurations by the duals. Whole multiples are used.
3. Actual lengths take the places of the rounded ones, longest first. A run is a number
   of sequences that hold the same lengths.
4. What is left over of the large ones, and all small ones, go by best fit, longest
   first, into the fullest sequence that still takes them; a run is split where only a
   part of it is filled.

The limit of what is large that gives fewest sequences is taken.

Pieces then find their place by their rank among the pieces of their length: tasks
number their own pieces, a prefix sum over tasks makes that a rank, and the plan says
which run, sequence and offset the rank has. No length is brought together in one task.

Null and empty texts are the end id alone. Special tokens of the tokenizer that stand in a
text are their ids there. An empty table packs to nothing. Repeated
rows are packed as often as they occur.
"""

from __future__ import annotations

import bisect
import os
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from closebook.llm.common import batch_rows, query, table, worker_cache, written

LENGTH = 4096
END_ID = 1
GROUPS = 64
UNIT = 8
LARGE_PARTS = (2, 4, 8)
CACHED_WORDS = 300_000
CALL_CHARS = 1_000_000
BATCH_ROWS = 1_000  # of whole texts, held by Spark's and Python's side of a task at once
TOKENIZER = "word_bpe_49k.json"
LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
MARKS = string.punctuation.replace("'", "").encode()  # after letters the tokenizer splits before these


class WordTokenizer:
    """Ids of whole texts from a cache of the ids of their words.

    No token of this tokenizer reaches over white space, and it lower-cases, so a text's
    ids are those of its ASCII-lower-cased words in turn. Letters and the ASCII marks
    after them are cached apart, as the tokenizer splits there too. Its special
    tokens are found in the text as it stands, before anything is lower-cased.

    The cache has two generations of `CACHED_WORDS` words: when the younger one is full it
    becomes the older one, and words of that which come again join the younger.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.own = Tokenizer.from_file(path)
        # Words come without special tokens; one that looks like it when lower-cased is text.
        self.own.encode_special_tokens = True
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        special = {t.content: np.array([i], "<u4").tobytes() for i, t in self.own.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.special_ids = special
        # Lower-case Latin letters stay as they are, and a run of them is one part: for those
        # normalizing and the pattern that splits can be left out.
        self.letters = Tokenizer(self.own.model)  # one model for both
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        known = self.own.get_vocab()
        self.ends = np.zeros(max(known.values(), default=0) + 1, bool)
        self.ends[[i for t, i in known.items() if t.endswith("</w>")]] = True

    def _known(self, words) -> None:
        """Have all these words in the younger generation."""
        missing = words.difference(self.cache)
        if len(self.cache) + len(missing) > CACHED_WORDS:
            self.older, self.cache, missing = self.cache, {}, words
        again = missing & self.older.keys()
        self.cache.update((w, self.older[w]) for w in again)
        self._learn(missing - again)

    def _learn(self, words):
        marked, plain, other = [], {}, {}
        for w in words:
            body = w.rstrip(MARKS)
            text = body.decode("utf-8")
            if not text.isalpha():
                other[w] = w.decode("utf-8")
                continue
            if len(body) < len(w):
                marked.append(w)
                tail = w[len(body):]
                if tail not in self.cache:
                    other[tail] = tail.decode("utf-8")
                if body in self.cache:
                    continue
            plain[body] = text
        # Words of letters alone are encoded as one text.
        latin = [w for w, text in plain.items() if LATIN(text)]
        more = [w for w, text in plain.items() if not LATIN(text)] if len(latin) < len(plain) else []
        for words, own in ((latin, self.letters), (more, self.own)):
            for at in range(0, len(words), 4000):
                some = words[at:at + 4000]
                self._learn_letters(own, some, [plain[w] for w in some])
        words = list(other)
        for at in range(0, len(words), 2000):  # what is encoded is held with all its offsets
            some = words[at:at + 2000]
            for w, e in zip(some, self.own.encode_batch([other[w] for w in some], add_special_tokens=False), strict=True):
                self.cache[w] = np.array(e.ids, "<u4").tobytes()
        for w in marked:
            body = w.rstrip(MARKS)
            self.cache[w] = self.cache[body] + self.cache[w[len(body):]]

    def _learn_letters(self, own, words: list[bytes], texts: list[str]) -> None:
        """Tell words apart by the ids that end one, or where a word has several by their places."""
        joined = " ".join(texts)
        ids = np.array(own.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        edges = np.flatnonzero(self.ends[ids]) + 1
        if len(edges) == len(words) and edges[-1] == len(ids):
            edges = [0, *(4 * edges).tolist()]
        else:
            whole = own.encode(joined, add_special_tokens=False)
            ids = np.array(whole.ids, "<u4")
            starts = np.cumsum([0] + [len(t) + 1 for t in texts])
            edges = (4 * np.searchsorted([a for a, _ in whole.offsets], starts)).tolist()
        raw = ids.tobytes()
        self.cache.update((w, raw[a:b]) for w, a, b in zip(words, edges[:-1], edges[1:], strict=True))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Of each text the ids as unsigned little-endian 32-bit numbers, without the end id."""
        if not self.special or not any(text and self.special.search(text) for text in texts):
            return self._plain(texts)
        # Every other part is a special token; the others are encoded together.
        parts = [self.special.split(text or "") for text in texts]
        known = iter(self._plain([x for own in parts for x in own[::2]]))
        return [b"".join(self.special_ids[x] if at % 2 else next(known) for at, x in enumerate(own)) for own in parts]

    def _plain(self, texts: list[str | None]) -> list[bytes]:
        split = [(text or "").encode("utf-8").lower().split() for text in texts]
        distinct = set().union(*split)
        if len(distinct) <= CACHED_WORDS:
            self._known(distinct)
            return [b"".join(map(self.cache.__getitem__, words)) for words in split]
        # More words than a generation holds are learned piece by piece.
        out = []
        for words in split:
            parts = []
            for at in range(0, len(words), CACHED_WORDS):
                some = words[at:at + CACHED_WORDS]
                self._known(set(some))
                parts.append(b"".join(map(self.cache.__getitem__, some)))
            out.append(b"".join(parts))
        return out


def tokenizer(path: str) -> WordTokenizer:
    held = worker_cache("tokenizers")
    if path not in held:
        held[path] = WordTokenizer(path)
    return held[path]


def _by_size(ids, texts, chars: int = CALL_CHARS):
    """Ids of the texts of a column, in calls of about `chars` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= chars:
            yield from ids(held)
            held, size = [], 0
    if held:
        yield from ids(held)


def _pieces(path: str, size: int):
    def step(batches):
        words, task, seen = tokenizer(path), TaskContext.get().partitionId(), {}
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            texts = batch.column(batch.schema.get_field_index("text"))
            owner, rows = [], []
            for n, raw in enumerate(_by_size(words.ids, texts)):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at:at + 4 * size]
                    length = len(part) // 4
                    turn = seen.get(length, 0)
                    seen[length] = turn + 1
                    owner.append(n)
                    rows.append((piece, at // 4, length, zlib.crc32(part), task, turn))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(owner, pa.int64()))] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["id", "piece", "start", "length", "ids_crc32", "task", "turn"],
            )

    return step


def _knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration that fits `room`, each size any number of times."""
    best = np.zeros(room + 1)
    pick = np.full(room + 1, -1)
    order = np.argsort(sizes, kind="stable")
    small, worth = sizes[order], values[order]
    for r in range(1, room + 1):
        n = np.searchsorted(small, r, side="right")
        best[r], pick[r] = best[r - 1], -1
        if n:
            total = best[r - small[:n]] + worth[:n]
            k = int(total.argmax())
            if total[k] > best[r] + 1e-12:
                best[r], pick[r] = total[k], order[k]
    counts, r = np.zeros(len(sizes), np.int64), room
    while r > 0:
        if pick[r] < 0:
            r -= 1
        else:
            counts[pick[r]] += 1
            r -= sizes[pick[r]]
    return float(best[room]), counts


def configurations(sizes, demand, room: int, tolerance: float = 1e-4, rounds: int = 2000):
    """(times, counts per size) of configurations that meet the demand with few sequences.

    Column generation for the linear relaxation of the cutting-stock problem; `times`
    may be fractional.
    """
    sizes, demand = np.asarray(sizes), np.asarray(demand, float)
    basis = np.diag([room // s for s in sizes]).astype(float)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, counts = _knapsack(sizes, np.maximum(duals, 0), room)
        if value <= 1 + tolerance:
            break
        times = np.linalg.solve(basis, demand)
        change = np.linalg.solve(basis, counts.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(change > 1e-9, np.maximum(times, 0) / change, np.inf)
        basis[:, int(ratio.argmin())] = counts
    times = np.maximum(np.linalg.solve(basis, demand), 0)
    return [(float(t), basis[:, j].astype(int)) for j, t in enumerate(times)]


class _Runs:
    """Runs of sequences with equal contents: (first, number, lengths), found by free room."""

    def __init__(self, size: int):
        self.size, self.next, self.done, self.free, self.rooms = size, 0, [], {}, []

    def add(self, first: int | None, number: int, lengths: list[int], room: int):
        if first is None:
            first, self.next = self.next, self.next + number
        if room == 0:
            self.done.append((first, number, lengths))
        else:
            if room not in self.free:
                bisect.insort(self.rooms, room)
            self.free.setdefault(room, []).append((first, number, lengths))

    def best_fit(self, length: int, count: int):
        """Put `count` pieces of a length where they leave least room."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.size // length
                number = count // each
                if number:
                    self.add(None, number, [length] * each, self.size - each * length)
                    count -= number * each
                if count % each:
                    self.add(None, 1, [length] * (count % each), self.size - (count % each) * length)
                return
            room = self.rooms[at]
            first, number, lengths = self.free[room].pop()
            if not self.free[room]:
                del self.free[room]
                del self.rooms[at]
            each = min(room // length, count)
            full = min(number, count // each)
            self.add(first, full, lengths + [length] * each, room - each * length)
            count -= full * each
            if number > full:
                self.add(first + full, number - full, lengths, room)

    def all(self):
        return self.done + [r for runs in self.free.values() for r in runs]


def plan(counts: dict[int, int], size: int = LENGTH, groups: int = GROUPS, unit: int = UNIT):
    """Runs (first sequence, number of sequences, lengths in each) that hold all pieces."""
    plans = [plan_with(counts, part, size, groups, unit) for part in LARGE_PARTS]
    return min(plans, key=lambda runs: sum(number for _, number, _ in runs))


def plan_with(counts: dict[int, int], large_part: int, size: int, groups: int, unit: int):
    """The plan in which lengths over `size / large_part` are large."""
    runs = _Runs(size)
    left = dict(counts)
    if left.get(size):
        runs.add(None, left.pop(size), [size], 0)
    large = sorted((n for n in left if n > size // large_part), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        members: list[list[list[int]]] = []
        per, held = -(-total // groups), 0
        for n in large:
            rest = left[n]
            while rest:
                if not members or held == per:
                    members.append([])
                    held = 0
                take = min(rest, per - held)
                members[-1].append([n, take])
                held, rest = held + take, rest - take
        sizes = [-(-g[0][0] // unit) for g in members]
        demand = [sum(k for _, k in g) for g in members]
        for times, config in sorted(configurations(sizes, demand, size // unit), key=lambda c: -c[0]):
            slots = [g for g, k in enumerate(config) for _ in range(k)]
            wanted = int(times + 1e-6)
            for g, k in enumerate(config):
                if k:
                    wanted = min(wanted, sum(x for _, x in members[g]) // int(k))
            if not wanted:
                continue
            drawn = [_draw(members[g], wanted) for g in slots]
            while wanted:
                number = min(d[-1][1] for d in drawn)
                lengths = [d[-1][0] for d in drawn]
                runs.add(None, number, lengths, size - sum(lengths))
                wanted -= number
                for d in drawn:
                    d[-1][1] -= number
                    if not d[-1][1]:
                        d.pop()
        for n in large:
            left[n] = 0
        for g in members:
            for n, k in g:
                left[n] += k
    for n in sorted(left, reverse=True):
        runs.best_fit(n, left[n])
    return runs.all()


def _draw(group: list[list[int]], number: int) -> list[list[int]]:
    """Take the longest pieces of a group: [length, count], the first one last."""
    out = []
    while number:
        n, k = group[0]
        take = min(k, number)
        out.append([n, take])
        number -= take
        if take == k:
            group.pop(0)
        else:
            group[0][1] -= take
    return out[::-1]


def slots(runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ranks within lengths: sorted keys (length << 48 | first rank), sequence and offset there."""
    rows, used = [], {}
    for first, number, lengths in sorted(runs):
        offset = 0
        for n in lengths:
            rank = used.get(n, 0)
            used[n] = rank + number
            rows.append((n << 48 | rank, first, offset))
            offset += n
    rows.sort()
    keys, first, offset = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ((), (), ())))
    return keys, first, offset


def _place(sent):
    def step(batches):
        keys, first, offset = sent.value
        for batch in batches:
            at = batch.schema.get_field_index
            length = batch.column(at("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(at("base")).to_numpy(zero_copy_only=False) + batch.column(at("turn")).to_numpy(zero_copy_only=False)
            key = (length << 48) | rank
            slot = np.searchsorted(keys, key, side="right") - 1
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(at(n)) for n in names]
                + [pa.array(first[slot] + (key - keys[slot]), pa.int64()), pa.array(offset[slot], pa.int64())],
                names=[*names, "sequence_id", "offset"],
            )

    return step


def pack(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = LENGTH,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    kind = docs.schema[id_column].dataType.simpleString()
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        pieces = written(chosen.mapInArrow(
            _pieces(path, size),
            f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, turn bigint"), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("k"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("task", "length", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["k"] for r in pieces.groupBy("length").agg(F.count("*").alias("k")).collect()}
    sent = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, size)))
    placed = pieces.join(base, ["task", "length"]).mapInArrow(
        _place(sent),
        f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return placed.withColumnRenamed("id", id_column)


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
