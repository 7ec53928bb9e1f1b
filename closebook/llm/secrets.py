"""Secret scan: patterns, and a character convolutional network over every candidate.

Base findings come from three patterns (assignment, access key, hexadecimal run) and
always stay. Further candidates are all runs of 12 or more characters `[A-Za-z0-9+/_=.-]`,
with a digit or without, that touch no base finding. A convolutional network in numpy reads
each with its surroundings (16 characters before, 40 of its own, 8 after), each character
with a mark of whether it is the candidate's. Of a longer candidate it reads such windows
every 20 characters and at the end; the largest output counts. Those above the threshold
are added as kind `model`.

The network learns from labelled findings: base findings are secrets, the other candidates
of the same documents are not. Secrets are also shown out of their surroundings and in
other alphabets and behind the ends of other candidates, so that the look of the value
decides and not only a keyword, also at the end of a path; candidates that a first round takes for secrets although no pattern found them are left out of the
second. What is added is what looks like a base finding but matches no pattern. A fifth of the findings
is kept to calibrate the output and to set the threshold: the largest at which `RECALL`
of the held-out secrets are found.

Training takes the findings of all documents, with all their windows; those of a candidate
of more than `SHOWN` windows weigh as much as that many. Up to `SMALL` windows are learned on
the driver. Of more, equal findings are one, and tasks learn: findings are dealt by a hash
over shards of about `SHARD` windows, and each shard's over `ROUNDS` rounds. In a round a task
a shard goes on from the same parameters with batches of its own, and the mean of what they
come to is where the next round begins. A class with few findings is dealt to several
shards, so that each has `LEAST` of them or all. Calibration and threshold come from counts of
the outputs, in steps of 1/256, of all held-out findings, equal ones counted as often as they
occur. Null and empty texts have no spans. Without findings of both classes nothing is added.
Rows are scanned independently of each other; ids are not used, and repeated rows are learned
as rows. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closebook.llm.common import query, table, worker_cache, written
from closebook.llm.toxicity import calibrate, sigmoid

SMALL = 10_000  # windows, of all findings together, that the driver learns from by itself
SHARD = 60_000  # windows without a finding that a task learns one after the other
ROUNDS = 4
LEAST = 400  # findings of a class for a shard and round, where there are as many
LEAST_STEPS = 500
BATCH = 128
SHARES = {1: 4.0, 0: 1.0, 2: 1.0}  # what secrets, candidates with and without a digit weigh together
BINS = 256  # counted steps of an output of 1
RECALL = 0.98
DOUBT = 0.25  # weight of candidates without a finding in the first round
LEFT, OWN, RIGHT = 16, 40, 8
STEP = 20
SHOWN = 8
WIDTH = LEFT + OWN + RIGHT
MIN_CANDIDATE = 12

#: The kinds of base findings and their patterns, in the order of the kinds.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # `[0-9a-f]+` of 24 or more: runs are whole either way

_KEYWORD = re.compile(r"(?i:passw|secret|token|api_?key)")
_DIGITS = re.compile(r"[0-9]+")
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]*")
_LONG_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % MIN_CANDIDATE)
_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base patterns, sorted."""
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for a, b in _digit_runs(text, HEX):
        out.append((a, 2, b))
    return sorted(out)


def _digit_runs(text, pattern):
    return [m.span() for m in pattern.finditer(text)]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs with a digit, of `MIN_CANDIDATE` or more characters, that touch no base finding."""
    out, last = [], 0
    for m in _DIGITS.finditer(text):
        if m.start() < last:
            continue
        start = m.start()
        while start > last and text[start - 1] in _CHARACTERS:
            start -= 1
        last = _RUN.match(text, m.end()).end()
        if last - start >= MIN_CANDIDATE:
            out.append((start, last))
    return [(a, b) for a, b in out if not any(s < b and a < e for s, _, e in base)] if base else out


def undigited(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The like without a digit."""
    out = [m.span() for m in _LONG_RUN.finditer(text) if not _DIGITS.search(m[0])]
    return [(a, b) for a, b in out if not any(s < b and a < e for s, _, e in base)] if base else out


def window(text: str, start: int, end: int) -> str:
    """Candidate and surroundings at fixed places; NUL where there is no character."""
    before = text[max(0, start - LEFT):start].rjust(LEFT, "\0")
    own = text[start:min(end, start + OWN)].ljust(OWN, "\0")
    return before + own + text[end:end + RIGHT].ljust(RIGHT, "\0")


def windows_of(text: str, start: int, end: int, most: int | None = None) -> list[str]:
    """Windows that together read the whole candidate; with `most`, that many of them."""
    starts = [*range(start, end - OWN, STEP), max(start, end - OWN)]
    if most is not None and len(starts) > most:
        starts = [starts[i * (len(starts) - 1) // (most - 1)] for i in range(most)]
    return [window(text, at, min(end, at + OWN)) for at in starts]


def _encode(windows: list[str]) -> np.ndarray:
    """Characters as numbers: 0 none, 1 to 95 printable ASCII, 96 other."""
    points = np.frombuffer("".join(windows).encode("utf-32-le"), "<u4").astype(np.int64).reshape(len(windows), WIDTH)
    return np.where(points == 0, 0, np.where((points >= 32) & (points < 127), points - 31, 96))


class Network:
    """Embedding, one convolution, largest and mean activation, one output."""

    EMBED, TAPS, FILTERS = 8, 5, 24

    def __init__(self, seed: int = 5, kind=np.float64):
        rng = np.random.default_rng(seed)
        inputs = (self.EMBED + 1) * self.TAPS
        self.p = {
            "embed": rng.normal(0, 0.3, (97, self.EMBED)),
            "kernel": rng.normal(0, np.sqrt(2 / inputs), (inputs, self.FILTERS)),
            "shift": np.zeros(self.FILTERS),
            "out": rng.normal(0, 0.1, 2 * self.FILTERS),
            "bias": np.zeros(1),
        }
        self.p = {k: v.astype(kind) for k, v in self.p.items()}
        mark = np.zeros(WIDTH, kind)
        mark[LEFT:LEFT + OWN] = 1
        self.mark = mark

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)]).astype(np.float64)

    def restored(self, flat: np.ndarray) -> Network:
        at = 0
        for k in sorted(self.p):
            v = self.p[k]
            self.p[k] = flat[at:at + v.size].reshape(v.shape).astype(v.dtype)
            at += v.size
        return self

    def _forward(self, x):
        e = self.p["embed"][x]
        own = (self.mark * (x > 0))[..., None]
        z = np.concatenate([e, own], axis=2)
        steps = WIDTH - self.TAPS + 1
        taps = np.concatenate([z[:, j:j + steps] for j in range(self.TAPS)], axis=2)
        a = np.maximum(taps @ self.p["kernel"] + self.p["shift"], 0)
        top = a.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(axis=1)], axis=1)
        return taps, a, top, pooled, pooled @ self.p["out"] + self.p["bias"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i:i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def _slopes(self, x, y, weight):
        taps, a, top, pooled, z = self._forward(x)
        e = (weight * (sigmoid(z) - y) / len(y)).astype(z.dtype)
        d = e[:, None] * self.p["out"][None]
        k = self.FILTERS
        da = np.repeat(d[:, None, k:] / a.shape[1], a.shape[1], axis=1)
        np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + d[:, None, :k], 1)
        da *= a > 0
        back = da @ self.p["kernel"].T
        wide = self.EMBED + 1
        dz = np.zeros((len(x), WIDTH, wide), z.dtype)
        for j in range(self.TAPS):
            dz[:, j:j + a.shape[1]] += back[:, :, j * wide:(j + 1) * wide]
        places = x.reshape(-1, 1) * self.EMBED + np.arange(self.EMBED)
        embed = np.bincount(places.ravel(), dz[:, :, :self.EMBED].ravel(), self.p["embed"].size).reshape(self.p["embed"].shape)
        return {
            "embed": embed, "kernel": np.tensordot(taps, da, ((0, 1), (0, 1))), "shift": da.sum(axis=(0, 1)),
            "out": pooled.T @ e, "bias": np.array([e.sum()]),
        }

    def learn(self, x, y, weight, epochs: int = 6, least_steps: int = 800, seed: int = 11):
        rng = np.random.default_rng(seed)

        def batches():
            for _ in range(max(epochs, -(-least_steps * BATCH // len(x)))):
                order = rng.permutation(len(x))
                for at in range(0, len(order), BATCH):
                    yield order[at:at + BATCH]

        self._descend((x[some], y[some], weight[some]) for some in batches())

    def learn_classes(self, classes: list[tuple[np.ndarray, np.ndarray, float, float]], rounds: int, rng):
        """One of `rounds` turns over the (windows, weights, label, share of the loss) of each class.

        Every batch has some of each class; each window comes up at least once.
        """
        total = sum(len(x) for x, *_ in classes)
        takes = [max(BATCH // 8, BATCH * len(x) // total) for x, *_ in classes]
        steps = max(max(-(-len(c[0]) // k) for c, k in zip(classes, takes, strict=True)), -(-LEAST_STEPS // rounds))
        orders = [
            np.concatenate([rng.permutation(len(c[0])) for _ in range(-(-steps * k // len(c[0])))])
            for c, k in zip(classes, takes, strict=True)]
        y = np.concatenate([np.full(k, label) for (_, _, label, _), k in zip(classes, takes, strict=True)])

        def batches():
            for step in range(steps):
                some = [order[step * k:(step + 1) * k] for order, k in zip(orders, takes, strict=True)]
                weight = [
                    w[n] * (share * len(y) / k) for (_, w, _, share), n, k in zip(classes, some, takes, strict=True)]
                x = [c[0][n] for c, n in zip(classes, some, strict=True)]
                yield np.concatenate(x).astype(np.int64), y, np.concatenate(weight)

        self._descend(batches())

    def _descend(self, batches):
        """Adam over batches of (windows, labels, weights)."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(q) for k, q in self.p.items()}
        for step, batch in enumerate(batches, 1):
            for k, g in self._slopes(*batch).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                self.p[k] -= 0.004 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)


def _findings(batches):
    """Base findings (their value, 1) and other candidates (0 with a digit, 2 without) as windows."""
    for batch in batches:
        at = batch.schema.get_field_index
        windows, labels = [], []
        for text in batch.column(at("text")):
            text = text.as_py() or ""
            base = base_findings(text)
            for start, kind, end in base:
                if kind == 0:
                    start = ASSIGN.match(text, start).start(2)
                windows.append(windows_of(text, start, end))
                labels.append(1)
            for label, found in ((0, candidates), (2, undigited)):
                for start, end in found(text, base):
                    windows.append(windows_of(text, start, end))
                    labels.append(label)
        yield pa.RecordBatch.from_arrays(
            [pa.array(windows, pa.list_(pa.string())), pa.array(labels, pa.int32())], names=["windows", "label"])


_ALPHABETS = (
    "0123456789abcdef", "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
)


def _varied(secrets: list[str], others: list[str], rng) -> list[str]:
    """Secrets in other alphabets, in the surroundings of other candidates and behind their ends."""
    out = []
    for w in secrets:
        own = w[LEFT:LEFT + OWN].rstrip("\0")
        around = others[rng.integers(len(others))] if others else w
        length = max(len(own), MIN_CANDIDATE)
        letters = _ALPHABETS[rng.integers(len(_ALPHABETS))]
        value = "".join(letters[i] for i in rng.integers(len(letters), size=length))
        tail = around[LEFT:LEFT + OWN].rstrip("\0")
        behind = (tail + "/" + value)[-OWN:] if around is not w else value
        for own in (own, value, behind):
            out.append(around[:LEFT] + own.ljust(OWN, "\0") + around[LEFT + OWN:])
    return out


def _weights(found: list[list[str]]) -> np.ndarray:
    """What each window of these findings weighs."""
    return np.array([min(1.0, SHOWN / len(windows)) for windows in found for _ in windows])


def _learned(secrets: list[str], others: list[str], weights: np.ndarray) -> Network:
    network = Network()
    network.learn(_encode(secrets + others), np.array([1.0] * len(secrets) + [0.0] * len(others)), weights)
    return network


def _largest(network: Network, found: list[list[str]]) -> np.ndarray:
    """The largest logit of the windows of each candidate, encoded some at a time."""
    flat = [w for windows in found for w in windows]
    if not flat:
        return np.zeros(0)
    z = np.concatenate([network.logits(_encode(flat[i:i + 4096])) for i in range(0, len(flat), 4096)])
    return np.maximum.reduceat(z, np.cumsum([0] + [len(windows) for windows in found[:-1]]))


def fit(secrets: list[list[str]], others: list[list[str]], recall: float = RECALL, seed: int = 3) -> dict | None:
    """A network, its calibration and threshold, from the windows of each finding; None
    without findings of both classes."""
    if len(secrets) < 5 or len(others) < 5:
        return None
    rng = np.random.default_rng(seed)

    def split(items):
        return [w for i, w in enumerate(items) if i % 5 < 4], [w for i, w in enumerate(items) if i % 5 == 4]

    def flat(items):
        return [w for windows in items for w in windows]

    (a, a_held), (b, b_held) = split(secrets), split(others)
    own = _weights(a)
    own = np.concatenate([own, np.repeat(own, 3)])
    a = flat(a) + _varied(flat(a), flat(b), rng)
    a_held = a_held + [[w] for w in _varied([windows[0] for windows in a_held], flat(b_held), rng)]
    # That no pattern has found a candidate is a weak label. Those that a first network takes
    # for secrets all the same are no examples for the one that counts.
    # Each half is judged by a network that has not seen it.
    halves = [_learned(a, flat(b[k::2]), np.concatenate([own, DOUBT * _weights(b[k::2])])) for k in (0, 1)]
    b, b_held = (
        [w for k in (0, 1) for w, z in zip(some[1 - k::2], _largest(halves[k], some[1 - k::2]), strict=True) if z < 0]
        for some in (b, b_held)
    )
    if not b or not b_held:
        return None
    network = _learned(a, flat(b), np.concatenate([own, _weights(b)]))
    held = np.array([1.0] * len(a_held) + [0.0] * len(b_held))
    z = _largest(network, a_held + b_held)
    slope, offset = calibrate(z, held)
    found = np.sort(sigmoid(slope * z[held > 0] + offset))
    threshold = float(found[int((1 - recall) * len(found))])
    return {"network": network, "slope": slope, "offset": offset, "threshold": threshold}


def _classes(rows: pa.Table, judges: list[np.ndarray] | None) -> tuple[dict[int, list[list[str]]], np.ndarray]:
    """Windows of the findings of each label in the order of their hash, and the copies of the secrets and others kept.

    Of candidates without a finding those go that the network of the other half takes for secrets.
    """
    rows = rows.sort_by([("key", "ascending"), ("label", "ascending")])
    labels, halves = rows["label"].to_numpy(), rows["half"].to_numpy()
    windows, keep = rows["windows"].to_pylist(), np.ones(len(labels), bool)
    for half in (0, 1) if judges else ():
        at = np.flatnonzero((labels != 1) & (halves == half))
        network = Network(kind=np.float32).restored(judges[1 - half])
        keep[at] = _largest(network, [windows[i] for i in at]) < 0
    found = {label: [windows[i] for i in np.flatnonzero(keep & (labels == label))] for label in SHARES}
    copies = rows["copies"].to_numpy()
    return found, {label: copies[keep & (labels == label)] for label in SHARES}


def _surroundings(found: dict[int, list[list[str]]]) -> list[str]:
    """Windows of other candidates, about as many without a digit as with one."""
    flat = {label: [w for windows in found[label] for w in windows] for label in (0, 2)}
    return flat[0] + flat[2][:max(len(flat[0]), BATCH)]


def _learn_shard(sent, turn: int):
    """Parameters of a network after a round over one shard, times its windows, in whole 1/65536."""

    def step(key, rows):
        start, judges, doubt = sent.value
        net, slot = (k.as_py() for k in key)
        rng = np.random.default_rng([turn, net, slot])
        found, _ = _classes(rows, judges)
        number = sum(len(windows) for some in found.values() for windows in some)
        network = Network(kind=np.float32).restored(start[net])
        if found[1] and (found[0] or found[2]):
            secrets, weights = [w for windows in found[1] for w in windows], _weights(found[1])
            secrets += _varied(secrets, _surroundings(found), rng)
            sets = [(_encode(secrets).astype(np.uint8), np.concatenate([weights, np.repeat(weights, 3)]), 1.0, SHARES[1])]
            for label in (0, 2):
                if not found[label]:
                    continue
                some = [w for windows in found[label] for w in windows]
                sets.append((_encode(some).astype(np.uint8), doubt * _weights(found[label]), 0.0, SHARES[label]))
            whole = sum(share for *_, share in sets)
            network.learn_classes([(x, w, y, share / whole) for x, w, y, share in sets], ROUNDS, rng)
        flat = np.append(network.flat(), 1.0)
        return pa.table({
            "net": pa.array([net] * len(flat), pa.int32()), "at": pa.array(range(len(flat)), pa.int32()),
            "total": pa.array(np.rint(flat * number * 65536).astype(np.int64), pa.int64())})

    return step


def _count_shard(sent):
    """Numbers of held-out findings by label (secrets 1, with their varied forms) and step of the output."""

    def step(key, rows):
        final, judges = sent.value
        found, copies = _classes(rows, judges)
        rng = np.random.default_rng([ROUNDS, key[0].as_py()])
        varied = [[w] for w in _varied([windows[0] for windows in found[1]], _surroundings(found), rng)]
        network = Network(kind=np.float32).restored(final)
        z = _largest(network, found[1] + varied + found[0] + found[2])
        number = np.concatenate([copies[1], np.repeat(copies[1], 3), copies[0], copies[2]])
        label = np.arange(len(z)) < 4 * len(found[1])
        return pa.table({
            "label": pa.array(label.astype(np.int32)), "bin": pa.array(np.floor(np.clip(z, -40, 40) * BINS).astype(np.int32)),
            "number": pa.array(number, pa.int64())})

    return step


def _dealt(found: DataFrame, shards: int, counts: dict[int, int], halves: bool) -> DataFrame:
    """Findings to learn with the network and slot they go to; a slot is a round of a shard."""
    slots = shards * ROUNDS
    copies = F.lit(1)
    for label, n in counts.items():
        per = n // 2 if halves and label != 1 else n
        copies = F.when(F.col("label") == label, max(1, min(slots, -(-LEAST * slots // max(per, 1))))).otherwise(copies)
    nets = F.when(F.col("label") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array("half")) if halves else F.array(F.lit(0))
    turn = F.explode(F.sequence(F.lit(0), copies - 1))
    out = found.where("NOT held").withColumn("net", F.explode(nets)).withColumn("again", turn)
    return out.withColumn("slot", F.pmod(F.pmod(F.xxhash64("key"), F.lit(slots)) + F.col("again"), F.lit(slots)).cast("int")).drop("again")


def _distributed(found: DataFrame, dealt: DataFrame, shards: int, nets: int, judges: list | None, doubt: float) -> list[np.ndarray]:
    """Parameters of `nets` networks after all rounds."""
    context = found.sparkSession.sparkContext
    at = [Network(kind=np.float32).flat()] * nets
    for turn in range(ROUNDS):
        sent = context.broadcast((at, judges, doubt))
        sums = (
            dealt.where((F.col("slot") >= turn * shards) & (F.col("slot") < (turn + 1) * shards))
            .repartition(4 * shards * nets, "net", "slot").groupBy("net", "slot")
            .applyInArrow(_learn_shard(sent, turn), "net int, at int, total bigint")
            .groupBy("net", "at").agg(F.sum("total").alias("total")).collect()
        )
        totals = np.zeros((nets, len(at[0]) + 1))
        for r in sums:
            totals[r["net"], r["at"]] = r["total"]
        at = [row[:-1] / row[-1] if row[-1] else before for row, before in zip(totals, at, strict=True)]
        sent.unpersist()
    return at


def fit_distributed(found: DataFrame, counts: dict[int, int], windows: int, shard: int = SHARD, recall: float = RECALL) -> dict | None:
    """What `fit` gives, learned by tasks from all findings of a written table."""
    key = F.xxhash64("windows", "label")
    found = found.withColumn("key", key).withColumn("half", F.pmod(F.xxhash64("key", F.lit("half")), F.lit(2)).cast("int"))
    found = found.withColumn("held", F.pmod(F.xxhash64("key", F.lit("held")), F.lit(5)) == 4)
    context = found.sparkSession.sparkContext
    shards = max(1, windows // (2 * shard))
    judges = _distributed(found, _dealt(found, shards, counts, True), shards, 2, None, DOUBT)
    shards = max(1, windows // shard)
    final = _distributed(found, _dealt(found, shards, counts, False), shards, 1, judges, 1.0)[0]
    sent = context.broadcast((final, judges))
    rows = (
        found.where("held").withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
        .repartition(4 * shards, "slot").groupBy("slot").applyInArrow(_count_shard(sent), "label int, bin int, number bigint")
        .groupBy("label", "bin").agg(F.sum("number").alias("number")).orderBy("label", "bin").collect()
    )
    label, place, number = (np.array([r[c] for r in rows], float) for c in ("label", "bin", "number"))
    if len(set(label)) < 2:
        return None
    slope, offset = calibrate((place + 0.5) / BINS, label, number)
    secrets = label > 0
    below = np.cumsum(number[secrets])
    least = place[secrets][np.searchsorted(below, int((1 - recall) * below[-1]), side="right")] / BINS
    network = Network(kind=np.float32).restored(final)
    return {"network": network, "slope": slope, "offset": offset, "threshold": float(sigmoid(slope * least + offset))}


def train(docs: DataFrame, text_column: str = "text", small: int = SMALL, shard: int = SHARD) -> dict | None:
    """A model of the findings of all documents."""
    found = written(
        docs.select(F.col(text_column).alias("text")).mapInArrow(_findings, "windows array<string>, label int")
        .groupBy("windows", "label").agg(F.count("*").alias("copies")), "findings")
    sums = found.groupBy("label").agg(
        F.count("*").alias("texts"), F.sum("copies").alias("findings"), F.sum(F.size("windows")).alias("windows"),
        F.sum(F.size("windows") * F.col("copies")).alias("all_windows")).collect()
    by = {r["label"]: r for r in sums}
    secrets = by[1]["findings"] if 1 in by else 0
    if secrets < 5 or sum(r["findings"] for r in sums) - secrets < 5:
        return None
    if sum(r["all_windows"] for r in sums) > small:
        counts = {label: r["texts"] for label, r in by.items()}
        return fit_distributed(found, counts, sum(r["windows"] for r in sums if r["label"] != 1), shard)
    rows = found.select("*", F.xxhash64("windows", "label").alias("key")).collect()
    rows.sort(key=lambda r: (r["label"] == 2, r["key"], r["windows"]))
    return fit(
        [r["windows"] for r in rows if r["label"] == 1 for _ in range(r["copies"])],
        [r["windows"] for r in rows if r["label"] != 1 for _ in range(r["copies"])])


def _spelled(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _judged(texts, base, model):
    """(number of the text, candidate, probability), some thousand windows at a time."""

    def judge(some):
        p = sigmoid(model["slope"] * _largest(model["network"], [windows for _, _, windows in some]) + model["offset"])
        return [(n, place, sure) for (n, place, _), sure in zip(some, p, strict=True)]

    waiting, held = [], 0
    for n, text in enumerate(texts):
        for a, b in candidates(text, base[n]) + undigited(text, base[n]):
            waiting.append((n, (a, b), windows_of(text, a, b)))
            held += len(waiting[-1][2])
            if held >= 4096:
                yield from judge(waiting)
                waiting, held = [], 0
    yield from judge(waiting)


def _scan(sent):
    def step(batches):
        worker_cache("secrets")  # those of other operators go
        model = sent.value
        for batch in batches:
            at = batch.schema.get_field_index
            texts = [t.as_py() or "" for t in batch.column(at("text"))]
            base = [base_findings(t) for t in texts]
            spans = [list(s) for s in base]
            if model:
                for n, (a, b), sure in _judged(texts, base, model):
                    if sure >= model["threshold"]:
                        spans[n].append((a, 3, b))
            columns = [pa.array([sum(k == kind for _, k, _ in s) for s in base], pa.int64()) for kind in range(3)]
            columns.append(pa.array([hashlib.sha256(_spelled(s).encode()).hexdigest() for s in base], pa.string()))
            columns.append(pa.array([_spelled(sorted(s)) for s in spans], pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(at("id")), *columns], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return step


def scan_secrets(docs: DataFrame, model: dict | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, numbers of base findings, their digest and all spans as `kind:start:end`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()
    out = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        _scan(sent), f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_column)


@query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, train(docs))
