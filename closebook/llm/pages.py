"""HTML extraction: a bidirectional LSTM labels the blocks of a page.

Each block is a vector: hashed tags and names of the elements around it, hashed words,
and figures of length, links, punctuation and place. A bidirectional LSTM in numpy reads
all blocks of a page in both directions and gives each the odds of being main text; blocks
over an even chance are joined in page order by one space.

It is trained on pages of the table itself, `SAMPLE` at most, in the order of a hash of
the url, of long ones on a stretch of `TRAIN_BLOCKS` blocks. Pages that hold an `article`
or `main` label their own blocks (inside of it, outside of elements for navigation and the
like); pages without label nothing. The same texts are also set into varied layouts, with
menus, notices, adverts, sidebars, forms and reader comments around and inside of the
article, whose labels are known. Where no page has such an element, what stands between a
page's first and last long block takes its place in those layouts. Tag names
alone are sometimes taken away, so that words and neighbours have to decide too.

Reading a page takes time in proportion to its length, however deep its elements; pages are
labelled in groups of `BLOCKS_AT_ONCE` blocks, a longer page alone. Null and empty pages
have no blocks and an empty text. Where the sample has no text that could be an article's
the labels of the markup are used as they are. Rows are independent of each other, so
repeated pages give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closebook.llm.blocks import Block, read_blocks
from closebook.llm.common import query, table
from closebook.llm.toxicity import sigmoid

SAMPLE = 300
LAYOUTS = 3
HIDDEN = 16
PATH_BUCKETS, WORD_BUCKETS, FIGURES = 192, 96, 7
CACHED_WORDS = 100_000
TRAIN_BLOCKS = 100
BLOCKS_AT_ONCE = 4096
FADE = 0.9
#: A block that could be an article's, where no page says which are.
LONG_WORDS = 25

_WORD = re.compile(r"\w+")


class Vectors:
    """Vectors of blocks; words are hashed once while they fit the cache."""

    def __init__(self):
        self.cache: dict[str, int] = {}

    def _word(self, word: str) -> int:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            found = self.cache[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        return found

    def _path(self, block: Block) -> np.ndarray:
        """Names around a block, the farther the lighter, as far as a weight changes a sum."""
        out, weight = np.zeros(PATH_BUCKETS, np.float32), 1.0
        for name in block.names():
            out[zlib.crc32(name.encode("utf-8", "surrogatepass")) % PATH_BUCKETS] += weight
            weight *= FADE
            if weight < 1e-7:
                break
        return out

    def __call__(self, blocks: list[Block]) -> np.ndarray:
        n = len(blocks)
        path = np.zeros((n, PATH_BUCKETS), np.float32)
        words = np.zeros((n, WORD_BUCKETS), np.float32)
        figures = np.zeros((n, FIGURES), np.float32)
        places: dict[int, np.ndarray] = {}
        for i, b in enumerate(blocks):
            if id(b.place) not in places:
                places[id(b.place)] = self._path(b)
            path[i] = places[id(b.place)]
            own = [self._word(w) for w in _WORD.findall(b.text.lower())]
            if own:
                words[i] = np.bincount(own, minlength=WORD_BUCKETS) / len(own)
            size = len(b.text)
            figures[i] = (
                np.log1p(size) / 5, np.log1p(len(own)) / 4, min(b.linked / size, 1.0),
                sum(b.text.count(c) for c in ".!?;") / max(len(own), 1) * 4, i / n, 1 / (1 + i), 1 / (n - i),
            )
        return np.concatenate([np.minimum(path, 2), np.sqrt(words), figures], axis=1)


class Labeller:
    """A linear layer, an LSTM in each direction, one output per block."""

    INPUT, REDUCED = PATH_BUCKETS + WORD_BUCKETS + FIGURES, 24

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        k, h = self.REDUCED, HIDDEN
        self.p = {"reduce": rng.normal(0, 0.15, (self.INPUT, k)), "first": np.zeros(k), "out": rng.normal(0, 0.2, 2 * h + k), "last": np.zeros(1)}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 1 / np.sqrt(k), (k, 4 * h))
            self.p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.p[f"s{d}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])

    def _run(self, d: str, z: np.ndarray, mask: np.ndarray, keep: bool):
        """One direction over (pages, blocks, features); states stay as they are where the mask is 0."""
        n, steps, _ = z.shape
        h = HIDDEN
        drive = z @ self.p[f"x{d}"] + self.p[f"s{d}"]
        out, state, cell, trail = np.zeros((n, steps, h)), np.zeros((n, h)), np.zeros((n, h)), []
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        for t in order:
            g = drive[:, t] + state @ self.p[f"h{d}"]
            s = sigmoid(g[:, :3 * h])
            i, f, o, c = s[:, :h], s[:, h:2 * h], s[:, 2 * h:], np.tanh(g[:, 3 * h:])
            m = mask[:, t, None]
            new = f * cell + i * c
            squashed = np.tanh(new)
            if keep:
                trail.append((t, state, cell, i, f, o, c, squashed, m))
            cell = m * new + (1 - m) * cell
            state = m * (o * squashed) + (1 - m) * state
            out[:, t] = state
        return out, trail

    def _forward(self, x, mask, keep=False):
        z = np.tanh(x @ self.p["reduce"] + self.p["first"])
        forward, tf = self._run("f", z, mask, keep)
        backward, tb = self._run("b", z, mask, keep)
        joined = np.concatenate([forward, backward, z], axis=2)
        return joined @ self.p["out"] + self.p["last"][0], (z, joined, tf, tb)

    def logits(self, pages: list[list[Block]], vectors: Vectors) -> list[np.ndarray]:
        """Odds of the blocks of each page; pages of like length are read together, as many as
        `BLOCKS_AT_ONCE` holds."""
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            some = [order.pop(0)]
            while order and len(pages[order[0]]) * (len(some) + 1) <= BLOCKS_AT_ONCE:
                some.append(order.pop(0))
            x, mask = _padded([vectors(pages[i]) for i in some])
            z, _ = self._forward(x, mask)
            for row, i in zip(z, some, strict=True):
                out[i] = row[:len(pages[i])]
        return out

    def slopes(self, x, mask, y):
        h = HIDDEN
        logit, (z, joined, tf, tb) = self._forward(x, mask, keep=True)
        e = (sigmoid(logit) - y) * mask / max(mask.sum(), 1)
        g = {"out": np.tensordot(joined, e, ((0, 1), (0, 1))), "last": np.array([e.sum()])}
        d = e[..., None] * self.p["out"]
        dz = d[..., 2 * h:].copy()
        for name, trail, down in (("f", tf, d[..., :h]), ("b", tb, d[..., h:2 * h])):
            gx, gh, gs = (np.zeros_like(self.p[f"{k}{name}"]) for k in "xhs")
            ds, dc = np.zeros((len(x), h)), np.zeros((len(x), h))
            for t, state, cell, i, f, o, c, squashed, m in reversed(trail):
                ds = ds + down[:, t]
                own = ds * m
                dn = dc * m + own * o * (1 - squashed ** 2)
                gate = np.concatenate([
                    dn * c * i * (1 - i), dn * cell * f * (1 - f), own * squashed * o * (1 - o), dn * i * (1 - c ** 2),
                ], axis=1)
                gx += z[:, t].T @ gate
                gh += state.T @ gate
                gs += gate.sum(axis=0)
                dz[:, t] += gate @ self.p[f"x{name}"].T
                ds = ds * (1 - m) + gate @ self.p[f"h{name}"].T
                dc = dc * (1 - m) + dn * f
            g |= {f"x{name}": gx, f"h{name}": gh, f"s{name}": gs}
        dr = dz * (1 - z ** 2)
        g["reduce"] = np.tensordot(x, dr, ((0, 1), (0, 1)))
        g["first"] = dr.sum(axis=(0, 1))
        return g

    def learn(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 6, seed: int = 2):
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(q) for k, q in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), 32):
                some = order[at:at + 32]
                x, mask = _padded([pages[i] for i in some])
                # Some pages are shown without part of their tags and names.
                hidden = rng.random((len(some), 1, PATH_BUCKETS)) < rng.choice([0.0, 0.1, 0.5], size=(len(some), 1, 1), p=[0.6, 0.25, 0.15])
                x[..., :PATH_BUCKETS] *= ~hidden
                y, _ = _padded([labels[i][:, None] for i in some])
                step += 1
                for k, g in self.slopes(x, mask, y[..., 0]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= 0.01 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), steps, pages[0].shape[1]), np.float32), np.zeros((len(pages), steps), np.float32)
    for i, p in enumerate(pages):
        x[i, :len(p)] = p
        mask[i, :len(p)] = 1
    return x, mask


#: Layouts of made-up training pages. {t} is a text, {l} a row of links.
ARTICLES = (
    "<article>{b}</article>", "<main>{b}</main>", "<main><article class=\"post\">{b}</article></main>", "<div class=\"content\">{b}</div>",
    "<div id=\"content\"><div class=\"post-body\">{b}</div></div>", "<div class=\"article-body\">{b}</div>", "<section class=\"story\">{b}</section>",
    "<div class=\"entry-content\">{b}</div>", "<div id=\"main\">{b}</div>", "<td class=\"text\">{b}</td>", "<div>{b}</div>", "{b}",
)
ABOVE = (
    "<nav><ul>{l}</ul></nav>", "<header><h2>{t}</h2><div>{l}</div></header>", "<div class=\"menu\"><ul>{l}</ul></div>", "<div id=\"nav\">{l}</div>",
    "<div class=\"cookie-notice\"><p>{t}</p><button>{w}</button></div>", "<div class=\"banner\" role=\"alert\">{t}</div>", "<div class=\"ad\">{t}</div>",
    "<div class=\"breadcrumb\">{l}</div>", "<form action=\"/s\"><label>{w}</label><input name=\"q\"><button>{w}</button></form>", "<div class=\"notice\">{t}</div>",
    "<ul class=\"topbar\">{l}</ul>", "<div class=\"header\"><a href=\"/\">{w}</a></div>",
)
BESIDE = (
    "<aside><h3>{w}</h3><p>{t}</p></aside>", "<div class=\"sidebar\"><h3>{w}</h3><ul>{l}</ul></div>", "<div class=\"ad\">{t}</div>", "<div class=\"advert\"><p>{t}</p></div>",
    "<div class=\"related\"><h4>{w}</h4><ul>{l}</ul></div>", "<div class=\"share\">{l}</div>", "<form class=\"newsletter\"><p>{t}</p><button>{w}</button></form>",
    "<div class=\"promo\">{t}</div>", "<div class=\"sponsored\"><a href=\"/x\">{t}</a></div>",
)
BELOW = (
    "<section class=\"comments\"><h3>{w}</h3><div class=\"comment\"><p>{t}</p></div><div class=\"comment\"><p>{t}</p></div></section>",
    "<div id=\"comments\"><ul class=\"comment-list\"><li class=\"comment\"><b>{w}</b><p>{t}</p></li><li class=\"comment\"><p>{t}</p><p>{t}</p></li></ul></div>",
    "<ol class=\"replies\"><li><p>{t}</p></li><li><p>{t}</p></li></ol>", "<footer>&copy; {w} &middot; {t}</footer>", "<div class=\"footer\">{l} {t}</div>", "<div id=\"footer\"><p>{t}</p></div>",
    "<footer><ul>{l}</ul><p>{t}</p></footer>", "<div class=\"disqus\"><p>{t}</p></div>", "<aside class=\"sidebar\"><p>{t}</p><ul>{l}</ul></aside>",
    "<form class=\"reply\"><label>{w}</label><textarea></textarea><button>{w}</button></form>",
)
PARTS = ("<p>{t}</p>",) * 6 + (
    "<h2>{t}</h2>", "<ul><li>{t}</li><li>{t}</li></ul>", "<blockquote>{t}</blockquote>", "<pre>{t}</pre>", "<p><b>{t}<br><p>{t}</p>", "<table><tr><td>{t}</td><td>{t}</td></tr></table>",
    "<p>{t} <a href=\"/a\">{w}</a> {t}</p>", "<div>{t}</div>",
)


class Layouts:
    """Pages in varied layouts from texts of articles and of what stands around them."""

    def __init__(self, articles: list[list[str]], around: list[str], seed: int = 4):
        self.articles, self.around, self.rng = articles, around or ["..."], np.random.default_rng(seed)

    def _pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def _filled(self, form: str, texts) -> str:
        out = form
        while "{l}" in out:
            links = "".join(f"<li><a href=\"/{i}\">{html.escape(self._word())}</a></li>" for i in range(int(self.rng.integers(2, 8))))
            out = out.replace("{l}", links, 1)
        while "{w}" in out:
            out = out.replace("{w}", html.escape(self._word()), 1)
        while "{t}" in out:
            out = out.replace("{t}", html.escape(texts()), 1)
        return out

    def _word(self) -> str:
        words = self._pick(self.around).split() or ["..."]
        return " ".join(self._pick(words) for _ in range(int(self.rng.integers(1, 3))))

    def _other(self) -> str:
        """What could stand anywhere: text from around articles, or of another article."""
        if self.rng.random() < 0.5:
            return self._pick(self.around)
        words = self._pick(self._pick(self.articles)).split()
        at, size = int(self.rng.integers(max(len(words) - 3, 1))), int(self.rng.integers(3, 60))
        return " ".join(words[at:at + size])

    def page(self, texts: list[str]) -> str:
        rng = self.rng

        def noise(forms, most):
            return "".join(f"<div data-y=\"0\">{self._filled(self._pick(forms), self._other)}</div>" if rng.random() < 0.3 else _marked(
                self._filled(self._pick(forms), self._other), "0") for _ in range(int(rng.integers(0, most + 1))))

        body, left = [f"<h1>{html.escape(texts[0])}</h1>"] if rng.random() < 0.8 else [], list(texts[1:]) or list(texts)
        while left:
            form = self._pick(PARTS)
            body.append(self._filled(form, lambda: left.pop(0) if left else self._pick(texts)))
            if rng.random() < 0.04:
                body.append(_marked(self._filled(self._pick(BESIDE), self._other), "0"))
        article = _marked(self._pick(ARTICLES).replace("{b}", "".join(body)), "1")
        inner = noise(ABOVE, 4) + noise(BESIDE, 1) + article + noise(BESIDE, 2) + noise(BELOW, 3)
        if rng.random() < 0.4:
            inner = f"<div class=\"{self._pick(('wrapper', 'page', 'container', 'site'))}\">{inner}</div>"
        return f"<!DOCTYPE html><html><head><title>x</title></head><body data-y=\"0\">{inner}</body></html>"


def _marked(markup: str, label: str) -> str:
    """`markup` with the label on its first element, or inside of an element that only holds it."""
    if not markup.startswith("<"):
        return f"<span data-y=\"{label}\">{markup}</span>"
    if markup.startswith(("<h1>", "<p>")):
        return f"<div data-y=\"{label}\">{markup}</div>"
    end = re.match(r"<[a-z0-9]+", markup).end()
    return f"{markup[:end]} data-y=\"{label}\"{markup[end:]}"


def _likely(blocks: list[Block]) -> list[str]:
    """Texts from the first long block to the last, without links and what is put around."""
    long = [i for i, b in enumerate(blocks) if not b.around and not b.linked and len(b.text.split()) >= LONG_WORDS]
    return [b.text for b in blocks[long[0]:long[-1] + 1] if not b.around and not b.linked] if long else []


def fit(pages: list[str], layouts: int = LAYOUTS, seed: int = 6) -> Labeller | None:
    """A labeller trained on pages that say where their article is, and on texts in other
    layouts; None without a text that could be an article's."""
    vectors = Vectors()
    read = [b for b in (read_blocks(p) for p in pages) if b]
    # Only a page that says where its article is labels its blocks; of others it is known
    # what an element puts around the article.
    labelled = [p for p in read if any(b.main for b in p)]
    articles = [[b.text for b in p if b.main] for p in labelled]
    if not articles:
        articles = [t for t in map(_likely, read) if t]
    around = [b.text for p in labelled for b in p if not b.main] or [b.text for p in read for b in p if b.around]
    if not articles:
        return None
    rng = np.random.default_rng(seed)
    made = Layouts(articles, around)
    x, y = [], []

    def add(blocks, labels):
        labels = np.array(labels, float)
        if len(blocks) > TRAIN_BLOCKS:  # a stretch of a long page
            at = int(rng.integers(len(blocks) - TRAIN_BLOCKS + 1))
            blocks, labels = blocks[at:at + TRAIN_BLOCKS], labels[at:at + TRAIN_BLOCKS]
        if blocks:
            x.append(vectors(blocks))
            y.append(labels)

    for blocks in labelled:
        add(blocks, [b.main for b in blocks])
    # As many made-up pages whatever the share of pages that label themselves.
    for texts in articles:
        for _ in range(-(-layouts * len(read) // len(articles))):
            blocks = read_blocks(made.page(texts))
            add(blocks, [b.label == "1" for b in blocks])
    labeller = Labeller()
    labeller.learn(x, y)
    return labeller


def main_text(pages: list[list[Block]], labeller: Labeller | None, vectors: Vectors) -> list[str]:
    """The main text of each page."""
    if labeller is None:
        return [" ".join(b.text for b in p if b.main) for p in pages]
    odds = labeller.logits(pages, vectors)
    return [" ".join(b.text for b, z in zip(p, o, strict=True) if z > 0) for p, o in zip(pages, odds, strict=True)]


def _extract(sent, html_column, names):
    def step(batches):
        labeller, vectors = sent.value, Vectors()
        for batch in batches:
            for start in range(0, len(batch), 256):
                some = batch.slice(start, 256)
                at = some.schema.get_field_index
                pages = [read_blocks(p.as_py()) for p in some.column(at(html_column))]
                texts = main_text(pages, labeller, vectors)
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(at(n)) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*names, "text", "n_chars"])

    return step


def train(pages: DataFrame, url_column: str = "url", html_column: str = "html", sample: int = SAMPLE) -> Labeller | None:
    """A labeller trained on at most `sample` pages."""
    keys = pages.where(F.col(html_column).isNotNull()).select(F.xxhash64(url_column, html_column).alias("turn"))
    last = keys.orderBy("turn").limit(sample).agg(F.max("turn")).first()[0]
    if last is None:
        return None
    chosen = pages.where(F.xxhash64(url_column, html_column) <= last).where(F.col(html_column).isNotNull())
    rows = chosen.select(html_column, F.xxhash64(url_column, html_column).alias("turn")).orderBy("turn").limit(sample).collect()
    return fit([r[0] for r in rows])


def extract_text(pages: DataFrame, labeller: Labeller | None, html_column: str = "html", keep: tuple[str, ...] | None = None) -> DataFrame:
    """`pages` (or their columns `keep`) with `text` and `n_chars` instead of the markup.

    Columns of `pages` named as a new one make way for it.
    """
    names = [c for c in (keep or pages.columns) if c.lower() not in {"text", "n_chars"} and c != html_column]
    schema = "".join(f"`{n}` {pages.schema[n].dataType.simpleString()}, " for n in names)
    sent = pages.sparkSession.sparkContext.broadcast(labeller)
    return pages.select(*names, html_column).mapInArrow(_extract(sent, html_column, names), schema + "text string, n_chars bigint")


@query("op10_html_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, train(pages), keep=("page_id", "url"))
