"""Main text of HTML pages by a recurrent labeller of blocks.

A page is read into its leaf blocks: stretches of text between block-level tags, each with the path
of tags above it. A bidirectional LSTM in numpy reads the blocks of the whole page in order, each as
a vector of its hashed tag path, of its hashed words and of a few measures, and labels every block
as main text or not. The main blocks, in page order, are the text.

The labeller is trained here on a bounded sample of pages. Its labels come from markup that names its
purpose (``article``, ``nav``, class names); variants of the sampled pages, with other containers
around the same blocks and further menus, notices, sidebars, forms and comments, teach it to go by
words and surroundings as well. Inference covers every page whole.

Defined cases: a null or empty page, or one without blocks, gives the empty text; broken markup is
read as far as it goes; repeated pages give equal texts; if no sampled page has markup to learn from,
or there are no pages, the labels come from the markup rules alone. Other columns take no part.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docmill.functions.markup import DEPTH, INLINE, VOID, tokens
from docmill.llm.common import bounded_sample, text_batches

SAMPLE_PAGES = 300
SAMPLE_CHARS = 100_000  # longest page in the sample
SAMPLE_BLOCKS = 300
EXAMPLES = 900  # sampled pages and their variants, at least; two variants of each page at least
STEPS = 300
WORD_SLOTS, WORD_DIMS = 1024, 12
PATH_SLOTS, PATH_DIMS = 2048, 16
MEASURES = 7
HIDDEN = 16
NEAR = 64  # last steps of a path that are read

# Words in names that tell the purpose of a container.
MAIN_NAMES = frozenset("article main content post entry story articlebody".split())
OTHER_TAGS = frozenset("nav footer aside form button menu dialog".split())
OTHER_NAMES = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo cookie cookies consent notice alert popup "
    "sidebar widget menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments "
    "reply replies related share sharing social newsletter subscribe login search form pagination".split()
)

_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")

Step = tuple[str, tuple[str, ...]]  # a tag and the words in its names


@dataclass
class Block:
    path: tuple[Step, ...]
    text: str
    linked: int  # characters inside links


@dataclass
class _Reader:
    stack: list[Step] = field(default_factory=list)
    opened: Counter[str] = field(default_factory=Counter)  # elements of each name in the stack
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    blocks: list[Block] = field(default_factory=list)
    paths: dict[tuple[Step, ...], tuple[Step, ...]] = field(default_factory=dict)

    def flush(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                path = tuple(s for s in self.stack if s[0] not in INLINE)
                self.blocks.append(Block(self.paths.setdefault(path, path), text, self.linked))
            self.parts, self.linked = [], 0

    def _cut(self, at: int) -> None:
        self.opened.subtract(s[0] for s in self.stack[at:])
        del self.stack[at:]

    def open(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.flush()
            closes = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
                      "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}.get(tag, ())
            inside = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
                      "dt": ("dl",), "dd": ("dl",), "option": ("select",)}.get(tag, ())
            if not closes and any(s[0] == "p" for s in self.stack[-8:]):
                closes = ("p",)  # a block ends an open paragraph
            self._end(closes, inside)
        if tag in VOID or attributes.endswith("/"):
            if tag == "br":
                self.parts.append(" ")
            return
        names = ()
        if attributes:
            found = (next(filter(None, m), "") for m in _NAMED.findall(attributes))
            names = tuple(w for value in found for w in _PART.findall(value.lower()))
        if len(self.stack) < DEPTH:
            self.stack.append((tag, names))
            self.opened[tag] += 1

    def _end(self, tags, inside) -> None:
        if not any(self.opened[t] for t in tags):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in inside:
                return
            if self.stack[at][0] in tags:
                self._cut(at)
                return
            if tags == ("p",) and self.stack[at][0] not in INLINE:
                return

    def close(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if not self.opened[tag]:
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self._cut(at)
                return
            if tag in INLINE and self.stack[at][0] not in INLINE:
                return


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks of a page, in order. Scripts, embedded elements and comments hold no text; what
    ``tokens`` says of those without an end holds here too. Elements deeper than ``DEPTH`` count as
    part of the one above them."""
    reader = _Reader()
    head = False
    for value, attributes, closes in tokens(page):
        if attributes is None:
            if not head:
                reader.parts.append(value)
                if reader.opened["a"]:
                    reader.linked += len(value)
            continue
        if closes is None:
            continue
        if value == "head":
            head = not closes
        elif value == "body" or (head and value not in VOID):
            head = False
        if value in ("html", "head", "body"):
            reader.flush()
        elif closes:
            reader.close(value)
        else:
            reader.open(value, attributes)
    reader.flush()
    return reader.blocks


def named_purpose(path: tuple[Step, ...]) -> int | None:
    """1 for main text, 0 for anything else, None if the markup does not tell."""
    main = False
    for tag, names in path:
        if tag in MAIN_NAMES or (MAIN_NAMES.intersection(names) and tag not in OTHER_TAGS):
            main = True
        elif tag in OTHER_TAGS or OTHER_NAMES.intersection(names) or (tag == "header" and not main):
            return 0
    return 1 if main else None


class Features:
    """Hashed path and word slots and measures of blocks; remembers paths and words."""

    def __init__(self):
        self.paths: dict[tuple[Step, ...], np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path_slots(self, path: tuple[Step, ...]) -> np.ndarray:
        slots = self.paths.get(path)
        if slots is None:
            path, whole = path[-NEAR:], path
            names = [f"<{tag}" for tag, _ in path] + [f".{w}" for _, words in path for w in words]
            names.append(f"last<{path[-1][0] if path else ''}")
            names += [f"{a[0]}>{b[0]}" for a, b in zip(path, path[1:])]
            slots = np.array([zlib.crc32(n.encode()) % PATH_SLOTS for n in names])
            if len(self.paths) >= 50_000:
                self.paths.clear()
            self.paths[whole] = slots
        return slots

    def word_slot(self, word: str) -> int:
        slot = self.words.get(word)
        if slot is None:
            if len(self.words) >= 300_000:
                self.words.clear()
            slot = self.words[word] = zlib.crc32(word.encode("utf-8", "replace")) % WORD_SLOTS
        return slot

    def __call__(self, blocks: list[Block]):
        """(path slots, their counts, word slots, their counts, measures) of the blocks of a page."""
        paths = [self.path_slots(b.path) for b in blocks]
        split = [b.text.lower().split() for b in blocks]
        words = [self.word_slot(w) for found in split for w in found]
        measures = np.empty((len(blocks), MEASURES), dtype=np.float32)
        for i, (b, found) in enumerate(zip(blocks, split, strict=True)):
            size = len(b.text)
            stops = b.text.count(".") + b.text.count(",") + b.text.count("!") + b.text.count("?")
            last = b.path[-1][0] if b.path else ""
            measures[i] = (
                np.log1p(len(found)) / 4, np.log1p(size) / 6, min(b.linked / size, 1.0), stops / (len(found) + 1),
                i / len(blocks), last in ("h1", "h2", "h3", "h4"), last == "p",
            )
        return (
            np.concatenate(paths), np.array([len(p) for p in paths]), np.array(words, dtype=np.int64),
            np.array([len(s) for s in split]), measures,
        )


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over the blocks of a page."""

    def __init__(self, seed: int = 3):
        random = np.random.default_rng(seed)
        size = PATH_DIMS + WORD_DIMS + MEASURES

        def made(*shape, scale=0.3):
            return (random.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"path": made(PATH_SLOTS, PATH_DIMS), "word": made(WORD_SLOTS, WORD_DIMS),
                  "out": made(2 * HIDDEN), "bias": np.zeros(1, dtype=np.float32)}
        for side in "fb":
            self.p[f"w{side}"] = made(size + HIDDEN, 4 * HIDDEN, scale=1 / np.sqrt(size + HIDDEN))
            self.p[f"c{side}"] = np.zeros(4 * HIDDEN, dtype=np.float32)
            self.p[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first

    def inputs(self, features) -> np.ndarray:
        """Input vectors of the blocks of one or more pages behind each other."""
        path, path_n, word, word_n, measures = features

        def means(table, slots, counts):
            out = np.zeros((len(counts), table.shape[1]), dtype=np.float32)
            some = np.flatnonzero(counts)
            if len(some):
                starts = (np.cumsum(counts) - counts)[some]
                out[some] = np.add.reduceat(table[slots], starts, axis=0) / np.sqrt(counts[some])[:, None]
            return out

        return np.concatenate([means(self.p["path"], path, path_n), means(self.p["word"], word, word_n), measures], axis=1)

    def run(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Score of every block, given all pages' blocks behind each other; pages go in step, the
        long ones last. With ``keep`` also what the gradients need."""
        starts = np.cumsum(lengths) - lengths
        turn = np.argsort(-lengths, kind="stable")
        starts, length = starts[turn], lengths[turn]
        steps = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(steps), side="left")
        hidden = np.zeros((len(x), 2 * HIDDEN), dtype=np.float32)
        kept = {}
        for side, base in (("f", 0), ("b", HIDDEN)):
            w, c = self.p[f"w{side}"], self.p[f"c{side}"]
            given = x @ w[: x.shape[1]] + c
            h = np.zeros((len(length), HIDDEN), dtype=np.float32)
            cell = np.zeros_like(h)
            trace = []
            for t in range(steps):
                n = active[t]
                rows = starts[:n] + (t if side == "f" else length[:n] - 1 - t)
                z = given[rows] + h[:n] @ w[x.shape[1] :]
                gates = _sigmoid(z[:, : 3 * HIDDEN])
                i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
                g = np.tanh(z[:, 3 * HIDDEN :])
                before, last = cell[:n], h[:n]
                cell = f * before + i * g
                squashed = np.tanh(cell)
                h = o * squashed
                hidden[rows, base : base + HIDDEN] = h
                if keep:
                    trace.append((rows, i, f, o, g, before, squashed, last))
            kept[side] = trace
        score = hidden @ self.p["out"] + self.p["bias"]
        return (score, hidden, kept) if keep else score

    def gradients(self, features, lengths, labels, weights):
        x = self.inputs(features)
        score, hidden, kept = self.run(x, lengths, keep=True)
        wrong = ((_sigmoid(score) - labels) * weights / max(weights.sum(), 1)).astype(np.float32)
        grads = {"out": hidden.T @ wrong, "bias": np.array([wrong.sum()], dtype=np.float32)}
        d_hidden = wrong[:, None] * self.p["out"]
        dx = np.zeros_like(x)
        size = x.shape[1]
        for side, base in (("f", 0), ("b", HIDDEN)):
            w = self.p[f"w{side}"]
            dw, dc = np.zeros_like(w), np.zeros(4 * HIDDEN, dtype=np.float32)
            dh = np.zeros((0, HIDDEN), dtype=np.float32)
            dcell = dh
            for rows, i, f, o, g, before, squashed, last in reversed(kept[side]):
                more = np.zeros((len(rows) - len(dh), HIDDEN), dtype=np.float32)
                dh, dcell = np.concatenate([dh, more]), np.concatenate([dcell, more])
                dh = dh + d_hidden[rows, base : base + HIDDEN]
                dcell = dcell + dh * o * (1 - squashed**2)
                dz = np.concatenate([
                    dcell * g * i * (1 - i), dcell * before * f * (1 - f), dh * squashed * o * (1 - o),
                    dcell * i * (1 - g**2),
                ], axis=1)
                dw[:size] += x[rows].T @ dz
                dw[size:] += last.T @ dz
                dc += dz.sum(axis=0)
                dx[rows] += dz @ w[:size].T
                dh = dz @ w[size:].T
                dcell = dcell * f
            grads[f"w{side}"], grads[f"c{side}"] = dw, dc
        path, path_n, word, word_n, _ = features
        for name, slots, counts, part in (("path", path, path_n, dx[:, :PATH_DIMS]),
                                          ("word", word, word_n, dx[:, PATH_DIMS : PATH_DIMS + WORD_DIMS])):
            share = np.repeat(part / np.sqrt(np.maximum(counts, 1))[:, None], counts, axis=0)
            sums = [np.bincount(slots, weights=share[:, i], minlength=len(self.p[name])) for i in range(part.shape[1])]
            grads[name] = np.stack(sums, axis=1).astype(np.float32)
        return grads

    def fit(self, pages: list, steps: int = STEPS, batch: int = 48, rate: float = 0.01, seed: int = 5) -> None:
        """Adam over (features, labels, weights) of pages, for ``steps`` batches or a little more."""
        epochs = -(-steps // -(-len(pages) // batch))
        random = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            turn = random.permutation(len(pages))
            for at in range(0, len(turn), batch):
                some = [pages[i] for i in turn[at : at + batch]]
                features, lengths = joined([s[0] for s in some])
                grads = self.gradients(features, lengths, np.concatenate([s[1] for s in some]),
                                       np.concatenate([s[2] for s in some]))
                step += 1
                speed = rate * (1 - epoch / epochs) + 1e-4
                for k, g in grads.items():
                    np.clip(g, -1, 1, out=g)
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    up = first[k] / (1 - 0.9**step)
                    self.p[k] -= (speed * up / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def joined(features: list):
    """Features of pages behind each other, and the pages' lengths."""
    parts = [np.concatenate([f[i] for f in features]) for i in range(5)]
    return parts, np.array([len(f[4]) for f in features])


class _Variants:
    """Pages with the blocks of a sampled page in other containers, and with further parts whose
    texts come from other pages."""

    # Containers that pages use for each purpose.
    MAIN = [("article", ()), ("main", ()), ("div", ("content",)), ("div", ("post", "body")), ("section", ("entry",)),
            ("div", ("story",)), ("div", ()), ("section", ()), ("div", ("text",)), ("td", ())]
    OTHER = {
        "menu": [("nav", ()), ("div", ("menu",)), ("ul", ("navbar",)), ("div", ("navigation",)), ("div", ("breadcrumbs",))],
        "header": [("header", ()), ("div", ("header",)), ("div", ("masthead",)), ("div", ("top", "bar"))],
        "footer": [("footer", ()), ("div", ("footer",)), ("div", ("bottom",))],
        "advert": [("div", ("ad",)), ("div", ("ads",)), ("aside", ("advert",)), ("div", ("banner",)), ("div", ("sponsored",)),
                   ("div", ("promo",))],
        "sidebar": [("aside", ()), ("div", ("sidebar",)), ("div", ("widget",)), ("div", ("related",))],
        "notice": [("div", ("cookie", "notice")), ("div", ("notice",)), ("div", ("alert",)), ("div", ("consent",)),
                   ("dialog", ())],
        "form": [("form", ()), ("form", ("newsletter",)), ("div", ("login",)), ("div", ("subscribe",))],
        "comments": [("section", ("comments",)), ("div", ("comments",)), ("ol", ("commentlist",)), ("div", ("comment",)),
                     ("div", ("replies",))],
    }

    def __init__(self, pages: list[list[Block]], seed: int = 11):
        self.random = np.random.default_rng(seed)
        self.pool = [b.text for page in pages for b in page]

    def pick(self, values):
        return values[self.random.integers(len(values))]

    def part(self, purpose: str) -> list[Block]:
        outer = self.pick(self.OTHER[purpose])
        links = purpose in ("menu", "sidebar", "footer") and self.random.random() < 0.8
        out = []
        for _ in range(self.random.integers(1, 8 if links or purpose == "comments" else 3)):
            words = self.pick(self.pool).split()
            size = self.random.integers(1, 5 if links else 60)
            text = " ".join(words[: int(size)])
            inner = self.pick([("li", ()), ("p", ()), ("div", ()), ("span", ())] if links else [("p", ()), ("div", ())])
            path = (outer, inner) if inner[0] != "span" and self.random.random() < 0.8 else (outer,)
            out.append(Block(path, text, len(text) if links else 0))
        return out

    def page(self, blocks: list[Block], labels: list[int | None]) -> tuple[list[Block], list[int | None]]:
        main = [b for b, label in zip(blocks, labels, strict=True) if label == 1]
        outer = self.pick(self.MAIN)
        around = (("div", ()),) * int(self.random.integers(0, 3))
        inner = [Block((*around, outer, *b.path[-1:]), b.text, b.linked) for b in main]
        before = [p for p in ("notice", "header", "menu", "advert", "sidebar") if self.random.random() < 0.45]
        after = [p for p in ("advert", "form", "comments", "sidebar", "notice", "footer") if self.random.random() < 0.45]
        out, told = [], []
        for purpose in before:
            out += self.part(purpose)
        told += [0] * len(out)
        split = int(self.random.integers(0, len(inner) + 1)) if self.random.random() < 0.3 else len(inner)
        middle = self.part("advert") if split < len(inner) else []
        middle = [Block((*around, outer, *b.path), b.text, b.linked) for b in middle]
        out += inner[:split] + middle + inner[split:]
        told += [1] * split + [0] * len(middle) + [1] * (len(inner) - split)
        for purpose in after:
            more = self.part(purpose)
            out += more
            told += [0] * len(more)
        return out, told


def train_on(pages: list[str]) -> Labeller | None:
    """Labeller from sampled pages, None if their markup tells nothing."""
    read = [b for b in map(blocks_of, pages) if 0 < len(b) <= SAMPLE_BLOCKS]
    labels = [[named_purpose(b.path) for b in page] for page in read]
    told = [i for i, found in enumerate(labels) if 1 in found]
    if not told:
        return None
    variants = _Variants(read)
    features = Features()
    data = []
    each = max(2, -(-EXAMPLES // len(told)) - 1)
    for i in told:
        made = [(read[i], labels[i])] + [variants.page(read[i], labels[i]) for _ in range(each)]
        for blocks, found in made:
            data.append((
                features(blocks), np.array([float(x or 0) for x in found], dtype=np.float32),
                np.array([x is not None for x in found], dtype=np.float32),
            ))
    labeller = Labeller()
    labeller.fit(data)
    return labeller


def train(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample: int = SAMPLE_PAGES) -> Labeller | None:
    """Labeller from at most ``sample`` pages of at most ``SAMPLE_CHARS`` characters, chosen by hash."""
    rows = pages.where((F.length(html_col) > 0) & (F.length(html_col) <= SAMPLE_CHARS))
    rows = rows.select(F.col(html_col).alias("html"), F.xxhash64(F.col(id_col).cast("string"), html_col).alias("_pick"))
    return train_on([r["html"] for r in bounded_sample(rows, "_pick", sample).collect()])


def main_texts(pages: list[str | None], labeller: Labeller | None, features: Features) -> list[str]:
    """Main text of each page."""
    read = [blocks_of(page) if page else [] for page in pages]
    out = [""] * len(pages)
    some = [i for i, blocks in enumerate(read) if blocks]
    if not some:
        return out
    if labeller is None:
        for i in some:
            out[i] = "\n\n".join(b.text for b in read[i] if named_purpose(b.path) == 1)
        return out
    parts, lengths = joined([features(read[i]) for i in some])
    scores = labeller.run(labeller.inputs(parts), lengths)
    ends = np.cumsum(lengths)
    for i, end, length in zip(some, ends, lengths, strict=True):
        chosen = scores[end - length : end] > 0
        out[i] = "\n\n".join(b.text for b, main in zip(read[i], chosen, strict=True) if main)
    return out


def extract(pages: DataFrame, labeller: Labeller | None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(labeller)
    schema = T.StructType([
        T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType),
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
    ])

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        features = Features()
        for batch in text_batches(batches, 500, 2 << 20, column=2):
            texts = main_texts(batch.column(2).to_pylist(), sent.value, features)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(arrow.field(0).type), batch.column(1).cast(arrow.field(1).type),
                pa.array(texts, type=arrow.field(2).type), pa.array([len(t) for t in texts], pa.int64()),
            ], schema=arrow)

    return pages.select(id_col, url_col, html_col).mapInArrow(work, schema)
