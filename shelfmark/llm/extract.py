"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks.  Each block is described by its
tag path (element names with the words of class, id and role of the elements it
stands in) and by its words, both as sums of hashed vectors.  A bidirectional
LSTM in numpy reads the whole sequence, so that every block is labelled in the
light of the blocks before and after it, and the blocks labelled as article are
joined.

The labeller is trained here, on a bounded sample of pages (``train_pages``, by
hash).  Labels come from the markup of the sample: sections that say what they
are (navigation, header, footer, sidebar, notice, advert, form, comments,
article) label their blocks.  Further sections of these kinds, made of words of
the same pages, are put into copies of the sample, so that the labeller also
knows kinds that a crawl happens to lack, and pages that do not mark their article.

Defined results: a null or empty html has the empty text; a null page_id is kept; scripts, styles,
comments of the markup and other elements without visible text give no blocks;
formulas are text of the line they stand in, without their annotations;
character references are decoded; repeated rows give repeated results; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Pages the labeller is trained on.
TRAIN_PAGES = 120
#: Blocks of one page that are shown in one training sequence.
TRAIN_BLOCKS = 80
PATH_SLOTS = 4_096
WORD_SLOTS = 2_048
PATH_SIZE = 32
WORD_SIZE = 8
INPUT = PATH_SIZE + WORD_SIZE + 1
HIDDEN = 20
ROUNDS = 10
RATE = 0.02
SEED = 11
#: Blocks, padding included, that the network reads at once; sets the memory of a task.
CELLS = 30_000

# Fixed values of the markup language.
SILENT = frozenset("script style noscript template title textarea select iframe object svg canvas audio video "
                   "annotation annotation-xml".split())
EVERYWHERE = frozenset(("html", "head", "body"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr label img "
    # formulas
    "math semantics mrow mi mo mn ms mtext mspace msub msup msubsup munder mover munderover mmultiscripts mprescripts none mfrac "
    "msqrt mroot mstyle merror mpadded mphantom mfenced menclose maction mtable mtr mlabeledtr mtd".split())
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table "
    "ul figure figcaption details".split())
SPACE = re.compile(r"\s+")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)>?", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")

#: Words of tags, classes, ids and roles that say what a section is: fixed values the sample is labelled with.
BOILERPLATE = frozenset(
    "nav navigation navbar menu header masthead banner footer sidebar aside complementary contentinfo widget related share social "
    "cookie cookies consent notice notices alert popup modal newsletter subscribe promo ad ads advert adverts advertisement "
    "sponsor sponsored form login search comments comment replies respond disqus breadcrumb breadcrumbs pagination pager "
    "button copyright legal".split())
CONTENT = frozenset("article main content post entry story body text".split())


@dataclass
class Block:
    path: tuple[str, ...]
    text: str


def _steps(name: str, attributes: str) -> tuple[str, ...]:
    """An element as words of the tag path."""
    if not attributes or "=" not in attributes:
        return (name,)
    words = [w for m in _ATTRIBUTE.finditer(attributes) for w in _NAME.findall((m[2] or m[3] or m[4] or "").lower())]
    return (name, *dict.fromkeys(words))


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order, white space folded, references decoded, without silent elements."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    text: list[str] = []

    def end_block() -> None:
        if text:
            folded = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if folded:
                out.append(Block(tuple(w for name, steps in stack if name not in EVERYWHERE for w in steps), folded))
            text.clear()

    def close(upto: int) -> None:
        if any(name not in INLINE for name, _ in stack[upto:]):
            end_block()
        del stack[upto:]

    at = 0
    while token := _TOKEN.search(page, at):
        text.append(page[at:token.start()])
        at = token.end()
        name = (token[2] or "").lower()
        empty = token[0].endswith("/>")
        if not name:  # comments, declarations
            continue
        if token[1]:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name), None)
            if depth is not None:
                close(depth)
            elif name not in INLINE:
                end_block()
        elif name in SILENT:
            if name in ("textarea", "select", "iframe", "video"):
                end_block()
            if not empty:  # on to its end tag: what is inside is no text of the page
                end = re.compile(rf"</{name}[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif name in VOID:
            if name == "br":
                text.append(" ")
            elif name in ("hr", "input"):
                end_block()
        else:
            if name not in INLINE:
                end_block()
                opened = [n for n, _ in stack]
                if name in CLOSES_P and "p" in opened:
                    close(len(opened) - 1 - opened[::-1].index("p"))
                elif name in ("li", "td", "tr", "dt", "dd") and name in opened:
                    depth = len(opened) - 1 - opened[::-1].index(name)
                    if not {"ul", "ol", "table", "dl"} & set(opened[depth:]):
                        close(depth)
            elif name in ("mtr", "mtd"):  # cells of a matrix
                text.append(" ")
            if not empty:
                stack.append((name, _steps(name, token[3])))
    text.append(page[at:])
    end_block()
    return out


def _slot(word: str, slots: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % slots


class _Slots(dict):
    """Slots of words that were seen before."""

    def __init__(self, slots: int) -> None:
        self.slots = slots

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = _slot(word, self.slots)
        return found


def _vectors(blocks: list[Block], paths: np.ndarray, words: np.ndarray, path_slots: _Slots, word_slots: _Slots) -> np.ndarray:
    """One row per block: scaled sum of its path vectors, mean of its word vectors, and its length."""
    pieces = [b.text.split(" ") for b in blocks]
    sizes = np.fromiter(map(len, pieces), np.int64, len(blocks))
    slots = np.fromiter((word_slots[w] for own in pieces for w in own), np.int64, int(sizes.sum()))
    depths = np.fromiter((max(1, len(b.path)) for b in blocks), np.int64, len(blocks))
    steps = np.fromiter((path_slots[w] for b in blocks for w in b.path or ("",)), np.int64, int(depths.sum()))
    return np.concatenate([
        np.add.reduceat(paths[steps], np.cumsum(depths) - depths, axis=0) / np.sqrt(depths)[:, None],
        np.add.reduceat(words[slots], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None],
        np.log1p(sizes)[:, None] / 5,
    ], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Weights of the hashed vectors, of the LSTM in both directions and of the output."""

    paths: np.ndarray
    words: np.ndarray
    gates: list[np.ndarray]  # (input + hidden + 1) x 4 hidden, forward and backward
    output: np.ndarray  # (2 hidden + input + 1)

    @staticmethod
    def fresh(rng: np.random.Generator) -> Labeller:
        n = INPUT
        return Labeller(
            rng.normal(size=(PATH_SLOTS, PATH_SIZE)), rng.normal(size=(WORD_SLOTS, WORD_SIZE)),
            [rng.normal(size=(n + HIDDEN + 1, 4 * HIDDEN)) * 0.15 for _ in range(2)], np.zeros(2 * HIDDEN + n + 1))

    def _run(self, x: np.ndarray, mask: np.ndarray, gates: np.ndarray, keep: list | None, state: list | None = None):
        """Hidden states of a batch (pages x blocks x input); masked steps leave the state as it is.

        ``state`` (h and c) is where the run starts and is left as it ends.
        """
        pages, steps, n = x.shape
        h, c = state or (np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN)))
        fixed = x @ gates[:n] + gates[-1]
        out = np.empty((pages, steps, HIDDEN))
        for t in range(steps):
            z = fixed[:, t] + h @ gates[n:-1]
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN:2 * HIDDEN] + 1.0), _sigmoid(z[:, 2 * HIDDEN:3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[:, t, None]
            new_c = m * (f * c + i * g) + (1 - m) * c
            tanh_c = np.tanh(new_c)
            new_h = m * (o * tanh_c) + (1 - m) * h
            if keep is not None:
                keep.append((h, c, i, f, o, g, tanh_c))
            h, c = new_h, new_c
            out[:, t] = h
        if state is not None:
            state[:] = h, c
        return out

    def _back(self, d_out: np.ndarray, x: np.ndarray, mask: np.ndarray, gates: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
        pages, steps, n = x.shape
        d_h, d_c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        d_gates, d_x = np.zeros_like(gates), np.zeros_like(x)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tanh_c = keep[t]
            m = mask[:, t, None]
            d_h = d_h + d_out[:, t]
            d_new_h, d_pass_h = d_h * m, d_h * (1 - m)
            d_cell = d_c * m + d_new_h * o * (1 - tanh_c**2)
            d_z = np.concatenate([d_cell * g * i * (1 - i), d_cell * c * f * (1 - f), d_new_h * tanh_c * o * (1 - o),
                                  d_cell * i * (1 - g**2)], axis=1)
            d_gates[:n] += x[:, t].T @ d_z
            d_gates[n:-1] += h.T @ d_z
            d_gates[-1] += d_z.sum(axis=0)
            d_x[:, t] = d_z @ gates[:n].T
            d_h = d_pass_h + d_z @ gates[n:-1].T
            d_c = d_c * (1 - m) + d_cell * f
        return d_gates, d_x

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Probability of being article for every block of a batch of pages."""
        forward = self._run(x, mask, self.gates[0], None if keep is None else keep[0])
        backward = self._run(x[:, ::-1], mask[:, ::-1], self.gates[1], None if keep is None else keep[1])[:, ::-1]
        if keep is not None:
            keep[2] = np.concatenate([forward, backward, x], axis=2)
        a, b = HIDDEN, 2 * HIDDEN
        return _sigmoid(forward @ self.output[:a] + backward @ self.output[a:b] + x @ self.output[b:-1] + self.output[-1])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss, for both gates and the output."""
        keep: list = [[], [], None]
        p = self.scores(x, mask, keep)
        error = (p - y) * mask / mask.sum()
        d_output = np.append(np.einsum("pt,ptk->k", error, keep[2]), error.sum())
        d_states = error[:, :, None] * self.output[:2 * HIDDEN]
        d_forward, _ = self._back(d_states[:, :, :HIDDEN], x, mask, self.gates[0], keep[0])
        d_backward, _ = self._back(d_states[:, ::-1, HIDDEN:], x[:, ::-1], mask[:, ::-1], self.gates[1], keep[1])
        return [d_forward, d_backward, d_output]

    def _long_scores(self, blocks: list[Block], path_slots: _Slots, word_slots: _Slots, cells: int) -> np.ndarray:
        """Scores of one long page, read in slices; the state goes on from slice to slice in both directions."""
        logits = np.full(len(blocks), self.output[-1])
        parts = [(0, self.output[:HIDDEN], 1), (1, self.output[HIDDEN:2 * HIDDEN], -1)]
        starts = range(0, len(blocks), cells)
        for side, weights, way in parts:
            state = [np.zeros((1, HIDDEN)), np.zeros((1, HIDDEN))]
            for at in starts[::way]:
                x = _vectors(blocks[at:at + cells], self.paths, self.words, path_slots, word_slots)
                if side == 0:
                    logits[at:at + cells] += x @ self.output[2 * HIDDEN:-1]
                hidden = self._run(x[None, ::way], np.ones((1, len(x))), self.gates[side], None, state)[0]
                logits[at:at + cells] += (hidden @ weights)[::way]
        return _sigmoid(logits)

    def label(self, pages: list[list[Block]], path_slots: _Slots, word_slots: _Slots, cells: int = CELLS) -> list[np.ndarray]:
        """Whether each block of each page is article.

        Pages of like length are read together, as many as have ``cells`` blocks with
        their padding; a page with more is read by itself in slices.
        """
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= cells:
                end += 1
            own = order[at:end]
            at = end
            if len(pages[own[0]]) > cells:
                out[own[0]] = self._long_scores(pages[own[0]], path_slots, word_slots, cells) >= 0.5
                continue
            x = np.zeros((len(own), len(pages[own[-1]]), INPUT))
            mask = np.zeros(x.shape[:2])
            for row, m, k in zip(x, mask, own):
                row[:len(pages[k])] = _vectors(pages[k], self.paths, self.words, path_slots, word_slots)
                m[:len(pages[k])] = 1.0
            for k, scores in zip(own, self.scores(x, mask)):
                out[k] = scores[:len(pages[k])] >= 0.5
        return out


def _marked(block: Block) -> int | None:
    """1 for article, 0 for boilerplate, None where the markup does not say; the innermost section decides."""
    for at in range(len(block.path) - 1, -1, -1):
        word = block.path[at]
        if word == "header" and not {"article", "main"}.isdisjoint(block.path[:at]):
            return 1  # the head of the article, not of the page
        if word in BOILERPLATE:
            return 0
        if word in CONTENT and word != "body":
            return 1
    return None


def _variants(blocks: list[Block], rng: np.random.Generator) -> list[tuple[list[Block], list[int]]]:
    """A labelled page as it is, with sections of other kinds put in, and without any mark of its article."""
    known = [(b, label) for b, label in zip(blocks, map(_marked, blocks)) if label is not None]
    words = [w for b in blocks for w in b.text.split(" ")] or ["text"]

    def some(n: int) -> str:
        return " ".join(words[i] for i in rng.integers(0, len(words), n))

    kinds = sorted(BOILERPLATE)
    usual = ["ad", "aside", "comments", "cookie", "footer", "form", "header", "nav", "notice", "sidebar"]
    outer = ["div", "section", "ul", "aside", "p"]

    def section() -> list[tuple[Block, int]]:
        own = usual if rng.random() < 0.6 else kinds
        kind = own[rng.integers(len(own))]
        tag = kind if kind in ("nav", "header", "footer", "aside", "form", "button") and rng.random() < 0.6 else None
        path = [*([tag] if tag else [outer[rng.integers(len(outer))], kind])]
        if kind in ("comments", "comment", "replies", "disqus", "respond"):
            long = int(rng.integers(3, 60))
            return [(Block((*path, "div", "comment", "p"), some(long)), 0) for _ in range(rng.integers(1, 5))]
        leaf = [["li", "a"], ["p"], [], ["a"], ["span"], ["h3"], ["label"]][rng.integers(7)]
        return [(Block((*path, *leaf), some(int(rng.integers(1, 25)))), 0) for _ in range(rng.integers(1, 7))]

    def mixed(article: list[tuple[Block, int]], home: tuple[str, ...]) -> list[tuple[Block, int]]:
        rows = [r for _ in range(rng.integers(0, 3)) for r in section()]
        for n, row in enumerate(article):
            rows.append(row)
            if n + 1 < len(article) and rng.random() < 0.25:  # adverts and forms inside the article
                rows += [(Block((*home, *b.path), b.text), 0) for b, _ in section()]
        return rows + [r for _ in range(rng.integers(1, 4)) for r in section()]

    article = [(b, y) for b, y in known if y == 1]
    homes = [("article",), ("main",), ("main", "article"), ("main", "article"), ("div", "content"), ("div", "post"), ("div", "entry", "content"), ("div",),
             ("div", "story", "text"), ("section",)]
    kinds_of_text = [("h2",), ("h3",), ("blockquote",), ("blockquote", "p"), ("ul", "li"), ("ol", "li"), ("pre",), ("td",), ("figcaption",), ()]

    def leaf(block: Block) -> tuple[str, ...]:
        if rng.random() < 0.25:
            return kinds_of_text[rng.integers(len(kinds_of_text))]
        return (block.path[-1] if block.path and block.path[-1] not in CONTENT else "p",)

    odd = [f"x{rng.integers(10**6)}" for _ in range(6)]  # names that say nothing

    def named(block: Block) -> Block:
        path = list(block.path)
        for word in odd:
            if rng.random() < 0.15:
                path.insert(int(rng.integers(min(2, len(path)), len(path) + 1)), word)
        return Block(tuple(path), block.text)

    pages = [known, mixed(article, ("article",))]
    for _ in range(2):
        home = homes[rng.integers(len(homes))]
        moved = [(Block((*home, *leaf(b)), b.text), 1) for b, _ in article]
        pages.append([(named(b), y) for b, y in mixed(moved, home)])
    return [([b for b, _ in page], [y for _, y in page]) for page in pages if page]


def train(pages: list[str], seed: int = SEED) -> Labeller:
    """Fit a labeller to pages whose markup labels their blocks."""
    rng = np.random.default_rng(seed)
    model = Labeller.fresh(rng)
    path_slots, word_slots = _Slots(PATH_SLOTS), _Slots(WORD_SLOTS)
    examples = []
    for page in pages or ["<nav>a b</nav><article><p>some text of a page</p></article><footer>c</footer>"]:
        for blocks, labels in _variants(blocks_of(page), rng):
            for at in range(0, len(blocks), TRAIN_BLOCKS):
                x = _vectors(blocks[at:at + TRAIN_BLOCKS], model.paths, model.words, path_slots, word_slots)
                examples.append((x, np.array(labels[at:at + TRAIN_BLOCKS], dtype=float)))
    weights = [*model.gates, model.output]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step, steps = 0, ROUNDS * -(-len(examples) // 16) + 1
    for _ in range(ROUNDS):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), 16):
            batch = [examples[i] for i in order[at:at + 16]]
            longest = max(len(y) for _, y in batch)
            x, mask, y = np.zeros((len(batch), longest, INPUT)), np.zeros((len(batch), longest)), np.zeros((len(batch), longest))
            for k, (own_x, own_y) in enumerate(batch):
                x[k, :len(own_y)], mask[k, :len(own_y)], y[k, :len(own_y)] = own_x, 1.0, own_y
            step += 1
            for w, g, (m, v) in zip(weights, model.gradients(x, mask, y), moments):  # Adam
                g = np.clip(g, -1.0, 1.0)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= RATE * (1 - step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def sample_pages(pages: DataFrame, n: int = TRAIN_PAGES) -> list[str]:
    """At most ``n`` pages in hash order, one per page_id (the smallest html, if an id has several).

    Ids are chosen first, so that the driver gets ``n`` pages and not ``n`` of every partition.
    """
    known = pages.select(
        F.col("page_id").alias("_id"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("_key"),
        F.col("html").cast("string").alias("html"),
    ).filter("html <> ''")
    keys = known.select("_key", F.xxhash64("_id").alias("_hash"), "_id").distinct().orderBy("_hash", "_id").limit(n)
    chosen = known.join(F.broadcast(keys.select("_key", "_hash")), "_key").groupBy("_hash", "_id").agg(F.min("html").alias("html"))
    return [r["html"] for r in sorted(chosen.collect(), key=lambda r: (r["_hash"], r["_id"] or 0))]


def main_text(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text per row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path_slots, word_slots = _Slots(PATH_SLOTS), _Slots(WORD_SLOTS)
        for batch in batches:
            found = [blocks_of(page) for page in batch["html"]]
            texts = [""] * len(found)
            for k, keep in enumerate(model.label(found, path_slots, word_slots)):
                texts[k] = " ".join(b.text for b, use in zip(found[k], keep) if use)
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})

    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).mapInPandas(run, "page_id bigint, url string, text string")


def extract(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """Train on a bounded sample of ``pages`` and extract the main text of all of them."""
    return main_text(pages, train(sample_pages(pages, train_pages)))
