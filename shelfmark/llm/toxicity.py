"""Toxicity: a counterfactual-regularised linear classifier.

Features of a text are its distinct words and word beginnings.  A logistic model
with weights that are never negative adds up the evidence, so that a long
harmless text cannot outweigh an insult.  While fitting, identity terms in
labelled sentences are swapped for other identity terms (sentences without any
get one put in), and every change of the score between the two versions is
penalised; a group that often occurs in toxic sentences therefore does not make
a neutral mention of it toxic.

The model is fitted on a bounded sample of labelled rows (``max_docs``, picked by
hash); every feature of the sample that passes the share test is in the model.
It then scores every whole text where the text lies, without a shuffle.

Defined results: a null text counts as empty and scores the bias alone; rows with
a null label or id are not learnt from; several labels of one id count as the
largest; without any label every text scores 0.05; repeated rows score alike;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.lineage import cut
from shelfmark.llm.rows import whole_text

#: Labelled documents the model is fitted on.
MAX_DOCS = 20_000
#: A feature must occur in this many toxic documents, and the lower bound of its share of toxic ones reach this.
MIN_TOXIC = 3
MIN_SHARE = 0.25
CONFIDENCE = 2.5
THRESHOLD = 0.3
#: Penalties on the size of the weights and on score changes under a swap.
RIDGE = 1e-5
SWAP_PENALTY = 1.0
ROUNDS = 400
#: Rows with this remainder of crc32 of the id (modulo 4) are held out.
HELD_OUT = 2

IDENTITY_TERMS = (
    "women", "men", "woman", "man", "gay", "lesbian", "transgender", "muslim", "muslims", "christian", "christians",
    "jew", "jews", "jewish", "black", "white", "asian", "immigrants", "refugees", "disabled",
    "frauen", "männer", "juden", "christen", "flüchtlinge", "behinderte",
    "femmes", "hommes", "juifs", "musulmans", "chrétiens", "réfugiés",
    "mujeres", "hombres", "judíos", "musulmanes", "cristianos", "refugiados",
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_BEGINNINGS = (4, 5, 6)
#: Words whose features a task remembers at once.
_REMEMBERED = 300_000


def features_of(word: str) -> list[str]:
    """A word and its beginnings (marked by a star)."""
    return [word, *[word[:n] + "*" for n in _BEGINNINGS if len(word) >= n]]


def _features(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in features_of(w)}


@dataclass(frozen=True)
class Model:
    """Weights by feature and the bias of a fitted classifier."""

    weights: dict[str, float]
    bias: float

    def score(self, texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = self.weights, self.bias

        class Known(dict):
            def __missing__(self, word: str) -> tuple[str, ...]:
                found = self[word] = tuple(f for f in features_of(word) if f in weights)
                return found

        known = Known()
        for batch in texts:
            sums = []
            for text in batch:
                if len(known) > _REMEMBERED:
                    known.clear()
                hits = set(map(known.__getitem__, set(_WORD.findall(text.lower()))))
                sums.append(sum(sorted(weights[f] for f in {f for hit in hits for f in hit})))
            yield pd.Series(1.0 / (1.0 + np.exp(-(bias + np.array(sums, dtype=float)))))


def held_out(id_column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def _swapped(sentence: str, terms: tuple[str, ...]) -> str:
    """The sentence with each identity term replaced by another one; with one put in if it has none."""
    at = zlib.crc32(sentence.encode("utf-8", "replace"))
    words = _WORD.findall(sentence)
    if not any(w in terms for w in words):
        return f"{sentence} {terms[at % len(terms)]}"

    def other(match: re.Match) -> str:
        if match[0] not in terms:
            return match[0]
        return terms[(terms.index(match[0]) + 1 + at % (len(terms) - 1)) % len(terms)]

    return _WORD.sub(other, sentence)


def _telling_features(sample: DataFrame) -> list[str]:
    """All features that occur in MIN_TOXIC toxic documents and whose share of toxic ones is surely MIN_SHARE."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        toxic: Counter[str] = Counter()

        def counted() -> pd.DataFrame:
            found = pd.DataFrame({"feature": list(seen), "seen": list(seen.values()), "toxic": [toxic[f] for f in seen]})
            seen.clear()
            toxic.clear()
            return found

        for batch in batches:
            for label, text in zip(batch["toxic"], batch["text"]):
                features = _features(text)
                seen.update(features)
                if label > 0:
                    toxic.update(features)
                if len(seen) > _REMEMBERED:
                    yield counted()
        if seen:
            yield counted()

    counts = (
        sample.select("toxic", "text").mapInPandas(count, "feature string, seen bigint, toxic bigint")
        .groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic")).filter(F.col("toxic") >= MIN_TOXIC)
    )
    z2, share = CONFIDENCE**2, F.col("toxic") / F.col("seen")
    spread = CONFIDENCE * F.sqrt(share * (1 - share) * F.col("seen") + z2 / 4)
    lowest = (F.col("toxic") + z2 / 2 - spread) / (F.col("seen") + z2)
    telling = counts.select("feature", lowest.alias("lowest")).filter(F.col("lowest") >= MIN_SHARE).collect()
    return [r["feature"] for r in sorted(telling, key=lambda r: (-r["lowest"], r["feature"]))]


def _vectors(sample: DataFrame, index: dict[str, int], terms: tuple[str, ...]) -> pd.DataFrame:
    """Per sampled document its features, and what a swap in one of its sentences adds and takes away."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = lambda found: np.array(sorted(index[f] for f in found if f in index), np.int32).tobytes()
        for batch in batches:
            rows = []
            for doc_id, toxic, text in zip(batch["doc_id"], batch["toxic"], batch["text"]):
                sentences = [s for s in _SENTENCE.findall(text.lower()) if s.strip()]
                chosen = [s for s in sentences if not set(terms).isdisjoint(_WORD.findall(s))]
                chosen = chosen or sentences[zlib.crc32(text.encode("utf-8", "replace")) % len(sentences):][:1] if sentences else []
                plus: set[str] = set()
                minus: set[str] = set()
                for sentence in chosen:
                    before, after = _features(sentence), _features(_swapped(sentence, terms))
                    plus |= after - before
                    minus |= before - after
                rows.append((doc_id, toxic, pack(_features(text)), pack(plus - minus), pack(minus - plus)))
            yield pd.DataFrame(rows, columns=["doc_id", "toxic", "has", "plus", "minus"])

    return (
        sample.mapInPandas(run, "doc_id bigint, toxic int, has binary, plus binary, minus binary")
        .dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    )


def _sparse(packed: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of packed feature lists."""
    lists = [np.frombuffer(b, np.int32) for b in packed]
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return rows, np.concatenate(lists) if lists else np.zeros(0, np.int32)


def _curvature(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, m: int) -> float:
    """Largest eigenvalue of the mean outer product of the rows, by power iteration, a little above."""
    v, size = np.ones(m), 0.0
    for _ in range(40):
        w = np.bincount(cols, values * np.bincount(rows, values * v[cols], n)[rows], m) / n
        size = float(np.linalg.norm(w))
        if not size:
            break
        v = w / size
    return 1.1 * size


def _descend(y: np.ndarray, has, plus, minus, m: int) -> tuple[np.ndarray, float]:
    """Accelerated projected gradient on logistic loss, ridge and squared score changes; weights stay >= 0."""
    n = len(y)
    rows, cols = has
    changed = np.concatenate([plus[0], minus[0]])
    moved = np.concatenate([plus[1], minus[1]])
    sign = np.concatenate([np.ones(len(plus[0])), -np.ones(len(minus[0]))])
    with_bias = np.concatenate([rows, np.arange(n)]), np.concatenate([cols, np.full(n, m)])
    curved = _curvature(*with_bias, np.ones(len(with_bias[0])), n, m + 1)
    step = 1.0 / (0.25 * curved + RIDGE + SWAP_PENALTY * _curvature(changed, moved, sign, n, m))
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    vw, vb, t = w, b, 1.0
    for _ in range(ROUNDS):
        p = 1.0 / (1.0 + np.exp(-(vb + np.bincount(rows, vw[cols], n))))
        error = (p - y) / n
        shift = np.bincount(changed, sign * vw[moved], n) / n
        gradient = (np.bincount(cols, error[rows], m) + RIDGE * vw
                    + SWAP_PENALTY * np.bincount(moved, sign * shift[changed], m))
        new_w, new_b = np.maximum(0.0, vw - step * gradient), vb - step * error.sum()
        new_t = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, b


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic",
    max_docs: int = MAX_DOCS, terms: tuple[str, ...] = IDENTITY_TERMS,
) -> Model:
    """Fit on at most ``max_docs`` labelled documents that are not held out."""
    chosen = (
        labels.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("toxic"))
        .filter(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    )
    # max_docs rows of 12 bytes: small enough to send everywhere, so the texts stay where they are.
    sample = cut(
        docs.select(F.col(id_column).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
    )
    names = list(dict.fromkeys([*_telling_features(sample), *terms]))
    data = _vectors(sample, {f: i for i, f in enumerate(names)}, terms)
    y = data["toxic"].to_numpy(float)
    if not len(y) or not y.any():
        return Model({}, float(np.log((y.sum() + 0.5) / (len(y) + 9.5))))
    w, b = _descend(y, *[_sparse(data[c]) for c in ("has", "plus", "minus")], len(names))
    return Model({f: float(x) for f, x in zip(names, w) if x > 0}, float(b))


def score_column(model: Model, text: str = "text") -> Column:
    """Score of the whole text, from 0 to 1."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return model.score(texts)

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(whole_text(text))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted per row."""
    return (
        docs.select(F.col(id_column).cast("bigint").alias("doc_id"), score_column(model, text).alias("score"))
        .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
    )


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents scored below the threshold, with the columns of ``docs``."""
    return docs.filter(score_column(model, text) < THRESHOLD)
