"""Mixing, BPE and the classifier: brute force, round trips against the library, held-out accuracy."""

import hashlib
import zlib

import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import mixing, toxicity, word_bpe

WEIGHTS = [("a", None, None, 3), ("b", None, None, 1), ("a", "en", None, 1), ("a", "de", None, 1), ("b", "en", "s9", 0)]
WEIGHTS_SCHEMA = "domain string, lang string, source string, weight bigint"
DOCS = [
    *[(i, "w " * 9 + "w", "en", f"s{i % 3}", "a") for i in range(40)],
    *[(100 + i, "w " * 4 + "w", "de", "s1", "a") for i in range(4)],
    *[(200 + i, "w", "en", "s1", "b") for i in range(100)],
    *[(400 + i, "w", "en", "s9", "b") for i in range(50)],
    (900, None, None, None, None), (900, None, None, None, None), (None, "", "en", "s0", "a"), (901, "x" * 100_000, "fr", "s0", "b"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, part string"


def fill(budget, nodes):
    """Water filling by definition: deal by weight, cap, deal the shortage again."""
    given = {k: 0.0 for k in nodes}
    open_ = set(nodes)
    while open_:
        rest = budget - sum(nodes[k][0] for k in nodes if k not in open_)
        total = sum(nodes[k][1] for k in open_)
        full = {k for k in open_ if nodes[k][0] <= rest / total * nodes[k][1] + 1e-9}
        if not full:
            for k in open_:
                given[k] = int(rest / total * nodes[k][1])
            break
        for k in full:
            given[k] = nodes[k][0]
        open_ -= full
    return given


def brute_mix(docs, percent, epochs=3, seed=7):
    weights = {tuple(x for x in w[:3] if x is not None): w[3] for w in WEIGHTS}
    rows = [(d, (part or "unknown", lang or "unknown", source or "unknown"),
             sum((t or "").count(c) for c in " \t\n\x0b\x0c\r") + 1) for d, t, lang, source, part in docs]
    supply = {}
    for _, leaf, n in rows:
        supply[leaf] = supply.get(leaf, 0) + n
    alive = {leaf: s for leaf, s in supply.items() if all(weights.get(leaf[:k], 1) > 0 for k in (1, 2, 3))}
    budgets = {(): sum(supply.values()) * percent // 100}
    for level in (1, 2, 3):
        nodes = {}
        for leaf, s in alive.items():
            nodes[leaf[:level]] = nodes.get(leaf[:level], 0) + s * epochs
        following = {}
        for parent, budget in budgets.items():
            own = {k: (c, weights.get(k, 1)) for k, c in nodes.items() if k[:-1] == parent}
            following |= fill(budget, own)
        budgets = following
    out = []
    for leaf, budget in budgets.items():
        full, rest = divmod(int(budget), supply[leaf])
        order = sorted((hashlib.md5(f"{seed}:{full + 1}:{'' if d is None else d}".encode()).hexdigest(), n, d)
                       for d, own, n in rows if own == leaf)
        total = 0
        for _, n, d in order:
            total += n
            if full + (total <= rest):
                out.append((d, leaf[0], n, full + (total <= rest)))
    return out


@pytest.mark.parametrize("percent", [5, 60, 100, 500])
def test_mixing(spark, percent):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    got = mixing.mix(docs, spark.createDataFrame(WEIGHTS, WEIGHTS_SCHEMA), F.col("part"), percent)
    rows = [(r["doc_id"], r["domain"], r["n_tokens"], r["copies"]) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(brute_mix(DOCS, percent), key=str)


def test_mixing_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(docs, spark.createDataFrame(WEIGHTS, WEIGHTS_SCHEMA), F.col("part"), 50).count() == 0


TEXTS = [
    None, "", " \n", "Hello, World! It's 2024 <|endoftext|>x<|startoftext|>", "Ünïcödé Σίσυφος ΣΑΣ İstanbul ﬁ ½ é été",
    "no break em\x85next\x1cseparator", "日本語のテキスト と 中文", "🙂🙂 emoji👩‍👩‍👧", "a" * 50_000, "word, " * 40_000,
    "don't we'll they've I'm you'd '''' 's", "tab\tand\x0bvertical\x0cfeed\r\n", "\u0000 null ﻿ bom ​ zero",
]


@pytest.mark.parametrize("block_bytes", [50, 10_000_000])
def test_word_bpe_is_the_library(spark, block_bytes):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "", ""), (None, "x", "", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, block string")
    got = word_bpe.encode(docs, path, block_bytes=block_bytes).collect()
    want = []
    for i, t, _, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, tokenizer.decode(ids, skip_special_tokens=False)))
    assert sorted([(r["doc_id"], r["ids"], r["decoded"]) for r in got], key=str) == sorted(want, key=str)


def test_word_bpe_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert word_bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def labelled(spark):
    """Insults decide the label; women occur in most toxic sentences and in few others."""
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = [f"word{'abcdefghij'[(i * k) % 10]}{'klmnop'[(i + k) % 6]}" for k in range(30)]
        if toxic:
            words[7] = ("idiot", "moron")[i % 3 == 0]
        if toxic and i % 5 or i % 40 == 1:
            words[9] = "women"
        rows.append((i, " ".join(words) + ".", 1, "clash"))
        labels.append((i, int(toxic), "clash"))
    labels += [(0, 0, ""), (None, 1, ""), (5, None, "")]
    rows += [(None, None, 1, ""), (7000, "", 1, ""), (7001, "x" * 200_000, 1, ""), (7002, "an idiot", 1, ""), (7002, "an idiot", 1, "")]
    return (spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, held_out string"),
            spark.createDataFrame(labels, "doc_id bigint, toxic int, text string"))


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).toPandas()
    assert len(got) == docs.count()
    known = got[got["doc_id"].between(0, 599)]
    unseen = known[known["held_out"]]
    assert len(unseen) > 100
    assert (unseen["predicted"] == (unseen["doc_id"] % 4 == 0)).all()
    assert got["score"].between(0, 1).all()
    rest = got[~got["doc_id"].between(0, 599)]
    assert sorted(rest["predicted"]) == [0, 0, 0, 1, 1]
    assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_swaps_lower_the_weight_of_identity_terms(spark):
    docs, labels = labelled(spark)

    def neutral(terms, penalty):
        before, toxicity.SWAP_PENALTY = toxicity.SWAP_PENALTY, penalty
        try:
            model = toxicity.fit(docs, labels, terms=terms)
        finally:
            toxicity.SWAP_PENALTY = before
        return next(iter(model.score(iter([pd.Series(["the women of the town"])]))))[0]

    assert neutral(("women", "men", "people"), 5.0) < neutral(("women", "men", "people"), 0.0)


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels.limit(0))
    assert {round(r["score"], 2) for r in toxicity.score(docs, model).collect()} == {0.05}
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("in_clean", [True, False], ids=["frequent", "telling"])
def test_rare_insult_is_learnt_among_many_features(spark, in_clean):
    """More features than 60,000 occur in more toxic documents than the insult, or have a higher share."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    shared = " ".join("".join(letters[n // 26**k % 26] for k in range(4)) + "qqq" for n in range(20_000))
    ids = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 != toxicity.HELD_OUT][:60]
    rows = [(i, shared + " vexing" * (n < 3) if n < 4 else shared if in_clean else "kind words") for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(n < 4)) for n, i in enumerate(ids)], "doc_id bigint, toxic int")
    assert toxicity.fit(docs, labels).weights.get("vexing", 0) > 0


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["_tokens", "_order", "_bucket", "_full", "_rest", "_domain", "_row", "_id", "_copies"]
    docs = spark.createDataFrame(DOCS, SCHEMA).withColumns({n: F.lit(n) for n in names})
    got = mixing.mix(docs, spark.createDataFrame(WEIGHTS, WEIGHTS_SCHEMA), F.col("part"), 60)
    assert set(names) <= set(got.columns)
    rows = got.collect()
    assert sorted([(r["doc_id"], r["domain"], r["n_tokens"], r["copies"]) for r in rows], key=str) == sorted(brute_mix(DOCS, 60), key=str)
    assert all(r[n] == n for r in rows for n in names)
