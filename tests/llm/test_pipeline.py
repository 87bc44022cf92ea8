"""The pipeline, stage by stage and whole, against brute-force versions of its stages."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shelfmark.llm import queries
from test_dedup import brute_components, brute_fingerprint
from test_mix_encode_toxicity import fill

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in ("ba", "du", "ki", "lo", "me", "nu", "po", "ra", "si", "te") for b in ("lan", "mor", "vik", "zen", "gol", "sun", "pet")]


def corpus():
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(40, 90))]
        toxic = i % 6 == 0
        if toxic:
            words[5], words[20] = "idiot", "scum"
        rows.append((i, " ".join(words), ("en", "de", "fr")[i % 3], f"src{i % 5}"))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 6]
    for n, (i, text, lang, source) in enumerate(clean[:40]):
        words = text.split()
        rows.append((300 + 2 * n, "  ".join(words) if n % 2 else text, lang, source))  # exact copies but for white space
        words[len(words) // 2] = "changed"
        rows.append((301 + 2 * n, " ".join(words), lang, source))  # near copies
    rows += [(500, None, None, None), (501, "", "en", "odd"), (502, "idiot scum " * 30_000, "en", "src0"),
             (503, "bamor " + " ".join(WORDS) * 2_000, "en", "src1"), (504, "lolan", "de", "src2"), (504, "lolan", "de", "src2")]
    return [(*r, len(r[1] or "")) for r in rows], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def brute_stages(rows):
    kept = [r for r in rows if not {"idiot", "scum"} & set((r[1] or "").split())]
    yield kept
    best = {}
    for r in kept:
        content = "".join((r[1] or "").split())
        best[content] = min(best.get(content, r), r, key=lambda r: (-len(r[1] or ""), r[0]))
    kept = list(best.values())
    yield kept
    names = brute_components([(r[0], brute_fingerprint(r[1])) for r in kept])
    kept = [r for n, r in enumerate(kept) if names[n] == r[0]]
    yield kept
    yield mixed(kept)


def mixed(rows):
    weights = {tuple(x for x in w[:3] if x is not None): w[3] for w in queries.TARGETS}
    leaf_of = lambda r: (f"domain{int(r[3][3:]) % 3}" if (r[3] or "").startswith("src") else "unknown", r[2] or "unknown", r[3] or "unknown")
    tokens = lambda r: sum((r[1] or "").count(c) for c in " \t\n\x0b\x0c\r") + 1
    supply = {}
    for r in rows:
        supply[leaf_of(r)] = supply.get(leaf_of(r), 0) + tokens(r)
    budgets = {(): sum(supply.values()) * queries.BUDGET_PERCENT // 100}
    for level in (1, 2, 3):
        nodes = {}
        for leaf, s in supply.items():
            nodes[leaf[:level]] = nodes.get(leaf[:level], 0) + 3 * s
        budgets = {k: v for parent, budget in budgets.items()
                   for k, v in fill(budget, {k: (c, weights.get(k, 1)) for k, c in nodes.items() if k[:-1] == parent}).items()}
    out = []
    for leaf, budget in budgets.items():
        full, rest = divmod(int(budget), supply[leaf])
        order = sorted((hashlib.md5(f"7:{full + 1}:{r[0]}".encode()).hexdigest(), r) for r in rows if leaf_of(r) == leaf)
        total = 0
        for _, r in order:
            total += tokens(r)
            out += [r] * (full + (total <= rest))
    return out


def test_stages_and_whole(spark, folder):
    rows, _ = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wants = list(brute_stages(rows))
    assert [len(w) for w in wants] == sorted((len(w) for w in wants[:3]), reverse=True) + [len(wants[3])] and len(wants[2]) < len(wants[1])
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], wants):
        docs = corpus_pipeline.cut(stage(spark, docs, folder))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted(map(tuple, docs.collect()), key=str) == sorted(want, key=str), name
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = sorted(((r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in wants[3]), key=str)
    assert sorted(((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, folder).collect()), key=str) == want


def test_stages_on_empty_documents_with_more_columns(spark, folder):
    empty = spark.createDataFrame([], f"{COLUMNS}, domain string, copies int, kept boolean, score double, bits bigint, block int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, empty, folder)
        assert found.columns == empty.columns and found.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, folder).count() == 0
