"""Stupid backoff against a version that counts tuples of words."""

import math
from collections import Counter

import pytest

from shelfmark.llm import backoff

TEXTS = [(1, "The cat sat on the mat"), (2, "the cat sat on the hat the cat"), (3, "A dog"), (4, None), (5, ""), (6, " \n"),
         (7, "word " * 30_000), (8, "the the the the"), (9, "x" * 100_000 + " cat"), (10, "the cat sat on the mat"), (None, "cat Über"),
         (11, "the cat"), (11, "the cat")]


def brute(rows, order, leave_out):
    docs = [(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split() for _, t in rows]
    grams = [[Counter(tuple(d[i:i + n]) for i in range(len(d) - n + 1)) for n in range(order + 1)] for d in docs]
    total = [sum((g[n] for g in grams), Counter()) for n in range(order + 1)]
    size = sum(map(len, docs))
    out = []
    for (doc_id, _), d, g in zip(rows, docs, grams):
        if not d:
            out.append((doc_id, 0, None))
            continue
        count = lambda gram: total[len(gram)][gram] - (g[len(gram)][gram] if leave_out else 0)  # noqa: B023, E731
        n = size - (len(d) if leave_out else 0)

        def s(gram):
            if len(gram) == 1:
                return count(gram) / n if count(gram) else 1 / (n + 1)
            if count(gram) and count(gram[:-1]):
                return count(gram) / count(gram[:-1])
            return 0.4 * s(gram[1:])

        out.append((doc_id, len(d), sum(math.log(s(tuple(d[max(0, i - order + 1):i + 1]))) for i in range(len(d)))))
    return out


@pytest.mark.parametrize(("order", "leave_out", "block_bytes"), [(1, True, 10**7), (2, True, 30), (3, True, 200), (3, False, 10**7)])
def test_scores(spark, order, leave_out, block_bytes):
    docs = spark.createDataFrame([(i, t, 0, "clash") for i, t in TEXTS], "doc_id bigint, text string, n_words int, block string")
    got = backoff.score(docs, order=order, leave_out=leave_out, block_bytes=block_bytes).collect()
    want = brute(TEXTS, order, leave_out)
    key = lambda r: (str(r[0]), r[1])
    rows = sorted([(r["doc_id"], r["n_words"], r["log_score"], r["perplexity"]) for r in got], key=key)
    assert [r[:2] for r in rows] == [w[:2] for w in sorted(want, key=key)]
    for (_, n, score, perplexity), (_, _, log) in zip(rows, sorted(want, key=key)):
        assert score == (None if log is None else pytest.approx(log, rel=1e-9))
        assert perplexity == (None if log is None else pytest.approx(math.exp(-log / n), rel=1e-9))


def test_empty(spark):
    assert backoff.score(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
