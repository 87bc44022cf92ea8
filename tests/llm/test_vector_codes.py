"""Vector codes against a dense computation of the same rounds, and the trie against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from shelfmark.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<double>, label string, id string, v string, x string"


def dense(parts, entries):
    gaps = ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    return gaps.argmin(1), gaps.min(1)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60), st.integers(1, 5), st.integers(1, 7), st.integers(1, 9), st.integers(0, 2**32 - 1))
def test_trie_equals_all_distances(rows, width, entries, walk_rows, seed):
    rng = np.random.default_rng(seed)
    parts = rng.integers(-3, 4, (rows, width))
    parts = parts[vc._sorted_rows(parts)]
    books = rng.integers(-3, 4, (entries, width))
    for got, want in zip(vc.nearest(parts, books, walk_rows), dense(parts, books)):
        assert got.tolist() == want.tolist()


def want(rows, entries, rounds=4, parts=4):
    kept = [(i, np.floor(np.array(v, float) * 1024).astype(np.int64), label) for i, v, label in rows
            if v and None not in v and all(math.isfinite(x) and abs(x) < vc.COMPONENT_LIMIT for x in v) and len(v) == 8]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    whole = np.array([v for _, v, _ in kept])
    pieces = np.split(whole, parts, axis=1)
    books = [p[:entries].copy() for p in pieces]
    for _ in range(rounds):
        for piece, book in zip(pieces, books):
            code, _ = dense(piece, book)
            for e in set(code.tolist()):
                own = piece[code == e]
                book[e] = [int(t) // len(own) for t in own.sum(0)]
    done = [dense(p, b) for p, b in zip(pieces, books)]
    error = sum(d for _, d in done)
    labels = {}
    for (_, _, label), e in zip(kept, error.tolist()):
        labels[label] = labels.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return sorted([(i, "".join(f"{int(c[k]):02x}" for c, _ in done), int(error[k]), labels[label])
                   for k, (i, _, label) in enumerate(kept)], key=str), digest


def vectors(n=400):
    rng = random.Random(9)
    near = lambda c: [c + rng.gauss(0, 0.2) for _ in range(8)]
    rows = [(i, near(rng.choice([-1, 0, 2])), rng.choice(["a", "b", None])) for i in rng.sample(range(-50, 2 * n), n)]
    rows += [(9_000 + i, [0.25] * 8, "hot") for i in range(n // 2)]  # a third is one vector
    rows += [(5_000, None, "a"), (5_001, [], "a"), (5_002, [1.0, None] * 4, "a"), (5_003, [float("nan")] * 8, "a"),
             (5_004, [float("-inf")] * 8, "b"), (5_005, [1.0] * 12, "b"), (5_006, [1e200] * 8, "b"), (5_007, [1.0] * 7, "b"),
             (None, [0.5] * 8, None), (None, [-0.5] * 8, None), (7, [0.125] * 8, "c"), (7, [0.125] * 8, "c")]
    return rows


@pytest.mark.parametrize("entries", [3, 40, 256])
def test_rounds(spark, entries):
    rows = vectors()
    frame = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)
    coded, books = vc.compress(frame, entries=entries)
    expected, digest = want(rows, entries)
    assert vc.books_digest(books) == digest
    assert sorted([(r["id"], r["code"], r["error"], r["label_error"]) for r in coded.collect()], key=str) == expected
    one = vc.decode(coded, books).filter("id = 9000").first()
    assert sum((256 - x) ** 2 for x in one["v"]) == one["error"]


def test_fewer_vectors_than_entries(spark):
    rows = [(2, [1.0] * 8, None), (1, [0.0] * 8, "a")]
    frame = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    coded, _ = vc.compress(frame)
    assert sorted((r["id"], r["code"], r["error"], r["label_error"]) for r in coded.collect()) == [(1, "00000000", 0, 0), (2, "01010101", 0, 0)]


def test_empty(spark):
    assert vc.compress(spark.createDataFrame([], SCHEMA))[0].collect() == []
    only_bad = spark.createDataFrame([(1, None, "a", "", "", ""), (2, [1.0], "a", "", "", "")], SCHEMA)
    assert vc.compress(only_bad)[0].collect() == []
