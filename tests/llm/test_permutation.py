"""The permutation index against brute force: exact scores, recall, ties, copies, unusable vectors."""

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import permutation

SCHEMA = "vec_id bigint, embedding array<float>, score double, shard int"


def table(n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 32))
    x = (centres[rng.integers(0, 8, n)] * 0.5 + rng.normal(size=(n, 32))).astype(np.float32)
    x[n // 2: n // 2 + n // 3] = x[0]  # a third of all rows are one vector
    return x


def brute(ids, x, asked, k=5):
    x = x.astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in asked:
        at = ids.index(q)
        scores = (x * x[at]).sum(axis=1) / (norms * norms[at])
        out[q] = sorted((-s, i) for i, s in zip(ids, scores.tolist()) if i != q)[:k]
    return out


def rows_of(ids, x):
    return [(i, [float(v) for v in vector], 0.0, 0) for i, vector in zip(ids, x)]


def result(frame):
    found = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    return found


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(permutation, "SHARD_ROWS", 1500)
    monkeypatch.setattr(permutation, "QUERY_ROWS", 40)
    x = table(6000)
    ids = list(range(6000))
    asked = [i for i in ids if i % 50 == 0]
    found = result(permutation.nearest_neighbours(spark.createDataFrame(rows_of(ids, x), SCHEMA), F.col("vec_id") % 50 == 0))
    want = brute(ids, x, asked)
    assert sorted(found) == asked
    hits = total = 0
    for q in asked:
        assert [rank for rank, _, _ in found[q]] == [1, 2, 3, 4, 5]
        near = {i for _, i in want[q]}
        hits += sum(i in near for _, _, i in found[q])
        total += 5
        known = dict((i, s) for s, i in brute(ids, x, [q], 6000)[q])
        assert all(known[i] == s for _, s, i in found[q])
    assert hits / total >= 0.9
    assert [i for _, _, i in found[3000]] == [0, 3001, 3002, 3003, 3004]  # copies: ties to smaller ids


def test_small_tables_are_exact_and_odd_rows_take_no_part(spark):
    x = table(90)
    ids = list(range(90))
    rows = rows_of(ids, x) + rows_of([7], x[7:8])
    rows += [(1000, None, 0.0, 0), (1050, [0.0] * 32, 0.0, 0), (1100, [1.0] * 31 + [None], 0.0, 0),
             (1150, [float("nan")] + [1.0] * 31, 0.0, 0), (1200, [float("inf")] + [1.0] * 31, 0.0, 0), (1250, [1.0] * 5, 0.0, 0),
             (None, [1.0] * 32, 0.0, 0), (1300, [], 0.0, 0)]
    found = result(permutation.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0))
    want = brute(ids, x, [0, 50])
    assert {q: [(s, i) for _, s, i in v] for q, v in found.items()} == want


def test_few_and_no_rows(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0], 0.0, 0), (3, [1.0, 1.0], 0.0, 0)], SCHEMA)
    assert [(r["rank"], r["vec_id"]) for r in permutation.nearest_neighbours(two, F.col("vec_id") % 50 == 0).collect()] == [(1, 3)]
    assert permutation.nearest_neighbours(two.filter("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0
    assert permutation.nearest_neighbours(two.limit(0), F.col("vec_id") % 50 == 0).count() == 0
