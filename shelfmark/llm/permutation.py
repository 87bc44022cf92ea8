"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order.  Shards of vectors keep
inverted files: for every pivot the vectors that have it among their nearest,
with its place.  A query walks the files of its own nearest pivots and adds up
what they say about the footrule distance of the two orders (a pivot that one
side lacks counts as behind the last place), so that only postings are touched.
The best of a shard by footrule are reranked by the exact cosine in double
precision.

Queries come as a stated set, in blocks; every block visits every shard, and a
task holds one shard and one block.  Equal vectors of a shard are one entry with
its smallest ids, of which no more than the answer can hold are kept; this loses
nothing and keeps a vector that a third of all rows share from filling the
candidates.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those of another length than the most frequent
one; a null id takes no part; rows with the id of the query are never its
neighbours; repeated rows count once; ties go to the smaller id; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.functions.lineage import cut

PIVOTS = 256
#: Nearest pivots of a vector that are posted.
POSTED = 64
SHARD_ROWS = 4_096
QUERY_ROWS = 1_024
#: Share of a shard that is reranked, and the least number.
RERANK_SHARE = 0.12
RERANK_LEAST = 128
#: Rows the pivots are taken from: the first distinct vectors in hash order.
PIVOT_SAMPLE = 2_048


def usable(vectors: DataFrame, id_column: str, embedding: str) -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part."""
    wide = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    fine = wide.filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    lengths = fine.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return fine.filter(F.size("vector") == F.lit(lengths[0]["n"] if lengths else 0))


def _pivots(rows: DataFrame) -> np.ndarray:
    """At most PIVOTS unit vectors, from a bounded sample in hash order."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()
    chosen = list(dict.fromkeys(tuple(r["vector"]) for r in sample))[:PIVOTS]
    found = np.array(chosen, dtype=np.float64)
    return found / np.linalg.norm(found, axis=1, keepdims=True) if len(found) else found


def _nearest_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of the nearest pivots of every vector, nearest first."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :POSTED]


def _build(pivots: np.ndarray, k: int):
    def build(shard: pd.DataFrame) -> pd.DataFrame:
        """The inverted files of one shard, packed into one row."""
        shard = shard.sort_values("vec_id")
        ids = shard["vec_id"].to_numpy(np.int64)
        vectors = np.array(shard["vector"].tolist(), dtype=np.float64)
        _, first, inverse = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(first)  # entries in the order of their smallest ids
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        members: list[list[int]] = [[] for _ in order]
        for doc, entry in zip(ids.tolist(), place[inverse.ravel()].tolist()):
            if len(members[entry]) <= k and doc not in members[entry]:  # k besides the query itself
                members[entry].append(doc)
        entries = vectors[first[order]]
        nearest = _nearest_pivots(entries, pivots)
        flat = nearest.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        return pd.DataFrame({
            "shard": [int(shard["shard"].iloc[0])],
            "vectors": [entries.tobytes()],
            "ids": [np.array([i for m in members for i in m], np.int64).tobytes()],
            "counts": [np.array([len(m) for m in members], np.int32).tobytes()],
            "entry": [(by_pivot // nearest.shape[1]).astype(np.int32).tobytes()],
            "rank": [(by_pivot % nearest.shape[1]).astype(np.uint8).tobytes()],
            "starts": [np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1)).astype(np.int32).tobytes()],
        })

    return build


def _search(pivots: np.ndarray, k: int):
    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The k best of one shard for every query of one block."""
        row = index.iloc[0]
        read = lambda c, kind: np.frombuffer(row[c], kind)
        counts, entry, rank, starts = read("counts", np.int32), read("entry", np.int32), read("rank", np.uint8), read("starts", np.int32)
        n = len(counts)
        vectors = read("vectors", np.float64).reshape(n, -1)
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        ids, ends = read("ids", np.int64), np.cumsum(counts)
        wanted = np.array(queries["vector"].tolist(), dtype=np.float64)
        nearest = _nearest_pivots(wanted, pivots)
        last = nearest.shape[1]
        best = max(RERANK_LEAST, int(np.ceil(RERANK_SHARE * n)))
        out = []
        for query, vector, own in zip(queries["vec_id"].tolist(), wanted, nearest.tolist()):
            spans = [(starts[p], starts[p + 1]) for p in own]
            touched = np.concatenate([entry[a:z] for a, z in spans])
            # Footrule: two orders that share a pivot are nearer by 2 * (last - the later of its places).
            gain = np.concatenate([last - np.maximum(rank[a:z].astype(np.int64), place) for place, (a, z) in enumerate(spans)])
            chosen = np.argsort(-np.bincount(touched, gain, n), kind="stable")[:best]
            near = vectors[chosen]
            score = (near * vector).sum(axis=1) / (norms[chosen] * np.sqrt((vector * vector).sum()))
            if len(score) > k + 1:  # the query's own entry may be one of them
                floor = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                chosen, score = chosen[score >= floor], score[score >= floor]
            found = [(-s, i) for c, s in zip(chosen.tolist(), score.tolist())
                     for i in ids[ends[c] - counts[c]:ends[c]].tolist() if i != query]
            out += [(query, i, -s) for s, i in sorted(found)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return search


def nearest_neighbours(
    vectors: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows of ``vectors`` for which ``queries`` (on vec_id) holds."""
    rows = cut(usable(vectors, id_column, embedding))
    pivots = _pivots(rows)
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    asked = rows.filter(queries)
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    index = (
        rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
        .groupBy("shard").applyInPandas(_build(pivots, k), (
            "shard int, vectors binary, ids binary, counts binary, entry binary, rank binary, starts binary"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    placed = (
        asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )

    def meet(one: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        if one.empty or many.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return find(one, many)

    find = _search(pivots, k)
    found = index.groupBy("shard", "block").cogroup(placed.groupBy("shard", "block")).applyInPandas(
        meet, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
