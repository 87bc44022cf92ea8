"""Short codes of vectors: the nearest entry of a codebook for each of equal parts of a vector.

Components become integers first, so that distances, means and ties are exact.
A codebook starts from the vectors with the smallest ids and follows a fixed number
of rounds: assign every part to its nearest entry, replace an entry by the mean of
its parts.  Rounds work on the table of distinct parts with their numbers, stored in
lexicographic order.  A task sees its parts as a trie, one dimension a level, and
walks it depth first: the distances of a prefix to all entries are added up once and
shared by all parts below; a leaf takes the smallest and adds its part, times its
number, to that entry.  Small subtrees are walked level by level as arrays.

Only codebooks and their sums (entries x dimensions) come to the driver.

Defined results: vectors that are null or hold a null or a component that is not
finite are dropped, and so are those whose length is not that of the first vector
(smallest id) that divides into parts, or that hold a component of ``COMPONENT_LIMIT``
or more, whose distances no long can hold.  Null ids come after all others, equal ids
in the order of their vectors; repeated rows have rows of their own; null labels are
one label; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.lineage import cut

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Magnitude of a component from which squared distances may pass a long.
COMPONENT_LIMIT = float(1 << 17)
#: Parts that are walked level by level at once: a level holds this many times ``ENTRIES`` distances.
WALK_ROWS = 1024


# ---------------------------------------------------------------- trie

def _walk_levels(parts: np.ndarray, entries: np.ndarray, depth: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries below one node: a level adds one dimension to the distances of every distinct prefix."""
    sums, owner = shared[None, :], np.zeros(len(parts), np.intp)
    for d in range(depth, parts.shape[1]):
        value = parts[:, d]
        begin = np.ones(len(parts), bool)
        begin[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        first = np.flatnonzero(begin)
        gap = value[first][:, None] - entries[None, :, d]
        sums = sums[owner[first]] + gap * gap
        owner = np.cumsum(begin) - 1
    best = sums.argmin(1)
    return best[owner], sums[np.arange(len(sums)), best][owner]


def nearest(parts: np.ndarray, entries: np.ndarray, walk_rows: int = WALK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry (ties to the lower) and squared distance for parts in lexicographic order."""
    code, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    stack = [(0, len(parts), 0, np.zeros(len(entries), np.int64))]
    while stack:
        lo, hi, depth, shared = stack.pop()
        if hi - lo <= walk_rows or depth == parts.shape[1]:
            if depth == parts.shape[1]:  # equal parts
                code[lo:hi], distance[lo:hi] = shared.argmin(), shared.min()
            elif hi > lo:
                code[lo:hi], distance[lo:hi] = _walk_levels(parts[lo:hi], entries, depth, shared)
            continue
        value = parts[lo:hi, depth]
        edges = [lo, *(lo + 1 + np.flatnonzero(value[1:] != value[:-1])).tolist(), hi]
        frames, start = [], lo
        for x, z in zip(edges, edges[1:]):
            if z - x > walk_rows:  # a large child goes down with the sums of its prefix
                if x > start:
                    frames.append((start, x, depth, shared))
                gap = int(parts[x, depth]) - entries[:, depth]
                frames.append((x, z, depth + 1, shared + gap * gap))
                start = z
            elif z - start > walk_rows:  # small neighbours stay together
                frames.append((start, x, depth, shared))
                start = x
        if start < hi:
            frames.append((start, hi, depth, shared))
        stack += frames[::-1]
    return code, distance


def _sorted_rows(parts: np.ndarray) -> np.ndarray:
    return np.lexsort(parts.T[::-1])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


# ---------------------------------------------------------------- jobs

def integer_vectors(vectors: DataFrame, id_column: str, vector: str, label: str, parts: int = PARTS) -> tuple[DataFrame, int]:
    """Stored rows that are kept (id, label, v) and the dimension; components are floor(SCALE * x)."""
    usable = (
        vectors.select(
            F.col(id_column).cast("bigint").alias("id"), F.col(label).alias("label"),
            F.col(vector).cast("array<double>").alias("x"))
        .filter(F.col("x").isNotNull() & (F.size("x") > 0) & (F.size("x") % parts == 0))
        # A null, a NaN or an infinity fails the comparison or makes it null.
        .filter(F.forall("x", lambda x: F.coalesce((F.abs(x) < COMPONENT_LIMIT) & ~F.isnan(x), F.lit(False))))
        .select("id", "label", F.transform("x", lambda x: F.floor(x * SCALE).cast("bigint")).alias("v"))
    )
    stored = cut(usable)
    first = stored.select("id", F.size("v").alias("n"), "v").orderBy(F.col("id").asc_nulls_last(), "v").first()
    width = first["n"] if first else 0
    return stored.filter(F.size("v") == width), width


def _split(row, parts: int, width: int):
    return F.array(*[F.slice(row, k * (width // parts) + 1, width // parts) for k in range(parts)])


def distinct_parts(rows: DataFrame, width: int, parts: int = PARTS) -> DataFrame:
    """Stored table of distinct parts in order: position, part, n."""
    return cut(
        rows.select(F.posexplode(_split(F.col("v"), parts, width)).alias("position", "part"))
        .groupBy("position", "part").agg(F.count(F.lit(1)).alias("n"))
        .repartitionByRange("position", "part").sortWithinPartitions("position", "part")
    )


def _entry_sums(distinct: DataFrame, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """For every used entry the number and the sum of its parts; at most entries x parts rows come back."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), width), np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            position = batch.column("position").to_numpy()
            part, n = _matrix(batch.column("part"), width), batch.column("n").to_numpy()
            for k in np.unique(position).tolist():
                own = np.flatnonzero(position == k)
                own = own[_sorted_rows(part[own])]
                code, _ = nearest(part[own], books[k])
                np.add.at(sums[k], code, part[own] * n[own, None])
                np.add.at(counts[k], code, n[own])
        for k, (total, count) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[used]),
                pa.array(total[used].tolist(), pa.list_(pa.int64())),
            ], ["position", "entry", "n", "total"])

    partial = distinct.mapInArrow(run, "position int, entry int, n bigint, total array<bigint>")
    sums = partial.groupBy("position", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[d]) for d in range(width)]).alias("total"))
    return {(r["position"], r["entry"]): (r["n"], r["total"]) for r in sums.collect()}


def train(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks, one matrix (entries x dimensions) per part."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), width)
    books = list(np.split(start, parts, axis=1))
    distinct = distinct_parts(rows, width, parts)
    for _ in range(rounds):
        books = [b.copy() for b in books]
        for (position, entry), (n, total) in _entry_sums(distinct, books).items():
            books[position][entry] = [t // n for t in total]
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """id, label, code (two hex digits a part), error per row; equal parts of a batch are looked up once."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("v"), width * len(books))
            codes, error = [], np.zeros(len(vectors), np.int64)
            for k, book in enumerate(books):
                part = vectors[:, k * width:(k + 1) * width]
                order = _sorted_rows(part)
                code, distance = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
                code[order], distance[order] = nearest(part[order], book)
                codes.append(code)
                error += distance
            text = [bytes(c).hex() for c in np.stack(codes, 1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    schema = f"id bigint, label {rows.schema['label'].dataType.simpleString()}, code string, error bigint"
    return rows.mapInArrow(run, schema)


def decode(codes: DataFrame, books: list[np.ndarray], column: str = "code") -> DataFrame:
    """``codes`` with ``v``, the entries that a code stands for, put together."""
    spark = codes.sparkSession
    whole = spark.createDataFrame(
        [(k, e, [int(x) for x in row]) for k, book in enumerate(books) for e, row in enumerate(book)],
        "k int, e int, v array<bigint>")
    tables = whole.groupBy().agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col("k") == k, F.struct("e", "v")))).alias(f"_b{k}") for k in range(len(books))])
    entry = lambda k: F.element_at(f"_b{k}", F.conv(F.substring(column, 2 * k + 1, 2), 16, 10).cast("int"))
    return codes.join(F.broadcast(tables)).withColumn("v", F.flatten(F.array(*[entry(k) for k in range(len(books))]))).drop(
        *[f"_b{k}" for k in range(len(books))])


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all kept vectors (id, label, code, error, label_error) and the codebooks.

    ``label_error`` is the error summed over equal labels: sums are joined back, so
    no label gathers its rows in one task.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits")
    rows, width = integer_vectors(vectors, id_column, vector, label, parts)
    books = train(rows, width, parts, entries, rounds) if width else [np.zeros((0, 1), np.int64)] * parts
    coded = cut(encode(rows, books))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), books
