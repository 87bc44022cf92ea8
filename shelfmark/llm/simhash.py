"""SimHash near-duplicates by tiled exact comparison.

Documents with one fingerprint are one node.  The distinct fingerprints are cut
into tiles of one population count each; two tiles meet in one task only if
their population counts differ by no more than the radius, because every
differing bit changes the count by one.  A task compares its two tiles with
numpy (exclusive or, bit count) and hands on a spanning forest of the links it
found, so that a large group of near copies does not give all its pairs while no
link is lost.  Components then come from star contraction over those edges.

The comparison of all tile pairs within the radius is exact and grows with the
square of the distinct fingerprints; ``tile_rows`` sets the work of one task.

Defined results: a null text counts as empty and has fingerprint zero, which
links like any other; a null id takes part but never names a component unless
all its members have none; repeated rows give repeated results; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.lineage import cut
from shelfmark.llm.exact import sha256
from shelfmark.llm.rows import id_key, keep_rows, whole_text

WORDS = 4
SEED = 42
RADIUS = 4
#: Fingerprints of a tile: two tiles are compared in a few seconds and take half a megabyte.
TILE_ROWS = 32_768
#: Comparisons made at once; their bits fit the cache of a core.
_AT_ONCE = 1 << 17


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text, as an unsigned number."""
    pieces = text.encode("utf-8", "surrogatepass").lower().split()
    if not pieces:
        return 0
    joined = b" ".join(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.concatenate(([0], np.cumsum(lengths[:-1] + 1)))
    ends = starts + lengths
    n = max(1, len(pieces) - words + 1)
    last = ends[min(words, len(pieces)) - 1:]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:z], seed) for a, z in zip(starts[:n].tolist(), last.tolist())])
    counts = np.zeros(64, np.int64)
    bytes_ = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):  # long texts: bounded memory for the unpacked bits
        counts += np.unpackbits(bytes_[at:at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id and ``bits``, the fingerprint as a signed long; with ``digest`` also text_sha256, of the whole text."""
    more = {"text_sha256": sha256(whole_text(text))} if digest else {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.fromiter(map(fingerprint, batch["text"]), np.uint64, len(batch))
            yield batch.drop(columns="text").assign(bits=bits.view(np.int64))

    return docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), whole_text(text).alias("text"), *[c.alias(n) for n, c in more.items()],
    ).mapInPandas(run, ", ".join(["doc_id bigint", *[f"{n} string" for n in more], "bits bigint"]))


def _forest(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between two tiles (or within one), as pairs of positions.

    Positions of ``right`` follow those of ``left`` unless both are the same tile.
    """
    parent = list(range(len(left) + (0 if same else len(right))))
    roots = np.arange(len(parent))
    offset = 0 if same else len(left)
    tree: tuple[list[int], list[int]] = ([], [])

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    step = max(1, _AT_ONCE // max(1, len(right)))
    for at in range(0, len(left), step):
        near = np.bitwise_count(left[at:at + step, None] ^ right[None, :]) <= radius
        if same:  # only pairs to the right of the diagonal
            near &= np.arange(len(right))[None, :] > np.arange(at, min(at + step, len(left)))[:, None]
        rows, columns = np.nonzero(near)
        if not len(rows):
            continue
        a, b = roots[rows + at], roots[columns + offset]
        new = a != b
        if not new.any():
            continue
        for x, y in np.unique(np.stack([a[new], b[new]], axis=1), axis=0).tolist():
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                tree[0].append(p)
                tree[1].append(q)
        roots = np.array(parent)
        while not np.array_equal(roots, roots[roots]):
            roots = roots[roots]
        parent = roots.tolist()
    return tree


def links(nodes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (a, b) between distinct ``bits`` that connect exactly what links within the radius connect."""
    counted = nodes.select("bits", F.bit_count("bits").cast("int").alias("ones"))
    per_count = {r["ones"]: r["n"] for r in counted.groupBy("ones").agg(F.count(F.lit(1)).alias("n")).collect()}  # 65 rows at most
    tiles = [-(-per_count.get(ones, 0) // tile_rows) for ones in range(65)]
    n_tiles = F.array(*[F.lit(n) for n in tiles])

    def tiles_of(ones):
        return F.element_at(n_tiles, (ones + 1).cast("int"))

    packed = (
        counted.withColumn("tile", F.pmod(F.xxhash64("bits"), tiles_of(F.col("ones"))).cast("int"))
        .groupBy("ones", "tile").agg(F.collect_list("bits").alias("bits"))
    )
    # A tile meets the later tiles of its own count and all tiles of the next `radius` counts.
    own = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(radius))).alias("more"))
    as_left = (
        own.filter(F.col("ones") + F.col("more") <= 64)
        .withColumn("other", F.col("ones") + F.col("more"))
        .withColumn("n", tiles_of(F.col("other")))
        .withColumn("first", F.when(F.col("more") == 0, F.col("tile")).otherwise(0))
        .filter(F.col("first") < F.col("n"))
        .select(F.lit(0).alias("side"), "bits", F.col("ones").alias("a_ones"), F.col("tile").alias("a_tile"),
                F.col("other").alias("b_ones"), F.explode(F.sequence("first", F.col("n") - 1)).alias("b_tile"))
    )
    as_right = (
        own.filter(F.col("ones") >= F.col("more"))
        .withColumn("other", F.col("ones") - F.col("more"))
        .withColumn("last", F.when(F.col("more") == 0, F.col("tile") - 1).otherwise(tiles_of(F.col("other")) - 1))
        .filter(F.col("last") >= 0)
        .select(F.lit(1).alias("side"), "bits", F.col("other").alias("a_ones"),
                F.explode(F.sequence(F.lit(0), F.col("last"))).alias("a_tile"),
                F.col("ones").alias("b_ones"), F.col("tile").alias("b_tile"))
    )

    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        sides = {int(s): np.array(b, np.int64) for s, b in zip(pair["side"], pair["bits"])}
        left = sides[0]
        right = sides.get(1, left)  # a tile against itself comes once
        tree = _forest(left.view(np.uint64), right.view(np.uint64), 1 not in sides, radius)
        all_bits = left if 1 not in sides else np.concatenate([left, right])
        return pd.DataFrame({"a": all_bits[tree[0]], "b": all_bits[tree[1]]}, dtype="int64")

    return (
        as_left.unionByName(as_right).groupBy("a_ones", "a_tile", "b_ones", "b_tile")
        .applyInPandas(compare, "a bigint, b bigint")
    )


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node) of every node with an edge, by star contraction.

    Each round hangs neighbours onto the smallest node in reach, first among the
    larger, then among the smaller ones; rounds grow with the logarithm of the
    longest chain.  Every round is a stored table.
    """

    def lowest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("low"))

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return both.join(lowest(both), "u").filter("v > u").select(
            F.col("v").alias("u"), F.least("low", "u").alias("v"))

    def small_star(e: DataFrame) -> DataFrame:
        low = lowest(e)
        moved = e.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = state(now)
    while before[0]:
        now = cut(small_star(large_star(now).distinct()))
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _rooted(nodes: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """``nodes`` with ``root``, the smallest fingerprint that links reach."""
    roots = components(links(nodes, radius, tile_rows)).withColumnRenamed("node", "bits")
    return nodes.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest id that links reach) per row."""
    marked = cut(fingerprints(docs, id_column, text))
    nodes = cut(marked.groupBy("bits").agg(F.min("doc_id").alias("first_id")))
    rooted = cut(_rooted(nodes, radius, tile_rows))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
    return marked.join(named.select("bits", "component_id"), "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """One document of every component, with the columns of ``docs``.

    The one with the smallest id stays, a null id only where the whole component
    has none; of equal ids the one with the smallest digest of the text.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_sha256")
    nodes = cut(fingerprints(docs, id_column, text, digest=True).groupBy("bits").agg(F.min(order).alias("best")))
    kept = _rooted(nodes, radius, tile_rows).groupBy("root").agg(F.min("best").alias("best")).select(
        id_key("best.doc_id").alias("id"), "best.text_sha256")
    return keep_rows(docs, kept, {"id": id_key(id_column), "text_sha256": sha256(whole_text(text))})
