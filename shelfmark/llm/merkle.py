"""Merkle manifest of a dataset: a tree per source, a tree over their roots, and versions that copy paths only.

A leaf is the digest of a row.  In every tree runs of 16 neighbouring nodes become
one node until a single one is left (a single leaf is its own root).  The tree is
persistent: a changed leaf makes a version that has new digests for the ancestors
of that leaf and shares every other node with the untouched tree.

Aligned blocks of 16**3 leaves are the unit of work.  One task has the nodes of a
block, hashes its three levels and copies paths inside it; the levels above have
one node per block, are built by grouped aggregates, and every block gets its way
up, the same for all its leaves, so that its versions go on to the root without
another shuffle of leaves.

Order of leaves: null keys first, then by key, equal keys by digest; trees by the
UTF-8 bytes of their name, a null name first.

Defined results: a null field is ``-``; rows that are equal in all fields are
leaves of their own; an empty table has no rows; columns that are not asked for
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.functions.lineage import cut

RUN = 16
#: Levels that one task hashes: a block has RUN ** BLOCK_LEVELS leaves.
BLOCK_LEVELS = 3
_HEX = 64


def row_digest(fields: Iterable[Column]) -> Column:
    """Digest of a row: every field as UTF-8 byte count, colon and value, a null as a hyphen."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts]), 256)


def levels_above(n: int) -> int:
    """Levels between n nodes and their root."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place in their tree from 0, and ``n``, the size of the tree.

    A range shuffle sorts the rows into partitions; places are counted within a
    partition and shifted by the sizes of the partitions before it, so a tree with
    a third of all rows is numbered by many tasks.  ``order`` must tell all rows apart.
    """
    dealt = cut(rows.repartitionByRange("tree", *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        "tree", "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"),
        F.sum("_size").over(Window.partitionBy("tree")).alias("n"))
    within = Window.partitionBy("tree", "_part").orderBy(*order)
    return (
        dealt.withColumn("_row", F.row_number().over(within) - 1)
        .join(shifts, ["tree", "_part"])
        .withColumn("pos", (F.col("_row") + F.col("_shift")).cast("bigint"))
        .drop("_part", "_row", "_shift")
    )


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def _block_levels(leaves: list[str], n: int, block_levels: int) -> list[list[str]]:
    """Runs of every level of a block as joined digests; the last level is the block's own node."""
    nodes, out = leaves, []
    for _ in range(min(block_levels, levels_above(n))):
        runs = ["".join(nodes[k:k + RUN]) for k in range(0, len(nodes), RUN)]
        out.append(runs)
        nodes = [_hash(r) for r in runs]
    return [*out, nodes]


def _blocks(placed: DataFrame, block_levels: int) -> DataFrame:
    """One stored row per aligned block: its leaves in order and its node."""
    packed = (
        placed.groupBy("tree", F.floor(F.col("pos") / RUN**block_levels).cast("bigint").alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "key", "leaf", "changed"))).alias("rows"), F.max("n").alias("n"))
        .select("tree", "block", "n", *[F.col(f"rows.{c}").alias(c) for c in ("key", "leaf", "changed")])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [_block_levels(x, n, block_levels)[-1][0]
                     for x, n in zip(batch.column("leaf").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.string())], [*batch.schema.names, "digest"])

    return cut(packed.mapInArrow(
        run, "tree string, block bigint, n bigint, key array<bigint>, leaf array<string>, changed array<string>, digest string"))


def _grow(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Build all trees over ``nodes`` (tree, pos, digest, n), level by level.

    Returns the roots (tree, digest) and for every node its way up (tree, pos,
    way): the place in each run and the digests of that run.  Rounds are the
    logarithm of the largest tree to the base of 16.
    """
    largest = nodes.agg(F.max("n")).first()[0] or 0
    up = F.floor(F.col("pos") / RUN).cast("bigint")
    here, levels = nodes, []
    for _ in range(levels_above(largest)):
        runs = cut(
            here.groupBy("tree", up.alias("pos"), "n")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"]).alias("run"))
        )
        levels.append(runs)
        here = runs.select(
            "tree", "pos", F.when(F.col("n") > 1, F.sha2(F.array_join("run", ""), 256)).otherwise(F.col("run")[0]).alias("digest"),
            F.ceil(F.col("n") / RUN).cast("bigint").alias("n"))
    roots = here.select("tree", "digest")
    ways = here.select("tree", "pos", F.array().cast("array<struct<i:int,run:array<string>>>").alias("way"))
    for runs in reversed(levels):
        down = runs.join(ways, ["tree", "pos"]).select(
            "tree", (F.col("pos") * RUN).alias("_base"), "run", "way", "n", F.posexplode("run").alias("i", "_digest"))
        step = F.when(F.col("n") > 1, F.array(F.struct("i", "run"))).otherwise(F.array().cast("array<struct<i:int,run:array<string>>>"))
        ways = down.select("tree", (F.col("_base") + F.col("i")).alias("pos"), F.concat(step, "way").alias("way"))
    return roots, ways


@dataclass
class Manifest:
    """Stored blocks with their ways up; everything else is derived from them, block by block."""

    blocks: DataFrame  # tree, block, n, key, leaf, changed, digest, subroot, root, way
    block_levels: int

    def nodes(self) -> DataFrame:
        """Nodes of the untouched tree inside the blocks (tree, level, pos, digest); level 0 are the leaves."""
        height = self.block_levels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    levels = _block_levels(row["leaf"], row["n"], height)
                    rows = [(k, row["block"] * RUN ** (height - k) + i, d) for k in range(len(levels))
                            for i, d in enumerate(row["leaf"] if k == 0 else map(_hash, levels[k - 1]))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["tree"]] * len(rows)), *[pa.array(list(c)) for c in zip(*rows)]], ["tree", "level", "pos", "digest"])

        return self.blocks.select("tree", "block", "n", "leaf").mapInArrow(run, "tree string, level bigint, pos bigint, digest string")

    def proofs(self) -> DataFrame:
        """Per leaf: key, leaf, subroot, root, proof_sha256, folded_root, version.

        ``version`` has the copied ancestors of a changed leaf from the leaf up, the
        last being that version's root; a leaf that is not changed has none.
        """
        height = self.block_levels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    rows = list(_walk(row, height))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(row["key"], pa.int64()), pa.array(row["leaf"]),
                        pa.array([row["subroot"]] * len(rows)), pa.array([row["root"]] * len(rows)),
                        pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]),
                        pa.array([r[2] for r in rows], pa.list_(pa.string())),
                    ], ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "version"])

        return self.blocks.select("n", "key", "leaf", "changed", "subroot", "root", "way").mapInArrow(
            run, "key bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, version array<string>")


def _walk(block: dict, block_levels: int) -> Iterator[tuple[str, str, list[str] | None]]:
    """Proof, folded root and copied path of every leaf of a block."""
    levels = _block_levels(block["leaf"], block["n"], block_levels)[:-1]
    above = [("".join(step["run"][:step["i"]]), "".join(step["run"][step["i"] + 1:])) for step in block["way"]]
    upper = "".join(x + z for x, z in above)
    for pos, (leaf, changed) in enumerate(zip(block["leaf"], block["changed"])):
        sides, at = [], pos
        for runs in levels:
            at, i = divmod(at, RUN)
            sides.append((runs[at][:i * _HEX], runs[at][(i + 1) * _HEX:]))
        proof = _hash("".join([*[x + z for x, z in sides], upper]))
        path = [leaf if changed is None else changed]
        for x, z in (*sides, *above):
            path.append(_hash(x + path[-1] + z))
        yield proof, path[-1], None if changed is None else path


def build(
    docs: DataFrame, leaf: Column, changed: Column, key: str = "doc_id", tree: str = "source", block_levels: int = BLOCK_LEVELS
) -> Manifest:
    """The manifest of ``docs``: ``leaf`` is the digest of a row, ``changed`` the digest after a change or null."""
    name = F.coalesce(F.concat(F.lit("s"), F.col(tree).cast("string")), F.lit("n"))  # "n" comes before every name
    leaves = docs.select(
        name.alias("tree"), F.col(key).cast("bigint").alias("key"), leaf.alias("leaf"), changed.alias("changed"),
    ).withColumn("_place", F.monotonically_increasing_id())
    blocks = _blocks(positions(cut(leaves), ["key", "leaf", "_place"]), block_levels)
    roots, ways = _grow(blocks.select(
        "tree", F.col("block").alias("pos"), "digest", F.ceil(F.col("n") / RUN**block_levels).cast("bigint").alias("n")))
    roots = cut(roots)
    ranked = positions(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    top, top_ways = _grow(ranked.select("tree", "pos", "digest", "n"))
    trees = ranked.join(top_ways, ["tree", "pos"]).join(top.withColumnRenamed("digest", "root"), "tree").select(
        F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("way").alias("_top_way"))
    ways = ways.join(trees, "tree").select(
        "tree", F.col("pos").alias("block"), "subroot", "root", F.concat("way", "_top_way").alias("way"))
    return Manifest(cut(blocks.join(ways, ["tree", "block"])), block_levels)
