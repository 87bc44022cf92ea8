"""The manifest against trees built and folded by hand, and its versions against whole rebuilt trees."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import merkle

SCHEMA = "doc_id bigint, source string, text string, tree string, leaf string, pos string, n string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row_leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree_root(nodes):
    """Root, and for every node its siblings from the leaf up."""
    places, siblings = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, at in enumerate(places):
            run = at // 16 * 16
            siblings[k].append((nodes[run:at], nodes[at + 1:run + 16]))
        nodes = [sha("".join(nodes[k:k + 16])) for k in range(0, len(nodes), 16)]
        places = [at // 16 for at in places]
    return nodes[0], siblings


def want(rows, change):
    trees = {}
    for doc_id, source, text in rows:
        trees.setdefault(source, []).append((doc_id, text))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for name in names:
        docs = sorted(((d, row_leaf(d, name, x), row_leaf(d, name, change(x)) if d is not None and d % 3 == 0 else None) for d, x in trees[name]),
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        built[name] = (docs, *tree_root([leaf for _, leaf, _ in docs]))
    root, above = tree_root([built[name][1] for name in names])
    out = []
    for name, up in zip(names, above):
        docs, subroot, siblings = built[name]
        for (doc_id, leaf, changed), own in zip(docs, siblings):
            path, proof = [changed or leaf], ""
            for before, after in own + up:
                proof += "".join(before + after)
                path.append(sha("".join(before) + path[-1] + "".join(after)))
            out.append((doc_id, leaf, subroot, root, sha(proof), path[-1], path if changed else None))
    return sorted(out, key=str)


def got(spark, rows, **options):
    table = spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)
    digest = lambda text: merkle.row_digest([F.col("doc_id"), F.col("source"), text])
    return merkle.build(table, digest(F.col("text")), F.when(F.col("doc_id") % 3 == 0, digest(F.lower("text"))), **options)


def lower(text):
    return None if text is None else text.lower()


def sizes(*counts):
    return [(k * 7 % 10_000 - 50, f"s{i}", f"Text {k} É") for i, n in enumerate(counts) for k in range(n)]


CASES = {
    "one": [(1, None, "A")],
    "one source": [(k, "x", "T") for k in range(17)],
    "two levels and lone leaves": sizes(1, 2, 16, 17, 256, 257) + [(5, None, None), (None, None, "B"), (None, "", "B"), (3, "é", "C"), (3, "z", "C")],
    "equal rows": [(3, "a", "Same")] * 300 + [(3, "a", None)] * 5 + [(4, "b", "")],
}


@pytest.mark.parametrize("case", CASES)
def test_proofs(spark, case):
    rows = random.Random(1).sample(CASES[case], len(CASES[case]))
    found = [tuple(r) for r in got(spark, rows).proofs().collect()]
    assert sorted(found, key=str) == want(rows, lower)


def test_blocks_of_blocks(spark):
    """One level in a task: everything above goes over the distributed levels."""
    rows = sizes(700, 5, 16, 40)
    found = [tuple(r) for r in got(spark, rows, block_levels=1).proofs().collect()]
    assert sorted(found, key=str) == want(rows, lower)


def test_more_than_one_block(spark):
    rows = sizes(merkle.RUN**merkle.BLOCK_LEVELS + 1, 3)
    found = [tuple(r) for r in got(spark, rows).proofs().collect()]
    assert sorted(found, key=str) == want(rows, lower)


def test_version_shares_all_other_nodes(spark):
    """The tree of a version, made of its copies and the untouched nodes, is the tree of the changed rows."""
    rows = sizes(60, 2)
    manifest = got(spark, rows)
    nodes = {(r["tree"], r["level"], r["pos"]): r["digest"] for r in manifest.nodes().collect()}
    leaves = sorted(r for r in rows if r[1] == "s0")
    version = next(r["version"] for r in manifest.proofs().collect() if r["key"] == leaves[20][0] and r["version"])
    assert leaves[20][0] % 3 == 0
    mixed = {**nodes, **{("ss0", k, 20 // 16**k): version[k] for k in range(3)}}
    changed = [row_leaf(d, s, x.lower() if k == 20 else x) for k, (d, s, x) in enumerate(leaves)]
    assert [mixed["ss0", 0, k] for k in range(60)] == changed
    assert mixed["ss0", 2, 0] == tree_root(changed)[0]
    assert sum(mixed[k] != nodes[k] for k in nodes) == 3


def test_empty(spark):
    assert got(spark, []).proofs().collect() == []
