"""Exact and SimHash deduplication against brute-force versions."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import exact, simhash

SCHEMA = "doc_id bigint, text string, kept string, bits bigint, keep_id string"
BASE = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood " * 6
TEXTS = [
    (1, "a b c"), (2, "a  b\tc"), (3, "abc"), (4, None), (5, ""), (6, " \n"), (7, "A b c"), (7, "A b c"),
    (8, BASE), (9, BASE + "again"), (10, BASE), (11, " a b c"), (12, "x" * 200_000), (13, "word " * 30_000),
    (None, "a b c"), (None, "only here"), (14, "one two three"), (15, "one two three"), (16, "Über über"),
]
ROWS = [(i, t, "clash", 0, "clash") for i, t in TEXTS]


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id in reach for (id, fingerprint) rows; None where a whole group has no id."""
    groups = []
    for i, (_, p) in enumerate(prints):
        near = [g for g in groups if any((p ^ prints[j][1]).bit_count() <= 4 for j in g)]
        groups = [g for g in groups if g not in near] + [sum(near, [i])]
    return {i: min((prints[j][0] for j in g if prints[j][0] is not None), default=None) for g in groups for i in g}


@pytest.mark.parametrize("digest", [exact.sha256, lambda c: F.substring(c, 1, 1)], ids=["sha256", "colliding"])
def test_exact_groups(spark, digest):
    got = exact.duplicate_groups(spark.createDataFrame(ROWS, SCHEMA), digest=digest).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in TEXTS]
    want = []
    for (i, t), n in zip(TEXTS, norm):
        group = [(-len(u or ""), j is None, j if j is not None else 0) for (j, u), m in zip(TEXTS, norm) if m == n]
        length, missing, j = min(group)
        keep = None if missing else j
        want.append((i, keep, len(group), i == keep and len(t or "") == -length, hashlib.sha256(n.encode()).hexdigest()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)


def test_exact_keeps_one_row_and_all_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = exact.drop_duplicates(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(rows, key=str) == sorted(
        [(2, "a  b\tc"), (6, " \n"), (7, "A b c"), (8, BASE), (9, BASE + "again"), (11, " a b c"), (12, "x" * 200_000),
         (13, "word " * 30_000), (None, "only here"), (14, "one two three"), (16, "Über über")], key=str)


def test_fingerprint_matches_definition():
    for _, text in TEXTS:
        assert simhash.fingerprint(text or "") == brute_fingerprint(text)


@pytest.mark.parametrize("tile_rows", [2, 1000])
def test_simhash_components(spark, tile_rows):
    near = BASE.split()
    more = [(100 + k, " ".join(near[:k] + ["changed"] + near[k + 1:])) for k in range(0, 100, 4)]
    rows = TEXTS + more
    got = simhash.near_duplicates(
        spark.createDataFrame([(i, t, "", 0, "") for i, t in rows], SCHEMA), tile_rows=tile_rows).collect()
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    found = brute_components(prints)
    want = [(i, f"{p:016x}", found[n]) for n, (i, p) in enumerate(prints)]
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)
    assert len({c for _, _, c in want}) < len(want)


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact.duplicate_groups(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert exact.drop_duplicates(docs).columns == docs.columns
    assert simhash.drop_near_duplicates(docs).count() == 0


def test_near_dedup_keeps_smallest_id(spark):
    docs = spark.createDataFrame([(3, BASE), (2, BASE), (2, BASE), (9, "something else entirely is here")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == [2, 9]


def test_near_dedup_keeps_one_row_of_every_component(spark):
    rows = [(None, "alpha beta gamma delta"), (None, "one two three four five"), (None, BASE), (None, None),
            (5, "red green blue white black"), (5, "north south east west up down"), (7, BASE), (7, BASE.upper()),
            (None, "one  two three four five"), (8, "red green blue white black")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, n int")
    prints = [brute_fingerprint(t) for _, t in rows]
    names = brute_components(list(enumerate(prints)))  # by position, so that every component has its name
    want = {}
    for n, (i, t) in enumerate(rows):
        key = (i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest())
        want[names[n]] = min(want.get(names[n], (key, n)), (key, n))
    got = sorted(r["n"] for r in simhash.drop_near_duplicates(docs).collect())
    assert got == sorted(n for _, n in want.values())
    assert {0, 3, 4, 5} <= set(got) and len(got) == 6


def test_exact_drop_reads_the_texts_once_for_the_result(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/docs")
    kept = exact.drop_duplicates(spark.read.parquet(f"{tmp_path}/docs"))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    # One reading of the documents beside the stored groups, and no string made of every character.
    assert plan.count("Relation") == 2 and "translate(" not in plan


def test_exact_drop_keeps_the_rows_that_the_groups_name(spark):
    rows = ROWS + [(i, t, "", 0, "") for i, t in [
        (20, "same id"), (20, "other text"), (20, "sameid"), (None, "z\x0bz"), (None, "z\x0bz"), (-5, "z z"), (21, "a b"), (22, "a b"),
        (-(2**63), "low"), (2**63 - 1, "lo w"), (23, "\r\n"), (24, "\x0c")]]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {(r["doc_id"], r["n_chars"], r["text_sha256"]) for r in exact.duplicate_groups(docs).filter("kept").collect()}
    got = [(r["doc_id"], len(r["text"] or ""), hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "").encode()).hexdigest())
           for r in exact.drop_duplicates(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want
