"""Whole runs and the streaming run on a small catalogue."""

import pytest

from pyspark.sql import functions as F

from shelfmark.functions.lineage import cut, ensure_checkpoint_dir, scratch
from shelfmark.operators import corpus, index
from shelfmark.plans import runs
from shelfmark.plans.snapshots import read_pointer, read_snapshot, remove_unused, write_snapshot
from shelfmark.sources.tables import SCHEMAS
from shelfmark.streaming.entries import snapshot_path, stream_entries

FIRST, SECOND = "2024-01-10 00:00:00", "2024-01-20 00:00:00"
TOPICS = ["algebra rings fields groups", "poetry verse rhyme meter", "cells genes protein enzyme"]


def change(i, at, deleted=False, extra=""):
    words = TOPICS[i % 3]
    return (
        i, i % 4, "en", f"http://host{i % 4}.org/{i}", None, f"{words.split()[i % 4].title()} course {i}",
        f"{words} {words} {words} {extra}", "course" if i % 2 else "resource", True,
        "deleted" if deleted else f"oai:{i}", at, None, None, at,
    )


def changes(spark, rows):
    typed = spark.createDataFrame(rows, SCHEMAS["entries"].replace("timestamp", "string"))
    for c in ("harvested_at", "indexed_at", "relevance_calculated_at", "published_at"):
        typed = typed.withColumn(c, F.col(c).cast("timestamp"))
    return typed


@pytest.fixture(scope="module")
def start(spark):
    state = runs.empty_catalogue(spark)
    state["feeds"] = spark.createDataFrame([(f, f"Feed {f}") for f in range(4)], SCHEMAS["feeds"])
    state["aggregation_feeds"] = spark.createDataFrame([(1, f) for f in range(4)], SCHEMAS["aggregation_feeds"])
    return state


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_full_run_then_incremental_deletion(spark, start):
    first = runs.run_full(start, changes(spark, [change(i, "2024-01-01 00:00:00") for i in range(12)]), FIRST)
    assert ids(first["corpus"]) == list(range(12))
    recs = first["recommendations"].collect()
    assert recs and all((r.entry_id - r.dest_entry_id) % 3 == 0 for r in recs if r["rank"] <= 3)
    assert first["buckets"].count() == 12
    assert first["entries_subjects"].filter("autogenerated").count() >= 12
    assert {r.level for r in first["tag_clouds"].select("level").distinct().collect()} == {1, 2, 3}

    later = changes(spark, [change(3, "2024-01-15 00:00:00", deleted=True), change(12, "2024-01-15 00:00:00")])
    second = runs.run_incremental(first, later, SECOND)
    assert ids(second["entries"]) == [i for i in range(13) if i != 3]
    assert 3 not in ids(second["corpus"]) and 12 in ids(second["corpus"])
    pairs = second["recommendations"].collect()
    assert all(3 not in (r.entry_id, r.dest_entry_id) for r in pairs)
    assert any(r.entry_id == 12 for r in pairs)
    untouched = {r.id for r in recs if 3 not in (r.entry_id, r.dest_entry_id) and r.entry_id % 3}
    assert untouched <= {r.id for r in pairs}


def test_bootstrap_works_on_the_first_entries_and_keeps_the_others(spark, start):
    state = runs.run_bootstrap(start, changes(spark, [change(i, "2024-01-01 00:00:00") for i in range(9)]), FIRST, n=6)
    assert ids(state["entries"]) == list(range(9)) and ids(state["corpus"]) == list(range(6))
    after = runs.run_incremental(state, changes(spark, []), SECOND)
    assert ids(after["corpus"]) == list(range(9))
    assert {r.level for r in state["tag_clouds"].select("level").distinct().collect()} == {1}


def test_bootstrap_writes_the_texts_of_the_others_once(spark, start, monkeypatch):
    rows = [change(i, "2024-01-01 00:00:00") for i in range(40)]
    stored = cut(changes(spark, rows))
    again = changes(spark, [change(i, "2024-01-02 00:00:00", extra="again") for i in (2, 30)])
    written = []

    def counting(df):
        table = cut(df)
        if "harvested_at" in df.columns:
            written.append(table.filter("id >= 6").count())
        return table

    monkeypatch.setattr(runs, "cut", counting)
    state = runs.run_bootstrap({**start, "entries": stored}, again, FIRST, n=6)
    assert ids(state["entries"]) == list(range(40)) and ids(state["corpus"]) == [2]
    texts = {r.id: r.description for r in state["entries"].collect()}
    assert texts[2].endswith("again") and texts[30].endswith("again") and not texts[31].endswith("again")
    assert sum(written) <= 34 + 1  # every other entry once, and the change of one


def test_stream_gives_the_state_of_the_batch_run(spark, start, tmp_path):
    batches = [
        [change(i, "2024-01-01 00:00:00") for i in range(6)],
        [change(i, "2024-01-02 00:00:00") for i in range(6, 9)] + [change(0, "2024-01-02 00:00:00", extra="galois theory")],
    ]
    source, snapshots = str(tmp_path / "in"), str(tmp_path / "state")
    write_snapshot(start, snapshot_path(snapshots, -1))
    expected = start
    for n, rows in enumerate(batches):
        batch = changes(spark, rows)
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(batch.schema).parquet(source)
        stream_entries(stream, snapshots, str(tmp_path / "cp"), as_of=f"2024-02-0{n + 1}", interval=None).awaitTermination()
        expected = runs.run_incremental(expected, batch, f"2024-02-0{n + 1}")
    got = read_snapshot(spark, snapshot_path(snapshots, 1))
    for table, columns in (("entries", ("id", "description", "indexed_at")), ("corpus", ("id", "description"))):
        assert sorted(map(tuple, got[table].select(*columns).collect())) == sorted(
            map(tuple, expected[table].select(*columns).collect())
        )
    key = ("entry_id", "dest_entry_id", "rank")
    assert sorted(map(tuple, got["recommendations"].select(*key).collect())) == sorted(
        map(tuple, expected["recommendations"].select(*key).collect())
    )


def test_harvest_keeps_entries_without_times_and_decides_ties(spark, start):
    none, tie = change(1, None), change(2, "2024-01-03 00:00:00")
    rows = [none, tie, tie[:5] + ("Another title",) + tie[6:], change(3, None), change(3, "2024-01-02 00:00:00", extra="newer")]
    results = []
    for order in (rows, rows[::-1]):
        merged = runs.harvest(start["entries"], changes(spark, order))
        results.append(sorted(map(tuple, merged.collect())))
    assert results[0] == results[1] and [r[0] for r in results[0]] == [1, 2, 3]
    assert results[0][1][5] == max(tie[5], "Another title") and results[0][2][6].endswith("newer")
    state = runs.run_incremental(start, changes(spark, rows), FIRST)
    assert ids(state["corpus"]) == [1, 2, 3]
    assert state["entries"].filter("indexed_at = timestamp '2024-01-10'").count() == 3


def test_stream_of_changes_without_times(spark, start, tmp_path):
    snapshots, source = str(tmp_path / "state"), str(tmp_path / "in")
    write_snapshot(start, snapshot_path(snapshots, -1))
    batch = changes(spark, [change(i, None) for i in range(3)])
    batch.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    stream_entries(stream, snapshots, str(tmp_path / "cp"), interval=None).awaitTermination()
    got = read_snapshot(spark, snapshot_path(snapshots, 0))
    assert ids(got["corpus"]) == [0, 1, 2] and got["entries"].filter("indexed_at IS NULL").count() == 0


def rows_of(table):
    return sorted(map(tuple, table.select(*sorted(table.columns)).collect()), key=str)


def rebuilt_index(spark, state):
    empty = index.Index(*[spark.createDataFrame([], SCHEMAS[name]) for name in index.INDEX_TABLES])
    return index.update_index(empty, state["corpus"], state["subjects"], state["entries_subjects"], state["corpus"].select("id"))


def assert_index_is_rebuilt(spark, state):
    want, got = rebuilt_index(spark, state), runs.kept_index(state)
    for part in ("terms", "documents", "vocabulary"):
        assert rows_of(getattr(got, part)) == rows_of(getattr(want, part)), part


@pytest.fixture(scope="module")
def ten(spark, start):
    return runs.run_incremental(start, changes(spark, [change(i, "2024-01-01 00:00:00") for i in range(10)]), FIRST)


def test_one_change_splits_one_text(spark, ten, monkeypatch):
    split = []

    def counting(fields, *args, _terms=corpus.weighted_terms):
        split.append(sorted({r["id"] for r in fields.select("id").collect()}))
        return _terms(fields, *args)

    later = changes(spark, [change(4, "2024-01-12 00:00:00", extra="galois theory")])
    monkeypatch.setattr(corpus, "weighted_terms", counting)
    one = runs.run_incremental(ten, later, SECOND)
    monkeypatch.undo()
    assert split == [[4]]
    assert_index_is_rebuilt(spark, ten)
    assert_index_is_rebuilt(spark, one)
    assert one["index_vocabulary"].filter("term = 'galois'").first()["df"] == 1
    empty = {n: spark.createDataFrame([], SCHEMAS[n]) for n in index.INDEX_TABLES}
    fresh = runs.run_incremental({**ten, **empty}, later, SECOND)
    for table in ("recommendations", "buckets", *index.INDEX_TABLES):
        assert rows_of(one[table]) == rows_of(fresh[table])


def test_index_after_deletions_and_new_subjects(spark, ten):
    subjects = [(1, "Number theory"), (2, "Generated")]
    state = {
        **ten, "subjects": spark.createDataFrame(subjects, SCHEMAS["subjects"]),
        "entries_subjects": spark.createDataFrame([(5, 1, False), (5, 1, False), (6, 2, True)], SCHEMAS["entries_subjects"]),
        "corpus": ten["corpus"].filter("id <> 2"),
    }
    got = runs.maintain_index(state)
    assert_index_is_rebuilt(spark, got)
    assert got["index_terms"].filter("id = 5 AND term = 'theory'").first()["tf"] == 4
    assert got["index_terms"].filter("term = 'generated'").count() == got["index_documents"].filter("id = 2").count() == 0


def test_snapshot_writes_changed_parts_only(spark, ten, tmp_path):
    root = str(tmp_path / "state")
    paths = [f"{root}/batch={n}" for n in range(3)]
    whole = write_snapshot(ten, paths[0], buckets=8)
    stored = read_snapshot(spark, paths[0])
    assert all(rows_of(stored[name]) == rows_of(ten[name].select(*stored[name].columns)) for name in runs.STATE_TABLES)

    assert write_snapshot(stored, paths[1], paths[0]) == 0
    changed = {**stored, "corpus": stored["corpus"].withColumn("title", F.when(F.col("id") == 7, "Changed").otherwise(F.col("title")))}
    assert write_snapshot(changed, paths[2], paths[1]) == 1 < whole
    assert write_snapshot(changed, paths[2], paths[1]) == 1  # again, after a failure
    folders = [r["folder"] for r in read_pointer(spark, paths[2]).collect()]
    assert sum(f.startswith(paths[2]) for f in folders) == 1

    removed = remove_unused(spark, root, paths[2:])
    assert paths[1] in removed and sum(r.startswith(paths[0]) for r in removed) == 2  # one old part and the old pointer
    got = read_snapshot(spark, paths[2])
    assert all(rows_of(got[name]) == rows_of(ten[name].select(*got[name].columns)) for name in runs.STATE_TABLES if name != "corpus")
    assert [r["title"] for r in got["corpus"].filter("id = 7").collect()] == ["Changed"] and got["corpus"].count() == 10


def test_small_batch_writes_few_files_and_repeats(spark, ten, tmp_path):
    before, after = f"{tmp_path}/batch=0", f"{tmp_path}/batch=1"
    write_snapshot(ten, before, buckets=32)
    batch = changes(spark, [change(3, "2024-01-15 00:00:00", extra="lemma")])
    states = []
    for _ in range(2):
        runs.run_incremental(read_snapshot(spark, before), batch, SECOND, lambda s: write_snapshot(s, after, before))
        states.append({name: rows_of(table) for name, table in read_snapshot(spark, after).items()})
    assert states[0] == states[1]
    written = [r for r in read_pointer(spark, after).collect() if r["folder"].startswith(after)]
    touched = {r["table"]: sum(x["table"] == r["table"] for x in written) for r in written}
    assert touched["entries"] == touched["corpus"] == touched["index_documents"] == touched["index_terms"] == 1
    assert len(list((tmp_path / "batch=1").rglob("*.parquet"))) == len(written) + 1


def test_scratch_tables_go(spark):
    import os

    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scratch(spark):
        assert cut(spark.range(5)).count() == 5
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before
