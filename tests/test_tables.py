"""Buckets, table states, subjects and clouds on small hand-made tables."""

import json
import random
import re

from pyspark.sql import functions as F

from shelfmark.functions import scoring, text
from shelfmark.operators import buckets, corpus, snapshots, subjects, tagcloud, worksets

REC = "id bigint, entry_id bigint, dest_entry_id bigint, rank int, relevance double, clicks int, avg_time_at_dest bigint"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_bucket_rules(spark):
    recs = spark.createDataFrame(
        [(i, 1, 10 + i, i, 0.5, 0, 60) for i in range(1, 5)]  # all alike: nothing above the threshold
        + [(5, 2, 20, 1, 0.9, 0, 60)]  # a single one
        + [(6, 3, 30, 1, 0.9, 9, 50), (7, 3, 31, 2, 0.8, 9, 50), (8, 3, 32, 3, 0.7, 9, 40), (9, 3, 33, 4, 0.1, 0, 1)],
        REC,
    )
    got = buckets.bucketize(recs)
    assert rows(got, "id", "bucket") == [(i, "other") for i in range(1, 6)] + [
        (6, "other"), (7, "other"), (8, "other"), (9, "other")
    ]
    # popular ones are shown by time on page, shortest first, ties by rank
    popular = got.withColumn("bucket", F.when(F.col("clicks") >= 5, "popular").otherwise("other"))
    ordered = buckets.order_buckets(popular).filter("entry_id = 3 AND bucket = 'popular'")
    assert rows(ordered, "position", "dest_entry_id") == [(1, 32), (2, 30), (3, 31)]


def test_every_recommendation_is_in_one_bucket_and_in_its_list(spark):
    rng = random.Random(1)
    recs = spark.createDataFrame(
        [(e * 100 + r, e, 1000 + r, r, rng.random(), rng.randint(0, 20), rng.randint(1, 90)) for e in range(20) for r in range(1, 11)],
        REC,
    )
    entries = spark.createDataFrame(
        [(1000 + r, 1, f"http://x/{r}", None, f'Say "{r}" \\ here') for r in range(1, 11)],
        "id bigint, feed_id bigint, permalink string, direct_link string, title string",
    )
    feeds = spark.createDataFrame([(1, None)], "id bigint, short_title string")
    lists = buckets.bucket_json(buckets.bucketize(recs), entries, feeds).collect()
    assert len(lists) == 20
    for row in lists:
        shown = [x for b in buckets.BUCKETS for x in json.loads(row[b])]
        assert sorted(x["id"] for x in shown) == [row.entry_id * 100 + r for r in range(1, 11)]
        assert list(shown[0]) == [
            "id", "uri", "direct_link", "title", "collection", "clicks", "avg_time_on_target", "relevance"
        ]


def test_recommendation_states_are_idempotent(spark):
    old = spark.createDataFrame([(1, 1, 2, 1, 0.9, 7, 33), (2, 1, 3, 2, 0.8, 1, 60), (3, 5, 6, 1, 0.7, 0, 60)], REC)
    new = spark.createDataFrame(
        [(1, 2, 2, 0.5), (1, 4, 1, 0.6)], "entry_id bigint, dest_entry_id bigint, rank int, relevance double"
    )
    first = snapshots.upsert_recommendations(old, new)
    assert rows(first, *old.columns) == [
        (1, 1, 2, 2, 0.5, 7, 33), (2, 1, 3, 2, 0.8, 1, 60), (3, 5, 6, 1, 0.7, 0, 60), (4, 1, 4, 1, 0.6, 0, 60)
    ]
    assert rows(snapshots.upsert_recommendations(first, new), *old.columns) == rows(first, *old.columns)
    kept = snapshots.drop_stale_recommendations(first, new)
    assert rows(kept, "id") == [(1,), (3,), (4,)]
    assert rows(snapshots.drop_stale_recommendations(kept, new), "id") == rows(kept, "id")


def test_queries_and_subjects_upserts(spark):
    queries = spark.createDataFrame([(1, "a", 100), (2, "b", 10)], "id bigint, name string, frequency int")
    popular = spark.createDataFrame([("a", 5), ("b", 6), ("c", 7)], "name string, frequency int")
    got = snapshots.upsert_queries(queries, popular)
    assert rows(got, "id", "name", "frequency") == [(1, "a", 100), (2, "b", 6), (3, "c", 7)]
    assert rows(snapshots.upsert_queries(got, popular), "id", "name", "frequency") == rows(got, "id", "name", "frequency")
    known = spark.createDataFrame([(4, "art")], "id bigint, name string")
    names = spark.createDataFrame([("art",), ("music",), ("music",)], "name string")
    assert rows(snapshots.get_or_create_subjects(known, names), "id", "name") == [(4, "art"), (5, "music")]


def literal_subjects(terms, existing):
    have, seen, out = len(existing), set(existing), []
    if have >= 5:
        return []
    for term, tf in sorted(terms.items(), key=lambda x: (-x[1], x[0])):
        if have >= 5 or tf <= 2:
            break
        for piece in re.split(r"--|[:;,)(/\".]", term.lower()):
            piece = piece.strip()
            if piece and piece not in seen:
                seen.add(piece)
                out.append(piece)
                have += 1
    return out


def test_generated_subjects_match_literal_loop(spark):
    rng = random.Random(2)
    words = ["art", "b--c", "d/e/f", "Gee", "h.i", "jay", "kay", "(ell)", "em;en;oh", "pee"]
    terms, existing, want = [], [], []
    for e in range(60):
        own = {w: rng.randint(1, 6) for w in rng.sample(words, 8)}
        names = rng.sample(["art", "c", "gee", "zoo", "yes", "no", "x"], rng.randint(0, 6))
        terms += [(e, "en", w, tf) for w, tf in own.items()]
        existing += [(e, n) for n in names]
        want += [(e, n) for n in literal_subjects(own, names)]
    existing_df = spark.createDataFrame(existing, "id bigint, name string")
    ids = spark.range(60)
    gap = subjects.subject_gap(ids, existing_df.select(F.col("id").alias("entry_id")))
    got = subjects.generate_subjects(
        spark.createDataFrame(terms, "id bigint, lang string, term string, tf bigint"), gap, existing_df
    )
    assert rows(got, "entry_id", "name") == sorted(want)


def test_a_term_with_three_pieces_may_exceed_the_target(spark):
    terms = spark.createDataFrame([(1, "en", "d/e/f", 9), (1, "en", "g", 3)], "id bigint, lang string, term string, tf bigint")
    existing = spark.createDataFrame([(1, n) for n in "wxyz"], "id bigint, name string")
    gap = spark.createDataFrame([(1, 4)], "id bigint, have bigint")
    got = subjects.generate_subjects(terms, gap, existing)
    assert rows(got, "name") == [("d",), ("e",), ("f",)]


def cloud_tables(spark):
    tags = {1: ["art", "martial arts", "smart"], 2: ["art", "martial arts"], 3: ["smart", "art"], 4: ["solo"]}
    names = sorted({t for ts in tags.values() for t in ts})
    subject = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id bigint, name string")
    links = spark.createDataFrame(
        [(e, names.index(t), False) for e, ts in tags.items() for t in ts],
        "entry_id bigint, subject_id bigint, autogenerated boolean",
    )
    entries = spark.createDataFrame(
        [(e, 1, "course" if e == 2 else None) for e in tags], "id bigint, language_id int, grain_size string"
    )
    return entries, links, subject


def test_tags_inside_the_filter_text_are_not_shown(spark):
    tables = cloud_tables(spark)
    level1 = tagcloud.tag_cloud_level1(*tables)
    level2 = tagcloud.tag_cloud_level2(level1, *tables)
    inside = level2.filter("filter = 'martial arts' AND grain_size = 'all'")
    assert rows(inside, "tag", "freq", "shown") == [("art", 2, False), ("martial arts", 2, False), ("smart", 1, True)]
    assert rows(inside, "cloud_min", "cloud_max")[0] == (1, 2)
    alone = tagcloud.cloud_string(level2.filter("filter = 'solo'")).collect()
    assert [r.tag_list for r in alone] == ["1,1"]
    texts = tagcloud.cloud_string(level1.filter("grain_size = 'all'")).collect()
    assert [r.tag_list for r in texts] == ["1,3,art,3,martial arts,2,smart,2,solo,1"]


def test_both_orders_of_a_pair_are_one_cloud(spark):
    tables = cloud_tables(spark)
    level3 = tagcloud.tag_cloud_level3(tagcloud.tag_cloud_level2(tagcloud.tag_cloud_level1(*tables), *tables), *tables)
    got = rows(level3.filter("grain_size = 'all'"), "filter", "tag", "freq")
    assert [g for g in got if g[0] == "martial arts/smart"] == [
        ("martial arts/smart", "art", 1), ("martial arts/smart", "martial arts", 1), ("martial arts/smart", "smart", 1)
    ]
    assert {g[0] for g in got} == {"art/martial arts", "art/smart", "martial arts/smart"}


def test_scalar_expressions(spark):
    one = spark.createDataFrame([("A, b, Fall 2001", "http://a.org/x/y", "Ab--Cd: e. ;F")], "t string, u string, s string")
    got = one.select(
        text.normalized_title(F.col("t")).alias("t"), text.domain_of(F.col("u")).alias("u"),
        text.split_subjects(F.col("s")).alias("s"),
        text.tag_pair_filter(F.lit("b"), F.lit("B")).alias("p"),
        text.clean_tokens(F.lit("The Cat4 sat ON Émile mats")).alias("c"),
    ).first()
    assert (got.t, got.u, got.s, got.p) == ("A, b", "http://a.org", ["ab", "cd", "e", "f"], "B/b")
    assert got.c == ["sat", "mats"]


def test_decay_falls_from_ten_to_one(spark):
    days = spark.range(60).select(F.expr("timestamp '2024-01-31 00:00:00' - interval 1 day * cast(id as int)").alias("d"))
    values = [r.v for r in days.select(scoring.decay(F.col("d"), "2024-01-31 00:00:00").alias("v")).collect()]
    assert all(a >= b for a, b in zip(values, values[1:])) and 1 <= values[-1] < values[0] < 10
    assert abs(values[10] - 5.5) < 1e-12


def test_unknown_identifier_is_not_usable(spark):
    entries = spark.createDataFrame(
        [(1, "en", True, None), (2, "en", True, "oai:2"), (3, "en", False, "oai:3"), (4, "en", True, "deleted")],
        "id bigint, lang string, permalink_good boolean, oai_identifier string",
    )
    assert rows(worksets.entries_to_recommend(entries, all=True), "id") == [(2,)]
    assert rows(worksets.deleted_entries(entries), "id", "is_deleted") == [(3, False), (4, True)]
    assert rows(snapshots.delete_entries(entries), "id") == [(1,), (2,), (3,)]


def test_stems_merge_frequencies_and_spare_protected_terms(spark):
    terms = spark.createDataFrame(
        [(1, "es", "gatos", 2), (1, "es", "gato", 1), (1, "es", "perros", 4)], "id bigint, lang string, term string, tf bigint"
    )
    stems = spark.createDataFrame([("gatos", "gato"), ("perros", "perro")], "term string, stem string")
    kept = spark.createDataFrame([("perros",)], "term string")
    assert rows(corpus.stem_vocabulary(terms, stems, kept), "term", "tf") == [("gato", 3), ("perros", 4)]
