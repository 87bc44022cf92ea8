"""New table states computed from the old state and a change set.

Each function returns the complete next state, so that running it again over
its own result changes nothing.  Sinks write that state as a new snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.scoring import as_timestamp
from shelfmark.functions.skew import number_rows

PAIR = ["entry_id", "dest_entry_id"]
PERSONAL_PAIR = ["personal_recommendable_id", "destination_id"]
# State of a recommendation nobody has followed yet.
NEW_CLICKS = 0
NEW_AVG_TIME = 60
# A moment before any run, which makes an entry due again.
NEVER = "1971-01-01 00:00:00"


def _next_id(table: DataFrame) -> F.Column:
    return F.coalesce(table.agg(F.max("id")).scalar(), F.lit(0))


def upsert_recommendations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Known pairs get the new rank and relevance and keep id, clicks and time; new pairs are added."""
    fresh = new.select(*PAIR, F.col("rank").alias("_rank"), F.col("relevance").alias("_relevance"))
    kept = old.join(fresh, PAIR, "left").select(
        "id",
        *PAIR,
        F.coalesce("_rank", "rank").cast("int").alias("rank"),
        F.coalesce("_relevance", "relevance").alias("relevance"),
        "clicks",
        "avg_time_at_dest",
    )
    added = number_rows(new.join(old, PAIR, "left_anti"), PAIR).select(
        (_next_id(old) + F.col("position")).cast("bigint").alias("id"),
        *PAIR,
        F.col("rank").cast("int").alias("rank"),
        "relevance",
        F.lit(NEW_CLICKS).cast("int").alias("clicks"),
        F.lit(NEW_AVG_TIME).cast("bigint").alias("avg_time_at_dest"),
    )
    return kept.unionByName(added)


def drop_stale_recommendations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Drop destinations missing from the new list of an entry; entries without a new list stay as they are."""
    untouched = old.join(new.select("entry_id").distinct(), "entry_id", "left_anti")
    confirmed = old.join(new.select(*PAIR), PAIR, "left_semi")
    return untouched.unionByName(confirmed).select(*old.columns)


def delete_involving(recs: DataFrame, deleted: DataFrame) -> DataFrame:
    """Drop recommendations that start or end at a deleted entry."""
    gone = deleted.select("id")
    return recs.join(gone, recs["entry_id"] == gone["id"], "left_anti").join(
        gone, F.col("dest_entry_id") == gone["id"], "left_anti"
    )


def delete_entries(entries: DataFrame) -> DataFrame:
    """Physically drop deleted entries; those with a bad link stay."""
    return entries.filter(~F.col("oai_identifier").eqNullSafe("deleted"))


def _set_where(entries: DataFrame, ids: DataFrame, column: str, value: F.Column) -> DataFrame:
    marks = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return (
        entries.join(marks, "id", "left")
        .withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column)))
        .drop("_hit")
        .select(*entries.columns)
    )


def stamp_processed(entries: DataFrame, ids: DataFrame, column: str, as_of) -> DataFrame:
    """Set ``indexed_at`` or ``relevance_calculated_at`` of the processed entries."""
    return _set_where(entries, ids, column, as_timestamp(as_of))


def entries_pointing_at(recs: DataFrame, dests: DataFrame) -> DataFrame:
    """Entries that recommend one of the given destinations."""
    targets = dests.select(F.col("id").alias("dest_entry_id"))
    return recs.join(targets, "dest_entry_id", "left_semi").select(F.col("entry_id").alias("id")).distinct()


def flag_for_recompute(entries: DataFrame, recs: DataFrame, deleted: DataFrame) -> DataFrame:
    """Make entries that recommended a deleted entry due again."""
    return _set_where(
        entries, entries_pointing_at(recs, deleted), "relevance_calculated_at", as_timestamp(NEVER)
    )


def replace_tag_clouds(old: DataFrame, new: DataFrame, key=("grain_size", "language_id", "filter")) -> DataFrame:
    """Replace clouds by key, keeping those that were not rebuilt."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new).select(*old.columns)


def upsert_personal(
    old: DataFrame, scores: DataFrame, attended: DataFrame, as_of, min_score: float = 0.0
) -> DataFrame:
    """Store scores above ``min_score`` of (user, entry) pairs the user has not attended yet.

    ``scores`` has user_id, entry_id, score; ``attended`` has user_id, entry_id.
    """
    wanted = (
        scores.filter(F.col("score") > min_score)
        .join(attended, ["user_id", "entry_id"], "left_anti")
        .select(
            F.col("user_id").alias("personal_recommendable_id"),
            F.col("entry_id").alias("destination_id"),
            F.lit("User").alias("personal_recommendable_type"),
            F.lit("Entry").alias("destination_type"),
            F.col("score").alias("_score"),
        )
    )
    keys = PERSONAL_PAIR + ["personal_recommendable_type", "destination_type"]
    kept = (
        old.join(wanted, keys, "left")
        .withColumn("relevance", F.coalesce("_score", "relevance"))
        .select(*old.columns)
    )
    added = (
        wanted.join(old, keys, "left_anti")
        .withColumn("relevance", F.col("_score"))
        .withColumn("created_at", as_timestamp(as_of))
        .withColumn("visited_at", F.lit(None).cast("timestamp"))
        .select(*old.columns)
    )
    return kept.unionByName(added)


def delete_unvisited(recs: DataFrame, users: DataFrame) -> DataFrame:
    """Drop the never visited recommendations of the given users."""
    ids = users.select(F.col("id").alias("personal_recommendable_id"))
    loose = F.col("visited_at").isNull() & (F.col("personal_recommendable_type") == "User")
    dropped_candidates = recs.filter(loose).join(ids, "personal_recommendable_id", "left_anti")
    return recs.filter(~loose).unionByName(dropped_candidates).select(*recs.columns)


def get_or_create_subjects(subjects: DataFrame, names: DataFrame) -> DataFrame:
    """All subjects, with the missing names added under new ids."""
    missing = names.select("name").distinct().join(subjects, "name", "left_anti")
    added = number_rows(missing, ["name"]).select(
        (_next_id(subjects) + F.col("position")).cast("bigint").alias("id"), "name"
    )
    return subjects.select("id", "name").unionByName(added)


def upsert_queries(queries: DataFrame, popularity: DataFrame, frozen_at: int = 100) -> DataFrame:
    """Insert query terms or refresh their frequency, unless the stored one has reached ``frozen_at``."""
    fresh = popularity.select("name", F.col("frequency").alias("_frequency"))
    kept = queries.join(fresh, "name", "left").select(
        "id",
        "name",
        F.when(F.col("frequency") < frozen_at, F.coalesce("_frequency", "frequency"))
        .otherwise(F.col("frequency"))
        .cast("int")
        .alias("frequency"),
    )
    added = number_rows(fresh.join(queries, "name", "left_anti"), ["name"]).select(
        (_next_id(queries) + F.col("position")).cast("bigint").alias("id"),
        "name",
        F.col("_frequency").cast("int").alias("frequency"),
    )
    return kept.unionByName(added)
