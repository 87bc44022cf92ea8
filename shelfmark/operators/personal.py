"""Personal recommendations from attentions and stored item recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shelfmark.functions.scoring import as_timestamp, decay
from shelfmark.operators import snapshots, worksets

# Kinds of attention and the weight of one without its own.
ATTENTION_KINDS = {"write": 1, "bookmark": 2, "search": 3, "click": 4, "share": 5, "discuss": 6}
DEFAULT_WEIGHT = 5
DIGITS = 9


def _kinds(types: DataFrame) -> DataFrame:
    return types.select(F.col("id").alias("attention_type_id"), "default_weight")


def semantic_scores(attentions: DataFrame, types: DataFrame, recs: DataFrame) -> DataFrame:
    """Best product of attention, weight of its kind and relevance per user and destination.

    The relevance is not negative, so the strongest attention of a user to an
    entry decides and the attentions are reduced to it before they meet the
    recommendations.
    """
    strongest = (
        attentions.join(_kinds(types), "attention_type_id")
        .groupBy("attentionable_id", "entry_id")
        .agg(
            F.max(F.col("weight") * F.col("default_weight")).alias("_w"),
            F.min("attentionable_type").alias("_type"),
        )
    )
    return (
        strongest.join(recs.select("entry_id", "dest_entry_id", "relevance"), "entry_id")
        .groupBy(F.col("attentionable_id").alias("user_id"), "dest_entry_id")
        .agg(F.max(F.col("_w") * F.col("relevance")).alias("score"), F.min("_type").alias("attentionable_type"))
    )


def decayed_scores(attentions: DataFrame, types: DataFrame, recs: DataFrame, entries: DataFrame, as_of) -> DataFrame:
    """As ``semantic_scores``, with the age of the attention and of the source entry weighed in."""
    fresh = F.col("weight") * F.col("default_weight") * decay(F.col("created_at"), as_of)
    strongest = (
        attentions.filter(F.col("attentionable_type") == "User")
        .join(_kinds(types), "attention_type_id")
        .groupBy("attentionable_id", "entry_id")
        .agg(F.max(fresh).alias("_w"))
    )
    sources = entries.select(F.col("id").alias("entry_id"), decay(F.col("published_at"), as_of).alias("_decay"))
    led = recs.join(sources, "entry_id").select(
        "entry_id", "dest_entry_id", (F.col("relevance") * F.col("_decay")).alias("_r")
    )
    return (
        strongest.join(led, "entry_id")
        .groupBy(F.col("attentionable_id").alias("user_id"), "dest_entry_id")
        .agg(F.max(F.col("_w") * F.col("_r")).alias("score"))
    )


def decayed_recommendations(scores: DataFrame, existing: DataFrame, n: int = worksets.MAX_PERSONAL) -> DataFrame:
    """The best ``n`` destinations per user that are not among the user's recommendations yet."""
    known = existing.filter(
        (F.col("personal_recommendable_type") == "User") & (F.col("destination_type") == "Entry")
    ).select(F.col("personal_recommendable_id").alias("user_id"), F.col("destination_id").alias("dest_entry_id"))
    best = Window.partitionBy("user_id").orderBy(F.round("score", DIGITS).desc(), "dest_entry_id")
    return (
        scores.join(known, ["user_id", "dest_entry_id"], "left_anti")
        .withColumn("position", F.row_number().over(best).cast("bigint"))
        .filter(F.col("position") <= n)
    )


def refresh_personal(
    users: DataFrame, recs: DataFrame, attentions: DataFrame, types: DataFrame, item_recs: DataFrame,
    entries: DataFrame, as_of, weekly: bool = False, quota: int = worksets.MAX_PERSONAL,
) -> DataFrame:
    """New state of the personal recommendations after serving all users that need some."""
    due = worksets.users_needing_recs(users, recs, attentions, as_of, weekly, quota=quota).select("id")
    kept = snapshots.delete_unvisited(recs, due)
    theirs = attentions.join(due.withColumnRenamed("id", "attentionable_id"), "attentionable_id", "left_semi")
    chosen = decayed_recommendations(
        decayed_scores(theirs, types, item_recs, entries, as_of), kept, quota
    )
    added = chosen.select(
        F.col("user_id").alias("personal_recommendable_id"),
        F.lit("User").alias("personal_recommendable_type"),
        F.col("dest_entry_id").alias("destination_id"),
        F.lit("Entry").alias("destination_type"),
        F.col("score").alias("relevance"),
        as_timestamp(as_of).alias("created_at"),
        F.lit(None).cast("timestamp").alias("visited_at"),
    )
    return kept.unionByName(added)


def authorship_attentions(
    entries: DataFrame, identity_feeds: DataFrame, attentions: DataFrame,
    kind: int = ATTENTION_KINDS["write"], weight: float = DEFAULT_WEIGHT,
) -> DataFrame:
    """Attentions of users to the entries of their own feeds, where there is none yet."""
    seen = attentions.filter(F.col("attentionable_type") == "User").select("attentionable_id", "entry_id")
    return (
        entries.join(identity_feeds, "feed_id")
        .select(
            F.col("ownable_id").alias("attentionable_id"), F.lit("User").alias("attentionable_type"),
            F.col("id").alias("entry_id"), F.lit(kind).alias("attention_type_id"),
            F.lit(float(weight)).alias("weight"), F.col("published_at").alias("created_at"),
        )
        .join(seen, ["attentionable_id", "entry_id"], "left_anti")
    )


def attention_docs(entries: DataFrame, attentions: DataFrame) -> DataFrame:
    """Title and text of every entry a user attended, once per attention."""
    seen = attentions.filter(F.col("attentionable_type") == "User").select(
        F.col("attentionable_id").alias("user_id"), "entry_id"
    )
    return seen.join(entries.select(F.col("id").alias("entry_id"), "title", "description"), "entry_id").select(
        "user_id", "entry_id", "title", "description"
    )
