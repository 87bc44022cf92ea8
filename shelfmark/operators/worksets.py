"""Selecting the entries and users a run has to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.scoring import age_in_days

DELETED = "deleted"
# Ages in days for the two refresh rhythms, (age of the oldest
# unvisited recommendation, time since the last login).
DAILY = (1, 7)
WEEKLY = (7, 30)
# Attentions before a user gets recommendations, recommendations per user.
MIN_ATTENTION = 5
MAX_PERSONAL = 20


def _usable() -> F.Column:
    """Good link and not deleted; an unknown identifier is excluded as in SQL."""
    return F.col("permalink_good") & (F.col("oai_identifier") != DELETED)


def entries_to_index(entries: DataFrame, all: bool = False) -> DataFrame:
    """Ids of all entries, or of those harvested after they were last indexed."""
    chosen = entries if all else entries.filter(F.col("harvested_at") > F.col("indexed_at"))
    return chosen.select("id")


def entries_to_recommend(entries: DataFrame, all: bool = False) -> DataFrame:
    """Ids of usable entries, or of those indexed after their relevance was computed."""
    chosen = entries.filter(_usable())
    if not all:
        chosen = chosen.filter(F.col("indexed_at") > F.col("relevance_calculated_at"))
    return chosen.select("id")


def deleted_entries(entries: DataFrame) -> DataFrame:
    """Deleted entries and entries with a bad link; ``is_deleted`` tells them apart."""
    return entries.filter((F.col("oai_identifier") == DELETED) | ~F.col("permalink_good")).select(
        "id", "lang", F.col("oai_identifier").eqNullSafe(DELETED).alias("is_deleted")
    )


def entries_to_tag(entries: DataFrame, lang: str | None = None) -> DataFrame:
    """Usable entries changed since their last run, of one language or of all."""
    chosen = entries.filter(_usable() & (F.col("indexed_at") > F.col("relevance_calculated_at")))
    if lang is not None:
        chosen = chosen.filter(F.col("lang") == lang)
    return chosen.select("id", "lang")


def _of_users(df: DataFrame, prefix: str) -> DataFrame:
    return df.filter(F.col(f"{prefix}_type") == "User")


def users_by_recs_age(users: DataFrame, recs: DataFrame, as_of, days: int) -> DataFrame:
    """Users whose oldest unvisited recommendation is more than ``days`` old."""
    return (
        _of_users(recs, "personal_recommendable")
        .filter(F.col("visited_at").isNull())
        .groupBy(F.col("personal_recommendable_id").alias("id"))
        .agg(F.max(age_in_days(F.col("created_at"), as_of)).alias("_age"))
        .filter(F.col("_age") > days)
        .join(users, "id", "left_semi")
        .select("id")
    )


def users_logged_in_within(users: DataFrame, as_of, days: int) -> DataFrame:
    return users.filter(age_in_days(F.col("last_request_at"), as_of) < days).select("id")


def users_without_recs(users: DataFrame, recs: DataFrame) -> DataFrame:
    owners = _of_users(recs, "personal_recommendable").select(F.col("personal_recommendable_id").alias("id"))
    return users.select("id").join(owners, "id", "left_anti")


def users_with_attention(users: DataFrame, attentions: DataFrame, more_than: int = MIN_ATTENTION) -> DataFrame:
    """Users with more than the given number of attentions, counted per user."""
    return (
        _of_users(attentions, "attentionable")
        .groupBy(F.col("attentionable_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > more_than)
        .join(users, "id", "left_semi")
        .select("id")
    )


def users_needing_recs(
    users: DataFrame,
    recs: DataFrame,
    attentions: DataFrame,
    as_of,
    weekly: bool = False,
    min_attention: int = MIN_ATTENTION,
    quota: int = MAX_PERSONAL,
) -> DataFrame:
    """Recently seen users with stale recommendations, and active users without any."""
    age, login = WEEKLY if weekly else DAILY
    stale = users_by_recs_age(users, recs, as_of, age).join(
        users_logged_in_within(users, as_of, login), "id", "left_semi"
    )
    unserved = users_without_recs(users, recs).join(
        users_with_attention(users, attentions, min_attention), "id", "left_semi"
    )
    return stale.union(unserved).distinct().withColumn("quota", F.lit(quota))


def recs_quota(
    recs: DataFrame, attentions: DataFrame, users: DataFrame, max_recs: int = MAX_PERSONAL,
    min_attention: int = MIN_ATTENTION,
) -> DataFrame:
    """Older rule: how many recommendations each active user is short of."""
    unvisited = (
        _of_users(recs, "personal_recommendable")
        .filter(F.col("visited_at").isNull())
        .groupBy(F.col("personal_recommendable_id").alias("id"))
        .agg((F.lit(max_recs) - F.count(F.lit(1))).alias("recs_needed"))
        .filter(F.col("recs_needed") > 0)
    )
    return unvisited.join(users_with_attention(users, attentions, min_attention), "id", "left_semi")


def bootstrap_limit(entries: DataFrame, n: int = 200) -> DataFrame:
    """The first ``n`` entries by id: the top-n that a first run starts with."""
    return entries.orderBy("id").limit(n)
