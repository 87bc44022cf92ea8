"""The searchable corpus: one document per entry and one row per document field.

Multi-valued fields (subjects, aggregations) are kept as field rows instead of
arrays, so an entry or feed with very many of them never has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.skew import BROADCAST_ROWS, spread_by_size
from shelfmark.functions.text import tokenize_as

# Languages that have an analyzer.
ANALYZER_LANGUAGES = ("de", "en", "es", "fr", "ja", "nl", "ru", "zh")
# Weight of each field in the similarity text and in the tag text.
TEXT_WEIGHTS = {"title": 3, "description": 1, "subject": 2}
TAG_WEIGHTS = {"title": 3, "description": 1}
# Characters of text that one task splits into terms and counts.
TASK_CHARACTERS = 8_000_000


def feed_aggregations(feeds: DataFrame, aggregation_feeds: DataFrame) -> DataFrame:
    """Feed and aggregation pairs; a feed in no aggregation keeps one row without one."""
    return feeds.select(F.col("id").alias("feed_id")).join(aggregation_feeds, "feed_id", "left").select(
        "feed_id", "aggregation_id"
    )


def corpus_validity(entries: DataFrame, languages=ANALYZER_LANGUAGES) -> DataFrame:
    """Which entries can be indexed and which may be stamped as done.

    A missing title, description, link or grain size fails the document and
    leaves it unstamped; a language without analyzer is stamped but not indexed.
    """
    complete = (
        F.col("title").isNotNull()
        & F.col("description").isNotNull()
        & F.col("permalink").isNotNull()
        & F.col("grain_size").isNotNull()
    )
    analyzed = F.coalesce(F.col("lang").isin(*languages), F.lit(False))
    return entries.select(
        "id", (analyzed & complete).alias("indexable"), (~analyzed | complete).alias("stampable")
    )


def build_corpus(entries: DataFrame, feeds: DataFrame, languages=ANALYZER_LANGUAGES) -> DataFrame:
    """One document per indexable entry with a known feed.

    Runs one job over the feeds: as long as they are few, the texts stay where they are read.
    """
    names = feeds.select(F.col("id").alias("feed_id"), F.coalesce("short_title", F.lit("")).alias("collection"))
    if names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        names = F.broadcast(names)
    return (
        entries.filter(F.col("lang").isin(*languages))
        .dropna(subset=["title", "description", "permalink", "grain_size"])
        .join(names, "feed_id")
        .select(
            "id", "lang", "feed_id", "permalink",
            F.coalesce("direct_link", F.lit("")).alias("direct_link"),
            "title", "description", "collection", "grain_size",
        )
    )


def corpus_fields(
    corpus: DataFrame,
    subjects: DataFrame | None = None,
    entries_subjects: DataFrame | None = None,
    feed_aggs: DataFrame | None = None,
) -> DataFrame:
    """Field rows (id, lang, field, value) of title, description, subjects and aggregations.

    Subjects given by people are ``subject``, generated ones ``generated_subject``.
    """
    texts = corpus.select(
        "id",
        "lang",
        F.explode(
            F.array(
                F.struct(F.lit("title").alias("field"), F.col("title").alias("value")),
                F.struct(F.lit("description").alias("field"), F.col("description").alias("value")),
            )
        ).alias("f"),
    ).select("id", "lang", "f.field", "f.value")
    rows = texts
    keys = corpus.select("id", "lang", "feed_id")
    if entries_subjects is not None:
        named = entries_subjects.join(subjects.withColumnRenamed("id", "subject_id"), "subject_id").select(
            F.col("entry_id").alias("id"),
            F.when(F.col("autogenerated"), "generated_subject").otherwise("subject").alias("field"),
            F.col("name").alias("value"),
        )
        rows = rows.unionByName(keys.join(named, "id").select("id", "lang", "field", "value"))
    if feed_aggs is not None:
        member = feed_aggs.dropna(subset=["aggregation_id"])
        rows = rows.unionByName(
            keys.join(member, "feed_id").select(
                "id", "lang", F.lit("aggregation").alias("field"),
                F.col("aggregation_id").cast("string").alias("value"),
            )
        )
    return rows


def members_of(corpus: DataFrame, feed_aggs: DataFrame, aggregation_id: int) -> DataFrame:
    """Documents whose feed belongs to the aggregation."""
    feeds = feed_aggs.filter(F.col("aggregation_id") == aggregation_id).select("feed_id").distinct()
    return corpus.join(feeds, "feed_id", "left_semi").select("id", "lang")


def weighted_terms(
    fields: DataFrame,
    weights: dict[str, int] | None = None,
    tokenizers: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Weighted term frequency (id, lang, term, tf) over the weighted fields.

    The texts of an entry are brought together before they are split into terms.
    That moves less than moving the terms, and all later work per entry (counts,
    lengths, ranks) finds its rows in place.  A task counts the terms of about
    TASK_CHARACTERS, however large the input is.  ``tokenizers`` maps languages to
    functions from a text to its terms.
    """
    weights = TEXT_WEIGHTS if weights is None else weights
    weight = F.lit(None).cast("int")
    for field, value in weights.items():
        weight = F.when(F.col("field") == field, F.lit(value)).otherwise(weight)
    weighted = fields.filter(F.col("field").isin(*weights))
    return (
        spread_by_size(weighted, F.length("value"), TASK_CHARACTERS, "id")
        .select("id", "lang", weight.alias("w"), F.explode(tokenize_as(F.col("value"), F.col("lang"), tokenizers)).alias("term"))
        .groupBy("id", "lang", "term")
        .agg(F.sum("w").cast("bigint").alias("tf"))
    )


def tag_terms(fields: DataFrame, tokenizers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Unstemmed term frequency of title and description, the source of generated subjects."""
    return weighted_terms(fields, TAG_WEIGHTS, tokenizers)


def stem_vocabulary(terms: DataFrame, stem_map: DataFrame, protected: DataFrame) -> DataFrame:
    """Replace terms by their stem, except protected ones, and add up what falls together."""
    usable = stem_map.join(protected, "term", "left_anti").select("term", "stem")
    return (
        terms.join(usable, "term", "left")
        .groupBy("id", "lang", F.coalesce("stem", "term").alias("term"))
        .agg(F.sum("tf").alias("tf"))
    )


def index_orphans(corpus: DataFrame, entries: DataFrame) -> DataFrame:
    """Documents whose entry no longer exists."""
    return corpus.join(entries.select("id"), "id", "left_anti").select("id", "lang")


def remove_documents(corpus: DataFrame, gone: DataFrame) -> DataFrame:
    """The corpus without the given ids."""
    return corpus.join(gone.select("id"), "id", "left_anti").select(*corpus.columns)
