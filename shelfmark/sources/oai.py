"""Reader for harvested OAI-PMH ``ListRecords`` responses, and records as changes of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.functions.skew import number_rows

RECORD = (
    "header struct<_status:string, identifier:string, datestamp:date, setSpec:array<string>>, "
    "metadata struct<dc:struct<identifier:array<string>, title:string, description:string, date:string, "
    "creator:array<string>, subject:array<string>, type:string, language:string, rights:string>>"
)


def read_oai_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; a deleted record is a tombstone whose ``oai_identifier`` is ``deleted``.

    ``facets`` are the (facet, value) pairs of the set names; a facet may repeat.
    """
    raw = spark.read.format("xml").options(rowTag="record", ignoreNamespace="true").schema(RECORD).load(path)
    dc = "metadata.dc."
    facets = F.transform(
        F.col("header.setSpec"),
        lambda s: F.struct(
            F.get(F.split(s, ":", 2), F.lit(0)).alias("facet"), F.get(F.split(s, ":", 2), F.lit(1)).alias("value")
        ),
    )
    is_deleted = F.coalesce(F.col("header._status") == "deleted", F.lit(False))
    return raw.select(
        F.trim("header.identifier").alias("identifier"),
        F.when(is_deleted, "deleted").otherwise(F.trim("header.identifier")).alias("oai_identifier"),
        F.coalesce("header._status", F.lit("live")).alias("status"),
        F.col("header.datestamp").alias("datestamp"),
        F.trim(F.get(dc + "identifier", F.lit(0))).alias("permalink"),
        F.col(dc + "title").alias("title"),
        F.col(dc + "description").alias("description"),
        F.col(dc + "date").alias("date"),
        F.col(dc + "creator").alias("creator"),
        F.coalesce(dc + "subject", F.array().cast("array<string>")).alias("subject"),
        F.col(dc + "type").alias("type"),
        F.col(dc + "language").alias("language"),
        F.col(dc + "rights").alias("rights"),
        F.coalesce(facets, F.array().cast("array<struct<facet:string,value:string>>")).alias("facets"),
    )


def record_facets(records: DataFrame) -> DataFrame:
    """(identifier, facet, value) rows of all records."""
    return records.select("identifier", F.explode("facets").alias("f")).select("identifier", "f.facet", "f.value")


def entries_from_records(
    records: DataFrame, entries: DataFrame, feed_id: int, language_facet: str = "language", grain_facet: str = "grain_size"
) -> DataFrame:
    """Records of one feed as changes of ``entries``, for ``plans.runs.harvest``.

    A record whose identifier an entry has keeps the id of that entry; unknown ones
    are numbered after the largest id, so a tombstone finds the entry it deletes.
    Tombstones of unknown records are left out.  Language and grain size come from
    the metadata, else from the facets.
    """
    facet = lambda name: F.get(F.transform(
        F.filter("facets", lambda f: f["facet"] == name), lambda f: f["value"]), F.lit(0))
    known = entries.filter("oai_identifier <> 'deleted'").groupBy(F.col("oai_identifier").alias("identifier")).agg(
        F.min("id").alias("_known"))
    largest = entries.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    placed = records.join(known, "identifier", "left")
    unknown = placed.filter("_known IS NULL AND oai_identifier <> 'deleted'").select("identifier").distinct()
    numbered = number_rows(unknown, ["identifier"], "_new")
    live = F.col("oai_identifier") != "deleted"
    return (
        placed.join(numbered, "identifier", "left")
        .withColumn("id", F.coalesce("_known", F.col("_new") + F.lit(largest)).cast("bigint"))
        .filter("id IS NOT NULL")
        .select(
            "id", F.lit(feed_id).cast("bigint").alias("feed_id"),
            F.lower(F.substring(F.coalesce("language", facet(language_facet)), 1, 2)).alias("lang"),
            "permalink", F.lit(None).cast("string").alias("direct_link"), "title", "description",
            F.coalesce(facet(grain_facet), F.lit("resource")).alias("grain_size"),
            (live & F.col("permalink").isNotNull()).alias("permalink_good"), "oai_identifier",
            F.col("datestamp").cast("timestamp").alias("harvested_at"),
            F.lit(None).cast("timestamp").alias("indexed_at"), F.lit(None).cast("timestamp").alias("relevance_calculated_at"),
            F.try_to_timestamp("date").alias("published_at"),
        )
    )
