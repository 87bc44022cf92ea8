"""Readers for the ``::`` separated rating files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_movies(spark: SparkSession, path: str) -> DataFrame:
    """``id::Name (yyyy)::genres`` as id, name, year, genre and, for malformed lines, the line itself.

    The name keeps the blank before the bracket; the genres stay one text.
    """
    parts = F.split("value", r"\)::")
    head, genre = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    front = F.expr("substring(head, 1, length(head) - 5)")
    parsed = (
        spark.read.text(path)
        .filter(F.length(F.trim("value")) > 0)
        .select("value", head.alias("head"), genre.alias("genre"))
        .withColumn("front", F.split(front, "::"))
        .select(
            F.get("front", F.lit(0)).try_cast("bigint").alias("id"),
            F.get("front", F.lit(1)).alias("name"),
            F.right("head", F.lit(4)).try_cast("int").alias("year"),
            "genre", "value",
        )
    )
    broken = F.col("id").isNull() | F.col("name").isNull() | F.col("year").isNull() | F.col("genre").isNull()
    columns = [F.when(~broken, F.col(c)).alias(c) for c in ("id", "name", "year", "genre")]
    return parsed.select(*columns, F.when(broken, F.col("value")).alias("_corrupt"))


def read_movie_users(spark: SparkSession, path: str) -> DataFrame:
    """``id::gender::age::occupation``; numbers that cannot be read become NULL."""
    return spark.read.csv(path, sep="::", schema="id bigint, gender string, age int, occupation int")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """``user::movie::rate`` with anything after the third field ignored."""
    return spark.read.csv(path, sep="::", schema="user_id bigint, movie_id bigint, rate int, _rest string").select(
        "user_id", "movie_id", "rate"
    )
