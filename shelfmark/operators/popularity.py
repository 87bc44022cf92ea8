"""Popularity of subjects as query suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.scoring import scale_0_100


def subject_popularity(taggings: DataFrame, subjects: DataFrame) -> DataFrame:
    """Times a subject was used, in whole percent of the most used one."""
    counts = taggings.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.agg(F.max("n")).scalar()
    return counts.join(subjects.withColumnRenamed("id", "subject_id"), "subject_id").select(
        "subject_id", "name", scale_0_100(F.col("n"), largest).alias("frequency")
    )
