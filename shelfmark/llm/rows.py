"""Helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import shelfmark

#: The white space the operators fold or delete: blank and tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def whole_text(name: str = "text") -> Column:
    """The text column as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_key(name: str) -> Column:
    """A join key that is never null: the id in decimal, empty for a null id."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def keep_rows(docs: DataFrame, kept: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` whose keys are in ``kept``, one per key, with the columns of ``docs``.

    ``kept`` has one row per key and no text, so only one side of the join is wide.
    Keys are document ids (with a digest), so that no key gathers more than the
    repetitions of one document.
    """
    names = [f"_key_{name}" for name in keys]
    keyed = docs.withColumns(dict(zip(names, keys.values())))
    wanted = kept.select(*[F.col(name).alias(key) for name, key in zip(keys, names)])
    return keyed.join(wanted, names, "left_semi").dropDuplicates(names).select(*[keyed[c] for c in docs.columns])


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors of this application the package, which functions run in Python import there."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(shelfmark.__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="shelfmark-")) / "shelfmark.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as target:
        for source in sorted(root.rglob("*.py")):
            target.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(application)
