"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Three stages, each of which groups by digest *and* whole content, so that two
texts with one digest never merge:

1. every task combines its own copies (the partial aggregate of stage 2);
2. what is left of a digest is merged per salt, so that a text that makes up a
   third of all rows is spread over several tasks;
3. the salt winners of a digest are combined globally.

Texts are equal when identical without white space.  Of equal texts the row with
the most code points in the original text stays, then the one with the smallest
id.

Defined results: a null text counts as empty; a null id loses every tie and is
only kept (``keep_id`` null) where its whole group has none; rows repeated with
the same id and text get the same result; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.lineage import cut
from shelfmark.llm.rows import ASCII_SPACE, keep_rows, whole_text

#: Tasks over which the merged copies of one digest are spread before the last stage.
SALTS = 16

_SHIFT = Decimal(10) ** 20
_TOP = Decimal(2) ** 63


def normalised(text: str = "text") -> Column:
    """The text without white space.  A pattern goes from run to run; ``translate`` makes a string of every character."""
    return F.regexp_replace(whole_text(text), f"[{ASCII_SPACE}]+", "")


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def _rank(length: Column, doc_id: Column) -> Column:
    """Longest text first, then smallest id, as one number: aggregates of numbers need no sort."""
    later = F.coalesce(F.lit(_TOP) - doc_id.cast("decimal(20,0)"), F.lit(Decimal(0)).cast("decimal(20,0)"))
    return (length.cast("decimal(10,0)") * F.lit(_SHIFT) + later).cast("decimal(38,0)")


def _winner(rank: Column) -> tuple[Column, Column]:
    later = F.pmod(rank, F.lit(_SHIFT))
    keep_id = F.when(later > 0, (F.lit(_TOP) - later).cast("bigint"))
    return keep_id, F.floor(rank / F.lit(_SHIFT)).cast("bigint")


def _content_groups(rows: DataFrame) -> DataFrame:
    """One row per (digest, content) with its best rank and its number of rows."""
    salted = (
        rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        .groupBy("_digest", "_salt", "_content")
        .agg(F.max("_rank").alias("_rank"), F.count(F.lit(1)).alias("_rows"))
    )
    return (
        salted.repartition("_digest")
        .groupBy("_digest", "_content")
        .agg(F.max("_rank").alias("_rank"), F.sum("_rows").alias("group_size"))
    )


def _rows(docs: DataFrame, id_column: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Where the copies of a document meet and which of them stays: doc_id, n_chars, _content, _digest, _rank."""
    plain = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), normalised(text).alias("_content"),
                        F.length(whole_text(text)).cast("bigint").alias("n_chars"))
    return plain.select("*", digest(F.col("_content")).alias("_digest"), _rank(F.col("n_chars"), F.col("doc_id")).alias("_rank"))


def _groups(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """_digest, _best and group_size of every digest with one content; _digest, _content, _best and group_size of the contents that share one."""
    groups = cut(
        _content_groups(rows).groupBy("_digest").agg(
            F.count(F.lit(1)).alias("_contents"), F.max("_rank").alias("_best"), F.sum("group_size").alias("group_size"))
    )
    shared = groups.filter("_contents > 1").select("_digest")
    exact = None
    if not shared.isEmpty():  # different contents under one digest: those rows meet by content
        exact = _content_groups(rows.join(shared, "_digest", "left_semi")).withColumnRenamed("_rank", "_best")
    return groups.filter("_contents = 1").drop("_contents"), exact


def duplicate_groups(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and n_chars of the original text.

    ``digest`` only decides where copies meet; contents are compared at every
    stage, so a weak digest costs time and changes nothing.
    """
    rows = _rows(docs, id_column, text, digest)
    groups, exact = _groups(rows)
    members = rows.select("doc_id", "n_chars", "_digest", sha256(F.col("_content")).alias("text_sha256"))
    found = members.join(groups, "_digest")
    if exact is not None:
        found = found.unionByName(
            rows.join(exact, ["_digest", "_content"])
            .select("_digest", "doc_id", "n_chars", sha256(F.col("_content")).alias("text_sha256"), "_best", "group_size")
        )
    keep_id, longest = _winner(F.col("_best"))
    return found.select(
        "doc_id", keep_id.alias("keep_id"), "group_size",
        (F.col("doc_id").eqNullSafe(keep_id) & (F.col("n_chars") == longest)).alias("kept"), "text_sha256", "n_chars",
    )


def drop_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, one row each, with the columns of ``docs``.

    A rank holds length and id, so that digest and best rank name the row of a
    group that stays: the texts are read for the groups and once more to be kept.
    """
    groups, exact = _groups(_rows(docs, id_column, text, sha256))
    best = groups.select("_digest", "_best")
    if exact is not None:
        best = best.unionByName(exact.select("_digest", "_best"))
    return keep_rows(docs, best, {
        "_digest": sha256(normalised(text)), "_best": _rank(F.length(whole_text(text)), F.col(id_column).cast("bigint")),
    })
