"""Joins and numbering that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

# Side length of a cell: rows of one key that meet in one task are at most this
# many from each side.
CELL_ROWS = 2_000
# Products one task of an expanding join should make.
PRODUCTS_PER_TASK = 1_000_000
# A table of hot keys up to this many rows may be broadcast.
BROADCAST_ROWS = 200_000
# Number of md5 prefixes used for numbering (three hex digits).
ID_BUCKETS = 4096


def expanding_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_by: Sequence[str],
    right_by: Sequence[str],
    sizes: DataFrame,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Inner equi-join for N:M joins whose hottest key may hold a third of either side.

    The rows of a hot key are dealt over a grid: left rows by the hash of
    ``left_by`` over the lines, right rows by ``right_by`` over the columns, and
    every row is repeated along the other axis.  A cell then holds at most about
    ``cell_rows`` rows of each side and the repetition adds a thousandth of the
    product.  Keys that fit one cell are joined as they are.

    ``sizes`` has the keys with ``left_rows`` and ``right_rows``, exact or upper
    bounds.  Runs one job over it, to see whether there are hot keys at all and how
    large the product is.  Both sides are spread over as many partitions as the
    product asks for, up to the number of shuffle partitions: their input is small
    next to the product, so it must not be coalesced by input size.
    """
    keys = list(keys)
    spark = left.sparkSession
    is_hot = F.greatest("left_rows", "right_rows") > cell_rows
    products = F.col("left_rows").cast("double") * F.col("right_rows")
    size = sizes.agg(F.sum(products).alias("products"), F.count_if(is_hot).alias("hot")).first()
    found = size["hot"]
    limit = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(1, min(limit, ceil((size["products"] or 0) / PRODUCTS_PER_TASK)))
    hot = sizes.filter(is_hot).select(
        *keys,
        F.ceil(F.col("left_rows") / cell_rows).cast("int").alias("_lines"),
        F.ceil(F.col("right_rows") / cell_rows).cast("int").alias("_columns"),
    )
    if found:
        if found <= BROADCAST_ROWS:
            hot = F.broadcast(hot)
        lines = F.greatest(F.lit(1), F.coalesce("_lines", F.lit(1)))
        columns = F.greatest(F.lit(1), F.coalesce("_columns", F.lit(1)))

        def deal(side: DataFrame, by: Sequence[str], own: str, own_n, other: str, other_n) -> DataFrame:
            return (
                side.join(hot, keys, "left")
                .withColumn(own, F.pmod(F.xxhash64(*by), own_n).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), other_n - 1)))
                .drop("_lines", "_columns")
            )

        left = deal(left, left_by, "_line", lines, "_column", columns)
        right = deal(right, right_by, "_column", columns, "_line", lines)
        keys += ["_line", "_column"]
    joined = left.repartition(partitions, *keys).join(right.repartition(partitions, *keys), keys)
    return joined.drop("_line", "_column")


def spread_by_size(df: DataFrame, size: Column, per_task: int, key: str) -> DataFrame:
    """``df`` by the hash of ``key`` in as many partitions as keep the sum of ``size`` at about ``per_task`` in each.

    For rows that are split into many more in the same task, whose number AQE
    cannot see from the bytes shuffled.  Runs one job over ``size``.
    """
    whole = df.agg(F.sum(size)).first()[0] or 0
    return df.repartition(max(1, ceil(whole / per_task)), key)


def number_rows(df: DataFrame, key: Sequence[str], name: str = "position") -> DataFrame:
    """Number distinct keys 1..n without sorting the data in one task.

    The order is that of ``md5(key)``: distinct keys fall evenly into the 4096
    prefixes, each prefix is numbered on its own and then shifted by the size of
    the prefixes before it.  The table of shifts never exceeds 4096 rows.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key]))
    tagged = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, 3))
    sizes = tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift")
    )
    within = Window.partitionBy("_bucket").orderBy("_digest", *key)
    return (
        tagged.withColumn("_n", F.row_number().over(within))
        .join(F.broadcast(shifts), "_bucket")
        .withColumn(name, (F.col("_n") + F.col("_shift")).cast("bigint"))
        .drop("_digest", "_bucket", "_n", "_shift")
    )
