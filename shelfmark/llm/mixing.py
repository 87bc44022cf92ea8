"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Leaves are (domain, language, source).  A token budget goes down the tree: at
every node it is dealt to the children by weight; a child that cannot use its
share (its subtree holds fewer tokens, even when repeated ``max_epochs`` times)
takes what it can and the shortage goes to its siblings by weight.  Since a
subtree is never given more than it holds, a shortage reaches the siblings of
its parent only when its own siblings are full.

A leaf with budget B and S tokens gives all its documents B div S times, and the
rest as a prefix of the next epoch: documents in seeded order (md5 of seed, epoch
and id) as long as their running sum fits.  Running sums are not a window over a
leaf, which may hold a third of all rows: the order is cut at the first three
digits of the md5 into 4,096 buckets, buckets are summed first, and within a
bucket only its own rows are ordered.

Defined results: null domain, language or source is the node ``unknown``; a null
text counts as empty, which is one token; weights that are not listed are
``default_weight``, weights of zero or less (or null) give nothing; a null id is
ordered as an empty one; repeated rows are dealt like different documents; an
empty table gives no rows.  Columns of the input are kept, those named like an
added column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.functions.lineage import cut
from shelfmark.llm.rows import ASCII_SPACE, id_key, whole_text

LEVELS = ("domain", "lang", "source")
MAX_EPOCHS = 3
SEED = 7
UNKNOWN = "unknown"


def token_count(text: str = "text") -> Column:
    """Pieces between single white-space characters: one more than there are of those."""
    content = whole_text(text)
    return (F.length(content) - F.length(F.translate(content, ASCII_SPACE, "")) + 1).cast("bigint")


def _weighted(leaves: DataFrame, weights: DataFrame, default_weight: int) -> DataFrame:
    """Leaves with the weights of their domain, language and source; what weighs nothing is left out."""
    for n, level in enumerate(LEVELS, 1):
        listed = weights
        for name in LEVELS[:n]:
            listed = listed.filter(F.col(name).isNotNull())
        for name in LEVELS[n:]:
            listed = listed.filter(F.col(name).isNull())
        listed = listed.groupBy(*LEVELS[:n]).agg(F.max(F.coalesce("weight", F.lit(0))).cast("bigint").alias("_listed"))
        leaves = (
            leaves.join(listed, list(LEVELS[:n]), "left")
            .withColumn(f"{level}_weight", F.coalesce("_listed", F.lit(default_weight).cast("bigint")))
            .filter(F.col(f"{level}_weight") > 0).drop("_listed")
        )
    return leaves


def _deal(children: DataFrame, parents: DataFrame, level: int) -> DataFrame:
    """Split the budget of every parent among its children, none above its capacity.

    Children in the order of capacity by weight are full up to some point; those
    after it share what is left by weight, in whole tokens.  These tables have as
    many rows as the tree has nodes, which is metadata and not data.
    """
    own, keys = list(LEVELS[:level + 1]), ["_root", *LEVELS[:level]]
    rows = children.join(parents.select(*keys, F.col("budget").alias("_budget")), keys)
    order = Window.partitionBy(*keys).orderBy(F.col("capacity").cast("double") / F.col("weight"), own[-1])
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    share = (F.col("_budget") - before).cast("double") / rest_weight * F.col("weight")
    group = Window.partitionBy(*keys)
    full = rows.withColumn("_full", F.col("capacity").cast("double") <= share)
    left = F.col("_budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(group), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group)
    return full.select(
        "_root", *own,
        F.when(F.col("_full"), F.col("capacity"))
        .otherwise(F.greatest(F.lit(0), F.floor(left.cast("double") / open_weight * F.col("weight")))).cast("bigint").alias("budget"),
    )


def leaf_budgets(
    leaves: DataFrame, weights: DataFrame, budget_percent: int, max_epochs: int = MAX_EPOCHS, default_weight: int = 1
) -> DataFrame:
    """domain, lang, source, supply, budget for leaves given with their ``supply`` of tokens.

    ``weights`` has domain, lang, source and weight; rows without source weigh a
    language within its domain, rows without language weigh a domain.
    """
    supplied = cut(_weighted(leaves, weights, default_weight).withColumns(
        {"_root": F.lit(0), "capacity": F.col("supply") * F.lit(max_epochs)}))
    total = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("supply"))
    budgets = total.select(
        F.lit(0).alias("_root"), F.floor(F.col("supply") * F.lit(budget_percent) / 100).cast("bigint").alias("budget"))
    for level, name in enumerate(LEVELS):
        children = supplied.groupBy("_root", *LEVELS[:level + 1]).agg(
            F.sum("capacity").alias("capacity"), F.max(f"{name}_weight").alias("weight"))
        budgets = _deal(children, budgets, level)
    return budgets.join(supplied.select(*LEVELS, "supply"), list(LEVELS)).select(*LEVELS, "supply", "budget")


def mix(
    docs: DataFrame,
    weights: DataFrame,
    domain: Column,
    budget_percent: int,
    id_column: str = "doc_id",
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    default_weight: int = 1,
    added: tuple[str, str, str] = ("domain", "n_tokens", "copies"),
) -> DataFrame:
    """The selected rows of ``docs`` with domain, n_tokens and copies (the epochs that take the document).

    The budget is ``budget_percent`` of all tokens of ``docs``; ``added`` names the new columns.
    """
    named = {"_domain": domain, "_lang": F.col(lang), "_source": F.col(source)}
    keys = list(named)
    # The given columns travel as one, so that none of them can clash with a name used here.
    tagged = docs.select(
        F.struct("*").alias("_row"), id_key(id_column).alias("_id"), token_count(text).alias("_tokens"),
        *[F.coalesce(c.cast("string"), F.lit(UNKNOWN)).alias(k) for k, c in named.items()])
    leaves = cut(
        tagged.groupBy(*keys).agg(F.sum("_tokens").alias("supply"))
        .select(*[F.col(k).alias(name) for k, name in zip(keys, LEVELS)], "supply")
    )
    budgets = cut(
        leaf_budgets(leaves, weights, budget_percent, max_epochs, default_weight).filter("budget > 0").select(
            *[F.col(name).alias(k) for k, name in zip(keys, LEVELS)],
            F.floor(F.col("budget") / F.col("supply")).cast("bigint").alias("_full"),
            F.pmod(F.col("budget"), F.col("supply")).alias("_rest"))
    )
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("_full") + 1).cast("string"), F.col("_id")).cast("binary"))
    ordered = tagged.join(budgets, keys).withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, 3))
    spot = [*keys, "_bucket"]
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows a leaf
    buckets = (
        ordered.groupBy(*spot).agg(F.sum("_tokens").alias("_sum"))
        .select(*spot, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy(*spot).orderBy("_order", "_tokens").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ordered.join(buckets, spot)
        .withColumn("_end", F.col("_before") + F.sum("_tokens").over(within))
        .withColumn("_copies", F.col("_full") + (F.col("_end") <= F.col("_rest")).cast("bigint"))
        .filter("_copies > 0")
        .select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in added],
                *[F.col(c).alias(name) for c, name in zip(("_domain", "_tokens", "_copies"), added)])
    )
