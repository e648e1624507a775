"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

The tree has the levels domain, language, source. A token budget enters at the
root; each node shares what it gets among its children by weight, and no child
gets more than its subtree can supply (its tokens times ``max_epochs``). A child
that can't take its share leaves the shortage to its siblings, by weight, before
anything is left to the level above: a node's own supply is the sum of its
children's, so it returns only what they all together can't take. The share of
each child is min(supply, level * weight), where level solves the sum; ordering
siblings by supply / weight gives it in closed form by running sums.

Each leaf then takes a prefix of its documents in a seeded random order, epoch
after epoch: whole epochs first, then the documents of the next epoch whose
running token sum stays within what is left. Running sums over a leaf of any size
are taken in two levels: sums of hash-range bins over the leaf's bins, and rows
within the one bin that the boundary falls in. Bins number ``bins`` for each
leaf, so a leaf with a third of all rows spreads over as many keys.

Defined results: null keys form leaves of their own ('' as name); null or empty
texts have no tokens and are never chosen; a weight that isn't listed is 1;
repeated rows are drawn one by one (ties in the order break by the id and then
count together); a zero budget selects nothing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

LEVELS = ("domain", "language", "source")


def weight_of(column: Column, weights: dict[str, float]) -> Column:
    return reduce(lambda acc, kv: F.when(column == kv[0], F.lit(float(kv[1]))).otherwise(acc), weights.items(), F.lit(1.0))


def n_tokens(text: Column) -> Column:
    """Words divided by white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _share(nodes: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """Adds share: the children's parts of budget. nodes has supply, weight."""
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ratio = F.when(F.col("weight") > 0, F.col("supply") / F.col("weight")).otherwise(F.lit(float("inf")))
    before = siblings.orderBy("__ratio", *[c for c in nodes.columns if c in LEVELS]).rowsBetween(Window.unboundedPreceding, -1)
    sized = nodes.withColumn("__ratio", ratio).withColumn("__budget", budget.cast("double"))
    sized = sized.withColumn("__full", F.coalesce(F.sum("supply").over(before), F.lit(0))).withColumn("__open", F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The level if all smaller ratios were full. It holds at the first child that it doesn't fill, and is lower at later ones.
    sized = sized.withColumn("__level", F.when(F.col("__open") > 0, (F.col("__budget") - F.col("__full")) / F.col("__open")))
    level = F.max(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level"))).over(siblings)
    share = F.floor(F.least(F.col("supply").cast("double"), F.coalesce(F.greatest(level, F.lit(0.0)) * F.col("weight"), F.when(F.col("weight") > 0, F.col("supply").cast("double")).otherwise(F.lit(0.0)))))
    return sized.withColumn("share", share.cast("long")).drop("__ratio", "__budget", "__full", "__open", "__level")


def leaf_budgets(leaves: DataFrame, budget: int, weights: dict[str, dict[str, float]], max_epochs: int) -> DataFrame:
    """domain, language, source, tokens, share. leaves: one row for each leaf with its tokens."""
    leaves = leaves.withColumn("supply", F.col("tokens") * max_epochs)
    got, above = None, []
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens")).withColumn("weight", weight_of(F.col(level), weights.get(level, {})))
        if got is not None:
            nodes = nodes.join(got, above)
        got = _share(nodes, above, F.lit(budget) if depth == 0 else F.col("__parent"))
        if depth < len(LEVELS) - 1:
            got = got.select(*keys, F.col("share").alias("__parent"))
        above = keys
    return got.select(*LEVELS, "tokens", "share")


def mix_sources(docs: DataFrame, domain: Column, budget: int | None = None, fraction: float = 0.5, weights: dict[str, dict[str, float]] | None = None, max_epochs: int = 2, seed: int = 7, bins: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, domain, language, source, n_tokens, epochs: how many times each chosen row is taken.

    budget: tokens over all epochs; by default ``fraction`` of all tokens.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    order = lambda epoch: F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), name(F.col("doc_id"))))
    rows = docs.select(F.col(id_col).alias("doc_id"), name(domain).alias("domain"), name(F.col(lang_col)).alias("language"), name(F.col(source_col)).alias("source"), n_tokens(F.col(text_col)).alias("n_tokens")).where("n_tokens > 0")
    rows = materialize(rows)  # texts are read and split once; all that follows is on these narrow rows
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")))
    if budget is None:
        budget = math.floor((leaves.agg(F.sum("tokens")).first()[0] or 0) * fraction)
    shares = leaf_budgets(leaves, budget, weights or {}, max_epochs)
    # Whole epochs, and what is left for the next one, whose order is seeded by its number.
    shares = shares.select(*LEVELS, F.expr("share div tokens").alias("whole"), F.expr("share % tokens").alias("rest"))
    rows = rows.join(shares, list(LEVELS)).withColumn("h", order(F.col("whole")))
    rows = rows.withColumn("bin", F.expr(f"(cast(conv(substring(h, 1, 8), 16, 10) as bigint) * {bins}) div 4294967296"))
    of_bin = rows.groupBy(*LEVELS, "bin").agg(F.sum("n_tokens").alias("b"), F.first("rest").alias("rest"))
    running = Window.partitionBy(*LEVELS).orderBy("bin")
    of_bin = of_bin.withColumn("through", F.sum("b").over(running)).select(*LEVELS, "bin", (F.col("through") - F.col("b")).alias("before"), "through")
    rows = rows.join(of_bin, [*LEVELS, "bin"])
    within = Window.partitionBy(*LEVELS, "bin").orderBy("h", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    split = rows.where((F.col("before") < F.col("rest")) & (F.col("through") > F.col("rest"))).withColumn("more", (F.col("before") + F.sum("n_tokens").over(within) <= F.col("rest")).cast("long"))
    clear = rows.where((F.col("before") >= F.col("rest")) | (F.col("through") <= F.col("rest"))).withColumn("more", (F.col("through") <= F.col("rest")).cast("long"))
    return split.unionByName(clear).withColumn("epochs", F.col("whole") + F.col("more")).where("epochs > 0").select("doc_id", *LEVELS, "n_tokens", "epochs")
