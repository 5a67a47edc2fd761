"""Mixing of sources to target weights by hierarchical token budgets, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import as_row, kept_columns, stored, unpack

#: Hex digits of the seeded hash that part a leaf's epoch into bins.
BIN_DIGITS = 2
_WIDE = "decimal(38,0)"


def weight_of(value: Column, weights: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(value == name, w).otherwise(out)
    return out


def share_out(children: DataFrame, parent: Sequence[str], budget: Column) -> DataFrame:
    """Part each parent's ``budget`` among its children in proportion to ``weight``, none over its ``capacity``.

    Exact water-filling: by rising capacity per weight, a child is full if its capacity is at most its weighted part of
    what the full ones before it leave; the others share the rest. So a child's shortage goes to its siblings.
    Adds ``given`` (whole tokens, rounded down).
    """
    order = Window.partitionBy(*parent).orderBy(F.col("capacity").cast("double") / F.col("weight").cast("double"), "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    c = children.withColumns({"budget": budget.cast(_WIDE), "capacity": F.col("capacity").cast(_WIDE), "weight": F.col("weight").cast("long")})
    c = c.withColumns({"taken": F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast(_WIDE), "left": (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))})
    c = c.withColumn("full", F.col("capacity") * F.col("left") <= F.col("weight") * (F.col("budget") - F.col("taken")))
    open_ = c.withColumns({"cap_full": F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(whole).cast(_WIDE), "w_open": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole)})
    part = F.expr("(weight * (budget - cap_full)) div nullif(w_open, 0)")
    return open_.withColumn("given", F.when(F.col("full"), F.col("capacity")).otherwise(part).cast("long"))


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: int, max_epochs: int) -> DataFrame:
    """Token budget of every leaf of the tree ``levels`` (outermost first), from ``tokens`` per leaf.

    A node can give ``max_epochs`` times its tokens. Budgets go down the tree; at each level siblings make up for a
    sibling's shortage first, and only a family's whole shortage reaches its parent's siblings.
    """
    # a nil weight takes part in nothing
    tree = leaves.select(*levels, "tokens", (F.col("tokens") * max_epochs).alias("capacity"))
    for level in levels:
        tree = tree.filter(weight_of(F.col(level), weights.get(level, {}), 1) > 0)
    above: DataFrame | None = None
    for depth, level in enumerate(levels):
        parent = list(levels[:depth])
        nodes = tree.groupBy(*parent, level).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumns({"weight": weight_of(F.col(level), weights.get(level, {}), 1), "name": F.col(level)})
        if above is None:
            nodes = nodes.withColumn("upper", F.lit(budget).cast("long"))
        else:
            nodes = nodes.join(above, parent)
        nodes = share_out(nodes, parent or [F.lit(0)], F.col("upper"))
        above = nodes.select(*parent, level, F.col("given").alias("upper"))
    return tree.select(*levels, "tokens").join(above, list(levels)).withColumnRenamed("upper", "given")


def mix(df: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], *, budget: int | None = None, budget_share: float = 0.5, max_epochs: int = 2, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Choose rows so that sources get their target weights of a token budget.

    ``levels`` names the tree's levels, outermost first, and how a row's value is computed (null: 'none'); ``weights``
    gives whole-number weights per level (missing names: 1; 0: left out). The budget is ``budget`` tokens, or
    ``budget_share`` of all tokens. Tokens are runs of other characters than space, tab and line ends.

    A leaf's budget is filled from epochs: in each it is ordered by a seeded hash of the row's id and text; whole
    epochs are taken ``given div tokens`` times and of the last one the prefix of rows whose tokens fit. Rows without
    tokens come along with the prefix. Running totals go through bins of the hash, never through a leaf as a whole.

    Returns the caller's columns, one row per choice, with the levels, ``tokens`` and ``epoch`` (from 0); these win
    over columns of the same names. Repeated rows are rows of their own. An empty table gives an empty result.
    """
    names = list(levels)
    made = [*names, "tokens", "epoch"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = lambda epoch: F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("id"), F.col("digest")).cast("binary"))
    rows = df.select(
        as_row(df).alias("row"),
        *[F.coalesce(c.cast("string"), F.lit("none")).alias(n) for n, c in levels.items()],
        F.regexp_count(text, F.lit(r"[^ \t\n\r]+")).cast("long").alias("tokens"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.md5(text.cast("binary")).alias("digest"),
    )
    sizes = stored(rows.select(*names, "tokens", "id", "digest"), "mix_rows")
    leaves = sizes.groupBy(*names).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    if budget is None:
        budget = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * budget_share)
    given = leaf_budgets(leaves, names, weights, budget, max_epochs)
    plan = stored(given.select(*names, F.expr("given div tokens").alias("epochs"), F.expr("given % tokens").alias("rest")), "mix_plan")

    last = sizes.join(plan.filter("rest > 0"), names).withColumn("order", hashed(F.col("epochs")))
    last = last.withColumn("bin", F.substring("order", 1, BIN_DIGITS))
    bins = last.groupBy(*names, "bin").agg(F.sum("tokens").alias("in_bin"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*names).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("in_bin").over(upto), F.lit(0)))
    # the one bin of each leaf in which the prefix ends is the only one that needs running totals
    edge = bins.filter("before <= rest and before + in_bin > rest").select(*names, "bin", "before", "rest")
    within = Window.partitionBy(*names, "bin").orderBy("order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        last.drop("rest")
        .join(edge, [*names, "bin"])
        .withColumn("until", F.col("before") + F.sum("tokens").over(within))
        .filter("until <= rest")
        .groupBy(*names)
        .agg(F.max("order").alias("stop"))
    )
    stops = stored(
        plan.join(edge.select(*names, "bin"), names, "left").join(cut, names, "left").select(*names, "epochs", F.when(F.col("rest") > 0, F.coalesce("stop", "bin", F.lit("g"))).alias("stop")),
        "mix_stops",
    )
    chosen = rows.join(stops, names)
    partly = F.when(F.col("stop").isNotNull() & (hashed(F.col("epochs")) <= F.col("stop")), F.array(F.col("epochs")))
    whole = F.when(F.col("epochs") > 0, F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1))
    none = F.array().cast("array<bigint>")
    epochs = F.concat(F.coalesce(whole, none), F.coalesce(partly, none))
    return chosen.withColumn("epoch", F.explode(epochs)).select(*unpack("row", kept_columns(df, made)), *names, "tokens", "epoch")
