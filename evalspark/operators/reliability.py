"""Agreement between judges."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.exact import ratio
from evalspark.operators.panel import valid_score, valid_scores


def pair_agreement(panel: DataFrame, judges: int) -> DataFrame:
    """Of every two judges: samples that both scored, equal scores and their share. One pass over the aligned panel."""
    pairs = []
    for i, j in combinations(range(1, judges + 1), 2):
        a, b = valid_score(F.element_at("judges", i)), valid_score(F.element_at("judges", j))
        pairs.append(F.when(a.isNotNull() & b.isNotNull(), F.struct(F.lit(i).alias("judge_a"), F.lit(j).alias("judge_b"), (a == b).alias("same"))))
    each = panel.select(F.explode(F.array_compact(F.array(*pairs))).alias("p")).select("p.*")
    counted = each.groupBy("judge_a", "judge_b").agg(F.count(F.lit(1)).alias("compared"), F.count_if("same").alias("agreed"))
    return counted.withColumn("agreement_rate", ratio(F.col("agreed"), F.col("compared"), 6))


def bundle(panel: DataFrame, judges: int) -> DataFrame:
    """One row: pairs of judges with a common sample, the mean of their agreement rates, and Krippendorff's alpha."""
    rates = pair_agreement(panel, judges).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("agreement_rate"), 6).alias("average_pairwise_agreement"))
    return rates.join(alpha(panel))  # one row each


def alpha(panel: DataFrame, categories: int = 4) -> DataFrame:
    """Krippendorff's alpha over squared rank distances of the categories in use, to 6 decimals, in one row.

    Only the categories-squared coincidences leave the aggregation. One category: 1; no sample with two scores: null.
    """
    scores = panel.select(valid_scores(F.col("judges")).alias("s")).filter(F.size("s") >= 2)
    # rows with the same scores count alike, so they are counted first and no row's arrays are read more than once
    scores = scores.groupBy(F.array_sort("s").alias("s")).agg(F.count(F.lit(1)).alias("same"))
    size_of = lambda v: F.size(F.filter("s", lambda x: x == v))
    scores = scores.select("same", F.size("s").alias("size"), *[size_of(v).alias(f"n{v}") for v in range(categories)])
    n = [F.col(f"n{v}") for v in range(categories)]
    pair = lambda c, k: n[c] * (n[c] - 1 if c == k else n[k])
    cells = [(c, k) for c in range(categories) for k in range(categories)]
    o = scores.agg(F.sum("same").alias("units"), *[F.coalesce(F.sum(F.col("same") * pair(c, k) / (F.col("size") - 1)), F.lit(0.0)).alias(f"o{c}{k}") for c, k in cells])
    plus = lambda xs: reduce(lambda a, b: a + b, xs)
    o = o.withColumns({f"m{c}": plus(F.col(f"o{c}{k}") for k in range(categories)) for c in range(categories)})
    o = o.withColumns({f"r{c}": plus([F.lit(0), *[(F.col(f"m{j}") > 0).cast("int") for j in range(c)]]) for c in range(categories)})
    used = plus((F.col(f"m{c}") > 0).cast("int") for c in range(categories))
    everything = plus(F.col(f"m{c}") for c in range(categories))
    distance = lambda c, k: (F.col(f"r{c}") - F.col(f"r{k}")) * (F.col(f"r{c}") - F.col(f"r{k}"))
    seen = plus(F.col(f"o{c}{k}") * distance(c, k) for c, k in cells)
    expected = plus(F.col(f"m{c}") * F.col(f"m{k}") * distance(c, k) for c, k in cells) / F.nullif(everything - 1, F.lit(0.0))
    value = F.when(used <= 1, 1.0).when(expected == 0, F.when(seen == 0, 1.0).otherwise(0.0)).otherwise(F.round(1 - seen / expected, 6))
    return o.select(F.coalesce("units", F.lit(0)).cast("long").alias("units"), F.when(F.col("units") > 0, value).alias("alpha"))
