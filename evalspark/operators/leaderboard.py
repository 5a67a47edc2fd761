"""Per-model summaries, ranks and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.exact import half_up, ratio
from evalspark.functions.text import base_model, level_of, modern_org, org_of
from evalspark.operators.order import numbered
from evalspark.operators.panel import UNIT, bucket


def count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def mean4(c4: Column) -> Column:
    """Mean of ten-thousandths as a double of 4 decimals."""
    return half_up(F.sum(c4), F.count(c4)) / F.lit(float(UNIT))


def summarize(rows: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Counts and rates per group over consensus rows (c4, is_control, status).

    Buckets: controls count only in score_3, other rows in their own bucket; the average is over rounded consensus
    scores of rows that are no controls. Rates are null without rows.
    """
    b, plain = bucket(F.col("c4")), ~F.col("is_control")
    scored = F.col("c4").isNotNull()
    s = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        count(F.col("status") == "error").alias("error_count"),
        count(scored).alias("scored_count"),
        count(scored & plain).alias("nonsense_count"),
        count(scored & ~plain).alias("control_count"),
        count((b == 0) & plain).alias("score_0"),
        count((b == 1) & plain).alias("score_1"),
        count((b == 2) & plain).alias("score_2"),
        count(b == 3).alias("score_3"),
        mean4(F.when(plain, F.col("c4"))).alias("avg_score"),
    )
    return s.withColumns(
        {
            "detection_rate_score_2": ratio(F.col("score_2"), F.col("nonsense_count")),
            "full_engagement_rate_score_0": ratio(F.col("score_0"), F.col("nonsense_count")),
            "control_correct_rate_score_3": ratio(F.col("score_3"), F.col("control_count")),
        }
    )


def ranked(summary: DataFrame, first: str = "model") -> DataFrame:
    """``rank`` 1..n without ties: average, then detection (nulls last), then first appearance.

    The window has no partition, but its rows are a leaderboard's: one per model.
    """
    order = Window.orderBy(F.col("avg_score").desc_nulls_last(), F.col("detection_rate_score_2").desc_nulls_last(), first)
    return summary.withColumn("rank", F.row_number().over(order))


def judge_summary(grades: DataFrame) -> DataFrame:
    """One judge's scores per model, with control and other questions in counters of their own. A score of 3 on a
    question that is no control gives no points but counts in the average's denominator."""
    s, control = F.col("score"), F.col("is_control")
    valid = s.between(0, 3)
    cells = {f"{name}_score_{v}": count((s == v) & which) for name, which in (("nonsense", ~control), ("control", control)) for v in range(4)}
    g = grades.groupBy("judge_model", "model").agg(
        F.count(F.lit(1)).alias("count"),
        count(F.col("error") != "").alias("error_count"),
        count(valid).alias("scored_count"),
        count(valid & ~control).alias("nonsense_count"),
        count(valid & control).alias("control_count"),
        *[c.alias(n) for n, c in cells.items()],
        *[count(s == v).alias(f"score_{v}") for v in range(4)],
    )
    return g.withColumns(
        {
            "avg_score": ratio(F.col("nonsense_score_1") + 2 * F.col("nonsense_score_2"), F.col("nonsense_count")),
            "detection_rate_score_2": ratio(F.col("nonsense_score_2"), F.col("nonsense_count")),
            "full_engagement_rate_score_0": ratio(F.col("nonsense_score_0"), F.col("nonsense_count")),
            "control_correct_rate_score_3": ratio(F.col("control_score_3"), F.col("control_count")),
        }
    )


def breakdown(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Rows scored and their average consensus per group."""
    return rows.filter("c4 is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), mean4(F.col("c4")).alias("avg_score"))


def run_averages(rows: DataFrame) -> DataFrame:
    return breakdown(rows.filter(~F.col("is_control")), ("model", "run_index"))


def run_deviation(rows: DataFrame) -> DataFrame:
    """Population deviation of the rounded run averages; null with fewer than two runs."""
    return run_averages(rows).groupBy("model").agg(F.count(F.lit(1)).alias("runs"), F.when(F.count(F.lit(1)) >= 2, F.round(F.stddev_pop("avg_score"), 4)).alias("run_average_stddev"))


def bucket_mix(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Shares of buckets 2, 1 and 0 among rows that are no controls."""
    b = bucket(F.col("c4"))
    g = rows.filter("c4 is not null and not is_control").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[count(b == v).alias(f"b{v}") for v in (2, 1, 0)])
    return g.select(*by, "n", *[ratio(F.col(f"b{v}"), F.col("n")).alias(name) for v, name in ((2, "green"), (1, "amber"), (0, "red"))])


def saturation(rows: DataFrame, top: int) -> DataFrame:
    """Per question: how many of the ``top`` models were scored on it, how many reached bucket 2, and whether all of the
    top models did (one without a score has not)."""
    best = ranked(summarize(rows)).filter(F.col("rank") <= top).select("model")
    every = best.agg(F.count(F.lit(1)).alias("every"))  # one row
    hit = count(bucket(F.col("c4")) == 2)
    g = rows.filter("c4 is not null and not is_control").join(F.broadcast(best), "model", "left_semi").groupBy("question_id").agg(F.count(F.lit(1)).alias("models"), hit.alias("solved"))
    return g.join(F.broadcast(every)).withColumns({"solved_share": ratio(F.col("solved"), F.col("models")), "saturated": F.col("every") == F.col("solved")}).drop("every")


def org_votes(rows: DataFrame) -> DataFrame:
    """Each model's most frequent organisation; equal counts: the one seen first (by ``pos``)."""
    org = modern_org(F.trim(F.coalesce("model_org", F.lit(""))))
    votes = rows.select("model", org.alias("org"), "pos").filter("org <> ''").groupBy("model", "org").agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"))
    return votes.groupBy("model").agg(F.max_by("org", F.struct("votes", -F.col("first"))).alias("org"), F.max("votes").alias("votes"))


def last_by(df: DataFrame, keys: tuple[str, ...], order: str = "pos") -> DataFrame:
    """The last row per key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def enriched(board: DataFrame, votes: DataFrame, launches: DataFrame, params: DataFrame, as_of: str) -> DataFrame:
    """The leaderboard with organisation, launch date, age and size; dimensions' last rows win, missing ones stay null."""
    dates = last_by(launches, ("model_id",)).select("model_id", "launch_date")
    sizes = last_by(params, ("model_id",)).select("model_id", "total_params_b")
    day = F.lit(as_of).cast("date")
    age = F.when(F.col("launch_date") <= day, F.datediff(day, F.col("launch_date")))
    out = board.withColumn("model_id", base_model(F.col("model"))).join(votes.select("model", F.col("org").alias("voted")), "model", "left")
    out = out.join(dates, "model_id", "left").join(sizes, "model_id", "left")
    return out.withColumns({"org": F.coalesce("voted", org_of(F.col("model"))), "reasoning": level_of(F.col("model")), "model_age_days": age}).drop("voted")


def csv_rows(board: DataFrame, votes: DataFrame) -> DataFrame:
    """The leaderboard as it is exported: rank, names, average, and the shares of buckets 2 and 0 as green and red."""
    b = board.join(votes.select("model", F.col("org").alias("voted")), "model", "left")
    rates = (F.col("detection_rate_score_2").alias("green_rate"), F.col("full_engagement_rate_score_0").alias("red_rate"))
    return b.select("rank", "model", F.coalesce("voted", org_of(F.col("model"))).alias("org"), level_of(F.col("model")).alias("reasoning"), "avg_score", *rates, "score_2", "score_1", "score_0", "nonsense_count", "error_count")


def placed(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows with their ``place`` in the canonical order of all rows: by ``keys``, missing numbers as 0, missing texts as
    '' (see numbered)."""
    kinds = dict(rows.dtypes)
    return numbered(rows, [F.coalesce(F.col(k), F.lit("") if kinds[k] == "string" else F.lit(0)) for k in keys])


def compared(first: DataFrame, second: DataFrame) -> DataFrame:
    """Models of two leaderboards (of two benchmark versions): both averages and the change."""
    side = lambda df, n: df.select("model", F.col("avg_score").alias(n))
    change = F.round((F.col("second_avg") - F.col("first_avg")) * UNIT) / F.lit(float(UNIT))
    return side(first, "first_avg").join(side(second, "second_avg"), "model").withColumn("delta", change)
