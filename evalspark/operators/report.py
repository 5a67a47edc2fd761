"""Rows of a run's report: responses with their judges and consensus, errors of all phases, and cost against score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.exact import ratio
from evalspark.operators.leaderboard import summarize


def report_rows(responses: DataFrame, consensus: DataFrame) -> DataFrame:
    """Responses (``sample_id``, ``error`` and any columns) with ``judges``, ``c4`` and ``consensus_error`` of their
    consensus rows, ``status`` and ``report_error``: the response's error, the judges' and the consensus', joined.
    Responses without a consensus row stay."""
    none = F.lit("")
    p = consensus.select("sample_id", "judges", "c4", "consensus_error")
    graded = F.transform("judges", lambda j, i: F.when(j["error"] != "", F.concat(F.lit("judge"), (i + 1).cast("string"), F.lit(": "), j["error"])))
    errors = F.concat(F.array(F.nullif(F.coalesce("error", none), none)), F.coalesce(graded, F.array().cast("array<string>")), F.array(F.concat(F.lit("consensus: "), F.nullif("consensus_error", none))))
    out = responses.join(p, "sample_id", "left").withColumn("report_error", F.array_join(F.array_compact(errors), " | "))
    return out.withColumn("status", F.when(F.col("report_error") != "", "error").otherwise("ok"))


def report_errors(rows: DataFrame) -> DataFrame:
    """Errors of all phases of report rows, each with its phase and judge; one pass over the rows."""
    none = F.lit("")
    fact = lambda phase, judge, error: F.struct(F.lit(phase).alias("phase"), judge.alias("judge_model"), error.alias("error"))
    graded = F.transform("judges", lambda j, i: F.when(j["error"] != "", fact("grade", F.concat(F.lit("judge"), (i + 1).cast("string")), j["error"])))
    others = F.array(F.when(F.coalesce("error", none) != "", fact("collect", none, F.col("error"))), F.when(F.coalesce("consensus_error", none) != "", fact("aggregate", none, F.col("consensus_error"))))
    every = F.array_compact(F.concat(others, F.coalesce(graded, F.array())))
    return rows.select("sample_id", "model", "question_id", F.explode(every).alias("e")).select("sample_id", "model", "question_id", "e.*")


def cost_against_score(consensus: DataFrame, metrics: DataFrame, by: str = "model") -> DataFrame:
    """Per ``by``: the share of questions in bucket 2, and the averages of reasoning tokens and of cost (to 1e-8 dollars)
    over the responses that have them."""
    money = F.col("cost_usd").cast("decimal(28,10)")
    per = metrics.groupBy(by).agg(F.sum("reasoning_tokens").alias("tokens"), F.count("reasoning_tokens").alias("n"), F.sum(money).alias("cost"), F.count("cost_usd").alias("paid"))
    cost = F.when(F.col("paid") > 0, F.round(F.col("cost") / F.col("paid"), 8).cast("double"))
    return summarize(consensus, (by,)).join(per, by).select(by, "detection_rate_score_2", ratio(F.col("tokens"), F.col("n")).alias("avg_reasoning_tokens"), cost.alias("avg_cost_usd"))
