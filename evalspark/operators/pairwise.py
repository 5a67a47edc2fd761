"""Pairwise preferences between models on the same question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.exact import quotient
from evalspark.functions.text import tag
from evalspark.operators.leaderboard import last_by
from evalspark.operators.panel import UNIT


def scored(rows: DataFrame) -> DataFrame:
    """The last scored row of each question and model."""
    keep = rows.filter("c4 is not null").select("question_id", "model", "c4", "technique", "domain", "sample_id", "pos")
    return last_by(keep, ("question_id", "model"))


def events(rows: DataFrame, version: str, extra_tags: Sequence[str] = ()) -> DataFrame:
    """Every two models of a question, the better one and the margin. The pairs are the result; both sides carry only
    what an event names, and a question's pairs are joined on its id."""
    side = lambda s: rows.select("question_id", *[F.col(c).alias(f"{s}_{c}") for c in ("model", "c4", "sample_id")], *(["technique", "domain"] if s == "a" else []))
    p = side("a").join(side("b"), "question_id").filter("a_model < b_model")
    winner = F.when(F.col("a_c4") > F.col("b_c4"), "system_a").when(F.col("a_c4") < F.col("b_c4"), "system_b").otherwise("tie")
    tags = F.array_distinct(F.array(F.lit(f"benchmark_{version}"), F.concat(F.lit("question_"), "question_id"), F.concat(F.lit("technique_"), tag(F.col("technique"))), F.concat(F.lit("domain_"), tag(F.col("domain"))), *map(F.lit, extra_tags)))
    return p.select(
        "question_id", F.col("a_model").alias("system_a"), F.col("b_model").alias("system_b"), winner.alias("winner"),
        (F.abs(F.col("a_c4") - F.col("b_c4")) / float(UNIT)).alias("score_margin"), tags.alias("tags"), F.col("a_sample_id").alias("sample_a"), F.col("b_sample_id").alias("sample_b"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """One row: models, questions, rows, events and ties, counted without making the pairs."""
    pairs = lambda n: quotient(n * (n - 1), F.lit(2).cast("long"))
    ties = rows.groupBy("question_id", "c4").agg(F.count(F.lit(1)).alias("n")).groupBy("question_id").agg(F.sum("n").alias("rows"), F.sum(pairs(F.col("n"))).alias("ties"))
    q = ties.agg(F.count(F.lit(1)).alias("questions"), F.sum("rows").alias("rows"), F.sum(pairs(F.col("rows"))).alias("events"), F.sum("ties").alias("ties"))
    return q.join(rows.agg(F.count_distinct("model").alias("models")))  # one row each


def reached(rows: DataFrame, n: int) -> DataFrame:
    """The questions that hold the first ``n`` events, with the number of their events and of those ``before``.

    A question of k models has k (k - 1) / 2 events, so no pair is made to find them; each of the first ``n`` questions
    with two models has one at least, so only these are added up.
    """
    pairs = rows.groupBy("question_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("question_id", quotient(F.col("k") * (F.col("k") - 1), F.lit(2).cast("long")).alias("events"))
    above = Window.orderBy("question_id").rowsBetween(Window.unboundedPreceding, -1)
    first = pairs.orderBy("question_id").limit(n)
    return first.withColumn("before", F.coalesce(F.sum("events").over(above), F.lit(0))).filter(F.col("before") < n)


def first_events(rows: DataFrame, version: str, n: int, extra_tags: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` of the events by question and models; pairs are made of the questions that hold them only."""
    held = rows.join(reached(rows, n).select("question_id"), "question_id", "left_semi")
    return events(held, version, extra_tags).orderBy("question_id", "system_a", "system_b").limit(n)


def as_json(made: DataFrame) -> DataFrame:
    """One JSON text per event, keys in order."""
    return made.select(F.to_json(F.struct(*sorted(made.columns))).alias("value"))
