"""Checks that tables hold what they should."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_done(tasks: DataFrame, checkpoint: DataFrame, key: str = "sample_id") -> DataFrame:
    """Tasks that the checkpoint does not hold."""
    return tasks.join(checkpoint.select(key), key, "left_anti")


def stale(tasks: DataFrame, checkpoint: DataFrame, key: str = "sample_id") -> DataFrame:
    """Checkpoint ids that no task has; must be empty."""
    return checkpoint.select(key).distinct().join(tasks.select(key), key, "left_anti")


def duplicates(rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """Blank ids and ids on several rows; must be empty."""
    return rows.groupBy(F.coalesce(F.trim(key), F.lit("")).alias(key)).count().filter((F.col("count") > 1) | (F.col(key) == ""))


def report(expected: DataFrame, actual: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row: rows on either side, duplicate, missing and unexpected ids."""
    side = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = side(expected, "want").join(side(actual, "have"), key, "full_outer")
    return both.agg(
        F.coalesce(F.sum("want"), F.lit(0)).alias("expected_rows"),
        F.coalesce(F.sum("have"), F.lit(0)).alias("actual_rows"),
        F.count_if(F.col("have") > 1).alias("duplicate_ids"),
        F.count_if(F.col("have").isNull()).alias("missing_ids"),
        F.count_if(F.col("want").isNull()).alias("unexpected_ids"),
    )


def outside(rows: DataFrame, allowed: DataFrame, key: str = "sample_id") -> DataFrame:
    """Ids of ``rows`` that ``allowed`` lacks (blank ones apart); must be empty before a report is made."""
    named = rows.select(key).filter(F.coalesce(F.trim(key), F.lit("")) != "").distinct()
    return named.join(allowed.select(key), key, "left_anti")


def other_judge(checkpoint: DataFrame, judge_model: str) -> DataFrame:
    """Checkpoint rows that another judge has graded; must be empty before grading goes on."""
    given = F.coalesce(F.trim("judge_model"), F.lit(""))
    return checkpoint.filter((given != "") & (given != judge_model))


def require_empty(df: DataFrame, message: str) -> None:
    """Fail with a few of the offending rows."""
    bad = df.limit(5).collect()
    if bad:
        raise ValueError(f"{message}: {[r.asDict() for r in bad]}")


def sources(rows: DataFrame, column: str) -> DataFrame:
    """One row: how many values ``column`` has, and whether there is one at most."""
    return rows.agg(F.count_distinct(column).alias("sources")).withColumn("single", F.col("sources") <= 1)


def single_source(rows: DataFrame, column: str) -> None:
    """All rows must come from one responses file."""
    require_empty(sources(rows, column).filter("not single"), f"rows differ in {column}")
