"""Event logs: attempts, requeues and milestones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attempts(events: DataFrame) -> DataFrame:
    """The n-th try of every sample, in order of time."""
    order = Window.partitionBy("sample_id").orderBy("ts", "pos")
    return events.filter(F.col("event").isin("start", "task_rate_limit_requeue")).withColumn("attempt", F.row_number().over(order))


def requeues(events: DataFrame) -> DataFrame:
    return events.filter("event = 'task_rate_limit_requeue'").groupBy("model").agg(F.count(F.lit(1)).alias("requeues"), F.max("cooldown").cast("double").alias("max_cooldown"))


def daily(events: DataFrame) -> DataFrame:
    """Events per day and up to it. The running sum is over days, not events."""
    days = events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.withColumn("total", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def milestones(events: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """The n-th event by time for each of ``numbers`` that is reached.

    Its day is found from daily counts and its second from that day's counts per second, so only the events of such
    seconds are put in order, and a day with most of the events meets in no task.
    """
    wanted = F.explode(F.array(*[F.lit(n).cast("long") for n in numbers])).alias("milestone")
    days = daily(events).select("day", "n", "total", wanted).filter("milestone > total - n and milestone <= total")
    days = days.select("day", "milestone", (F.col("milestone") - F.col("total") + F.col("n")).alias("left"))
    timed = events.select("pos", "ts", F.to_date("ts").alias("day"), F.date_trunc("second", "ts").alias("second"))
    seconds = timed.join(days.select("day").distinct(), "day", "left_semi").groupBy("day", "second").agg(F.count(F.lit(1)).alias("n"))
    seconds = seconds.withColumn("total", F.sum("n").over(Window.partitionBy("day").orderBy("second")))
    found = seconds.join(days, "day").filter("left > total - n and left <= total").select("second", "milestone", (F.col("left") - F.col("total") + F.col("n")).alias("nth"))
    nth = timed.join(found.select("second").distinct(), "second", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("second").orderBy("ts", "pos")))
    return found.join(nth, ["second", "nth"]).select("milestone", "pos", "ts")
