"""Token usage and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.exact import half_up, ratio, whole
from evalspark.functions.text import is_rate_limit, to_bool, to_float, to_int

#: Both providers' names; every leaf is read as text, since some write numbers as strings.
_DETAILS = "struct<cached_tokens:string,cache_write_tokens:string,reasoning_tokens:string>"
USAGE = (
    "prompt_tokens string, input_tokens string, completion_tokens string, output_tokens string, total_tokens string, cost string, is_byok string,"
    f"prompt_tokens_details {_DETAILS}, input_tokens_details {_DETAILS}, completion_tokens_details {_DETAILS}, output_tokens_details {_DETAILS},"
    "cost_details struct<upstream_inference_cost:string,upstream_inference_prompt_cost:string,upstream_inference_completions_cost:string>, __bad string"
)


def with_metrics(rows: DataFrame, json: str = "response_usage", prices: DataFrame | None = None) -> DataFrame:
    """Typed metrics of the usage object, whatever the provider's names; bad objects and values are null. With ``prices``
    (see estimated_cost) the estimate is the cost of rows that tell none.

    The JSON is parsed once; only an object that does not fit is parsed again, to tell odd values from broken text.
    """
    u = lambda path: F.col(f"__u.{path}")
    either = lambda a, b: F.coalesce(u(a), u(b))
    prompt, completion = either("prompt_tokens_details", "input_tokens_details"), either("completion_tokens_details", "output_tokens_details")
    parsed = rows.withColumn("__u", F.from_json(json, USAGE, {"columnNameOfCorruptRecord": "__bad"}))
    filled = F.col(json).rlike(r"^\s*\{\s*[^\s}]")
    m = {
        "prompt_tokens": to_int(either("prompt_tokens", "input_tokens")),
        "completion_tokens": to_int(either("completion_tokens", "output_tokens")),
        "total_tokens": to_int(u("total_tokens")),
        "reasoning_tokens": to_int(completion["reasoning_tokens"]),
        "cached_prompt_tokens": to_int(prompt["cached_tokens"]),
        "cache_write_tokens": to_int(prompt["cache_write_tokens"]),
        "cost_usd": to_float(u("cost")),
        "upstream_cost_usd": to_float(u("cost_details.upstream_inference_cost")),
        "upstream_prompt_cost_usd": to_float(u("cost_details.upstream_inference_prompt_cost")),
        "upstream_completions_cost_usd": to_float(u("cost_details.upstream_inference_completions_cost")),
        "is_byok": to_bool(u("is_byok")),
        "has_usage": F.coalesce(filled & F.when(u("__bad").isNull(), True).otherwise(F.try_parse_json(json).isNotNull()), F.lit(False)),
    }
    latency = F.col("response_latency_ms")
    out = parsed.withColumns(m).drop("__u")
    if "response_text" in rows.columns:
        out = out.withColumn("char_count", F.length(F.coalesce("response_text", F.lit(""))).cast("long"))
    out = out.withColumn("tokens_per_second", F.when(latency > 0, ratio(1000 * F.col("total_tokens"), latency)))
    if prices is None:
        return out
    return estimated_cost(out, prices).withColumn("cost_usd", F.col("final_cost_usd")).drop("estimated_cost_usd", "final_cost_usd")


def estimated_cost(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost where the provider gave none and the model has a price. ``prices`` (one row per model; a small dimension
    that Spark broadcasts by its size): input, cached_input, output in 1e-4 dollars per million tokens."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    cached = n(F.col("cached_prompt_tokens"))
    units = F.greatest(n(F.col("prompt_tokens")) - cached, F.lit(0)) * F.col("input") + cached * F.col("cached_input") + n(F.col("completion_tokens")) * F.col("output")
    known = F.col("prompt_tokens").isNotNull() | F.col("completion_tokens").isNotNull()
    estimate = F.when(F.col("input").isNotNull() & known, units / F.lit(1e10))
    return rows.join(prices, "model", "left").withColumns({"estimated_cost_usd": estimate, "final_cost_usd": F.coalesce("cost_usd", estimate)}).drop("input", "cached_input", "output")


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(whole(c)), F.lit(0)).cast("long")


#: What the summary adds up: tokens and characters as whole numbers, money to 10 decimals.
TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens", "reasoning_tokens", "cached_prompt_tokens", "cache_write_tokens", "char_count")
MONEY = ("cost_usd", "upstream_cost_usd", "upstream_prompt_cost_usd", "upstream_completions_cost_usd")


def usage_summary(rows: DataFrame) -> DataFrame:
    """Counters, sums and averages per model and over all rows (model null). Averages are over the rows that have the
    metric; sums of money and rates are exact. Rows are added up per model once and models then rolled up."""
    if "char_count" not in rows.columns:
        rows = rows.withColumn("char_count", F.lit(None).cast("long"))
    tps4 = F.round(F.col("tokens_per_second") * 10000).cast("long")
    counts = {
        "rows": F.count(F.lit(1)),
        "error_rows": F.count_if(F.col("error") != ""),
        "success_rows": F.count_if(F.col("error") == ""),
        "rows_with_usage": F.count_if("has_usage"),
        "rows_with_total_tokens": F.count("total_tokens"),
        "rows_with_cost": F.count("cost_usd"),
        "rows_with_latency": F.count("response_latency_ms"),
        "rows_with_tokens_per_second": F.count("tokens_per_second"),
        "rows_with_byok_true": F.count_if("is_byok"),
    }
    sums = {f"{c}_total": _sum(c) for c in TOKENS}
    money = {f"{c}_total": F.sum(F.col(c).cast("decimal(28,10)")) for c in MONEY}
    rest = {"latency_ms_total": _sum("response_latency_ms"), "tps4_total": F.coalesce(F.sum(tps4), F.lit(0)).cast("long")}
    per = rows.groupBy("model").agg(*[c.alias(n) for n, c in (counts | sums | money | rest).items()])
    again = [F.sum(c).alias(c) for c in per.columns if c != "model"]
    g = per.groupingSets([["model"], []], "model").agg(*again)
    whole_totals = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in (*counts, *sums, "latency_ms_total")]
    return g.select(
        F.coalesce("model", F.lit("ALL")).alias("model"),
        *whole_totals,
        *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in money],
        (F.coalesce(F.col("tps4_total"), F.lit(0)) / F.lit(10000.0)).alias("tokens_per_second_total"),
        ratio(F.col("total_tokens_total"), F.col("rows_with_total_tokens")).alias("avg_total_tokens"),
        ratio(F.col("latency_ms_total"), F.col("rows_with_latency"), 2).alias("avg_latency_ms"),
        (half_up(F.col("tps4_total"), F.col("rows_with_tokens_per_second")) / F.lit(10000.0)).alias("avg_tokens_per_second"),
    )


def ordered(summary: DataFrame) -> DataFrame:
    """Models by falling total tokens, then name, with their ``place``; the row over all comes first. One row a model."""
    all_first = F.when(F.col("model") == "ALL", 0).otherwise(1)
    return summary.withColumn("place", F.row_number().over(Window.orderBy(all_first, F.col("total_tokens_total").desc(), "model"))).orderBy("place")


def collection_stats(responses: DataFrame, events: DataFrame) -> DataFrame:
    """One row: outcome of the responses and attempts and requeues in the event log."""
    limited = is_rate_limit(F.lit(None).cast("string"), F.lit(None).cast("int"), F.col("error"))
    r = responses.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("error") != "").alias("errors"), F.count_if(F.col("error") == "").alias("successes"), F.count_if(limited).alias("final_rate_limit_errors"))
    tries = F.count_if(F.col("event").isin("start", "task_rate_limit_requeue")).alias("tries")
    e = events.groupBy("sample_id").agg(tries, F.count_if(F.col("event") == "task_rate_limit_requeue").alias("requeues"))
    e = e.agg(F.sum("tries").alias("attempts"), F.max("tries").alias("max_attempt"), F.sum("requeues").alias("requeues"))
    return r.join(e)  # one row each
