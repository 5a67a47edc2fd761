"""Task grids: models, efforts, providers, overrides, questions and runs."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.functions.text import sample_id, variant_label
from evalspark.operators.order import numbered


def named_patterns(model: Column) -> Column:
    """The patterns that match a model, each once: '*', every part of its name that ends with '/' and '*' after it, and
    the name itself. So rules are found by equality, however many there are."""
    parts = F.split(model, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/*")))
    return F.array_distinct(F.array_append(F.array_append(F.slice(above, 1, F.size(above) - 1), model), F.lit("*")))


def specificity(pattern: Column) -> Column:
    """'*' under prefixes by length under exact names."""
    return F.when(pattern == "*", 0).when(pattern.endswith("/*"), F.length(pattern)).otherwise(1 << 30)


def provider_rules(spark: SparkSession, rules: Mapping[str, str]) -> DataFrame:
    """Rules of a settings file as the table that routed takes: ``pattern``, ``provider``."""
    return spark.createDataFrame(list(rules.items()), "pattern string, provider string")


def routed(models: DataFrame, rules: DataFrame, default: str, made: str = "provider") -> DataFrame:
    """``models`` with the provider of the most specific of ``rules`` (``pattern``, ``provider``; a pattern occurs once)
    that matches ``model_id``. Each model names the few patterns that match it, and these are joined by hash."""
    named = models.select("model_id").distinct().select("model_id", F.explode(named_patterns(F.col("model_id"))).alias("pattern"))
    best = named.join(rules.select("pattern", F.col("provider").alias("__p")), "pattern").groupBy("model_id").agg(F.max_by("__p", specificity(F.col("pattern"))).alias("__p"))
    return models.join(best, "model_id", "left").withColumn(made, F.coalesce("__p", F.lit(default))).drop("__p")


def leaves(value: Mapping, path: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    out = []
    for k, v in value.items():
        out += leaves(v, (*path, k)) if isinstance(v, Mapping) else [(".".join((*path, k)), json.dumps(v))]
    return out


def override_rules(spark: SparkSession, rules: Mapping[str, Mapping]) -> DataFrame:
    """Nested settings per pattern as the table that overrides takes: a row per leaf, ``pattern``, ``path``, ``value``."""
    return spark.createDataFrame([(pattern, *leaf) for pattern, nested in rules.items() for leaf in leaves(nested)], "pattern string, path string, value string")


def overrides(models: DataFrame, rules: DataFrame) -> DataFrame:
    """Settings of every model as (model_id, path, value as JSON): of the ``rules`` (``pattern``, ``path``, ``value``)
    whose patterns match, the more specific one wins leaf by leaf, and a plain value and an object at one place replace
    each other whole.

    A leaf stands at its path and counts at all places above it. It is beaten where a more specific leaf stands at or
    above its path, or counts at it: both are seen place by place, so leaves are never held against each other in pairs.
    """
    named = models.select("model_id").distinct().select("model_id", F.explode(named_patterns(F.col("model_id"))).alias("pattern"))
    found = named.join(rules, "pattern").withColumn("rank", specificity(F.col("pattern")))
    steps = F.split("path", r"\.")
    places = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "."))
    at = found.select("model_id", "path", "value", "rank", F.explode(places).alias("place"))
    here = Window.partitionBy("model_id", "place")
    standing, counting = F.max(F.when(F.col("path") == F.col("place"), F.col("rank"))).over(here), F.max("rank").over(here)
    beaten = F.when(F.col("path") == F.col("place"), counting > F.col("rank")).otherwise(F.coalesce(standing > F.col("rank"), F.lit(False)))
    judged = at.select("model_id", "path", "value", "rank", beaten.alias("beaten"))
    return judged.groupBy("model_id", "path", "rank").agg(F.max("value").alias("value"), F.bool_or("beaten").alias("beaten")).filter(~F.col("beaten")).select("model_id", "path", "value")


def variants(models: DataFrame, rules: DataFrame, default_provider: str, default_effort: str | None) -> DataFrame:
    """One row per model and effort: models without configured efforts (null) get the default one, those with an empty
    list run without one. Names and labels are built from the parts of the model id; ``rules`` as in routed."""
    plain = F.array(F.lit(default_effort).cast("string"))
    efforts = F.when(F.col("efforts").isNull(), plain).when(F.size("efforts") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.col("efforts"))
    named = F.col("model_id").contains("/")
    v = routed(models, rules, default_provider, "model_provider").select("model_id", "model_provider", F.posexplode(efforts).alias("effort_pos", "response_reasoning_effort")).withColumns(
        {
            "model_org": F.when(named, F.split_part("model_id", F.lit("/"), F.lit(1))).otherwise("unknown"),
            "model_name": F.when(named, F.regexp_replace("model_id", r"^[^/]*/", "")).otherwise(F.col("model_id")),
            "model_reasoning_level": F.coalesce("response_reasoning_effort", F.lit("default")),
        }
    )
    v = v.withColumn("model_row", variant_label(F.col("model_name"), F.col("model_reasoning_level")))
    return v.withColumn("model_label", F.concat("model_org", F.lit("/"), "model_row"))


def task_grid(models: DataFrame, questions: DataFrame, runs: int, run_id: str) -> DataFrame:
    """Every run of every question by every variant, with its sample id. The grid is the result, so it is a product;
    runs multiply inside each row and Spark broadcasts the smaller side by its size."""
    run = F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run_index")
    grid = models.select("*", run).crossJoin(questions)
    return grid.withColumn("sample_id", sample_id(F.lit(run_id), F.col("question_id"), F.col("model_label"), F.col("run_index")))


def seeded_order(rows: DataFrame, seed: int, key: str = "sample_id") -> DataFrame:
    """Rows with their ``place`` in a shuffled order that depends on the seed alone (see numbered)."""
    return numbered(rows, [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary")), F.col(key)])


def first_of(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row per key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("__n = 1").drop("__n")


def known_settings(settings: DataFrame, models: DataFrame) -> DataFrame:
    """Per-model settings (``pattern``) that apply to some selected model: each model names the patterns that match it."""
    return settings.join(models.select(F.explode(named_patterns(F.col("model_id"))).alias("pattern")).distinct(), "pattern", "left_semi")
