"""Publishing: keyed merges, redaction, coverage and first-seen windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.text import base_model, redacted


#: Ending of the names of columns and fields that hold grade folders.
GRADE_DIR = "_grade_dir"


def merge(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``existing`` with ``incoming`` merged in by key: the incoming row replaces, equal keys keep their last row (by
    ``order``), rows with a blank key are all kept. ``side``: 0 existing, 1 incoming."""
    both = existing.withColumn("side", F.lit(0)).unionByName(incoming.withColumn("side", F.lit(1)), allowMissingColumns=True)
    blank = F.coalesce(F.trim(key), F.lit("")) == ""
    rest = [c for c in both.columns if c != key]
    last = both.filter(~blank).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("side", *order)).alias("r")).select(key, "r.*")
    return last.unionByName(both.filter(blank).select(key, *rest))


def merge_counts(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """One row: keys that the merge adds and replaces, and blank rows that it appends."""
    side = lambda df, name: df.groupBy(F.coalesce(F.trim(key), F.lit("")).alias("k")).agg(F.count(F.lit(1)).alias(name))
    both = side(existing, "old").join(side(incoming, "new"), "k", "full_outer")
    named = F.col("k") != ""
    return both.agg(
        F.count_if(named & F.col("old").isNull()).alias("added"),
        F.count_if(named & F.col("old").isNotNull() & F.col("new").isNotNull()).alias("replaced"),
        F.coalesce(F.sum(F.when(~named, F.col("new"))), F.lit(0)).alias("blank_appended"),
    )


def publish(existing: DataFrame | None, incoming: DataFrame, key: str, order: Sequence[str], mode: str = "auto") -> DataFrame:
    """merge, or replace where there is nothing to merge with (``auto``) or that is asked for (``replace``)."""
    if mode == "replace" or existing is None:
        return incoming
    return merge(existing, incoming, key, order).drop("side")


def _redacted(c: Column, kind: T.DataType) -> Column:
    """A value of any type with local paths blanked in all its texts, and without fields and keys that name grade
    folders. Keys of maps stay as they are."""
    if isinstance(kind, T.StringType):
        return redacted(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _redacted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        held = F.map_filter(c, lambda k, v: ~k.endswith(GRADE_DIR)) if isinstance(kind.keyType, T.StringType) else c
        return F.transform_values(held, lambda k, v: _redacted(v, kind.valueType))
    if isinstance(kind, T.StructType):
        kept = [f for f in kind if not f.name.endswith(GRADE_DIR)]
        return F.when(c.isNotNull(), F.struct(*[_redacted(c.getField(f.name), f.dataType).alias(f.name) for f in kept]) if kept else F.lit(None))
    return c


def redact(df: DataFrame) -> DataFrame:
    """Local paths blanked in every text, however deep it lies; columns and fields that name grade folders dropped."""
    return df.select(*[_redacted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema if not f.name.endswith(GRADE_DIR)])


def slim(df: DataFrame, raw: str = "response_raw", drop: Sequence[str] = ("request_messages",)) -> DataFrame:
    """Without raw payloads; the model that answered is kept from them."""
    model = F.get_json_object(raw, "$.model")
    have = F.nullif(F.trim("response_model_snapshot"), F.lit("")) if "response_model_snapshot" in df.columns else F.lit(None).cast("string")
    return df.withColumn("response_model_snapshot", F.coalesce(have, model, F.lit(""))).drop(raw, *drop)


def coverage(df: DataFrame) -> DataFrame:
    """(column, rows, filled, objects): rows whose value is there and, for texts, not blank; and rows whose value is an
    object: a struct or map that is there, a VARIANT or text that holds a JSON object. One pass over the table."""

    def filled(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return c.isNotNull() & (F.trim(c) != "") if isinstance(f.dataType, T.StringType) else c.isNotNull()

    def is_object(f: T.StructField) -> Column:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, (T.StructType, T.MapType)):
            return c.isNotNull()
        if isinstance(kind, T.VariantType):
            return F.coalesce(F.schema_of_variant(c).startswith("OBJECT"), F.lit(False))
        if isinstance(kind, T.StringType):  # few texts begin like an object, so few are parsed
            return F.coalesce(F.when(F.ltrim(c).startswith("{"), F.try_parse_json(c).isNotNull()), F.lit(False))
        return F.lit(False)

    one = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.struct(F.count_if(filled(f)).alias("filled"), F.count_if(is_object(f)).alias("objects")).alias(f.name) for f in df.schema])
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").alias("c")) for f in df.schema])
    return one.select(F.explode(pairs).alias("p"), F.col("__rows").alias("rows")).select("p.column", "rows", "p.c.filled", "p.c.objects")


def first_seen(rows: DataFrame, saved: DataFrame) -> DataFrame:
    """Earliest time per name over new rows and what was saved before (both: name, ts)."""
    return rows.select("name", "ts").unionByName(saved.select("name", "ts")).filter("ts is not null").groupBy("name").agg(F.min("ts").alias("first_seen"))


def recent_additions(rows: DataFrame, saved: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Models and base models (``kind``) now in the data, when they were first seen, and whether within ``days``."""
    both = F.array(F.struct(F.lit("model").alias("kind"), F.col("model").alias("name")), F.struct(F.lit("base").alias("kind"), base_model(F.col("model")).alias("name")))
    now = rows.select(F.explode(both).alias("k"), "ts").groupBy("k.kind", "k.name").agg(F.min("ts").alias("seen"))
    joined = now.join(saved.groupBy("kind", "name").agg(F.min("ts").alias("before")), ["kind", "name"], "left")
    first = F.least("seen", "before")
    start = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {max(1, days)} days")
    return joined.select("kind", "name", first.alias("first_seen"), F.coalesce(first >= start, F.lit(False)).alias("recent"))


def model_sets(rows: DataFrame) -> DataFrame:
    """Models and base models in the data (``kind``, ``name``), each once."""
    both = F.array(F.struct(F.lit("model").alias("kind"), F.col("model").alias("name")), F.struct(F.lit("base").alias("kind"), base_model(F.col("model")).alias("name")))
    return rows.select(F.explode(both).alias("k")).select("k.*").filter("name <> ''").distinct()


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of every published table and how far its columns are filled: ``table``, ``column``, ``rows``, ``filled``,
    ``objects`` (see coverage)."""
    parts = [coverage(df).select(F.lit(name).alias("table"), "column", "rows", "filled", "objects") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


#: Counters of a collection that add up over merged publishes.
ADDED = ("attempt_count", "rate_limit_requeue_count", "final_rate_limit_error_count")


def accumulated(previous: DataFrame, incoming: DataFrame, responses: DataFrame, added_rows: int, mode: str = "merge") -> DataFrame:
    """One row: a publish's collection counters from the rows (one each) of the previous and the incoming collection.

    ``replace`` takes the incoming ones; a merge that adds responses adds them up; one that adds none keeps the previous
    ones. Totals are counted from the merged ``responses``; the largest attempt is theirs, or else the larger known one.
    """
    zero = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(0)).cast("long")
    both = previous.alias("old").join(incoming.alias("new"))  # one row each
    of = {"replace": lambda c: zero("new", c)}.get(mode, (lambda c: zero("old", c) + zero("new", c)) if added_rows > 0 else lambda c: zero("old", c))
    counters = both.select(*[of(c).alias(c) for c in ADDED], F.greatest(zero("old", "max_attempt_observed"), zero("new", "max_attempt_observed")).alias("__known"))
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    totals = responses.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(failed).alias("error_count"), F.count_if(~failed).alias("success_count"), F.max("collect_attempt").cast("long").alias("__seen"))
    made = counters.join(totals)  # one row each
    return made.withColumns({"max_attempt_observed": F.coalesce("__seen", "__known"), "new_rows_processed": F.lit(added_rows).cast("long")}).drop("__seen", "__known")
