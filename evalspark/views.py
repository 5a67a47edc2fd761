"""Views that give the test tables the shapes of evaluation data (whole-number arithmetic only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.exact import quotient

DOMAIN_NAMES = ("software", "finance", "legal", "medical", "physics")
LEVEL_NAMES = ("none", "low", "high", "default")
#: The window of the recent-additions report and the launch review end on these days.
EVENTS_AS_OF, LAUNCH_AS_OF = "2024-01-31 00:00:00", "2024-06-30"
IDENTITY = ("model", "run_index", "question_id", "technique", "domain", "is_control")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))


def model_base(i: Column) -> Column:
    return F.concat(F.lit("org"), (i % 5).cast("string"), F.lit("/m"), i.cast("string"))


def model_name(i: Column) -> Column:
    level = pick(i % 4, LEVEL_NAMES)
    return F.concat(model_base(i), F.when(level == "default", "").otherwise(F.concat(F.lit("@reasoning="), level)))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 models by n/20 questions, one document as each response."""
    i, q = F.col("doc_id") % 20, quotient(F.col("doc_id"), F.lit(20).cast("long"))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("sample_id"),
        model_name(i).alias("model"),
        model_base(i).alias("model_id"),
        F.when(F.col("doc_id") % 50 == 7, "").when(F.col("doc_id") % 6 == 0, "alt").otherwise(F.concat(F.lit("org"), (i % 5).cast("string"))).alias("model_org"),
        pick(i % 4, LEVEL_NAMES).alias("model_reasoning_level"),
        (1 + q % 3).cast("int").alias("run_index"),
        F.concat(F.lit("q"), q.cast("string")).alias("question_id"),
        F.concat(F.lit("tech"), (q % 13).cast("string")).alias("technique"),
        pick(q % 5, DOMAIN_NAMES).alias("domain"),
        (q % 11 == 0).alias("is_control"),
        F.col("text").alias("response_text"),
        "n_chars",
        F.when(F.col("doc_id") % 37 == 0, "HTTP 429 rate limit").otherwise("").alias("error"),
    )


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of three judges in long form; judge 2 misses samples and changes some runs, judge 3 fails on some."""
    r = responses(spark, sf_dir).drop("response_text", "error")
    r = r.join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), "quality", "toxic"), "pos", "left")
    d, n = F.col("pos"), F.col("n_chars")
    raw = [F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1).otherwise(n % 3), (n + d) % 3, (7 * n + d) % 3]
    score = [F.when(F.col("is_control"), 3 * (x % 2)).otherwise(x).cast("int") for x in raw]
    failed = d % 29 == 0
    one = lambda k, s, e, run: F.struct(F.lit(k).alias("judge_idx"), F.lit(f"judge{k}").alias("judge_model"), s.alias("score"), e.alias("error"), run.alias("run_index"))
    run = F.col("run_index")
    rows = F.array_compact(
        F.array(
            one(1, score[0], F.lit(""), run),
            F.when(d % 23 != 0, one(2, score[1], F.lit(""), F.when(d % 41 == 0, run + 1).otherwise(run))),
            one(3, F.when(~failed, score[2]), F.when(failed, "parse").otherwise(""), run),
        )
    )
    return r.withColumn("g", F.explode(rows)).select("pos", "sample_id", "model", "model_id", "model_org", "question_id", "technique", "domain", "is_control", "g.*")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with their usage as JSON in the names of two providers, some numbers quoted."""
    k = F.col("o_orderkey")
    prompt, completion = 10 + k % 2000, F.col("o_custkey") % 700
    reasoning = F.when(F.col("o_orderstatus") != "O", k % 300)
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    cost = F.when(k % 5 != 0, F.concat(quotient(cents, F.lit(100000).cast("long")).cast("string"), F.lit("."), F.lpad((cents % 100000).cast("string"), 5, "0")))
    quoted = lambda c: F.when(k % 3 == 0, F.concat(F.lit('"'), c.cast("string"), F.lit('"'))).otherwise(c.cast("string"))
    text = lambda c: F.coalesce(quoted(c), F.lit("null"))
    plain = F.col("o_orderstatus").isin("F", "P")
    name = lambda a, b: F.when(plain, a).otherwise(b)
    json = F.concat(
        F.lit('{"'), name("prompt_tokens", "input_tokens"), F.lit('": '), text(prompt),
        F.lit(', "'), name("completion_tokens", "output_tokens"), F.lit('": '), text(completion),
        F.lit(', "total_tokens": '), text(prompt + completion),
        F.lit(', "'), name("prompt_tokens_details", "input_tokens_details"), F.lit('": {"cached_tokens": '), text(prompt % 7), F.lit(', "cache_write_tokens": '), text(completion % 5),
        F.lit('}, "'), name("completion_tokens_details", "output_tokens_details"), F.lit('": {"reasoning_tokens": '), text(reasoning),
        F.lit('}, "cost": '), text(cost), F.lit(', "is_byok": '), F.when(k % 4 == 0, "true").when(k % 4 == 1, '"False"').otherwise("null"),
        F.lit(', "cost_details": {"upstream_inference_cost": '), text(cost), F.lit("}}"),
    )
    return read(spark, sf_dir, "orders").select(
        k.alias("sample_id"), F.col("o_orderpriority").alias("model"), json.alias("response_usage"), (k % 5000).alias("response_latency_ms"), F.concat(F.lit("answer "), k.cast("string")).alias("response_text"), F.when(k % 31 == 0, "HTTP 500").otherwise("").alias("error")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped_events(read(spark, sf_dir, "events"))


def shaped_events(raw: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "task_rate_limit_requeue").when(F.col("event_type") == "signup", "start").otherwise("task_complete")
    return raw.select(
        F.col("event_id").alias("pos"),
        "ts",
        F.concat(F.lit("m"), (F.col("user_id") % 10).cast("string")).alias("model"),
        F.col("user_id").alias("sample_id"),
        kind.alias("event"),
        F.when(F.col("value") > 400, "error").otherwise("ok").alias("status"),
        F.col("value").cast("decimal(18,2)").alias("cooldown"),
    )


def launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Launch dates of the 20 models, given many times: the last one counts."""
    p = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(p.alias("pos"), model_base(p % 20).alias("model_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("launch_date"))


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    size = F.when(p % 3 != 0, F.col("p_retailprice").cast("decimal(18,2)"))
    return read(spark, sf_dir, "part").select(p.alias("pos"), model_base(p % 20).alias("model_id"), size.alias("total_params_b"))


def line_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A published table and an incoming one with the same keys in part; some keys are blank."""
    t = read(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_orderkey") % 97 == 0, "").otherwise(F.col("l_orderkey").cast("string")).alias("key"),
        "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("decimal(18,2)").alias("qty"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
    )
    return t.filter("l_linenumber <= 4"), t.filter("l_linenumber >= 3")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    tail = F.concat(F.lit("m"), (c % 50).cast("string"))
    model = F.when(c % 13 == 0, tail).otherwise(F.concat(F.lit("org"), (c % 50 % 5).cast("string"), F.lit("/"), tail))
    source = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "config").when(F.col("c_mktsegment") == "BUILDING", "latest").otherwise("runs")
    return read(spark, sf_dir, "customer").select(model.alias("model_id"), source.alias("source"), F.concat(model, F.lit("@reasoning="), pick(c % 4, LEVEL_NAMES)).alias("variant"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Launch evidence made of the pages' urls: some dates blank, malformed, future or unequal."""
    p = F.col("page_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (p % 150).cast("int")), "yyyy-MM-dd")
    proposed = F.when(p % 11 == 0, "").when(p % 13 == 0, "2024-1-5").when(p % 17 == 0, "2025-01-01").otherwise(day)
    return read(spark, sf_dir, "pages").select(
        p.alias("pos"),
        F.concat(F.lit("org"), (p % 3).cast("string"), F.lit("/m"), (p % 70).cast("string")).alias("model_id"),
        F.concat(F.lit("org"), (p % 3).cast("string")).alias("org"),
        F.when(p % 31 == 0, "").otherwise(F.col("url")).alias("evidence_url"),
        F.concat(F.lit("Release of M"), (p % 140).cast("string")).alias("evidence_title"),
        proposed.alias("proposed_launch_date"),
        F.when(p % 23 == 0, "").when(p % 19 == 0, "2024-02-02").otherwise(proposed).alias("evidence_published_date"),
        pick(p % 5, ("announcement_blog", "newsroom", "docs_release_note", "changelog", "tweet")).alias("evidence_type"),
        F.when(p % 29 == 0, "").otherwise("now available").alias("supporting_snippet"),
    )


#: First-party domains of the organisations in ``evidence``.
ALLOWED = {"org0": ["example.com", "example.net"], "org1": ["example.net", "example.org"], "org2": ["example.com", "example.org"]}


def model_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models that the responses name, with the reasoning efforts configured for some (empty: none)."""
    i = F.regexp_extract("model_id", r"/m(\d+)$", 1).cast("int")
    efforts = F.when(i % 3 == 0, F.array(F.lit("low"), F.lit("high"))).when(i % 3 == 2, F.array().cast("array<string>"))
    return responses(spark, sf_dir).select("model_id").distinct().select("model_id", i.alias("pos"), efforts.alias("efforts"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question_id"), F.col("item_id").alias("pos"), F.col("text").alias("question"), (F.col("item_id") % 11 == 0).alias("is_control"))


