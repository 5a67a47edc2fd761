"""Queries over files, guards, exports and small rules, registered beside those of ``registry``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from evalspark import views as v
from evalspark.functions import text as t
from evalspark.operators import expand, inference, integrity, leaderboard, metadata, pairwise, publish, reliability, usage
from evalspark.plans.registry import JUDGES, _attempts, _pairs, _prices, aligned, board, query, scored
from evalspark.scratch import scratch_dir
from evalspark.sources import files

#: The judge whose grades a resumed run goes on with, and when evidence is collected.
JUDGE, COLLECTED_AT = "judge1", "2024-06-30T00:00:00Z"


def _plain(spark, sf_dir):
    return v.responses(spark, sf_dir).select("sample_id", "model", "run_index", "is_control", "error")


@query
def jsonl_roundtrip(spark, sf_dir):
    path, rows = scratch_dir(spark), _plain(spark, sf_dir)
    files.write_jsonl(rows, path)
    return files.strict_jsonl(spark, path, rows.schema)


@query
def csv_roundtrip(spark, sf_dir):
    """Texts with line ends and quotes survive; a column that the table lacks is empty."""
    path = scratch_dir(spark)
    rows = v.responses(spark, sf_dir).select("sample_id", "run_index", F.concat(F.lit('a "b",\n'), "model").alias("model"))
    files.write_csv(rows, path, ["sample_id", "run_index", "model", "note"])
    return files.csv_table(spark, path, "sample_id string, run_index int, model string, note string").select("sample_id", "run_index", F.length("model").cast("long").alias("n"), F.coalesce("note", F.lit("")).alias("note"))


@query
def run_history(spark, sf_dir):
    """Rows of all run folders, with the folder each came from."""
    path, rows = scratch_dir(spark), _plain(spark, sf_dir).select("sample_id", "model", F.col("run_index").alias("run"))
    rows.write.partitionBy("run").json(path)
    return files.run_history(spark, path, "*.json", "sample_id string, model string")


@query
def event_log(spark, sf_dir):
    """Two appends to one log."""
    path, e = scratch_dir(spark), v.events(spark, sf_dir).select("pos", "event", "model")
    files.append_events(e.filter("event = 'start'"), path)
    files.append_events(e.filter("event <> 'start'"), path)
    return files.strict_jsonl(spark, path, e.schema).groupBy("event", "model").agg(F.count(F.lit(1)).alias("n"))


@query
def pairwise_event_log(spark, sf_dir):
    """One JSON text per event with its keys in order, written and read again."""
    path = scratch_dir(spark)
    pairwise.as_json(pairwise.events(_pairs(spark, sf_dir), "v1")).write.text(path)
    x = F.from_json("value", "question_id string, score_margin double, system_a string, system_b string, winner string")
    keys = F.array_join(F.regexp_extract_all("value", F.lit(r'"(\w+)":'), F.lit(1)), ",")
    return spark.read.text(path).select(x.alias("x"), keys.alias("keys")).select("x.*", "keys")


@query
def grade_set(spark, sf_dir):
    """One judge's grades as a file, read with its checks."""
    path = scratch_dir(spark)
    rows = v.grades(spark, sf_dir).filter("judge_idx = 1").select("sample_id", "score", "judge_model")
    files.write_jsonl(rows, path)
    return files.grade_set(spark, path, rows.schema, 1)


def _bank(spark, sf_dir):
    r = v.questions(spark, sf_dir)
    return r.select(F.concat(F.lit("tech"), (F.col("pos") % 4).cast("string")).alias("technique"), F.col("question_id").alias("id"), "question", F.lit("w").alias("nonsensical_element"), v.pick(F.col("pos") % 5, v.DOMAIN_NAMES).alias("domain"), "is_control")


@query
def nested_questions(spark, sf_dir):
    """Questions nested by technique, some rows each, and flattened again, without controls."""
    nested = files.nested_bank(_bank(spark, sf_dir), 50)
    bank = nested.select(F.array(F.struct("technique", F.lit("d").alias("description"), "questions")).alias("techniques"))
    return files.flat_questions(bank).select("technique", "technique_description", "id", "question", "domain")


@query
def question_counts(spark, sf_dir):
    return files.question_counts(_bank(spark, sf_dir))


@query
def incomplete_questions(spark, sf_dir):
    """Questions of a bank in which some fields are blank and some ids occur twice."""
    q = _bank(spark, sf_dir).withColumn("question", F.when(F.col("technique") == "tech1", " ").otherwise(F.col("question")))
    return files.incomplete(q.unionByName(q.filter("domain = 'legal'")))


@query
def collect_review(spark, sf_dir):
    r = v.responses(spark, sf_dir)
    warned = F.when(F.col("pos") % 9 == 0, F.array(F.lit("slow"), F.lit("cut"))).otherwise(F.array().cast("array<string>"))
    return files.review_columns(r.withColumn("warnings", warned).drop("pos", "n_chars", "response_text", "domain"))


@query
def grade_review(spark, sf_dir):
    return files.review_columns(v.grades(spark, sf_dir).withColumn("judge_score", F.col("score")), files.GRADE_REVIEW)


def _published(spark, sf_dir):
    return {"responses": v.responses(spark, sf_dir), "aggregate": scored(spark, sf_dir).select("sample_id", "model", "c4", "status")}


@query
def dataset_manifest(spark, sf_dir):
    return publish.manifest(_published(spark, sf_dir))


@query
def published_dataset(spark, sf_dir):
    """Tables of a published folder and their rows; an absent dimension has its columns and none."""
    path, tables = scratch_dir(spark), _published(spark, sf_dir)
    params = v.params(spark, sf_dir).schema
    files.write_dataset(tables, path, {"model_params": params})
    read = {n: spark.read.parquet(f"{path}/{n}") for n in (*tables, "model_params")}
    rows = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows", F.lit(len(df.columns)).alias("columns")) for n, df in read.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def leaderboard_csv(spark, sf_dir):
    return leaderboard.csv_rows(board(spark, sf_dir), leaderboard.org_votes(v.responses(spark, sf_dir)))


@query
def canonical_order(spark, sf_dir):
    rows = scored(spark, sf_dir).select("sample_id", "model", "run_index", "question_id")
    return leaderboard.placed(rows, ("model", "run_index", "question_id")).select("sample_id", "model", "place")


@query
def collect_order(spark, sf_dir):
    rows = v.responses(spark, sf_dir).select("sample_id", "model", F.when(F.col("model_reasoning_level") != "default", F.col("model_reasoning_level")).alias("effort"), "run_index", "question_id")
    return leaderboard.placed(rows, ("model", "effort", "run_index", "question_id")).select("sample_id", "model", "place")


@query
def usage_order(spark, sf_dir):
    return usage.ordered(usage.usage_summary(usage.with_metrics(v.usage(spark, sf_dir), prices=_prices(spark)))).select("place", "model", "total_tokens_total")


@query
def reliability_bundle(spark, sf_dir):
    return reliability.bundle(aligned(spark, sf_dir), JUDGES)


@query
def report_input_guard(spark, sf_dir):
    """Ids of aggregates without a response and grade sets that the aggregate does not name."""
    r = v.responses(spark, sf_dir).select("sample_id", "pos")
    aggregate = r.select(F.when(F.col("pos") % 50 == 3, F.concat(F.lit("z"), "sample_id")).when(F.col("pos") % 50 == 4, "").otherwise(F.col("sample_id")).alias("sample_id"))
    g = v.grades(spark, sf_dir).select("judge_model", "pos")
    given, named = g.select("judge_model").distinct(), g.filter("pos % 23 = 0").select("judge_model").distinct()
    bad = integrity.outside(aggregate, r).select(F.lit("sample").alias("kind"), F.col("sample_id").alias("id"))
    return bad.unionByName(integrity.outside(given, named, "judge_model").select(F.lit("grade_set").alias("kind"), F.col("judge_model").alias("id")))


@query
def grade_resume(spark, sf_dir):
    """Samples still to be graded, and checkpoint rows of another judge or without a response."""
    g = v.grades(spark, sf_dir)
    tasks = v.responses(spark, sf_dir).select("sample_id")
    checkpoint = g.filter("judge_idx = 2").select("sample_id", F.when(F.col("pos") % 7 == 0, F.col("judge_model")).when(F.col("pos") % 7 == 1, "").otherwise(JUDGE).alias("judge_model"))
    of = lambda kind, df: df.select(F.lit(kind).alias("kind"), "sample_id")
    return of("to do", integrity.not_done(tasks, checkpoint)).unionByName(of("other judge", integrity.other_judge(checkpoint, JUDGE))).unionByName(of("stale", integrity.stale(tasks, checkpoint)))


@query
def grade_sources(spark, sf_dir):
    """Whether each judge's grades come from one responses file."""
    g = v.grades(spark, sf_dir).withColumn("file", F.concat(F.lit("runs/"), F.when(F.col("judge_idx") == 1, "a").otherwise(F.col("model_org")), F.lit("/responses.jsonl")))
    parts = [integrity.sources(g.filter(F.col("judge_idx") == k), "file").withColumn("judge_idx", F.lit(k)) for k in range(1, JUDGES + 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def first_responses(spark, sf_dir):
    return expand.first_of(v.responses(spark, sf_dir), ["model", "technique"], "pos").select("model", "technique", "sample_id")


@query
def shuffled_tasks(spark, sf_dir):
    """All tasks with their place in an order that depends on a seed."""
    return expand.seeded_order(v.responses(spark, sf_dir).select("sample_id", "model"), 7)


@query
def control_rows(spark, sf_dir):
    flag = F.when(F.col("pos") % 3 == 0, F.col("is_control"))
    technique = F.when(F.col("technique") == "tech5", "control_legitimate").when(F.col("technique") != "tech6", F.col("technique"))
    return v.responses(spark, sf_dir).select("sample_id", t.is_control(flag, technique).alias("control"))


@query
def error_classes(spark, sf_dir):
    code = F.when(F.col("pos") % 37 == 0, 429).when(F.col("pos") % 41 == 0, 503).when(F.col("pos") % 43 == 0, 404)
    r = v.responses(spark, sf_dir).withColumn("code", code)
    given = F.when(F.col("pos") % 5 == 0, " Done ")
    return r.select("sample_id", t.error_kind(F.col("code")).alias("kind"), t.is_retryable(F.col("code")).alias("retryable"), t.status_of(given, F.col("error")).alias("status"))


@query
def identity_rows(spark, sf_dir):
    r = v.responses(spark, sf_dir).select("sample_id", "model", F.when(F.col("pos") % 2 == 0, F.col("model_id")).alias("model_id"))
    return r.withColumns(t.identity_defaults(r.columns))


@query
def known_settings(spark, sf_dir):
    """Patterns named in observations that apply to one of the models."""
    o = v.observations(spark, sf_dir).select("model_id").distinct()
    patterns = o.select(F.explode(F.array("model_id", F.concat(F.split_part("model_id", F.lit("/"), F.lit(1)), F.lit("/*")), F.lit("*"))).alias("pattern")).distinct()
    return expand.known_settings(patterns, v.model_list(spark, sf_dir))


@query
def request_messages(spark, sf_dir):
    m = inference.messages(F.when(F.col("turn") % 2 == 0, F.col("role")), F.col("text"))
    c = v.read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.size(m).alias("n"), F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"), F.md5(F.element_at(m, -1)["content"].cast("binary")).alias("last_md5"))


@query
def dataset_versions(spark, sf_dir):
    path = v.pick(F.col("doc_id") % 4, ("/x/data/v2/latest/", "/x/data/latest/", "/runs/Set A/", "/old/"))
    name = F.concat(path, F.when(F.col("doc_id") % 3 == 0, "V2_").otherwise(""), "lang", F.lit(".jsonl"))
    return v.read(spark, sf_dir, "documents").select("doc_id", t.benchmark_version(name).alias("version"))


class _Refused(Exception):
    """A client's error with its HTTP status."""

    status_code, retry_after_seconds = 429, 2.5


@query
def collected_rows(spark, sf_dir):
    """Responses from a client that fails on some rows, refuses others and leaves some empty or cut short."""
    tasks = v.responses(spark, sf_dir).select("sample_id", "question_id", "model", "pos")

    def ask(row: dict) -> dict | str:
        p = row["pos"]
        if p % 97 == 0:
            raise ValueError("no answer")
        if p % 89 == 0:
            raise _Refused("HTTP 429")
        if p % 83 == 0:
            return {"error": {"message": "overloaded"}}
        message = {"content": "" if p % 7 < 2 else [{"type": "text", "text": f" answer to {row['question_id']} "}], "refusal": "I will not." if p % 7 == 0 else None}
        return {"id": f"r{p}", "usage": {"total_tokens": p % 50}, "choices": [{"message": message, "finish_reason": "length" if p % 11 == 0 else "stop"}]}

    out = usage.with_metrics(inference.collected(inference.answered(tasks, ask, workers=8)))
    return out.select(
        "sample_id", "response_text", "response_id", "response_finish_reason", "total_tokens", "char_count", "error", "error_kind", "error_http_status", "error_retryable", "error_retry_after_seconds",
        F.array_join("warnings", ",").alias("warnings"), (F.col("response_latency_ms") >= 0).alias("timed"), t.status_of(F.lit(None).cast("string"), F.col("error")).alias("status"),
    )


@query
def graded_rows(spark, sf_dir):
    """Judge outputs, asked again up to twice where they don't parse; a row without any output scores 0."""
    asked = v.responses(spark, sf_dir).select("sample_id", "pos")

    def judge(batch: pd.DataFrame) -> list[str]:
        good = '{"score": 1, "justification": "fine"}'
        return [good if p % 5 <= n else "" if p % 5 == 4 else "no object" for p, n in zip(batch["pos"], batch["asked"], strict=True)]

    return inference.graded(asked, judge, 2).select("sample_id", "score", "parse_mode", "error", "asked")


@query
def model_keys(spark, sf_dir):
    ending = v.pick(F.col("pos") % 5, ("", "-HIGH", "-none", "-x", "-minimal"))
    name = F.concat(F.lit(" "), "model_id", ending, F.when(F.col("pos") % 2 == 0, "@reasoning=low").otherwise(""))
    return v.responses(spark, sf_dir).select("sample_id", t.model_key(name).alias("model_key"), t.variant_of(name, F.when(F.col("pos") % 3 == 0, "low")).alias("variant"))


@query
def excerpts(spark, sf_dir):
    return v.responses(spark, sf_dir).select("sample_id", F.md5(t.excerpt(F.col("response_text")).cast("binary")).alias("excerpt_md5"))


@query
def first_times(spark, sf_dir):
    """The first of three texts that is a time, with and without zones, as UTC text."""
    p = F.col("pos")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    a = F.when(p % 4 == 0, "soon").when(p % 4 == 1, F.concat(stamp, F.lit("+02:00"))).when(p % 4 == 2, "")
    b = F.when(p % 3 == 0, stamp).when(p % 3 == 1, F.concat(stamp, F.lit("Z")))
    return v.events(spark, sf_dir).select("pos", t.utc_text(t.first_time(a, b, F.date_format("ts", "yyyy-MM-dd"))).alias("first"))


@query
def model_sets(spark, sf_dir):
    return publish.model_sets(v.responses(spark, sf_dir))


@query
def accumulated_stats(spark, sf_dir):
    """Collection counters after a merge, a merge of nothing new and a replacement."""
    e = v.events(spark, sf_dir).withColumn("late", F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"))
    part = lambda late: e.filter("late" if late else "not late").agg(
        F.count_if(F.col("event") != "task_complete").alias("attempt_count"), F.count_if(F.col("event") == "task_rate_limit_requeue").alias("rate_limit_requeue_count"),
        F.count_if(F.col("status") == "error").alias("final_rate_limit_error_count"), F.max(F.col("pos") % 10).alias("max_attempt_observed"),
    )
    r = v.responses(spark, sf_dir)
    tried, untried = r.withColumn("collect_attempt", F.col("pos") % 7), r.withColumn("collect_attempt", F.lit(None).cast("long"))
    made = [publish.accumulated(part(False), part(True), rows, n, mode).withColumn("kind", F.lit(kind)) for kind, rows, n, mode in (("merge", tried, 5, "merge"), ("nothing new", untried, 0, "merge"), ("replace", tried, 5, "replace"))]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query
def redact_nested(spark, sf_dir):
    """Local paths in structs, arrays of structs and maps, and fields that name grade folders."""
    path = F.concat(F.lit("/Users/u"), F.col("pos").cast("string"), F.lit("/a b"))
    inner = F.struct(path.alias("file"), F.lit("d").alias("judge_2_grade_dir"), F.col("pos").alias("n"))
    rows = v.responses(spark, sf_dir).select("pos", F.array(inner).alias("list"), F.create_map(F.lit("k"), path, F.lit("x_grade_dir"), path).alias("map"), F.when(F.col("pos") % 2 == 0, F.struct(inner.alias("deep"))).alias("tree"))
    return publish.redact(rows).select("pos", *[F.to_json(c).alias(c) for c in ("list", "map", "tree")])


def _models(spark, sf_dir):
    inventory = metadata.inventory(v.observations(spark, sf_dir)).select("model_id", "org")
    return metadata.bucketed(inventory, {"collector_a": ["org0", "org1"], "collector_b": ["org2"]}, "collector_c")


@query
def sources_template(spark, sf_dir):
    return metadata.sources_template(_models(spark, sf_dir))


@query
def collected_sources(spark, sf_dir):
    """Evidence of every model; sources name some models with their reasoning level."""
    e = v.evidence(spark, sf_dir).withColumn("model_id", F.concat("model_id", F.when(F.col("pos") % 2 == 0, "@reasoning=high").otherwise("")))
    return metadata.collected(_models(spark, sf_dir), e, 1, COLLECTED_AT)


@query
def launch_totals(spark, sf_dir):
    return metadata.status_totals(metadata.final_rows(_attempts(spark, sf_dir)))


@query
def observed_models(spark, sf_dir):
    """The inventory over configured models, published rows and run history."""
    of = lambda source, df: df.select("model_id", F.lit(source).alias("source"), F.col("model").alias("variant"))
    config = v.model_list(spark, sf_dir).withColumn("model", F.concat("model_id", F.lit("@reasoning=none")))
    runs = v.events(spark, sf_dir).select(F.concat(F.lit("org9/"), "model").alias("model_id")).withColumn("model", F.col("model_id"))
    return metadata.inventory(of("config", config).unionByName(of("latest", v.responses(spark, sf_dir))).unionByName(of("runs", runs)))
