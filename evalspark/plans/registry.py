"""Queries over the test tables: one or more operators each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark import views as v
from evalspark.functions.exact import ratio
from evalspark.functions.text import url_domain
from evalspark.operators import expand, inference, integrity, leaderboard, metadata, pairwise, panel, publish, reliability, report, timeline, usage
from evalspark.scratch import scratch_dir, stored
from evalspark.sources import damaged, files
from evalspark.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
JUDGES = 3
PROVIDERS = {"org1/m6": "direct", "org1/*": "azure", "org2/*": "vertex", "*": "router"}
OVERRIDES = {
    "*": {"reasoning": {"effort": "low", "enabled": True}, "temperature": 0},
    "org1/*": {"reasoning": {"effort": "high"}, "provider": {"only": ["a"]}},
    "org2/*": {"reasoning": "off"},
    "org1/m6": {"provider": "none", "temperature": 1},
}
#: Input, cached input and output, in 1e-4 dollars per million tokens.
PRICES = [("1-URGENT", 25000, 2500, 100000), ("2-HIGH", 12500, 1250, 50000), ("5-LOW", 1500, 150, 6000)]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def day_text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def time_text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.align(v.grades(spark, sf_dir), JUDGES, v.IDENTITY)


def scored(spark: SparkSession, sf_dir: str, method: str = "mean") -> DataFrame:
    return panel.consensus(aligned(spark, sf_dir), method).withColumn("pos", F.substring("sample_id", 2, 20).cast("long"))


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.ranked(leaderboard.summarize(scored(spark, sf_dir)))


QUERIES["leaderboard"] = board


def _consensus(method: str) -> None:
    def run(spark, sf_dir):
        return scored(spark, sf_dir, method).select("sample_id", "c4", "consensus_error", "status")

    run.__name__ = f"consensus_{method}"
    query(run)


for _m in panel.METHODS:
    _consensus(_m)


@query
def aggregate_rows(spark, sf_dir):
    cols = ("sample_id", *v.IDENTITY, "mismatch", "c4", "consensus_error", "status", "error")
    return scored(spark, sf_dir).select(*cols, F.array_join(F.col("valid").cast("array<string>"), ",").alias("judge_valid_scores"))


@query
def judge_summary(spark, sf_dir):
    return leaderboard.judge_summary(v.grades(spark, sf_dir))


@query
def technique_breakdown(spark, sf_dir):
    return leaderboard.breakdown(scored(spark, sf_dir), ("model", "technique"))


@query
def run_averages(spark, sf_dir):
    return leaderboard.run_averages(scored(spark, sf_dir))


@query
def run_stddev(spark, sf_dir):
    return leaderboard.run_deviation(scored(spark, sf_dir))


@query
def domain_mix(spark, sf_dir):
    return leaderboard.bucket_mix(scored(spark, sf_dir), ("model", "domain"))


@query
def technique_difficulty(spark, sf_dir):
    return leaderboard.breakdown(scored(spark, sf_dir), ("technique",))


@query
def question_saturation(spark, sf_dir):
    return leaderboard.saturation(stored(scored(spark, sf_dir).select("model", "question_id", "is_control", "c4", "status")), 5)


@query
def judge_pair_agreement(spark, sf_dir):
    return reliability.pair_agreement(aligned(spark, sf_dir), JUDGES)


@query
def krippendorff_alpha(spark, sf_dir):
    return reliability.alpha(aligned(spark, sf_dir))


@query
def disagreement_samples(spark, sf_dir):
    return panel.disagreements(aligned(spark, sf_dir)).select("sample_id", "model", "question_id")


@query
def panel_disagreement_rate(spark, sf_dir):
    p = aligned(spark, sf_dir)
    bad = panel.disagreements(p).agg(F.count(F.lit(1)).alias("disagreements"))
    return p.agg(F.count(F.lit(1)).alias("rows")).join(bad).select("rows", "disagreements", ratio(F.col("disagreements"), F.greatest("rows", F.lit(1))).alias("rate"))


@query
def publish_disagreement(spark, sf_dir):
    bad = F.count_if(panel.valid_and_different()).alias("disagreements")
    return aligned(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), bad).withColumn("rate", ratio(F.col("disagreements"), F.col("rows")))


@query
def synthetic_tiebreak(spark, sf_dir):
    g = v.grades(spark, sf_dir)
    rejudged = g.filter("judge_idx = 3 and run_index = 1")
    source = v.responses(spark, sf_dir).select("sample_id", "model", "question_id")
    two = panel.align(g.filter("judge_idx <= 2"), 2, v.IDENTITY)
    return panel.synthetic_tiebreaks(source, two, rejudged)


def _report(spark, sf_dir):
    return report.report_rows(v.responses(spark, sf_dir).select("sample_id", "model", "question_id", "error"), scored(spark, sf_dir))


@query
def report_rows(spark, sf_dir):
    text = F.transform("judges", lambda j, i: F.concat_ws(":", F.concat(F.lit("judge"), (i + 1).cast("string")), F.coalesce(j["score"].cast("string"), F.lit("-")), j["error"]))
    return _report(spark, sf_dir).select("sample_id", "model", "question_id", F.col("error").alias("response_error"), "c4", "consensus_error", F.array_join(text, "|").alias("judges"), "status", "report_error")


@query
def report_errors(spark, sf_dir):
    return report.report_errors(_report(spark, sf_dir))


def _prices(spark):
    return spark.createDataFrame(PRICES, "model string, input long, cached_input long, output long")


@query
def usage_metrics(spark, sf_dir):
    return usage.with_metrics(v.usage(spark, sf_dir)).select("sample_id", "model", "prompt_tokens", "completion_tokens", "total_tokens", "reasoning_tokens", "cached_prompt_tokens", "cache_write_tokens", "cost_usd", "upstream_cost_usd", "is_byok", "char_count", "tokens_per_second")


@query
def usage_summary(spark, sf_dir):
    return usage.usage_summary(usage.with_metrics(v.usage(spark, sf_dir), prices=_prices(spark)))


@query
def estimated_cost(spark, sf_dir):
    return usage.estimated_cost(usage.with_metrics(v.usage(spark, sf_dir)), _prices(spark)).select("sample_id", "cost_usd", "estimated_cost_usd", "final_cost_usd")


@query
def collection_stats(spark, sf_dir):
    return usage.collection_stats(v.responses(spark, sf_dir), v.events(spark, sf_dir))


def _variants(spark, sf_dir):
    return expand.variants(v.model_list(spark, sf_dir), expand.provider_rules(spark, PROVIDERS), "openrouter", "none")


@query
def model_variants(spark, sf_dir):
    return _variants(spark, sf_dir).drop("effort_pos")


@query
def task_grid(spark, sf_dir):
    grid = expand.task_grid(_variants(spark, sf_dir), v.questions(spark, sf_dir), 2, "run 1")
    return grid.select("run_index", "model_label", "question_id", "model_provider", "is_control")


@query
def sample_ids(spark, sf_dir):
    return expand.task_grid(_variants(spark, sf_dir), v.questions(spark, sf_dir), 2, "run 1").select("sample_id")


@query
def provider_routing(spark, sf_dir):
    return expand.routed(v.model_list(spark, sf_dir).select("model_id"), expand.provider_rules(spark, PROVIDERS), "openrouter")


@query
def override_cascade(spark, sf_dir):
    return expand.overrides(v.model_list(spark, sf_dir), expand.override_rules(spark, OVERRIDES))


def _tasks_and_checkpoint(spark, sf_dir):
    """All responses and a task for each control besides; the first runs as checkpoint, with stale and repeated rows."""
    r = v.responses(spark, sf_dir)
    named = lambda prefix: F.concat(F.lit(prefix), F.col("pos").cast("string")).alias("sample_id")
    done = r.filter("run_index = 1")
    tasks = r.select("sample_id").union(r.filter("is_control").select(named("x")))
    return tasks, done.select("sample_id").union(r.filter("error <> ''").select(named("old"))).union(done.filter("is_control").select("sample_id"))


@query
def resume_antijoin(spark, sf_dir):
    return integrity.not_done(*_tasks_and_checkpoint(spark, sf_dir))


@query
def stale_checkpoint(spark, sf_dir):
    tasks, checkpoint = _tasks_and_checkpoint(spark, sf_dir)
    bad = integrity.duplicates(checkpoint).select(F.lit("duplicate").alias("kind"), "sample_id")
    return integrity.stale(tasks, checkpoint).select(F.lit("stale").alias("kind"), "sample_id").union(bad)


@query
def integrity_report(spark, sf_dir):
    return integrity.report(*_tasks_and_checkpoint(spark, sf_dir))


def _grid(spark, sf_dir):
    return v.model_list(spark, sf_dir).select("model_id").crossJoin(v.questions(spark, sf_dir))


@query
def dry_run_collect(spark, sf_dir):
    return _grid(spark, sf_dir).select("model_id", "question_id", inference.dry_response(F.col("question_id"), F.col("model_id")).alias("response_text"))


@query
def dry_run_grade(spark, sf_dir):
    return _grid(spark, sf_dir).select("model_id", "question_id", inference.dry_grade(F.col("is_control")).alias("judge_score"), F.lit("Dry run placeholder grade.").alias("judge_justification"))


@query
def prompt_render(spark, sf_dir):
    template = F.when(F.col("is_control"), "Legitimate: {question} Answer: {response}").otherwise("Q: {question} Wrong: {nonsensical_element} A: {response}")
    fields = {"question": F.concat(F.col("question"), F.lit(" {response}")), "nonsensical_element": F.col("model_id"), "response": inference.dry_response(F.col("question_id"), F.col("model_id"))}
    return _grid(spark, sf_dir).select("model_id", "question_id", inference.rendered(template, fields).alias("prompt"))


@query
def grading_guard(spark, sf_dir):
    r = v.responses(spark, sf_dir)
    text = F.when(F.col("pos") % 17 == 0, F.lit(" ")).otherwise(F.col("response_text"))
    return r.select("sample_id", inference.grading_error(F.col("error"), text).alias("error"))


@query
def score_checks(spark, sf_dir):
    """Scores of another scale held against the allowed ones, with and without the control hint."""
    g, s = v.grades(spark, sf_dir), (F.col("score") + F.col("pos") % 2).cast("int")
    return g.select("sample_id", "judge_idx", inference.score_error(s, F.col("is_control")).alias("hinted"), inference.score_error(s, F.col("is_control"), False).alias("unhinted"))


@query
def version_comparison(spark, sf_dir):
    """Two leaderboards, of even and of odd questions."""
    rows = scored(spark, sf_dir).withColumn("half", F.substring("question_id", 2, 20).cast("long") % 2)
    per = stored(leaderboard.summarize(rows, ("half", "model")).select("half", "model", "avg_score"))
    return leaderboard.compared(per.filter("half = 0"), per.filter("half = 1"))


def judge_raw(spark, sf_dir):
    """Judge outputs of every shape, the documents' texts as justifications."""
    d, k = F.col("doc_id"), F.col("doc_id") % 14
    said = F.concat(F.lit("because {it} \\ \"is\" "), F.coalesce("text", F.lit("")))
    made = lambda score, reason: F.concat(F.lit('{"justification": '), reason, F.lit(', "score": '), score, F.lit("}"))
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r"(?s)^.{5}(.*).$", "$1")
    n, reason = (d % 3).cast("string"), quoted(said)
    obj, other = made(n, reason), quoted(F.lit("no"))
    shapes = [
        obj, F.concat(F.lit("Here:\n```json\n"), obj, F.lit("\n```")), F.concat(F.lit("I \"think } "), obj, F.lit(" is right {")), quoted(obj), made(F.concat(n, F.lit(".0")), reason), F.substring(obj, 1, 20), F.lit(" \n"),
        made(n, F.lit("5")), made(n, quoted(F.lit(" "))), made(F.lit("4"), reason), F.concat(F.lit("[1] "), made(F.lit("true"), other), F.lit(" then "), obj), F.concat(F.lit("```\n"), quoted(obj), F.lit("\n```")), F.lit("[1, 2]"), F.concat(F.lit("\n "), made(n, F.concat(F.lit('" a"'))), F.lit(" ")),
    ]
    raw = F.element_at(F.array(*shapes), (k + 1).cast("int"))
    return v.read(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))


@query
def judge_output_parse(spark, sf_dir):
    return inference.judged(judge_raw(spark, sf_dir)).select("doc_id", "score", F.md5(F.col("justification").cast("binary")).alias("justification_md5"), "parse_mode", "error")


@query
def chat_text_extract(spark, sf_dir):
    """Payloads of both shapes, with lists as contents, refusals and unfinished answers, and of every broken shape."""
    said = F.coalesce("text", F.lit(""))
    part = lambda kind, field, c: F.struct(F.lit(kind).alias("type"), c.alias(field))
    json = lambda **fields: F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    output = lambda *parts: F.array(F.struct(F.lit("reasoning").alias("type"), F.array(parts[0]).alias("content")), F.struct(F.lit("message").alias("type"), F.array(*parts).alias("content")))
    choice = lambda content, reason="stop": F.array(F.struct(F.struct(content.alias("content")).alias("message"), F.lit(reason).alias("finish_reason")))
    shapes = [
        json(output=output(part("output_text", "text", said), part("output_text", "text", F.lit(" more "))), status=F.lit(" Completed "), incomplete_details=F.struct(F.lit("max").alias("reason"))),
        json(choices=choice(said)),
        json(choices=choice(F.array(F.struct(said.alias("text")), F.struct(F.lit("end").alias("text"))), "length")),
        json(output=output(part("refusal", "refusal", said)), status=F.lit("incomplete"), incomplete_details=F.struct(F.lit("max_output_tokens").alias("reason")), choices=choice(F.lit("plain"))),
        json(error=F.lit("rate limited"), choices=choice(said)), json(error=F.struct(F.lit(1).alias("code"))), F.lit("{}"), F.lit("not json"), F.lit('{"choices": ["x"], "error": null}'), F.lit('{"choices": [{"message": 5}]}'), F.lit("[1]"),
        F.lit('{"choices": [{"finish_reason": "stop"}], "status": "INCOMPLETE"}'),
    ]
    payload = F.element_at(F.array(*shapes), ((F.col("conv_id") + F.col("turn")) % len(shapes) + 1).cast("int"))
    c = v.read(spark, sf_dir, "conversations").withColumn("payload", payload)
    return inference.model_text(c).select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("text_md5"), "finish_reason", F.md5(F.col("refusal").cast("binary")).alias("refusal_md5"), "error")


@query
def supplemental_merge(spark, sf_dir):
    old, new = v.line_snapshots(spark, sf_dir)
    out = publish.merge(old, new, "key", ("l_linenumber", "l_partkey", "l_suppkey", "qty", "price"))
    return out.withColumns({"qty": F.col("qty").cast("double"), "price": F.col("price").cast("double")})


@query
def merge_counts(spark, sf_dir):
    return publish.merge_counts(*v.line_snapshots(spark, sf_dir), "key")


@query
def redact_paths(spark, sf_dir):
    path = F.concat(F.lit("see /Users/u"), F.col("pos").cast("string"), F.lit('/runs/a.json" then '), F.col("response_text"))
    rows = v.responses(spark, sf_dir).select("pos", path.alias("note"), F.lit("d").alias("judge_1_grade_dir"))
    return publish.redact(rows).select("pos", F.md5(F.col("note").cast("binary")).alias("note_md5"))


@query
def slim_rows(spark, sf_dir):
    raw = F.to_json(F.struct(F.col("model_id").alias("model"), F.col("response_text").alias("body")))
    seen = F.when(F.col("pos") % 3 == 0, "snap").otherwise("")
    rows = v.responses(spark, sf_dir).select("sample_id", seen.alias("response_model_snapshot"), raw.alias("response_raw"), F.array(F.lit("m")).alias("request_messages"))
    return publish.slim(rows)


@query
def column_coverage(spark, sf_dir):
    """Responses with a usage text that is an object, a list, broken or blank, and a payload that some have."""
    k = F.col("pos") % 4
    usage_text = F.when(k == 0, F.to_json(F.struct("pos"))).when(k == 1, "[1]").when(k == 2, "{broken").otherwise(" ")
    return publish.coverage(v.responses(spark, sf_dir).withColumns({"response_usage": usage_text, "raw": F.when(F.col("pos") % 3 == 0, F.struct("model"))}))


@query
def recent_additions(spark, sf_dir):
    e = v.events(spark, sf_dir)
    named = e.filter("status = 'ok'").withColumn("model", F.concat("model", F.lit("@reasoning="), "event"))
    saved = e.filter("status <> 'ok'").select(F.lit("base").alias("kind"), F.col("model").alias("name"), "ts")
    return publish.recent_additions(named, saved, v.EVENTS_AS_OF).withColumn("first_seen", time_text("first_seen"))


@query
def attempt_numbers(spark, sf_dir):
    return timeline.attempts(v.events(spark, sf_dir)).select("pos", "sample_id", "attempt")


@query
def requeue_stats(spark, sf_dir):
    return timeline.requeues(v.events(spark, sf_dir))


@query
def event_milestones(spark, sf_dir):
    return timeline.milestones(v.events(spark, sf_dir), (1, 10, 100, 1000, 10_000, 100_000)).withColumn("ts", time_text("ts"))


@query
def cumulative_daily(spark, sf_dir):
    return timeline.daily(v.events(spark, sf_dir)).withColumn("day", day_text("day"))


@query
def org_vote(spark, sf_dir):
    return leaderboard.org_votes(v.responses(spark, sf_dir))


def _enriched(spark, sf_dir):
    votes = leaderboard.org_votes(v.responses(spark, sf_dir))
    return leaderboard.enriched(board(spark, sf_dir), votes, v.launches(spark, sf_dir), v.params(spark, sf_dir), v.LAUNCH_AS_OF)


@query
def leaderboard_enriched(spark, sf_dir):
    e = _enriched(spark, sf_dir).withColumn("total_params_b", F.col("total_params_b").cast("double"))
    return e.select("rank", "model", "model_id", "org", "reasoning", "avg_score", day_text("launch_date").alias("launch_date"), "model_age_days", "total_params_b")


@query
def release_trend(spark, sf_dir):
    e = _enriched(spark, sf_dir).groupBy("org", F.date_format("launch_date", "yyyy-MM").alias("month"))
    return e.agg(F.sum("score_2").alias("score_2"), F.sum("nonsense_count").alias("n")).withColumn("green_rate", ratio(F.col("score_2"), F.col("n")))


@query
def size_vs_score(spark, sf_dir):
    return _enriched(spark, sf_dir).filter("total_params_b is not null").select("model", F.col("total_params_b").cast("double").alias("total_params_b"), "detection_rate_score_2", "avg_score")


@query
def cost_vs_score(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for i, p in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) for x in (p, f"org{i}")])
    u = usage.with_metrics(v.usage(spark, sf_dir), prices=_prices(spark)).withColumn("org", names[F.col("model")])
    return report.cost_against_score(scored(spark, sf_dir).withColumn("org", F.split_part("model", F.lit("/"), F.lit(1))), u, "org")


@query
def model_inventory(spark, sf_dir):
    return metadata.bucketed(metadata.inventory(v.observations(spark, sf_dir)), {"collector_a": ["org0", "org1"], "collector_b": ["org2"]}, "collector_c")


@query
def evidence_judge(spark, sf_dir):
    return metadata.judge(v.evidence(spark, sf_dir), v.ALLOWED, v.LAUNCH_AS_OF, 3).select("pos", "evidence_domain", "judge_status", "judge_reason", "required_fix", "judge_confidence")


def _attempts(spark, sf_dir):
    return metadata.attempts(v.evidence(spark, sf_dir), v.ALLOWED, v.LAUNCH_AS_OF, 3)


@query
def attempts_table(spark, sf_dir):
    return _attempts(spark, sf_dir).select("pos", "attempt_count", "judge_status", "judge_confidence")


@query
def canonical_launch(spark, sf_dir):
    return metadata.canonical(metadata.final_rows(_attempts(spark, sf_dir)))


@query
def launch_review(spark, sf_dir):
    models = metadata.inventory(v.observations(spark, sf_dir)).select("model_id", "org")
    return metadata.candidates(metadata.review(models, metadata.final_rows(_attempts(spark, sf_dir))))


@query
def page_domains(spark, sf_dir):
    return v.read(spark, sf_dir, "pages").select("page_id", url_domain(F.col("url")).alias("domain"))


def _pairs(spark, sf_dir):
    return pairwise.scored(scored(spark, sf_dir))


@query
def pairwise_events(spark, sf_dir):
    return pairwise.events(_pairs(spark, sf_dir), "v1").withColumn("tags", F.array_join("tags", ","))


@query
def pairwise_summary(spark, sf_dir):
    return pairwise.summary(_pairs(spark, sf_dir))


@query
def pairwise_topn(spark, sf_dir):
    return pairwise.first_events(_pairs(spark, sf_dir), "v1", 100).drop("tags")


def _lines(spark, sf_dir):
    """Documents as JSON lines, every seventh of them cut short."""
    d = v.read(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", F.col("text"))).alias("j"))
    return d.select("doc_id", F.when(F.col("doc_id") % 7 == 3, F.expr("left(j, length(j) - 1)")).otherwise(F.col("j")).alias("value"))


@query
def jsonl_lenient(spark, sf_dir):
    path = scratch_dir(spark)
    _lines(spark, sf_dir).select("value").write.text(path)
    schema = spark.createDataFrame([], "doc_id long, lang string, text string").schema
    return files.lenient_jsonl(spark, path, schema).select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def salvage_json(spark, sf_dir):
    """Two objects on one damaged line, raw line ends in strings, junk around them."""
    d = v.read(spark, sf_dir, "documents")
    body = F.replace(F.to_json(F.struct("doc_id", "text")), F.lit("\\n"), F.lit("\n"))
    broken = F.concat(F.lit("junk } "), body, F.lit(", "), F.to_json(F.struct("doc_id", "lang")), F.lit(" tail {"))
    found = files.salvaged(d.select("doc_id", broken.alias("value")), "value", ["doc_id"])
    x = F.from_json("json", "doc_id long, text string, lang string")
    return found.select("place", x.alias("x")).select("place", "x.doc_id", "x.lang", F.md5(F.col("x.text").cast("binary")).alias("text_md5"))


@query
def salvage_files(spark, sf_dir):
    """Files of damaged texts, each with two objects, scanned split by split."""
    path, d = scratch_dir(spark), v.read(spark, sf_dir, "documents")
    body = F.replace(F.to_json(F.struct("doc_id", "text")), F.lit("\\n"), F.lit("\n"))
    d.select(F.concat(F.lit('junk } " '), body, F.lit(", "), F.to_json(F.struct("doc_id", "lang")), F.lit(' tail }"')).alias("value")).write.text(path)
    x = F.from_json("json", "doc_id long, text string, lang string")
    return damaged.salvage_files(spark, path).select(x.alias("x")).select("x.doc_id", "x.lang", F.md5(F.col("x.text").cast("binary")).alias("text_md5"))


@query
def markdown_bank(spark, sf_dir):
    """Drafts of ten questions a file made of the documents' whole texts; headings stand before some questions only."""
    d, text = F.col("doc_id"), F.regexp_replace(F.coalesce("text", F.lit("")), "[*#:\"']", "")
    name = F.translate(d.cast("string"), "0123456789", "abcdefghij")
    section = F.when(d % 10 == 0, F.concat(F.lit("## "), F.upper(v.pick(F.floor(d / 10) % 5, files.DOMAINS)), F.lit("\n"))).otherwise("")
    code = v.pick(F.floor(d / 5) % 4, ("pnf", "mm", "L2", "zz"))
    technique = F.when(d % 5 == 0, F.concat(F.lit("### "), code, F.lit(" — The "), code, F.lit(" kind \n"))).otherwise("")
    block = F.concat(
        section, technique, F.lit("\n**"), name, F.lit("_"), code, F.lit("_"), F.lpad((d % 100).cast("string"), 2, "0"), F.lit("**\nnot a field\nDomain: first\nQuestion: \"x"), text, F.lit("y\"\nWhat's wrong: “w”\n  continued "), name,
        F.when(d % 17 == 3, "\nDomain:").otherwise(F.concat(F.lit("\nDomain: "), (d % 5).cast("string"))),
    )
    rows = v.read(spark, sf_dir, "documents").select(F.floor(d / 10).alias("file"), d.alias("doc_id"), files.numbered(block).alias("k", "line"))
    bank = files.markdown_bank(rows.select("file", (F.col("doc_id") * (1 << 32) + F.col("k")).alias("n"), "line"))
    return bank.withColumn("question_md5", F.md5(F.col("question").cast("binary"))).drop("file", "question", "is_control")


def _stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return v.shaped_events(streams.parquet_stream(spark, path, spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp")))


#: Seconds by which an event may come after newer ones: in the progress report, and for one completion per sample.
LATE, LATE_SAMPLES = 3600, 40 * 86400


@query
def stream_progress(spark, sf_dir):
    """Windows that are closed, those that are open yet, and completions that came after their window was closed."""
    folder = scratch_dir(spark)
    out = streams.progress(_stream(spark, sf_dir), LATE, folder)
    late = out.late.groupBy(F.window("ts", "1 minute")["start"].alias("start"), "model", "status").agg(F.count(F.lit(1)).alias("n"))
    parts = [df.withColumn("state", F.lit(state)) for df, state in ((out.rows, "closed"), (streams.open_windows(spark, folder), "open"), (late, "late"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query
def stream_requeues(spark, sf_dir):
    return streams.latest(streams.requeues(_stream(spark, sf_dir)), ("model",)).withColumn("max_cooldown", F.col("max_cooldown").cast("double"))


@query
def stream_due_again(spark, sf_dir):
    """Samples sent back by a rate limit: still cooling down, due again, or done since."""
    return streams.due_again(_stream(spark, sf_dir), scratch_dir(spark)).withColumn("retry_at", time_text("retry_at"))


@query
def stream_first_seen(spark, sf_dir):
    """When models were first seen on each day of the month, and whether that is in the last week; the saved map has
    earlier times of those with errors."""
    name = F.concat("model", F.lit("/"), F.dayofmonth("ts").cast("string"))
    failed = v.events(spark, sf_dir).filter("status = 'error'").groupBy(name.alias("name")).agg((F.min("ts") - F.expr("interval 2 days")).alias("ts"))
    return streams.first_seen(_stream(spark, sf_dir).withColumn("name", name), scratch_dir(spark), failed).withColumn("first_seen", time_text("first_seen"))


@query
def stream_dedup(spark, sf_dir):
    """Samples that completed, each once; completions beyond the lateness are counted apart."""
    out = streams.first_completions(_stream(spark, sf_dir), LATE_SAMPLES)
    count = lambda df, kind: df.groupBy("sample_id").agg(F.count(F.lit(1)).alias("completed")).withColumn("state", F.lit(kind))
    return count(out.rows, "first").unionByName(count(out.late, "late"))


@query
def stream_publish(spark, sf_dir):
    """All odd orders and a third of the even ones, merged into the published even ones file by file."""
    path = f"{sf_dir}/orders.parquet"
    raw = spark.read.parquet(path)
    shaped = lambda d: d.select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_custkey").alias("cust"), "o_orderstatus")
    old = shaped(raw.filter("o_orderkey % 2 = 0")).withColumn("cust", -F.col("cust"))
    new = streams.parquet_stream(spark, path, raw.schema).filter("o_orderkey % 2 <> 0 or o_orderkey % 3 = 0")
    return streams.published(shaped(new), "key", ("cust", "o_orderstatus"), old)
