"""Rules that are easy to get wrong, on literal rows."""

import json
import random
import time
from pathlib import Path

import pytest
from evalspark.functions import text as t
from evalspark.functions.exact import ratio
from evalspark.operators import expand, inference, integrity, leaderboard, metadata, pairwise, panel, publish, reliability, usage
from evalspark.sources import files
from pyspark.sql import functions as F

IDENTITY = ("model", "run_index", "question_id", "technique", "domain", "is_control")
GRADES = "pos long, sample_id string, model string, run_index int, question_id string, technique string, domain string, is_control boolean, judge_idx int, judge_model string, score int, error string"


def value(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def graded(spark, scores, runs=(1, 1, 1), control=False):
    """{sample: (score or None for an error or 'missing', ...)}"""
    rows = []
    for n, (sample, per) in enumerate(scores.items()):
        for k, s in enumerate(per, 1):
            if s != "missing":
                rows.append((n, sample, "m", runs[k - 1], "q", "t", "d", control, k, f"j{k}", s, "" if s is not None else "parse"))
    return spark.createDataFrame(rows, GRADES)


def consensus(spark, scores, method, **kw):
    p = panel.align(graded(spark, scores, **kw), 3, IDENTITY)
    return {r.sample_id: (None if r.c4 is None else r.c4 / 10000, r.consensus_error, r.status) for r in panel.consensus(p, method).collect()}


def test_coercion(spark):
    s = lambda x: F.lit(x)
    assert value(spark, *[t.to_int(s(x)) for x in (" 12 ", "12.0", "3.5", "true", "", None)]) == (12, 12, None, None, None, None)
    assert value(spark, *[t.to_bool(s(x)) for x in ("Yes", "0", "maybe")]) == (True, False, None)
    assert value(spark, t.to_float(s(" 1e3 ")), t.to_float(s("x"))) == (1000.0, None)
    assert [str(x) for x in value(spark, *[t.iso_date(s(x)) for x in ("2024-02-29", "2024-02-30", "2024-1-05")])] == ["2024-02-29", "None", "None"]


def test_names(spark):
    s = F.lit
    assert value(spark, t.slug(s("a b//c__")), t.tag(s("Hot & Cold!")), t.tag(s("!!")), t.excerpt(s("a " * 100), 10)) == ("a_b_c", "hot_cold", "unknown", "a a a a...")
    assert value(spark, t.variant_of(s("openai/gpt-5-high@reasoning=low"), s("low")), t.variant_of(s(" a/b "), s(None)), t.variant_of(s(""), s("low"))) == ("openai/gpt-5@reasoning=low", "a/b@reasoning=default", "")
    assert value(spark, t.unquoted(s("'x'")), t.unquoted(s('" x "'))) == ("'x'", "x")
    assert value(spark, t.model_key(s("x/y@reasoning=high")), t.model_key(s("x/y-HIGH")), t.model_key(s("x/y-max"))) == ("x/y", "x/y", "x/y-max")
    assert value(spark, t.url_domain(s("https://www.X.com:81/a")), t.url_domain(s("nothing")), t.org_of(s("meta-llama/z"))) == ("x.com:81", "", "meta")
    assert value(spark, t.unquoted(s(' "a b" ')), t.unquoted(s("“x”")), t.unquoted(s("it's"))) == ("a b", "x", "it's")
    assert value(spark, t.is_rate_limit(s(None), s(429), s(None)), t.is_rate_limit(s(None), s(500), s("Rate Limit hit")), t.is_retryable(s(503)), t.is_retryable(s(404))) == (True, True, True, False)
    assert value(spark, t.status_of(s(" "), s("x")), t.status_of(s("OK"), s("x"))) == ("error", "ok")


def test_ratio_rounds_halves_up(spark):
    assert value(spark, ratio(F.lit(1), F.lit(32)), ratio(F.lit(2), F.lit(3)), ratio(F.lit(1), F.lit(0))) == (0.0313, 0.6667, None)


def test_consensus_methods(spark):
    scores = {"all": (0, 1, 2), "two": (2, 2, 0), "failed": (1, None, 2), "missing": (1, "missing", None), "none": (None, None, None)}
    assert consensus(spark, scores, "mean") == {"all": (1.0, None, "ok"), "two": (1.3333, None, "ok"), "failed": (1.5, None, "error"), "missing": (1.0, None, "error"), "none": (None, "no_valid_scores", "error")}
    majority = consensus(spark, scores, "majority")
    assert majority["all"] == (None, "majority_tie:0,1,2", "error") and majority["two"][0] == 2.0
    assert consensus(spark, scores, "min")["failed"][0] == 1.0 and consensus(spark, scores, "max")["failed"][0] == 2.0
    primary = consensus(spark, {**scores, "no third": (0, 1, None), "one": (None, 2, None)}, "primary_tiebreak")
    assert primary["all"][0] == 2.0 and primary["two"][0] == 2.0 and primary["no third"] == (None, "primary_disagreement_without_tiebreak", "error") and primary["one"][0] == 2.0


def test_identity_mismatch_empties_all_but_primary(spark):
    scores = {"s": (2, 2, 2)}
    assert consensus(spark, scores, "mean", runs=(1, 2, 1))["s"] == (None, "no_valid_scores", "error")
    assert consensus(spark, scores, "primary_tiebreak", runs=(1, 2, 1))["s"] == (2.0, None, "error")


def test_buckets(spark):
    assert value(spark, *[panel.bucket(F.lit(x).cast("long")) for x in (4999, 5000, 13333, 15000, 35000, -5, None)]) == (0, 1, 1, 2, 3, 0, None)


def test_summary_keeps_shared_counter_of_three(spark):
    rows = spark.createDataFrame([("m", True, 30000, "ok"), ("m", True, 10000, "ok"), ("m", False, 30000, "error"), ("m", False, None, "error")], "model string, is_control boolean, c4 long, status string")
    r = leaderboard.summarize(rows).first()
    assert (r["count"], r.error_count, r.score_3, r.control_count, r.nonsense_count, r.score_1, r.control_correct_rate_score_3, r.avg_score) == (4, 2, 2, 2, 1, 0, 1.0, 3.0)


def test_alpha(spark):
    p = lambda s: panel.align(graded(spark, s), 3, IDENTITY)
    assert reliability.alpha(p({"a": (1, 1, 1), "b": (1, 1, 1)})).first().alpha == 1.0
    assert reliability.alpha(p({"a": (1, 1, 1), "b": (2, 2, 2)})).first().alpha == 1.0
    assert reliability.alpha(p({"a": (1, None, None)})).first().alpha is None
    assert reliability.alpha(p({"a": (0, 2, 0), "b": (2, 0, 2)})).first().alpha < 0


def test_disagreement_definitions_differ(spark):
    p = panel.align(graded(spark, {"same": (1, 1, 0), "differ": (1, 2, 0), "failed": (None, 1, 0), "missing": (1, "missing", 0)}), 3, IDENTITY)
    assert {r.sample_id for r in panel.disagreements(p).collect()} == {"differ", "failed", "missing"}
    assert p.agg(F.count_if(panel.valid_and_different())).first()[0] == 1


def test_usage(spark):
    rows = [("m", '{"prompt_tokens": 10, "completion_tokens": "4", "total_tokens": 14, "prompt_tokens_details": {"cached_tokens": 20}}', 0, ""), ("n", "{}", 7, ""), ("n", "broken", None, "x"), ("n", '{"input_tokens": 3, "output_tokens": 1, "total_tokens": 4, "cost": 0.5}', 1000, "")]
    m = usage.with_metrics(spark.createDataFrame(rows, "model string, response_usage string, response_latency_ms long, error string"))
    got = m.collect()
    assert [(r.prompt_tokens, r.completion_tokens, r.has_usage, r.tokens_per_second) for r in got] == [(10, 4, True, None), (None, None, False, None), (None, None, False, None), (3, 1, True, 4.0)]
    prices = spark.createDataFrame([("m", 10_000, 1_000, 20_000)], "model string, input long, cached_input long, output long")
    cost = {r.prompt_tokens: r.final_cost_usd for r in usage.estimated_cost(m, prices).collect()}
    assert cost[10] == (20 * 1_000 + 4 * 20_000) / 1e10 and cost[3] == 0.5
    s = {r.model: r for r in usage.usage_summary(m).collect()}
    assert s["ALL"].rows == 4 and s["ALL"].avg_total_tokens == 9.0 and s["n"].rows_with_usage == 1


def test_judge_output(spark):
    good = '{"score": 2, "justification": "j"}'
    double = '"{\\"score\\": 1, \\"justification\\": \\" k \\"}"'
    score, reason, none = inference.NO_SCORE, inference.NO_REASON, inference.NO_OBJECT
    cases = [
        (good, 2, "j", "direct", ""), (f"x ```json\n{good}\n``` y", 2, "j", "markdown_fence", ""), (f"\n\t{good}\r\n", 2, "j", "direct", ""),
        (double, 1, "k", "direct_double_encoded", ""), (f"```\n{double}\n```", 1, "k", "markdown_fence_double_encoded", ""), (f'so "a" {good} {{', 2, "j", "first_object", ""),
        (f'pre {{"a": "}}"}} {good}', None, None, "", score), (good.replace("2", "2.0"), None, None, "", score), (good.replace("2", '"2"'), None, None, "", score), (good.replace("2", "true"), None, None, "", score),
        (good.replace("2", "7"), None, None, "", score), ("{}", None, None, "", score), (good.replace('"j"', '" "'), None, None, "", reason), (good.replace('"j"', "5"), None, None, "", reason), ('{"score": 1}', None, None, "", reason),
        ("[1]", None, None, "", none), ('"text"', None, None, "", none), ("{ no", None, None, "", none), ("", 0, "", "fallback_empty_judge_output", ""), (None, 0, "", "fallback_empty_judge_output", ""), (" \n\t", 0, "", "fallback_empty_judge_output", ""),
    ]
    got = inference.judged(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, raw string"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")
    assert [(r.score, r.justification, r.parse_mode, r.error) for r in got.orderBy("i").collect()] == [c[1:] for c in cases]


def slow_first_object(text):
    depth, start, quoted, skip = 0, -1, False, False
    for i, ch in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"' and depth:
            quoted = True
        elif ch == "{":
            start = i if depth == 0 else start
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
    return None


def test_first_object(spark):
    r = random.Random(1)
    texts = ['a {"x": "}\\"{"} b', "{ no", "", "}{}", '{"' + "\\" * 5000 + '"}', "{" * 300 + "}" * 300, *["".join(r.choice('{}"\\ab\n') for _ in range(r.randrange(25))) for _ in range(3000)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [x.o for x in df.select("i", inference.first_object(F.col("t")).alias("o")).orderBy("i").collect()]
    assert got == [slow_first_object(t) for t in texts]


def test_payloads(spark):
    msg = lambda m, **k: json.dumps({"choices": [{"message": m, "finish_reason": "stop"}], **k})
    out = lambda *parts, **k: json.dumps({"output": [{"type": "reasoning", "content": [{"type": "output_text", "text": "no"}]}, "odd", {"type": "message", "content": [*parts, 5]}, {"type": "message", "content": "odd"}], **k})
    part = lambda t: {"type": "output_text", "text": t}
    error = inference.ERROR_PAYLOAD
    cases = [
        (msg({"content": " a \n"}), "a", "", "stop", ""), (msg({"content": None, "refusal": " no "}), "", "no", "stop", ""), (msg({"content": [{"text": "a"}, {"image": 1}, {"text": "b "}]}), "a\nb", "", "stop", ""),
        (out(part("x "), part(" "), part("y"), status="completed", incomplete_details={"reason": "max"}), "x\ny", "", "completed", ""), (out(part("x"), status=" INCOMPLETE ", incomplete_details={"reason": "max"}), "x", "", "max", ""),
        (out(part("x"), status="incomplete", incomplete_details=None), "x", "", "incomplete", ""), (out({"type": "refusal", "refusal": "never"}, choices=[{"message": {"content": "plain"}}]), "plain", "never", None, ""),
        (out(), "", "", None, inference.NO_CONTENT), ('{"error": "rate limited"}', "", "", None, error + '"rate limited"'), (msg({"content": "a"}, error={"code": 5}), "", "", "stop", error + '{"code":5}'), (msg({"content": "a"}, error=""), "a", "", "stop", ""),
        ("{}", "", "", None, inference.NO_CONTENT), ('{"choices": {}}', "", "", None, inference.NO_CONTENT), ("not json", "", "", None, inference.NOT_JSON), (None, "", "", None, inference.NOT_JSON), ("[]", "", "", None, inference.NOT_JSON),
        ('{"choices": [1]}', "", "", None, inference.BAD_CHOICE), ('{"choices": [{"message": null}]}', "", "", None, inference.BAD_MESSAGE), ('{"choices": [{}], "status": ""}', "", "", None, ""), (msg({"content": 12}), "12", "", "stop", ""),
    ]
    got = inference.model_text(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, payload string")).orderBy("i").collect()
    assert [(r.text, r.refusal, r.finish_reason, r.error) for r in got] == [c[1:] for c in cases]


def test_calls_run_side_by_side_within_a_budget(spark):
    def ask(row):
        if row["id"] == 3:
            raise ValueError("no")
        time.sleep(0.2)
        return {"usage": {"total_tokens": row["id"]}, "choices": [{"message": {"content": f"a{row['id']}"}}]}

    rows = spark.range(12).coalesce(1)
    start = time.monotonic()
    got = inference.collected(inference.answered(rows, ask, workers=12)).collect()
    assert time.monotonic() - start < 12 * 0.2 + 8
    assert [r.id for r in got] == list(range(12)) and all(r.response_latency_ms >= 190 for r in got if r.id != 3)
    assert (got[3].error, got[3].error_kind, got[3].response_text) == ("no", "runtime_error", "") and got[4].response_text == "a4" and got[4].response_usage == '{"total_tokens":4}'
    start = time.monotonic()
    inference.answered(rows, lambda row: "{}", workers=12, per_second=10).collect()
    assert time.monotonic() - start >= 1.1


def test_prompts_replace_in_turn(spark):
    assert value(spark, inference.rendered(F.lit("{question}|{response}"), {"question": F.lit("say {response}"), "response": F.lit("hi")})) == ("say hi|hi",)
    assert [m["role"] for m in value(spark, inference.messages(F.lit(" "), F.lit("u")))[0]] == ["user"]


def test_calls_report_errors_by_row(spark):
    def model(batch):
        if (batch.q == 3).any():
            raise ValueError("no")
        return batch.q.astype(str)

    got = {r.q: (r.response_text, r.error) for r in inference.call(spark.range(6).selectExpr("cast(id as int) q"), model).collect()}
    assert got[3] == ("", "ValueError: no") and got[4] == ("4", "")


def test_overrides(spark):
    rules = {"*": {"a": {"x": 1, "y": 2}, "b": 1}, "o/*": {"a": 5}, "o/m": {"a": {"z": 3}}, "p/m": {"b": {"c": 1}}}
    got = {}
    for r in expand.overrides(spark.createDataFrame([("o/m",), ("o/n",), ("p/m",), ("q",)], "model_id string"), expand.override_rules(spark, rules)).collect():
        got.setdefault(r.model_id, {})[r.path] = r.value
    assert got == {"o/m": {"a.z": "3", "b": "1"}, "o/n": {"a": "5", "b": "1"}, "p/m": {"a.x": "1", "a.y": "2", "b.c": "1"}, "q": {"a.x": "1", "a.y": "2", "b": "1"}}


def test_merge(spark):
    df = lambda rows: spark.createDataFrame(rows, "key string, pos int, v int")
    old, new = df([("a", 1, 1), ("a", 2, 2), ("", 3, 3), ("b", 4, 4)]), df([("b", 1, 9), ("c", 2, 8), ("", 3, 7), (None, 4, 6)])
    once = publish.publish(old, new, "key", ["pos"])
    assert sorted((r.key or "", r.v) for r in once.collect()) == [("", 3), ("", 6), ("", 7), ("a", 2), ("b", 9), ("c", 8)]
    again = publish.merge(once, new.filter("key <> ''"), "key", ["pos"]).drop("side")
    assert sorted((r.key or "", r.v) for r in again.collect()) == sorted((r.key or "", r.v) for r in once.collect())
    assert tuple(publish.merge_counts(old, new, "key").first()) == (1, 1, 2)
    assert publish.publish(None, new, "key", ["pos"]).count() == 4


def test_redaction_and_slimming(spark):
    df = spark.createDataFrame([("/Users/me/x.json ok", ["see /Users/a"], 1, "p")], "a string, b array<string>, c int, judge_1_grade_dir string")
    assert tuple(publish.redact(df).first()) == ("[local-path] ok", ["see [local-path]"], 1)


def test_evidence_rules(spark):
    base = {"pos": 1, "model_id": "o/alpha-3.5", "org": "o", "proposed_launch_date": "2024-01-02", "evidence_url": "https://blog.o.com/x", "evidence_title": "Alpha 3.5 is here", "evidence_published_date": "2024-01-02", "evidence_type": "newsroom", "supporting_snippet": "s"}
    cases = [({}, "accepted"), ({"proposed_launch_date": "2024-1-2"}, "rejected"), ({"proposed_launch_date": "2030-01-01", "evidence_published_date": "2030-01-01"}, "rejected"), ({"evidence_url": "https://o.com.evil.org"}, "rejected"), ({"evidence_type": "tweet"}, "needs_retry"), ({"evidence_title": "news", "supporting_snippet": "x"}, "needs_retry"), ({"evidence_published_date": ""}, "needs_retry")]
    rows = spark.createDataFrame([tuple({**base, **c, "pos": i}.values()) for i, (c, _) in enumerate(cases)], ", ".join(f"{k} {'int' if k == 'pos' else 'string'}" for k in base))
    judged = metadata.judge(rows, {"o": ["o.com"]}, "2024-06-30", 3).orderBy("pos").collect()
    assert [r.judge_status for r in judged] == [s for _, s in cases]
    tried = metadata.attempts(rows, {"o": ["o.com"]}, "2024-06-30", 3)
    assert tried.filter("pos = 1").orderBy("attempt_count").select("judge_status").collect()[-1][0] == "unresolved" and tried.filter("pos = 0").count() == 1
    assert {r.judge_status for r in metadata.review(spark.createDataFrame([("zz", "o")], "model_id string, org string"), metadata.final_rows(tried)).collect()} == {"unresolved"}


def test_pairs(spark):
    rows = spark.createDataFrame([("q", m, c, "t", "d", f"{m}{p}", p) for m, c, p in (("a", 10000, 1), ("a", 20000, 2), ("b", 20000, 3), ("c", None, 4))], "question_id string, model string, c4 long, technique string, domain string, sample_id string, pos int")
    s = pairwise.scored(rows)
    e = pairwise.events(s, "v1").collect()
    assert [(r.system_a, r.system_b, r.winner, r.score_margin) for r in e] == [("a", "b", "tie", 0.0)]
    assert pairwise.summary(s).first().asDict() == {"questions": 1, "rows": 2, "events": 1, "ties": 1, "models": 2}


def test_integrity(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "sample_id string")
    assert tuple(integrity.report(ids("a", "b", "c"), ids("b", "b", "z")).first()) == (3, 3, 1, 2, 1)
    with pytest.raises(ValueError, match="stale"):
        integrity.require_empty(integrity.stale(ids("a"), ids("b")), "stale checkpoint")


def test_files(spark, tmp_path: Path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "responses.jsonl").write_text('{"id": 1, "t": "x"}\nbad\n\n[1]\n{"id": 2}\n')
    schema = spark.createDataFrame([], "id int, t string").schema
    assert {r.id for r in files.lenient_jsonl(spark, str(tmp_path / "r1" / "responses.jsonl"), schema).collect()} >= {1, 2}
    with pytest.raises(Exception, match="(?i)malformed"):
        files.strict_jsonl(spark, str(tmp_path / "r1" / "responses.jsonl"), schema).collect()
    assert files.csv_table(spark, str(tmp_path / "none.csv"), schema).count() == 0
    files.write_csv(spark.createDataFrame([(1, 'a "q", b')], schema), str(tmp_path / "out.csv"), ["id", "t", "absent"])
    assert files.csv_table(spark, str(tmp_path / "out.csv"), spark.createDataFrame([], "id int, t string, absent string").schema).first().t == 'a "q", b'
    assert files.objects_in('x {"a": {"b": "}"}} , {"c": "line\nend"} {') == ['{"a": {"b": "}"}}', '{"c": "line\\nend"}']


def test_question_bank(spark):
    q = lambda i, c=False: {"id": i, "question": "q", "nonsensical_element": "n", "domain": "d", "domain_group": "g", "difficulty": "1", "technique": "t", "is_control": c}
    bank = spark.createDataFrame([([{"technique": "t1", "description": "x", "questions": [q("a"), q("b", True), q("c")]}, {"technique": "control_legitimate", "description": "x", "questions": [q("z")]}, {"technique": "t2", "description": "y", "questions": [q("d")]}],)], files.BANK)
    assert [r.id for r in files.flat_questions(bank, limit=2).collect()] == ["a", "c"]
    flat = files.flat_questions(bank)
    assert {(r.kind, r.name): r.n for r in files.question_counts(flat).collect()}[("all", "")] == 3
    assert {r.technique: r.question_count for r in files.nested_bank(flat).collect()} == {"t1": 2, "t2": 1}
    many = spark.range(95).select(F.when(F.col("id") < 70, "big").when(F.col("id") < 90, "small").alias("technique"), F.format_string("q%03d", "id").alias("id"))
    parts = files.nested_bank(many.unionByName(many.filter("id = 'q007'")), 20).orderBy("technique", "part").collect()
    assert max(r.question_count for r in parts) <= 20 and all(r.question_count == len(r.questions) for r in parts)
    ids = lambda t: [q.id for r in parts if r.technique == t for q in r.questions]
    assert ids("big") == sorted([f"q{i:03d}" for i in range(70)] + ["q007"]) and len(ids("small")) == 20 and len(ids(None)) == 5
    assert files.nested_bank(many.limit(0)).count() == 0
    assert files.incomplete(flat).count() == 0
