"""Guards and defaults."""

import pytest
from evalspark.functions import text as t
from evalspark.operators import expand, inference, publish
from evalspark.sources import files
from pyspark.sql import functions as F


def value(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_versions(spark):
    paths = ("/x/data/v2/latest/a.jsonl", "C:\\x\\data\\latest\\a", "/x/set_V2.jsonl", "/Runs Here/a.jsonl")
    assert value(spark, *[t.benchmark_version(F.lit(p)) for p in paths]) == ("v2", "v1", "v2", "runs_here")


def test_identity_defaults(spark):
    df = spark.createDataFrame([("m", None), ("m", "id")], "model string, model_id string")
    got = df.withColumns(t.identity_defaults(df.columns)).collect()
    assert [(r.model_id, r.model_name, r.model_org, r.model_reasoning_level, r.model_row) for r in got] == [("m", "m", "unknown", "default", "m"), ("id", "id", "unknown", "default", "m")]


def test_guards(spark):
    s = F.lit
    assert value(spark, inference.grading_error(s(""), s("x")), inference.grading_error(s("boom"), s("x")), inference.grading_error(s(None), s(" \n"))) == (None, "Cannot grade response with source error: boom", "Cannot grade empty response_text.")
    assert value(spark, inference.score_error(s(1), s(True)), inference.score_error(s(1), s(True), False), inference.score_error(s(3), s(False)))[1] is None


def test_grade_sets(spark, tmp_path):
    schema = spark.createDataFrame([], "sample_id string, score int").schema
    (tmp_path / "a.jsonl").write_text('{"sample_id": "s1", "score": 1}\n{"sample_id": "s2", "score": 1}\n')
    assert files.grade_set(spark, str(tmp_path / "a.jsonl"), schema, 2).filter("judge_idx = 2").count() == 2
    (tmp_path / "b.jsonl").write_text('{"sample_id": "s1"}\n{"sample_id": "s1"}\n')
    with pytest.raises(ValueError, match="repeated"):
        files.grade_set(spark, str(tmp_path / "b.jsonl"), schema, 1)
    (tmp_path / "c.jsonl").write_text("")
    with pytest.raises(ValueError, match="no grades"):
        files.grade_set(spark, str(tmp_path / "c.jsonl"), schema, 1)


def test_settings_for_unselected_models_are_dropped(spark):
    rules = spark.createDataFrame([("*",), ("o/*",), ("p/*",), ("o/m",), ("o/x",)], "pattern string")
    models = spark.createDataFrame([("o/m",)], "model_id string")
    assert {r.pattern for r in expand.known_settings(rules, models).collect()} == {"*", "o/*", "o/m"}


def test_order_depends_on_the_seed(spark):
    ids = spark.createDataFrame([(f"s{i}",) for i in range(30)], "sample_id string")
    order = lambda seed: [r.sample_id for r in expand.seeded_order(ids, seed).orderBy("place").collect()]
    assert order(1) == order(1) != order(2) and sorted(order(1)) == sorted(order(2))
    assert [r.v for r in expand.first_of(spark.createDataFrame([(1, "a", 2), (1, "b", 1)], "k int, v string, pos int"), ["k"], "pos").collect()] == ["b"]


DRAFT = """intro Question: not in a question
**sw_mm_01**
Question: no section
## LEGAL
### pnf — Plausible Nonexistent Framework
stray line
**leg_pnf_01**
stray line
Question: "one
goes on"
What's wrong: “quoted whole”
Domain: first
Domain: "last "
### L2 - Wrong Relationship
Question: ends with the heading before it
**leg_L2_07**
Question: 'two'
### not a heading
What's wrong:
later
## NOWHERE
**leg_pnf_02**
Question: a
## SOFTWARE
**sw_mm_03**
Question: b
## Lower
### mm — Misapplied Mechanism
**sw_mm_04**
Domain: d"""


def test_drafts(spark, tmp_path):
    (tmp_path / "draft.md").write_text(DRAFT)
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(DRAFT.split("\n"))] + [("g", 0, "**sw_mm_09**"), ("g", 1, None)], "file string, n int, line string")
    bank = files.markdown_bank(lines)
    got = {r.id: r for r in bank.collect()}
    row = lambda i: (got[i].question, got[i].nonsensical_element, got[i].domain, got[i].domain_group, got[i].difficulty, got[i].difficulty_label, got[i].technique, got[i].problem)
    assert row("leg_pnf_01") == ('"one goes on"', "quoted whole", "last", "legal", "pnf", "Plausible Nonexistent Framework", "plausible_nonexistent_framework", "")
    assert row("leg_L2_07") == ("'two' ### not a heading", "later", "", "legal", "L2", "Wrong Relationship", "wrong_relationship", "Incomplete question block for leg_L2_07: missing domain")
    assert got["sw_mm_01"].problem == "Question sw_mm_01 is outside a known domain section." == got["leg_pnf_02"].problem.replace("leg_pnf_02", "sw_mm_01")
    assert got["sw_mm_03"].problem == "Question sw_mm_03 is outside a technique/level section."
    assert got["sw_mm_04"].problem == "Incomplete question block for sw_mm_04: missing question, nonsensical_element" and got["sw_mm_09"].domain_group == ""
    assert got["sw_mm_03"].question == "b ## Lower" and len(got) == 7
    assert [r.id for r in files.sound_bank(bank.filter("problem = ''")).collect()] == ["leg_pnf_01"]
    for bad in (bank, bank.filter("problem = ''").union(bank.filter("problem = ''"))):
        with pytest.raises(ValueError):
            files.sound_bank(bad)


def test_a_dataset_lists_its_files_and_objects(spark, tmp_path):
    df = spark.createDataFrame([("a", '{"x": 1}', {"k": 1}), ("b", "{x", None), (" ", "[1]", {})], "t string, u string, m map<string,int>")
    files.write_dataset({"one": df, "two": df.limit(0)}, str(tmp_path / "set"))
    found = {(r.table, r.file.split("/")[0], r.bytes > 0) for r in files.dataset_files(spark, str(tmp_path / "set")).collect()}
    assert ("one", "one", True) in found and {x[0] for x in found} <= {"one", "two"}
    assert sorted(tuple(r) for r in publish.coverage(df).collect()) == [("m", 3, 2, 2), ("t", 3, 2, 0), ("u", 3, 3, 1)]
