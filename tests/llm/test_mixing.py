import duckdb
import pytest
from evalspark.llm.mixing import leaf_budgets, mix
from evalspark.llm.queries import WEIGHTS, mix_levels, mix_sql, op6_hierarchical_mix
from pyspark.sql import functions as F


def fill(budget, children):
    """Budgets of {name: (weight, capacity)} by repeated sharing."""
    given, left, open_ = {}, budget, dict(children)
    while True:
        w = sum(x[0] for x in open_.values())
        full = {n for n, (a, c) in open_.items() if c * w <= a * left}
        if not full:
            return given | {n: a * left // w for n, (a, c) in open_.items()}
        for n in full:
            given[n] = open_.pop(n)[1]
            left -= given[n]
        if not open_:
            return given


def test_shortages_go_to_siblings_before_ancestors(spark):
    rows = [("a", "en", "s1", 100), ("a", "en", "s2", 5000), ("a", "de", "s3", 5000), ("b", "en", "s1", 50), ("b", "de", "s4", 50), ("c", "en", "s9", 9000)]
    weights = {"domain": {"a": 2, "b": 1, "c": 1}, "lang": {"en": 3, "de": 1}, "source": {"s1": 2}}
    got = {(r.domain, r.lang, r.source): r.given for r in leaf_budgets(spark.createDataFrame(rows, "domain string, lang string, source string, tokens long"), ["domain", "lang", "source"], weights, 8000, 1).collect()}
    top = fill(8000, {"a": (2, 10100), "b": (1, 100), "c": (1, 9000)})
    a = fill(top["a"], {"en": (3, 5100), "de": (1, 5000)})
    en = fill(a["en"], {"s1": (2, 100), "s2": (1, 5000)})
    assert got[("b", "en", "s1")] == 50 and got[("b", "de", "s4")] == 50
    assert got[("a", "en", "s1")] == en["s1"] == 100 and got[("a", "en", "s2")] == en["s2"] and got[("a", "de", "s3")] == a["de"] and got[("c", "en", "s9")] == top["c"]
    assert 8000 - 4 <= sum(got.values()) <= 8000


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    got = sorted(tuple(r) for r in op6_hierarchical_mix(spark, f"/root/testdata/{sf}").select("doc_id", "domain", "lang", "source", "tokens", "epoch").collect())
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    assert got == sorted(c.sql(f"select doc_id, domain, lang, source, tokens, epoch from ({mix_sql()})").fetchall())


def test_epochs_and_hard_rows(hard, nothing):
    out = mix(hard, mix_levels(), WEIGHTS, budget=10**9, max_epochs=3)
    per = {tuple(r) for r in out.filter("tokens > 0").groupBy("doc_id", "text", F.col("tokens")).agg(F.count_distinct("epoch")).select("count(DISTINCT epoch)").collect()}
    assert per == {(3,)}
    assert out.filter("source = 'none'").count() > 0 and set(hard.columns) <= set(out.columns)
    half = mix(hard, mix_levels(), WEIGHTS, max_epochs=1)
    total = hard.select(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\r]+")))).first()[0]
    assert 0 < half.agg(F.sum("tokens")).first()[0] <= total // 2
    assert mix(nothing, mix_levels(), WEIGHTS).count() == 0
