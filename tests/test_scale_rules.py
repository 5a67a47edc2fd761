"""Orders, rule tables and early stops: the same answers as slow versions, and plans that scale."""

import copy
import json
import random

import pytest
from evalspark.operators import expand, pairwise
from evalspark.operators.order import numbered
from pyspark.sql import functions as F


@pytest.mark.parametrize("seed", [1, 2])
def test_places_are_a_total_order(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]), r.randrange(5) if r.random() < 0.8 else None, f"s{i % 150}", i % 3) for i in range(400)] + [("b", 1, "same", 1)] * 300
    df = spark.createDataFrame(rows, "model string, run int, id string, place int")
    by = [F.coalesce("model", F.lit("")), -F.coalesce("run", F.lit(0))]
    got = sorted(((x.place, x.model, x.run, x.id) for x in numbered(df, by, ranges=7).collect()), key=lambda x: x[0])
    assert [x[0] for x in got] == list(range(1, 701))
    keys = [(x[1] or "", -(x[2] or 0)) for x in got]
    assert keys == sorted(keys) and sorted(map(str, (x[1:] for x in got))) == sorted(str(x[:3]) for x in rows)
    assert numbered(df.limit(0), by).collect() == []


def test_no_task_orders_the_whole_table(spark):
    df = spark.range(50_000).selectExpr("'hot' as model", "cast(id % 3 as int) as run", "1 as same")
    out = numbered(df, [F.col("model"), F.col("run")], ranges=10)
    sizes = [x["count"] for x in out.groupBy(F.floor((F.col("place") - 1) / 5000)).count().collect()]
    assert sum(sizes) == 50_000 and set(sizes) == {5000}
    assert out.filter("run = 0").agg(F.min("place"), F.max("place")).first()[:] == (1, 16_667)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0]


def provider(model, rules, default):
    ok = lambda p: p == model or p == "*" or (p.endswith("/*") and model.startswith(p[:-1]))
    rank = lambda p: 1 << 30 if p == model else 0 if p == "*" else len(p)
    return rules[max(filter(ok, rules), key=rank)] if any(map(ok, rules)) else default


def test_many_rules_over_many_models(spark):
    r = random.Random(3)
    name = lambda: "/".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(r.randrange(1, 4)))
    rules = {}
    for i in range(3000):
        rules[name() + r.choice(["", "/*"])] = f"p{i}"
    models = sorted({name() for _ in range(3000)} | {"", "/", "a//b", "*"})
    df = spark.createDataFrame([(m,) for m in models], "model_id string")
    for with_all in (False, True):
        table = rules | ({"*": "any"} if with_all else {})
        got = {x.model_id: x.provider for x in expand.routed(df, expand.provider_rules(spark, table), "none").collect()}
        assert got == {m: provider(m, table, "none") for m in models}


def test_rules_are_joined_not_unrolled(spark):
    models = spark.range(200_000).selectExpr("concat('org', id % 500, '/m', id) as model_id")
    rules = spark.range(100_000).selectExpr("if(id < 400, concat('org', id, '/*'), concat('org', id % 500, '/m', id)) as pattern", "concat('p', id) as provider")
    out = expand.routed(models, rules, "none")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE" in plan.upper() and len(plan) < 20_000 and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.groupBy(F.col("provider") == "none").count().collect()
    exact = [i for i in range(200_000) if i % 500 >= 400 and not 400 <= i < 100_000]
    assert {x[0]: x[1] for x in got} == {True: len(exact), False: 200_000 - len(exact)}


def merged(below, above):
    out = copy.deepcopy(below)
    for k, v in above.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_settings_cascade_like_nested_merges(spark, seed):
    r = random.Random(seed)

    def tree(depth=0):
        return {k: tree(depth + 1) if depth < 3 and r.random() < 0.5 else r.randrange(9) for k in r.sample("abcd", r.randrange(1, 4))}

    rules = {p: tree() for p in ("*", "o/*", "o/p/*", "o/p/m", "o/m", "q/*")}
    models = ["o/p/m", "o/p/n", "o/m", "o/x", "q/m", "z"]
    got = {}
    for x in expand.overrides(spark.createDataFrame([(m,) for m in models], "model_id string"), expand.override_rules(spark, rules)).collect():
        assert x.path not in got.setdefault(x.model_id, {})
        got[x.model_id][x.path] = json.loads(x.value)
    for m in models:
        want = {}
        for p in sorted((p for p in rules if p == "*" or p == m or (p.endswith("/*") and m.startswith(p[:-1]))), key=lambda p: 1 << 30 if p == m else 0 if p == "*" else len(p)):
            want = merged(want, rules[p])
        assert got[m] == {path: json.loads(v) for path, v in expand.leaves(want)}


def test_an_event_limit_stops_early(spark):
    rows = [(f"q{q:03d}", f"m{m:02d}", m * 10_000 % 30_001, "t", "d", f"s{q}-{m}", q) for q in range(200) for m in range(q % 7)]
    df = spark.createDataFrame(rows, "question_id string, model string, c4 long, technique string, domain string, sample_id string, pos int")
    every = sorted((x.question_id, x.system_a, x.system_b) for x in pairwise.events(df, "v1").collect())
    for n in (0, 1, 3, 50, len(every), len(every) + 9):
        assert sorted((x.question_id, x.system_a, x.system_b) for x in pairwise.first_events(df, "v1", n).collect()) == every[:n]
        made = pairwise.reached(df, n).agg(F.sum("events")).first()[0] or 0
        assert min(n, len(every)) <= made < n + 15
