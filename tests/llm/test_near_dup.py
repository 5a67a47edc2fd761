import random

import numpy as np
from evalspark.llm import near_dup
from evalspark.llm.near_dup import Sketcher, aligned_likeness, banded_common, keep_one, may_reach, near_duplicates
from evalspark.llm.queries import op8_order_minhash_near_dup


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_banded_alignment_is_exact_where_it_matters():
    r = random.Random(1)
    for _ in range(1500):
        a = [r.randrange(r.choice([3, 10, 1000])) for _ in range(r.randrange(5, 70))]
        b = list(a)
        for _ in range(r.randrange(7)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randrange(2)] = [r.randrange(9)] * r.randrange(2)
        needed = 0.8 * (len(a) + len(b)) / 1.8
        found, true = banded_common(a, b, int(len(a) + len(b) - 2 * needed) + 1), lcs(a, b)
        assert found <= true and (true < needed or found == true)


def test_sketches_do_not_depend_on_neighbours():
    texts = [b"", b"one", b"a b c d e f", b"  spaced\tout\nWords ", b"a b c d e f a b c d e f", b""]
    flat = lambda ts: (np.frombuffer(b"".join(ts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in ts])]))
    s = Sketcher()
    rows, n = s.sketch(*flat(texts))
    for t, row, k in zip(texts, rows, n, strict=True):
        alone, m = s.sketch(*flat([t]))
        assert m[0] == k and (k == 0 or (alone[0] == row).all())
    assert list(n) == [0, 1, 2, 1, 8, 0]
    upper, _ = s.sketch(*flat([b"A B C D E F"]))
    assert (upper[0] == rows[2]).all()


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_classes_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    of = {r.doc_id: r.doc_id for r in docs}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    sets = [(r.doc_id, shingles(r.text)) for r in docs]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                of[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: r.class_id for r in op8_order_minhash_near_dup(spark, "/root/testdata/sf0.01").collect()}
    assert got == {d: root(d) for d in of}


def test_places_rule_out_no_pair(spark):
    r = random.Random(3)
    rows, alike = [], 0
    for _ in range(3000):
        one = set(r.sample(range(400), r.randrange(1, 120)))
        two = {x for x in one if r.random() > 0.08} | set(r.sample(range(400), r.randrange(9)))
        if one & two:
            x, y, first = sorted(one), sorted(two), min(one & two)
            rows.append((len(x), len(y), x.index(first), y.index(first), len(one & two) >= 0.8 * len(one | two)))
            alike += rows[-1][-1]
    pairs = spark.createDataFrame(rows, "na long, nb long, ata long, atb long, alike boolean").withColumn("may", may_reach(0.8))
    assert alike > 500 and pairs.filter("alike and not may").count() == 0
    assert pairs.filter("not may").count() > 100


def test_a_large_group_of_near_copies_and_order(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(400):
        t = list(base)
        for _ in range(2):
            t[r.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows.append((1000, " ".join(base[150:] + base[:150])))
    rows += [(2000 + i, " ".join(f"y{i}_{j}" for j in range(50))) for i in range(50)]
    got = {x.id: x.class_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(400)} == {0}
    assert got[1000] == 1000 and all(got[2000 + i] == 2000 + i for i in range(50))
    assert aligned_likeness(rows[0][1].encode(), rows[400][1].encode()) == 0.0


def test_hard_rows_and_empty_table(hard, nothing):
    out = near_duplicates(hard)
    rows = out.collect()
    assert len(rows) == hard.count()
    empty = {r.class_id for r in rows if r.id in (0, 1, 2)}
    assert empty == {0}
    one = keep_one(hard)
    assert one.columns == hard.columns and one.count() == len({(r.class_id, r.node if r.class_id is None else 0) for r in rows})
    assert near_duplicates(nothing).count() == 0 and keep_one(nothing).count() == 0


def test_only_candidates_leave_the_join(spark):
    r = random.Random(3)
    rows = []
    for k in range(60):
        sketch = [r.randrange(1, 1 << 60) for _ in range(16)]
        for node in (2 * k, 2 * k + 1):  # agree in k % 4 sketches
            mine = [x if i < k % 4 else r.randrange(1, 1 << 60) for i, x in enumerate(sketch)]
            rows += [(t, node, node % 3, 100, at, mine) for t, at in ((k % 7, 0), (100 + k, 1 if k % 5 else 90))]
    df = spark.createDataFrame(rows, "token long, node long, label long, n long, at long, sketch array<long>")
    agree = lambda x, y: sum(p == q for p, q in zip(x[5], y[5], strict=True)) >= 2
    may = lambda x, y: min(x[3] - x[4], y[3] - y[4]) >= (x[3] + y[3]) * 0.8 / 1.8 - 1e-6
    want = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[2] != y[2] and may(x, y) and agree(x, y)}
    out = near_dup.agreeing(df, 0.8)
    assert {(x.a, x.b) for x in out.collect()} == want and len(want) > 10
    # the agreement is part of the join itself
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x]
    assert len(joins) == 1 and "sa#" in joins[0] and "sb#" in joins[0]
