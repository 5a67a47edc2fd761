import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from evalspark.llm.filter_audit import audit, audit_documents, audit_part, lehmer_rank, removal_intervals
from evalspark.llm.queries import op12_filter_interaction_audit

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(rows):
    """rows: (part, set of failing letters, good, toxic)"""
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        made, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = sum(f in r[1] for r in mine)
                shapley[f] += len(gone)
                made.append(("".join(order), step, f, len(left), len(gone), fails - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(part, order, step, *rest, shapley[f]) for order, step, f, *rest in made]
    return sorted(out)


def failing(docs, labels):
    marks = {}
    for i, q, t in labels:
        good, toxic = marks.get(i, (0, 0))
        marks[i] = (max(good, int(q == 1)), max(toxic, int(t == 1)))
    out = []
    for i, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A"} if len(words) < 200 else set()
        bad |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        bad |= {"D"} if re.search("[#$%&*|]", t) else set()
        bad |= {"E"} if any((u or "") == t and j is not None and (i is None or j < i) for j, u, _ in docs) else set()
        out.append((lang or "", bad, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    return out


def got(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_ranks_and_intervals():
    orders = list(permutations(range(5)))
    assert [lehmer_rank(o, 5) for o in orders] == list(range(120))
    for mask in range(32):
        steps = {}
        for step, first, after in removal_intervals(mask, 5):
            for rank in range(first, after):
                assert rank not in steps
                steps[rank] = step
        assert steps == {rank: next(k for k, f in enumerate(o) if mask >> f & 1) for rank, o in enumerate(orders) if mask}


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_other_numbers_of_filters(n):
    r = np.random.default_rng(n)
    masks, counts = np.arange(1 << n), r.integers(0, 1 << 50, (1 << n, 3))
    made = audit_part(masks, counts, n)
    for rank, order in enumerate(permutations(range(n))):
        left = set(range(1 << n))
        for step, f in enumerate(order):
            gone = {m for m in left if m >> f & 1}
            left -= gone
            at = rank * n + step
            assert made["removed"][at] == sum(int(counts[m, 0]) for m in gone) and made["kept"][at] == sum(int(counts[m, 0]) for m in left)
            assert made["good_lost"][at] == sum(int(counts[m, 1]) for m in gone)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert got(op12_filter_interaction_audit(spark, sf)) == brute(failing(docs, labels))


def test_hard_rows(spark, hard, nothing):
    r = random.Random(4)
    ids = [*range(75), None]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None]), "x") for i in ids for _ in range(r.randrange(3))]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    docs = [(x.doc_id, x.text, x.lang) for x in hard.collect()]
    extra = [(None, "text without an id here", None), (None, None, "en"), (2, "", "fr"), (7, docs[7][1], "en"), (4, "AB# " * 300, None)]
    both = hard.select("doc_id", "text", "lang").union(spark.createDataFrame(extra, "doc_id long, text string, lang string")).selectExpr("*", "1 as mask", "2 as part", "3 as n", "4 as digest", "5 as good")
    assert got(audit_documents(both, marks)) == brute(failing([*docs, *extra], [x[:3] for x in labels]))
    assert audit_documents(nothing, marks).collect() == []
    assert got(audit_documents(hard, marks.limit(0))) == brute(failing(docs, []))


def test_counts_of_one_mask_are_added_up(spark):
    rows = spark.createDataFrame([("p", 1, 2, 1, 0), ("p", 1, 3, 0, 1), ("p", 3, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    a = {(r.filter_order, r.step): r for r in audit(rows, "AB").collect()}
    assert (a["AB", 1].removed, a["AB", 2].redundant, a["BA", 2].removed, a["BA", 1].removed, a["AB", 1].shapley, a["AB", 1].unique_fails) == (6, 1, 5, 1, 11, 5)
