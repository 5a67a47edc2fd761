import random
import re
import time

import pytest
from evalspark.llm import line_dedup
from evalspark.llm.line_dedup import SHORT, dedup_lines, with_lines, without
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def normal(s):
    return re.sub(r"\s+", " ", s.lower(), flags=re.A).strip(" ")


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :])


def expected(rows, short=SHORT):
    seen, out = [], {}
    for i, t in sorted(rows):
        keep = []
        for line in t.split("\n"):
            n = normal(line)
            late = n and any(n == m or (min(len(n), len(m)) >= short and within_one(n, m)) for m in seen)
            if n:
                seen.append(n)
            if not late:
                keep.append(line)
        out[i] = "\n".join(keep)
    return out


def check(spark, rows, short=SHORT):
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), short=short).collect()}
    assert got == expected(rows, short)


def test_edits_of_each_kind(spark):
    base = "the quick brown fox jumps over the lazy dog"
    lines = [base, base[:5] + base[6:], base[:20] + "X" + base[20:], base[:30] + "Z" + base[31:], base[2:], "zz" + base, base + "s", "x" + base[1:], base.upper(), base.replace("quick", "slow")]
    check(spark, [(i, f"{line}\nown line of document {chr(97 + i) * 9}") for i, line in enumerate(lines)])


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text("ab", min_size=0, max_size=22), min_size=1, max_size=5), min_size=1, max_size=12))
def test_against_brute_force(spark, docs):
    check(spark, [(i, "\n".join(d)) for i, d in enumerate(docs)])


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 300), st.lists(st.tuples(st.integers(0, 299), st.sampled_from(["", "x", "yz", " ", "é\t"])), max_size=2)), min_size=2, max_size=30), st.randoms(use_true_random=False))
def test_long_lines_against_brute_force(spark, cuts, r):
    base = "".join(r.choice("abcdefgh  ") for _ in range(300))
    lines = []
    for n, edits in cuts:
        line = base[:n]
        for at, new in edits:
            line = line[:at] + new + line[at + 1 :]
        lines.append(line)
    check(spark, [(i, "\n".join(lines[i::5])) for i in range(5)])


def test_short_lines_by_parameter(spark):
    check(spark, [(0, "a\nb\nab\nabc"), (1, "xyz\nxz\nqqqq\nq"), (2, "Ab\tc\n\nzzzz"), (3, "same  words\nsame words\nsame\twords")], short=1)


def test_very_many_lines_in_one_document(spark):
    n = 100_000
    text = "\n".join(f"line number {i} of a long list" if i % 3 else "one and the same line" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    assert df.select(F.size(with_lines(F.col("text"), lambda x: without(x, F.sequence(F.lit(1), F.lit(n - 1), F.lit(3))))).alias("n")).first().n == n - n // 3
    assert time.time() - start < 30
    same = spark.createDataFrame([(1, "\n".join(["one and the same line"] * n))], "doc_id long, text string")
    row = dedup_lines(same).first()
    assert row.text == "one and the same line" and row.lines_dropped == n - 1


def test_lines_that_differ_in_several_digits_stay(spark):
    texts = ["12 March 1998: 340 of 512 votes", "30 March 2004: 918 of 777 votes", "Price: 19.90", "Price: 24.95", "12 March 1998: 340 of 513 votes", "10:15", "10:16"]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: "" if i == 4 else t for i, t in enumerate(texts)}


def test_hard_rows_and_empty_table(hard, nothing):
    out = dedup_lines(hard)
    rows = out.collect()
    assert len(rows) == hard.count() and set(out.columns) == {*hard.columns, "lines_dropped"}
    assert sum(r.text is None for r in rows) == 1
    same = next(r for r in rows if r.text and r.text.startswith("The same"))
    assert same.text == "The same line here.\nAnd another line." and same.lines_dropped == 1
    assert dedup_lines(nothing).count() == 0


@pytest.mark.parametrize("n", [500, 3000])
def test_a_large_group_keeps_one_line(spark, n):
    line = "a very common line of text that many documents share"
    rows = [(i, line[: i % 40] + ("#" if i else "") + line[i % 40 + (i % 2) :]) for i in range(n)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("text <> ''").collect()
    assert {r.doc_id for r in got} == {0}


def test_normal_and_blank_of_odd_white_space(spark):
    r = random.Random(5)
    odd = ["".join(r.choice(" \t\n\v\f\r  aBÉİ\u00a0\u0085\u2003") for _ in range(r.randrange(8))) for _ in range(3000)]
    rows = spark.createDataFrame([(x,) for x in odd], "x string").select("x", line_dedup.normal(F.col("x")).alias("n"), line_dedup.blank(F.col("x")).alias("b")).collect()
    assert [(x.x, x.n, x.b) for x in rows] == [(x, normal(x), normal(x) == "") for x in odd]


def test_keys_are_compiled_and_shared_within_one_edit(spark):
    r = random.Random(6)
    lines = ["".join(r.choice("abc é") for _ in range(n)) for n in range(1, 120)]
    near = [x[: len(x) // 2] + y + x[len(x) // 2 + k :] for x in lines for y, k in (("z", 0), ("z", 1), ("", 1))]
    for parts in (line_dedup.COARSE, line_dedup.FINE):
        keyed = line_dedup.block_keys(spark.createDataFrame([(x,) for x in [*lines, *near]], "line string"), parts)
        assert "lambda" not in keyed._jdf.queryExecution().executedPlan().toString()
        keys = {x.line: {k.key for k in x.keys} for x in keyed.collect()}
        assert all(keys[x] & keys[y] for i, x in enumerate(lines) for y in near[3 * i : 3 * i + 3] if y)
