import hashlib
import re
from collections import Counter
from datetime import date, timedelta
from decimal import Decimal

from evalspark.llm.fingerprint import LEAF_PATTERN, SECTION, fingerprint_edits, likeness, merkle, with_next
from evalspark.llm.queries import op3_merkle_fingerprints
from pyspark.sql import functions as F


def test_edits_follow_the_contract(spark):
    out = {r.doc_id: r for r in op3_merkle_fingerprints(spark, "/root/testdata/sf0.01").collect()}
    docs = sorted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    prints = {}
    for i, d in enumerate(docs):
        after, n = docs[(i + 1) % len(docs)].text, len(d.text)
        edited = d.text[: n - n // 4] + after[: n // 4]
        r = out[d.doc_id]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint == r.edited_fingerprint) == (edited == d.text)
        assert prints.setdefault(d.text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        if n > 400 and after != d.text:
            assert r.near_edited > 0.5 > r.near_next
    assert len(set(prints.values())) == len(prints)


def test_differences_are_located(spark):
    text = "\n".join(f"Paragraph number {i} of the text." for i in range(20))
    rows = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    got = fingerprint_edits(rows).filter("id = 1").first()
    quarter = len(text) - len(text) // 4
    changed = next(i for i in range(20) if sum(len(x) + 1 for x in text.split("\n")[: i + 1]) > quarter)
    assert got.first_edit == changed and got.near_next == 1.0


def test_repeats_count(spark):
    def leaves(t):
        return Counter(x for p in t.split("\n") for x in re.findall(LEAF_PATTERN, p))

    line = "The same line again and again."
    texts = ["\n".join([line] * n) for n in (10, 1000)] + ["", "\n".join([line] * 30 + [f"Line {i} of the end." for i in range(20)]), "Other. Other. No. " + f"{line}\n{line} Other."]
    pairs = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", merkle(F.col("a")).alias("x"), merkle(F.col("b")).alias("y"))
    for r in df.select("a", "b", likeness(F.col("x"), F.col("y")).alias("v")).collect():
        size = lambda c: sum(len(x) * n for x, n in c.items())
        a, b = leaves(r.a), leaves(r.b)
        assert r.v == (1.0 if r.a == r.b else 2.0 * size(a & b) / (size(a) + size(b)))


def slow_tree(text):
    """Root, and per section its digest, paragraph digests and leaves."""
    sha = lambda level, parts: hashlib.sha256((level + "".join(parts)).encode()).hexdigest()
    lines = [re.findall(LEAF_PATTERN, p) for p in text.split("\n")]
    digests = [sha("p", [sha("l", [x]) for x in leaves]) for leaves in lines]
    sections = [(sha("s", digests[i : i + SECTION]), digests[i : i + SECTION], [x for leaves in lines[i : i + SECTION] for x in leaves]) for i in range(0, len(lines), SECTION)]
    return sha("r", [s[0] for s in sections]), sections


def slow_likeness(a, b):
    (root_a, x), (root_b, y) = slow_tree(a), slow_tree(b)
    size = lambda c: sum(len(t) * n for t, n in c.items())
    p, q = (Counter(t for s in sections for t in s[2]) for sections in (x, y))
    return 1.0 if root_a == root_b else 2.0 * size(p & q) / (size(p) + size(q)) if size(p) + size(q) else 0.0


def test_trees_equal_slow_ones(spark):
    docs = sorted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in op3_merkle_fingerprints(spark, "/root/testdata/sf0.01").collect()}
    for i, d in enumerate(docs):
        after, n, r = docs[(i + 1) % len(docs)].text, len(d.text), got[d.doc_id]
        edited = d.text[: n - n // 4] + after[: n // 4]
        assert r.fingerprint == slow_tree(d.text)[0] and r.edited_fingerprint == slow_tree(edited)[0]
        assert abs(r.near_edited - slow_likeness(d.text, edited)) < 1e-12 and abs(r.near_next - slow_likeness(d.text, after)) < 1e-12
        paragraphs = [[p for s in slow_tree(t)[1] for p in s[1]] for t in (d.text, edited)]
        longer = max(map(len, paragraphs))
        assert r.first_edit == next((k for k in range(longer) if paragraphs[0][k : k + 1] != paragraphs[1][k : k + 1]), None)


def test_ids_of_any_type(spark):
    texts = [f"text number {i}" for i in range(60)]
    for kind, name in (("string", lambda i: f"https://example.org/{i:03d}"), ("decimal(12,2)", lambda i: Decimal(i)), ("date", lambda i: date(2024, 1, 1) + timedelta(i))):
        df = spark.createDataFrame([(name(i), t) for i, t in enumerate(texts)], f"doc_id {kind}, text string")
        by: dict = {}
        for r in with_next(df, rows_per_bucket=7).collect():
            by.setdefault(r.bucket, []).append((r.ghost, r.id, r.text))
        nexts = {a[2]: b[2] for rows in by.values() for a, b in zip(sorted(rows), sorted(rows)[1:], strict=False) if not a[0]}
        assert len(by) > 3 and nexts == {t: texts[(i + 1) % 60] for i, t in enumerate(texts)}


def test_many_buckets_agree_with_one(spark):
    from evalspark.llm import fingerprint as f

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    nexts = {}
    for size in (10_000, 7):
        rows = f.with_next(docs, rows_per_bucket=size)
        pairs = {}
        by = {}
        for r in rows.collect():
            by.setdefault(r.bucket, []).append(r)
        for b in by.values():
            b.sort(key=lambda r: (r.ghost, r.id, r.text))
            pairs |= {x.id: y.id for x, y in zip(b, b[1:], strict=False) if not x.ghost}
        nexts[size] = pairs
    assert nexts[10_000] == nexts[7] and len(nexts[7]) == docs.count()


def test_hard_rows_and_empty_table(hard, nothing):
    out = fingerprint_edits(hard).collect()
    assert len(out) == hard.count()
    assert len({r.tree.root for r in out if r.text == ""}) == 1
    assert fingerprint_edits(nothing).count() == 0
