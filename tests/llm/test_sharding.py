import random
from collections import Counter, defaultdict

from evalspark.llm.common import range_of
from evalspark.llm.sharding import find_splitters, histogram_shards
from pyspark.sql import functions as F


def test_shards_are_near_equal_in_bytes_and_slots_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = histogram_shards(docs, 16).select("doc_id", "size", "shard", "slot", "text").collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.size == len(r.text.encode()) + 1 for r in rows)
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    most = max(r.size for r in rows)
    mean = sum(load.values()) / 16
    assert all(abs(v - mean) <= most + 0.02 * mean for v in load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_equal_texts_stay_together_unless_they_must_be_cut(spark):
    small = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id div 4) as text")
    by = defaultdict(set)
    for r in histogram_shards(small, 8).collect():
        by[r.text].add(r.shard)
    assert sum(len(s) > 1 for s in by.values()) == 0
    hot = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'copy', concat('text ', id)) as text")
    load = Counter()
    for r in histogram_shards(hot, 8).collect():
        load[r.shard] += r.size
    assert max(load.values()) < 1.05 * min(load.values())


def test_hard_rows_and_empty_table(hard, nothing):
    out = histogram_shards(hard, 4)
    assert out.count() == hard.count()
    assert set(out.columns) == {*hard.columns, "size", "slot"} and dict(out.dtypes)["shard"] == "int"
    assert {r.size for r in out.filter("text is null or text = ''").collect()} == {1}
    assert histogram_shards(nothing, 4).count() == 0


def test_range_of_counts_splitters(spark):
    for n in (0, 1, 7, 300):
        cuts = [3 * i for i in range(n)]
        got = spark.range(-2, 1000).select("id", range_of(F.col("id"), cuts).alias("r")).collect()
        assert all(r.r == sum(c <= r.id for c in cuts) for r in got)


def test_splitters_equal_sorted_prefix_sums(spark):
    r = random.Random(2)
    rows = [(r.randrange(1 << 63), r.randrange(1, 500)) for _ in range(3000)] + [(123 << 40, 50)] * 900 + [((123 << 40) + i, 7) for i in range(300)]
    total = sum(s for _, s in rows)
    targets = [(total * j / 40, total / 40 * (0.005 if j % 5 == 0 else 0.5)) for j in range(1, 40)]
    got = find_splitters(spark.createDataFrame(rows, "key long, size long"), targets)
    edges, below = [0], 0
    for key in sorted({k for k, _ in rows}):
        below += sum(s for k, s in rows if k == key)
        edges.append(below)
    assert got == sorted(got)
    for s, (target, slack) in zip(got, targets, strict=True):
        best = min(abs(e - target) for e in edges)
        assert abs(sum(z for k, z in rows if k < s) - target) <= max(slack, best) + 1e-6
