import math

import numpy as np
import pytest
from evalspark.llm import embedding_dup
from evalspark.llm.embedding_dup import encode, joined, plan_bands, rotations, vector_links, widths
from evalspark.llm.queries import op10_rotated_code_links


def brute(rows, least=0.93):
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = [np.array(v, float) / np.linalg.norm(v) if ok(v) and label is not None else None for _, v, label in rows]
    links = {i: [j for j in range(len(rows)) if i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(len(rows))}
    label = [r[0] for r in rows]
    for _ in rows:
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    return sorted((rows[i][0], len(links[i]), label[i], label[i] == rows[i][0]) for i in range(len(rows)))


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted(tuple(r) for r in vector_links(df).select("id", "n_links", "component_id", "kept").collect())


def test_groups_copies_and_unusable_vectors(spark):
    r = np.random.default_rng(1)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            centre = r.normal(size=32)
            rows += [[(centre + s * r.normal(size=32)).tolist(), label] for s in (0, 0.1, 0.3, 0.35, 0.4)]
    rows += [[rows[0][0], 0]] * 5 + [[rows[0][0], 1], [None, 0], [[], 0], [[0.0] * 32, 0], [[float("nan")] * 32, 0], [[None] + [1.0] * 31, 0], [[float("inf")] * 32, 0], [[1.0, 2.0], 0], [[2.0, 4.0], 0]]
    rows = [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None, label) for i, (v, label) in enumerate(rows)]
    assert run(spark, rows) == brute(rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(tuple(r) for r in op10_rotated_code_links(spark, "/root/testdata/sf0.01").select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == brute(rows)


@pytest.mark.parametrize("n", [3000])
def test_a_large_group_of_near_copies(spark, n):
    r = np.random.default_rng(2)
    centre = r.normal(size=16)
    rows = [(i, (centre + 0.01 * r.normal(size=16)).astype(np.float32).tolist(), 3) for i in range(n)]
    got = run(spark, rows)
    assert all(g[1] == n - 1 and g[2] == 0 for g in got)


@pytest.mark.parametrize(("dims", "spread", "block"), [(2, 0.3, 64), (3, 0.25, 40), (16, 0.24, 1024), (64, 0.27, 50)])
def test_several_blocks_with_pairs_on_both_sides_of_the_threshold(spark, monkeypatch, dims, spread, block):
    monkeypatch.setattr(embedding_dup, "BLOCK", block)
    r = np.random.default_rng(dims)
    centres = r.normal(size=(3, dims))
    x = (centres[r.integers(0, 3, 240)] / np.linalg.norm(centres, axis=1).mean() + spread / math.sqrt(dims) * r.normal(size=(240, dims))).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(v) for v in vector_links(df, miss=1e-7).select("id", "n_links", "component_id", "kept").collect())
    assert got == brute(rows) and any(0 < g[1] < 70 for g in got)


@pytest.mark.parametrize("dims", [2, 3, 16, 64, 256])
def test_bounds_keep_pairs_at_the_threshold(dims):
    r = np.random.default_rng(dims)
    x, y = embedding_dup.units(r.normal(size=(2, 4000, dims)).reshape(8000, dims)).reshape(2, 4000, dims)
    y = embedding_dup.units(y - (x * y).sum(1, keepdims=True) * x)
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * y
    signs, factor = encode(x, 6, 4)
    code = (2.0 * np.unpackbits(signs, axis=1, count=dims) - 1) / math.sqrt(dims)
    estimate = (code * (y @ rotations(dims, 1)[0])).sum(1) / factor
    assert (estimate >= 0.93 - widths(factor, dims, 0.93)).all()
    assert dims < 16 or abs(estimate.mean() - 0.93) < 0.02


def test_bands_grow_with_the_table():
    assert plan_bands(10**9, 0.93)[0] > plan_bands(10**4, 0.93)[0]


def test_classes_of_a_block():
    label = joined(np.arange(7), np.array([6, 5, 2, 0]), np.array([5, 2, 1, 3]))
    assert label.tolist() == [0, 1, 1, 0, 4, 1, 1]


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("scale", [1e200, 1e-170, 1e-200, 1e300])
def test_vectors_of_extreme_magnitude(spark, scale):
    r = np.random.default_rng(8)
    x = r.normal(size=(6, 16))
    rows = [(i, (v * s).tolist(), 0) for i, (v, s) in enumerate((v, s) for v in x for s in (1.0, scale, -scale))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(x) for x in vector_links(df).select("id", "n_links", "component_id", "kept").collect())
    assert got == sorted((i, 0 if i % 3 == 2 else 1, i if i % 3 == 2 else i - i % 3, i % 3 != 1) for i in range(18))
