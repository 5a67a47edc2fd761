import hashlib
import math
import random

import numpy as np
import pytest
from evalspark.llm.queries import op13_limb_split_codes
from evalspark.llm.vector_codes import dot_products, limbs, most_component, nearest, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, id string, code string, ints string, slot string"


def brute(rows):
    """Plain Python integers throughout."""
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if ok(v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // 8))
    kept = [(i, v + [0] * (8 * width - len(v)), label) for i, v, label in sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))]
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(b)), key=lambda e: (far(part(v, p), b[e]), e)) for p, b in enumerate(books)] for _, v, _ in kept]
    for _ in range(6):
        codes = assign()
        for p, b in enumerate(books):
            for e in range(len(b)):
                mine = [part(v, p) for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == e]
                if mine:
                    b[e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    codes = assign()
    errors = [sum(far(part(v, p), books[p][c[p]]) for p in range(8)) for (_, v, _), c in zip(kept, codes, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by = {label: sum(e for e, k in zip(errors, kept, strict=True) if k[2] == label) for label in {k[2] for k in kept}}
    return sorted(((i, "".join(f"{x:02x}" for x in c), e, by[label], digest) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in vector_codes(df).select("id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("bound", [1, 1 << 12, 1 << 27, 1 << 29])
def test_products_of_limbs_are_exact(bound):
    r = np.random.default_rng(bound)
    for width in (1, 3, 8):
        x, y = (r.integers(-bound, bound + 1, (n, width)) for n in (40, 16))
        x[0], y[0] = -bound, bound
        want = [[sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for q in y] for p in x]
        assert dot_products(x, y).tolist() == want
        if bound <= most_component(width):
            at, far = nearest(x, y)
            exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in y] for p in x]
            assert at.tolist() == [d.index(min(d)) for d in exact] and far.tolist() == [min(d) for d in exact]
    assert sum(int(a) << (20 * k) for k, a in enumerate(z[0, 0] for z in limbs(np.array([[-bound]]), 20))) == -bound


def test_ties_go_to_the_lower_entry():
    assert nearest(np.array([[0], [5]]), np.array([[1], [-1], [1], [5], [5]]))[0].tolist() == [0, 3]


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted((tuple(r) for r in op13_limb_split_codes(spark, "/root/testdata/sf0.001").select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str) == brute(rows)


def test_hard_vectors(spark):
    r = random.Random(5)
    v = lambda n=16, s=1.0: [r.gauss(0, s) for _ in range(n)]
    rows = [(i, v(), i % 3 if i % 4 else None) for i in range(60)] + [(60, None, 0), (61, [float("nan"), *v(15)], 0), (62, [None, *v(15)], 0), (63, [float("inf"), *v(15)], 1), (64, [], 1), (65, v(3), 1), (66, v(13), 2), (None, v(), 0)]
    rows += [rows[0], rows[1], (2, v(), 1), (70, [-1e-9] * 16, 1), (71, [-1.0 / 4096] * 16, 1), (72, [0.0] * 16, 1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:5]) == brute(rows[:5])
    assert run(spark, []) == [] and run(spark, [(1, None, 0)]) == [] and run(spark, [(1, [], None)]) == brute([(1, [], None)])


def test_components_of_several_limbs(spark):
    r = random.Random(6)
    rows = [(i, [r.uniform(-90_000, 90_000) for _ in range(16)], i % 2) for i in range(50)]
    assert run(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="too large for exact distances"):
        run(spark, [(1, [1e12] * 8, 0)])
