import math
import zlib

import numpy as np
import pytest
from evalspark.llm import byte_cnn, ngram_linear
from evalspark.llm.quality import fit_quality, score_quality
from evalspark.llm.queries import id_fold, op2_byte_cnn_quality, op7_ngram_toxicity
from evalspark.llm.scoring import collected, training_sample
from evalspark.llm.toxicity import fit_toxicity, score_toxicity
from pyspark.sql import functions as F


@pytest.mark.parametrize(("query", "label", "folds", "fold", "least"), [(op2_byte_cnn_quality, "quality", 3, 1, 0.97), (op7_ngram_toxicity, "toxic", 5, 0, 0.95)])
def test_held_out_accuracy(spark, query, label, folds, fold, least):
    out = {r.doc_id: r for r in query(spark, "/root/testdata/sf0.1").collect()}
    marks = {r.doc_id: r[label] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(out) == 10_000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % folds == fold) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in out.items())
    test = [i for i in marks if out[i].held_out]
    assert sum(out[i].predicted == marks[i] for i in test) / len(test) >= least


@pytest.mark.parametrize(("fit", "score"), [(fit_quality, score_quality), (fit_toxicity, score_toxicity)])
def test_hard_rows_and_empty_tables(spark, hard, nothing, fit, score):
    labels = spark.range(60).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "if(id % 7 = 0, null, cast(id % 2 as int)) as toxic")
    model = fit(hard, labels, F.lit(False))
    out = score(hard, model)
    assert out.count() == hard.count() and dict(out.dtypes)["score"] == "double" and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert out.filter("text is null or text = ''").select("score").distinct().count() == 1
    assert score(nothing, model).count() == 0
    for rows in (labels.filter("false"), labels.filter("quality = 1 and toxic = 1")):
        assert score(hard, fit(hard, rows, F.lit(False))).count() == hard.count()


def test_scores_see_the_end_of_long_texts(spark):
    r = __import__("random").Random(1)
    clean = lambda n: b" ".join(r.choice([b"the", b"ording", b"ther", b"an", b"este"]) for _ in range(n))
    texts = [clean(80) for _ in range(200)] + [clean(60) + b" idiot " + clean(10) for _ in range(200)]
    model = ngram_linear.fit(spark.createDataFrame([(i, int(i >= 200), t.decode()) for i, t in enumerate(texts)], "id long, label int, text string"))
    one = lambda m, t: m.score(np.frombuffer(t, "u1"), np.array([0, len(t)]))[0]
    long = clean(60_000)
    assert one(model, long) < 0.5 < one(model, long + b" idiot")


def test_network_scores_do_not_depend_on_neighbours():
    model = byte_cnn.ByteCnn.start(8, 4, 1)
    texts = [b"", b"a", b"word " * 300, b"x" * 256, b"y" * 257, b"", b"z" * 1000]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    alone = [model.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(model.score(data, offsets), alone, atol=1e-6)


def test_fold_is_false_for_null(spark):
    assert spark.sql("select cast(null as long) as doc_id").select(id_fold("doc_id", 3, 1)).first()[0] is False


def test_repeated_ids_conflicting_labels_and_the_byte_bound(spark):
    docs = spark.range(100_000).selectExpr("1L as doc_id", "concat('same ', id % 10) as text").union(spark.createDataFrame([(2, "x" * 500), (3, None), (4, "four"), (None, "no id")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (4, 0), (4, 1), (None, 1), (5, 0), (6, 2)], "doc_id long, quality int")
    sample = training_sample(docs, labels, F.lit(False), "doc_id", "text", "quality", 100)
    assert sorted((r.id, r.label, r.text) for r in sample.collect()) == [(1, 1, "same 0"), (2, 0, "x" * 500), (3, 1, "")]
    assert sorted(collected(sample, 100)[0]) == [b"", b"same 0"] and len(collected(sample, 1000)[0]) == 3
    assert training_sample(docs, labels, F.lit(False), "doc_id", "text", "quality", 2).count() <= 2


def slow_network_score(m, t):
    """The network, one window and one chunk at a time."""
    n, width, block = max(1, -(-len(t) // byte_cnn.BLOCK)), byte_cnn.WIDTH, byte_cnn.BLOCK
    at = lambda i: t[i] if i < len(t) else 0
    size = [max(1, min(block, len(t) - k * block)) for k in range(n)]
    pooled = [[max(0.0, m.bias[f] + max(sum(m.filters[j, at(k * block + i + j), f] for j in range(width)) for i in range(size[k]))) for f in range(len(m.bias))] for k in range(n)]
    z = []
    for a, b in [(k, k + 1) for k in range(n - 1)] or [(0, 0)]:
        x = [max(p, q) for p, q in zip(pooled[a], pooled[b], strict=True)] + [math.log1p(size[a] + (size[b] if b > a else 0)) / byte_cnn.LENGTH_SCALE]
        h = [max(0.0, m.hidden_bias[g] + sum(v * m.hidden[i, g] for i, v in enumerate(x))) for g in range(len(m.out))]
        z.append(m.out_bias[0] + sum(v * m.out[g] for g, v in enumerate(h)))
    return 1 / (1 + math.exp(-sum(z) / len(z)))


def test_network_equals_a_slow_one():
    model = byte_cnn.ByteCnn.start(5, 3, 2)
    model.bias[:], model.out_bias[:] = 0.1, -0.2
    for t in (b"", b"a", "é word ".encode() * 20, b"x" * 256, bytes(range(1, 255)) * 3):
        assert abs(model.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] - slow_network_score(model, t)) < 1e-5


def test_gradients_equal_differences():
    model = byte_cnn.ByteCnn.start(4, 3, 5)
    texts, y, w = [b"good words " * 60, b"", b"bad"], np.array([1, 0, 0], np.float32), np.array([1.0, 0.5, 2.0])

    def loss():
        p = np.array([slow_network_score(model, t) for t in texts])
        return -np.mean(w * (y * np.log(p) + (1 - y) * np.log(1 - p)))

    for p, g in list(zip(model.params(), byte_cnn._gradients(model, texts, y, w), strict=True))[2:]:
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[i]
        p[i] = old + 1e-2
        up = loss()
        p[i] = old - 1e-2
        down = loss()
        p[i] = old
        assert abs((up - down) / 2e-2 - g[i]) < 2e-3 + 0.05 * abs(g[i])


def test_ngram_scores_equal_a_slow_scorer(spark):
    r = __import__("random").Random(4)
    texts = [" ".join(r.choice(["The", "öffne", "an", "este", "idiot" if i % 3 == 0 else "thing"]) for _ in range(r.randrange(1, 60))) for i in range(120)] + ["", "ab"]
    model = ngram_linear.fit(spark.createDataFrame([(i, int(i % 3 == 0), t) for i, t in enumerate(texts)], "id long, label int, text string"), features=50)
    for t in [*texts, "IDIOT"]:
        points = [ord(c.lower()) if c.isascii() else ord(c) for c in t]
        grams = {int(ngram_linear.hashes(np.array(points[i : i + n], np.uint32), n)[0]) for n in ngram_linear.SIZES for i in range(len(points) - n + 1)}
        z = model.bias + sum(model.weight[model.slot[g]] for g in grams if model.slot[g] >= 0)
        data = t.encode()
        assert abs(model.score(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
