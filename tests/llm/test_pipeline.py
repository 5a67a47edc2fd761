import zlib
from collections import defaultdict

import corpus_pipeline as cp
import duckdb
import numpy as np
import pytest
from evalspark.llm.quality import fit_quality
from evalspark.llm.queries import id_fold, mix_sql, tokenizer_path
from test_line_dedup import expected
from test_near_dup import shingles
from tokenizers import Tokenizer

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if i == 0:
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            assert sum((k in kept) == (q == 1) for k, q in marks.items()) >= 0.97 * len(marks)
        if i == 1:
            assert docs.filter("n_chars <> length(text)").count() == 0
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    assert counts[0] > counts[1] > counts[2] >= counts[3] > counts[4] > 0


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    model = fit_quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), id_fold("doc_id", 3, 1))
    score = lambda t: model.score(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    rows = [r for r in rows if score(r["text"]) >= cp.GOOD]
    texts = expected([(r["doc_id"], r["text"]) for r in rows])
    rows = [r | {"text": texts[r["doc_id"]]} for r in rows if texts[r["doc_id"]].strip(" ") or texts[r["doc_id"]] == r["text"]]
    of = {r["doc_id"]: r["doc_id"] for r in rows}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    sets = [(r["doc_id"], shingles(r["text"])) for r in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if len(x & y) >= 0.8 * len(x | y):
                of[max(root(a), root(b))] = min(root(a), root(b))
    rows = [r for r in rows if root(r["doc_id"]) == r["doc_id"]]
    d = __import__("pandas").DataFrame(rows)  # noqa: F841
    chosen = {r[0] for r in duckdb.sql(f"select doc_id from ({mix_sql('d', 1)})").fetchall()}
    text = {r["doc_id"]: r["text"] for r in rows}
    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces, places = defaultdict(list), defaultdict(list)
    for r in cp.run(spark, SMALL).collect():
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == chosen
    for i, parts in pieces.items():
        ids = np.array([*tokenizer.encode(text[i], add_special_tokens=False).ids, 2], "<u4")
        parts.sort(key=lambda r: r.start)
        assert [r.start for r in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))] and sum(r.length for r in parts) == len(ids) == parts[0].doc_tokens
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in parts)
    for spans in places.values():
        spans.sort()
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 4096


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_take_hard_rows_and_empty_tables(spark, hard, nothing, name):
    stage = dict(cp.STAGES)[name]
    out = stage(spark, hard, SMALL)
    assert out.count() >= 0 and stage(spark, nothing, SMALL).count() == 0
    if name != "packing":
        assert out.columns == hard.columns
