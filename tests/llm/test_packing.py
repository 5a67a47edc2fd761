import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from evalspark.llm.packing import WordIds, pack
from evalspark.llm.queries import op9_bounded_space_packing, tokenizer_path
from tokenizers import Tokenizer

TOK = Tokenizer.from_file(tokenizer_path())


def ids_of(text):
    return np.array([*TOK.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_whole_table(spark):
    docs = {r.doc_id: ids_of(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    spans, windows = defaultdict(list), defaultdict(list)
    for r in op9_bounded_space_packing(spark, "/root/testdata/sf0.001").collect():
        x = docs[r.doc_id]
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())
        spans[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for k, parts in [*((d, s) for d, s in spans.items()), *windows.items()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
    assert all(sum(n for _, n in s) == len(docs[d]) for d, s in spans.items()) and set(spans) == set(docs)
    fill = [sum(n for _, n in w) for w in windows.values()]
    assert max(fill) <= 4096 and sum(fill) / (4096 * len(fill)) > 0.96


@pytest.mark.parametrize("partitions", [1, 3])
def test_small_windows_hard_rows_and_empty_table(spark, hard, nothing, partitions):
    rows = pack(hard.repartition(partitions), tokenizer_path(), length=64, open_windows=3).collect()
    load = defaultdict(int)
    for r in rows:
        load[r.sequence] += r.length
        assert len(r.ids) == 4 * r.length
    assert max(load.values()) <= 64 and sum(load.values()) == sum(len(ids_of(r.text)) for r in hard.collect())
    assert sum(load.values()) / (64 * len(load)) > 0.9
    assert sum(r.length for r in rows if r.id == 0) == 1
    assert pack(nothing, tokenizer_path()).count() == 0


def test_word_ids_equal_the_tokenizer():
    texts = ["It's 12.5% of x's, don't! İstanbul straße ÉCOLE. été. <|endoftext|> Foo... bar,,, a.b,c (x) --- 漢字。", "", "don't'", "...", "a.", "Ab<|startoftext|>", "<|STARTOFTEXT|> x", "ǅ. ﬁ ª", "é café.", "a\x1cb\x85c d", "word " * 50 + "word. " * 50]
    words = WordIds(tokenizer_path())
    for _ in range(2):
        got = words.texts([t.encode() for t in texts])
        assert [g + b"\x02\0\0\0" for g in got] == [ids_of(t).tobytes() for t in texts]


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    assert WordIds(tokenizer_path()).by_words
    other = public_tokenizers.path("byte_bpe_50k.json")
    words, plain = WordIds(other), Tokenizer.from_file(other)
    texts = ["Two  Words, and\tone\n", "", "Ünï 12 don't"]
    assert not words.by_words
    assert words.texts([t.encode() for t in texts]) == [np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_ids_do_not_depend_on_what_came_before():
    whole = Tokenizer.from_file(tokenizer_path())
    r = random.Random(9)
    parts = ["foo", "a", "Zoë", "x1", "9", "5€", "²", "é", "日本", '"', "“", "”", "'", "-", "–", "$", "%", "​", "﻿", "…", ")", "(", ",", ".", "!", "?", ";", ":", "́", "_", "*"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randrange(1, 6)))
    vocabulary = [word() for _ in range(4000)]
    texts = ['he said "foo" to me', 'he said "foo", ok', "a- b", "a-, b", "5€ x", "5€. x", "“foo”", "“foo”,"] + [" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 8))) for _ in range(20_000)]
    want = {t: np.asarray(e.ids, "<u4").tobytes() for t, e in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True)}
    for seed in range(3):
        ids, order = WordIds(tokenizer_path()), list(want)
        if seed:
            random.Random(seed).shuffle(order)
        for at in range(0, len(order), 700):
            batch = order[at : at + 700] if seed < 2 else order[at : at + 1]
            assert ids.texts([t.encode() for t in batch]) == [want[t] for t in batch]
