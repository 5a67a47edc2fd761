"""Damaged JSON files scanned by many tasks equal one serial scan."""

import random

import pyarrow as pa
import pytest
from evalspark.sources import damaged, files
from evalspark.sources.files import objects_in


def text_of(r, n):
    good = ['{"a": 1}', '{"b": {"c": "}{"}}', '{"d": "x\\"y\\\\"}', '{"e": "two\nlines\tand"}', '{\n "f": [\n  {"g": 2}\n ]\n}', '{"h": "\\\\\\\\"}']
    junk = ["}", '"', "\\", "\n", " , ", "x", "{", '{"', '\\"', "é", "}}", '"}', "\\\n"]
    return "".join(r.choice(good) if r.random() < 0.6 else r.choice(junk) for _ in range(n))


@pytest.mark.parametrize("seed", range(60))
def test_transitions_equal_the_scan(seed):
    r = random.Random(seed)
    lines = text_of(r, r.randrange(1, 60)).split("\n")
    cuts = sorted(r.randrange(len(lines) + 1) for _ in range(3))
    for depth in (0, 1, 2, 3, 7):
        for mode in (damaged.PLAIN, damaged.QUOTED, damaged.SKIP) if depth else (damaged.PLAIN,):
            d, m, e, n = depth, mode, depth, mode
            for lo, hi in zip([0, *cuts], [*cuts, len(lines)], strict=True):
                scan = damaged.Transition()
                for line in lines[lo:hi]:
                    scan.take(line + "\n")
                    _, d, m = damaged.pieces(line + "\n", d, m)
                e, n, _ = damaged.after(scan.table(), e, n)
                assert (d, m) == (e, n)


@pytest.mark.parametrize("size", ["40b", "200b", "1m"])
def test_files_in_many_splits(spark, tmp_path, size):
    r = random.Random(len(size))
    (tmp_path / "in").mkdir()
    want = {}
    for k in range(6):
        text = text_of(r, 80) if k else "".join(f'{{"n": {i}, "t": "line\none"}}, \n' for i in range(300))
        (tmp_path / "in" / f"{k}.txt").write_text(text)
        want[f"{k}.txt"] = objects_in(text)
    (tmp_path / "in" / "empty.txt").write_text("")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], "0")
        rows = damaged.salvage_files(spark, str(tmp_path / "in")).collect()
        splits = damaged._lines(spark, str(tmp_path / "in")).select("file", "block").distinct().count()
    finally:
        for k, x in zip(keys, before, strict=True):
            spark.conf.set(k, x)
    got = {}
    for x in sorted(rows, key=lambda x: (x.file, x.block, x.place)):
        got.setdefault(x.file.split("/")[-1], []).append(x.json)
    assert got == {k: v for k, v in want.items() if v}
    assert splits > 60 or size != "40b"


def test_a_mark_costs_the_same_however_many_objects_came_before():
    scan = damaged.Transition()
    for i in range(2000):  # each row closes one object more than it opens, and leaves a string open
        scan.take(f'junk }} " {{"doc_id": {i}, "text": "words"}}, {{"doc_id": {i}}} tail }}"\n')
    table = scan.table()
    assert min(table["least"]) < -1000
    assert sum(map(len, table["near"])) < 20
    # the scans still apart: at depth 0, or in one of the three modes
    assert sum(len(x.items) for x in scan.inside.values()) < 5


@pytest.mark.parametrize("seed", range(40))
def test_deep_states_equal_the_scan(seed):
    r = random.Random(seed)
    marks = r.choice(['"\\{}', '{}"', '{}}"', '"\\{{}x'])
    scan, lines = damaged.Transition(), ["".join(r.choice(marks) for _ in range(r.randrange(30))) for _ in range(3)]
    for line in lines:
        scan.take(line + "\n")
    table = scan.table()
    for mode in (damaged.PLAIN, damaged.QUOTED, damaged.SKIP):
        for depth in range(1, 60):
            d, m = depth, mode
            for line in lines:
                _, d, m = damaged.pieces(line + "\n", d, m)
            assert damaged.after(table, depth, mode)[:2] == (d, m)


def by_characters(text):
    out, depth, part, quoted, skip = [], 0, [], False, False
    for ch in text:
        if depth == 0 and ch != "{":
            continue
        if quoted and ch in "\n\r\t":
            part.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}[ch])
            skip = False
            continue
        part.append(ch)
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
            if depth == 0:
                out.append("".join(part))
                part = []
    return out


@pytest.mark.parametrize("seed", range(100))
def test_objects_equal_a_scan_by_characters(seed):
    r = random.Random(seed)
    for _ in range(20):
        text = text_of(r, r.randrange(40)) if seed % 2 else "".join(r.choice('"\\{}x\n\r\t') for _ in range(r.randrange(60)))
        assert objects_in(text) == by_characters(text)


def test_salvaged_rows_come_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(files, "SALVAGED", 10_000)
    texts = [f'junk }} {{"n": {i}, "t": "{"x" * 100}\n"}}, {{"m": {i}}} tail {{' for i in range(3000)] + [None, "", '{"t": "' + "y" * 50_000 + '"}']
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["k", "text"])
    out = list(files.salvaged_rows(iter([batch, batch.slice(0, 0)])))
    got = [(x["k"], x["place"], x["json"]) for b in out for x in b.to_pylist()]
    assert got == [(i, p, x) for i, t in enumerate(texts) for p, x in enumerate(by_characters(t or ""))]
    assert len(out) > 30 and all(sum(map(len, b.column("json").to_pylist()[:-2])) < 10_000 for b in out)
