import hashlib
import random

from evalspark.llm.chat import END, HEAD, escaped, fold_events, read_back, render, turn_events, unescaped
from evalspark.llm.queries import TRICKY, op11_event_sourced_chat
from pyspark.sql import functions as F

EVENTS = "conv long, message long, seq long, kind string, role string, text string"
TURNS = "conv_id long, turn long, role string, text string, conv string, message string, e string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def folded(spark, rows):
    return {(r.conv, r.message): (r.role, r.text) for r in fold_events(spark.createDataFrame(rows, EVENTS)).collect()}


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 1, 3, "delta", None, "b"), (1, 1, 2, "delta", None, "a"), (1, 1, 3, "delta", None, "b"),
        (1, 2, 4, "message", "user", "gone"), (1, 2, 5, "delta", None, "!"), (1, 1, 6, "regenerate", None, None), (1, 1, 7, "delta", None, "c"), (1, 2, 8, "message", "user", "kept"), (1, 0, 9, "edit", None, "hello"),
        (2, 5, None, "message", "user", None), (2, 5, 1, "delta", None, "x"), (2, 6, 2, "delta", None, "no opening"), (2, 7, 3, "typing", "user", "?"), (2, 8, 4, None, "user", "?"),
        (None, None, 1, "message", "user", "nowhere"),
    ]
    want = {(1, 0): ("user", "hello"), (1, 1): ("assistant", "c"), (1, 2): ("user", "kept"), (2, 5): ("user", "x"), (2, 6): (None, "no opening"), (None, None): ("user", "nowhere")}
    assert folded(spark, rows) == want
    assert folded(spark, rows[::-1]) == want
    assert folded(spark, []) == {}


def test_a_long_stream(spark):
    text = [f"{i} " for i in range(20_000)]
    rows = [(1, 0, 0, "message", "assistant", "")] + [(1, 0, i + 1, "delta", None, t) for i, t in enumerate(text)]
    random.Random(1).shuffle(rows)
    assert folded(spark, rows) == {(1, 0): ("assistant", "".join(text))}


def test_control_strings_come_back(spark):
    r = random.Random(2)
    parts = ["\\", "### ", "\n", "</turn>", "<", "/turn>", "</turn>\n", "### assistant\n", "a", "é", "\r", "#"]
    texts = ["", None, TRICKY[1], "\\" * 50 + "### ", *["".join(r.choice(parts) for _ in range(r.randrange(1, 9))) for _ in range(500)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", escaped(F.col("t")))
    for t, e, u in df.select("t", "e", unescaped(F.col("e"))).collect():
        assert u == t
        assert e is None or ("</turn>" not in e and not any(line.startswith(HEAD) for line in e.split("\n")))
    roles = ["user", "assistant", None, "", "a\nb", "</turn>\n", "### x", "% +ü"]
    rows = [(i // 7, i % 7, roles[r.randrange(len(roles))], t) for i, t in enumerate(texts)]
    got = {c.conv: c for c in read_back(render(spark.createDataFrame(rows, "conv long, message long, role string, text string"))).collect()}
    for conv in {x[0] for x in rows}:
        mine = [(x[2] or "", x[3] or "") for x in rows if x[0] == conv]
        assert [tuple(t) for t in got[conv].turns] == mine
        assert got[conv].learnt == [t for role, t in mine if role == "assistant"]
        assert got[conv].formatted.count(END) == len(mine)


def digests(rows):
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda x: (x[0], x[1], x[2] or "", x[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt))
    return out


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = digests([*rows, (-7, 0, "user", TRICKY[1]), (-7, 1, "assistant", TRICKY[1])])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op11_event_sourced_chat(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_hard_turns(spark):
    long = "word ### \n" * 30_000
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (1, 2, "assistant", long), (1, 2, "assistant", long), (2, 0, None, "x"), (2, 3, "assistant", "é" * 7), (2, 3, "user", "tie"), (3, 0, "assistant", "only")]
    df = spark.createDataFrame([(*x, "c", "m", "e") for x in rows], TURNS)
    got = {}
    for c in read_back(render(fold_events(turn_events(df)))).collect():
        learnt = "".join(c.learnt)
        got[c.conv] = (len(c.turns), sha("".join(f"{t.role}\n{t.text}\n" for t in c.turns)), len(learnt), sha(learnt))
    assert got == digests(rows)
    assert read_back(render(fold_events(turn_events(df.limit(0))))).collect() == []


def test_no_python_on_the_executors(spark):
    plan = op11_event_sourced_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
