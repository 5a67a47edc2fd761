import json
import os
import random
from datetime import datetime, timedelta

import pytest
from evalspark.operators.keyed_log import KeyedLog
from evalspark.streaming import events as streams
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, event string, model string, status string, sample_id string, cooldown double"


def written(folder, files, first=0, tick=100):
    """Files of (hour, minute, second, sample) completions, in the order in which they came."""
    folder.mkdir(exist_ok=True)
    for i, rows in enumerate(files, first):
        x = [{"ts": f"2024-01-01T{h:02d}:{m:02d}:{s:02d}Z", "event": "task_complete", "model": f"m{s % 2}", "status": "ok", "sample_id": k, "cooldown": None} for h, m, s, k in rows]
        (folder / f"{i}.json").write_text("\n".join(json.dumps(r) for r in x))
        os.utime(folder / f"{i}.json", (1_700_000_000 + tick * i,) * 2)


def live(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def windows(df):
    return sorted((r.start.hour, r.start.minute, r.model, r.n) for r in df.collect())


def test_a_window_is_given_once_and_late_rows_apart(spark, tmp_path):
    log, folder = tmp_path / "log", str(tmp_path / "run")
    files = [[(0, m, s, f"s{m}") for m in range(60) for s in (0, 1)], [(1, 5, 0, "a")], [(1, 6, 0, "b")], [(0, 30, 0, "late"), (1, 1, 0, "in time"), (1, 6, 1, "c")], [(2, 0, 0, "d")]]
    written(log, files)
    out = streams.progress(live(spark, log), 600, folder)
    closed = windows(out.rows)
    assert closed == sorted([(0, m, k, 1) for m in range(60) for k in ("m0", "m1")] + [(1, 1, "m0", 1), (1, 5, "m0", 1), (1, 6, "m0", 1), (1, 6, "m1", 1)])
    assert [(r.sample_id) for r in out.late.collect()] == ["late"]
    assert windows(streams.open_windows(spark, folder)) == [(2, 0, "m0", 1)]
    assert out.progress.agg(F.sum("dropped")).first()[0] == 1
    assert max(r.state_rows for r in out.progress.collect()) < 200
    # a later run closes what was open and gives no window again
    written(log, [[(4, 0, 0, "e")], [(1, 6, 0, "too late")]], first=5)
    again = streams.progress(live(spark, log), 600, folder)
    assert windows(again.rows) == sorted([*closed, (2, 0, "m0", 1)])
    assert sorted(r.sample_id for r in again.late.collect()) == ["late", "too late"]
    assert windows(streams.open_windows(spark, folder)) == [(4, 0, "m0", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_closed_open_and_late_are_all_rows(spark, tmp_path, seed):
    r = random.Random(seed)
    files = [[(min(23, max(0, i + r.randrange(-3, 1))), r.randrange(60), r.randrange(60), f"s{i}-{k}") for k in range(20)] for i in range(8)]
    written(tmp_path / "log", files)
    folder = str(tmp_path / "run")
    out = streams.progress(live(spark, tmp_path / "log"), 1800, folder)
    whole = {}
    for parts in (out.rows, streams.open_windows(spark, folder)):
        for h, m, k, n in windows(parts):
            assert (h, m, k) not in whole
            whole[h, m, k] = n
    late = out.late.collect()
    assert sum(whole.values()) + len(late) == 160 and late
    assert out.progress.agg(F.sum("dropped")).first()[0] > 0


def test_samples_complete_once_in_bounded_state(spark, tmp_path):
    files = [[(h, m, s, f"s{h}-{m}-{s}") for m in range(0, 60, 6) for s in (0, 1)] for h in range(12)]
    files = [rows + (files[h - 1][-3:] if h else []) for h, rows in enumerate(files)]  # the last ones come twice
    files[9].append((3, 0, 30, "long past"))
    written(tmp_path / "log", files)
    out = streams.first_completions(live(spark, tmp_path / "log"), 3600, str(tmp_path / "run"))
    got = [r.sample_id for r in out.rows.collect()]
    assert len(got) == len(set(got)) == 240
    assert [r.sample_id for r in out.late.collect()] == ["long past"]
    facts = out.progress.collect()
    assert max(r.state_rows for r in facts) <= 80 and sum(r.dropped for r in facts) == 1


def test_files_in_any_time_order_within_the_lateness(spark, tmp_path):
    for name, order in (("a", [12, 6, 0]), ("b", [0, 12, 6])):
        written(tmp_path / name, [[(h, 0, s, f"s{s % 2 + 2 * h}") for s in range(4)] for h in order])
        out = streams.first_completions(live(spark, tmp_path / name), 86400, str(tmp_path / f"run-{name}"))
        assert sorted(r.sample_id for r in out.rows.collect()) == sorted(f"s{k + 2 * h}" for h in order for k in (0, 1)) and out.late.count() == 0


def test_first_seen_goes_on_and_stops_being_recent(spark, tmp_path):
    def rows(day, names):
        return [{"ts": f"2024-01-{day:02d}T00:00:{s:02d}Z", "name": n} for s, n in enumerate(names)]

    def put(i, x):
        (tmp_path / "log").mkdir(exist_ok=True)
        (tmp_path / "log" / f"{i}.json").write_text("\n".join(map(json.dumps, x)))
        os.utime(tmp_path / "log" / f"{i}.json", (1_700_000_000 + 100 * i,) * 2)

    def run(folder):
        log = spark.readStream.schema("ts timestamp, name string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "log"))
        saved = spark.createDataFrame([("b", "2023-12-01 00:00:00"), ("gone", "2023-12-02 00:00:00"), (None, None)], "name string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        return {r.name: (str(r.first_seen)[:10], r.recent) for r in streams.first_seen(log, str(tmp_path / folder), saved).collect()}

    put(0, rows(1, ["a", "b", None]))
    put(1, rows(2, ["c"]))
    assert run("one") == {"a": ("2024-01-01", True), "b": ("2023-12-01", False), "c": ("2024-01-02", True), "gone": ("2023-12-02", False)}
    put(2, rows(8, ["d"] * 3) + rows(9, ["a"]))
    put(3, [{"ts": "2023-12-31T00:00:00Z", "name": "c"}, {"ts": "2024-01-07T00:00:00Z", "name": "e"}])
    want = {"a": ("2024-01-01", False), "b": ("2023-12-01", False), "c": ("2023-12-31", False), "d": ("2024-01-08", True), "e": ("2024-01-07", True), "gone": ("2023-12-02", False)}
    assert run("one") == want
    assert run("whole") == want


@pytest.mark.parametrize(("times", "order"), [((0, 0, 0), (0, 1, 2)), ((0, 0, 0), (2, 1, 0)), ((0, 1, 2), (0, 1, 2)), ((2, 1, 0), (0, 1, 2))])
def test_published_rows_are_decided_by_data(spark, tmp_path, times, order):
    (tmp_path / "log").mkdir()
    for i in order:
        path = tmp_path / "log" / f"{i}.json"
        path.write_text("\n".join(json.dumps({"key": f"s{s}", "v": i}) for s in range(4)))
        os.utime(path, (1_700_000_000 + times[i],) * 2)
    new = spark.readStream.schema("key string, v int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "log"))
    old = spark.createDataFrame([("s0", 99), ("old", 7)], "key string, v int")
    got = {r.key: r.v for r in streams.published(new, "key", ["v"], old).collect()}
    assert got == {"old": 7, "s0": 2, "s1": 2, "s2": 2, "s3": 2}


def test_publishing_goes_on_in_its_folder(spark, tmp_path):
    log, folder = tmp_path / "log", str(tmp_path / "data")
    log.mkdir()

    def put(i, rows):
        (log / f"{i}.json").write_text("\n".join(json.dumps({"key": k, "v": v}) for k, v in rows))
        os.utime(log / f"{i}.json", (1_700_000_000 + 100 * i,) * 2)

    def run():
        new = spark.readStream.schema("key string, v int").option("maxFilesPerTrigger", 1).json(str(log))
        old = spark.createDataFrame([(f"k{i}", 100 + i) for i in range(50)] + [("", 1), (" ", 1)], "key string, v int")
        return sorted(str((r.key, r.v)) for r in streams.published(new, "key", ["v"], old, folder, 8, 2).collect())

    want = {f"k{i}": 100 + i for i in range(50)}
    for i in range(5):
        put(i, [(f"k{i}", i), (f"k{i + 10}", 0), (None, i)])
        want |= {f"k{i}": i, f"k{i + 10}": 0}
        assert run() == sorted(map(str, [*want.items(), ("", 1), (" ", 1), *[(None, k) for k in range(i + 1)]]))


def rows_in(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_a_batch_writes_its_own_rows_and_compaction_its_buckets(spark, tmp_path):
    schema = "key string, v int, note map<string,string>"
    big = spark.range(20_000).selectExpr("concat('k', id) as key", "cast(id as int) as v", "map('a', repeat(md5(string(id)), 4)) as note")
    log = KeyedLog(spark, str(tmp_path / "t"), big.schema, "key", ["v"], 8)
    log.begin(big)
    before = rows_in(tmp_path / "t")
    log.begin(big.limit(0))  # a later run's existing rows change nothing
    batch = spark.createDataFrame([("k5", 7, None), ("k5", 9, {"b": "c"}), ("new", 1, None)], schema)
    log.append(batch, 0)
    log.append(batch, 0)  # run again
    assert rows_in(tmp_path / "t") - before < before / 50
    want = {f"k{i}": i for i in range(20_000)} | {"k5": 9, "new": 1}
    same = lambda: {r.key: r.v for r in log.read().select("key", "v").collect()} == want
    assert same()
    touched = log.compact(0)
    assert 1 <= len(touched) <= 2 and same()
    assert {p.name for p in (tmp_path / "t/base/g=1").glob("log_bucket=*")} == {f"log_bucket={b}" for b in touched}
    log.append(batch, 0)  # a batch that is already in the base
    assert same() and log.compact(0) == []
    log.append(spark.createDataFrame([("k5", 8, None), ("k6", -1, None)], schema), 1)
    want["k6"] = -1  # incoming rows outrank existing ones; of incoming ones the larger order counts
    assert same()
    (tmp_path / "t/state/g=2").mkdir()  # a compaction that was killed
    assert same()
    log.compact(1)
    assert same() and log.vacuum() and same()
    assert log.vacuum() == []


def test_samples_come_due_when_their_cooldown_is_over(spark, tmp_path):
    path, folder = str(tmp_path / "log"), str(tmp_path / "state")
    schema = "sample_id string, model string, event string, ts timestamp, cooldown double"

    def run(rows):
        at = lambda s: datetime(2024, 1, 1, 12, 0, 0) + timedelta(seconds=s)
        names = {"q": "task_rate_limit_requeue", "c": "task_complete", "s": "start"}
        spark.createDataFrame([(k, "m", names[e], None if t is None else at(t), c) for k, e, t, c in rows], schema).coalesce(1).write.mode("append").parquet(path)
        live = spark.readStream.schema(schema).parquet(path)
        out = streams.due_again(live, folder)
        assert out.filter("retry_at is null").isEmpty()
        return {r.sample_id: (r.state, (r.retry_at - at(0)).total_seconds()) for r in out.collect()}

    got = run([("a", "q", 0, 5.0), ("b", "q", 0, 60.0), ("c", "q", 1, 5.0), ("c", "c", 7, None), ("d", "q", 2, 1.5), ("d", "q", 2, 90.25), ("e", "c", 3, None), ("f", "s", 900, None), (None, "q", 1, 1.0), ("g", "q", None, 1.0), ("h", "q", 4, None), ("t", "q", 5, 9.0), ("t", "c", 5, None), ("z", "q", 10, 100.0)])
    assert got == {"a": ("due", 5), "b": ("waiting", 60), "c": ("done", 6), "d": ("waiting", 92.25), "h": ("due", 4), "t": ("done", 14), "z": ("waiting", 110)}
    # a is done by an event from before the watermark, c and e are forgotten, b's newest requeue counts, whatever the order
    got = run([("a", "c", 9, None), ("c", "q", 8, 1.0), ("e", "q", 2, 1.0), ("b", "q", 30, 50.0), ("b", "q", 20, 500.0), ("z", "c", 70, None)])
    assert got == {"a": ("done", 5), "b": ("waiting", 80), "c": ("done", 6), "d": ("waiting", 92.25), "h": ("due", 4), "t": ("done", 14), "z": ("done", 110)}
    got = run([("d", "c", 200, None), ("n", "q", 200, 0.0)])
    assert got["b"] == ("due", 80) and got["d"] == ("done", 92.25) and got["n"] == ("due", 200)
    state = spark.read.format("statestore").option("stateVarName", "known").load(f"{folder}/checkpoint")
    assert {s.key.sample_id for s in state.select("key").collect()} == {"b", "h", "n"}
