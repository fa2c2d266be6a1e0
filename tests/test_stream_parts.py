"""Windows of turns, capped runs, sound of intervals, the speech gate as a stream, and the counter sink."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lexifold.operators import stats
from lexifold.streaming import gate, sink, windows

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
FRAME = "session long, seq long, at_ms long, duration_ms int, prob double, agent boolean, ts timestamp"


def _at(ms):
    return T0 + timedelta(milliseconds=ms)


@pytest.fixture
def streamed(spark, tmp_path):
    """Run a stream over folders to the end of what is there, again and again with one state, and read all that it has written."""

    def run(name, make, **folders):
        read = {k: spark.readStream.schema(schema).parquet(f"{tmp_path}/{k}") for k, schema in folders.items()}
        made = make(**read)
        made.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start(f"{tmp_path}/{name}").awaitTermination()
        return spark.read.schema(made.schema).parquet(f"{tmp_path}/{name}").collect()

    def put(folder, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{folder}")

    return run, put


def test_windows_of_turns(spark):
    def plain(start, now, window, overlap):
        if now - start <= window:
            return start
        return start + (1 + (now - start - window) // (window - overlap)) * (window - overlap)

    times = [(s, s + n) for s in (0, 700) for n in [0, 1, 999, 1000, 1001, 1699, 1700, 1701, 2399, 2400, 5000]]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(times)], "i int, start_ms long, end_ms long")
    got = {r.i: r.w for r in df.select("i", windows.stt_window_start(F.col("start_ms"), F.col("end_ms"), 1000, 300).alias("w")).collect()}
    assert got == {i: plain(*t, 1000, 300) for i, t in enumerate(times)}
    spans = {}
    for r in windows.turn_windows(df, 1000, 300).orderBy("i", "window").collect():
        spans.setdefault(r.i, []).append((r.from_ms, r.to_ms))
    for i, (a, z) in enumerate(times):
        begins = sorted({plain(a, now, 1000, 300) for now in range(a, z + 1)})
        assert spans[i] == [(b, min(z, b + 1000)) for b in begins]


def test_frames_of_windows(spark):
    frames = spark.createDataFrame([(1, 100 * i, i / 10) for i in range(8)], "session long, at_ms long, prob double")
    spans = spark.createDataFrame([(1, 0, 0, 250), (1, 1, 250, 251), (1, 2, 300, 800), (2, 0, 0, 900), (1, 3, 5, 5)], "session long, window int, from_ms long, to_ms long")
    got = {(r.session, r.window): (r.frames, r.mean_prob and round(r.mean_prob, 6)) for r in windows.frames_of_windows(frames, spans, ["window"], 200).collect()}
    assert got == {(1, 0): (3, 0.1), (1, 1): (0, None), (1, 2): (5, 0.5), (2, 0): (0, None), (1, 3): (0, None)}


def _plain_runs(rows, gap):
    last = busy = None
    for at, run, samples in rows:
        if samples and (last is None or at - last >= gap) and (busy is None or at >= busy):
            last, busy = at, at + run
            yield at


def test_runs_in_flight(spark, streamed):
    run, put = streamed
    rnd = random.Random(2)
    rows = {s: [(at, rnd.choice([50, 400, 900]), rnd.choice([0, 1, 5])) for at in sorted(rnd.sample(range(0, 9000, 50), 60))] for s in range(6)}
    expect = sorted((s, at) for s, r in rows.items() for at in _plain_runs(r, 250))
    schema = "session long, at_ms long, run_ms long, samples long, ts timestamp"
    flat = [(s, *r, _at(r[0])) for s, each in rows.items() for r in each]
    df = spark.createDataFrame(flat, schema).repartition(3)
    assert sorted((r.session, r.at_ms) for r in windows.cap_runs(df, 250).collect()) == expect
    make = lambda runs: windows.stream_cap_runs(runs.withWatermark("ts", "1 minute"), 250)
    put("runs", [r for r in flat if r[1] < 4000], schema)
    run("capped", make, runs=schema)
    put("runs", [r for r in flat if r[1] >= 4000], schema)
    assert sorted((r.session, r.at_ms) for r in run("capped", make, runs=schema)) == expect


def _plain_ring(frames, request, rate, keep_ms):
    """Sample by sample: what was written last at each place, silence elsewhere."""
    written, head, first = {}, 0, None
    for at, samples in frames:
        if samples:
            start = at * rate // 1000
            first = start if first is None else first
            written |= {start + i: v for i, v in enumerate(samples)}
            head = max(head, start + len(samples))
    if first is None:
        return []
    a, z = request
    low = max(a * rate // 1000, first, head - keep_ms * rate // 1000)
    return [written.get(i, 0) for i in range(low, min(head if z is None else z * rate // 1000, head))]


def test_sound_of_intervals(spark):
    rnd = random.Random(5)
    frames, asked = {}, []
    for s in range(12):
        at, each = rnd.randrange(500), []
        for _ in range(rnd.choice([0, 1, 12, 30])):
            n = rnd.choice([0, 5, 10, 13])
            each.append((at, [rnd.randrange(1, 99) for _ in range(n)]))
            at += rnd.choice([100, 100, 100, 60, 180, 700])  # in a row, over the one before, after a gap
        frames[s] = each
        asked += [(s, i, rnd.randrange(0, 4000), rnd.choice([None, rnd.randrange(0, 5000)])) for i in range(8)]
    asked += [(99, 0, 0, None), (1, 90, 0, None), (1, 91, 10_000, None), (1, 92, 300, 200)]
    df = spark.createDataFrame([(s, i, at, x) for s, each in frames.items() for i, (at, x) in enumerate(each)], "session long, seq int, at_ms long, samples array<smallint>")
    requests = spark.createDataFrame(asked, "session long, request int, from_ms long, to_ms long")
    got = {(r.session, r.request): r.samples for r in windows.slice_samples(df.repartition(4), requests, 100, 2000, 300).collect()}
    assert got == {(s, i): _plain_ring(frames.get(s, []), (a, z), 100, 2000) for s, i, a, z in asked}
    assert sum(map(len, got.values())) > 1000


def test_coarse_sessions(spark, streamed):
    run, put = streamed
    rnd = random.Random(1)
    rows = [(s, ms, rnd.choice([0.1, 0.9]), _at(ms)) for s in range(4) for ms in rnd.sample(range(0, 100_000, 500), 60)]
    schema, expect = "session long, at_ms long, prob double, ts timestamp", []
    for s in range(4):
        last = None
        for ms in sorted(r[1] for r in rows if r[0] == s and r[2] >= 0.5):
            if last is None or ms - last > 2000:
                expect.append([s, ms, 0, 0])
            expect[-1][2:], last = [ms + 2000, expect[-1][3] + 1], ms
    flat = lambda found: sorted([r.session, round((r.start.timestamp() - T0.timestamp()) * 1000), round((r.end.timestamp() - T0.timestamp()) * 1000), r.frames] for r in found)
    found = windows.coarse_sessions(spark.createDataFrame(rows, schema), "2 seconds").collect()
    # times come back in this machine's zone
    assert flat(found) == sorted(expect)
    put("frames", rows, schema)
    make = lambda frames: windows.coarse_sessions(frames, "2 seconds", late="0 seconds")
    run("coarse", make, frames=schema)
    put("frames", [(9, 900_000, 0.9, _at(900_000))], schema)
    assert flat(run("coarse", make, frames=schema)) == sorted(expect)


def _talk(seed, sessions=5, n=80):
    rnd = random.Random(seed)
    frames, speech = [], []
    for s in range(sessions):
        prob = 0.9
        at = 0
        for i in range(n):
            prob = rnd.choice([prob, prob, prob, 0.9, 0.1])
            frames.append((s, i, at, 100, prob))
            at += 100
        for _ in range(4):
            a = rnd.randrange(0, n * 100)
            speech.append((s, a, a + rnd.choice([0, 250, 900, 2500])))
    return frames, speech


def _with_agent(frames, speech):
    return [(*f, any(s == f[0] and a <= f[2] < z for s, a, z in speech), _at(f[2])) for f in frames]


def _rows(found):
    return sorted((r.session, r.kind, r.at_ms, -1 if r.value is None else r.value) for r in found)


EDGE = "session long, start_ms long, end_ms long, ts timestamp"


def _gate(frames, speech):
    return gate.stream_speech_events(frames.withWatermark("ts", "1 minute"), gate.agent_edges(speech).withWatermark("ts", "1 minute"), 300, silence_ms=200)


def test_speech_and_overlaps_as_a_stream(spark, streamed):
    """Two runs with one state, then rows of a later time, after which open segments come without an end."""
    run, put = streamed
    frames, speech = _talk(1)
    flagged = _with_agent(frames, speech)
    batch = _rows(gate.speech_events(spark.createDataFrame(flagged, FRAME), 300, silence_ms=200).collect())
    assert {k for _, k, *_ in batch} == {"segment", "overlap"}
    rows = [(s, a, z, _at(a)) for s, a, z in speech]
    put("frames", [f for f in flagged if f[2] < 4000], FRAME)
    put("speech", rows, EDGE)
    folders = {"frames": FRAME, "speech": EDGE}
    run("gate", _gate, **folders)
    put("frames", [f for f in flagged if f[2] >= 4000], FRAME)
    so_far = _rows(run("gate", _gate, **folders))
    assert so_far == [r for r in batch if r[3] >= 0]
    put("frames", [(99, 0, 9_000_000, 100, 0.1, False, _at(9_000_000))], FRAME)
    put("speech", [(99, 9_000_000, 9_000_100, _at(9_000_000))], EDGE)
    assert _rows(run("gate", _gate, **folders)) == batch


def test_late_intervals_count_from_then_on(spark, streamed):
    run, put = streamed
    frames = [(1, i, 100 * i, 100, 0.9, False, _at(100 * i)) for i in range(20)]
    put("frames", frames[:10], FRAME)
    put("speech", [(7, 0, 1, _at(0))], EDGE)
    folders = {"frames": FRAME, "speech": EDGE}
    run("gate", _gate, **folders)
    put("frames", frames[10:], FRAME)
    put("speech", [(1, 200, 1500, _at(950))], EDGE)
    assert _rows(run("gate", _gate, **folders)) == [(1, "overlap", 1200, 300)]  # not the frames from 200 on, which had gone by


def test_counters_count_once(spark, streamed, tmp_path):
    _, put = streamed
    schema, at = "kind string, n int", f"{tmp_path}/counters"
    make = lambda: stats.session_counters(spark.readStream.schema(schema).parquet(f"{tmp_path}/log"), ["kind"])
    read = lambda path=at, mode="update": {r.kind: r["count"] for r in sink.read_counters(spark, path, ["kind"], "kind string, count long", mode).collect()}
    put("log", [("a", 1), ("b", 2), ("a", 3)], schema)
    sink.write_counters(make(), at).awaitTermination()
    assert read() == {"a": 2, "b": 1}
    put("log", [("b", 4), ("c", 5)], schema)
    sink.write_counters(make(), at).awaitTermination()
    assert read() == {"a": 2, "b": 2, "c": 1}
    sink.write_counters(make(), at).awaitTermination()  # nothing new
    sink.put_batch(spark.createDataFrame([("b", 2), ("c", 1)], "kind string, count long"), 1, at)  # the last batch once more
    assert read() == {"a": 2, "b": 2, "c": 1}
    whole = f"{tmp_path}/whole"
    sink.write_counters(make(), whole, "complete").awaitTermination()
    put("log", [("d", 6)], schema)
    sink.write_counters(make(), whole, "complete").awaitTermination()
    assert read(whole, "complete") == {"a": 2, "b": 2, "c": 1, "d": 1}
    lines = [r.line for r in stats.to_exposition(sink.read_counters(spark, at, ["kind"], "kind string, count long"), "x_total", "X.", ["kind"]).collect()]
    assert lines == ["# HELP x_total X.", "# TYPE x_total counter", 'x_total{kind="a"} 2', 'x_total{kind="b"} 2', 'x_total{kind="c"} 1']
