"""Sinks and stream options: over one batch, over shuffled rows, and over micro-batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weir.engine import Engine, Pipeline, Sink, Stream

COLUMNS = {"columns": [{"name": "k", "data_type": "string"}, {"name": "v", "data_type": "int64"}]}
ROWS = [(i, i * 3, random.Random(i).choice("xyz"), i // 4 % 5) for i in range(61)]
FORM = "__seq long, at long, k string, v long"


def timed(df):
    return df.withColumn("__ts", F.timestamp_seconds("at")).drop("at")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three files, a micro-batch each."""
    path = str(tmp_path_factory.mktemp("rows") / "t")
    for a, b in ((0, 20), (20, 41), (41, 61)):
        timed(spark.createDataFrame(ROWS[a:b], FORM)).coalesce(1).write.mode("append").parquet(path)
    return path


def batch_source(folder):
    return lambda s: s.read.parquet(folder).repartition(7)


def stream_source(folder):
    return lambda s: s.readStream.schema(s.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def payloads(got):
    return lambda df: got.extend(r.payload for r in df.collect())


def run_both(spark, folder, tmp_path, sql, sink_options, **stream_options):
    """What a batch run and a stream of three micro-batches send."""
    found = []
    for k, source in enumerate((batch_source(folder), stream_source(folder))):
        got, engine = [], Engine(spark)
        engine.create_stream(Stream("s", COLUMNS, source, **stream_options))
        engine.create_pipeline(Pipeline("p", sql, [Sink(payloads(got), **sink_options)]))
        if k:
            engine.start("p", str(tmp_path / "c")).awaitTermination()
            engine.stop("p")
        else:
            engine.run("p")
        found.append(got)
    return found


def test_delta_over_shuffled_rows(spark, folder, tmp_path):
    sql = "SELECT k, v, acc_count(v) OVER (PARTITION BY k) AS n FROM s"
    batch, stream = run_both(spark, folder, tmp_path, sql, {"encoder": "json", "delta": True, "delta_columns": ["v"]})
    counts, want, before = {}, [], None
    for _, _, k, v in ROWS:
        counts[k] = counts.get(k, 0) + 1
        want.append({"k": k, **({"v": v} if v != before else {}), "n": counts[k]})
        before = v
    assert [x for p in batch for x in json.loads(p)] == want
    assert [x for p in stream for x in json.loads(p)] == want and len(stream) == 3


def test_batches_over_shuffled_rows(spark, folder, tmp_path):
    batch, stream = run_both(spark, folder, tmp_path, "SELECT v, k FROM s", {"encoder": "json", "batch_count": 8})
    rows = [{"v": v, "k": k} for _, _, k, v in ROWS]
    assert [json.loads(p) for p in batch] == [rows[i : i + 8] for i in range(0, 61, 8)] == [json.loads(p) for p in stream]


def test_delta_with_empty_batches_left_out(spark, folder, tmp_path):
    batch, stream = run_both(spark, folder, tmp_path, "SELECT v FROM s", {"encoder": "json", "delta": True, "omit_if_empty": True, "batch_count": 2})
    want = []
    for i in range(0, 61, 2):
        pair = [{"v": ROWS[j][3]} if j == 0 or ROWS[j][3] != ROWS[j - 1][3] else {} for j in range(i, min(61, i + 2))]
        want += [pair] if any(pair) else []
    assert [json.loads(p) for p in batch] == want == [json.loads(p) for p in stream]


def test_batch_duration(spark, folder):
    from weir.streaming.delivery import Delivery

    clock, got = [100.0], []
    import tempfile

    delivery = Delivery(Sink(payloads(got), encoder="json", batch_duration=10.0), tempfile.mkdtemp(), lambda: clock[0])
    rows = spark.createDataFrame([(0, 1), (1, 2)], "__out long, v long")
    for number, now in enumerate((100.0, 104.0, 111.0, 112.0)):
        clock[0] = now
        delivery.take(rows, number, final=False)
    assert [len(json.loads(p)) for p in got] == [6]
    delivery.flush(spark)
    assert [len(json.loads(p)) for p in got] == [6, 2]


def test_gate_over_a_stream(spark, folder, tmp_path):
    batch, stream = run_both(spark, folder, tmp_path, "SELECT v, k FROM s", {"encoder": "json"}, gate=True, on_change=["v"])
    want = [{"v": ROWS[i][3], "k": ROWS[i][2]} for i in range(61) if i == 0 or ROWS[i][3] != ROWS[i - 1][3]]
    assert [x for p in batch for x in json.loads(p)] == want == [x for p in stream for x in json.loads(p)]


def test_sampler_over_a_stream(spark, folder, tmp_path):
    batch, stream = run_both(spark, folder, tmp_path, "SELECT v, k FROM s", {"encoder": "json"}, sample_seconds=10)
    newest = {}
    for _, at, k, v in ROWS:
        newest[at // 10] = {"v": v, "k": k}
    assert [x for p in batch for x in json.loads(p)] == list(newest.values())
    assert [x for p in stream for x in json.loads(p)] == list(newest.values())[:-1]  # the last interval is open


def test_packer_over_a_stream(spark, tmp_path):
    form, rows = "__seq long, at long, payload binary", [(i, i * 4, json.dumps({"v": i}).encode()) for i in range(12)]
    path = str(tmp_path / "raw")
    for a in (0, 4, 8):
        timed(spark.createDataFrame(rows[a : a + 4], form)).coalesce(1).write.mode("append").parquet(path)
    batch, stream = run_both(spark, path, tmp_path, "SELECT v FROM s", {"encoder": "json"}, payload="payload", sample_seconds=10, packer=lambda ps: b"[" + b",".join(ps) + b"]")
    assert [x["v"] for p in batch for x in json.loads(p)] == list(range(12))
    assert [x["v"] for p in stream for x in json.loads(p)] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]


@pytest.mark.parametrize("tolerance", [4, 9])
def test_event_time_is_released_in_order(spark, tmp_path, tolerance):
    """Rows leave by time and arrival, but for those under the watermark when they come."""
    rnd = random.Random(tolerance)
    rows = [(i, max(0, i * 2 + rnd.choice([0, 0, 0, -3, -13, 5]))) for i in range(45)]
    path = str(tmp_path / "raw")
    for a in (0, 15, 30):
        spark.createDataFrame([(i, at, i) for i, at in rows[a : a + 15]], "__seq long, t long, v long").coalesce(1).write.mode("append").parquet(path)
    most, kept = None, []
    for i, at in rows:
        if most is None or at > most - tolerance:
            kept.append((at, i))
        most = at if most is None else max(most, at)
    kept.sort()
    want = [{"v": i, **({"p": kept[n - 1][1]} if n else {})} for n, (_, i) in enumerate(kept)]
    assert len(kept) < 45
    schema = {"columns": [{"name": "t", "data_type": "int64"}, {"name": "v", "data_type": "int64"}]}
    for k, source in enumerate((batch_source(path), stream_source(path))):
        got, engine = [], Engine(spark)
        engine.create_stream(Stream("s", schema, source, event_column="t", event_kind="unixtimestamp_s", late_tolerance=tolerance))
        engine.create_pipeline(Pipeline("p", "SELECT v, lag(v) AS p FROM s", [Sink(payloads(got), encoder="json")]))
        if k:
            engine.start("p", str(tmp_path / "c")).awaitTermination()
        else:
            engine.run("p")
        sent = [x for p in got for x in json.loads(p)]
        passed = [n for n, (at, _) in enumerate(kept) if at <= most - tolerance]
        assert sent == (want[: len(passed)] if k else want)


def test_shared_stream_grows(spark, folder, tmp_path):
    engine, got = Engine(spark), []
    engine.create_stream(Stream("s", COLUMNS, batch_source(folder), shared=True))
    engine.create_pipeline(Pipeline("a", "SELECT v FROM s WHERE v > 3", [Sink(payloads(got), encoder="json")]))
    engine.run("a")
    engine.create_pipeline(Pipeline("b", "SELECT k FROM s WHERE v > 3", [Sink(payloads(got), encoder="json")]))
    engine.run("b")
    assert [x["k"] for x in json.loads(got[1])] == [k for _, _, k, v in ROWS if v > 3]
    engine = Engine(spark)
    engine.create_stream(Stream("s", COLUMNS, stream_source(folder), shared=True))
    sent = {"a": [], "b": []}
    for name, column in (("a", "v"), ("b", "k")):
        engine.create_pipeline(Pipeline(name, f"SELECT {column} FROM s WHERE v > 3", [Sink(payloads(sent[name]), encoder="json")]))
        engine.start(name, str(tmp_path / name)).awaitTermination()
    assert [x["v"] for p in sent["a"] for x in json.loads(p)] == [v for *_, v in ROWS if v > 3]
    assert [x["k"] for p in sent["b"] for x in json.loads(p)] == [k for _, _, k, v in ROWS if v > 3]


def test_user_fold(spark, folder, tmp_path):
    """A function with state as a start and a step: the longest run of equal values so far."""

    def step(state, accepted, args):
        value, length, most = state
        if accepted:
            value, length = (args[0], length + 1) if args[0] == value else (args[0], 1)
            most = max(most, length)
        return (value, length, most), most

    Engine.register_fold("longest_run", 1, 1, "long", lambda: (None, 0, 0), step)
    for over in ("", " OVER (PARTITION BY k)"):
        batch, stream = run_both(spark, folder, tmp_path / over.strip(), f"SELECT longest_run(v) FILTER (WHERE v > 0){over} AS n FROM s", {"encoder": "json"})
        states, want = {}, []
        for _, _, k, v in ROWS:
            key = k if over else 0
            states[key], out = step(states.get(key, (None, 0, 0)), v > 0, [v])
            want.append(out)
        assert [x["n"] for p in batch for x in json.loads(p)] == want == [x["n"] for p in stream for x in json.loads(p)]
    with pytest.raises(ValueError):
        Engine.register_fold("lag", 1, 1, "long", lambda: 0, step)
