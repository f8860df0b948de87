"""Sources, shaping, encoders, the engine, and order at scale."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

import weir
from weir.engine import Engine, Pipeline, Sink, Stream, capabilities
from weir.operators import eventtime, ordering, shaping
from weir.sources import connectors, decoders, encoders, history, schemas


def rows(spark, values, schema):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"__seq long, {schema}")


def payload(df):
    return df.collect()[0].payload


@pytest.mark.parametrize(
    "values, columns, want",
    [
        ([(1, 10), (1, 10), (2, 10)], None, [{"a": 1, "b": 10}, {}, {"a": 2}]),
        ([(1, 10), (None, 10), (None, 10)], None, [{"a": 1, "b": 10}, {"a": None}, {}]),
        ([(1, 10), (2, 10), (3, 11)], ["b"], [{"a": 1, "b": 10}, {"a": 2}, {"a": 3, "b": 11}]),
    ],
)
def test_row_diff(spark, values, columns, want):
    diff = shaping.row_diff(rows(spark, values, "a long, b long"), "__seq", columns)
    assert json.loads(payload(encoders.encode_json(diff, "__seq"))) == want


@pytest.mark.parametrize("rows", [3, 1_000_000])
def test_on_change(spark, rows):
    import random

    rnd = random.Random(4)
    data = [(i, rnd.choice([None, 1, 2]), rnd.choice("ab"), i) for i in range(50)]
    df = spark.createDataFrame(data, "__seq long, p long, q string, r long").repartition(4)
    for tracked, of in ((["p", "q"], lambda x: x[1:3]), (["q"], lambda x: x[2]), (None, lambda x: x[1:])):
        want = [x[0] for k, x in enumerate(data) if k == 0 or of(x) != of(data[k - 1])]
        assert sorted(r[0] for r in shaping.on_change(df, "__seq", tracked, rows=rows).collect()) == want


def test_event_time_out_of_order(spark):
    import random

    rnd = random.Random(14)
    data = [(i, i * 5000 + rnd.choice([0, 2000, -9000, -30000])) for i in range(8, 60)]
    df = eventtime.event_time(spark.createDataFrame(data, "__seq long, at long").repartition(3), "at")
    for tolerance in (4, 12):
        most, kept = None, []
        for i, at in data:
            kept += [i] if most is None or at > most - tolerance * 1000 else []
            most = at if most is None else max(most, at)
        late = eventtime.drop_late(df, "__ts", "__seq", tolerance)
        assert sorted(r[0] for r in late.collect()) == kept and len(kept) < len(data)
        sums = {}
        for i, at in data:
            if i in kept:
                sums[at // 10_000] = sums.get(at // 10_000, 0) + at
        out = weir.run("SELECT sum(at) AS s FROM stream GROUP BY tumblingwindow('ss', 10)", late)
        assert sorted(r.s for r in out.collect()) == sorted(sums.values())


def test_decode_json(spark):
    schema = schemas.stream_schema({"columns": [{"name": "a", "data_type": "INT64"}, {"name": "b", "data_type": "struct", "fields": [{"name": "c", "data_type": "list", "element": {"data_type": "float64"}}]}]})
    texts = ['{"a": 1, "b": {"c": [1.5, "x"]}, "z": 0}', '[{"a": "no"}, {"a": 3}]', "not json", None, "[]"]
    got = decoders.decode_json(rows(spark, [(t,) for t in texts], "payload string"), "payload", schema).orderBy("__seq").collect()
    assert [(r.a, r.b and r.b.c) for r in got if r["__seq"] < 2] == [(1, [1.5, None]), (None, None), (3, None)]


def test_history(spark, tmp_path):
    spark.createDataFrame([(1, b"x"), (5, b"y"), (9, b"z")], "ts long, data binary").coalesce(1).write.parquet(str(tmp_path / "h"))
    file = next((tmp_path / "h").glob("part-*.parquet"))
    file.rename(tmp_path / "h" / "archive_speed-1~9_0_ab.parquet")
    assert [bytes(r.data) for r in history.read_history(spark, str(tmp_path / "h"), "speed", 2, 5).collect()] == [b"y"]


def test_signals(spark):
    decode = decoders.signal_decoder({7: [("speed", 0, 16, 0.5, 1.0, False), ("temp", 16, 8, 1.0, 0.0, True)]})
    schema = schemas.stream_schema({"columns": [{"name": "speed", "data_type": "float64"}, {"name": "temp", "data_type": "float64"}]})
    got = decode(spark.createDataFrame([(7, bytes([4, 1, 255])), (8, b"\1")], "can_id int, payload binary"), "payload", schema).orderBy("can_id").collect()
    assert (got[0].speed, got[0].temp, got[1].speed) == (0x104 * 0.5 + 1, -1.0, None)


def test_packer(spark):
    df = rows(spark, [("a",), ("b",), ("c",)], "p string").select("__seq", F.timestamp_seconds(F.col("__seq") * 6).alias("ts"), F.encode("p", "UTF-8").alias("p"))
    got = shaping.sample_packed(df, "ts", "__seq", 10, "p", b"".join).orderBy("ts").collect()
    assert [bytes(r.payload) for r in got] == [b"ab", b"c"]


def test_order_in_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k"), (F.col("id") * 61 % 503).alias("v"))
    ordered = sorted((r.k, r.v) for r in df.collect())
    indexed, n = ordering.arrival_index(df, "k", rows=97)
    assert n == 1000 and [r["__index"] for r in indexed.orderBy("k").collect()] == list(range(1000))
    most, want = None, []
    for _, v in ordered:
        want.append(most)
        most = v if most is None else max(most, v)
    assert [r["__before"] for r in ordering.max_before(df, "v", "k", rows=97).orderBy("k").collect()] == want
    assert ordering.arrival_index(df.limit(0), "k")[1] == 0


def test_engine(spark):
    engine, got = Engine(spark), []
    texts = ['{"a": 1, "b": "x"}', '[{"a": 2, "b": null}, {"a": 3}]']
    source = lambda s: s.createDataFrame(list(enumerate(texts)), "__seq long, data string")
    engine.create_stream(Stream("demo", {"columns": [{"name": "a", "data_type": "int64"}, {"name": "b", "data_type": "string"}]}, source, payload="data", shared=True))
    engine.create_pipeline(Pipeline("p", "SELECT a, b FROM demo WHERE a > 1", [Sink(lambda df: got.append(payload(df)), encoder="json"), Sink(lambda df: got.append(df.count()))]))
    engine.run("p")
    assert json.loads(got[0]) == [{"a": 2}, {"a": 3}] and got[1] == 2
    assert [x["operator"] for x in engine.explain("p")["logical"]] == ["DataSource", "Filter", "Project"]
    with pytest.raises(ValueError):
        engine.create_pipeline(Pipeline("q", "SELECT a FROM nowhere"))
    with pytest.raises(ValueError):
        engine.drop_stream("demo")
    assert "lag" in capabilities()["stateful"] and len(engine.functions()) >= 110


def test_user_functions(spark):
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    Engine.register_scalar("twice", lambda x: x * 2, "long", 1)
    Engine.register_aggregate("spread", spread, "double")
    df = rows(spark, [(1,), (4,)], "a long")
    assert sorted(r.x for r in weir.run("SELECT twice(a) AS x FROM stream", df).collect()) == [2, 8]
    assert weir.run("SELECT spread(a) AS x FROM stream", df).collect()[0].x == 3.0
    with pytest.raises(ValueError):
        Engine.register_scalar("twice", lambda x: x, "long", 1)


def test_topics(spark):
    topics = connectors.Topics()
    topics.publish("in", [b'{"a": 1}', b'{"a": 5}'])
    engine = Engine(spark)
    engine.create_stream(Stream("s", {"columns": [{"name": "a", "data_type": "int64"}]}, lambda s: topics.read(s, "in"), payload="payload"))
    engine.create_pipeline(Pipeline("p", "SELECT a + 1 AS b FROM s WHERE a > 2", [Sink(topics.sink("out"), encoder="json"), Sink(connectors.nop)]))
    engine.run("p")
    assert [p for _, p in topics.payloads["out"]] == [b'[{"b":6}]']
    with pytest.raises(RuntimeError):
        connectors.connect({"broker_url": "tcp://localhost:1", "topic": "x"}, print)


def test_scalars_with_nulls_and_errors(spark):
    df = rows(spark, [(None, -1.0, "a")], "n long, x double, s string")
    one = lambda e: weir.run(f"SELECT {e} AS r FROM stream", df).collect()[0].r
    for e in ("sqrt(x)", "acos(5)", "ln(x)", "mod(1, 0)", "abs(n)", "upper(cast(n, 'string'))", "format(NULL, 2)", "dec2hex(n)", "element_at(array_create(1), 4)"):
        assert one(e) is None, e
    assert one("ln(0)") == float("-inf") and one("cardinality(array_create())") == 0
    assert one("format(2.5, 0)") == "2" and one("format(1234567.891, 2, 'de_DE')") == "1.234.567,89"
    assert one("round(2.5)") == 3.0 and one("trunc(-2.57, 1)") == -2.5 and one("chr(128512)") == "😀"
    assert one("coalesce(n, 3)") == 3 and one("isnull(n)") is True and one("n = NULL") is True and one("n < 1") is False
    assert one("conv('ff', 16, 10)") == "255" and one("substring(s, 0)") == "a" and one("split_value('a.b.c', '.', 1)") == "b"
    for e in ("concat(s, NULL)", "substring(s, -1)", "split_value('a', ',', 3)", "hex2dec('zz')", "cast('maybe', 'boolean')", "1 / 0", "NOT (n > 1 AND NULL) AND NOT cast(NULL, 'boolean')", "cot(0)", "array_create(1)[4]"):
        with pytest.raises(Exception):
            one(e)
    with pytest.raises(ValueError):
        one("nosuch(1)")
    with pytest.raises(ValueError):
        one("upper(s, s)")
