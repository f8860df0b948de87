"""Streams, pipelines and their life: the programming interface around the query planner."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .functions import catalog, registry
from .operators import aggregates, eventtime, ordering, shaping, stateful
from .plans import planner, syntax
from .sources import decoders, schemas
from .streaming import feed
from .streaming.delivery import Delivery, arrived
from .streaming.runner import start_query


@dataclass
class Stream:
    """A declared stream: its schema, where rows come from, and what happens to them before queries."""

    name: str
    schema: dict
    source: Callable[[SparkSession], DataFrame]
    seq: str = "__seq"
    payload: str | None = None
    decoder: str = "json"
    event_column: str | None = None
    event_kind: str = "unixtimestamp_ms"
    late_tolerance: float | None = None
    sample_seconds: float | None = None
    packer: Callable[[list[bytes]], bytes] | None = None
    on_change: Sequence[str] | None = None
    gate: bool = False
    shared: bool = False


@dataclass
class Sink:
    """Where rows go, and in which form: ``write(frame)`` gets rows, or payloads if there is an encoder."""

    write: Callable[[DataFrame], None]
    encoder: str | None = None
    delta: bool = False
    delta_columns: Sequence[str] | None = None
    omit_if_empty: bool = False
    omit_null_columns: bool = True
    batch_count: int | None = None
    batch_duration: float | None = None
    template: str | None = None


@dataclass
class Pipeline:
    name: str
    sql: str
    sinks: list[Sink] = field(default_factory=list)


class Engine:
    """A catalog of streams and pipelines over one Spark session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.streams, self.pipelines, self.running = spark, {}, {}, {}
        self._shared: dict[str, tuple[set[str], DataFrame]] = {}
        self._feeds: dict[str, feed.Feed] = {}
        self._feeding: dict[str, object] = {}
        self._deliveries: dict[str, tuple[list[Delivery], str]] = {}

    def create_stream(self, stream: Stream) -> None:
        if stream.name in self.streams:
            raise syntax.SqlError(f"a stream {stream.name} exists already")
        schemas.stream_schema(stream.schema)
        self.streams[stream.name] = stream

    def drop_stream(self, name: str) -> None:
        if any(syntax.parse(p.sql).source == name for p in self.pipelines.values()):
            raise syntax.SqlError(f"the stream {name} is in use")
        self.streams.pop(name)
        if name in self._shared:
            self._shared.pop(name)[1].unpersist()

    def create_pipeline(self, pipeline: Pipeline) -> None:
        """Checks and keeps a pipeline."""
        if pipeline.name in self.pipelines:
            raise syntax.SqlError(f"a pipeline {pipeline.name} exists already")
        self._plan(pipeline)
        self.pipelines[pipeline.name] = pipeline

    def drop_pipeline(self, name: str) -> None:
        self.stop(name)
        self.pipelines.pop(name)

    def _stream(self, name: str) -> Stream:
        if name not in self.streams:
            raise syntax.SqlError(f"unknown stream {name}")
        return self.streams[name]

    def _plan(self, pipeline: Pipeline) -> planner.Query:
        stream = self._stream(syntax.parse(pipeline.sql).source)
        return planner.plan(pipeline.sql, [c["name"] for c in stream.schema["columns"]])

    def rows(self, name: str, used: set[str] | None = None) -> DataFrame:
        """The decoded rows of a stream's batch source; of a shared one, kept for all its pipelines, with all columns that any of them has asked for."""
        stream = self._stream(name)
        if not stream.shared:
            return self._decoded(stream, used)
        wanted = set(used) if used is not None else {c["name"] for c in stream.schema["columns"]}
        for p in self.pipelines.values():
            if syntax.parse(p.sql).source == name:
                wanted |= self._plan(p).needed()
        known = self._shared.get(name)
        if known is None or not wanted <= known[0]:
            if known is not None:
                known[1].unpersist()
                wanted |= known[0]
            known = self._shared[name] = (wanted, self._decoded(stream, wanted).persist())
        return known[1]

    def _decoded(self, stream: Stream, used: set[str] | None) -> DataFrame:
        df = stream.source(self.spark)
        if stream.sample_seconds and stream.packer:  # before decoding, on the raw payloads
            df = shaping.sample_packed(df, "__ts", stream.seq, stream.sample_seconds, stream.payload, stream.packer, keep_names=True)
        elif stream.sample_seconds:
            df = shaping.sample_latest(df, "__ts", stream.seq, stream.sample_seconds)
        df = self._plain(stream, used)(df)
        if stream.gate:
            tracked = stream.on_change or [c["name"] for c in stream.schema["columns"] if c["name"] in df.columns]
            df = shaping.on_change(df, stream.seq, tracked)
        if stream.late_tolerance is not None:
            df = eventtime.drop_late(df, "__ts", stream.seq, stream.late_tolerance).withColumn("__order", ordering.time_order("__ts", stream.seq))
        return df

    def _plain(self, stream: Stream, used: set[str] | None) -> Callable[[DataFrame], DataFrame]:
        """Decoding and event time, row by row."""
        schema = schemas.stream_schema(stream.schema)

        def run(df: DataFrame) -> DataFrame:
            if stream.payload:
                extra = {stream.event_column, *(stream.on_change or ())} if not stream.gate or stream.on_change else set(schema.names)
                df = decoders.DECODERS[stream.decoder](df, stream.payload, schemas.pruned(schema, used | extra) if used is not None else schema)
            else:
                df = decoders.pass_rows(df, schema) if stream.seq.startswith("__") else df
            if stream.event_column:
                df = eventtime.event_time(df, stream.event_column, stream.event_kind)
            return df

        return run

    def options(self, stream: Stream) -> planner.Options:
        """Late rows are left out and the others released in the order of time; else the order is that of arrival."""
        return planner.Options(seq="__order" if stream.late_tolerance is not None else stream.seq)

    def query(self, sql: str) -> DataFrame:
        """The rows of a query over what its stream holds now."""
        stream = self._stream(syntax.parse(sql).source)
        planned = planner.plan(sql, [c["name"] for c in stream.schema["columns"]])
        return planned.apply(self.rows(stream.name, planned.needed()), self.options(stream))

    def explain(self, name: str) -> dict:
        """The logical plan as steps, and Spark's physical plan."""
        pipeline = self.pipelines[name]
        df = self.query(pipeline.sql)
        return {"logical": [{"operator": x.operator, "detail": x.detail} for x in self._plan(pipeline).steps()], "physical": df._jdf.queryExecution().toString()}

    def run(self, name: str) -> None:
        """One batch run: the query's rows are computed once and go to every sink in the order of their arrival."""
        pipeline = self.pipelines[name]
        stream = self._stream(syntax.parse(pipeline.sql).source)
        planned = self._plan(pipeline)
        with scratch.temporary(self.spark):
            rows = arrived(*planned.ordered(self.rows(stream.name, planned.needed()), self.options(stream)))
            for sink in pipeline.sinks:
                Delivery(sink).take(rows)

    def _streamed(self, stream: Stream, used: set[str], checkpoint: str, trigger: dict) -> DataFrame:
        """The rows of a streaming source. Where something is kept between rows, or pipelines share them, a feed works them out first."""
        kept = stream.gate or stream.sample_seconds or stream.late_tolerance is not None
        if not kept and not stream.shared:
            return self._decoded(stream, used)
        own = f"{checkpoint}/feed"
        known = self._feeds.get(stream.name) if stream.shared else None
        found = known or feed.Feed(stream, own, self._plain(stream, None if stream.shared or stream.gate else used))
        if stream.shared:
            self._feeds[stream.name] = found
        source = stream.source(self.spark)
        if stream.name not in self._feeding or not self._feeding[stream.name].isActive:
            running = found.start(source, trigger)
            if "availableNow" in trigger or "once" in trigger:
                running.awaitTermination()
            else:
                self._feeding[stream.name] = running
        empty = self.spark.createDataFrame([], source.schema)
        schema = found.decode(empty).schema
        if stream.late_tolerance is not None:
            schema = schema.add("__order", "decimal(38,0)")
        return found.read(self.spark, schema)

    def start(self, name: str, checkpoint: str, tolerance: str = "0 seconds", trigger: dict | None = None):
        """A streaming run; the stream's source must be a streaming frame of decoded rows or of payloads.

        Sinks go on where the last micro-batch ended, also after a new start with the same checkpoint folder.
        """
        pipeline, trigger = self.pipelines[name], trigger or {"availableNow": True}
        planned, stream = self._plan(pipeline), self._stream(syntax.parse(pipeline.sql).source)
        deliveries = [Delivery(sink, f"{checkpoint}/sinks/{i}") for i, sink in enumerate(pipeline.sinks)]
        self._deliveries[name] = (deliveries, checkpoint)

        def take(ordered: tuple, number: int) -> None:
            with scratch.temporary(self.spark):
                rows = arrived(*ordered)
                for delivery in deliveries:
                    delivery.take(rows, number, final=False)

        rows = self._streamed(stream, planned.needed(), checkpoint, trigger)
        self.running[name] = start_query(pipeline.sql, rows, take, f"{checkpoint}/query", self.options(stream), tolerance, trigger, ordered=True)
        return self.running[name]

    def stop(self, name: str, graceful: bool = True) -> None:
        """Gracefully: what has arrived is worked off first, and what waits for a batch to fill leaves."""
        query = self.running.pop(name, None)
        if query:
            if graceful and query.isActive:
                query.processAllAvailable()
            query.stop()
            deliveries, _ = self._deliveries.pop(name)
            for delivery in deliveries if graceful else ():
                delivery.flush(self.spark)
        for source, running in list(self._feeding.items()):
            if not any(syntax.parse(self.pipelines[n].sql).source == source for n in self.running):
                self._feeding.pop(source).stop()

    def stats(self, name: str) -> dict | None:
        query = self.running.get(name)
        return query.lastProgress if query else None

    def export(self) -> dict:
        """What can be told of streams and pipelines as plain data."""
        return {"streams": [{"name": s.name, "schema": s.schema, "shared": s.shared} for s in self.streams.values()], "pipelines": [{"name": p.name, "sql": p.sql} for p in self.pipelines.values()]}

    @staticmethod
    def functions() -> list[dict]:
        return catalog()

    @staticmethod
    def register_scalar(name: str, function: Callable, returns: str, arguments: int) -> None:
        """A vectorised user function (pandas series in and out)."""
        udf = F.pandas_udf(function, returns)
        registry.register(name, lambda *a: udf(*[x.col for x in a]), arguments)

    @staticmethod
    def register_aggregate(name: str, function: Callable, returns: str) -> None:
        """A vectorised user aggregate (a pandas series in, a scalar out)."""
        udf = F.pandas_udf(function, returns)
        aggregates.register_aggregate(name, lambda x, kind, seq: udf(x))

    @staticmethod
    def register_stateful(name: str, least: int, most: int | None, build: Callable) -> None:
        """A function with state as a builder of columns, for batches."""
        stateful.register_stateful(name, least, most, build)

    @staticmethod
    def register_fold(name: str, least: int, most: int | None, returns: str, start: Callable, step: Callable) -> None:
        """A function with state as what it starts from and a step, for batches and streams."""
        stateful.register_fold(name, least, most, returns, start, step)

    def load(self, described: dict, sources: dict[str, Callable[[SparkSession], DataFrame]]) -> None:
        """Declares what ``export`` has told; sources come by name, as they are code."""
        for x in described["streams"]:
            self.create_stream(Stream(x["name"], x["schema"], sources[x["name"]], shared=x["shared"]))
        for x in described["pipelines"]:
            self.create_pipeline(Pipeline(x["name"], x["sql"]))


def capabilities() -> dict:
    """What the dialect has and hasn't."""
    return {
        "statements": ["SELECT"], "clauses": ["FROM (one stream)", "WHERE", "GROUP BY", "HAVING", "ORDER BY"], "windows": sorted(syntax.WINDOWS), "aggregates": sorted(aggregates.AGGREGATES), "stateful": sorted(stateful.STATEFUL),
        "scalars": sorted(registry.FUNCTIONS), "operators": ["+", "-", "*", "/", "%", "=", "!=", "<>", "<", "<=", ">", ">=", "AND", "OR", "NOT", "BETWEEN", "IN", "CASE", "->", "[]"], "unsupported": sorted({v for v in syntax.REFUSED.values()}),
    }
