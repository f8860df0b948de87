"""What a stream does to its rows before queries, over micro-batches: sampling, decoding, change gate, late rows, release in the order of time.

A feed is a streaming query of its own. Each micro-batch goes through the batch operators,
together with what the last one handed on: the newest row of the open interval, the last
row let through, the rows that wait for the watermark. What is handed on and the rows that
leave are tables by micro-batch number, renamed into place when whole, so that a
micro-batch that is run again changes nothing. Pipelines read the rows as a stream;
a shared stream has one feed for all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ordering, shaping
from ..scratch import drop_path


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The micro-batches that have a table in a folder."""
    fs, path = _fs(spark, folder)
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(path) if x.getPath().getName().isdigit()) if fs.exists(path) else []


def put(df: DataFrame, folder: str, number: int) -> None:
    """A micro-batch's table, in place when it is whole; one that is there stays."""
    spark = df.sparkSession
    fs, path = _fs(spark, f"{folder}/{number}")
    if fs.exists(path):
        return
    df.write.mode("overwrite").parquet(f"{folder}/_{number}")
    fs.rename(_fs(spark, f"{folder}/_{number}")[1], path)


def handed_on(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    """The table of the last micro-batch before; those before it are deleted, as no run needs them again."""
    before = [n for n in numbers(spark, folder) if n < number]
    for n in before[:-1]:
        drop_path(spark, f"{folder}/{n}")
    return spark.read.parquet(f"{folder}/{before[-1]}") if before else None


def joined(df: DataFrame, more: DataFrame | None) -> DataFrame:
    return df if more is None else more.select(*df.columns).unionByName(df)


class Feed:
    """The operators of one stream over micro-batches; ``decode`` turns raw rows into decoded ones."""

    def __init__(self, stream, folder: str, decode: Callable[[DataFrame], DataFrame]):
        self.stream, self.folder, self.decode = stream, folder.rstrip("/"), decode

    @property
    def rows(self) -> str:
        return f"{self.folder}/rows"

    def step(self, batch: DataFrame, number: int) -> None:
        if number in numbers(batch.sparkSession, self.rows):
            return
        df, s = batch, self.stream
        if s.sample_seconds:
            df = self._sampled(df, number)
        df = self.decode(df)
        if s.gate:
            df = self._gated(df, number)
        if s.late_tolerance is not None:
            df = self._released(df, number)
        put(df, self.rows, number)

    def _sampled(self, df: DataFrame, number: int) -> DataFrame:
        """The newest row (or the packed payloads) of every interval that a later one has closed; rows of closed intervals go."""
        s, folder = self.stream, f"{self.folder}/sampled"
        width = int(s.sample_seconds * 1_000_000)
        interval = F.floor(F.unix_micros(F.col("__ts").cast("timestamp")) / F.lit(width))
        waiting = handed_on(df.sparkSession, folder, number)
        both = joined(df, waiting)
        last, opened = both.agg(F.max(interval)).head()[0], waiting.agg(F.min(interval)).head()[0] if waiting is not None else None
        if last is None:
            put(both, folder, number)
            return both
        both = both.where(interval >= opened) if opened is not None else both
        sampled = (lambda x: shaping.sample_latest(x, "__ts", s.seq, s.sample_seconds)) if s.packer is None else (lambda x: x)
        put(sampled(both.where(interval == last)), folder, number)
        done = both.where(interval < last)
        return shaping.sample_packed(done, "__ts", s.seq, s.sample_seconds, s.payload, s.packer, keep_names=True) if s.packer else sampled(done)

    def _gated(self, df: DataFrame, number: int) -> DataFrame:
        """Rows that differ from the last one let through, which is handed on."""
        s, folder = self.stream, f"{self.folder}/gated"
        before = handed_on(df.sparkSession, folder, number)
        tracked = list(s.on_change or [c for c in df.columns if c != s.seq and not c.startswith("__")])
        both = joined(df, before)
        last = both.agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in both.columns]), F.col(s.seq)).alias("r")).where("r IS NOT NULL").select("r.*")
        put(last, folder, number)
        out = shaping.on_change(both, s.seq, tracked)
        return out if before is None else out.join(before.select(F.col(s.seq).alias("__known")), F.col(s.seq) == F.col("__known"), "left_anti")

    def _released(self, df: DataFrame, number: int) -> DataFrame:
        """Rows that the watermark has passed, those that came after it left out; later ones wait."""
        s, folder = self.stream, f"{self.folder}/waiting"
        us, tolerance = F.unix_micros(F.col("__ts").cast("timestamp")), int(s.late_tolerance * 1_000_000)
        waiting = handed_on(df.sparkSession, folder, number)
        columns = df.columns
        most = None
        if waiting is not None:
            most = waiting.agg(F.max("__most")).head()[0]
            waiting = waiting.where("NOT __mark").select(*columns)
        timed = ordering.max_before(df.withColumn("__us", us), "__us", s.seq)
        reached = F.greatest(F.col("__before"), F.lit(most).cast("long"))
        fresh = timed.where(reached.isNull() | (F.col("__us") > reached - tolerance)).select(*columns)
        now = df.agg(F.max(us)).head()[0]
        most = max((x for x in (most, now) if x is not None), default=None)
        both = joined(fresh, waiting)
        passed = us <= F.lit(most).cast("long") - tolerance
        mark = df.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields], F.lit(most).cast("long").alias("__most"), F.lit(True).alias("__mark"))
        put(both.where(~F.coalesce(passed, F.lit(False))).withColumn("__most", F.lit(most).cast("long")).withColumn("__mark", F.lit(False)).unionByName(mark), folder, number)
        return both.where(passed).withColumn("__order", ordering.time_order("__ts", s.seq))

    def start(self, source: DataFrame, trigger: dict):
        """Starts the feed."""
        fs, path = _fs(source.sparkSession, self.rows)
        fs.mkdirs(path)
        return source.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(self.step).trigger(**trigger).start()

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """The rows that have left, as a stream, a micro-batch of the feed at a time or more."""
        return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(self.rows)
