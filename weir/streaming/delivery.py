"""From a query's rows to its sinks: difference, suppression, batching, encoding, with what is kept between micro-batches."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ordering, shaping
from ..sources import encoders
from . import feed

ENCODERS = {"json": encoders.encode_json, "columnar_json": encoders.columnar_json, "columnar_csv_json": encoders.columnar_csv_json}
PLACE = "__out"


def arrived(df: DataFrame, sort: list[Column]) -> DataFrame:
    """A query's rows, computed once, with their places in the order in which they arrive."""
    out = ordering.numbered(df, sort, PLACE)
    return out.drop(*[c for c in out.columns if c.startswith("__h")])


class Delivery:
    """One sink of one pipeline. With a ``folder`` it goes on where the last micro-batch ended.

    A batch of ``batch_count`` rows leaves when it is full; with ``batch_duration`` what
    waits leaves when the first of it has waited for so many seconds. A run over a batch
    source, or the end of a stream, lets everything go.
    """

    def __init__(self, sink, folder: str | None = None, clock=time.time):
        self.sink, self.folder, self.clock = sink, folder, clock

    def take(self, df: DataFrame, number: int = 0, final: bool = True) -> None:
        """The rows of a micro-batch, with their places."""
        sink, spark = self.sink, df.sparkSession
        known = feed.handed_on(spark, self.folder, number) if self.folder else None
        names = [c for c in df.columns if not c.startswith("__")]
        waits = bool(sink.batch_count or sink.batch_duration)
        raw, now = df.select(*[F.col(f"`{c}`") for c in names], PLACE), self.clock()
        last = None
        if sink.delta:
            before = known.where("__what = 'last'").select(*[F.col(f"`{c}`") for c in names], F.lit(-1).cast("long").alias(PLACE)) if known is not None else None
            both = feed.joined(raw, before)
            last = both.agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in names]), F.col(PLACE)).alias("r")).where("r IS NOT NULL").select("r.*")
            rows = shaping.row_diff(both, PLACE, sink.delta_columns).where(F.col(PLACE) >= 0)
        else:
            rows = raw
        opened = now
        if waits:
            waiting = known.where("__what = 'waits'").select(*rows.columns, "__opened") if known is not None else None
            if waiting is not None:
                first = waiting.agg(F.min("__opened"), F.count(F.lit(1))).head()
                opened, held = (first[0], first[1]) if first[1] else (now, 0)
                rows = feed.joined(rows, waiting.drop("__opened"))
            else:
                held = 0
            total = rows.count()
            index = F.col(PLACE) + held  # those that wait have places below 0
            size = sink.batch_count or max(1, total)
            rows = rows.withColumn("__batch", F.floor(index / size).cast("long"))
            over = final or bool(sink.batch_duration) and now - opened >= sink.batch_duration
            full = total if over else total // size * size if sink.batch_count else 0
            left = rows.where(index >= full).withColumn(PLACE, F.col(PLACE) + F.lit(held - total))
            rows = rows.where(index < full)
        if self.folder:
            kept = [x for x in (None if last is None else self._kept(last, rows, "last", now), self._kept(left.drop("__batch"), rows, "waits", opened if held and not full else now) if waits else None) if x is not None]
            if kept:
                out = kept[0]
                for x in kept[1:]:
                    out = out.unionByName(x)
                feed.put(out, self.folder, number)
        self._send(rows, "__batch" if waits else None)

    def flush(self, spark) -> None:
        """What waits leaves; the last row stays known."""
        found = feed.numbers(spark, self.folder) if self.folder else []
        if not found or not (self.sink.batch_count or self.sink.batch_duration):
            return
        known = spark.read.parquet(f"{self.folder}/{found[-1]}")
        waiting = known.where("__what = 'waits'").drop("__what", "__opened").withColumn("__batch", F.lit(0))
        self._send(waiting, "__batch")
        # the next micro-batch finds the table without what has left
        rest = known.where("__what <> 'waits'").collect()
        feed.drop_path(spark, f"{self.folder}/{found[-1]}")
        feed.put(spark.createDataFrame(rest, known.schema), self.folder, found[-1])

    def _kept(self, df: DataFrame, like: DataFrame, what: str, opened: float) -> DataFrame:
        fields = [f for f in like.schema.fields if f.name != "__batch"]
        return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields], F.lit(what).alias("__what"), F.lit(float(opened)).alias("__opened"))

    def _send(self, rows: DataFrame, batch: str | None) -> None:
        sink = self.sink
        if sink.omit_if_empty:
            rows = shaping.omit_if_empty(rows, batch)
        if sink.omit_if_empty and rows.isEmpty() or batch and rows.isEmpty():
            return
        if sink.encoder:
            more = {"omit_nulls": sink.omit_null_columns, "template": sink.template} if sink.encoder == "json" else {}
            out = ENCODERS[sink.encoder](rows, PLACE, batch, **more)
            sink.write(out.orderBy(batch) if batch else out)
        else:
            sink.write(rows.orderBy(PLACE).select(*[F.col(f"`{c}`") for c in rows.columns if not c.startswith("__") or c == "__mask"]))
