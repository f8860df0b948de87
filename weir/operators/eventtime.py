"""Event time and late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import max_before


def event_time(df: DataFrame, column: str, kind: str = "unixtimestamp_ms", out: str = "__ts") -> DataFrame:
    """``out`` from a column of seconds or milliseconds since 1970; rows where it can't be told go."""
    number = F.col(f"`{column}`").try_cast("long")
    if kind not in ("unixtimestamp_s", "unixtimestamp_ms"):
        raise ValueError(f"unknown event time {kind}")
    made = F.timestamp_seconds(number) if kind == "unixtimestamp_s" else F.timestamp_millis(number)
    return df.withColumn(out, made).where(F.col(out).isNotNull())


def drop_late(df: DataFrame, ts: str, seq: str, tolerance: float) -> DataFrame:
    """Without the rows that come when the watermark, the greatest time so far less the tolerance, has reached their time.

    The greatest time so far is a running value over arrival order, carried from range to
    range, so it needs no single task.
    """
    timed = df.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    out = max_before(timed, "__us", seq)
    return out.where(F.col("__before").isNull() | (F.col("__us") > F.col("__before") - int(tolerance * 1_000_000))).drop("__us", "__before")
