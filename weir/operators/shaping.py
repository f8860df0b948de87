"""What sources and sinks do to rows: sampling, change gates, row differences, batching, suppression.

Per-row operators take the arrival order, and optional partition keys; without keys there is
one history for the whole stream, which is worked on in ranges of the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import RANGE_ROWS, arrival_index, ranged
from .stateful import State


def sample_latest(df: DataFrame, ts: str, seq: str, seconds: float) -> DataFrame:
    """The newest raw row of each interval; to be used before decoding. Partial maxima, one shuffle of the intervals."""
    interval = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(int(seconds * 1_000_000)))
    newest = df.groupBy(interval.alias("__i")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(ts, seq)).alias("r"))
    return newest.select("r.*")


def sample_packed(df: DataFrame, ts: str, seq: str, seconds: float, payload: str, merge, keep_names: bool = False) -> DataFrame:
    """One payload for each interval, merged from its payloads in order by ``merge(list of bytes) -> bytes``."""
    import pandas as pd

    keyed = df.select(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(int(seconds * 1_000_000))).alias("interval"), F.col(seq).alias("seq"), F.col(ts).alias("ts"), F.col(payload).alias("payload"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        return pd.DataFrame({"seq": [rows.seq.iloc[-1]], "ts": [rows.ts.iloc[-1]], "payload": [merge([bytes(p) for p in rows.payload])]})

    packed = keyed.groupBy("interval").applyInPandas(pack, f"seq long, ts timestamp, payload {keyed.schema['payload'].dataType.simpleString()}")
    return packed.select(F.col("seq").alias(seq), F.col("ts").alias(ts), F.col("payload").alias(payload)) if keep_names else packed.select("ts", "payload")


def _with_before(df: DataFrame, columns: Sequence[str], seq: str, by: Sequence[str], rows: int) -> DataFrame:
    """``df`` with __prev, the tracked columns of the row before."""
    now = F.struct(*[F.col(f"`{c}`") for c in columns])
    if by:
        return df.withColumn("__prev", F.lag(now).over(Window.partitionBy(*by).orderBy(seq)))
    st = State(ranged(df, seq, rows), [], F.col(seq), F.lit(True))
    before = st.over("last", now, before=True)
    return st.df.withColumn("__prev", before).select(*df.columns, "__prev")


def on_change(df: DataFrame, seq: str, columns: Sequence[str] | None = None, by: Sequence[str] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """Rows whose tracked columns (all, by default) differ from those of the last row let through; the first always is.

    Rows held back are equal to that last one in the tracked columns, so comparing with the
    row before is the same.
    """
    tracked = list(columns) if columns else [c for c in df.columns if c != seq and not c.startswith("__")]
    gated = _with_before(df, tracked, seq, by, rows)
    now = F.struct(*[F.col(f"`{c}`") for c in tracked])
    return gated.where(F.col("__prev").isNull() | ~now.eqNullSafe(F.col("__prev"))).drop("__prev")


def row_diff(df: DataFrame, seq: str, columns: Sequence[str] | None = None, by: Sequence[str] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """Unchanged tracked columns become null; __mask tells for every output column whether it is sent.

    The first row is whole; columns that aren't tracked are always sent; a change to null is sent as null.
    """
    output = [c for c in df.columns if c != seq and not c.startswith("__")]
    tracked = list(columns) if columns else output
    out = _with_before(df, tracked, seq, by, rows)
    sent = {c: (F.col("__prev").isNull() | ~F.col(f"`{c}`").eqNullSafe(F.col("__prev")[c])) if c in tracked else F.lit(True) for c in output}
    mask = F.array(*sent.values()).alias("__mask")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in output]
    return out.select(*[F.when(sent[c], F.col(f"`{c}`")).alias(c) for c in output], *rest, mask)


def omit_if_empty(df: DataFrame, batch: str | None = None) -> DataFrame:
    """Without the batches in which no row sends anything: empty ones, or with all masks false."""
    if "__mask" not in df.columns:
        return df
    sends = F.exists("__mask", lambda x: x)
    if batch is None:  # one batch: all of it, if any row sends something
        return df if not df.where(sends).isEmpty() else df.limit(0)
    return df.join(df.where(sends).select(batch).distinct(), batch, "left_semi")


def batches(df: DataFrame, seq: str, rows: int | None = None, ts: str | None = None, seconds: float | None = None) -> DataFrame:
    """``df`` with __batch: a number for every ``rows`` arrivals, or for every ``seconds``."""
    if rows:
        indexed, _ = arrival_index(df, seq)
        return indexed.withColumn("__batch", F.floor(F.col("__index") / rows).cast("long")).drop("__index")
    return df.withColumn("__batch", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(int(seconds * 1_000_000))).cast("long"))
