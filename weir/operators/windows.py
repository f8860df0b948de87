"""The windows of GROUP BY: each row gets the windows that it is in, as columns __w and, where there are several of a kind, more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .aggregates import MERGED
from .ordering import arrival_index
from .stateful import State


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def tumbling(df: DataFrame, ts: str, seconds: int) -> tuple[DataFrame, list[str]]:
    """Windows of ``seconds`` from the epoch on; __w is the start in seconds. One hash of the window, no order."""
    start = F.floor(micros(F.col(ts)) / F.lit(1_000_000 * seconds)) * seconds
    return df.withColumn("__w", start.cast("long")), ["__w"]


def count(df: DataFrame, seq: str, rows: int, flush_partial: bool = False) -> tuple[DataFrame, list[str]]:
    """Windows of ``rows`` arrivals of the whole stream; the last goes if it isn't full, unless it is asked for."""
    indexed, total = arrival_index(df, seq)
    out = indexed.withColumn("__w", F.floor(F.col("__index") / rows).cast("long")).drop("__index")
    return (out if flush_partial else out.where(F.col("__w") < total // rows)), ["__w"]


def sliding(df: DataFrame, ts: str, seq: str, back: int, ahead: int = 0) -> tuple[DataFrame, list[str]]:
    """A window for every row, of the rows from ``back`` seconds before it to ``ahead`` seconds after it.

    Without ``ahead`` a row doesn't see later rows of its own time. Rows meet by buckets as
    wide as a window, of which each window touches two, so the join is one on equal keys.
    """
    width = max(1, back + ahead) * 1_000_000
    at = micros(F.col(ts))
    low, high = F.col("__wt") - back * 1_000_000, F.col("__wt") + ahead * 1_000_000
    triggers = df.select(at.alias("__wt"), F.col(seq).alias("__w"))
    triggers = triggers.withColumn("__b", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    rows = df.withColumn("__at", at).withColumn("__b", F.floor(F.col("__at") / width))
    seen = (F.col("__at") >= low) & (F.col("__at") <= high)
    if not ahead:
        seen = seen & ((F.col("__at") < F.col("__wt")) | (F.col(seq) <= F.col("__w")))
    return rows.join(triggers, (rows["__b"] == triggers["__b"]) & seen).drop("__b", "__at", "__wt"), ["__w"]


def slid(df: DataFrame, ts: str, seq: str, back: int, ahead: int, keys: dict[str, Column], asked: list[tuple[str, Column, T.DataType | None, str]]) -> DataFrame:
    """__w, the ``keys`` and the aggregates ``asked`` (name, argument, its type, alias), all in MERGED, of the groups by ``keys`` of the windows that ``sliding`` makes.

    A window is as wide as a bucket of time, so it is the end of one bucket and the
    beginning of the next. Each row stands in its own bucket at its time and in the bucket
    before at its time less the width, and asks where its window begins, once for each key
    in its window: from there on it finds the rows of the bucket, up to there those of the
    next one, each by running aggregates. So twice the rows and once the groups of the
    result are moved, however many rows a window has; a task must hold no more than sorts
    of a bucket, which spill. Whether a key is in a window follows from its last time in
    the one bucket and its first in the next. Rows without a time are in no window.
    """
    width = (back + ahead) * 1_000_000
    bucket = lambda at: ((at - F.pmod(at, F.lit(width))) / width).cast("long")
    at, low, names, inputs = F.col("__at"), F.col("__at") - back * 1_000_000, list(keys), [f"__x{i}" for i in range(len(asked))]
    turn = F.lit(None).cast(df.schema[seq].dataType) if ahead else F.col("__w")
    rows = df.select(micros(F.col(ts)).alias("__at"), F.col(seq).alias("__w"), *[k.alias(n) for n, k in keys.items()], *[x.alias(n) for (_, x, *_), n in zip(asked, inputs)]).where("__at IS NOT NULL")
    place = lambda b, p, next_: F.struct(b.alias("b"), p.alias("p"), F.lit(next_).cast("boolean").alias("next"))
    places = F.array(place(bucket(at), at, False), place(bucket(at) - 1, at - width, True), place(bucket(low), low, None))
    spots = rows.select(F.explode(places).alias("__p"), turn.alias("turn"), "__w", *names, *inputs)
    asks = F.col("next").isNull()
    spots = spots.select("__p.*", "turn", "__w", *names, *inputs).select("b", "p", "next", "turn", "__w", *[F.when(~asks, F.col(n)).alias(n) for n in inputs], *names)
    if keys:
        placed = spots.where(~asks)
        ends = placed.groupBy(F.col("b").alias("__b"), *names).agg(F.max(F.when(~F.col("next"), F.col("p"))).alias("__last"), F.min(F.when(F.col("next"), F.col("p"))).alias("__first"))
        met = (F.col("b") == F.col("__b")) & ((F.col("__last") >= F.col("p")) | (F.col("__first") <= F.col("p")))
        spots = placed.union(spots.where(asks).drop(*names).join(ends, met).select(*placed.columns))
    part = Window.partitionBy("b", *names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = [(~F.col("next"), part.orderBy(F.col("p").desc(), asks)), (F.col("next"), part.orderBy("p", "turn", asks))]
    counted = [*zip(asked, map(F.col, inputs)), (("count", None, None, "__seen"), F.lit(1))]
    running = [[[c.over(side) for c in MERGED[name][0](F.when(on, x), F.when(on, F.col("__w")))] for on, side in sides] for (name, *_), x in counted]
    found = spots.select("__w", *names, asks.alias("__asks"), *[c.alias(f"__p{i}_{s}_{k}") for i, both in enumerate(running) for s, cs in enumerate(both) for k, c in enumerate(cs)])
    whole = [MERGED[name][1](*[[F.col(f"__p{i}_{s}_{k}") for k in range(len(cs))] for s, cs in enumerate(running[i])], kind).alias(alias) for i, ((name, _, kind, alias), _) in enumerate(counted)]
    # a key whose first row comes at the time of the window's end, but arrives later, isn't seen
    return found.where("__asks").select("__w", *names, *whole).where("__seen > 0").drop("__seen")


def state(df: DataFrame, seq: str, open_: Column, emit: Column, by: list[Column], graceful: bool = True) -> tuple[DataFrame, list[str]]:
    """Windows from a row where ``open_`` holds to the next one where ``emit`` does, for each of ``by``.

    A row that only opens leaves the window open, one that only emits leaves it closed, and
    one that does both turns it over; so what a row finds follows from the last row of the
    first two kinds and the number of turning ones since, and no fold is needed. Windows
    that are still open at the end count if the stream ends gracefully. Without ``by``,
    rows with a __range are worked on range by range.
    """
    keys = [k.alias(f"__by{i}") for i, k in enumerate(by)]
    names, zero = [f"__by{i}" for i in range(len(by))], F.lit(0)
    st = State(df.select("*", *keys, F.coalesce(open_, F.lit(False)).alias("__o"), F.coalesce(emit, F.lit(False)).alias("__e")), [F.col(n) for n in names], F.col(seq), F.lit(True))
    sets = F.col("__o") != F.col("__e")
    last = F.coalesce(st.over("last", F.when(sets, F.col("__o")), before=True), F.lit(False))
    part = F.coalesce(st.over("sum", sets.cast("int"), before=True), zero)
    st.df = st.df.withColumn("__last", last).withColumn("__part", part)
    # a row of the first kinds begins the part after it, so turns before it belong to its own part
    turns = F.coalesce(st.over("sum", (F.col("__o") & F.col("__e")).cast("int"), "__part", before=True), zero)
    st.df = st.df.withColumn("__active", F.col("__last") != (turns % 2 == 1))
    st.df = st.df.withColumn("__start", ~F.col("__active") & F.col("__o"))
    number = st.over("sum", F.col("__start").cast("long"))
    out = st.df.withColumn("__w", number).where(F.col("__active") | F.col("__start"))
    out = out.drop(*[c for c in out.columns if c.startswith("__carry")])
    if not graceful:  # the last window of each key goes if its last row leaves it open
        ends = out.groupBy(*names).agg(F.max("__w").alias("__final"), F.max_by(F.col("__start") | ~F.col("__e"), F.col(seq)).alias("__left"))
        if names:
            out = out.join(ends, names)
        else:
            final, left = ends.head()
            out = out.withColumn("__final", F.lit(final)).withColumn("__left", F.lit(left))
        out = out.where(~F.col("__left") | (F.col("__w") < F.col("__final"))).drop("__final", "__left")
    return out.drop("__o", "__e", "__last", "__part", "__active", "__start", "__range"), [*names, "__w"]
