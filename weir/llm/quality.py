"""Quality rules: hashed n-gram likelihood ratios and the base counts, in DataFrame functions.

The method compares two multinomials over hashed word unigrams and bigrams: one of a
trusted target, one of the raw corpus. A document's score is the mean over its n-grams of
log(p_target / p_raw); it is kept if the score reaches ``THRESHOLD``. The raw counts cover
every document. The target is a bounded sample of the rows labelled as good, about
``TARGET_ROWS`` of them, chosen by a hash of their ids.

A null text has no words and no lines, and fails the base rules. Repeated rows are judged
each by itself. An empty table gives an empty table. Labels with a null id or quality are
left out; ids that are labelled twice count once. Without trusted rows both multinomials
are the raw one, all scores are 0, and the base rules alone decide. A score equal to the
threshold is kept. A text is worked on within its row, by sorts and folds that are linear
but for the sorts, so a very long one must fit a task. Columns of the input with the names
of output columns are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHARE, let, share_of, table

BUCKETS = 8192
TARGET_ROWS = 20_000
SMOOTHING = 1.0
#: On labelled rows nearly all good documents of 50 words or more score over -0.04, and nearly all bad ones under -0.06: the middle of the gap.
THRESHOLD = -0.05
SPACE, SYMBOLS = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
#: Low bits of a window's sort key that hold its place in the text.
PLACE = (1 << 31) - 1
INTS, LONGS = "array<int>", "array<long>"


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def buckets(words: Column, n: int = BUCKETS) -> Column:
    """The hash bucket of each unigram, then of each bigram."""
    places = F.when(F.size(words) >= 2, F.sequence(F.lit(0), F.size(words) - 2)).otherwise(F.array().cast(INTS))
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(n)).cast("int")
    return F.concat(F.transform(words, lambda w: bucket(w)), F.transform(places, lambda i: bucket(words[i], words[i + 1])))


def target_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = TARGET_ROWS) -> DataFrame:
    """Ids of about ``rows`` trusted rows, all if there are no more."""
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"))
    return good.where(F.pmod(F.xxhash64("__id"), F.lit(SHARE)) < share_of(rows, good.count())).distinct()


def log_ratios(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = BUCKETS, rows: int = TARGET_ROWS) -> list[float]:
    """log(p_target / p_raw) of each bucket, from one pass over all documents; ``n`` numbers reach the driver."""
    ids = target_ids(labels, id_col, rows=rows).withColumn("__target", F.lit(1))
    words = docs.select(F.col(id_col).alias("__id"), split_words(F.col(text_col)).alias("__words"))
    counts = (
        words.join(F.broadcast(ids), "__id", "left")  # at most about `rows` ids
        .select("__target", F.explode(let(F.col("__words"), lambda w: buckets(w, n))).alias("bucket"))
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("__target").alias("target")).collect()
    )
    raw, target = [0] * n, [0] * n
    for x in counts:
        raw[x.bucket], target[x.bucket] = x.raw, x.target
    if not any(target):
        return [0.0] * n
    a, b = sum(target) + SMOOTHING * n, sum(raw) + SMOOTHING * n
    return [math.log((t + SMOOTHING) / a) - math.log((r + SMOOTHING) / b) for t, r in zip(target, raw)]


def mean_log_ratio(words: Column, ratios: list[float]) -> Column:
    """The score of a document; 0 without words."""
    ratio = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    total = F.aggregate(buckets(words, len(ratios)), F.lit(0.0), lambda acc, b: acc + ratio[b])
    return F.when(F.size(words) > 0, total / (2 * F.size(words) - 1)).otherwise(0.0)


def _twins(keys: Column, same, pick) -> Column:
    """``pick`` of each entry of a sorted array that has an equal neighbour."""
    n = F.size(keys)
    near = lambda j: (F.coalesce(same(F.get(keys, j - 1), keys[j]), F.lit(False))) | F.coalesce(same(F.get(keys, j + 1), keys[j]), F.lit(False))
    return F.transform(F.filter(F.when(n > 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast(INTS)), near), lambda j: pick(keys[j]))


def repeated_places(words: Column, width: int = 3) -> Column:
    """Starts of the windows of ``width`` words that stand twice or more in the text, ascending.

    Windows are sorted by 33 bits of their hash with the place in the low bits; those
    with an equal neighbour are then compared as strings. Linear but for the sorts.
    """
    count = F.size(words) - width
    places = F.when(count >= 0, F.sequence(F.lit(0), count)).otherwise(F.array().cast(INTS))
    window = lambda i: [words[i + k] for k in range(width)]
    high = F.lit(~PLACE)
    keys = F.sort_array(F.transform(places, lambda i: F.xxhash64(*window(i)).bitwiseAND(high).bitwiseOR(i.cast("long"))))
    likely = let(keys, lambda k: _twins(k, lambda a, b: a.bitwiseAND(high) == b.bitwiseAND(high), lambda a: a.bitwiseAND(F.lit(PLACE)).cast("int")))
    exact = F.array_sort(F.transform(likely, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("k"), i.alias("i"))))
    return F.sort_array(let(exact, lambda k: _twins(k, lambda a, b: a["k"] == b["k"], lambda a: a["i"])))


def covered(starts: Column, width: int = 3) -> Column:
    """How many places the windows at ascending ``starts`` cover."""
    zero = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("total"))
    step = lambda acc, s: F.struct(s.alias("last"), (acc["total"] + F.least(F.lit(width), s - acc["last"])).alias("total"))
    return F.aggregate(starts, zero, step, lambda acc: acc["total"])


def quality_rules(docs: DataFrame, ratios: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base counts, base_failed, score and kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    added = {
        "n_words": F.size("__words").cast("long"),
        "word_chars": (F.char_length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(F.col("__words"), lambda w: covered(repeated_places(w))),
        "score": let(F.col("__words"), lambda w: mean_log_ratio(w, ratios)),
    }
    kept = [c for c in docs.columns if c not in (*added, "base_failed", "kept")]
    extra = [] if text_col in kept else [F.col(text_col)]
    out = docs.withColumn("__words", split_words(F.col(text_col))).select(*[F.col(f"`{c}`") for c in kept], *extra, *[c.alias(n) for n, c in added.items()])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).select(*kept, *added, "base_failed", "kept")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = log_ratios(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, ratios).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
