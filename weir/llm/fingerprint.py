"""Bottom-k sketches of word shingles, in DataFrame functions.

A sketch is the ascending array of the ``k`` least distinct 64-bit hashes of a text's
shingles of ``n`` words (a text with fewer words has one shingle, all its words; a text
without words has none). Two sketches merge to the sketch of all shingles of both, so
parts of a text or of a corpus can be sketched apart. With fewer than ``k`` entries a
sketch is the whole set and its estimates are exact.

A null text counts as an empty one, with an empty sketch; two empty sketches have the
likeness 1, an empty and another one 0. Repeated rows are sketched each by itself; an
empty table gives an empty table. Rows are in the order of descending ids, null ones last,
then of the first PREFIX characters of the text, then of its hash, so that repeated and
null ids have a next document too; equal rows follow each other. Only the id and text
columns are read by the query, so other columns can't clash. A text is sketched within its
row, so a very long one must fit a task.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import rank
from .common import SHARE, let, share_of, table
from .quality import split_words

K, SHINGLE = 128, 5
LONGS = "array<long>"
#: Bytes of text that one task orders, of up to UNIT bytes in all; beyond, ranges grow with the cube root of the input, as the driver and every task hold their bounds.
RANGE_BYTES, UNIT = 12 << 20, 1 << 30
#: Sampled rows for each bound; characters of a text that order rows of one id.
SAMPLES, PREFIX = 16, 64


def shingle_hashes(words: Column, n: int = SHINGLE) -> Column:
    """Hashes of the shingles of a column of words, repeats included."""
    places = F.sequence(F.lit(0), F.size(words) - n)
    many = F.transform(places, lambda i: F.xxhash64(*[words[i + k] for k in range(n)]))
    return F.when(F.size(words) >= n, many).when(F.size(words) > 0, F.array(F.xxhash64(F.concat_ws(" ", words)))).otherwise(F.array().cast(LONGS))


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """The bottom-k sketch of a text; A-Z and a-z are told apart."""
    return let(split_words(text), lambda w: F.slice(F.sort_array(F.array_distinct(shingle_hashes(w, n))), 1, k))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of all that two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged(df: DataFrame, keys: list[str], sketch_col: str, k: int = K, parts: int = 64) -> DataFrame:
    """keys, sketch: one sketch a group, by way of ``parts`` salted groups so that a hot one is not gathered at once."""
    salted = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    entries = salted.select(*keys, "__salt", F.explode(sketch_col).alias("__h")).distinct()
    ranked = entries.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy("__h"))).where(F.col("__rank") <= k)
    return ranked.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_set("__h")), 1, k).alias("sketch"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A and B| / |A or B|."""
    both = let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))
    return both.cast("double")


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles."""
    share = (F.element_at(a, -1).cast("double") + F.lit(math.ldexp(1, 63))) / F.lit(math.ldexp(1, 64))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A and B| / |A|, from the resemblance and the sizes; at most 1."""
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def to_text(a: Column) -> Column:
    """A sketch as a string, 16 hexadecimal digits an entry."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


ORDER = "struct<n:int,i:long,p:string,h:long>"


def _order(id_: Column, value: Column) -> Column:
    """What ascends with the order of the rows."""
    return F.struct(id_.isNull().cast("int").alias("n"), F.bitwise_not(F.coalesce(id_.cast("long"), F.lit(0))).alias("i"), F.coalesce(F.substring(value, 1, PREFIX), F.lit("")).alias("p"), F.xxhash64(value).alias("h"))


def with_next(docs: DataFrame, id_col: str, value_cols: list[str], ranges: int, derive=None) -> DataFrame:
    """``docs`` with __next, a struct of the ``value_cols`` of the next row; after the last comes the first.

    Rows are cut into ranges of their order that begin at sampled rows; each range is
    ordered by itself in one shuffle of the rows. The row that begins a range is also sent
    to the range before as its end, so no window spans the table, and no range is empty.
    ``derive`` adds columns after the shuffle, so that they aren't shuffled themselves.
    """
    order = _order(F.col(id_col), F.col(value_cols[0]))
    own = docs.select(order.alias("o"))
    least = own.agg(F.min("o").alias("o")).select("o.*").head()
    starts = [tuple(least)]
    if ranges > 1 and least.n is not None:
        sample = own.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SHARE)) < share_of(SAMPLES * ranges, docs.count())).select("o.*").collect()
        ranked = sorted(map(tuple, sample))
        starts = sorted({*starts, *(ranked[k * len(ranked) // ranges] for k in range(1, ranges) if ranked)})
    # a literal that is folded, as are all expressions over it
    steps = F.from_json(F.lit(json.dumps([dict(zip("niph", x)) for x in starts])), f"array<{ORDER}>")
    spot = F.greatest(F.lit(0), rank(F.col("__o"), steps, len(starts), inclusive=True) - 1)
    ranged = docs.withColumn("__o", order).withColumn("__range", spot)
    begins = F.get(steps, F.col("__range")) == F.col("__o")
    both = F.struct(F.col("__range").alias("r"), F.lit(False).alias("end"))
    before = F.struct(F.pmod(F.col("__range") - 1, F.lit(len(starts))).alias("r"), F.lit(True).alias("end"))
    dealt = ranged.withColumn("__to", F.explode(F.when(begins, F.array(both, before)).otherwise(F.array(both)))).withColumn("__range", F.col("__to.r")).withColumn("__end", F.col("__to.end")).drop("__to", "__o").repartition(len(starts), "__range")
    dealt = derive(dealt) if derive else dealt
    inside = Window.partitionBy("__range").orderBy("__end", order)
    return dealt.withColumn("__next", F.lead(F.struct(*value_cols)).over(inside)).where(~F.col("__end")).drop("__range", "__end")


def spread(docs: DataFrame, text_col: str = "text", size: int = RANGE_BYTES) -> int:
    """How many ranges the texts are cut into."""
    total = docs.agg(F.sum(F.octet_length(text_col))).head()[0] or 0
    return max(1, math.ceil(total / (size * max(1.0, total / UNIT) ** (1 / 3))))


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as much of the beginning of the following one."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, "doc_id", ["text", "print"], spread(docs), lambda df: df.withColumn("print", sketch(F.col("text"))))
    both = rows.select("doc_id", "text", "print", F.col("__next.print").alias("following"), edited(F.col("text"), F.col("__next.text")).alias("changed")).withColumn("changed_print", sketch(F.col("changed")))
    return both.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("changed", 256).alias("edited_sha256"), to_text(F.col("print")).alias("fingerprint"), to_text(F.col("changed_print")).alias("edited_fingerprint"),
        resemblance(F.col("print"), F.col("changed_print")).alias("near_edited"), resemblance(F.col("print"), F.col("following")).alias("near_next"), distinct_count(F.col("print")).alias("n_distinct"),
    )
