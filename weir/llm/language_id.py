"""Language mixtures by expectation-maximisation over character n-gram likelihoods.

A language is a multinomial over hashed character trigrams. For a text, EM estimates the
proportions of all learned languages; nested sets of the most frequent ones are fitted
again, and the set with the best penalised log-likelihood (half of log n for each further
language) of all of them is taken, the smaller one of two as good. The predicted language
is the one with the largest proportion, of two the one first in the alphabet. EM goes on
until no proportion moves by CLOSE; a text whose EM has not got there in MOST_ITERATIONS
is told by ``converged``.

A text that is null or has no letter is ``und`` with the score 0, and so is every text
where no language could be learned. Rows without a language or a text teach nothing.
Repeated rows are predicted each by itself; an empty table gives an empty table; columns
of the input with the names of output columns are replaced. Whole texts are read, in
slices, so that memory doesn't grow with the longest.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SHARE, share_of, table, temporary, written

#: Hash buckets of trigrams (a power of two), and the smoothing of their counts.
BITS, SMOOTHING = 15, 0.5
#: A bound of the sample that the models are fitted on: about so many labelled rows a language.
ROWS_A_LANGUAGE = 4_000
CLOSE, MOST_ITERATIONS, SLICE, ROWS = 1e-4, 10_000, 1 << 20, 512
UNDETERMINED = "und"
OUTPUTS = {"lang_pred": T.StringType(), "score": T.DoubleType(), "languages": T.StringType(), "converged": T.BooleanType()}


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigram_counts(text: str) -> tuple[np.ndarray, bool]:
    """Counts by bucket of the trigrams with a letter, with runs of other characters as one space; whether there is a letter."""
    counts, found, tail = np.zeros(1 << BITS, np.int64), False, np.array([32], np.uint32)
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[codes]
        found |= bool(letter.any())
        codes = np.concatenate([tail, np.where(letter, codes, 32).astype(np.uint32), *([np.array([32], np.uint32)] if at + SLICE >= len(text) else [])])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        tail = codes[-2:]
        if len(codes) > 2:
            a, b, c = codes[:-2], codes[1:-1], codes[2:]
            h = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)
            h ^= h >> np.uint32(15)
            counts += np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return counts, found


def mixture(p: np.ndarray, n: np.ndarray, iterations: int = MOST_ITERATIONS, close: float = CLOSE) -> tuple[np.ndarray, float, bool]:
    """Proportions of the columns of ``p`` and the log-likelihood of counts ``n``, by EM; whether it converged."""
    share, total, done = np.full(p.shape[1], 1 / p.shape[1]), n.sum(), p.shape[1] == 1
    for _ in range(0 if done else iterations):
        mixed = p @ share
        new = share * ((n / mixed) @ p) / total
        done = bool(np.abs(new - share).max() < close)
        share = new
        if done:
            break
    return share, float(n @ np.log(p @ share)), done


def detect(text: str | None, languages: list[str], p: np.ndarray) -> tuple[str, float, str, bool]:
    """The predicted language, its proportion, the chosen set with proportions, and whether EM converged."""
    counts, letter = trigram_counts(text) if text else (None, False)
    if not letter or not languages:
        return UNDETERMINED, 0.0, "", True
    seen = np.flatnonzero(counts)
    n, q = counts[seen].astype(float), p[seen]
    share, _, converged = mixture(q, n)
    order, best = np.argsort(-share, kind="stable"), None
    # a set without languages of next to no proportion says the same with a smaller penalty
    for size in range(1, 1 + max(1, int((share >= 0.5 / n.sum()).sum()))):
        own, likelihood, done = mixture(q[:, order[:size]], n)
        converged &= done
        value = likelihood - 0.5 * (size - 1) * np.log(n.sum())
        if best is None or value > best[0]:
            best = (value, own, order[:size])
    _, own, chosen = best
    ranked = sorted(zip(-own, (languages[i] for i in chosen)))
    return ranked[0][1], float(min(1.0, -ranked[0][0])), ",".join(f"{name}:{-x:.3f}" for x, name in ranked), converged


def held_out(id_col: Column) -> Column:
    """Whether a row may not teach."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = ROWS_A_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities (buckets x languages), from a bounded sample by a hash of the ids.

    What reaches the driver is one row a language, with at most 2 ** BITS counts.
    """
    rows_of = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    totals = {x[0]: x[1] for x in rows_of.groupBy(lang_col).count().collect()}
    if not totals:
        return [], np.zeros((1 << BITS, 0))
    limits = F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, share_of(rows, v))])
    sample = rows_of.where(F.pmod(F.xxhash64(id_col), F.lit(SHARE)) < limits[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found[lang] = found.get(lang, 0) + trigram_counts(text.as_py())[0]
        for lang, counts in found.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages, p = sorted(totals), np.full((1 << BITS, len(totals)), SMOOTHING)
    grouped = counted.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))
    # read from a table of its own: Spark takes a query as ended, and deletes its shuffle files, before toLocalIterator gets the first row
    with temporary(docs.sparkSession):
        for x in written(grouped, "trigrams").toLocalIterator():
            p[x.b, languages.index(x.lang)] += x.n
    return languages, (p / p.sum(0)).astype(np.float32)


def language_id(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and languages (the chosen set with proportions)."""
    kept = [c for c in docs.columns if c not in OUTPUTS]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], *([] if text_col in kept else [F.col(f"`{text_col}`").alias("__in")]))
    name, schema = (text_col if text_col in kept else "__in"), T.StructType([docs.schema[c] for c in kept] + [T.StructField(k, v) for k, v in OUTPUTS.items()])
    languages, p = model

    def run(batches):
        q = p.astype(np.float64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = list(zip(*(detect(x.as_py(), languages, q) for x in part.column(part.schema.get_field_index(name))))) or [(), (), (), ()]
                arrays = [pa.array(made[0], pa.string()), pa.array(made[1], pa.float64()), pa.array(made[2], pa.string()), pa.array(made[3], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), *arrays], names=[*kept, *OUTPUTS])

    return source.mapInArrow(run, schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")
