"""A training-corpus pipeline over ``documents``: five stages, each written and read again.

All stages but the last return the columns of the documents they get, extra ones too,
whatever their names are: operators see them under names of the pipeline's own. An empty
table gives an empty table. Rows with a null id are documents of their own: nothing is a
copy of them and no label is theirs. Rows that repeat each go through every stage. A null
text is an empty one but for its value. Very long texts are worked on whole, a row at a
time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import bpe, jaccard_join, language_id, line_dedup, mixing
from weir.llm.common import kept, table, temporary

#: Targets of the mix: all good tokens, some poor ones, none of the toxic ones.
WEIGHTS = {"good": 0.95, "poor": 0.05, "toxic": 0.0}


class Hidden:
    """Documents with columns named by their place, and the way back."""

    def __init__(self, docs: DataFrame):
        self.names, self.columns = docs.columns, [f"__c{i}" for i in range(len(docs.columns))]
        self.docs = docs.toDF(*self.columns)

    def __getitem__(self, name: str) -> str:
        return self.columns[self.names.index(name)]

    def back(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns).toDF(*self.names)


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determinable language go: those without a letter, and all if no document has a language to learn from."""
    own = Hidden(docs)
    model = language_id.learn(own.docs, own["text"], own["lang"], own["doc_id"])
    return own.back(language_id.language_id(own.docs, model, own["text"]).where(F.col("lang_pred") != language_id.UNDETERMINED))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that more than a tenth of a source's documents contain go; a document of such lines alone is a copy, left to the next stage.

    Documents without a source are left alone; n_chars follows the text, null with it.
    """
    own = Hidden(docs)
    found = line_dedup.line_dedup(own.docs, own["source"], own["text"], spare_whole=True)
    return own.back(found.withColumn(own["n_chars"], F.char_length(own["text"]).cast("long")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles at 0.8 connect, those with the least id stay; a row without words stays."""
    own = Hidden(docs)
    groups = jaccard_join.jaccard_components(own.docs, own["doc_id"], own["text"], n=5, percent=80)
    copies = groups.where("id <> component").select(F.col("id").alias(own["doc_id"])).distinct()
    return own.back(own.docs.join(copies, own["doc_id"], "left_anti"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents labelled toxic, or toxic by their posterior, go; others stay with their fitted rate as probability, by a hash of the id.

    Good documents have the rate 1, so that all of them stay. A null id has one hash, so
    rows without an id that have the same rate stay or go together.
    """
    own = Hidden(docs)
    labels = table(spark, sf_dir, "labels")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    known = own.docs.withColumn("doc_id", F.col(own["doc_id"])).withColumn("text", F.col(own["text"]))
    rates = mixing.mix(known, labels, WEIGHTS, full="good", keep=[*own.columns, "doc_id"]).where("p_toxic <= 0.5").join(toxic, "doc_id", "left_anti")
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    return own.back(rates.where(chance < F.col("rate")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    import public_tokenizers

    own = Hidden(docs)
    named = own.docs.select(F.col(own["doc_id"]).alias("doc_id"), F.col(own["text"]).alias("text"))
    return bpe.digests(bpe.bpe_round_trip(named, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [("language_id", detect_language), ("line_dedup", drop_boilerplate), ("jaccard_join", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]
#: Language models and classifiers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage wrote for itself goes when its documents are written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
