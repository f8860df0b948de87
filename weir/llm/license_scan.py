"""License scan: ordered signature rules with a keyword prefilter, in DataFrame functions.

Words are maximal runs of letters, digits and non-ASCII characters, with A-Z lowered. A
rule is tried only on a text that contains its keyword as a word; the words of such a
text are marked with their places, so that a match carries its interval. A detection goes
if an earlier or equal interval that contains it has a rule of the same or a higher
priority (the larger interval, then the earlier rule, wins among equal priorities).

Everything happens within a row: nothing is shuffled. A null or empty text has no words,
no labels and the score 0; repeated rows are scanned each by itself; an empty table gives
an empty table; columns of the input with the names of output columns are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let, table
from .license_rules import BASE_RULES, KEYWORDS, RULES

#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DETECTION = "struct<first:int,last:int,priority:int,rule:int,label:string,confidence:int>"
#: Kept detections are gathered in parts of so many, to keep a long text's fold linear.
PART = 512


def _place(hit: Column) -> Column:
    return F.regexp_extract(hit, r"#(\d+);", 1).cast("int")


def _end(hit: Column) -> Column:
    return F.regexp_extract(hit, r"#(\d+);$", 1).cast("int")


def marked(words: Column) -> Column:
    """The words as one string, each with its place."""
    return F.concat_ws("", F.transform(words, lambda w, i: F.concat(F.lit(" "), w, F.lit("#"), i.cast("string"), F.lit(";"))))


def _base_hits(text: Column, hits: Column) -> Column:
    """(label, place) wherever a base phrase stands."""

    def places(label: str, keyword: str, regex: str) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda x: F.struct(F.lit(label).alias("label"), _place(x).alias("place")))
        return F.when(F.array_contains(hits, keyword), found).otherwise(F.array().cast("array<struct<label:string,place:int>>"))

    return F.concat(*[places(*rule) for rule in BASE_RULES])


def _detections(text: Column, hits: Column) -> Column:
    """All matches of the rules whose keyword is there, in the order in which a containing one comes first."""
    # one folded literal, as hundreds of struct expressions would cost seconds of planning
    table = [{"rule": i, "label": a, "priority": b, "confidence": c, "keyword": d, "regex": e} for i, (a, b, c, d, e) in enumerate(RULES)]
    rules = F.from_json(F.lit(json.dumps(table)), "array<struct<rule:int,label:string,priority:int,confidence:int,keyword:string,regex:string>>")
    gated = F.filter(rules, lambda r: F.array_contains(hits, r["keyword"]))
    found = F.flatten(F.transform(gated, lambda r: F.transform(F.regexp_extract_all(text, r["regex"], F.lit(0)), lambda x: F.struct(
        _place(x).alias("first"), (-_end(x)).alias("end"), (-r["priority"]).alias("rank"), r["rule"].alias("rule"), r["label"].alias("label"), r["confidence"].alias("confidence")))))
    return F.transform(F.array_sort(found), lambda x: F.struct(x["first"].alias("first"), (-x["end"]).alias("last"), (-x["rank"]).alias("priority"), x["rule"].alias("rule"), x["label"].alias("label"), x["confidence"].alias("confidence")))


def _kept(detections: Column) -> Column:
    """Those that no earlier one of at least their priority contains: one fold over the sorted ones."""
    none = F.array().cast(f"array<{DETECTION}>")
    start = F.struct(*[F.lit(-1).alias(f"m{p}") for p in (1, 2, 3)], F.array().cast(f"array<array<{DETECTION}>>").alias("parts"), none.alias("part"))

    def step(acc: Column, x: Column) -> Column:
        most = F.when(x["priority"] == 3, acc["m3"]).when(x["priority"] == 2, acc["m2"]).otherwise(acc["m1"])
        reach = lambda p: F.when(x["priority"] >= p, F.greatest(acc[f"m{p}"], x["last"])).otherwise(acc[f"m{p}"]).alias(f"m{p}")
        full = F.size(acc["part"]) >= PART
        parts = F.when(full, F.concat(acc["parts"], F.array(acc["part"]))).otherwise(acc["parts"])
        part = F.when(full, none).otherwise(acc["part"])
        return F.struct(reach(1), reach(2), reach(3), parts.alias("parts"), F.when(most >= x["last"], part).otherwise(F.concat(part, F.array(x))).alias("part"))

    return F.aggregate(detections, start, step, lambda acc: F.concat(F.flatten(acc["parts"]), acc["part"]))


def license_scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, base (label, place of each base phrase) and detections (what the rules keep)."""
    words = F.filter(F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), GAP), lambda w: w != "")
    cased = df.withColumn("__words", words)
    hits = F.array_intersect("__words", F.array(*map(F.lit, KEYWORDS)))
    gated = cased.select("*", F.size("__words").cast("long").alias("__n"), hits.alias("__hits")).withColumn("__text", F.when(F.size("__hits") > 0, marked(F.col("__words"))))
    scanned = let(F.col("__text"), lambda text: F.struct(_base_hits(text, F.col("__hits")).alias("base"), let(_detections(text, F.col("__hits")), _kept).alias("detections")))
    empty = F.struct(F.array().cast("array<struct<label:string,place:int>>").alias("base"), F.array().cast(f"array<{DETECTION}>").alias("detections"))
    out = gated.withColumn("__found", F.when(F.col("__text").isNotNull(), scanned).otherwise(empty))
    kept = [c for c in df.columns if c not in ("n_words", "base", "detections")]
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col("__n").alias("n_words"), F.col("__found.base").alias("base"), F.col("__found.detections").alias("detections"))


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    places = F.transform("base", lambda x: x["place"])
    labels = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        joined(labels("base")).alias("base_labels"), joined(F.concat(labels("base"), labels("detections"))).alias("labels"),
        (F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0)) / 100).alias("score"), F.size("detections").cast("long").alias("n_detections"),
    )


def _sql_rules() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quote(a)}, {b}, {c}, {quote(d)}, {quote(e)})" for i, (a, b, c, d, e) in enumerate(RULES))


OP1_SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
m AS (SELECT doc_id, words, len(words) AS n_words, coalesce(array_to_string(list_transform(words, lambda x, i: ' ' || x || '#' || (i - 1) || ';'), ''), '') AS marked FROM w),
rules(rule, label, priority, confidence, keyword, regex) AS (VALUES {_sql_rules()}),
hit AS (SELECT doc_id, rule, label, priority, confidence, unnest(regexp_extract_all(marked, regex)) AS h FROM m JOIN rules ON list_contains(words, keyword)),
place AS (SELECT doc_id, rule, label, priority, confidence, CAST(regexp_extract(h, '#(\d+);', 1) AS INT) AS a, CAST(regexp_extract(h, '#(\d+);$', 1) AS INT) AS b FROM hit),
kept AS (SELECT * FROM place d WHERE NOT EXISTS (SELECT 1 FROM place e WHERE e.doc_id = d.doc_id AND e.a <= d.a AND e.b >= d.b AND e.priority >= d.priority
  AND (e.a < d.a OR e.b > d.b OR e.priority > d.priority OR e.rule < d.rule))),
base AS (SELECT doc_id, 'cc-by' AS label, unnest(regexp_extract_all(marked, ' cc#\d+; by#\d+;')) AS h FROM m
  UNION ALL SELECT doc_id, 'gpl', unnest(regexp_extract_all(marked, ' general#\d+; public#\d+; license#\d+;')) FROM m
  UNION ALL SELECT doc_id, 'reserved', unnest(regexp_extract_all(marked, ' all#\d+; rights#\d+; reserved#\d+;')) FROM m),
bases AS (SELECT doc_id, count(*) AS n_base, min(CAST(regexp_extract(h, '#(\d+);', 1) AS BIGINT)) AS first_word, max(CAST(regexp_extract(h, '#(\d+);', 1) AS BIGINT)) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
alls AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM kept) GROUP BY doc_id),
scores AS (SELECT doc_id, max(confidence) / 100 AS score, count(*) AS n_detections FROM kept GROUP BY doc_id)
SELECT m.doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score, coalesce(n_detections, 0) AS n_detections
FROM m LEFT JOIN bases USING (doc_id) LEFT JOIN alls USING (doc_id) LEFT JOIN scores USING (doc_id)
"""
