"""Site-relative line deduplication with DataFrame functions only.

A line is boilerplate of a host if the pages of the host that contain it are more than
``ratio`` of the host's pages, and at least ``copies``; every copy of it goes. That holds
for hosts of any size: a line of one page alone repeats nothing, even if it is the host's
only page. Lines without a visible character are neither counted nor dropped. Rows without
a host are left alone. A null text stays null. A row is a page, so rows that
repeat count each; lines with the same number of pages are all judged alike. Columns keep
their names; those added replace columns of that name. An empty table gives an empty
table. A very long text is split within its row, so it must fit a task; its lines are
counted one by one. Lines are equal if their 64-bit hashes are: of 10^10 lines of a host
one is dropped wrongly with a probability under 10^-5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, written

RATIO, COPIES = 0.1, 2
#: Ends of a page's text blocks, each of which counts as the end of a line.
BLOCK_END = r"(</(?:p|li|div|h[1-6]|nav|ul|ol|title|script|style|article|section|header|footer|table|tr)>|<br ?/?>)"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def url_host(url: Column) -> Column:
    """The lower-case host of an absolute URL, else null."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def html_lines(html: Column) -> Column:
    """The markup with a line feed after each text block."""
    return F.regexp_replace(html, BLOCK_END, "$1\n")


def _visible(line: Column) -> Column:
    return line.rlike(r"[^\s]")


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, copies: int = COPIES) -> DataFrame:
    """host, hashes: the 64-bit hashes of the host's boilerplate lines.

    A host's array has at most (mean lines a page) / ``ratio`` entries. Pages and lines
    are counted in one pass with partial sums before the shuffle; the entry of a page
    itself has a null hash.
    """
    lines = F.filter(F.split(F.col(text_col), "\n"), _visible)
    hashes = F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))
    entries = pages.where(F.col(host_col).isNotNull()).select(F.col(host_col).alias("host"), F.explode(F.concat(F.array(F.lit(None).cast("long")), F.coalesce(hashes, F.array().cast("array<long>")))).alias("hash"))
    counts = written(entries.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(f"hash IS NULL OR n >= {int(copies)}"), "line-counts")
    totals = counts.where("hash IS NULL").select("host", F.col("n").alias("pages"))
    common = counts.where("hash IS NOT NULL").join(totals, "host").where(F.col("n") / F.col("pages") > F.lit(float(ratio)))
    return common.groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def line_dedup(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, copies: int = COPIES, spare_whole: bool = False) -> DataFrame:
    """``pages`` with ``text_col`` without boilerplate lines, and n_lines and n_dropped.

    With ``spare_whole``, a page with no other visible lines keeps them: it is one of many
    copies rather than a page with a site's furniture.

    The table of hosts is written first: it is broadcast only if its known size is under
    Spark's threshold, and otherwise a shuffled join takes it, whose hot host Spark splits.
    """
    found = written(boilerplate(pages, host_col, text_col, ratio, copies), "boilerplate").select(F.col("host").alias("__host"), F.col("hashes").alias("__hashes"))
    joined = pages.join(found, F.col(host_col) == F.col("__host"), "left")
    lines = F.split(F.col(text_col), "\n")
    kept = let(F.coalesce("__hashes", F.array().cast("array<long>")), lambda known: F.filter(lines, lambda x: ~(F.array_contains(known, F.xxhash64(x)) & _visible(x))))
    if spare_whole:
        kept = let(kept, lambda x: F.when(F.exists(x, _visible), x).otherwise(lines))
    return (
        joined.withColumn("__kept", kept)
        .withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn("n_dropped", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines) - F.size("__kept")).cast("long"))
        .withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.array_join("__kept", "\n")))
        .drop("__host", "__hashes", "__kept")
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", url_host(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text"))
    return line_dedup(pages, "host", "text").select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def line_dedup_sql(rows: str, ratio: float = RATIO, copies: int = COPIES) -> str:
    """DuckDB CTEs up to ``deduped(id, host, text, n_lines, n_dropped)`` from a query of id, host and text."""
    return f"""
src AS ({rows}),
lines AS (SELECT id, host, s.i AS i, s.l AS l, regexp_matches(s.l, '[^\\s]') AS visible
  FROM (SELECT id, host, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'i': i, 'l': x}})) AS s FROM src WHERE text IS NOT NULL)),
totals AS (SELECT host, count(*) AS pages FROM src WHERE host IS NOT NULL GROUP BY host),
common AS (SELECT host, l FROM (SELECT host, l, count(DISTINCT id) AS n FROM lines WHERE visible AND host IS NOT NULL GROUP BY host, l) JOIN totals USING (host) WHERE n >= {copies} AND n / pages > {ratio}),
kept AS (SELECT a.id, count(*) AS n_lines, count(*) FILTER (c.l IS NOT NULL AND a.visible) AS n_dropped,
    coalesce(string_agg(a.l, chr(10) ORDER BY a.i) FILTER (c.l IS NULL OR NOT a.visible), '') AS text
  FROM lines a LEFT JOIN common c ON a.host = c.host AND a.l = c.l GROUP BY a.id),
deduped AS (SELECT s.id, s.host, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped FROM src s LEFT JOIN kept k ON s.id = k.id)"""


OP10_SQL = f"""
WITH {line_dedup_sql(f"SELECT page_id AS id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host, regexp_replace(html, '{BLOCK_END}', '\\1' || chr(10), 'g') AS text FROM pages")}
SELECT id AS page_id, host, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM deduped
"""
