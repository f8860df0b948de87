"""License scan, fingerprints, quality rules and line deduplication against brute force, and their edge cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from weir.llm import fingerprint, license_scan, line_dedup, quality
from weir.llm.license_rules import RULES
from weir.llm.queries import ORACLE_SQL

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSED = [
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "CC-BY 4.0 text. All rights reserved. cc by cc by", "GNU General Public License version 3 or later", None, "", "!!!", "general\npublic\tLICENSE", "the K-license and İ", "All rights reserved",
]


def frame(spark, texts, extra=""):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", *([extra] if extra else []))


def oracle(name, **tables):
    con = duckdb.connect()
    for k, v in tables.items():
        con.register(k, v)
    return con.execute(ORACLE_SQL[name]).fetchall()


def same(df, rows):
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, rows))


def run(spark, monkeypatch, module, query, **tables):
    monkeypatch.setattr(module, "table", lambda s, d, name: tables[name])
    return query(spark, "")


def test_rules_are_many_and_distinct():
    assert len(RULES) >= 200 and len(set(RULES)) == len(RULES)
    for _, _, _, keyword, pattern in RULES:
        assert re.compile(pattern) and re.fullmatch(r"[a-z0-9]+", keyword)


def test_license(spark, monkeypatch):
    docs = frame(spark, [*LICENSED, LICENSED[0]])
    got = run(spark, monkeypatch, license_scan, license_scan.op1_license, documents=docs)
    same(got, oracle("op1_license", documents=docs.toPandas()))
    found = {r.doc_id: r for r in got.collect()}
    assert found[0].labels.startswith("apache") and "apache-2.0" in found[0].labels and found[0].n_base == 0
    assert (found[1].n_base, found[1].base_labels, found[1].first_word, found[1].last_word) == (4, "cc-by,reserved", 0, 10)
    assert (found[3].n_words, found[3].labels, found[3].score, found[3].first_word) == (0, "", 0.0, None)
    assert "gpl" in found[2].base_labels and "gpl-3" in found[2].labels and found[7].n_base == 0


def test_license_edges(spark):
    docs = frame(spark, ["all rights reserved. " * 5000 + "word " * 50_000, None], "1 AS base").withColumn("detections", F.lit("x"))
    got = license_scan.license_scan(docs).collect()
    assert [r.n_words for r in got] == [65_000, 0] and len(got[0].base) == 5000 and len(got[0].detections) == 5000
    assert license_scan.license_scan(docs.limit(0)).count() == 0


def shingles(text):
    w = WORD.findall(text or "")

    def h(words):
        s = 42
        for x in words:
            s = xxhash.xxh64_intdigest(x.encode(), seed=s)
        return s - (1 << 64) if s >> 63 else s

    return {h(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {h([" ".join(w)])} if w else set()


def test_fingerprint(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs.sort(reverse=True)
    hexed = lambda s: "".join(f"{v % (1 << 64):016X}" for v in sorted(s)[:128])
    got = {r.doc_id: r for r in fingerprint.op3_fingerprint(spark, SF).collect()}
    assert len(got) == len(docs)
    for k, (i, x) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        third = len(x) // 3
        changed = x[: len(x) - third] + following[:third]
        a, b = shingles(x), shingles(changed)
        assert (got[i].n_chars, got[i].edited_sha256) == (len(x), hashlib.sha256(changed.encode()).hexdigest())
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (hexed(a), hexed(b))
        assert abs(got[i].near_edited - len(a & b) / len(a | b)) < 0.2
        assert abs(got[i].n_distinct - len(a)) <= max(0.5, 0.4 * len(a))


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_next_row(spark, ranges):
    docs = spark.createDataFrame([(i * 3 % 101, f"t{i}") for i in range(101)] + [(5, "zz"), (None, "nn"), (None, "mm")], "doc_id long, text string")
    order = sorted(map(tuple, docs.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = {x: order[(k + 1) % len(order)][1] for k, x in enumerate(order)}
    got = fingerprint.with_next(docs, "doc_id", ["text"], ranges).collect()
    assert {(r.doc_id, r.text): r["__next"].text for r in got} == want and len(got) == len(order)


def test_sketches(spark):
    df = frame(spark, ["a b c d e f g", "a b c d e f h", "", None, "x " * 3000])
    s = df.select("doc_id", fingerprint.sketch(F.col("text")).alias("s"))
    a, b, c, d, e = [r.s for r in s.orderBy("doc_id").collect()]
    assert (len(a), c, d, len(e)) == (3, [], [], 1)
    row = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(fingerprint.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprint.containment(F.col("a"), F.col("b")).alias("c"), fingerprint.merge(F.col("a"), F.col("b")).alias("m")).head()
    assert (row.r, round(row.c, 9), row.m) == (0.5, round(2 / 3, 9), sorted(set(a) | set(b)))
    whole = fingerprint.merged(s.withColumn("g", F.lit(1)), ["g"], "s").head().sketch
    assert whole == sorted(set(a) | set(b) | set(e))
    empty = df.limit(0)
    assert fingerprint.with_next(empty, "doc_id", ["text"], 1).count() == 0


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, cover = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_quality(spark):
    texts = ["a b c a b c", None, "", "  \n\n ", "x\nx\ny\n \n \nx", "#*$ %&|<>", "w " * 2000, "p q r s " * 300 + "\n" + "p q r s", "é ü x \x0b\x1cy"]
    docs = frame(spark, texts, "1 AS score")
    bucket = lambda *x: _bucket(x)
    labels = spark.createDataFrame([(0, 1, 0), (7, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    ratios = quality.log_ratios(docs, labels)
    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        grams = [bucket(x) for x in w] + [bucket(x, y) for x, y in zip(w, w[1:])]
        raw.update(grams)
        if i in (0, 7):
            target.update(grams)
    n = quality.BUCKETS
    want = [math.log((target[b] + 1) / (target.total() + n)) - math.log((raw[b] + 1) / (raw.total() + n)) for b in range(n)]
    assert max(abs(a - b) for a, b in zip(ratios, want)) < 1e-12
    for r in quality.quality_rules(docs, ratios).collect():
        text = texts[r.doc_id]
        counts = base_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        w = WORD.findall(text or "")
        score = sum([ratios[bucket(x)] for x in w] + [ratios[bucket(x, y)] for x, y in zip(w, w[1:])]) / (2 * len(w) - 1) if w else 0.0
        assert abs(r.score - score) < 1e-9 and (r.base_failed, r.kept) == (failed, not failed and score >= quality.THRESHOLD)
    assert quality.quality_rules(docs.limit(0), ratios).count() == 0
    assert quality.log_ratios(docs, labels.limit(0)) == [0.0] * n


def _bucket(words):
    s = 42
    for x in words:
        s = xxhash.xxh64_intdigest(x.encode(), seed=s)
    return (s - (1 << 64) if s >> 63 else s) % quality.BUCKETS


def test_quality_separates_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.op5_quality(spark, SF).join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    assert {r.quality: r.kept for r in got}[1] >= 0.95 and docs.count() > 0


def test_quality_drops_bad_and_keeps_good(spark):
    folder = "/root/testdata/sf0.01"
    got = quality.op5_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in got}
    assert share[1] >= 0.99 and share[0] <= 0.1


def test_license_names_in_one_word(spark):
    texts = ["released as GPLv2 only", "under LGPLv3.0 or later", "AGPLv3", "GPLv2+", "the GPL v2 or later", "gplv4"]
    got = [r.detections for r in license_scan.license_scan(frame(spark, texts)).orderBy("doc_id").collect()]
    assert [sorted({d.label for d in x}) for x in got] == [["gpl-2-only"], ["lgpl-3-or-later"], ["agpl-3"], ["gpl-2"], ["gpl-2-or-later"], []]


def test_line_dedup(spark):
    import random

    rnd = random.Random(3)
    pages = [(i, f"h{i % 3}" if i % 7 else None, "\n".join(rnd.choice(["menu", "foot", f"line {rnd.randrange(60)}", "", " "]) for _ in range(6)) if i % 11 else None) for i in range(140)]
    pages += [(3, "h0", "menu\nmenu"), (4, "tiny", "menu\nfoot")]
    counts, total = defaultdict(set), Counter()
    for k, (_, host, text) in enumerate(pages):
        total[host] += host is not None
        for x in (text or "").split("\n"):
            if x.strip() and host and text is not None:
                counts[host, x].add(k)

    def drop(host, x):
        return host is not None and x.strip() and total[host] >= 20 and len(counts[host, x]) / total[host] > 0.1

    want = [(i, None if t is None else "\n".join(x for x in t.split("\n") if not drop(h, x)), 0 if t is None else t.count("\n") + 1) for i, h, t in pages]
    df = spark.createDataFrame(pages, "page_id long, host string, text string").withColumn("n_lines", F.lit("clash"))
    got = line_dedup.line_dedup(df, "host", "text").collect()
    assert sorted(map(repr, ((r.page_id, r.text, r.n_lines) for r in got))) == sorted(map(repr, want))
    assert any(r.n_dropped for r in got)
    spared = {r.page_id: r.text for r in line_dedup.line_dedup(df.where("page_id = 3 OR page_id % 3 = 0"), "host", "text", spare_whole=True).collect()}
    assert spared[3] is not None
    assert line_dedup.line_dedup(df.limit(0), "host", "text").count() == 0


def test_line_dedup_small_hosts(spark):
    pages = [(i, "nineteen", f"menu\nown {i}\n{'pair' if i < 2 else ''}") for i in range(19)]
    pages += [(100 + i, "three", "menu\nfoot" if i else "menu\nonly") for i in range(3)] + [(200, "one", "menu\nmenu\nfoot"), (300, None, "menu"), (301, None, "menu")]
    df = spark.createDataFrame(pages, "page_id long, host string, text string")
    got = {r.page_id: (r.text, r.n_dropped) for r in line_dedup.line_dedup(df, "host", "text").collect()}
    assert [got[i] for i in range(19)] == [(f"own {i}", 2) if i < 2 else (f"own {i}\n", 1) for i in range(19)]
    assert [got[100 + i] for i in range(3)] == [("only", 1), ("", 2), ("", 2)]
    assert got[200] == ("menu\nmenu\nfoot", 0) and got[300] == got[301] == ("menu", 0)


def test_hosts(spark):
    urls = ["http://U@A.Example.com:80/x", "https://b.org", "//c.org/x", None, "nothing"]
    got = frame(spark, urls).select("doc_id", line_dedup.url_host(F.col("text")).alias("h")).orderBy("doc_id").collect()
    assert [r.h for r in got] == ["a.example.com", "b.org", None, None, None]


def test_next_row_without_ids(spark):
    """All ids null, one id for nearly all rows, equal rows: every row has a next one, in a circle."""
    for rows in ([(None, f"t{i}") for i in range(60)], [(7, f"t{i}") for i in range(50)] + [(3, "a"), (9, "b")], [(1, "same")] * 40 + [(2, "x")], [(4, "only")], [(5, None), (5, ""), (None, None)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        for ranges in (1, 6):
            got = fingerprint.with_next(docs, "doc_id", ["text"], ranges).collect()
            assert len(got) == len(rows) and all(r["__next"] is not None for r in got)
            assert Counter(r["__next"].text for r in got) == Counter(t for _, t in rows)


def test_fingerprint_null_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "g h i j k l m"), (None, None)], "doc_id long, text string").withColumn("print", F.lit("clash"))
    got = run(spark, monkeypatch, fingerprint, fingerprint.op3_fingerprint, documents=docs).collect()
    assert len(got) == 3 and all(r.edited_sha256 for r in got) and sorted(r.n_chars for r in got) == [0, 11, 13]
    assert run(spark, monkeypatch, fingerprint, fingerprint.op3_fingerprint, documents=docs.limit(0)).count() == 0


def test_long_texts(spark, monkeypatch):
    """A text of ten million characters goes through the native operators."""
    long = "one two three four " * 530_000
    docs = spark.createDataFrame([(1, long), (2, "short text")], "doc_id long, text string")
    got = {r.doc_id: r for r in run(spark, monkeypatch, fingerprint, fingerprint.op3_fingerprint, documents=docs).collect()}
    assert got[1].n_chars == len(long) and len(got[1].fingerprint) == 16 * 4
    judged = {r.doc_id: r for r in quality.quality_rules(docs, [0.0] * quality.BUCKETS).collect()}
    assert judged[1].n_words == 4 * 530_000 and judged[1].base_failed and judged[1].n_repeat_words == 4 * 530_000
    lines = line_dedup.line_dedup(spark.createDataFrame([(k, "h", ("menu\n" + long.replace(" three", "\n")) if k == 0 else f"menu\nown {k}") for k in range(3)], "page_id long, host string, text string"), "host", "text").orderBy("page_id").collect()
    assert lines[0].n_lines == 530_002 and lines[0].n_dropped == 1 and lines[1].text == "own 1"
