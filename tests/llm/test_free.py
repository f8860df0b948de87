"""Languages, WARC, suffixes, BPE, the Jaccard join and mixing against brute force, and their edge cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weir import scratch
from weir.llm import bpe, components, jaccard_join, language_id, mixing, suffix_dedup, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = language_id.op2_language(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.95


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, t, lang) for i in range(0, 40, 2) for t, lang in (("the cat and the dog sat there", "en"), ("der hund und die katze sitzen dort", "de"))] + [(100, None, "en"), (101, "123 !?", None), (102, "", "de")], "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert model[0] == ["de", "en"]
    texts = [None, "", "12 34!", "the dog and the cat", "und der hund", "the cat and the dog sat there " * 50 + "der hund und die katze sitzen dort " * 20, "x" * 3_000_000]
    got = [r for r in language_id.language_id(frame(spark, texts).withColumn("score", F.lit("clash")), model).orderBy("doc_id").collect()]
    assert [r.lang_pred for r in got[:6]] == ["und", "und", "und", "en", "de", "en"] and got[0].score == 0.0
    assert got[5].languages.startswith("en:0.") and ",de:0." in got[5].languages and 0.5 < got[5].score < 0.9
    nothing = language_id.learn(docs.limit(0))
    assert nothing[0] == [] and language_id.language_id(frame(spark, ["abc"]), nothing).head().lang_pred == "und"
    assert language_id.language_id(docs.limit(0), model).count() == 0


def test_mixture_proportions():
    rnd = np.random.default_rng(1)
    p = rnd.dirichlet(np.full(300, 0.3), 3).T
    n = rnd.multinomial(200_000, p @ [0.6, 0.3, 0.1]).astype(float)
    share, _, converged = language_id.mixture(p, n, 200)
    assert np.abs(share - [0.6, 0.3, 0.1]).max() < 0.02 and converged
    assert not language_id.mixture(p, n, 2)[2]


def test_language_selection_by_brute_force():
    """The chosen set against all nested sets, fitted one by one to the end by plain loops."""
    rnd = random.Random(11)
    letters = {"aa": "abcde", "bb": "efghi", "cc": "aeimno", "dd": "opqrst"}
    say = lambda name, k: " ".join("".join(rnd.choices(letters[name], k=5)) for _ in range(k))
    names = sorted(letters)
    p = np.full((1 << language_id.BITS, 4), 0.5)
    for k, name in enumerate(names):
        p[:, k] += language_id.trigram_counts(say(name, 4000))[0]
    p /= p.sum(0)

    def em(columns, counts):
        share = [1 / len(columns)] * len(columns)
        for _ in range(3000):
            new = [0.0] * len(columns)
            for b, c in counts.items():
                parts = [s * p[b, k] for s, k in zip(share, columns)]
                for j, x in enumerate(parts):
                    new[j] += c * x / sum(parts)
            new = [x / sum(counts.values()) for x in new]
            close = max(abs(a - b) for a, b in zip(share, new)) < language_id.CLOSE
            share = new
            if close:
                break
        return share, sum(c * np.log(sum(s * p[b, k] for s, k in zip(share, columns))) for b, c in counts.items())

    for plan in ({"aa": 40}, {"aa": 60, "bb": 30}, {"cc": 30, "dd": 25, "aa": 40}, {"dd": 3}, {"aa": 50, "bb": 1}):
        text = " ".join(say(name, k) for name, k in plan.items())
        counts = {int(b): int(c) for b, c in enumerate(language_id.trigram_counts(text)[0]) if c}
        share, _ = em(list(range(4)), counts)
        order = sorted(range(4), key=lambda k: -share[k])
        fits = [(em(order[:size], counts), order[:size]) for size in range(1, 5)]
        (own, _), chosen = max(fits, key=lambda f: f[0][1] - 0.5 * (len(f[1]) - 1) * np.log(sum(counts.values())))
        lang, score, languages, converged = language_id.detect(text, names, p)
        want = sorted(zip(own, (names[k] for k in chosen)), reverse=True)
        assert converged and lang == want[0][1] and abs(score - want[0][0]) < 1e-3
        assert [x.split(":")[0] for x in languages.split(",")] == [x for _, x in want]


def test_language_repeats_and_ties(spark):
    docs = spark.createDataFrame([(i, t, lang) for i in range(0, 12) for t, lang in (("the cat", "en"), ("the cat", "ab"))], "doc_id long, text string, lang string")
    got = language_id.language_id(docs.where("doc_id < 3"), language_id.learn(docs, rows=10**12)).collect()
    assert len(got) == 6 and {r.lang_pred for r in got} == {"ab"}  # equal languages: the first in the alphabet


def test_language_learns_from_one_reading(spark):
    """Shuffle files go with their query, and none is read after that: the documents are read to be counted and to be learned from, and not again."""
    said = [(i, t, lang) for i in range(0, 40) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "de"), ("le chat", None))]
    docs, read = spark.createDataFrame(said, "doc_id long, text string, lang string"), spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    before = spark.conf.get(scratch.FILE_CLEANUP)
    spark.conf.set(scratch.FILE_CLEANUP, "true")
    try:
        languages, p = language_id.learn(docs.mapInArrow(seen, docs.schema))
    finally:
        spark.conf.set(scratch.FILE_CLEANUP, before)
    assert read.value == 2 * len(said)
    want = np.full((1 << language_id.BITS, 2), language_id.SMOOTHING)
    for i, text, lang in said:
        if text and lang and zlib.crc32(str(i).encode()) % 4 != 2:
            want[:, ["de", "en"].index(lang)] += language_id.trigram_counts(text)[0]
    assert languages == ["de", "en"] and np.array_equal(p, (want / want.sum(0)).astype(np.float32))


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "é☃" * 1000, "<p>a</p>", "b"]
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(html)] + [(7, "http://h/7", "b"), (None, None, "b")]
    path = str(tmp_path / "archive")
    warc.write_archives(warc.resolve_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")), path, records_a_file=3)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    of = defaultdict(list)
    for r in got:
        of[r.record_id].append(r)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    for i, h in enumerate(html):
        for r in of[str(i)]:
            assert (r.payload_digest, r.payload_bytes) == (digest(h), len((h or "").encode()))
            assert (r.record_type, r.refers_to) == {0: ("revisit", "6"), 1: ("revisit", "6"), 2: ("revisit", "3")}.get(i, ("response", None))
            assert r.record_type == "revisit" or bytes(r.payload) == (h or "").encode()
    assert len(of["7"]) == 2 and (of[""][0].record_type, of[""][0].refers_to) == ("revisit", "7")
    empty = str(tmp_path / "none")
    warc.write_archives(warc.resolve_revisits(spark.createDataFrame([], "page_id long, url string, html string")), empty)
    assert warc.read_archives(spark, empty).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"HTTP/1.1 200 OK\r\n\r\n"))


def test_suffix(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("ab é") for _ in range(rnd.randrange(1, 9)))
    shared = [" ".join(word() for _ in range(40)) for _ in range(4)]
    texts = [" ".join([word() for _ in range(rnd.randrange(30))] + rnd.sample(shared, rnd.randrange(3)) + [word() for _ in range(rnd.randrange(30))]) for _ in range(60)]
    texts += [None, "", "a" * 300, "a" * 60, "a" * 49, texts[0], "z" * 50, shared[0][:120], "a" * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (6, shared[1]), (None, shared[0])]
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49 if i is not None else 0):
            least[b[p : p + 50]] = min(i, least.get(b[p : p + 50], i))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if i is not None else 0):
            if least[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(b, gone) if not g)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = [(r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(r[2] for r in want) > 1000
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0


def test_suffix_slices(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    text = bytes(random.Random(2).choices(b"abc", k=700))
    monkeypatch.undo()
    whole = [(0, text)]
    pieces = {}
    for size in (64, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "PIECE", size)
        found = {}
        for data, spots in suffix_dedup.packed(whole):
            for spot, place, n, token in zip(*suffix_dedup.runs(data, spots)):
                start = place - spots[spot][2] + spots[spot][1]
                found |= {int(start + k): int(token) for k in range(n)}
        pieces[size] = found
    assert pieces[64] == pieces[1 << 20] and len(pieces[64]) == 651


def test_multikey_order():
    rnd = np.random.default_rng(0)
    columns = [rnd.integers(0, 3, 500).astype(np.uint64) for _ in range(4)]
    order, new = suffix_dedup.multikey_order([c.copy() for c in columns])
    rows = list(zip(*(c.tolist() for c in columns)))
    got = [rows[i] for i in order]
    assert got == sorted(rows) and [i for i in range(500) if new[i]] == [i for i in range(500) if i == 0 or got[i] != got[i - 1]]


def test_bpe(spark):
    own = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    texts = [None, "", "<|endoftext|> it's", "a  b \n\n c\t\x1c!\x85 x", "naïve 🙂 " * 30_000, "q" * 200_000, " " * 150_000 + "x", "word's " * 20_000 + "\x1c!" * 40_000]
    got = bpe.bpe_round_trip(frame(spark, texts).withColumn("ids", F.lit("clash")), RANKS, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        want = own.encode_ordinary(t or "")
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and bytes(r.decoded) == (t or "").encode()
    rnd = random.Random(4)
    for _ in range(300):
        t = "".join(rnd.choice("ab1 \n\t'.,sé \x1c") for _ in range(rnd.randrange(200)))
        assert bpe.encode_text(t, RANKS, public_tokenizers.PATTERN, size=5) == bpe.encode_text(t, RANKS, public_tokenizers.PATTERN)
    assert bpe.bpe_encode(frame(spark, ["x"]).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    both = bpe.bpe_decode(bpe.bpe_encode(frame(spark, ["a b"]), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).head()
    assert bytes(both.decoded) == b"a b"


def components_of(rows, n, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]) or rows[i][0] == rows[j][0]:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(rows[i][0], least.get(root(i), rows[i][0]))
    return [(rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows))]


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_jaccard(spark, n, percent):
    rnd = random.Random(7)
    texts = [None, "", "one", "ONE", "one two", "İ K one"]
    for size in (6, 9, 12, 14, 18, 21, 22, 30, 41, 60, 120, 300):
        base = [f"w{rnd.randrange(10_000)}" for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            words = list(base)
            for _ in range(edits):
                at = rnd.randrange(len(words))
                words[at : at + 1] = rnd.choice([[], ["new%d" % rnd.randrange(99)], [words[at], "more"]])
                words = words or ["x"]
            texts.append(" ".join(words[rnd.randrange(2) * (edits > 2) :]))
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = [(r.id, r.size, r.component) for r in jaccard_join.jaccard_components(frame(spark, texts).withColumn("keys", F.lit(0)), n=n, percent=percent).collect()]
    want = components_of(rows, n, percent)
    assert sorted(got) == sorted(want) and len({c for _, _, c in want}) < len(want) - 20


def test_jaccard_in_blocks(spark, monkeypatch):
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join(f"v{rnd.randrange(999)}" if rnd.random() < 0.02 else w for w in base) for _ in range(60)]
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 7)
    monkeypatch.setattr(jaccard_join, "SCREEN_DOCS", 11)
    monkeypatch.setattr(jaccard_join, "KEY_ROWS", 5)
    monkeypatch.setattr(jaccard_join, "BUCKET_KEYS", 200)
    texts += rnd.choices(texts, k=40)
    rnd.shuffle(texts)
    got = [(r.id, r.size, r.component) for r in jaccard_join.jaccard_components(frame(spark, texts)).collect()]
    assert sorted(got) == sorted(components_of(list(enumerate(texts)), 3, 90))
    assert jaccard_join.jaccard_components(frame(spark, ["x"]).limit(0)).count() == 0


def test_scheme_bounds():
    for percent in (80, 90):
        scheme = jaccard_join.Scheme(percent)
        assert 9 <= scheme.light < 64
        for a in range(1, 120):
            for b in range(a, 150):
                # the most tokens in which linked sets of these sizes differ
                shared = -(-percent * (a + b) // (100 + percent))
                if shared <= a:
                    assert a + b - 2 * shared <= scheme.spread(b) and b - shared <= scheme.deletions(b)
                    assert scheme.class_of(b) - scheme.class_of(a) in (0, 1)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 540)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: root(i) for i in up if root(i) != i}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_mixing_totals(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = mixing.mix(docs, labels).toPandas()
    n, p = rows.n_tokens.to_numpy(float), rows[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    have = n @ p
    goal = np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS]) * n.sum()
    r = np.ones(len(n))
    for _ in range(500):  # the same steps by brute force
        r = np.maximum(0, r - p @ ((r * n @ p - goal) / have))
    assert np.abs(r * n @ p - goal).max() < 1e-3 * goal.sum() and np.abs(rows.rate - r).max() < 1e-2
    assert (rows.rate >= 0).all() and np.abs(p.sum(1) - 1).max() < 1e-9


def test_mixing_edges(spark):
    docs = frame(spark, ["good words here", None, "", "idiot moron", "words"])
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 1), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in mixing.mix(docs, labels, {"good": 1.0, "poor": 0.0, "toxic": 0.0}, full="good").collect()}
    assert got[3].p_toxic > 0.9 and got[3].rate < 0.1 and got[0].rate > 0.8 and got[1].n_tokens == 0 and got[0].p_poor == 0.0
    unlabelled = mixing.mix(docs, labels.limit(0)).collect()
    assert all(r.p_good == 1.0 for r in unlabelled)
    assert mixing.mix(docs.limit(0), labels).count() == 0


def test_pipeline_drops_all_labelled_toxic(spark):
    import corpus_pipeline as cp

    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    left = cp.mix_sources(spark, docs, folder).select("doc_id").join(labels, "doc_id").collect()
    assert not any(r.toxic for r in left) and docs.join(labels.where("toxic = 1"), "doc_id").count() > 5
    clean = docs.join(labels.where("toxic = 0 AND quality = 1"), "doc_id").count()
    assert sum(r.quality == 1 for r in left) > 0.95 * clean


def test_pipeline(spark):
    import corpus_pipeline as cp

    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(9001, "12 !", None, "src1", 4), (9002, None, "en", "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    names = docs.columns
    kept = cp.detect_language(spark, docs, SF)
    assert kept.columns == names and kept.count() == docs.count() - 2
    lines = cp.drop_boilerplate(spark, kept, SF)
    assert lines.columns == names and lines.count() == kept.count() and lines.where("n_chars <> char_length(text)").count() == 0
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    single = cp.drop_near_copies(spark, lines, SF)
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in components_of(rows, 5, 80)})
    mixed = cp.mix_sources(spark, single, SF)
    left = {r.doc_id for r in mixed.collect()}
    known = [r.doc_id for r in single.collect() if r.doc_id in labels]
    clean = [i for i in known if labels[i].quality == 1 and labels[i].toxic == 0]
    assert sum(i in left for i in clean) / len(clean) > 0.95 and not any(labels[i].toxic and labels[i].quality and i in left for i in known)
    out = cp.encode(spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixed.collect())


def test_suffix_hot_token(spark, monkeypatch):
    """One 16-gram in very many contexts: its strings are split by later bytes, and no bucket holds much more than its share."""
    rnd = random.Random(3)
    gram = b"the hot sixteen "
    texts = [bytes(rnd.choices(b"abcdefgh ", k=34)) + gram + bytes(rnd.choices(b"abcdefgh ", k=34)) for _ in range(20_000)]
    data = b"".join(texts)
    chunk = suffix_dedup.Chunk(list(range(len(texts))), [len(t) for t in texts], suffix_dedup.zstandard.compress(data))
    several = np.bincount(chunk.which) > 1
    chunk.segments(several)
    hot = [(t, x[o : o + 50]) for t, x in zip(chunk.leads.tolist(), chunk.texts) for o in range(len(x) - 49)]
    assert max(Counter(t for t, _ in hot).values()) > 10_000
    splitters = suffix_dedup.Splitters.of(rnd.sample(hot, 640), 20)
    assert len(splitters.hot)
    chunk = suffix_dedup.Chunk(list(range(len(texts))), [len(t) for t in texts], suffix_dedup.zstandard.compress(data))
    chunk.segments(several, splitters)
    strings = Counter()
    for k, x in zip(chunk.bucket.tolist(), chunk.texts):
        strings[k] += len(x) - 49
    assert sum(strings.values()) == len(hot) and max(strings.values()) < 2.5 * len(hot) / 20
    # through the operator, with buckets so small that tokens are split
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", 2_000)
    monkeypatch.setattr(suffix_dedup, "TOKEN_BYTES", 10_000)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 5_000)
    few = [t.decode() for t in texts[:300]] + [t[:60].decode() + "zzz" for t in texts[:40]] + [texts[0].decode()]
    got = {r.id: r.n_removed for r in suffix_dedup.suffix_dedup(frame(spark, few)).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[300 + i] == 60 for i in range(40)) and got[340] == 84


def test_pipeline_edges(spark, tmp_path):
    """Every stage on clashing columns, nulls in every column, repeated rows and the empty table."""
    import corpus_pipeline as cp

    base = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, "some words without an id", "en", None, 5), (7001, None, None, "src1", None), (7002, "", "en", "src1", 0)], base.schema)
    docs = base.unionByName(base.limit(5)).unionByName(nulls)
    clash = ["score", "lang_pred", "languages", "n_lines", "n_dropped", "n_tokens", "rate", "p_good", "id", "component", "keys", "__p"]
    for c in clash:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in clash), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert cp.encode(spark, docs, SF).count() == docs.count() and cp.encode(spark, docs.limit(0), SF).count() == 0


def test_mixing_keeps_fitted_totals(spark):
    import corpus_pipeline as cp

    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    members = mixing.memberships(docs, labels)
    rows, got = mixing.fit_rates(members, cp.WEIGHTS, full="good")
    sums = rows.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")) for d in mixing.DOMAINS]).head()
    assert all(abs(a - got[d]) < 1e-6 * sum(got.values()) for a, d in zip(sums, mixing.DOMAINS))
    share = {d: x / sum(got.values()) for d, x in got.items()}
    assert all(abs(share[d] - cp.WEIGHTS[d]) < 0.01 for d in mixing.DOMAINS)
    assert rows.where("p_good > 0.5 AND rate <> 1").count() == 0
    left = cp.mix_sources(spark, docs, folder).select("doc_id").distinct().join(rows, "doc_id")
    kept = left.agg(*[F.sum(F.col("n_tokens") * F.col(f"p_{d}")) for d in mixing.DOMAINS]).head()
    assert all(abs(a - got[d]) < 0.03 * sum(got.values()) for a, d in zip(kept, mixing.DOMAINS))


def test_mixing_posteriors_by_brute_force(spark):
    """Posteriors against a plain naive Bayes with decisive words, in Python."""
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    rows, marks = [], []
    for i in range(260):
        toxic, poor = i % 5 == 0, i % 5 == 1
        text = rnd.choices(words[:200] if not poor else words[150:], k=10) + (["vile"] if toxic and i % 2 else rnd.choices(words[280:], k=8) if toxic or i % 11 == 2 else [])
        rows.append((i, " ".join(text)))
        marks.append((i, 0 if poor else 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.p_good, r.p_poor, r.p_toxic) for r in mixing.memberships(docs, labels).collect()}
    bucket = {r.w: (r.h, r.b) for r in spark.createDataFrame([(w,) for w in [*words, "vile"]], "w string").select("w", F.xxhash64("w").alias("h"), mixing._bucket(F.xxhash64("w")).alias("b")).collect()}
    domain = [2 if t else 1 if not q else 0 for _, q, t in marks]
    counts, n = [[0.1] * mixing.BUCKETS for _ in range(3)], Counter(domain)
    for (_, text), d in zip(rows, domain):
        for w in text.split():
            counts[d][bucket[w][1]] += 1
    logs = [[np.log(n[d] / 260) + sum(np.log(counts[d][bucket[w][1]] / sum(counts[d])) for w in text.split()) for d in range(3)] for _, text in rows]
    plain = [np.exp(np.array(x) - max(x)) / np.exp(np.array(x) - max(x)).sum() for x in logs]
    vile = sum("vile" in t for _, t in rows)
    sure = mixing.lower_bound(vile, vile)
    assert sure > mixing.DECISIVE
    taken = [(p[2] > 0.5, d == 2) for p, (_, t), d in zip(plain, rows, domain) if "vile" not in t]
    trust = sum(d for t, d in taken if t) / sum(t for t, _ in taken) if any(t for t, _ in taken) else 1.0
    for (i, text), p, x in zip(rows, plain, logs):
        doubt = 1 - sure if "vile" in text else 1.0
        bad = 1 - doubt * (1 - p[2] * trust)
        rest = np.exp(np.array(x[:2]) - max(x[:2]))
        want = [*(rest / rest.sum() * (1 - bad)), bad]
        assert max(abs(a - b) for a, b in zip(got[i], want)) < 3 / mixing.GRAIN, (i, got[i], want)
    assert all(got[i][2] > 0.75 for i, t in rows if "vile" in t)


def test_mixing_clashing_columns_and_repeats(spark):
    docs = frame(spark, ["good words here", "idiot moron", "words"]).withColumn("n_tokens", F.lit("x")).withColumn("rate", F.lit(9)).withColumn("p_good", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs.unionByName(docs), labels, keep=docs.columns).collect()
    assert len(got) == 6 and {r.n_tokens for r in got} == {3, 2, 1} and all(0 <= r.p_good <= 1 and r.rate >= 0 for r in got)
    assert len({(r.doc_id, r.rate) for r in got}) == 3


def test_jaccard_repeated_ids(spark):
    """An id with several texts links whatever any of them links, and no link is lost."""
    rnd = random.Random(12)
    a, b, c = ([f"{x}{rnd.randrange(9999)}" for _ in range(60)] for x in "abc")
    near = lambda w: " ".join([*w[:-1], "changed"])
    rows = [(3, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (7, near(b)), (8, " ".join(c)), (8, near(b[:-1] + ["x"])), (9, near(c)), (9, near(c)), (11, "alone"), (11, "alone"), (None, " ".join(a)), (20, " ".join(b)), (21, "one more"), (21, None)]
    got = [(r.id, r.size, r.component) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=80).collect()]
    known = [x for x in rows if x[0] is not None]
    want = components_of(known, 3, 80)
    assert sorted((x for x in got if x[0] is not None)) == sorted(want)
    assert {i: c for i, _, c in want}[9] == 3 and [x[2] for x in got if x[0] is None] == [None]


def test_jaccard_pivots(spark, monkeypatch):
    """Large groups of near copies, connected by pivots, with others hanging on: as brute force has it."""
    rnd = random.Random(21)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for k in range(150):
        words = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 9])):
            words[rnd.randrange(90)] = f"v{rnd.randrange(5000)}"
        texts.append(" ".join(words))
    other = [f"o{k}" for k in range(90)]
    texts += [" ".join(base[:45] + other[:45 - k] + base[:k]) for k in range(12)] + ["short one", "short one", ""]
    rnd.shuffle(texts)
    for name, size in (("BLOCK_DOCS", 16), ("SCREEN_DOCS", 24), ("PIVOTS", 4)):
        monkeypatch.setattr(jaccard_join, name, size)
    met = []
    plain = jaccard_join._meet_pivots
    monkeypatch.setattr(jaccard_join, "_meet_pivots", lambda *a: met.append(a) or plain(*a))
    got = [(r.id, r.size, r.component) for r in jaccard_join.jaccard_components(frame(spark, texts), n=3, percent=80).collect()]
    assert sorted(got) == sorted(components_of(list(enumerate(texts)), 3, 80)) and met


def test_jaccard_shared_passages_hang_nothing_together(spark, monkeypatch):
    """Documents that share passages, but too little to link, aren't compared with each other; near copies among them are found."""
    rnd = random.Random(31)
    passages = [" ".join(f"p{rnd.randrange(10**6)}" for _ in range(12)) for _ in range(60)]
    texts = [" ".join([*rnd.sample(passages, 3), *(f"own{rnd.randrange(10**9)}" for _ in range(60))]) for _ in range(400)]
    texts += [t + " end" for t in texts[:20]] + texts[20:30]
    hanging, plain = [], jaccard_join._hanging
    monkeypatch.setattr(jaccard_join, "_hanging", lambda ties: hanging.append(plain(ties)) or hanging[-1])
    got = [(r.id, r.size, r.component) for r in jaccard_join.jaccard_components(frame(spark, texts), n=5, percent=80).collect()]
    want = components_of(list(enumerate(texts)), 5, 80)
    assert sorted(got) == sorted(want) and sum(i != c for i, _, c in want) == 30
    assert max(r["count"] for r in hanging[0].groupBy("component").count().collect()) < 10


def test_jaccard_blocks_are_linear():
    """The number of blocks that keys go in, over three sizes, stays in proportion to the keys."""
    import math

    blocks = []
    for keys in (1 << 26, 1 << 30, 1 << 34):
        growth = math.sqrt(keys / jaccard_join.GROW_KEYS)
        blocks.append((keys / 30 / (jaccard_join.KEY_ROWS * growth)) * (keys / (jaccard_join.BUCKET_KEYS * growth)) / keys)
    assert max(blocks) < 1.01 * min(blocks)


def test_warc_files_are_bounded(spark, tmp_path):
    """Files hold about as many bytes as asked for, but for the payloads that are longer."""
    rnd = random.Random(2)
    html = ["".join(rnd.choices("abcdef", k=200)) * rnd.randrange(50, 500) for _ in range(300)] + ["z" * 5_000_000, "y" * 5_000_000] + ["same " * 1000] * 150
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = str(tmp_path / "archive")
    warc.write_archives(warc.resolve_revisits(pages, file_bytes=1 << 20), path)
    sizes = sorted(f.stat().st_size for f in (tmp_path / "archive").glob("part-*"))
    assert len(sizes) > 15 and sizes[-3] < 3 << 20 and sizes[-1] < 8 << 20
    got = warc.read_archives(spark, path).collect()
    assert Counter(r.record_type for r in got) == {"response": 303, "revisit": 149} and {r.refers_to for r in got} == {None, "451"}
    assert {r.record_id: r.payload_bytes for r in got} == {str(i): len(h) for i, h in enumerate(html)}


def test_long_texts(spark):
    """Texts of ten million characters, alike but for an end."""
    long = "".join(random.Random(1).choices("abcdefgh \n", k=1000)) * 10_000
    rows = [(1, long), (2, long + " and an end of its own that is longer than fifty bytes by far"), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == len(long) and got[3].n_removed == 0
    parts = {r.id: r.component for r in jaccard_join.jaccard_components(docs, n=3, percent=90).collect()}
    assert parts == {1: 1, 2: 1, 3: 3} or parts[2] == 2  # few distinct shingles: either, as brute force says
    assert parts[2] == {i: c for i, _, c in components_of(rows, 3, 90)}[2]
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert mixing.mix(docs, labels).where("doc_id = 1").head().n_tokens == len(WORD.findall(long))
