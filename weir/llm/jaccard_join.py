"""Exact n-gram Jaccard self-join by a size-aware heavy-light scheme.

A document's set holds the 64-bit hashes of its distinct shingles of ``n`` words (with
fewer words the whole sequence is one; without words it is empty and linked with nothing).
Two documents link if |A and B| / |A or B| >= ``percent`` / 100.

1. Equal sets collapse to the least id among them.
2. Light sets, up to a size where these are few, enumerate their subsets of every fixed
   size that a link can require. Heavy sets enter the inverted lists of a prefix of their
   tokens in one order of all tokens: those that are rarest, one more than a linked set may
   lack, so that the prefixes of linked sets have a token in common. Tokens are counted for
   that, a share of them by their hash, over all documents; those not counted come last.
   What one document alone has makes no list. (Counts are of 32 bits of a hash within a
   bucket: tokens taken for the same one only seem more frequent.) Passages that many
   documents share are in no prefix but of documents of little else, so that what hangs
   together doesn't grow into most of the input, as it did by lists of parts of a set.
   Tokens and lists are dealt to buckets by ranges of their keys, as compressed blocks; a
   chunk of documents tells a bucket each key once, so that no list is long for being
   frequent. Chunks and buckets both grow with the square root of the input, so that the
   number of blocks stays in proportion to it.
3. Sets on one list are tied to the least of them, so there are at most as many ties as
   keys. Of what hangs together in more than a block, all documents are first compared
   with a few pivots, of which every block gets a copy, and then the rest with pivots of
   the largest cluster found, as long as that attaches many; documents of that cluster
   needn't be compared with each other. What hangs together is screened by parities of its
   tokens' hashes, which bound from below in how many tokens two sets differ; what still
   hangs together is compared by scanning the inverted lists of its own tokens. Both go in
   blocks where it is large. Every two sets that share a list meet in both, unless pivots
   have connected them, so no link is lost; pairs are never emitted, but only ties to the
   least document that a comparison reached.

Rows that repeat an id count as one document with several texts. A null id is linked with
nothing, and its component is null. A null text is an empty one. An empty table gives an
empty table. Of equal candidates for a component's name the least id wins. Very long texts
are worked on whole, a row at a time. Only the id and text columns are read, so other
columns can't clash.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import cuts, mix, pack, unpack
from .common import LOWER, SPACE_WORD, UPPER, plan_bytes, table, written
from .components import connected_components

_WORD = re.compile(SPACE_WORD)
_LOW = str.maketrans(UPPER, LOWER)
_U = np.uint64
#: Keys that a light set has at most.
LIGHT_KEYS = 128
#: Documents and shingles of a block; what hangs together and is larger is compared block by block.
BLOCK_DOCS, BLOCK_SHINGLES = 4096, 1 << 21
#: The same for screening; and documents of small groups that are worked on together.
SCREEN_DOCS, PACK_DOCS = 16384, 1024
#: Keys of a bucket, so few that a tie is seldom found in as many buckets as there are; documents, and counted tokens, whose keys become one block a bucket.
BUCKET_KEYS, KEY_ROWS, KEY_TOKENS = 1 << 17, 1024, 1 << 18
#: Counted tokens of a bucket; the share of all tokens that is counted, so large that also short sets have enough of them for a prefix.
BUCKET_TOKENS, COUNTED = 1 << 20, 0.5
#: Keys from which on buckets grow, and bytes of input from which on chunks do; pivots of a group, about; the share of the rest that a round must attach to be followed by another.
GROW_KEYS, UNIT, PIVOTS, ATTACHED = 1 << 26, 1 << 30, 32, 0.2


class Hasher:
    """Hashes of words, kept while they are few."""

    def __init__(self, most: int = 1 << 18):
        self.most, self.known = most, {}

    def words(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        known, get = self.known, self.known.get
        out = []
        for w in words:
            h = get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)

    def shingles(self, text: str | None, n: int) -> np.ndarray:
        """Ascending hashes of the distinct shingles."""
        words = self.words(_WORD.findall(text.translate(_LOW))) if text else np.zeros(0, np.uint64)
        if not len(words):
            return words
        n = min(n, len(words))
        total = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            total = mix(total + words[k : k + len(total)] + _U(0x9E3779B97F4A7C15 + k))
        return np.unique(total)


class Scheme:
    """Which keys a set of a size has, for a threshold in hundredths."""

    def __init__(self, percent: int):
        self.percent = percent
        self.light = max(s for s in range(1, 64) if self._light_keys(s) <= LIGHT_KEYS)
        self.limit = _U(min(2**64 - 1, int(COUNTED * 2**64)))  # tokens up to it are counted

    def spread(self, size: int) -> int:
        """The most tokens in which two linked sets of up to ``size`` differ."""
        return (100 - self.percent) * 2 * size // (100 + self.percent)

    @functools.cached_property
    def starts(self) -> list[int]:
        """The least size of each class; linked sets are of one class or of neighbouring ones."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, out[-1] * 100 // self.percent + 1))
        return out

    def class_of(self, size: int) -> int:
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def _light_keys(self, s: int) -> int:
        return sum(math.comb(s, j) for j in range(self.deletions(s) + 1))

    def deletions(self, s: int) -> int:
        """The most tokens of a set of size ``s`` that a linked set lacks."""
        return s * (100 - self.percent) // 100

    def parities(self, tokens: np.ndarray) -> bytes:
        """For each value of the low bits of a token's hash whether an odd number of tokens has it; linked sets differ in few."""
        bits = 512
        while bits < 4 * self.spread(len(tokens)):
            bits *= 2
        return np.packbits(np.bincount((mix(tokens ^ _U(0x589965CC75374CC3)) & _U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """Of a light set, its subsets that a linked light set can have in common with it."""
        s, found = len(tokens), [np.zeros(0, np.uint64)]
        if s <= self.light:
            spread_tokens = mix(tokens ^ _U(0xA0761D6478BD642F))
            total = spread_tokens.sum(dtype=np.uint64)
            for j in range(self.deletions(s) + 1):
                gone = np.array([sum(map(int, x)) & (1 << 64) - 1 for x in itertools.combinations(spread_tokens, j)], np.uint64)
                found.append(mix(total - gone + _U((s - j) * 0xE7037ED1A0B428DB & (1 << 64) - 1)))
        return np.concatenate(found)

    def prefix(self, s: int) -> int:
        """How many of the first tokens of a set of size ``s``, in one order of all tokens, a linked heavy set has one of."""
        return self.deletions(s) + 1 if s > self.light or s * 100 >= (self.light + 1) * self.percent else 0

    def stored(self, tokens: np.ndarray) -> np.ndarray:
        """Of ascending tokens those that may be in the prefix: all that are counted, and of others as many as it may need."""
        most = self.prefix(len(tokens))
        return tokens[: max(most, int(np.searchsorted(tokens, self.limit, "right"))) if most else 0]


def described(docs: DataFrame, id_col: str, text_col: str, n: int, scheme: Scheme) -> DataFrame:
    """id, size, whole (two 64-bit sums that tell sets apart) and parities (marks) of each document; chunk and the chunk's block, in its first row.

    A block has of the documents with an id and words: ids, stored tokens, prefixes' sizes, numbers of keys; all stored tokens; all keys.
    """
    growth = math.sqrt(max(1.0, plan_bytes(docs) / UNIT))
    most_rows, most_tokens = int(KEY_ROWS * growth), int(KEY_TOKENS * growth)

    def run(batches):
        hasher = Hasher()
        ids, sizes, first, second, marks, numbers, stored, keys, held = [], [], [], [], [], [], [], [], 0

        def rows():
            none = np.zeros(0, np.uint64)
            block = pack(np.array(numbers, np.int64).reshape(-1, 4).T.copy(), np.concatenate([none, *stored]), np.concatenate([none, *keys]))
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(marks, pa.binary()), pa.array([uuid.uuid4().int >> 65] * len(ids), pa.int64()), pa.array([block, *[None] * (len(ids) - 1)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["id", "size", "whole1", "whole2", "marks", "chunk", "block"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = hasher.shingles(text.as_py(), n)
                ids.append(i)
                sizes.append(len(tokens))
                first.append(int(mix(tokens).sum(dtype=np.uint64).astype(np.int64)))
                second.append(int(mix(tokens ^ _U(0x8EBC6AF09C88C6E3)).sum(dtype=np.uint64).astype(np.int64)))
                marks.append(scheme.parities(tokens))
                if i is not None and len(tokens):
                    stored.append(scheme.stored(tokens)), keys.append(scheme.keys(tokens))
                    numbers.append((i, len(stored[-1]), scheme.prefix(len(tokens)), len(keys[-1])))
                    held += len(stored[-1]) + len(keys[-1])
                if len(ids) >= most_rows or held >= most_tokens:
                    yield rows()
                    ids, sizes, first, second, marks, numbers, stored, keys, held = [], [], [], [], [], [], [], [], 0
        if ids:
            yield rows()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, size long, whole1 long, whole2 long, marks binary, chunk long, block binary")


class Chunk:
    """A chunk's documents: ids, how many tokens are stored, prefixes' sizes, numbers of keys; the tokens; the keys; the distinct counted tokens."""

    def __init__(self, block: bytes, limit: np.uint64):
        numbers, self.tokens, self.keys = unpack(block, np.int64, np.uint64, np.uint64)
        self.ids, self.sizes, self.prefixes, self.n_keys = numbers.reshape(4, -1)
        self.counted = np.flatnonzero(self.tokens <= limit)
        self.distinct, self.which, self.times = np.unique(self.tokens[self.counted], return_inverse=True, return_counts=True)

    def told(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and ids of all lists that others may be on, by the ranks of the distinct counted tokens (0: of one document)."""
        rank = np.full(len(self.tokens), 255, np.int64)
        rank[self.counted] = ranks[self.which]
        owner = np.repeat(np.arange(len(self.ids)), self.sizes)
        order = np.argsort(owner << 8 | rank, kind="stable")  # a document's tokens ascend
        place = np.arange(len(order)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        kept = order[(place < self.prefixes[owner]) & (rank[order] > 0)]
        return np.concatenate([mix(self.tokens[kept]), self.keys]), np.concatenate([self.ids[owner[kept]], np.repeat(self.ids, self.n_keys)])


def _tell_tokens(buckets: int, limit: np.uint64):
    """Blocks of a chunk's counted tokens for the buckets: 32 bits of each token, and in how many documents it is."""

    def run(batches):
        for batch in batches:
            for number, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                chunk = Chunk(block.as_py(), limit)
                low, times = chunk.distinct.astype(np.uint32), np.minimum(chunk.times, 65535).astype(np.uint16)
                made = [(k, pack(low[a:b], times[a:b])) for k, a, b in cuts(chunk.distinct, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int32()), pa.array([number] * len(made), pa.int64()), pa.array([x for _, x in made], pa.binary())], names=["bucket", "chunk", "block"])

    return run


def _count(table: pa.Table) -> pa.Table:
    """For each chunk's tokens their ranks: 0 for those of one document, and four to each doubling of documents."""
    parts = [unpack(x, np.uint32, np.uint16) for x in table.column("block").to_pylist()]
    tokens, times = (np.concatenate(x) for x in zip(*parts))
    _, which = np.unique(tokens, return_inverse=True)
    found = np.bincount(which, weights=times)
    ranks = np.minimum(254, np.where(found > 1, 1 + 4 * np.log2(found), 0)).astype(np.uint8)[which]
    answers = [pack(x) for x in np.split(ranks, np.cumsum([len(x[0]) for x in parts])[:-1])]
    return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "block": pa.array(answers, pa.binary())})


def grouped(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys, the least id of each, and ties (rows u, v) of the other ids to it."""
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    low = np.minimum.reduceat(ids, starts) if len(keys) else ids
    own = np.repeat(low, np.diff(np.concatenate([starts, [len(keys)]])))
    return keys[starts], low, np.unique(np.stack([ids, own])[:, ids != own], axis=1)


def _pick_keys(buckets: int, limit: np.uint64):
    """Of each chunk, by the ranks that buckets answer, its keys: each once, with its least id; ties within the chunk go along."""

    def run(batches):
        for batch in batches:
            for block, answers in zip(batch.column(0), batch.column(1).to_pylist()):
                chunk, ranks = Chunk(block.as_py(), limit), {x["bucket"]: unpack(x["block"], np.uint8)[0] for x in answers or ()}
                key, low, ties = grouped(*chunk.told(np.concatenate([np.zeros(0, np.uint8), *(ranks[k] for k, _, _ in cuts(chunk.distinct, buckets))])))
                yield pa.RecordBatch.from_arrays([pa.array([len(key)], pa.int64()), pa.array([pack(key, low, ties[0], ties[1])], pa.binary())], names=["n", "block"])

    return run


def _tell_keys(buckets: int):
    """Blocks of a chunk's keys for the buckets."""

    def run(batches):
        for batch in batches:
            for block in batch.column(0):
                key, low, u, v = unpack(block.as_py(), np.uint64, np.int64, np.int64, np.int64)
                made = [(k, pack(key[a:b], low[a:b], *((u, v) if i == 0 else (u[:0], v[:0])))) for i, (k, a, b) in enumerate(cuts(key, buckets))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in made], pa.int32()), pa.array([r[1] for r in made], pa.binary())], names=["bucket", "block"])

    return run


def _tie(table: pa.Table) -> pa.Table:
    """Ties of all ids that share a key of the bucket."""
    parts = [unpack(x, np.uint64, np.int64, np.int64, np.int64) for x in table.column("block").to_pylist()]
    keys, ids, u, v = (np.concatenate(x) for x in zip(*parts))
    ties = np.unique(np.concatenate([grouped(keys, ids)[2], np.stack([u, v])], axis=1), axis=1)
    return pa.table({"u": pa.array(ties[0]), "v": pa.array(ties[1])})


class Forest:
    """Union-find over 0..n-1 with the least index as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def linked(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the least index that links reach, by scanning the inverted lists of its tokens."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    ends = np.concatenate([starts[1:], [len(tokens)]])
    number = np.empty(len(tokens), np.int64)  # the list of each token of each set
    number[order] = np.repeat(np.arange(len(starts)), ends - starts)
    firsts, forest = np.concatenate([[0], np.cumsum(sizes)]), Forest(len(sets))
    for i in range(1, len(sets)):
        own = number[firsts[i] : firsts[i + 1]]
        own = own[ends[own] - starts[own] > 1]
        if not len(own):
            continue
        hits = np.concatenate([owner[starts[k] : ends[k]] for k in own])
        shared = np.bincount(hits[hits < i], minlength=i)
        for j in np.flatnonzero(100 * shared >= percent * (sizes[i] + sizes[:i] - shared)):
            forest.join(i, int(j))
    return [forest.root(i) for i in range(len(sets))]


def _ties(ids: list[int], roots: list[int]) -> pa.Table:
    """Each id with the id of its root; ids ascend."""
    found = [(ids[i], ids[r]) for i, r in enumerate(roots) if ids[i] != ids[r]]
    return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})


def _compare(n: int, percent: int):
    def run(table):
        hasher, by_id = Hasher(), sorted(zip(table.column("id").to_pylist(), table.column("text").to_pylist()), key=lambda x: x[0])
        return _ties([i for i, _ in by_id], linked([hasher.shingles(text, n) for _, text in by_id], percent))

    return run


def near(sizes: np.ndarray, marks: list[bytes], percent: int) -> list[int]:
    """For each set, by ascending size, the least index reached by pairs whose parities allow a link."""
    forest, lengths = Forest(len(sizes)), np.array([len(m) for m in marks])
    for length in np.unique(lengths):
        own, double = np.flatnonzero(lengths == length), np.flatnonzero(lengths == 2 * length)
        rows = np.frombuffer(b"".join(marks[i] for i in own), np.uint64).reshape(len(own), -1)
        if len(double):
            folded = np.frombuffer(b"".join(marks[i] for i in double), np.uint64).reshape(len(double), 2, -1)
            rows = np.concatenate([rows, folded[:, 0] ^ folded[:, 1]])
        place, size = np.concatenate([own, double]), np.concatenate([sizes[own], sizes[double]])
        ends = np.searchsorted(size, size[: len(own)] * 100 // percent, "right")
        for i in range(len(own)):
            other = slice(i + 1, ends[i])
            least = np.bitwise_count(rows[other] ^ rows[i]).sum(1, dtype=np.int64)
            for j in np.flatnonzero(least * (100 + percent) <= (100 - percent) * (size[other] + size[i])):
                forest.join(int(place[i]), int(place[i + 1 + j]))
    return [forest.root(i) for i in range(len(sizes))]


def _screen(percent: int):
    def run(table):
        sizes = np.array(table.column("size").to_pylist(), np.int64)
        order = np.argsort(sizes, kind="stable")
        ids, marks = table.column("id").to_pylist(), table.column("marks").to_pylist()
        return _ties([ids[i] for i in order], near(sizes[order], [marks[i] for i in order], percent))

    return run


def _dealt(members: DataFrame, most_docs: int, most_size: int | None) -> DataFrame:
    """``members`` (id, component, size, major, ...) by pack, group, b1 and b2: small components many to a pack, large ones block by block.

    Blocks of a component's major documents come after those of the others, and don't meet each other.
    """
    parts = lambda own: F.ceil(F.greatest(F.count(F.when(own, 1)) / most_docs, *([F.coalesce(F.sum(F.when(own, F.col("size"))), F.lit(0)) / most_size] if most_size else [F.lit(0.0)]))).cast("int")
    measures = written(members.groupBy("component").agg(parts(F.lit(True)).alias("blocks"), parts(~F.col("major")).alias("others"), parts(F.col("major")).alias("majors"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")), "measures")
    docs, total = measures.where("blocks = 1").agg(F.sum("n"), F.sum("total")).head()
    packs = max(1, (docs or 0) // PACK_DOCS, (total or 0) // (most_size // 2) if most_size else 0)
    spots = members.join(measures.select("component", "blocks", "others", "majors"), "component")
    small = F.col("blocks") == 1
    block = F.when(small, 0).when(F.col("major"), F.col("others") + F.pmod(F.xxhash64("id"), F.col("majors")).cast("int")).otherwise(F.pmod(F.xxhash64("id"), F.col("others")).cast("int"))
    none = F.array().cast("array<int>")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)
    meets = F.when(small, F.array(F.lit(0))).when(F.col("major"), upto(F.col("others"))).otherwise(upto(F.col("others") + F.col("majors")))
    spots = spots.select("*", F.when(small, F.pmod(F.xxhash64("component"), F.lit(packs))).otherwise(-1).alias("pack"), F.when(small, 0).otherwise(F.col("component")).alias("group"), block.alias("block"), F.explode(meets).alias("other"))
    return spots.select(*[c for c in members.columns if c not in ("component", "major")], "pack", "group", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))


def _hanging(ties: DataFrame) -> DataFrame:
    """id, component of all ids that ties (u, v) connect."""
    found = written(connected_components(ties), "hanging")
    return found.select(F.col("node").alias("id"), "component").unionByName(found.select(F.col("component").alias("id"), "component").distinct())


def _meet_pivots(n: int, percent: int):
    """Ties of documents to the pivots that they link with."""

    def run(table):
        hasher, rows = Hasher(), list(zip(table.column("id").to_pylist(), table.column("text").to_pylist(), table.column("pivot").to_pylist()))
        pivots = [(i, hasher.shingles(t, n)) for i, t, pivot in rows if pivot]
        tokens = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for _, x in pivots)]))
        has = np.zeros((len(tokens), len(pivots)), np.int32)
        for k, (_, x) in enumerate(pivots):
            has[np.searchsorted(tokens, x), k] = 1
        sizes, found = np.array([len(x) for _, x in pivots], np.int64), []
        for i, t, pivot in rows:
            if pivot or not len(tokens):
                continue
            own = hasher.shingles(t, n)
            at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
            shared = has[at[tokens[at] == own]].sum(0)
            found += [(max(i, pivots[k][0]), min(i, pivots[k][0])) for k in np.flatnonzero(100 * shared >= percent * (len(own) + sizes - shared)).tolist() if pivots[k][0] != i]
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return run


def _with_majors(hanging: DataFrame, texts: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """``hanging`` (id, component) with major, and the ties found: the documents of a large component's largest cluster are connected by links through pivots."""
    counts = written(hanging.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_DOCS), "large")
    left = counts.agg(F.sum("n")).head()[0]
    hanging = hanging.withColumn("major", F.lit(False))
    if not left:
        return hanging, None
    state = written(hanging.join(counts.select("component"), "component", "left_semi"), "state")
    ties, turn = None, 0
    while True:
        # the first pivots are any documents, later ones those of the largest cluster
        some = state.where("major") if turn else state
        counted = some.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        pivots = some.join(counted, "component").where(F.pmod(F.xxhash64("id", F.lit(turn)), F.col("n")) < PIVOTS).select("id", "component")
        rest = state.where("NOT major")
        blocks = rest.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).cast("int").alias("blocks"))
        own = rest.join(blocks, "component").select("id", "component", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("pivot"))
        copied = pivots.join(blocks, "component").select("id", "component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("pivot"))
        spots = written(own.unionByName(copied), "pivots")
        new = written(texts.join(spots.hint("merge"), "id").groupBy("component", "block").applyInArrow(_meet_pivots(n, percent), "u long, v long"), "met")
        ties = new if ties is None else written(ties.unionByName(new), "all-met")
        clusters = written(connected_components(ties).select(F.col("node").alias("id"), F.col("component").alias("cluster")), "clusters")
        placed = state.join(clusters, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
        largest = placed.groupBy("component", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("largest"))
        state = written(placed.join(largest, "component").select("id", "component", (F.col("cluster") == F.col("largest")).alias("major")), "state")
        before, left, turn = left, state.where("NOT major").count(), turn + 1
        if not left or before - left < ATTACHED * before:
            break
    majors = state.where("major").select("id", F.lit(True).alias("__major"))
    return hanging.join(majors, "id", "left").select("id", "component", F.coalesce("__major", F.lit(False)).alias("major")), ties


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """id, size (of the set), rep (the least id with the same set), component (the least id that links reach)."""
    scheme = Scheme(percent)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = written(described(docs, id_col, text_col, n, scheme), "sets")
    whole, group = ["whole1", "whole2", "size"], ["pack", "group", "b1", "b2"]
    filled = sets.where("size > 0 AND id IS NOT NULL")
    reps = written(filled.groupBy(*whole).agg(F.min("id").alias("rep"), F.first("marks").alias("marks")), "reps")  # equal sets have equal marks
    told = written(sets.select("id", *whole).join(reps.select("rep", *whole), whole, "left").withColumn("rep", F.when((F.col("size") > 0) & F.col("id").isNotNull(), F.coalesce("rep", "id")).otherwise(F.col("id"))).select("id", "rep", *whole), "told")
    # ids with several sets stand for themselves, and are tied to those that have one of these sets first
    several = written(told.where("size > 0 AND id IS NOT NULL").groupBy("id").agg(F.min(F.struct(*whole)).alias("a"), F.max(F.struct(*whole)).alias("b")).where("a <> b").select("id"), "several")
    sure = told.join(several, "id", "left_semi").where("size > 0 AND id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    growth = lambda total: math.sqrt(max(1.0, total / GROW_KEYS))
    counted = (sets.agg(F.sum(F.octet_length("block"))).head()[0] or 0) // 8  # nearly: blocks are of hashes, which don't get smaller
    tokens = max(1, int(counted / (BUCKET_TOKENS * growth(counted)) / (int(scheme.limit) / 2**64)))
    chunks = sets.where("block IS NOT NULL").select("chunk", "block")
    ranks = written(chunks.mapInArrow(_tell_tokens(tokens, scheme.limit), "bucket int, chunk long, block binary").groupBy("bucket").applyInArrow(_count, "bucket int, chunk long, block binary"), "ranks")
    answers = ranks.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "block")).alias("ranks")).hint("shuffle_hash")
    picked = written(chunks.join(answers, "chunk", "left").select("block", "ranks").mapInArrow(_pick_keys(tokens, scheme.limit), "n long, block binary"), "keys")
    total = picked.agg(F.sum("n")).head()[0] or 0
    buckets = max(1, int(total / (BUCKET_KEYS * growth(total))))
    ties = written(picked.select("block").mapInArrow(_tell_keys(buckets), "bucket int, block binary").groupBy("bucket").applyInArrow(_tie, "u long, v long"), "ties").distinct()
    # an id whose set an earlier one has stands for nothing of its own: its ties are that one's
    copies = told.where("size > 0 AND id <> rep").join(several, "id", "left_anti").select("id", F.col("rep").alias("r")).distinct()
    first = ties.join(copies.select(F.col("id").alias("u")), "u", "left_anti").join(copies.withColumnRenamed("id", "v"), "v", "left").select("u", F.coalesce("r", "v").alias("v"))
    nodes = reps.select(F.col("rep").alias("id"), "size", "marks").unionByName(filled.join(several, "id", "left_semi").select("id", "size", "marks")).distinct()
    hanging, linked_by_pivots = _with_majors(_hanging(first), texts, n, percent)
    met = hanging.join(nodes.hint("merge"), "id")
    screened = _dealt(met, SCREEN_DOCS, None).groupBy(*group).applyInArrow(_screen(percent), "u long, v long")
    sized = _hanging(screened).join(nodes.groupBy("id").agg(F.sum("size").alias("size")), "id").join(hanging.select("id", "major"), "id")
    spots = written(_dealt(sized, BLOCK_DOCS, BLOCK_SHINGLES), "spots")
    compared = texts.join(spots.drop("size").hint("merge"), "id").groupBy(*group).applyInArrow(_compare(n, percent), "u long, v long").unionByName(sure)
    links = compared if linked_by_pivots is None else compared.unionByName(linked_by_pivots)
    found = written(connected_components(links), "components").select(F.col("node").alias("rep"), "component")
    # a repeated id takes the component of the id, which all its sets are tied to
    return told.join(found, "rep", "left").select("id", "size", "rep", F.coalesce("component", "rep").alias("component"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


def components_sql(rows: str, n: int = 3, percent: int = 90) -> str:
    """DuckDB CTEs up to ``parts(id, size, component)`` from a query of id and text."""
    return rf"""
doc AS ({rows}),
word AS (SELECT id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM doc),
shingle AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM word),
size AS (SELECT id, count(*) AS size FROM shingle GROUP BY id),
link AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM shingle a JOIN shingle b ON a.s = b.s AND a.id <> b.id JOIN size x ON x.id = a.id JOIN size y ON y.id = b.id
  GROUP BY a.id, b.id HAVING 100 * count(*) >= {percent} * (any_value(x.size) + any_value(y.size) - count(*))),
reach AS (WITH RECURSIVE r(u, v) AS (SELECT id, id FROM doc UNION SELECT r.u, link.v FROM r JOIN link ON link.u = r.v) SELECT u, min(v) AS component FROM r GROUP BY u),
parts AS (SELECT doc.id AS id, coalesce(size.size, 0) AS size, reach.component AS component FROM doc JOIN reach ON reach.u = doc.id LEFT JOIN size ON size.id = doc.id)"""


OP8_SQL = f"WITH {components_sql('SELECT doc_id AS id, text FROM documents')} SELECT id AS doc_id, size AS n_shingles, component AS component_id FROM parts"
