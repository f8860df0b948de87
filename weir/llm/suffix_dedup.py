"""Removal of byte strings of ``LENGTH`` that also start in a document with a smaller id.

Every suffix that can match is compared by its first LENGTH bytes, its string. Strings are
ordered by their leading token and then by their bytes, and range-partitioned by sampled
splitters in that order; each bucket sorts its own by a multikey quicksort.

1. The leading token of a string is the 16-gram of least hash in it. Equal strings have
   equal leading tokens, and neighbouring strings mostly share one, so a run of them
   travels as one segment of bytes instead of LENGTH bytes a string. Chunks of texts tell
   each token once, with the least and greatest id and the least and greatest hash of the
   segments that have it. A token of one document is left out. A token with one segment
   is decided at once: all copies of that segment have the same strings, and the least id
   keeps them.
2. Strings of the other tokens are sampled for splitters. A splitter is a token, or a
   token and a whole string where one token has several splitters: such a hot token's
   strings are dealt one by one, by their later bytes, so that no token needs to fit a
   bucket. Equal strings are always on one side of a splitter, so what would have to be
   compared across boundaries never lies on both sides of one.
3. Equal segments collapse to the least id that has them, first within a chunk of texts,
   then in their bucket; all strings of a segment's other documents go at once. Each
   bucket sorts the strings of what remains by multikey quicksort, 8 bytes a step, refining
   ties only, and equal neighbours get the least id among them.

Texts are packed into chunks, written once, compressed. What chunks and buckets tell each
other are blocks of numbers, one a chunk and bucket. Chunks grow with the fourth root of
the input and buckets with its square root, so that the number of blocks stays in
proportion to the input. Numbers are in the order of tokens, which each chunk finds again
from its texts, so no places are sent.

Strings never cross documents and are judged on the input. Rows that repeat an id don't
count against each other. A null text is an empty one; a row with a null id is kept whole
and counts against no other. Very long texts are worked on in slices of PIECE bytes, but
stand in one chunk. Equal texts are a tie that the least id wins. An empty table gives an
empty table. Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import bisect
import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import cuts, mix, pack, unpack
from .common import SHARE, plan_bytes, table, written

LENGTH, TOKEN = 50, 16
#: Bytes of a chunk of up to UNIT bytes of input, and of what is worked on at once; suffixes of one segment at most.
CHUNK, PIECE, RUN, UNIT = 1 << 20, 1 << 17, 64, 1 << 30
#: Suffixes that a bucket sorts at once, whole tokens apart; bytes of text for each bucket of tokens and of segments, of up to UNIT bytes of input.
SORT, TOKEN_BYTES, SEGMENT_BYTES = 1 << 18, 8 << 20, 4 << 20
#: Sampled strings for each splitter; of n chunks, SAMPLE_CHUNKS and one in SAMPLE_SHARE are sampled.
SAMPLES, SAMPLE_CHUNKS, SAMPLE_SHARE = 32, 16, 64
_U = np.uint64
WORDS = [*range(0, LENGTH - 7, 8), LENGTH - 8]


def eight(data: np.ndarray) -> np.ndarray:
    """At each place the next 8 bytes as a big-endian number."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(">u8")[:, 0].astype(np.uint64)


def leading_tokens(data: np.ndarray) -> np.ndarray:
    """The least hash of a 16-gram within the LENGTH bytes from each place on, mixed again as least ones are small."""
    x = eight(data)
    h = mix(x[:-8] * _U(0x9E3779B97F4A7C15) + mix(x[8:] + _U(1)))
    wide = LENGTH - TOKEN + 1
    step = 1
    while step * 2 <= wide:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return mix(np.minimum(h[: len(h) - (wide - step)], h[wide - step :]) if wide > step else h)


def packed(rows):
    """Bytes of several texts after one another, long ones in overlapping slices: (data, [(row, offset in the text, place, suffixes)])."""
    parts, spots, size = [], [], 0
    for row, text in rows:
        for at in range(0, max(0, len(text) - LENGTH + 1), PIECE):
            piece = text[at : at + PIECE + LENGTH - 1]
            spots.append((row, at, size, len(piece) - LENGTH + 1))
            parts.append(piece)
            size += len(piece)
            if size >= PIECE:
                yield np.frombuffer(b"".join(parts), np.uint8), spots
                parts, spots, size = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), spots


#: An odd base of the segments' hash, and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def segment_hashes(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run: a polynomial over the mixed 8-grams from each of its places on."""
    grams = mix(eight(data) + _U(_BASE))
    down, up = np.full(len(grams), _INVERSE, np.uint64), np.full(len(grams), _BASE, np.uint64)
    down[0] = up[0] = 1
    down, up = np.cumprod(down, dtype=np.uint64), np.cumprod(up, dtype=np.uint64)
    sums = np.concatenate([[_U(0)], np.cumsum(grams * down, dtype=np.uint64)])
    return mix((sums[at + n + LENGTH - 8] - sums[at]) * up[at] + n.astype(np.uint64))


def runs(data: np.ndarray, spots: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(spot, place, suffixes, token) of each run of suffixes with one leading token."""
    tokens = leading_tokens(data)
    places, sizes = np.array([s[2] for s in spots]), np.array([s[3] for s in spots])
    spot = np.repeat(np.arange(len(spots)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + places[spot]
    value = tokens[at]
    new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (spot[1:] != spot[:-1])]))
    length = np.diff(np.concatenate([new, [len(at)]]))
    pieces = (length + RUN - 1) // RUN  # long runs are cut
    first = np.repeat(new, pieces) + RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    n = np.minimum(RUN, np.repeat(new + length, pieces) - first)
    return spot[first], at[first], n, value[first]


def multikey_order(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by all columns, and for each place in it whether a new value starts there; only ties go on to the next column."""
    order = np.argsort(columns[0], kind="stable")
    new = np.concatenate([[True], columns[0][order][1:] != columns[0][order][:-1]])
    for column in columns[1:]:
        tied = np.flatnonzero(~new | np.concatenate([~new[1:], [False]]))
        if not len(tied):
            break
        group, value = np.cumsum(new)[tied], column[order[tied]]
        inner = np.lexsort((value, group))
        order[tied] = order[tied[inner]]
        group, value = group[inner], value[inner]
        new[tied] = np.concatenate([[True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])])
    return order, new


def _sorted_bucket(tokens: np.ndarray, ids: np.ndarray, segments: list[bytes]) -> list[np.ndarray]:
    """For each segment its suffixes that a smaller id also has."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments])
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(segments)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = offset + np.repeat(np.cumsum(sizes) - sizes, counts)
    x = eight(data)
    order, new = multikey_order([tokens[owner], *(x[at + w] for w in WORDS)])
    starts, owned = np.flatnonzero(new), ids[owner[order]]
    least = np.repeat(np.minimum.reduceat(owned, starts), np.diff(np.concatenate([starts, [len(order)]])))
    found = np.sort(order[least < owned])
    return np.split(offset[found], np.cumsum(np.bincount(owner[found], minlength=len(segments)))[:-1])


def _chunks(most: int):
    """Texts gathered to chunks of about ``most`` bytes: ids, sizes in bytes, and the bytes."""

    def run(batches):
        ids, parts, size = [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in parts]], pa.list_(pa.int64())), pa.array([zstandard.compress(b"".join(parts), 3)], pa.binary())], names=["chunk", "ids", "sizes", "data"]
            )

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = x.as_buffer().to_pybytes() if x.is_valid else b""
                ids.append(i), parts.append(text)
                size += len(text)
                if size >= most:
                    yield row()
                    ids, parts, size = [], [], 0
        if ids:
            yield row()

    return run


class Splitters:
    """Bounds between buckets in the order of (token, string); a bound is a token, or a token and a string."""

    def __init__(self, bounds: list[tuple[int, bytes]]):
        self.bounds = bounds
        self.tokens = np.array([t for t, _ in bounds], np.uint64)
        self.hot = np.unique(np.array([t for t, x in bounds if x], np.uint64))

    @classmethod
    def of(cls, sample: list[tuple[int, bytes]], buckets: int) -> Splitters:
        """Evenly spaced ones of a sample; the first of a token is the token alone, so that only tokens with several are split."""
        ranked = sorted(sample)
        picked = sorted({ranked[k * len(ranked) // buckets] for k in range(1, buckets)}) if ranked else []
        return cls([(t, b"" if k == 0 or picked[k - 1][0] != t else x) for k, (t, x) in enumerate(picked)])

    def __len__(self) -> int:
        return len(self.bounds) + 1

    def buckets(self, leads: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """The bucket of each segment; one of a hot token is a single string."""
        found = np.searchsorted(self.tokens, leads, "right")
        for i in np.flatnonzero(np.isin(leads, self.hot)).tolist():
            found[i] = bisect.bisect_right(self.bounds, (int(leads[i]), texts[i]))
        return found


class Chunk:
    """The runs of a chunk's texts, and the order of its tokens and segments."""

    def __init__(self, ids: list, sizes: list[int], data: bytes, hashed: bool = False):
        self.ids, self.sizes, self.data = ids, np.array(sizes, np.int64), zstandard.decompress(data)
        self.begins = np.cumsum(self.sizes) - self.sizes
        found = []
        rows = ((i, self.data[b : b + n]) for i, (b, n) in enumerate(zip(self.begins.tolist(), sizes)) if ids[i] is not None)
        for piece, spots in packed(rows):
            spot, place, n, token = runs(piece, spots)
            row, at, begin = (np.array([x[k] for x in spots], np.int64)[spot] for k in (0, 1, 2))
            found.append((row, place - begin + at, n, token, segment_hashes(piece, place, n) if hashed else token))
        self.row, self.start, self.n, self.token, self.hash = (np.concatenate(x) for x in zip(*found)) if found else (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        self.tokens, self.which = np.unique(self.token, return_inverse=True)

    @property
    def owner(self) -> np.ndarray:
        """The id that each run is of."""
        return np.array([i or 0 for i in self.ids], np.int64)[self.row]

    def bounds(self) -> list[np.ndarray]:
        """The least and the greatest id, and the least and the greatest segment hash, of each token."""
        order = np.argsort(self.which, kind="stable")
        starts = np.searchsorted(self.which[order], np.arange(len(self.tokens)))
        return [f.reduceat(x, starts) if len(starts) else x for x in (self.owner[order], self.hash[order]) for f in (np.minimum, np.maximum)]

    def segments(self, several: np.ndarray, splitters: Splitters | None = None) -> None:
        """Finds the distinct segments of tokens that have several, in the order of buckets: kept (runs), segment (of each), texts, leads (tokens), bucket, least ids."""
        kept = np.flatnonzero(several[self.which])
        if splitters and len(splitters.hot):  # strings of hot tokens stand alone
            alone = np.isin(self.token[kept], splitters.hot)
            times = np.where(alone, self.n[kept], 1)
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            one, kept = np.repeat(alone, times), np.repeat(kept, times)
            self.row, self.token, self.n, self.start = self.row[kept], self.token[kept], np.where(one, 1, self.n[kept]), self.start[kept] + inner
        else:
            self.row, self.token, self.n, self.start = self.row[kept], self.token[kept], self.n[kept], self.start[kept]
        places = self.begins[self.row] + self.start
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(self.data[p : p + n + LENGTH - 1], len(known)) for p, n in zip(places.tolist(), self.n.tolist())], np.int64)
        first = np.full(len(known), -1, np.int64)
        first[number[::-1]] = np.arange(len(number))[::-1]
        leads, texts = self.token[first] if len(known) else np.zeros(0, np.uint64), list(known)
        bucket = splitters.buckets(leads, texts) if splitters else np.zeros(len(known), np.int64)
        order = np.lexsort((leads, bucket))
        back = np.empty(len(known), np.int64)
        back[order] = np.arange(len(known))
        self.segment, self.texts, self.leads, self.bucket = back[number], [texts[i] for i in order], leads[order], bucket[order]
        self.least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.segment, self.owner)

    def parts(self):
        """(bucket, from, to) of the segments."""
        edges = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1], [True]])) if len(self.bucket) else np.zeros(1, np.int64)
        return [(int(self.bucket[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]


def _blocks(rows, *names_types):
    rows = list(zip(*rows)) or [()] * len(names_types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, names_types)], names=[n for n, _ in names_types])


BLOCK = (("bucket", pa.int32()), ("chunk", pa.int64()), ("block", pa.binary()))
BLOCK_SCHEMA = "bucket int, chunk long, block binary"


def _tell_tokens(buckets: int):
    def run(batches):
        for batch in batches:
            for number, ids, sizes, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                chunk = Chunk(ids, sizes, data, hashed=True)
                low, high, first, last = chunk.bounds()
                yield _blocks([(k, number, pack(chunk.tokens[a:b], low[a:b], high[a:b] - low[a:b], first[a:b], first[a:b] ^ last[a:b])) for k, a, b in cuts(chunk.tokens, buckets)], *BLOCK)

    return run


def _answer(table: pa.Table, answers: list[bytes]) -> pa.Table:
    return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "block": pa.array(answers, pa.binary())})


def _find_shared(table: pa.Table) -> pa.Table:
    """For each chunk's tokens, whether several documents have them, and if so whether in several segments; the least id of those in one."""
    parts = [unpack(x, np.uint64, np.int64, np.int64, np.uint64, np.uint64) for x in table.column("block").to_pylist()]
    token, low, more, first, last = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(token, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]]))
    times = np.diff(np.concatenate([starts, [len(token)]]))

    def told(values: np.ndarray) -> np.ndarray:
        out = np.empty(len(token), values.dtype)
        out[order] = np.repeat(values, times)
        return out

    least = np.minimum.reduceat(low[order], starts)
    shared = told(least < np.maximum.reduceat((low + more)[order], starts))
    several = told(np.minimum.reduceat(first[order], starts) != np.maximum.reduceat((first ^ last)[order], starts)) & shared
    least, ends = told(least), np.cumsum([len(x[0]) for x in parts])[:-1]
    return _answer(table, [pack(np.packbits(x), np.packbits(y), z[x & ~y]) for x, y, z in zip(*(np.split(v, ends) for v in (shared, several, least)))])


def _told(chunk: Chunk, told: list[dict] | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token of a chunk, whether it has several segments, and otherwise the least id that has it (none: the greatest number)."""
    answers = {x["bucket"]: unpack(x["block"], np.uint8, np.uint8, np.int64) for x in told or ()}
    several, least = np.zeros(len(chunk.tokens), bool), np.full(len(chunk.tokens), np.iinfo(np.int64).max)
    for k, a, b in cuts(chunk.tokens, buckets):
        shared, many = (np.unpackbits(x, count=b - a).astype(bool) for x in answers[k][:2])
        several[a:b] = many
        least[a:b][shared & ~many] = answers[k][2]
    return several, least


def _sample(tokens: int, share: float):
    """Strings of tokens with several segments, a share of them by their hash."""

    def run(batches):
        for batch in batches:
            for _, ids, sizes, data, told in zip(*(batch.column(k).to_pylist() for k in range(5))):
                chunk = Chunk(ids, sizes, data)
                chunk.segments(_told(chunk, told, tokens)[0])
                sizes = np.array([len(x) - LENGTH + 1 for x in chunk.texts], np.int64)
                which = np.repeat(np.arange(len(sizes)), sizes)
                offset = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                picked = np.flatnonzero(mix(chunk.leads[which] + _U(0x9E3779B97F4A7C15) * (offset.astype(np.uint64) + mix(which.astype(np.uint64)))) < _U(min(2**64 - 1, int(share * 2**64))))
                yield pa.RecordBatch.from_arrays([pa.array(chunk.leads[which[picked]].view(np.int64)), pa.array([chunk.texts[i][o : o + LENGTH] for i, o in zip(which[picked].tolist(), offset[picked].tolist())], pa.binary())], names=["token", "string"])

    return run


def _tell_segments(tokens: int, splitters: Splitters):
    def run(batches):
        for batch in batches:
            for number, ids, sizes, data, told in zip(*(batch.column(k).to_pylist() for k in range(5))):
                chunk = Chunk(ids, sizes, data)
                chunk.segments(_told(chunk, told, tokens)[0], splitters)
                lengths = np.array([len(x) for x in chunk.texts], np.uint8)
                yield _blocks([(k, number, pack(chunk.leads[a:b], chunk.least[a:b], lengths[a:b], b"".join(chunk.texts[a:b]))) for k, a, b in chunk.parts()], *BLOCK)

    return run


def _judge(table: pa.Table) -> pa.Table:
    """For each chunk's segments the least id that has them whole, and the suffixes of them that a still smaller id has."""
    known: dict[bytes, int] = {}
    leads, least, numbers = [], [], []
    for block in table.column("block").to_pylist():
        lead, low, lengths, data = unpack(block, np.uint64, np.int64, np.uint8, np.uint8)
        data, ends, own = data.tobytes(), np.cumsum(lengths, dtype=np.int64).tolist(), []
        for a, b, t, i in zip([0, *ends[:-1]], ends, lead.tolist(), low.tolist()):
            text = data[a:b]
            k = known.get(text)
            if k is None:
                k = known[text] = len(leads)
                leads.append(t), least.append(i)
            elif i < least[k]:
                least[k] = i
            own.append(k)
        numbers.append(np.array(own, np.int64))
    leads, least, texts = np.array(leads, np.uint64), np.array(least, np.int64), list(known)
    order = np.argsort(leads, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], leads[order][1:] != leads[order][:-1], [True]]))
    hits: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    group, size = [], 0
    for a, b in zip(new[:-1], new[1:]):
        if b - a > 1:  # a token with one segment has nothing to compare
            group += order[a:b].tolist()
            size += sum(len(texts[k]) - LENGTH + 1 for k in order[a:b])
        if group and (size >= SORT or b == len(order)):
            for k, h in zip(group, _sorted_bucket(leads[group], least[group], [texts[k] for k in group])):
                hits[k] = h
            group, size = [], 0
    if group:
        for k, h in zip(group, _sorted_bucket(leads[group], least[group], [texts[k] for k in group])):
            hits[k] = h
    answers = [pack(least[own], np.array([len(hits[k]) for k in own], np.uint8), np.concatenate([np.zeros(0, np.uint8), *(hits[k].astype(np.uint8) for k in own)])) for own in numbers]
    return _answer(table, answers)


def merged_spans(starts: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings cover."""
    order = np.argsort(starts, kind="stable")
    low, high = starts[order], np.maximum.accumulate(starts[order] + counts[order] + LENGTH - 1)
    new = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
    return list(zip(low[new].tolist(), high[np.concatenate([new[1:] - 1, [len(low) - 1]])].tolist()))


def _cut(tokens: int, splitters: Splitters):
    names = (("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()))

    def run(batches):
        for batch in batches:
            for _, ids, sizes, data, told, judged in zip(*(batch.column(k).to_pylist() for k in range(6))):
                chunk = Chunk(ids, sizes, data)
                several, low = _told(chunk, told, tokens)
                copies = np.flatnonzero(chunk.owner > low[chunk.which])
                decided = chunk.row[copies], chunk.start[copies], chunk.n[copies]
                chunk.segments(several, splitters)
                answers = {x["bucket"]: unpack(x["block"], np.int64, np.uint8, np.uint8) for x in judged or ()}
                found = [answers[k] for k, _, _ in chunk.parts()]
                least, counts, offsets = (np.concatenate([np.zeros(0, t), *(x[k] for x in found)]) for k, t in enumerate((np.int64, np.uint8, np.uint8)))
                segment = chunk.segment
                whole = chunk.owner > least[segment]
                parts = np.flatnonzero(~whole & (counts[segment] > 0))
                ends = np.cumsum(counts, dtype=np.int64)
                single = np.concatenate([np.zeros(0, np.int64), *(chunk.start[i] + offsets[ends[segment[i]] - counts[segment[i]] : ends[segment[i]]] for i in parts)])
                row = np.concatenate([decided[0], chunk.row[whole], np.repeat(chunk.row[parts], counts[segment[parts]])])
                start, n = np.concatenate([decided[1], chunk.start[whole], single]), np.concatenate([decided[2], chunk.n[whole], np.ones(len(single), np.int64)])
                order = np.argsort(row, kind="stable")
                row, start, n = row[order], start[order], n[order]
                edges, out = np.searchsorted(row, np.arange(len(ids) + 1)), []
                for i, (begin, size) in enumerate(zip(chunk.begins.tolist(), sizes)):
                    a, b = edges[i], edges[i + 1]
                    gone = merged_spans(start[a:b], n[a:b]) if b > a else []
                    text, at, left = chunk.data[begin : begin + size], 0, []
                    for x, y in gone:
                        left.append(text[at:x])
                        at = y
                    out.append((ids[i], size, sum(y - x for x, y in gone), len(gone), b"".join([*left, text[at:]])))
                yield _blocks(out, *names)

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    chunks = written(rows.mapInArrow(_chunks(int(CHUNK * max(1.0, plan_bytes(rows) / UNIT) ** 0.25)), "chunk long, ids array<long>, sizes array<long>, data binary"), "chunks")
    total, number = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.count(F.lit(1))).head()
    total, growth = total or 0, math.sqrt(max(1.0, (total or 0) / UNIT))
    tokens, segments = max(1, int(total / (TOKEN_BYTES * growth))), max(1, int(total / (SEGMENT_BYTES * growth)))

    def answered(told: DataFrame, answer, name: str) -> DataFrame:
        """What the buckets answer, by chunk: a chunk has one block a bucket at most."""
        found = written(told.groupBy("bucket").applyInArrow(answer, BLOCK_SCHEMA), name)
        return found.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "block")).alias(name)).hint("shuffle_hash")

    shared = answered(chunks.mapInArrow(_tell_tokens(tokens), BLOCK_SCHEMA), _find_shared, "shared")
    share = min(1.0, SAMPLE_CHUNKS / max(1, number) + 1 / SAMPLE_SHARE)
    some = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(SHARE)) < int(share * SHARE)).join(shared, "chunk", "left").select("chunk", "ids", "sizes", "data", "shared")
    # about a tenth of all strings belong to tokens with several segments
    sample = some.mapInArrow(_sample(tokens, min(1.0, SAMPLES * segments / max(1.0, 0.1 * total * share))), "token long, string binary").collect()
    splitters = Splitters.of([(x.token & (1 << 64) - 1, bytes(x.string)) for x in sample], segments)
    told = chunks.join(shared, "chunk", "left").select("chunk", "ids", "sizes", "data", "shared").mapInArrow(_tell_segments(tokens, splitters), BLOCK_SCHEMA)
    judged = answered(told, _judge, "judged")
    both = chunks.join(shared, "chunk", "left").join(judged, "chunk", "left").select("chunk", "ids", "sizes", "data", "shared", "judged")
    return both.mapInArrow(_cut(tokens, splitters), "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS p FROM d)),
hit AS (SELECT doc_id, p FROM w JOIN (SELECT s, min(doc_id) AS m FROM w GROUP BY s) USING (s) WHERE m < doc_id),
cut AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH} THEN 0 ELSE 1 END AS new FROM hit),
span AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM cut) GROUP BY doc_id, k),
part AS (SELECT span.doc_id, a, b, substr(h, 2 * lag(b, 1, 0) OVER (PARTITION BY span.doc_id ORDER BY a) + 1, 2 * (a - lag(b, 1, 0) OVER (PARTITION BY span.doc_id ORDER BY a))) AS before FROM span JOIN d USING (doc_id)),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(before, '' ORDER BY a) AS before FROM part GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(before, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
