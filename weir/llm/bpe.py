"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Edge cases: a null or empty text has no ids and decodes to no bytes; repeated rows are
encoded each by itself; an empty table gives an empty table; a column of the input that
has the name of an output column is replaced.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts longer than this many code points are encoded in pieces.
PIECE = 1 << 16
#: Rows handed to the tokenizer at once.
ROWS = 256
#: ASCII white space after something else: no match of the pattern goes over such a place, and none looks back.
_SAFE = re.compile(r"(?<=\S)(?=[\t-\r ])")


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The tokenizer of a rank file, built once a worker."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("weir", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` cut at safe boundaries only, each piece as short as they allow but at least ``size`` long."""
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode_text(text: str | None, ranks_path: str, pattern: str, size: int = PIECE) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    if not text:
        return b""
    own = encoding(ranks_path, pattern)
    return b"".join(own.encode_to_numpy(x, disallowed_special=()).astype("<u4").tobytes() for x in pieces(text, size))


def decode_ids(ids: bytes | None, ranks_path: str, pattern: str) -> bytes:
    """The bytes that the ids stand for, not checked to be UTF-8."""
    return encoding(ranks_path, pattern).decode_bytes(memoryview(ids).cast("I").tolist()) if ids else b""


def _mapped(df: DataFrame, column: str, outputs: dict[str, object]) -> DataFrame:
    """``df`` with binary columns computed from ``column`` and from the outputs before them."""
    kept = [c for c in df.columns if c not in outputs]
    source = df.select(*[F.col(f"`{c}`") for c in kept], *([F.col(f"`{column}`").alias("__in")] if column not in kept else []))
    name = column if column in kept else "__in"
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, T.BinaryType()) for c in outputs])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                values, made = part.column(part.schema.get_field_index(name)).to_pylist(), []
                for f in outputs.values():
                    values = [f(x) for x in values]
                    made.append(pa.array(values, pa.binary()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), *made], names=[*kept, *outputs])

    return source.mapInArrow(run, schema)


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds ``out_col``: the ids of ``text_col`` as packed little-endian unsigned 32-bit integers."""
    return _mapped(df, text_col, {out_col: functools.partial(encode_text, ranks_path=ranks_path, pattern=pattern)})


def bpe_decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``: the raw bytes of the packed ids in ``ids_col``."""
    return _mapped(df, ids_col, {out_col: functools.partial(decode_ids, ranks_path=ranks_path, pattern=pattern)})


def bpe_round_trip(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Adds ``ids`` and ``decoded`` in one pass through Python."""
    both = {"ids": functools.partial(encode_text, ranks_path=ranks_path, pattern=pattern), "decoded": functools.partial(decode_ids, ranks_path=ranks_path, pattern=pattern)}
    return _mapped(df, text_col, both)


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and SHA-256 digests of ``ids`` and ``decoded``."""
    return df.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
