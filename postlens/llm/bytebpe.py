"""Byte-level BPE by monoid tree reduction.

A text is halved until a piece is short, pieces are encoded alone, and neighbours are joined: the window
around the cut grows until both of its ends are places that no match of the split pattern can span, then
only the window is encoded again. No alternative of the pattern goes on past the end of a run of
non-space characters into white space, and its look-ahead reads forward only, so a non-space character
followed by a plain space is such a place: the tokens outside stay what they were. Decoding concatenates
up the same kind of tree.

Cases: a null text counts as empty (0 tokens); repeated rows give repeated results; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_of

#: A leaf is a few matches of the pattern; all of a text above that is put together by joins.
LEAF_CHARS = 256
DECODE_LEAF = 1 << 8
FIRST_WINDOW = 64


@functools.lru_cache(maxsize=4)
def load_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _sync_before(text: str, low: int, cut: int) -> int:
    """The last place in [low, cut) where a plain space follows a non-space; low if there is none."""
    width = FIRST_WINDOW
    while True:
        start = max(low, cut - width)
        at = cut
        while (at := text.rfind(" ", start, at)) > low:
            if not text[at - 1].isspace():
                return at
        if start == low:
            return low
        width *= 2


def _sync_after(text: str, cut: int, high: int) -> int:
    """The first place in (cut, high) where a plain space follows a non-space; high if there is none."""
    width = FIRST_WINDOW
    while True:
        end = min(high, cut + width)
        at = cut
        while (at := text.find(" ", at + 1, end)) >= 0:
            if not text[at - 1].isspace():
                return at
        if end == high:
            return high
        width *= 2


def encode_tree(enc, text: str, leaf: int = LEAF_CHARS) -> list[int]:
    def reduce(low: int, high: int) -> list[int]:
        if high - low <= leaf:
            return enc.encode_ordinary(text[low:high])
        cut = (low + high) // 2
        left, right = reduce(low, cut), reduce(cut, high)
        start, end = _sync_before(text, low, cut), _sync_after(text, cut, high)
        stay = len(left) - len(enc.encode_ordinary(text[start:cut]))
        skip = len(enc.encode_ordinary(text[cut:end]))
        return left[:stay] + enc.encode_ordinary(text[start:end]) + right[skip:]

    return reduce(0, len(text))


def decode_tree(enc, ids: list[int], leaf: int = DECODE_LEAF) -> bytes:
    if len(ids) <= leaf:
        return enc.decode_bytes(ids)
    cut = len(ids) // 2
    return decode_tree(enc, ids[:cut], leaf) + decode_tree(enc, ids[cut:], leaf)


def encode_texts(df: DataFrame, vocab: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, digests: bool = False) -> DataFrame:
    """One row per input row: the id, n_tokens, then ids and decoded bytes, or their digests."""
    import numpy as np

    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    fields = [rows.schema["doc_id"], T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())] * keep_ids
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] * digests

    def run(batches):
        enc = load_encoding(vocab, pattern)
        for batch in batches:
            counts, ids_out, decoded_out, id_digests, decoded_digests = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode_tree(enc, text)
                decoded = decode_tree(enc, ids)
                counts.append(len(ids))
                if keep_ids:
                    ids_out.append(ids)
                    decoded_out.append(decoded)
                if digests:
                    id_digests.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                    decoded_digests.append(hashlib.sha256(decoded).hexdigest())
            arrays = [batch.column(0), pa.array(counts, pa.int64())]
            arrays += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(decoded_out, pa.binary())] if keep_ids else []
            arrays += [pa.array(id_digests, pa.string()), pa.array(decoded_digests, pa.string())] if digests else []
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))
