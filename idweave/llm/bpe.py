"""BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a merge, so the place between the two bytes
is a certain cut: the fragments on both sides are encoded independently and their ids concatenated. Cuts are used only
where the pre-tokenizer's pattern sees the same on both sides as well (not after white space, not beside an
apostrophe, not within a character). Most fragments are single words that recur, so each worker remembers their ids.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

REMEMBERED = 250_000
LONGEST_REMEMBERED = 64
#: White space and invisible characters outside ASCII, as UTF-8: no cut after them.
ODD_SPACE = re.compile(rb"\xc2[\x80-\xa0\xad]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f-\xaf]|\xe3\x80\x80|\xef\xbb\xbf")


def byte_of_symbol() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, every other byte for the next code point from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ForcedBoundaryBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already keeps every core busy
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        byte, added = byte_of_symbol(), {k: v.content for k, v in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        inside = np.zeros((256, 256), bool)
        for token, k in vocabulary.items():
            own = added[k].encode() if k in added else bytes(byte[c] for c in token)
            self.token_bytes[k] = own
            pairs = np.frombuffer(own, np.uint8)
            inside[pairs[:-1], pairs[1:]] = True
        cut = ~inside
        cut[:33, :] = cut[127, :] = False  # after white space or a control character
        cut[ord("'"), :] = cut[:, ord("'")] = False  # contractions
        cut[:, 128:192] = False  # within a character
        self.cut = cut.ravel()
        self.known: dict[bytes, bytes] = {}

    def fragments(self, data: bytes) -> list[bytes]:
        if len(data) < 2:
            return [data] if data else []
        a = np.frombuffer(data, np.uint8)
        pair = a[:-1].astype(np.uint16)
        pair <<= 8
        pair |= a[1:]
        cut = self.cut[pair]
        if not data.isascii():
            for m in ODD_SPACE.finditer(data):
                if m.end() <= len(cut):
                    cut[m.end() - 1] = False
        at = [0, *(np.flatnonzero(cut) + 1).tolist(), len(data)]
        return [data[i:j] for i, j in zip(at, at[1:])]

    def encode(self, data: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.fragments(data)
        known = self.known
        out = [known.get(p) for p in parts]
        if None in out:
            new = list({p for p, ids in zip(parts, out) if ids is None})
            fresh = dict(zip(new, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False))))
            out = [ids if ids is not None else fresh[p] for p, ids in zip(parts, out)]
            if len(known) + len(fresh) > REMEMBERED:
                known.clear()
            known.update((p, ids) for p, ids in fresh.items() if len(p) <= LONGEST_REMEMBERED)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def forced_boundary_bpe(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def _with_column(df: DataFrame, column: str, out: str, kind: T.DataType, make) -> DataFrame:
    """df with column ``out`` made from ``column`` batch by batch; a column of that name is replaced."""
    df = df.withColumn(out, F.col(column)) if out != column else df
    schema = T.StructType([T.StructField(f.name, kind if f.name == out else f.dataType) for f in df.schema])
    at, arrow = [f.name for f in schema].index(out), pa.binary() if isinstance(kind, T.BinaryType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(make(batch.column(at)), arrow)
            yield pa.RecordBatch.from_arrays([made if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with ``out``: the ids of each whole text, as ``tokenizers`` encodes it without special tokens added.

    Ids are packed as little-endian unsigned 32-bit integers. A null text has the ids of an empty one (none). Every row
    stays, repeated rows too; other columns pass through and one named like ``out`` is replaced.
    """

    def make(column: pa.Array) -> list[bytes]:
        bpe = forced_boundary_bpe(path)
        return [bpe.encode((x.as_py() or "").encode()) for x in column]

    return _with_column(df, text, out, T.BinaryType(), make)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with ``out``: the text that the ids stand for, special tokens included; null ids give an empty text.

    Bytes that are no UTF-8 become U+FFFD. Every row stays; a column named like ``out`` is replaced.
    """

    def make(column: pa.Array) -> list[str]:
        bpe = forced_boundary_bpe(path)
        return [bpe.decode(x.as_py() or b"") for x in column]

    return _with_column(df, ids, out, T.StringType(), make)
