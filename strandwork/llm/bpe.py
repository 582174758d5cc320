"""Encoding of whole texts with a public byte-level BPE vocabulary, through a sentencepiece model.

The vocabulary file (token bytes and ranks) is serialised as a sentencepiece BPE model: every token becomes a piece whose
bytes are mapped to letters, scored by its negative rank, with identity normalisation. A text is cut into pre-tokens,
each is mapped and encoded by the model, and its piece numbers are the token ids. Decoding maps the pieces back.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from strandwork.llm.common import wide

#: Where the vocabulary lies; a parameter of every function below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-token pattern of this vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes 0..255 stand as the letters from here on.
FIRST_LETTER = 0x100
#: Pre-tokens a worker remembers.
REMEMBERED = 400_000

_LETTERS = {i: FIRST_LETTER + i for i in range(256)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(no: int, value: int | float | bytes | str) -> bytes:
    if isinstance(value, float):
        return _varint(no << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(no << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(no << 3 | 2) + _varint(len(raw)) + raw


def read_vocabulary(path: str) -> list[bytes]:
    """Token bytes by id, from lines of base64 and rank."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


def letters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_LETTERS)


def serialise(vocabulary: list[bytes]) -> bytes:
    """The sentencepiece model of a vocabulary; piece numbers are token ids, with the unknown piece behind them."""
    out = [_field(1, _field(1, letters(t)) + _field(2, float(-i)) + _field(3, 1)) for i, t in enumerate(vocabulary)]
    out.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    n = len(vocabulary)
    out.append(_field(2, _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, -1) + _field(42, -1) + _field(43, -1)))
    out.append(_field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Encoder:
    def __init__(self, path: str):
        import regex
        import sentencepiece

        self.vocabulary = read_vocabulary(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.vocabulary))
        self.cut = regex.compile(PRE_TOKEN).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Token ids; empty and null texts give an empty list."""
        if not text:
            return []
        known = self.known
        words = self.cut(text)
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            if len(known) > REMEMBERED:
                known.clear()
                new = list(dict.fromkeys(words))
            known.update(zip(new, self.model.encode([letters(w.encode()) for w in new], num_threads=1)))
        out: list[int] = []
        for w in words:
            out += known[w]
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.vocabulary[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _mapped(path: str, what: str, kind) -> Column:
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = getattr(encoder(path), what)
        for s in batches:
            yield pd.Series([f(t) for t in s], index=s.index, dtype=object if what == "encode" else "int32")

    return run


def encode_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the token ids of each text, special tokens' strings being ordinary text.

    Empty and null texts give an empty list. Repeated rows are encoded each for itself; other columns are not read; an
    empty table gives no rows.
    """
    ids = _mapped(path, "encode", ArrayType(IntegerType()))
    return wide(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), "doc_id").select("doc_id", ids("text").alias("ids"))


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens): token counts; 0 for empty and null texts."""
    n = _mapped(path, "count", IntegerType())
    return wide(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), "doc_id").select("doc_id", n("text").alias("n_tokens"))


def decode_ids(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text): the inverse mapping; a null list gives a null text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = encoder(path).decode
        for s in batches:
            yield s.map(lambda x: None if x is None else f(x))

    return encoded.select(F.col(doc_id).alias("doc_id"), run(ids).alias("text"))
