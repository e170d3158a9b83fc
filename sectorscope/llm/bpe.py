"""Byte-level BPE encoding and decoding through a sentencepiece model.

The model is not trained: it is serialised here, field by field, from a rank
file. Every byte is mapped to one letter (``chr(256 + byte)``), a piece's score
is its negative rank, and the normaliser is the identity, so sentencepiece
merges the adjacent pair of lowest rank, leftmost first, as byte-level BPE
does. Pre-tokens (matches of the pattern) are encoded one by one; decoding is
the inverse mapping of the vocabulary. The work is a map over documents.

Defined results: a null text encodes as the empty text (no ids) and decodes to
no bytes; equal rows get equal ids; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorscope.llm.chunks import ChunkCache
from sectorscope.llm.common import as_bytes, map_batches, row_struct, with_fields

_LETTERS = {i: 256 + i for i in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """``{token bytes: rank}`` of a rank file (base64 token, blank, rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def to_letters(token: bytes) -> str:
    return token.decode("latin-1").translate(_LETTERS)


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: varint, 32-bit float or length-delimited bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model; piece number = place in rank order, the last piece is unknown."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    # fields of a piece: 1 text, 2 score, 3 type (1 normal, 2 unknown)
    pieces = [_field(1, _field(1, to_letters(t).encode()) + _field(2, -float(ranks[t])) + _field(3, 1))
              for t in tokens]
    pieces.append(_field(1, _field(1, "<unk>".encode()) + _field(2, 0.0) + _field(3, 2)))
    # trainer: 3 model type (2 BPE), 4 vocabulary size, 40-43 ids of unknown, begin, end, padding (none: -1)
    none = (1 << 64) - 1
    trainer = (_field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, none)
               + _field(42, none) + _field(43, none))
    # normaliser: 1 name, 3 add a leading blank, 4 drop extra blanks, 5 escape blanks
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    """Encoder and decoder of one rank file and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.ids = [ranks[t] for t in self.tokens]
        self.whole = {to_letters(t): ranks[t] for t in self.tokens}
        self.bytes_of = {ranks[t]: t for t in self.tokens}
        self.pattern = regex.compile(pattern)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.cache = ChunkCache(self._encode)

    def _encode(self, chunks: list[str]) -> list[bytes]:
        pre = [[to_letters(m.encode()) for m in self.pattern.findall(c)] for c in chunks]
        new = list(dict.fromkeys(p for ps in pre for p in ps if p not in self.whole))
        merged = dict(zip(new, self.sp.encode(new, num_threads=1))) if new else {}
        out = []
        for ps in pre:
            ids: list[int] = []
            for p in ps:
                rank = self.whole.get(p)
                if rank is None:
                    ids += map(self.ids.__getitem__, merged[p])
                else:
                    ids.append(rank)
            out.append(array("I", ids).tobytes())
        return out

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit) of each text (UTF-8)."""
        return self.cache.pack(texts)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> ByteBPE:
    """One codec per worker process."""
    return ByteBPE(read_ranks(path), pattern)


def public_file(name: str) -> tuple[str, str]:
    """Path of a public vocabulary file and the pre-token pattern that goes with it."""
    import public_tokenizers
    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text",
                     carry: tuple[str, ...] = ("doc_id",), output: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """One row per input row: ``row`` (struct of ``carry``), ``n_tokens``, and of ``output``:
    ``ids`` (array of int), ``ids_packed`` (binary), ``ids_sha256``, ``decoded`` (binary), ``decoded_sha256``.
    """
    kinds = {"ids": "array<int>", "ids_packed": "binary", "ids_sha256": "string", "decoded": "binary",
             "decoded_sha256": "string"}
    packed = docs.select(row_struct(carry), as_bytes(text_col).alias("raw"))

    def run(batch: dict[str, list]) -> dict[str, list]:
        codec = _codec(ranks_path, pattern)
        ids = codec.encode(batch["raw"])
        make = {
            "ids": lambda p: np.frombuffer(p, "<i4"),
            "ids_packed": lambda p: p,
            "ids_sha256": lambda p: hashlib.sha256(p).hexdigest(),
            "decoded": codec.decode,
            "decoded_sha256": lambda p: hashlib.sha256(codec.decode(p)).hexdigest(),
        }
        return {"row": batch["row"], "n_tokens": [len(p) // 4 for p in ids]} | {o: list(map(make[o], ids)) for o in output}

    return map_batches(packed, run, with_fields(packed, "row", ", ".join(
        ["n_tokens bigint", *(f"{o} {kinds[o]}" for o in output)])))


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids",
                     carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` and ``text``: the texts of encoded documents; null ids give null, bytes that are no UTF-8 are replaced."""
    packed = encoded.select(row_struct(carry), F.col(f"`{ids_col}`").alias("ids"))

    def run(batch: dict[str, list]) -> dict[str, list]:
        tokens = _codec(ranks_path, pattern).bytes_of
        return {"row": batch["row"], "text": [None if i is None else b"".join(map(tokens.__getitem__, i)).decode(
            "utf-8", "replace") for i in batch["ids"]]}

    return map_batches(packed, run, with_fields(packed, "row", "text string"))
