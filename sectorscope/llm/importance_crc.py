"""Resampling towards a target distribution by importance weights over hashed features.

Features are all runs of 1 to ``ngrams`` consecutive words (lower-cased A-Z;
words are runs of ASCII digits, letters and anything beyond ASCII), joined by
one blank. A feature's bucket is the unsigned crc32 of its bytes modulo
``buckets``. The CRCs of many features are updated at once: distinct features
are grouped by length into two-dimensional byte arrays, one row a feature, and
the registers of all rows advance column by column; the results are scattered
back to the features' places. A feature over ``_LONG`` bytes becomes an array
of its own, of pieces whose registers are joined by the shift of a piece (the
CRC is linear).

Bucket counts of the documents and of the target give each bucket's gain;
counts are added up in the tasks first, so at most ``buckets`` numbers a table
reach the driver. A document's weight is the floored mean of its features'
gains; its score adds Gumbel noise from a hash of its id, which makes the
highest scores a weighted draw without replacement. Ranks come from one range
partitioning by score and a prefix sum over the partitions.

Defined results: a null text has no features and weight 0; a null id counts as
the empty one in the hash; ties in score go to the smaller id (null ids first),
then to either of equal rows; an empty table gives no rows, an empty target
gains that depend on the documents' counts alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sectorscope.llm.common import as_bytes, row_struct, stored
from sectorscope.llm.word_hashes import span_hashes
from sectorscope.operators.profiles import running_sum

_ONES = np.uint32(0xFFFFFFFF)
_LONG = 1024
#: Bytes of text whose features are hashed together (a longer text is alone).
_BUFFER = 1 << 21


@dataclass(frozen=True)
class ResampleRules:
    ngrams: int = 1
    buckets: int = 10_000
    seed: int = 2024
    min_words: int = 20
    percent: int = 10


# ---- CRC matrices -----------------------------------------------------------------------------------------------

def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


_TABLE = _crc_table()


def advance(register: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The CRC registers after the bytes of each row of a two-dimensional array."""
    for column in np.ascontiguousarray(rows.T):
        register = _TABLE[(register ^ column) & np.uint32(255)] ^ (register >> np.uint32(8))
    return register


def _zeros(count: int) -> list[list[int]]:
    """Registers after ``count`` zero bytes, for each value of each of a register's four bytes."""
    one = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    return advance(one.reshape(-1), np.zeros((1024, count), np.uint8)).reshape(4, 256).tolist()


_AFTER_PIECE = _zeros(_LONG)


def _long_crc(feature: np.ndarray) -> int:
    """CRC of one long feature from the registers of its pieces."""
    head = len(feature) % _LONG
    register = int(advance(np.array([_ONES]), feature[None, :head])[0])
    pieces = feature[head:].reshape(-1, _LONG)
    a, b, c, d = _AFTER_PIECE
    for piece in advance(np.zeros(len(pieces), np.uint32), pieces).tolist():
        register = a[register & 255] ^ b[register >> 8 & 255] ^ c[register >> 16 & 255] ^ d[register >> 24] ^ piece
    return register ^ 0xFFFFFFFF


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of the byte ranges of ``data``; ranges of equal bytes have equal ``key``s (checked the other way)."""
    out = np.zeros(len(start), np.uint32)
    length = end - start
    order = np.argsort(length, kind="stable")
    sizes, begins = np.unique(length[order], return_index=True)
    for size, at, to in zip(sizes.tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)]):
        mine = order[at:to]
        _, first, which = np.unique(key[mine], return_index=True, return_inverse=True)
        if size > _LONG:
            spans = [data[s:s + size] for s in start[mine].tolist()]
            made = {f: _long_crc(spans[f]) for f in first.tolist()}
            out[mine] = [made[f] if f == i or np.array_equal(spans[f], spans[i]) else _long_crc(spans[i])
                         for i, f in enumerate(first[which].tolist())]
            continue
        rows = np.lib.stride_tricks.sliding_window_view(data, size)[start[mine]]
        distinct = rows[first]
        if np.array_equal(distinct[which], rows):
            out[mine] = advance(np.full(len(first), _ONES), distinct)[which] ^ _ONES
        else:  # two features with one key
            out[mine] = advance(np.full(len(mine), _ONES), rows) ^ _ONES
    return out


# ---- features ---------------------------------------------------------------------------------------------------

#: Each byte's lower-case form if it is part of a word, else a blank.
_WORD_BYTE = np.full(256, 32, np.uint8)
for _lo, _hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _WORD_BYTE[_lo:_hi] = np.arange(_lo, _hi)
_WORD_BYTE[0x41:0x5B] = np.arange(0x61, 0x7B)


class Features:
    """The features of some texts: ``bucket`` and ``doc`` (number of the text) of each, ``n_words`` of each text."""

    def __init__(self, texts: list[bytes], rules: ResampleRules):
        data = _WORD_BYTE[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        inside = data != 32
        after = np.concatenate(([False], inside[:-1]))
        kept = inside | after  # words, one blank after each
        text_of = np.searchsorted(np.cumsum(sizes), np.flatnonzero(inside & ~after), side="right")
        data, inside = data[kept], inside[kept]
        end = np.flatnonzero(~inside)
        start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
        self.n_words = np.bincount(text_of, minlength=len(texts))
        hashes = span_hashes(data, start, end)
        buckets, docs, key = [], [], np.zeros(len(start), np.uint64)
        for size in range(1, rules.ngrams + 1):
            last = len(start) - size + 1
            if last <= 0:
                break
            # a run's key mixes those of its words in order
            key = key[:last] * np.uint64(0x9E3779B97F4A7C15) + hashes[size - 1:]
            same = text_of[:last] == text_of[size - 1:]
            crc = crc32_spans(data, start[:last][same], end[size - 1:][same], key[same])
            buckets.append(crc % np.uint32(rules.buckets))
            docs.append(text_of[:last][same])
        self.bucket = np.concatenate(buckets).astype(np.int64) if buckets else np.zeros(0, np.int64)
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)


def _buffers(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    group: list[bytes] = []
    size = 0
    for text in texts:
        text = text or b""
        if group and size + len(text) > _BUFFER:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def bucket_counts(docs: DataFrame, text_col: str, rules: ResampleRules) -> np.ndarray:
    """How many features of all texts fall in each bucket; one sum a task and bucket is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(rules.buckets, np.int64)
        for batch in batches:
            for texts in _buffers(batch.column(0).to_pylist()):
                count += np.bincount(Features(texts, rules).bucket, minlength=rules.buckets)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], names=["bucket", "n"])

    out = np.zeros(rules.buckets, np.int64)
    parts = docs.select(as_bytes(text_col).alias("text")).mapInArrow(run, "bucket int, n bigint")
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of each bucket's smoothed shares, floored."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


# ---- the operator -----------------------------------------------------------------------------------------------

def score_documents(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                    carry: tuple[str, ...] = ("doc_id",), rules: ResampleRules = ResampleRules()) -> DataFrame:
    """One row per input row: ``row`` (struct of ``carry``), ``id``, ``n_words``, ``n_features``, ``weight``, ``score``."""
    gain = gains(bucket_counts(docs, text_col, rules), bucket_counts(target, text_col, rules))
    packed = docs.select(row_struct(carry), F.col(f"`{id_col}`").alias("id"), as_bytes(text_col).alias("text"))
    schema = StructType([packed.schema["row"], packed.schema["id"],
                         *StructType.fromDDL("n_words bigint, n_features bigint, weight bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, count, total = [], [], []
            for texts in _buffers(batch.column(2).to_pylist()):
                found = Features(texts, rules)
                words.append(found.n_words)
                count.append(np.bincount(found.doc, minlength=len(texts)))
                edge = np.searchsorted(np.sort(found.doc, kind="stable"), np.arange(len(texts) + 1))
                running = np.concatenate(([0], np.cumsum(gain[found.bucket[np.argsort(found.doc, kind="stable")]])))
                total.append(running[edge[1:]] - running[edge[:-1]])
            words, count, total = map(np.concatenate, (words, count, total))
            weight = total // np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(
                pa.array(v.astype(np.int64)) for v in (words, count, weight))], names=schema.names)

    key = F.concat(F.lit(f"{rules.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return packed.mapInArrow(run, schema).withColumn("score", F.col("weight") + noise)


def draw(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id",
         carry: tuple[str, ...] = ("doc_id",), rules: ResampleRules = ResampleRules()) -> DataFrame:
    """``row``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (1 for the highest score; null if not drawn)."""
    # stored, so that the number that tells equal rows apart stays the same
    scored, _ = stored(score_documents(docs, target, text_col, id_col, carry, rules)
                       .withColumn("nth", F.monotonically_increasing_id()), "resample-scores")
    fits = F.col("n_words") >= rules.min_words
    drawn = scored.where(fits).count() * rules.percent // 100
    ordered = scored.withColumn("place", F.struct((~fits).alias("unfit"), (-F.col("score")).alias("down"), "id", "nth"))
    kept = ["row", "n_words", "n_features", "weight", "score"]
    ranked = running_sum(ordered, "place", fits.cast("bigint"), "rank", kept)
    return ranked.select(*kept, F.when(fits & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id",
             rules: ResampleRules = ResampleRules()) -> DataFrame:
    """The drawn documents, columns as the input's."""
    drawn = draw(docs, target, text_col, id_col, tuple(docs.columns), rules).where("rank is not null")
    return drawn.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
