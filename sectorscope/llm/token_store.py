"""Token-ID output: Parquet list columns.

Documents are range-partitioned and sorted by id, encoded inside each
partition, and written by Spark's Parquet writer: token ids in a list column
with dictionary encoding (a vocabulary fits one dictionary page), document id
and counts delta-encoded (format version 2), row groups and pages of a set
size, page indexes for skipping inside a row group. Metadata reads touch only
the small columns; token reads of some documents only their pages.

Each written part carries the token offset of its documents inside the part;
a manifest beside the data (one row per part) holds the parts' bases, so the
global start of a document is base + offset and no pass over all rows through
one task is needed.

Defined results: a null text is an empty one (the end id alone); rows with a
null id come first; rows of equal id follow in order of their text's hash,
and equal rows are all written; an empty table gives files without rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sectorscope.llm.chunks import ChunkCache
from sectorscope.llm.common import as_bytes


@dataclass(frozen=True)
class StoreLayout:
    """Sizes of the written files, in bytes."""

    row_group: int = 32 << 20
    page: int = 256 << 10
    codec: str = "zstd"

    def options(self) -> dict[str, str]:
        return {
            "compression": self.codec,
            "parquet.writer.version": "v2",               # delta encoding of integers
            "parquet.enable.dictionary": "false",         # ... of id and counts; token ids use a dictionary
            "parquet.enable.dictionary#ids.list.element": "true",
            "parquet.block.size": str(self.row_group),
            "parquet.page.size": str(self.page),
            "parquet.dictionary.page.size": str(1 << 20),
        }


def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1 itself, the rest from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (chr(256 + i) for i in range(256))
    return {b: chr(b) if b in plain else next(rest) for b in range(256)}


#: A blank and letters are one pre-token for certain (letters of every version of Unicode).
_ONE_WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


@lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkCache:
    """One tokenizer per worker process; special tokens' strings in a text are ordinary text.

    Chunks that are one word go to the tokenizer's model straight, all others through its pre-tokenizer too.
    """
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    letters, merge, is_word = _byte_letters(), tokenizer.model.tokenize, _ONE_WORD.fullmatch

    def encode(chunks: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        for c in chunks:
            if is_word(c):
                mapped = c.replace(" ", letters[32]) if c.isascii() else c.encode().decode("latin-1").translate(letters)
                out.append(array("I", [t.id for t in merge(mapped)]).tobytes())
            else:
                out.append(None)
        rest = iter(tokenizer.encode_batch_fast([c for c, ids in zip(chunks, out) if ids is None], add_special_tokens=False))
        return [array("I", next(rest).ids).tobytes() if ids is None else ids for ids in out]

    return ChunkCache(encode)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", layout: StoreLayout = StoreLayout()) -> None:
    """Write ``doc_id, n_tokens, part_start, ids`` under ``path/data`` and the manifest under ``path/parts``."""
    spark = docs.sparkSession
    ordered = (docs.select(F.col(f"`{id_col}`").alias("doc_id"), as_bytes(text_col).alias("text"))
               .withColumn("tie", F.xxhash64("text"))
               .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
               .select("doc_id", "text"))
    schema = StructType([StructField("doc_id", ordered.schema["doc_id"].dataType),
                         *StructType.fromDDL("n_tokens int, part_start bigint, ids array<int>").fields])
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, start = _encoder(tokenizer_path), 0
        for batch in batches:
            packed = [p + end for p in cache.pack(batch.column(1).to_pylist())]
            counts = np.array([len(p) // 4 for p in packed], np.int64)
            ends = np.concatenate(([0], np.cumsum(counts)))
            ids = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts.astype(np.int32)), pa.array(start + ends[:-1]),
                 pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids)],
                names=["doc_id", "n_tokens", "part_start", "ids"])
            start += int(ends[-1])

    ordered.mapInArrow(encode, schema).write.options(**layout.options()).parquet(f"{path}/data")
    parts = (_read_data(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
             .withColumn("base", F.coalesce(F.sum("tokens").over(
                 Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    parts.coalesce(1).write.parquet(f"{path}/parts")


def _read_data(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with the number of their part, taken from the file's name."""
    return spark.read.parquet(f"{path}/data").withColumn(
        "part", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens`` from the small columns alone; token pages are not read."""
    parts = spark.read.parquet(f"{path}/parts").select("part", "base")
    return (_read_data(spark, path).join(parts, "part")
            .select("doc_id", (F.col("base") + F.col("part_start")).alias("start"),
                    F.col("n_tokens").cast("bigint").alias("n_tokens")))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``; filters on ``doc_id`` reach the files' statistics and page indexes."""
    parts = spark.read.parquet(f"{path}/parts").select("part", "base")
    return (_read_data(spark, path).join(parts, "part")
            .select("doc_id", (F.col("base") + F.col("part_start")).alias("start"),
                    F.col("n_tokens").cast("bigint").alias("n_tokens"), "ids"))


def with_crc32(tokens: DataFrame, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with the list column replaced by the crc32 of its ids (little-endian unsigned 32-bit)."""
    rest = [c for c in tokens.columns if c != ids_col]
    schema = StructType([*(tokens.schema[c] for c in rest), StructField("ids_crc32", StructType.fromDDL("x bigint")["x"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(rest))
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], pa.array(crc, pa.int64())],
                                             names=[*rest, "ids_crc32"])

    return tokens.select(*rest, ids_col).mapInArrow(run, schema)
