"""Benchmark decontamination: a broadcast hash set of the test items' n-grams.

Words are maximal runs of digits, letters a-z (A-Z lowered) and non-ASCII
characters. An item's windows are its 13-word n-grams (an item with fewer
words is one window). The distinct windows are hashed into a table that is
broadcast; every document is scanned by token windows, a hash hit is verified
against the window's words, and the words inside it are marked.

The windows are cut into blocks by hash so that one broadcast never exceeds
``block_bytes``, whatever the size of the benchmark; each block is one further
map over the documents that adds to their marks. The marks are written before
the next block is sent, so a worker holds one block at a time. There is no
shuffle of documents and no cap on items.

Defined results: null, empty or word-free texts have no words, no hits and are
not contaminated; null, empty or word-free items have no window; items with
the same words all count; repeated rows are judged row by row; an empty
benchmark marks nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorscope.llm.common import as_bytes, map_batches, row_struct, stored, with_fields
from sectorscope.session import materialize

NGRAM = 13
#: Bytes of windows in one broadcast block.
BLOCK_BYTES = 32 << 20

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)


def normal_words(raw: bytes | None) -> list[bytes]:
    return [] if raw is None else raw.translate(_TABLE).split()


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 n: int = NGRAM) -> DataFrame:
    """Distinct windows (words joined by a space) of each item: ``item``, ``win``."""
    def run(batch: dict[str, list]) -> dict[str, list]:
        ids, windows = [], []
        for item, raw in zip(batch["item"], batch["raw"]):
            words = normal_words(raw)
            cut = {b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else ()
            ids += [item] * len(cut)
            windows += cut
        return {"item": ids, "win": windows}

    items = benchmark.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("string").alias("item"), as_bytes(text_col).alias("raw"))
    return map_batches(items, run, "item string, win binary").distinct()


def window_sets(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The windows with the numbers of their item sets (``win``, ``set``), and the sets (``set``, ``item``), as tables.

    Windows with the same items share a set, which is told by the number of its items and two sums of their hashes; no
    list of items is gathered.
    """
    spread = lambda seed: F.sum(F.xxhash64("item", F.lit(seed)).cast("decimal(38,0)"))
    pairs, _ = stored(pairs, "window-items")
    signed, _ = stored(pairs.groupBy("win").agg(F.count("*").alias("n"), spread(1).alias("a"), spread(2).alias("b")), "window-signs")
    sets, _ = stored(signed.groupBy("n", "a", "b").agg(F.min("win").alias("first")).withColumn("set", F.monotonically_increasing_id()),
                     "window-sets")
    windows, _ = stored(signed.join(sets, ["n", "a", "b"]).select("win", "set"), "windows")
    members, _ = stored(pairs.join(sets.select(F.col("first").alias("win"), "set"), "win").select("set", "item"), "set-items")
    return windows, members


class WindowIndex:
    """The windows of one block: a word table, and per window length sorted hashes of word numbers."""

    def __init__(self, rows: list[tuple[bytes, int]]):
        self.vocab: dict[bytes, int] = {}
        self.sets: dict[tuple[int, ...], int] = {}
        for win, number in rows:
            key = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in bytes(win).split())
            self.sets[key] = number
        by_len: dict[int, list[tuple[int, ...]]] = {}
        for key in self.sets:
            by_len.setdefault(len(key), []).append(key)
        self.hashes = {k: np.unique(_hash(np.array(v, np.uint64))) for k, v in by_len.items()}

    def mark(self, words: list[bytes], hit: np.ndarray, sets: set[int]) -> None:
        """Set ``hit`` at every word inside a window and add the item sets of the windows found."""
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        zeros = np.concatenate(([0], np.cumsum(ids == 0)))
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            starts = np.flatnonzero(zeros[n:] == zeros[:-n])
            if not len(starts):
                continue
            h = _hash(ids[starts[:, None] + np.arange(n)])
            at = np.searchsorted(hashes, h)
            at[at == len(hashes)] = 0
            for i in starts[hashes[at] == h].tolist():
                found = self.sets.get(tuple(ids[i:i + n].tolist()))
                if found is not None:
                    hit[i:i + n] = True
                    sets.add(found)


def _hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        h = (h ^ rows[:, j]) * _MUL
        h ^= h >> np.uint64(29)
    return h


def window_blocks(windows: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[bytes, int]]]:
    """The windows in blocks of about ``block_bytes``, dealt by hash; the number of blocks follows their size."""
    total = windows.agg(F.sum(F.length("win") + 16).alias("b")).first()["b"] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for k in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == k)
        yield [(r["win"], r["set"]) for r in part.collect()]


def find_windows(docs: DataFrame, windows: DataFrame, text_col: str, carry: tuple[str, ...],
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``row`` (struct of ``carry``), ``raw``, ``n_words``, ``n_hit``, ``hits`` (bit per word) and
    ``sets`` (numbers of the item sets of the windows found, sorted)."""
    spark = docs.sparkSession
    marked = docs.select(row_struct(carry), as_bytes(text_col).alias("raw"),
                         F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_hit"),
                         F.lit(None).cast("binary").alias("hits"),
                         F.array().cast("array<bigint>").alias("sets"))
    schema = with_fields(marked, "row", "raw binary, n_words bigint, n_hit bigint, hits binary, sets array<bigint>")
    index = None
    for rows in window_blocks(windows, block_bytes):
        if index is not None:
            marked = materialize(marked, "marks")
            index.unpersist()
        index = spark.sparkContext.broadcast(WindowIndex(rows))

        def run(batch: dict[str, list], index=index) -> dict[str, list]:
            table = index.value
            n_words, n_hit, hits, found = [], [], [], []
            for raw, old, sets in zip(batch["raw"], batch["hits"], batch["sets"]):
                words = normal_words(raw)
                hit = (np.zeros(len(words), bool) if old is None
                       else np.unpackbits(np.frombuffer(old, np.uint8), count=len(words)).astype(bool))
                numbers = set(sets)
                table.mark(words, hit, numbers)
                n_words.append(len(words))
                n_hit.append(int(hit.sum()))
                hits.append(np.packbits(hit).tobytes())
                found.append(sorted(numbers))
            return {"row": batch["row"], "raw": batch["raw"], "n_words": n_words, "n_hit": n_hit,
                    "hits": hits, "sets": found}

        marked = map_batches(marked, run, schema)
    return marked


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                       carry: tuple[str, ...] = ("doc_id",), item_col: str = "item_id",
                       item_text: str = "text", n: int = NGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``row`` (struct of ``carry``), ``n_words``, ``n_hit``, ``items``.

    ``items`` holds the ids of the items with occurring windows, as strings in string order.
    """
    windows, members = window_sets(item_windows(benchmark, item_col, item_text, n))
    marked, _ = stored(find_windows(docs, windows, text_col, carry, block_bytes).select("row", "n_words", "n_hit", "sets"), "marked")
    # the items of each combination of sets that a document has, looked up once
    named = (marked.where(F.size("sets") > 0).select("sets").distinct().select("sets", F.explode("sets").alias("set"))
             .join(members, "set").groupBy("sets").agg(F.sort_array(F.collect_set("item")).alias("items")))
    named, _ = stored(named, "named")
    return marked.join(named, "sets", "left").select(
        "row", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated(share: int = 20):
    """The verdict on a marked document: hit words times ``share`` reach its words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str = "item_id", item_text: str = "text",
           n: int = NGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``find_windows`` for a removal: every column but the text in ``row``, and no item is asked for."""
    windows, _ = stored(item_windows(benchmark, item_col, item_text, n).select("win").distinct()
                        .withColumn("set", F.lit(0).cast("bigint")), "windows")
    return find_windows(docs, windows, text_col, tuple(c for c in docs.columns if c != text_col), block_bytes)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents with every hit word (and what lies between two hit words) cut out; columns as the input's."""
    marked = _found(docs, benchmark, text_col, **options)

    def run(batch: dict[str, list]) -> dict[str, list]:
        out = []
        for raw, bits in zip(batch["raw"], batch["hits"]):
            if raw is None:
                out.append(None)
                continue
            hit = np.unpackbits(np.frombuffer(bits, np.uint8))
            parts, at, before = [], 0, False
            for k, m in enumerate(_WORD.finditer(raw)):
                if hit[k]:
                    if not before:
                        parts.append(raw[at:m.start()])
                    at = m.end()
                before = bool(hit[k])
            parts.append(raw[at:])
            out.append(b"".join(parts).decode("utf-8", "replace"))
        return {"row": batch["row"], "clean": out}

    done = map_batches(marked, run, with_fields(marked, "row", "clean string"))
    return done.select(*[F.col("clean").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c)
                         for c in docs.columns])


def remove_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", share: int = 20,
                     **options) -> DataFrame:
    """The documents that are not contaminated; columns as the input's."""
    clean = _found(docs, benchmark, text_col, **options).where(~contaminated(share))
    return clean.select(*[F.col("raw").cast("string").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c)
                          for c in docs.columns])
