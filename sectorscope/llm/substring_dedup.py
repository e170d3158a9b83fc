"""Substring dedup by suffix automata: words of passages that an earlier document has are removed.

A window is ``WINDOW`` consecutive words. A word is removed if a window over it
also starts in a document with a smaller id, judged on the input.

Reference text grows with the corpus, so its automata are not broadcast whole;
reference and documents meet shard by shard instead:

1. Each window is assigned to its minimizer, the 5-word gram of smallest hash
   inside it (the leftmost of equals). Equal windows have equal minimizers, so
   only grams that occur in two documents can matter; a grouped count finds
   them, and each document gets the list of its shared grams.
2. Around each shared gram a document's segment is cut: the words of all windows
   assigned to it. Equal segments are combined (smallest id) before the shuffle.
3. Segments are dealt by gram. Each task streams over its grams in order and
   packs them into shards of bounded size; a shard's suffix automaton, whose
   states carry the smallest document id of their occurrences, gives matching
   statistics: for each window of each segment, the first document that has it.
4. The answers go back to the documents' segments by a join, then per document
   the windows with an earlier document are merged into maximal spans and cut.

A gram in more than ``hot`` documents is dealt window by window over many
sub-keys, so that no task gets all its segments; the joins are ordinary
shuffles, which AQE splits where one segment occurs very often.

Defined results: null, empty and short texts have no window; rows with a null
id neither remove nor lose words; rows of equal id do not affect each other,
also when their texts are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, IntegralType, LongType, StructField, StructType

from sectorscope.llm.common import as_bytes, discard, map_batches, row_struct, stored, with_fields
from sectorscope.llm.word_hashes import WordBuffer, buffers, normal

WINDOW, GRAM = 13, 5
HOT = 20_000
SHARD_WORDS = 100_000
_SUB_KEYS = 1024
_MUL = np.uint64(0x9E3779B97F4A7C15)


def window_runs(words: WordBuffer, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: gram hash, first window, last window, number of the text.

    A window is named by its first word; all its words are of one text.
    """
    none = np.zeros(0, np.int64)
    n = len(words.hash) - window + 1
    if n <= 0:
        return none.view(np.uint64), none, none, none
    h = words.hash
    grams = np.zeros(len(h) - gram + 1, np.uint64)
    for j in range(gram):
        grams = (grams ^ h[j:j + len(grams)]) * _MUL
        grams ^= grams >> np.uint64(29)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, window - gram + 1):
        other = grams[j:j + n]
        less = np.flatnonzero(other < best)
        best[less] = other[less]
        at[less] = less + j
    whole = np.flatnonzero(words.doc[:n] == words.doc[window - 1:])
    if not len(whole):
        return none.view(np.uint64), none, none, none
    at = at[whole]
    # a window that crosses two texts ends a run, as does a new minimizer
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(whole) != 1)) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [len(at)])) - 1
    return grams[at[first]], whole[first], whole[last], words.doc[whole[first]]


class SuffixAutomaton:
    """Automaton of all substrings of the sequences added; states carry the smallest label of their occurrences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.label = [-1], [0], [None]

    def _state(self, length: int, link: int, edges: dict[int, int], label) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.label.append(label)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of ``q`` for the substrings that reach it through ``p`` and shorter ones."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.label[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int, label) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None:
            state = q if length[q] == length[last] + 1 else self._split(last, c, q)
        else:
            state = self._state(length[last] + 1, 0, {}, label)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = state
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[state] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        old = self.label[state]
        if old is None or label < old:
            self.label[state] = label
        return state

    def add(self, sequence: list[int], label) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c, label)

    def finish(self) -> None:
        """Pass the labels on to the shorter suffixes; call once, after the last ``add``."""
        label, link = self.label, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            p = link[s]
            if p > 0 and (label[p] is None or label[s] < label[p]):
                label[p] = label[s]

    def first_labels(self, sequence: list[int], window: int) -> list:
        """For each window of ``sequence``: the smallest label of the sequences that hold it, or None.

        The walk keeps the longest suffix that occurs here (the matching
        statistic) and reads the label of its last ``window`` symbols.
        """
        nxt, link, length, label = self.next, self.link, self.length, self.label
        state = matched = 0
        out = []
        for i, c in enumerate(sequence):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            if matched > window:
                while length[link[state]] >= window:
                    state = link[state]
                matched = min(matched, length[state])
            if i >= window - 1:
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                out.append(label[s] if matched >= window else None)
        return out


def shard_firsts(groups: list[tuple[list[bytes], list]], window: int) -> list[list]:
    """One shard: (segments, smallest ids) of several grams -> per segment the first id of each window."""
    out: list[list] = []
    numbers: dict[bytes, int] = {}
    automaton = None
    coded = []
    for segments, ids in groups:
        if len(segments) == 1:  # one text only: its smallest id is first for all its windows
            coded.append(None)
            continue
        automaton = automaton or SuffixAutomaton()
        rows = [[numbers.setdefault(w, len(numbers)) for w in s.split(b" ")] for s in segments]
        for row, label in zip(rows, ids):
            automaton.add(row, label)
        coded.append(rows)
    if automaton:
        automaton.finish()
    for (segments, ids), rows in zip(groups, coded):
        if rows is None:
            out.append([ids[0]] * (segments[0].count(b" ") + 2 - window))
        else:
            out += [automaton.first_labels(row, window) for row in rows]
    return out


def _id_type(docs: DataFrame, id_col: str) -> DataType:
    """Whole numbers are compared as long, other ids in their own type."""
    kind = docs.schema[id_col].dataType
    return LongType() if isinstance(kind, IntegralType) else kind


def _store_grams(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> str:
    """Path of ``g, id``: the minimizers of each document."""
    kind = _id_type(docs, id_col)
    packed = (docs.select(F.col(f"`{id_col}`").cast(kind).alias("id"), as_bytes(text_col).alias("raw"))
              .where("id is not null and raw is not null"))
    plain = np.int64 if isinstance(kind, LongType) else object

    def run(batch: dict[str, list]) -> dict[str, list]:
        ids, found = [np.zeros(0, plain)], [np.zeros(0, np.int64)]
        doc_ids = np.array(batch["id"], plain)
        for at, words in buffers(list(map(normal, batch["raw"]))):
            grams, _, _, doc = window_runs(words, window, gram)
            order = np.lexsort((grams, doc))
            grams, doc = grams[order], doc[order]
            # once a document
            once = np.concatenate(([True], (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])))[:len(grams)]
            found.append(grams[once].view(np.int64))
            ids.append(doc_ids[at + doc[once]])
        return {"g": np.concatenate(found), "id": np.concatenate(ids)}

    schema = StructType([StructField("g", LongType()), StructField("id", kind)])
    return stored(map_batches(packed, run, schema), "gram-rows")[1]


def _store_shared(spark: SparkSession, grams_path: str, hot: int) -> str:
    """Path of ``id``, ``grams``, ``hot_grams``: each document's minimizers that another row has too."""
    rows = spark.read.parquet(grams_path)
    shared = rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g", (F.col("n") > hot).alias("hot"))
    return stored(rows.join(shared, "g").groupBy("id")
                  .agg(F.collect_set(F.when(~F.col("hot"), F.col("g"))).alias("grams"),
                       F.collect_set(F.when(F.col("hot"), F.col("g"))).alias("hot_grams")), "grams")[1]


def _store_segments(texts: DataFrame, shared_path: str, window: int, gram: int) -> str:
    """Path of ``g, sub, sh, seg, id, tie, at`` (``sh``: hash of ``seg``): the segments round shared grams."""
    joined = texts.select("id", "tie", "raw").join(texts.sparkSession.read.parquet(shared_path), "id")

    def run(batch: dict[str, list]) -> dict[str, list]:
        import xxhash
        out: dict[str, list] = {c: [] for c in ("g", "sub", "sh", "seg", "id", "tie", "at")}

        def put(g: int, sub: int, seg: bytes, doc: int, at: int) -> None:
            for c, v in zip(out, (g, sub, xxhash.xxh64_intdigest(seg) - (1 << 63), seg, batch["id"][doc],
                                  batch["tie"][doc], at)):
                out[c].append(v)

        # a gram is shared or not for all documents alike
        cold, hot = (np.unique(np.fromiter((g for gs in batch[c] for g in gs), np.int64)).view(np.uint64)
                     for c in ("grams", "hot_grams"))
        for at, words in buffers(list(map(_unpack, batch["raw"]))):
            grams, first, last, doc = window_runs(words, window, gram)
            begin = np.searchsorted(words.doc, np.arange(words.doc[-1] + 1 if len(words.doc) else 0))
            for few, is_hot in ((cold, False), (hot, True)):
                pick = np.isin(grams, few)
                for g, a, b, d in zip(grams[pick].view(np.int64).tolist(), first[pick].tolist(), last[pick].tolist(),
                                      doc[pick].tolist()):
                    if not is_hot:
                        put(g, -1, words.words(a, b + window), at + d, a - int(begin[d]))
                    else:
                        for i in range(a, b + 1):
                            seg = words.words(i, i + window)
                            put(g, xxhash.xxh32_intdigest(seg) % _SUB_KEYS, seg, at + d, i - int(begin[d]))
        return out

    schema = StructType([*StructType.fromDDL("g bigint, sub int, sh bigint, seg binary").fields, joined.schema["id"],
                         *StructType.fromDDL("tie bigint, at int").fields])
    return stored(map_batches(joined, run, schema), "segments")[1]


def _store_hits(spark: SparkSession, segments_path: str, window: int, shard_words: int) -> str:
    """Path of ``id, tie, starts``: the windows of each document that an earlier document has."""
    segments = spark.read.parquet(segments_path)
    asked = segments.select("g", "sub", "sh", "id", "tie", "at")
    hits = (asked.join(_answers(segments, window, shard_words), ["g", "sub", "sh"])
            .select("id", "tie", F.expr("filter(transform(firsts, (f, i) -> if(f < id, at + i, -1)), s -> s >= 0)")
                    .alias("starts"))
            .where(F.size("starts") > 0)
            .groupBy("id", "tie").agg(F.array_distinct(F.flatten(F.collect_set("starts"))).alias("starts")))
    return stored(hits, "repeats")[1]


def _answers(segments: DataFrame, window: int, shard_words: int) -> DataFrame:
    """``g, sub, sh, firsts``: for each distinct segment (by hash) the first document of each of its windows."""
    kind = segments.schema["id"].dataType
    firsts_type = pa.list_(to_arrow_type(kind))
    distinct = (segments.groupBy("g", "sub", "seg").agg(F.min("id").alias("id"))
                .repartition("g", "sub").sortWithinPartitions("g", "sub"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        keys: list[tuple[int, int]] = []
        groups: list[tuple[list[bytes], list]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            firsts = shard_firsts(groups, window)
            g = [k[0] for k, (s, _) in zip(keys, groups) for _ in s]
            sub = [k[1] for k, (s, _) in zip(keys, groups) for _ in s]
            sh = [xxhash.xxh64_intdigest(x) - (1 << 63) for s, _ in groups for x in s]
            return pa.RecordBatch.from_arrays(
                [pa.array(g, pa.int64()), pa.array(sub, pa.int32()), pa.array(sh, pa.int64()),
                 pa.array(firsts, firsts_type)], names=["g", "sub", "sh", "firsts"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in range(4)]
            for g, sub, seg, doc in zip(*cols):
                if not keys or keys[-1] != (g, sub):
                    if size >= shard_words:
                        yield flush()
                        keys, groups, size = [], [], 0
                    keys.append((g, sub))
                    groups.append(([], []))
                groups[-1][0].append(seg)
                groups[-1][1].append(doc)
                size += seg.count(b" ") + 1
        if keys:
            yield flush()

    schema = StructType([*StructType.fromDDL("g bigint, sub int, sh bigint").fields, StructField("firsts", ArrayType(kind))])
    return distinct.select("g", "sub", "seg", "id").mapInArrow(run, schema)


def _pack(raw: bytes | None) -> bytes | None:
    import zstandard
    return None if raw is None else zstandard.ZstdCompressor(level=1).compress(normal(raw))


def _unpack(raw: bytes | None) -> bytes:
    import zstandard
    return b"" if raw is None else zstandard.ZstdDecompressor().decompress(raw)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ("doc_id",),
                 window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per input row: ``row`` (struct of ``carry``), ``raw`` (compressed, words joined by a blank), ``starts``.

    ``starts`` holds the word numbers at which windows start that an earlier document has.
    """
    packed = docs.select(F.struct(row_struct(carry), F.col(f"`{id_col}`").cast(_id_type(docs, id_col)).alias("id"),
                                  F.xxhash64(F.col(f"`{text_col}`")).alias("tie")).alias("row"),
                         as_bytes(text_col).alias("raw"))
    texts = map_batches(packed, lambda b: {"row": b["row"], "raw": [_pack(r) for r in b["raw"]]},
                        with_fields(packed, "row", "raw binary")).select("row.row", "row.id", "row.tie", "raw")
    spark = docs.sparkSession
    # each step's input goes when it is done; the frames it came from are out of scope by then
    grams = _store_grams(docs, id_col, text_col, window, gram)
    shared = _store_shared(spark, grams, hot)
    discard(spark, grams)
    segments = _store_segments(texts, shared, window, gram)
    discard(spark, shared)
    found = _store_hits(spark, segments, window, shard_words)
    discard(spark, segments)
    hits = spark.read.parquet(found)
    return texts.join(hits, ["id", "tie"], "left").select("row", "raw", "starts")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ("doc_id",),
                   window: int = WINDOW, **options) -> DataFrame:
    """One row per input row: ``row``, ``n_words``, ``n_removed``, ``spans`` and ``kept`` (bytes, words joined by a blank).

    ``spans`` are the maximal removed word ranges, as (start, end) pairs.
    """
    found = find_repeats(docs, id_col, text_col, carry, window, **options)

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"row": batch["row"], "n_words": [], "n_removed": [], "spans": [], "kept": []}
        for raw, starts in zip(batch["raw"], batch["starts"]):
            text = _unpack(raw)
            if not starts:
                out["n_words"].append(text.count(b" ") + bool(text))
                out["n_removed"].append(0)
                out["spans"].append([])
                out["kept"].append(text)
                continue
            words = text.split(b" ")
            spans: list[list[int]] = []
            for s in sorted(starts):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + window
                else:
                    spans.append([s, s + window])
            kept, at = [], 0
            for a, b in spans:
                kept += words[at:a]
                at = b
            kept += words[at:]
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["spans"].append(spans)
            out["kept"].append(b" ".join(kept))
        return out

    return map_batches(found, run, with_fields(
        found, "row", "n_words bigint, n_removed bigint, spans array<array<int>>, kept binary"))
