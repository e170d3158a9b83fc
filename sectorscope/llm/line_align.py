"""Line dedup by pairwise alignment.

A document loses every line of a run of consecutive lines that counts and that
an earlier document has. A run counts if it holds a rare line (at most
``rare_share`` of all documents have it), has ``common_lines`` lines or
``block_words`` words, or is the whole document; frequency thus protects only
short runs of few words.

Documents with equal lines are grouped first: all but the earliest go whole,
and only that one is compared further. Every run that counts is a union of
short ones (a rare line, a rare line with frequent ones, ``common_lines``
lines, ``block_words`` words), and each short run belongs to its owner, the
earliest document that has it. A document is paired with the owners of its
runs, so pairs grow with the lines. The shared lines of a pair are aligned with
patience diff: lines unique on both sides are matched in their longest
increasing order, and the gaps between them are aligned in the same way.
Aligned lines that are consecutive on both sides form a block; blocks that
count are deleted from the later document. A run that its owner has but that
this alignment leaves, because it crosses or repeats others, is aligned by
itself: matched with its place in the owner, extended over equal lines on both
sides, and deleted. So no other earlier document needs to be looked at.

A document is (id, text); the earlier one has the smaller id, then the smaller
text hash. Lines are cut at ``\\n``; blank lines are neither matched nor
removed, and are skipped in telling what is consecutive. Defined results: null
texts have no lines and stay null; equal rows get equal results; rows with a
null id come after all others; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorscope.llm.common import WS_CHARS, as_bytes, delete_table, map_batches, row_struct, stored, with_fields

_WS = WS_CHARS.encode()


@dataclass(frozen=True)
class AlignRules:
    rare_share: float = 0.05
    common_lines: int = 3
    block_words: int = 50


def lines_of(raw: bytes | None) -> list[bytes]:
    return [] if raw is None else raw.split(b"\n")


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned index pairs of two hash sequences, increasing on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
        anchors = _longest_increasing([(i, once_b[h]) for h, i in once_a.items() if h in once_b])
        if not anchors:
            continue
        at_a, at_b = a0, b0
        for i, j in [*anchors, (a1, b1)]:
            if i > at_a and j > at_b:
                todo.append((at_a, i, at_b, j))
            at_a, at_b = i + 1, j + 1
        out += anchors
    return sorted(out)


def _once(seq: list[int], lo: int, hi: int) -> dict[int, int]:
    """Position of each hash that occurs once in the range, in order."""
    found: dict[int, int] = {}
    for i in range(lo, hi):
        found[seq[i]] = -1 if seq[i] in found else i
    return {h: i for h, i in found.items() if i >= 0}


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs (sorted by the first) that increases in the second."""
    tails: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect.bisect_left(tails, j)
        back.append(piles[p - 1] if p else -1)
        if p == len(tails):
            tails.append(j)
            piles.append(k)
        else:
            tails[p], piles[p] = j, k
    chain, k = [], piles[-1] if piles else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def words_of(line: bytes) -> int:
    """The words of a line, or its bytes / 16 if that is more (scripts without spaces, encoded blobs)."""
    return max(len(line.split()), len(line) // 16)


def aligned_blocks(mine: list[int], words: list[int], theirs: list[int], frequent: frozenset[int],
                   rules: AlignRules) -> set[int]:
    """Line ranks to delete from one document (hashes and words of its non-blank lines) by an earlier one (hashes)."""
    shared = set(mine) & set(theirs)
    here = [(p, h) for p, h in enumerate(mine) if h in shared]
    there = [(p, h) for p, h in enumerate(theirs) if h in shared]
    gone: set[int] = set()
    block: list[tuple[int, int]] = []
    for i, j in [*patience([h for _, h in here], [h for _, h in there]), (-1, -1)]:
        at = (here[i][0], there[j][0]) if i >= 0 else None
        if block and at != (block[-1][0] + 1, block[-1][1] + 1):
            if counts(mine, words, block[0][0], len(block), frequent, rules):
                gone.update(p for p, _ in block)
            block = []
        if at:
            block.append(at)
    return gone


def anchored_block(mine: list[int], theirs: list[int], at: int, size: int, places: list[int]) -> range:
    """The block around the run of ``size`` lines from rank ``at`` of one document, at the first of ``places`` where the
    other has it, extended over equal lines on both sides."""
    run = mine[at:at + size]
    there = next((j for j in places if theirs[j:j + size] == run), None)
    if there is None:
        return range(0)
    lo, hi = 0, size
    while lo < min(at, there) and mine[at - lo - 1] == theirs[there - lo - 1]:
        lo += 1
    while at + hi < len(mine) and there + hi < len(theirs) and mine[at + hi] == theirs[there + hi]:
        hi += 1
    return range(at - lo, at + hi)


def removed_by(mine: list[int], words: list[int], theirs: list[int], runs: list[tuple[int, int]], frequent: frozenset[int],
               rules: AlignRules) -> set[int]:
    """Line ranks to delete from one document by an earlier one that owns the ``runs`` (rank and size) of the first."""
    gone = aligned_blocks(mine, words, theirs, frequent, rules)
    left = [(at, size) for at, size in runs if not gone.issuperset(range(at, at + size))]
    if left:
        places: dict[int, list[int]] = {mine[at]: [] for at, _ in left}
        for j, h in enumerate(theirs):
            if h in places:
                places[h].append(j)
        for at, size in left:
            if not gone.issuperset(range(at, at + size)):
                gone.update(anchored_block(mine, theirs, at, size, places[mine[at]]))
    return gone


def counts(seq: list[int], words: list[int], at: int, size: int, frequent: frozenset[int], rules: AlignRules) -> bool:
    """Whether a block of ``size`` lines from rank ``at`` is deleted."""
    return (size >= min(rules.common_lines, len(seq)) or sum(words[at:at + size]) >= rules.block_words
            or any(h not in frequent for h in seq[at:at + size]))


def block_runs(seq: list[int], words: list[int], frequent: frozenset[int], rules: AlignRules) -> list[tuple[int, int, int]]:
    """The shortest runs that make a block count, as (hash, rank, size).

    Every block that counts is a union of such runs, so a document that loses a line shares one of them that covers it.
    """
    import xxhash
    out: list[tuple[int, int, int]] = []
    for size in range(1, min(rules.common_lines, len(seq)) + 1):
        for at in range(len(seq) - size + 1):
            part = seq[at:at + size]
            # a longer run of rare lines only is covered by its lines
            if (size > 1 and not any(h in frequent for h in part)) or not counts(seq, words, at, size, frequent, rules):
                continue
            run = part[0] if size == 1 else xxhash.xxh64_intdigest(struct.pack(f"<{size}q", *part)) - (1 << 63)
            out.append((run, at, size))
    return out


def removed_lines(docs: DataFrame, id_col: str, text_col: str, rules: AlignRules) -> DataFrame:
    """``key`` and ``gone`` (line ranks) of each document that loses a line; written once, and all that led to it deleted."""
    spark, paths = docs.sparkSession, []

    def keep(df: DataFrame, label: str) -> DataFrame:
        table, path = stored(df, label)
        paths.append(path)
        return table

    rare_df = max(1, int(rules.rare_share * docs.count()))
    every = keep(line_hashes(docs, id_col, text_col), "line-hashes")
    # read back from tables, so that AQE can split a join on what very many documents have
    firsts = keep(every.groupBy("seq", "n_lines").agg(F.min("key").alias("first"), F.sum("n_rows").alias("n_rows")), "line-firsts")
    by_first = every.join(firsts, ["seq", "n_lines"])
    copies = (by_first.where(F.col("key") != F.col("first"))
              .select("key", F.sequence(F.lit(0), F.col("n_lines") - 1).alias("gone")))
    alone = keep(by_first.where(F.col("key") == F.col("first")).select("key", "lines", "words", firsts["n_rows"]), "line-alone")

    # at most mean lines of a document / rare_share hashes
    frequent = frozenset(r["h"] for r in alone.select(F.explode(F.array_distinct("lines")).alias("h"), "n_rows")
                         .groupBy("h").agg(F.sum("n_rows").alias("df")).where(F.col("df") > rare_df).select("h").collect())

    def find_runs(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"key": [], "run": [], "at": [], "size": []}
        for key, seq, words in zip(batch["key"], batch["lines"], batch["words"]):
            for run, at, size in block_runs(seq, words, frequent, rules):
                out["key"].append(key)
                out["run"].append(run)
                out["at"].append(at)
                out["size"].append(size)
        return out

    runs = keep(map_batches(alone, find_runs, with_fields(alone, "key", "run bigint, at int, size int")), "line-runs")
    owners = keep(runs.groupBy("run").agg(F.min("key").alias("owner"), F.max("key").alias("last"))
                  .where(F.col("owner") != F.col("last")).drop("last"), "line-owners")
    # one row per document and owner, with what the owner has of it
    pairs = keep(runs.join(owners, "run").where(F.col("key") != F.col("owner")).groupBy("key", "owner")
                 .agg(F.collect_list(F.struct("at", "size")).alias("runs")), "line-pairs")
    done, _ = stored(copies.unionByName(_aligned(pairs, alone, frequent, rules)), "line-gone")
    for path in paths:
        delete_table(spark, path)
    return done


def _aligned(pairs: DataFrame, alone: DataFrame, frequent: frozenset[int], rules: AlignRules) -> DataFrame:
    """``key`` and ``gone`` by the alignments of each ``key`` with its ``owner``s."""
    both = (pairs.join(alone.select("key", F.col("lines").alias("mine"), "words"), "key")
            .join(alone.select(F.col("key").alias("owner"), F.col("lines").alias("theirs")), "owner")
            .select("key", "mine", "words", "theirs", "runs"))

    def align(batch: dict[str, list]) -> dict[str, list]:
        return {"key": batch["key"], "gone": [
            sorted(removed_by(a, w, b, [(r["at"], r["size"]) for r in runs], frequent, rules))
            for a, w, b, runs in zip(*(batch[c] for c in ("mine", "words", "theirs", "runs")))]}

    aligned = map_batches(both, align, with_fields(both, "key", "gone array<int>")).where(F.size("gone") > 0)
    return aligned.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("gone"))).alias("gone"))


def _key(id_col: str, text_col: str):
    doc = F.col(f"`{id_col}`")
    return F.struct(doc.isNull().alias("no_id"), doc.alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("tie"))


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key``, ``n_lines``, ``seq`` (hash of all), ``lines`` and ``words`` (hashes and words of the non-blank lines), ``n_rows``."""
    packed = docs.select(_key(id_col, text_col).alias("key"), as_bytes(text_col).alias("raw")).where("raw is not null")

    def run(batch: dict[str, list]) -> dict[str, list]:
        import xxhash
        out: dict[str, list] = {"key": [], "n_lines": [], "seq": [], "lines": [], "words": []}
        for key, raw in zip(batch["key"], batch["raw"]):
            lines = [line for line in lines_of(raw) if line.strip(_WS)]
            seq = [xxhash.xxh64_intdigest(line) - (1 << 63) for line in lines]
            if seq:
                out["key"].append(key)
                out["n_lines"].append(len(seq))
                out["seq"].append(xxhash.xxh64_intdigest(struct.pack(f"<{len(seq)}q", *seq)) - (1 << 63))
                out["lines"].append(seq)
                out["words"].append([words_of(line) for line in lines])
        return out

    rows = map_batches(packed, run, with_fields(packed, "key", "n_lines int, seq bigint, lines array<bigint>, words array<int>"))
    return rows.groupBy("key", "n_lines", "seq").agg(F.first("lines").alias("lines"), F.first("words").alias("words"),
                                                    F.count("*").alias("n_rows"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ("doc_id",),
                rules: AlignRules = AlignRules()) -> DataFrame:
    """One row per input row: ``row`` (struct of ``carry``), ``n_lines``, ``n_removed``, ``clean_text``.

    A document without a removed line keeps its text as it is.
    """
    removed = (removed_lines(docs, id_col, text_col, rules)
               .select(F.col("key.id").alias("id"), F.col("key.no_id").alias("no_id"), F.col("key.tie").alias("tie"), "gone"))
    key = _key(id_col, text_col)
    joined = (docs.select(row_struct(carry), as_bytes(text_col).alias("raw"), key["id"].alias("id"),
                          key["no_id"].alias("no_id"), key["tie"].alias("tie")).alias("d")
              # one plan at every size: the texts are shuffled, whether or not what is removed would fit a broadcast
              .join(removed.hint("merge").alias("r"), F.col("d.id").eqNullSafe(F.col("r.id")) & (F.col("d.no_id") == F.col("r.no_id"))
                    & (F.col("d.tie") == F.col("r.tie")), "left").select("d.row", "d.raw", "r.gone"))

    def cut(batch: dict[str, list]) -> dict[str, list]:
        total, removed_n, clean = [], [], []
        for raw, gone in zip(batch["raw"], batch["gone"]):
            drop, kept, rank = set(gone or ()), [], 0
            for line in lines_of(raw):
                blank = not line.strip(_WS)
                if blank or rank not in drop:
                    kept.append(line)
                rank += not blank
            total.append(rank)
            removed_n.append(len(drop))
            clean.append(None if raw is None else b"\n".join(kept).decode("utf-8", "replace"))
        return {"row": batch["row"], "n_lines": total, "n_removed": removed_n, "clean_text": clean}

    return map_batches(joined, cut, with_fields(joined, "row", "n_lines bigint, n_removed bigint, clean_text string"))


def remove_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        rules: AlignRules = AlignRules()) -> DataFrame:
    """The documents without their deleted blocks; those left without a word go. Columns as the input's.

    A document that had no line to delete stays, also an empty or null one.
    """
    done = dedup_lines(docs, id_col, text_col, tuple(c for c in docs.columns if c != text_col), rules)
    kept = done.where((F.col("n_removed") == 0) | F.col("clean_text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[F.col("clean_text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c)
                         for c in docs.columns])
