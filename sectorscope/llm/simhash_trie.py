"""SimHash near-duplicates by a self-join of binary tries.

Each text gets a 64-bit fingerprint of its word shingles; fingerprints at most
``radius`` bits apart are linked, and links are closed to components.

The trie of all fingerprints is cut into parts that tasks can hold. Of
``radius + 1`` bit blocks at least one is equal in any linked pair, so each
fingerprint joins one trie per block, keyed by the block's value. Inside a
trie, node pairs are walked down together: bits in which the two sides differ
are added up, and a pair is dropped when they exceed the radius, or when both
sides already lie in one component. A key with more than ``trie_size``
fingerprints is first cut by its next bits into node pairs within the radius,
and so on until every node pair is small, each its own task.

A task returns one link per fingerprint to its local root, never all pairs of
a group, and equal texts count as one fingerprint, so links grow with the
number of distinct fingerprints.

Defined results: null, empty and word-free texts have fingerprint zero and are
linked like any other; a text with fewer words than a shingle is one shingle;
rows with a null id take part, and get the component of their fingerprint
(null if no row of it has an id); repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorscope.llm.common import as_bytes, delete_table, map_batches, row_struct, stored, with_fields
from sectorscope.llm.components import components
from sectorscope.session import materialize

SHINGLE, RADIUS = 4, 4
TRIE_SIZE = 20_000
_SPLIT_BITS = 6
#: Node pairs with at most this many member pairs are compared directly.
_DIRECT = 1024


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text (A-Z lowered): a bit is set if it is in over half the shingles' hashes."""
    import xxhash
    words = [] if raw is None else raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends))[:n].tolist()
    stops = (ends[shingle - 1:] - 1 if len(words) >= shingle else ends[-1:] - 1).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(text[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",),
                 shingle: int = SHINGLE) -> DataFrame:
    """``row`` (struct of ``carry``) and ``fp``, the fingerprint's bits as a signed long."""
    return _printed(docs.select(row_struct(carry), as_bytes(text_col).alias("raw")), shingle)


def _printed(packed: DataFrame, shingle: int) -> DataFrame:
    def run(batch: dict[str, list]) -> dict[str, list]:
        fps = np.array([fingerprint(raw, shingle) for raw in batch["raw"]], np.uint64)
        return {"row": batch["row"], "fp": fps.view(np.int64)}

    return map_batches(packed, run, with_fields(packed, "row", "fp bigint"))


def _join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the components of ``i`` and ``j`` in place; ``root`` stays flat."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def trie_roots(fps: np.ndarray, radius: int = RADIUS, step: int = 1 << 15) -> np.ndarray:
    """For sorted distinct unsigned fingerprints: the index of the first member of each one's component.

    A trie node is a range of the sorted array that shares its upper bits;
    pairs of nodes are held as arrays and walked from the top bit down, at
    most ``step`` pairs at a time.
    """
    n = len(fps)
    root = np.arange(n)
    one = np.uint64(1)
    todo = [(63, np.array([[0, n, 0, n, 0]], np.int64))] if n > 1 else []
    while todo:
        bit, pairs = todo.pop()
        if len(pairs) > step:
            todo += [(bit, pairs[step:]), (bit, pairs[:step])]
            continue
        a0, a1, b0, b1, diff = pairs.T
        # both sides in one component: nothing left to link
        change = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))
        done = (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0]) & (root[a0] == root[b0])
        pairs = pairs[~done]
        if not len(pairs):
            continue
        a0, a1, b0, b1, diff = pairs.T
        few = (a1 - a0) * (b1 - b0) <= _DIRECT
        leaves = pairs[few]
        piece = np.cumsum((leaves[:, 1] - leaves[:, 0]) * (leaves[:, 3] - leaves[:, 2])) >> 20
        for part in np.split(leaves, np.flatnonzero(np.diff(piece)) + 1) if len(leaves) else ():
            x0, x1, y0, y1, _ = part.T
            size = (x1 - x0) * (y1 - y0)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            width = np.repeat(y1 - y0, size)
            i, j = np.repeat(x0, size) + k // width, np.repeat(y0, size) + k % width
            near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
            _join_roots(root, i[near], j[near])
        pairs = pairs[~few]
        if not len(pairs):
            continue
        a0, a1, b0, b1, diff = pairs.T
        high, mask = np.uint64(bit + 1), one << np.uint64(bit)

        def middle(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            upper = (fps[lo] >> high) << high if bit < 63 else np.zeros(len(lo), np.uint64)
            return np.clip(np.searchsorted(fps, upper | mask), lo, hi)

        am, bm = middle(a0, a1), middle(b0, b1)
        same = np.concatenate((np.stack((a0, am, b0, bm, diff), 1), np.stack((am, a1, bm, b1, diff), 1)))
        self_pair = a0 == b0
        cross = np.concatenate((np.stack((a0, am, bm, b1, diff + 1), 1),
                                np.stack((am, a1, b0, bm, diff + 1), 1)[~self_pair]))
        for part in (cross, same):
            part = part[(part[:, 1] > part[:, 0]) & (part[:, 3] > part[:, 2]) & (part[:, 4] <= radius)]
            if len(part):
                todo.append((bit - 1, part))
    return root


def _blocks(radius: int) -> list[tuple[int, int]]:
    """``radius + 1`` bit blocks as (shift, width)."""
    cuts = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


_KEY = ["block", "value", "level", "lo", "hi"]


def _without_block(shift: int, width: int) -> Column:
    """The bits of ``fp`` outside a block, as one number of ``64 - width`` bits."""
    low = F.col("fp").bitwiseAND(F.lit((1 << shift) - 1))
    if shift + width == 64:
        return low
    return F.shiftleft(F.shiftrightunsigned("fp", shift + width), shift).bitwiseOR(low)


def _path(level: Column | int, block_width: Column) -> Column:
    """The first ``level`` times ``_SPLIT_BITS`` bits of ``rest``: the trie node of that depth."""
    below = F.greatest(F.lit(0), F.lit(64) - block_width - F.lit(level) * _SPLIT_BITS)
    return F.call_function("shiftrightunsigned", F.col("rest"), below.cast("int"))


def _bits_at(level: int, block_width: Column) -> Column:
    """How many bits the cut to ``level`` adds to a path (fewer at the end of the fingerprint)."""
    return F.least(F.lit(_SPLIT_BITS), F.greatest(F.lit(0), F.lit(64) - block_width - (level - 1) * _SPLIT_BITS))


def _cut(parts: DataFrame, level: int, radius: int) -> DataFrame:
    """Node pairs one cut deeper: each member goes to the pairs of its node with all nodes that the error budget allows."""
    bits = _bits_at(level, F.col("width"))
    masks = F.array(*[F.struct(F.lit(m).cast("bigint").alias("bits"), F.lit(m.bit_count()).alias("n"))
                      for m in range(1 << _SPLIT_BITS) if m.bit_count() <= radius])
    budget = F.lit(radius) - F.bit_count(F.col("lo").bitwiseXOR(F.col("hi")))
    fits = F.filter(masks, lambda m: (m["n"] <= budget) & (m["bits"] < F.call_function("shiftleft", F.lit(1).cast("bigint"), bits.cast("int"))))
    own = _path(level, F.col("width"))
    up = lambda x: F.call_function("shiftleft", x, bits.cast("int"))
    before = _path(level - 1, F.col("width"))
    # of a pair of two nodes the other one than its own, of a node with itself that node
    other = F.when(before == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    node = own.bitwiseAND(up(F.lit(1).cast("bigint")) - 1)
    rows = (parts.select("block", "width", "value", "rest", "fp", "lo", "hi", own.alias("own"), other.alias("other"), node.alias("node"),
                         F.explode(fits).alias("mask"))
            .withColumn("there", up(F.col("other")).bitwiseOR(F.col("node").bitwiseXOR(F.col("mask.bits")))))
    # of two nodes with one parent the smaller one is "lo"; deeper pairs keep the order of their parents
    swap = F.when(F.col("lo") == F.col("hi"), F.col("own") > F.col("there")).otherwise(before == F.col("hi"))
    return rows.select("block", "width", "value", F.lit(level).alias("level"),
                       F.when(swap, F.col("there")).otherwise(F.col("own")).alias("lo"),
                       F.when(swap, F.col("own")).otherwise(F.col("there")).alias("hi"), "rest", "fp")


def node_pairs(fps: DataFrame, radius: int, trie_size: int, tables: list[str]) -> DataFrame:
    """``_KEY`` and ``fp`` (the paths of tables it reads are added to ``tables``): for each bit block and value the members of its trie; tries of over ``trie_size`` members are
    cut into pairs of nodes, and those again, until all are small or no bit is left (then a pair has two members)."""
    tries = F.array(*[F.struct(F.lit(k).alias("block"), F.lit(width).alias("width"),
                               F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)).alias("value"),
                               _without_block(shift, width).alias("rest")) for k, (shift, width) in enumerate(_blocks(radius))])
    zero = F.lit(0).cast("bigint")
    parts = fps.select("fp", F.explode(tries).alias("t")).select(
        "t.block", "t.width", "t.value", F.lit(0).alias("level"), zero.alias("lo"), zero.alias("hi"), "t.rest", "fp")
    done = []
    for level in range(1, -(-64 // _SPLIT_BITS) + 1):
        own = _path(level - 1, F.col("width"))
        sizes = parts.groupBy(*_KEY).agg(F.count("*").alias("n"), F.count_if(own == F.col("lo")).alias("n_lo"),
                                         F.count_if(own == F.col("hi")).alias("n_hi"))
        # a table, so that AQE can split a join on a very common key; pairs with one side only have no links
        pairs, path = stored(sizes.where((F.col("n") > 1) & (F.col("n_lo") > 0) & (F.col("n_hi") > 0))
                             .select(*_KEY, (F.col("n") > trie_size).alias("large")), "simhash-pairs")
        tables.append(path)
        large = pairs.where("large").select(*_KEY)
        if not large.take(1):
            break
        done.append(parts.join(pairs.where("NOT large").select(*_KEY), _KEY, "left_semi").select(*_KEY, "fp"))
        parts, path = stored(_cut(parts.join(large, _KEY), level, radius), "simhash-nodes")
        tables.append(path)
    return reduce(DataFrame.unionByName, [*done, parts.select(*_KEY, "fp")])


def trie_links(fps: DataFrame, radius: int = RADIUS, trie_size: int = TRIE_SIZE, tables: list[str] | None = None) -> DataFrame:
    """Links ``u, v`` between the distinct fingerprints of ``fps`` (column ``fp``): each to a root in its trie."""
    cut = node_pairs(fps, radius, trie_size, [] if tables is None else tables)
    key = _KEY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def links(parts: list[np.ndarray]) -> pa.RecordBatch | None:
            values = np.unique(np.concatenate(parts).view(np.uint64))
            root = trie_roots(values, radius)
            linked = root != np.arange(len(values))
            if not linked.any():
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array(values[linked].view(np.int64)), pa.array(values[root[linked]].view(np.int64))],
                names=["u", "v"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(len(key))], 1)
            fp = batch.column(len(key)).to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(fp)]):
                if a == b:
                    continue
                now = tuple(keys[a])
                if now != last:
                    if held and sum(map(len, held)) > 1 and (out := links(held)) is not None:
                        yield out
                    last, held = now, []
                held.append(fp[a:b])
        if held and (out := links(held)) is not None:
            yield out

    return (cut.select(*[F.col(c).cast("bigint").alias(c) for c in key], "fp")
            .repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "u bigint, v bigint"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                    carry: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE, radius: int = RADIUS,
                    trie_size: int = TRIE_SIZE) -> DataFrame:
    """One row per input row: ``row`` (struct of ``carry``), ``fingerprint`` (hexadecimal), ``component_id``
    (and the row's ``id`` and text hash ``tie``).

    ``component_id`` is the smallest id reachable over links, the row's own included.
    """
    text = F.col(f"`{text_col}`")
    printed = _printed(docs.select(
        F.struct(row_struct(carry), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tie")).alias("row"),
        as_bytes(text_col).alias("raw")), shingle)
    printed = materialize(printed.select("row.row", "row.id", "row.tie", "fp"), "simhash")
    firsts = materialize(printed.groupBy("fp").agg(F.min("id").alias("first")), "simhash-first")
    tables: list[str] = []
    roots = components(trie_links(firsts, radius, trie_size, tables), "simhash-links")
    for path in tables:
        delete_table(docs.sparkSession, path)
    placed = (firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    smallest = materialize(placed.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    classes = placed.join(smallest, "root").select("fp", "component_id")
    return (printed.join(classes, "fp")
            .select("row", "id", "tie", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_representatives(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE,
                         radius: int = RADIUS) -> DataFrame:
    """One document of each component: the one with the component's id. Columns as the input's.

    Of several rows with that id the one of smallest text hash stays, of equal texts the row that is smallest as JSON.
    Documents of a component without any id all stay.
    """
    rows = materialize(near_duplicates(docs, text_col, id_col, (id_col,), shingle, radius).drop("row"), "simhash-classes")
    first = rows.where("id = component_id").groupBy("id").agg(F.min("tie").alias("tie"))
    nameless = rows.where("component_id is null").select("tie").distinct()
    packed = docs.select(row_struct(docs.columns), F.col(f"`{id_col}`").alias("id"),
                         F.xxhash64(F.col(f"`{text_col}`")).alias("tie"))
    kept = packed.join(first, ["id", "tie"]).groupBy("id", "tie").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    others = packed.where("id is null").join(nameless, "tie", "left_semi").select("row")
    return kept.unionByName(others).select("row.*")
