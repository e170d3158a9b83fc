"""Join-based scorer for lexicons too large to fold into the plan as literals.

Same semantics as the literal scorer (non-overlapping substring counts, no
word boundaries) but the lexicon is a table of any size and texts meet
keywords through an equi-join, never a cross join:

1. every keyword gets an *anchor*, one of its grams: of all its runs of
   ``min(length, GRAM)`` characters the one that stands at fewest places
   of the texts, counted over all texts. A keyword with a gram that no text holds
   cannot occur and is left out;
2. texts are cut into overlapping blocks of bounded size, a few of them at a
   time in an Arrow batch; every position's grams (one a class of anchor
   lengths) are hashed and tested against a bit set of the anchors, as arrays,
   so that only positions that can match become rows, with the characters
   around them;
3. these rows join the keywords on the anchor's hash (a small table that Spark may
   broadcast within its own bound, else a shuffle of the few rows), and a hit
   is a keyword that stands around its anchor;
4. hits are counted per (id, category) with a partial aggregate; keywords that
   can overlap themselves ("aa", "abab") count greedily over their sorted
   positions, which matches ``str.count``;
5. per-category scores and found lists are assembled per id (at most one
   entry per category) from these and one base row a text, so that texts
   without hits still give a result. Texts are never joined back.

A lexicon table has ``cat_ord``, ``category``, ``kw_ord``, ``keyword``.
Defined results: ordinals may have gaps, only their order counts; rows with a
null category or ordinal of one and null or empty keywords (or ones holding
NUL) are left out; a keyword that a category has twice (in lower case) counts
once, under its smallest ordinal; null keyword ordinals come last; two names of
one ordinal or two ordinals of one name are an error; an empty lexicon finds
nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sectorscope.functions.lexicon import GENERIC_WORDS, Lexicon
from sectorscope.functions.text import has_word
from sectorscope.operators.classify import RESULT_COLUMNS, _decision, let
from sectorscope.session import materialize

#: Longest anchor, characters of a block, and the bounds of the bit set (bits an anchor, at least, at most).
GRAM = 6
BLOCK = 1 << 18
BITS_PER_ANCHOR, LEAST_BITS, MOST_BITS = 32, 1 << 14, 1 << 24
_NUL = "\u0000"


# ---- the lexicon ------------------------------------------------------------------

def table_lexicon(lex_df: DataFrame, generic: tuple[str, ...] = tuple(GENERIC_WORDS)) -> Lexicon:
    """The categories of a lexicon table, in the order of their ordinals; the keywords stay in the table."""
    cats = [(r["cat_ord"], r["category"]) for r in _categories(lex_df).orderBy("cat_ord").collect()]
    if len({o for o, _ in cats}) < len(cats) or len({c for _, c in cats}) < len(cats):
        raise ValueError("a category with two ordinals, or an ordinal with two categories")
    return Lexicon(tuple(c for _, c in cats), tuple(() for _ in cats), generic)


def _categories(lex_df: DataFrame) -> DataFrame:
    return lex_df.select("cat_ord", "category").dropna().distinct()


def _keywords(lex_df: DataFrame, lex: Lexicon) -> DataFrame:
    """``cat`` (rank of the category, 0 for generic words), ``kw_ord``, ``keyword``, ``m`` (matched form), ``klen``, ``self_overlap``."""
    spark = lex_df.sparkSession
    ranks = spark.createDataFrame([(i + 1, c) for i, c in enumerate(lex.categories)], "cat int, category string")
    last = F.lit(2 ** 31 - 1)
    rows = lex_df.dropna(subset=["cat_ord", "category", "keyword"]).join(F.broadcast(ranks), "category").select(
        "cat", F.coalesce(F.col("kw_ord").cast("int"), last).alias("kw_ord"), "keyword")
    if lex.generic:
        rows = rows.unionByName(spark.createDataFrame([(0, i + 1, w) for i, w in enumerate(lex.generic)],
                                                      "cat int, kw_ord int, keyword string"))
    rows = (rows.where((F.col("keyword") != "") & ~F.col("keyword").contains(_NUL))
            .groupBy("cat", F.lower("keyword").alias("m")).agg(F.min(F.struct("kw_ord", "keyword")).alias("kw"))
            .select("cat", "kw.*", "m").withColumn("klen", F.length("m")))
    border = F.exists(F.sequence(F.lit(1), F.col("klen") - 1),
                      lambda b: F.substring("m", 1, b) == F.substring(F.col("m"), F.col("klen") - b + 1, b))
    return rows.withColumn("self_overlap", (F.col("klen") > 1) & border)


# ---- bit sets and positions -------------------------------------------------------

def _gram_hashes():
    """``codes, lengths -> {length: hashes}``: an even 64-bit hash of every run of that many code points, by its start."""
    def hashes(codes, lengths):
        import numpy as np
        out, h = {}, np.zeros(len(codes) + 1, np.uint64)
        for g in range(1, max(lengths, default=0) + 1):
            if len(codes) < g:
                break
            h = h[:len(codes) - g + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[g - 1:] + np.uint64(1)
            if g in lengths:
                x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(g)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                out[g] = (x ^ (x >> np.uint64(31))) & np.uint64(0xFFFFFFFFFFFFFFFE)
        return out
    return hashes


def _with_hash(grams: DataFrame) -> DataFrame:
    """The column ``gram`` (a string) replaced by its hash."""
    hashes = _gram_hashes()

    @F.pandas_udf("bigint")
    def of(values: pd.Series) -> pd.Series:
        import numpy as np
        out = np.zeros(len(values), np.uint64)
        lengths = values.str.len().to_numpy()
        for g in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == g)
            codes = np.frombuffer("".join(values.iloc[at]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            out[at] = hashes(codes, (g,))[g][::g]
        return pd.Series(out.view(np.int64))
    return grams.withColumns({"glen": F.length("gram"), "gram": of("gram")})


def _counted() -> tuple[Column, Column]:
    """How many grams a table has, and their lengths."""
    return F.count("*").alias("n"), F.sort_array(F.collect_set("glen")).alias("lengths")


@dataclass(frozen=True)
class GramSet:
    """The bit set of some grams (bytes that go with the function) and the lengths they have."""

    bits: bytes
    size: int
    lengths: tuple[int, ...]

    @staticmethod
    def of(grams: DataFrame, count: int, lengths: list[int]) -> "GramSet":
        """Of the column ``gram``, about ``count`` hashes; what reaches the driver is bounded by ``MOST_BITS``."""
        size = LEAST_BITS
        while size < min(MOST_BITS, BITS_PER_ANCHOR * count):
            size *= 2
        at = F.call_function("shiftright", F.col("gram"), F.lit(1)).bitwiseAND(F.lit(size - 1))
        words = bytearray(size >> 3)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))
        for r in (grams.select(F.call_function("shiftright", at, F.lit(6)).alias("word"), bit.alias("bit"))
                  .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()):
            words[r["word"] * 8:r["word"] * 8 + 8] = r["bits"].to_bytes(8, "little", signed=True)
        return GramSet(bytes(words), size, tuple(lengths))

    def places(self, before: int, after: int):
        """``texts -> (joined, hash, places, rows, positions)`` a group of blocks: the places of ``joined`` whose gram may
        be in the set, the number of their text and the position in it. ``before`` and ``after`` characters stand around
        each place, NUL where the text ends."""
        bits, size, lengths, hashes = self.bits, self.size, self.lengths, _gram_hashes()
        block, pad = BLOCK, "\0" * max(before, after, 1)

        def blocks(texts):
            for i, text in enumerate(texts):
                for at in range(0, len(text or ""), block):
                    yield i, at, min(at, before), text[max(0, at - before):at + block + after]

        def groups(texts):
            held, size_held = [], 0
            for b in blocks(texts):
                held.append(b)
                size_held += len(b[3]) + len(pad)
                if size_held >= block:
                    yield held
                    held, size_held = [], 0
            if held:
                yield held

        def find(texts):
            import numpy as np
            known = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").view(bool)
            for group in groups(texts):
                joined = pad + pad.join(b[3] for b in group) + pad
                codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                sizes = np.array([len(b[3]) + len(pad) for b in group])
                # the place of each block's first own position, and how many it has
                rows, starts, leads = (np.array(x) for x in zip(*(b[:3] for b in group)))
                first = len(pad) + np.concatenate(([0], np.cumsum(sizes)[:-1])) + leads
                own = np.minimum(block, sizes - len(pad) - leads)
                for h in hashes(codes, lengths).values():
                    places = np.flatnonzero(known[((h >> np.uint64(1)) & np.uint64(size - 1)).astype(np.int64)])
                    which = np.searchsorted(first, places, "right") - 1
                    local = places - first[which]
                    ok = (which >= 0) & (local >= 0) & (local < own[which])
                    places, which, local = places[ok], which[ok], local[ok]
                    yield joined, h[places], places, rows[which], starts[which] + local
        return find


def _grams(keywords: DataFrame) -> DataFrame:
    """Every gram of every keyword that may become its anchor: ``m``, ``gram`` (its hash), ``glen``, ``off`` (characters before it)."""
    g = F.least("klen", F.lit(GRAM))
    return _with_hash(keywords.select("m", "klen").distinct()
                      .select("m", "klen", F.explode(F.sequence(F.lit(0), F.col("klen") - g)).alias("off"))
                      .select("m", "off", F.substring(F.col("m"), F.col("off") + 1, g).alias("gram")))


def _anchors(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """The keywords that can occur, with ``gram``, ``glen`` and ``off`` of their anchors; a small table, written and read back."""
    grams = materialize(_grams(keywords), "lexicon-grams")
    found = grams.agg(*_counted()).first()
    known = GramSet.of(grams, found["n"], found["lengths"])
    if not known.lengths:
        none = {"gram": F.lit(0).cast("bigint"), "glen": F.lit(0), "off": F.lit(0)}
        return materialize(keywords.withColumns(none).where(F.lit(False)), "lexicon-anchors")
    find = known.places(0, max(known.lengths))

    def count(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for _, found_hashes, *_ in find(batch.column(0).to_pylist()):
                values, n = np.unique(found_hashes, return_counts=True)
                yield pa.record_batch({"gram": values.view(np.int64), "n": n.astype(np.int64)})

    counts = texts.select("_tl").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    best = (grams.join(counts, "gram", "left")
            .groupBy("m").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "gram", "glen")).alias("a"))
            .where(F.col("a.n") > 0).select("m", "a.gram", "a.glen", "a.off"))
    return materialize(keywords.join(best, "m"), "lexicon-anchors")


def candidates(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows ``_id``, ``pos``, ``gram``, ``win``, ``_empty`` and ``before``: one per position of a text that may hold an
    anchor (``win`` has ``before`` characters in front of it), and a base row per text, of position -1 and an odd gram of
    its own, which no anchor has."""
    reach = anchors.agg(F.max("off").alias("before"), F.max(F.col("klen") - F.col("off")).alias("after"), *_counted()).first()
    known = GramSet.of(anchors, reach["n"], reach["lengths"])
    before, after = reach["before"] or 0, reach["after"] or 1
    find = known.places(before, after)
    empty = F.col("_tl").isNull() | ~has_word(F.col("_tl"))
    rows = texts.select("_id", empty.alias("_empty"), "_tl")
    schema = T.StructType([rows.schema["_id"], rows.schema["_empty"], T.StructField("pos", T.IntegerType()),
                           T.StructField("gram", T.LongType()), T.StructField("win", T.StringType())])

    def rows_of(batches):
        import numpy as np
        import pyarrow as pa

        def out(batch, at, pos, gram, win):
            at = pa.array(at)
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int32()),
                                               pa.array(gram, pa.int64()), pa.array(win, pa.string())],
                                              names=["_id", "_empty", "pos", "gram", "win"])

        for batch in batches:
            n = batch.num_rows
            row = batch.column(0).field(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            base = (row * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
            yield out(batch, np.arange(n), np.full(n, -1, np.int32), base.view(np.int64), [""] * n)
            for joined, h, places, at, pos in find(batch.column(2).to_pylist()):
                win = [joined[p - before:p + after] for p in places.tolist()]
                yield out(batch, at, pos.astype(np.int32), h.view(np.int64), win)

    return rows.mapInArrow(rows_of, schema).withColumn("before", F.lit(before))


# ---- scores -----------------------------------------------------------------------

def keyed_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id`` (rows of equal id stay apart) and ``_tl``, the lower-cased text."""
    return df.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id")).alias("_id"),
                     F.lower(F.col(text_col)).alias("_tl"))


def score_by_join(df: DataFrame, id_col: str, text_col: str, lex: Lexicon | None = None,
                  lex_df: DataFrame | None = None) -> DataFrame:
    """Per id: ``scores``, ``found``, ``_generic`` (generic words present) and ``_empty``."""
    spark = df.sparkSession
    if lex_df is None:
        lex_df = lex.to_df(spark)
    lex = table_lexicon(lex_df) if lex is None else Lexicon(lex.categories, tuple(() for _ in lex.categories), lex.generic)
    keywords = _keywords(lex_df, lex)
    texts = keyed_texts(df, id_col, text_col)
    anchors = _anchors(texts, keywords)
    near = F.substring(F.col("win"), F.col("before") - F.col("off") + 1, F.col("klen"))
    start = F.col("pos") - F.coalesce("off", F.lit(0))
    # a base row always survives: its gram is no anchor, and it gathers with no other in a join
    hits = (candidates(texts, anchors).join(anchors, "gram", "left").where((F.col("pos") < 0) | (near == F.col("m")))
            .withColumn("pos", start))

    # per (id, category): plain hits are counted; self-overlapping keywords keep their positions and are counted
    # greedily; the base row lands in the null category and generic words in category 0
    kw = F.when(F.col("kw_ord").isNotNull(), F.struct("kw_ord", "keyword"))
    overlap = F.when(F.col("self_overlap"), F.struct("kw_ord", "keyword", "pos", "klen"))
    per_cat = (hits.groupBy("_id", "cat")
                   .agg(F.count_if(~F.col("self_overlap")).alias("n_plain"),
                        F.collect_set(kw).alias("kws"),
                        F.collect_list(overlap).alias("ov"),
                        F.bool_or("_empty").alias("_empty")))
    begin = F.struct(F.lit("").alias("kw"), F.lit(0).alias("next"), F.lit(0).alias("cnt"))

    def step(acc, o):
        nxt = F.when(o["keyword"] == acc["kw"], acc["next"]).otherwise(F.lit(0))
        return F.when(o["pos"] >= nxt, F.struct(o["keyword"].alias("kw"), (o["pos"] + o["klen"]).alias("next"),
                                                (acc["cnt"] + 1).alias("cnt"))) \
                .otherwise(F.struct(o["keyword"].alias("kw"), nxt.alias("next"), acc["cnt"].alias("cnt")))
    greedy = F.aggregate(F.array_sort("ov"), begin, step)["cnt"]
    score = (F.col("n_plain") + greedy).cast("int")
    found = F.transform(F.array_sort("kws"), lambda s: s["keyword"])
    entry = F.when(F.col("cat").isNotNull(),
                   F.struct("cat", F.struct(score.alias("score"), found.alias("found"))))
    per_id = (per_cat.groupBy("_id")
                     .agg(F.map_from_entries(F.collect_list(entry)).alias("_m"),
                          F.bool_or("_empty").alias("_empty")))
    none = F.array().cast("array<string>")
    cats = F.sequence(F.lit(1), F.lit(len(lex.categories))) if lex.categories else F.array().cast("array<int>")
    out = per_id.withColumn(id_col, F.col("_id.id")).drop("_id").withColumns({
        "_generic": F.coalesce(F.col("_m")[0]["found"], none),
        "scores": F.transform(cats, lambda c: F.coalesce(F.col("_m")[c]["score"], F.lit(0))),
        "found": F.transform(cats, lambda c: F.coalesce(F.col("_m")[c]["found"], none)),
    })
    return out.drop("_m")


def classify_by_join(df: DataFrame, id_col: str, text_col: str, lex: Lexicon | None = None,
                     lex_df: DataFrame | None = None, keep_scores: bool = False) -> DataFrame:
    """Per id: the three keyword results (and ``scores`` / ``found`` when asked)."""
    lex = table_lexicon(lex_df) if lex is None else lex
    scored = score_by_join(df, id_col, text_col, lex, lex_df)
    sc = F.struct(F.lit(None).cast("string").alias("t"), F.col("found").alias("found"),
                  F.col("scores").alias("scores"), F.col("_generic").alias("generic"))
    # stands in for the text in the decision: null exactly when the text is empty
    text_stub = F.when(~F.col("_empty"), F.lit("x"))
    out = scored.withColumn("_d", let(sc, lambda s: _decision(text_stub, s, lex, ("generic",))))
    out = out.withColumns({c: F.col(f"_d.{c}") for c in RESULT_COLUMNS})
    keep = [id_col, *RESULT_COLUMNS] + (["scores", "found"] if keep_scores else [])
    return out.select(*keep)
