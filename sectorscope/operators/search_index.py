"""Repeated search over one table: a posting table of trigrams, and the exact test on the rows it leaves.

The index holds one row per (trigram, row id) of the rows' searched columns, in
lower case, in folders by a hash of the trigram, so a search reads the folders
of its own trigrams only. From a pattern's syntax tree follow alternatives of
trigrams that any match must have; rows that hold all trigrams of one
alternative are candidates, and only they are tested with the pattern itself.
A pattern that requires no trigram (``a.*b``), or one that the parser does not
know, is tested on all rows.

Trigrams are of ASCII characters, after the few other letters that match an
ASCII letter when case is ignored are replaced by it, so no match is lost.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorscope.operators.explore import matches

BUCKETS = 64
#: Alternatives of a pattern beyond which a part of it counts as requiring nothing.
MOST_ALTERNATIVES = 64
# letters outside ASCII that equal s, i, i and k when case is ignored
_ALIKE = ("ſıİK", "siik")

State = tuple[frozenset[str], str]  # trigrams required so far, and the literal characters just before


def required_trigrams(pattern: str, literal: bool = False) -> list[frozenset[str]] | None:
    """Alternatives of trigrams, one of which any match holds whole; None if nothing is required."""
    if literal:
        states = _literals(pattern, [(frozenset(), "")])
    else:
        try:
            states = _walk(parser.parse(pattern, re.IGNORECASE), [(frozenset(), "")])
        except (re.error, OverflowError, RecursionError):
            return None
    found = {grams for grams, _ in states}
    return None if frozenset() in found else sorted(found, key=sorted)


def _literals(text: str, states: list[State]) -> list[State]:
    for c in text:
        c = c.lower() if c.isascii() else ""
        states = [(g | {(t + c)[-3:]} if c and len(t) >= 2 else g, (t + c)[-2:] if c else "") for g, t in states]
    return states


def _walk(tree, states: list[State]) -> list[State]:
    """The states after a part of the syntax tree. What is not understood ends the literal run and requires nothing."""
    for kind, value in tree:
        if kind is op.LITERAL:
            states = _literals(chr(value), states)
        elif kind is op.SUBPATTERN:
            states = _walk(value[3], states)
        elif kind is op.BRANCH:
            split = list(dict.fromkeys(s for part in value[1] for s in _walk(part, states)))
            states = split if len(split) <= MOST_ALTERNATIVES else _ended(states)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, part = value
            if least:
                states = _walk(part, states)
            if (least, most) != (1, 1):
                states = _ended(states)
        elif kind is op.ATOMIC_GROUP:
            states = _walk(value, states)
        elif kind not in (op.AT, op.ASSERT, op.ASSERT_NOT):  # those take no characters
            states = _ended(states)
    return states


def _ended(states: list[State]) -> list[State]:
    return list(dict.fromkeys((g, "") for g, _ in states))


def _trigrams(columns: Sequence[str]) -> Column:
    def of(c: str) -> Column:
        text = F.lower(F.translate(F.col(f"`{c}`").cast("string"), *_ALIKE))
        return F.coalesce(F.regexp_extract_all(text, F.lit(r"(?s)(?=([\x00-\x7f]{3}))"), 1), F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*map(of, columns))))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build_index(df: DataFrame, key: str, path: str, columns: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    """Write the postings of ``columns`` (all by default) under ``path``; ``append`` adds rows with new keys."""
    rows = df.select(F.col(key).alias("key"), F.explode(_trigrams(columns or df.columns)).alias("gram"))
    (rows.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8)))
     .sortWithinPartitions("bucket", "gram").write.mode(mode).partitionBy("bucket").parquet(path))


def candidate_keys(spark: SparkSession, path: str, alternatives: list[frozenset[str]]) -> DataFrame:
    """``key`` of the rows that hold all trigrams of one alternative."""
    grams = sorted(frozenset().union(*alternatives))
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"))).distinct().collect()]
    held = (spark.read.parquet(path).where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
            .groupBy("key").agg(F.collect_set("gram").alias("held")))
    whole = [F.size(F.array_intersect("held", F.array(*map(F.lit, sorted(a))))) == len(a) for a in alternatives]
    return held.where(reduce(lambda a, b: a | b, whole)).select("key")


def search_indexed(df: DataFrame, key: str, path: str, pattern: str, literal: bool = False,
                   columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that ``explore.search`` finds, and the rows that were tested for it. The index must cover ``columns``."""
    alternatives = required_trigrams(pattern, literal)
    tested = df
    if alternatives is not None:
        keys = candidate_keys(df.sparkSession, path, alternatives)
        tested = df.join(keys, df[key] == keys["key"], "left_semi")
    return tested.where(matches(columns or df.columns, pattern, literal)), tested
