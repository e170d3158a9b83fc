"""URL filters: a sort-merge range join of pages and prefix rules.

A host is keyed by its reversed labels, each ended by a dot
(``www.example.com`` -> ``com.example.www.``), so a rule's host and all its
subdomains form one interval of keys, and intervals nest or are disjoint.
Pages are range-partitioned and sorted by key; a sweep over each partition
walks the sorted rules beside the sorted pages and keeps a stack of the rules
whose interval is open. The hosts open at a page are asked from the innermost
out. The paths of a host's rules are sorted too and know the next shorter rule
path that starts them, so the longest one that starts the page's path is found
by one search and steps over nested rules only.

Range bounds include the page id and the path, so a host with a third of all
pages is cut over many partitions. Rules are a list or a table of any size; they
go to every task in blocks of about ``block_rules``, dealt by hash, and each
further block takes a further sweep, which keeps the better of two matches.

Longest rule: the longer host first, then the longer path, then the smaller
rule text and verdict.

Defined results: a null url or one without ``://`` has an empty host and path
and fits no rule; a page that fits no rule gets the default verdict and a null
rule; repeated rows are judged row by row; an empty rule list fits nothing;
a rule with a null part is left out.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorscope.llm.common import row_struct, with_fields

BLOCK_RULES = 500_000


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lowered; empty without ``://``."""
    host = F.regexp_extract(_after(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    """What follows the first ``://``; null without it."""
    return F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))


def host_key(host: str) -> str:
    """Reversed labels, each ended by a dot; the empty host has the empty key."""
    return ".".join(reversed(host.split("."))) + "." if host else ""


def host_key_col(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class PathRules:
    """The rules of one host by path; of several rules with one path the smallest."""

    def __init__(self, rules: list[UrlRule]):
        best: dict[str, UrlRule] = {}
        for r in sorted(rules, key=lambda r: (r.text, r.verdict)):
            best.setdefault(r.path, r)
        self.paths = sorted(best)
        self.rules = [best[p] for p in self.paths]
        self.shorter: list[int] = []  # the longest other path that starts this one, -1 for none
        open_paths: list[int] = []
        for i, path in enumerate(self.paths):
            while open_paths and not path.startswith(self.paths[open_paths[-1]]):
                open_paths.pop()
            self.shorter.append(open_paths[-1] if open_paths else -1)
            open_paths.append(i)

    def longest(self, path: str) -> UrlRule | None:
        """The rule whose path is the longest that starts ``path``."""
        i = bisect.bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.shorter[i]
        return self.rules[i] if i >= 0 else None


class RuleSweep:
    """The rules of one block in key order, and the stack of those open at the current key."""

    def __init__(self, rules: list[UrlRule]):
        groups: dict[str, list[UrlRule]] = {}
        for r in rules:
            groups.setdefault(host_key(r.host), []).append(r)
        self.keys = sorted(groups)
        self.groups = [PathRules(groups[k]) for k in self.keys]

    def start(self, key: str) -> None:
        """Open the rules whose interval holds ``key``, for the first key of a sorted run."""
        self.stack: list[int] = []
        labels = key.split(".")[:-1]
        for n in range(len(labels) + 1):
            prefix = "".join(label + "." for label in labels[:n])
            i = bisect.bisect_left(self.keys, prefix)
            if i < len(self.keys) and self.keys[i] == prefix:
                self.stack.append(i)
        self.next = bisect.bisect_right(self.keys, key)

    def advance(self, key: str) -> None:
        """Move on to ``key``, not smaller than the last: close and open intervals."""
        while self.next < len(self.keys) and self.keys[self.next] <= key:
            self._close(self.keys[self.next])
            self.stack.append(self.next)
            self.next += 1
        self._close(key)

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.keys[self.stack[-1]]):
            self.stack.pop()

    def best(self, path: str) -> UrlRule | None:
        for i in reversed(self.stack):
            if rule := self.groups[i].longest(path):
                return rule
        return None


def _better(a: UrlRule | None, b: UrlRule | None) -> UrlRule | None:
    if a is None or b is None:
        return a or b
    return min(a, b, key=lambda r: (-len(host_key(r.host)), -len(r.path), r.text, r.verdict))


def rule_blocks(rules: list[UrlRule] | DataFrame, block_rules: int) -> Iterator[list[UrlRule]]:
    """The rules (a table has ``host``, ``path``, ``verdict``) in blocks that are broadcast one by one; at least one block."""
    if not isinstance(rules, DataFrame):
        rules = [r for r in rules if None not in (r.host, r.path, r.verdict)]
        yield from (rules[at:at + block_rules] for at in range(0, max(1, len(rules)), block_rules))
        return
    table = rules.select("host", "path", "verdict").dropna().distinct()
    blocks = max(1, -(-table.count() // block_rules))
    for k in range(blocks):
        part = table if blocks == 1 else table.where(F.pmod(F.xxhash64("host", "path"), F.lit(blocks)) == k)
        yield [UrlRule(*r) for r in part.collect()]


def judge_urls(pages: DataFrame, rules: list[UrlRule] | DataFrame, url_col: str = "url", carry: tuple[str, ...] = ("page_id",),
               default: str = "allow", block_rules: int = BLOCK_RULES) -> DataFrame:
    """One row per page: ``row`` (struct of ``carry``), ``host``, ``path``, ``rule``, ``verdict``."""
    spark = pages.sparkSession
    url = F.col(f"`{url_col}`").cast("string")
    judged = (pages.select(row_struct(carry), url_host(url).alias("host"), url_path(url).alias("path"))
              .withColumn("key", host_key_col(F.col("host")))
              .withColumn("spread", F.monotonically_increasing_id())
              .repartitionByRange("key", "path", "spread").sortWithinPartitions("key")
              .select("row", "host", "path", "key", F.lit(None).cast("struct<host:string,path:string,verdict:string>").alias("found")))
    schema = with_fields(judged, "row", "host string, path string, key string, found struct<host:string,path:string,verdict:string>")
    for block in rule_blocks(rules, block_rules):
        block = spark.sparkContext.broadcast(block)
        judged = judged.mapInArrow(_sweeper(block), schema)
    rule = F.when(F.col("found").isNotNull(), F.concat("found.host", "found.path"))
    return judged.select("row", "host", "path", rule.alias("rule"),
                         F.coalesce("found.verdict", F.lit(default)).alias("verdict"))


def _sweeper(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, started = RuleSweep(block.value), False
        for batch in batches:
            found = []
            for key, path, old in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                if not started:
                    sweep.start(key)
                    started = True
                else:
                    sweep.advance(key)
                best = _better(UrlRule(**old) if old else None, sweep.best(path))
                found.append(best and {"host": best.host, "path": best.path, "verdict": best.verdict})
            kind = pa.struct([("host", pa.string()), ("path", pa.string()), ("verdict", pa.string())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, kind)], names=batch.schema.names)
    return run


def filter_urls(pages: DataFrame, rules: list[UrlRule] | DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The pages that are allowed; columns as the input's."""
    judged = judge_urls(pages, rules, url_col, tuple(pages.columns), default)
    return judged.where(F.col("verdict") == "allow").select("row.*")
