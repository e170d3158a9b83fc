"""Quality rules, line first.

Each line is judged alone by punctuation, navigation and boilerplate rules;
failing lines are removed; a document that loses too much of its words is
rejected, as is one that fails the base rules (too short, too repetitive).

The work is a map over documents: no shuffle, one pass over each whole text.

Defined results: a null text has no words and is rejected by the base rule,
its cleaned text stays null; an empty text likewise; repeated rows and null
ids are judged row by row; other columns of the input are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorscope.llm.common import WS_CHARS, as_bytes, has_letter, map_batches, row_struct, with_fields

SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "javascript is disabled", "lorem ipsum", "subscribe to our newsletter",
    "click here to", "this site uses cookies", "sign up for our",
)
NAVIGATION = frozenset((
    "home", "menu", "next", "previous", "next page", "previous page", "back to top", "skip to content",
    "read more", "log in", "sign in", "sign up", "share this", "share", "search", "contact us", "about us",
    "site map", "sitemap", "login", "register",
))


@dataclass(frozen=True)
class LineRules:
    """Limits of the line and document rules (shares are of words)."""

    min_words: int = 50
    max_repeat_percent: int = 50
    symbol_share: float = 0.3      # symbols per word at which a line fails
    shout_share: float = 0.3       # words with a doubled ! or ? at which a line fails
    rule_min_words: int = 3        # shorter lines are not judged by punctuation
    nav_items: int = 3             # separated items that make a line navigation
    nav_item_words: int = 3        # longest such item, in words
    max_lost: float = 0.3          # a document losing more of its words is rejected


_SEPARATOR = re.compile(r"\s*[|»›•·]\s*")
_SHOUT = re.compile(r"[!?]{2}(?:\s|$)")


def line_fails(line: str, rules: LineRules = LineRules()) -> str | None:
    """The name of the first rule that ``line`` fails, or None; a blank line passes."""
    words = line.encode().split()
    n = len(words)
    if not n:
        return None
    if not has_letter(line):
        return "punctuation"
    if n >= rules.rule_min_words:
        symbols = sum(map(line.count, SYMBOLS))
        if symbols >= rules.symbol_share * n:
            return "navigation" if line.count("|") * 2 >= symbols else "punctuation"
        if ("!!" in line or "??" in line) and len(_SHOUT.findall(line)) >= rules.shout_share * n:
            return "punctuation"
    if n <= 3 and line.strip(WS_CHARS + ".:>»").lower() in NAVIGATION:
        return "navigation"
    if any(c in line for c in "|»›•·"):
        items = [x for x in _SEPARATOR.split(line) if x]
        if len(items) >= rules.nav_items and all(len(x.split()) <= rules.nav_item_words for x in items):
            return "navigation"
    low = line.lower()
    if any(p in low for p in BOILERPLATE):
        return "boilerplate"
    return None


def repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs twice or more (its first place included)."""
    n = len(words)
    if n < 4:
        return 0
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    seen: dict[tuple, int] = {}
    code = np.fromiter((seen.setdefault(g, len(seen)) for g in grams), np.int64, len(grams))
    again = np.bincount(code)[code] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:shift + len(grams)] |= again
    return int(covered.sum())


def judge(raw: bytes | None, rules: LineRules = LineRules()) -> dict:
    """All measures of one text; ``clean_text`` is the text itself where no line fails."""
    text = "" if raw is None else raw.decode("utf-8", "replace")
    words = text.encode().split()
    n = len(words)
    seen: set[str] = set()
    kept: list[str] = []
    dup = lost = failed = 0
    by_rule = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    for line in text.split("\n"):
        if line.strip(WS_CHARS):
            dup += line in seen
            seen.add(line)
        rule = line_fails(line, rules)
        if rule is None:
            kept.append(line)
        else:
            failed += 1
            by_rule[rule] += 1
            lost += len(line.encode().split())
    repeated = repeat_words(words)
    base_failed = n < rules.min_words or 100 * repeated > rules.max_repeat_percent * n
    return {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, WS_CHARS)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": dup,
        "n_repeat_words": repeated,
        "base_failed": base_failed,
        "n_lost_words": lost,
        **{f"n_{k}_lines": v for k, v in by_rule.items()},
        "kept": not base_failed and lost <= rules.max_lost * n,
        "clean_text": None if raw is None else "\n".join(kept) if failed else text,
    }


MEASURES = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
            "n_repeat_words": "bigint", "base_failed": "boolean", "n_lost_words": "bigint",
            "n_punctuation_lines": "bigint", "n_navigation_lines": "bigint", "n_boilerplate_lines": "bigint",
            "kept": "boolean", "clean_text": "string"}


def line_quality(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",),
                 rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """One row per input row: the ``carry`` columns, then the measures.

    The carried columns travel as one struct, so their names and types can be
    anything, also those of the measures' inputs.
    """
    names = [m for m in MEASURES if with_text or m != "clean_text"]
    packed = docs.select(row_struct(carry), as_bytes(text_col).alias("raw"))

    def run(batch: dict[str, list]) -> dict[str, list]:
        out = [judge(raw, rules) for raw in batch["raw"]]
        return {"row": batch["row"]} | {m: [o[m] for o in out] for m in names}

    return map_batches(packed, run, with_fields(packed, "row", ", ".join(f"{m} {MEASURES[m]}" for m in names)))


def keep_good(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, with their failing lines removed; columns as the input's."""
    judged = line_quality(docs, text_col, tuple(c for c in docs.columns if c != text_col), rules)
    return judged.where("kept").select(
        *[F.col("clean_text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
