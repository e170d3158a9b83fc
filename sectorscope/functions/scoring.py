"""Keyword scoring of a lower-cased text against a lexicon.

Semantics: a category's score is the sum, over its keywords, of the number
of non-overlapping occurrences of the keyword as a plain substring (no word
boundaries). Found keywords are the keywords with at least one occurrence,
in lexicon order, each once.

Interchangeable scorers produce the same ``scores ARRAY<INT>`` and
``found ARRAY<ARRAY<STRING>>`` columns; ``native`` is the default, the others
are a caller's choice:

* ``native``: the lexicon is one literal ``ARRAY<ARRAY<STRING>>``;
  ``filter(contains)`` runs once per keyword and the occurrence count
  (``length`` / ``replace``) only for keywords that passed the gate. Stays in
  the JVM, no Python workers.
* ``arrow``: a scalar ``pandas_udf`` over Arrow batches doing the same gate
  and count with Python's ``str`` methods.
* ``aho``: a scalar ``pandas_udf`` that finds every keyword (and generic
  word) in one Aho-Corasick pass per text, so its cost grows with the text
  length and the hits, not with text length x keywords. Occurrences of a
  keyword that can overlap itself are counted greedily left to right, which
  is ``str.count``. Needs ``pyahocorasick`` on the executors.

All are row-local (a projection): no shuffle, partitioned like the input.
"""

from __future__ import annotations

import importlib.util

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sectorscope.functions.lexicon import Lexicon

SCORE_TYPE = "struct<scores: array<int>, found: array<array<string>>>"
AHO_TYPE = "struct<scores: array<int>, found: array<array<string>>, generic: array<string>>"


SCORERS = ("native", "aho", "arrow")


def resolve_scorer(scorer: str) -> str:
    """Check the scorer's name; the choice is the caller's and never depends on the machine.

    ``"native"`` (the default everywhere) runs in the JVM; ``"aho"`` needs
    ``pyahocorasick`` on every executor and pays off for longer lexicons.
    """
    if scorer not in SCORERS:
        raise ValueError(f"scorer {scorer!r} is none of {', '.join(SCORERS)}")
    if scorer == "aho" and importlib.util.find_spec("ahocorasick") is None:
        raise RuntimeError("the aho scorer needs the pyahocorasick package on the driver and every executor")
    return scorer


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def occurrences(t: Column, kw: Column) -> Column:
    """Non-overlapping occurrences of ``kw`` in ``t`` (``str.count`` semantics).

    In bytes, which a string knows; its length in characters is counted anew each time.
    """
    return ((F.octet_length(t) - F.octet_length(F.replace(t, kw, F.lit("")))) / F.octet_length(kw)).cast("int")


def native_found(t: Column, lex: Lexicon) -> Column:
    """ARRAY<ARRAY<STRING>>: per category, the keywords contained in ``t``."""
    if not lex.case_sensitive_display:
        lex_arr = F.array(*[_lit_array(ks) for ks in lex.match_keywords])
        return F.transform(lex_arr, lambda ks: F.filter(ks, lambda k: t.contains(k)))
    disp = F.array(*[_lit_array(ks) for ks in lex.keywords])
    return F.transform(disp, lambda ks: F.filter(ks, lambda k: t.contains(F.lower(k))))


def native_scores(t: Column, found: Column, lex: Lexicon) -> Column:
    """ARRAY<INT>: per category, occurrences summed over the found keywords only."""
    def count(k: Column) -> Column:
        return occurrences(t, F.lower(k) if lex.case_sensitive_display else k)
    return F.transform(found, lambda ks: F.aggregate(ks, F.lit(0), lambda acc, k: acc + count(k)))


def arrow_scorer(lex: Lexicon):
    """A pandas UDF ``text -> struct<scores, found>``; ``text`` is the raw text."""
    match = lex.match_keywords
    display = lex.keywords

    @F.pandas_udf(SCORE_TYPE)
    def score(texts: pd.Series) -> pd.DataFrame:
        all_scores, all_found = [], []
        for text in texts:
            if text is None:  # like the native scorer: nothing found
                all_scores.append([0] * len(match))
                all_found.append([[] for _ in match])
                continue
            low = text.lower()
            scores, found = [], []
            for mkws, dkws in zip(match, display):
                total, hits = 0, []
                for m, d in zip(mkws, dkws):
                    if m in low:
                        total += low.count(m)
                        hits.append(d)
                scores.append(total)
                found.append(hits)
            all_scores.append(scores)
            all_found.append(found)
        return pd.DataFrame({"scores": all_scores, "found": all_found})

    return score


def _self_overlapping(w: str) -> bool:
    """True when two occurrences of ``w`` can overlap (a proper prefix is also a suffix)."""
    return any(w[:b] == w[-b:] for b in range(1, len(w)))


def aho_scorer(lex: Lexicon):
    """A pandas UDF ``text -> struct<scores, found, generic>`` (one automaton pass per text).

    The automaton reports every occurrence, overlapping ones included; they
    are counted per pattern in C (``Counter`` over the match iterator). Only
    a pattern that can overlap itself ("aa", "abab") and occurs at all is
    recounted with ``str.count``, which gives the non-overlapping count.
    """
    match, display, generic = lex.match_keywords, lex.keywords, lex.generic
    # one pattern id per distinct matched form; keywords point at their pattern
    patterns: dict[str, int] = {}
    for w in [k for ks in match for k in ks] + list(generic):
        patterns.setdefault(w, len(patterns))
    kw_ids = [[patterns[k] for k in ks] for ks in match]
    generic_ids = [patterns[w] for w in generic]
    overlapping = [(pid, w) for w, pid in patterns.items() if _self_overlapping(w)]

    @F.pandas_udf(AHO_TYPE)
    def score(texts: pd.Series) -> pd.DataFrame:
        from collections import Counter
        from operator import itemgetter

        import ahocorasick
        automaton = ahocorasick.Automaton()
        for w, pid in patterns.items():
            automaton.add_word(w, pid)
        automaton.make_automaton()
        pattern_of = itemgetter(1)
        # one shared "nothing found" result (null text, or no match): read-only
        zeros, nothing, no_generic = [0] * len(kw_ids), [[] for _ in kw_ids], []
        all_scores, all_found, all_generic = [], [], []
        for text in texts.tolist():
            if text is not None:
                low = text.lower()
                counts = Counter(map(pattern_of, automaton.iter(low)))
            if text is None or not counts:
                all_scores.append(zeros)
                all_found.append(nothing)
                all_generic.append(no_generic)
                continue
            for pid, w in overlapping:
                if pid in counts:
                    counts[pid] = low.count(w)
            all_scores.append([sum(counts[i] for i in ids) for ids in kw_ids])
            all_found.append([[d for d, i in zip(dks, ids) if i in counts] for dks, ids in zip(display, kw_ids)])
            all_generic.append([w for w, i in zip(generic, generic_ids) if i in counts])
        return pd.DataFrame({"scores": all_scores, "found": all_found, "generic": all_generic})

    return score
