"""Keyword classification as DataFrame transforms.

``score`` adds ``scores`` / ``found``; ``decide`` turns them into the three
keyword-mode result columns; ``classify_text`` is both; ``classify_companies``
builds the text from a company table and appends the six result columns.

Decision rules (in order):
  * null text, or (for lexicons that need it) a text without words ->
    (Unclassified, Low, "")
  * best score 0 -> generic words present? (Traditional / Generalist, Low,
    the generic words) : (Unclassified, Low, "")
  * two categories share the best score -> (Hybrid, Medium, keywords of the
    first two such categories in lexicon order)
  * else the first best category; High at >= 3, Medium at >= 1.

Everything is a projection: no shuffle. The scorer is a parameter
(``functions.scoring``): ``"native"`` (the default) stays in the JVM, ``"aho"``
is an Arrow-batched Aho-Corasick UDF, by choice only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorscope.functions import text as tx
from sectorscope.functions.lexicon import (GENERALIST, HIGH, HIGH_FROM, HYBRID, LOW, MEDIUM, MEDIUM_FROM,
                                          UNCLASSIFIED, Lexicon, default_lexicon)
from sectorscope.functions.scoring import (aho_scorer, arrow_scorer, native_found, native_scores,
                                          resolve_scorer)

RESULT_COLUMNS = ["Predicted_Archetype", "Confidence_Score", "Keywords_Found"]

_T = "_t"  # lower-cased text, kept for callers that re-use it


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once per row and pass it to ``fn``.

    The value is bound to a lambda variable. Higher-order functions evaluate
    their lambdas per element, so an expression captured there (the
    lower-cased text in every keyword test, the scores in every decision
    branch) would otherwise be recomputed for each element.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def fence(value: Column) -> Column:
    """``value``, marked nondeterministic so that Catalyst evaluates it where it stands.

    Catalyst pushes filters below projections and merges projections by
    copying expressions; for the classifier each copy would score the text
    again (a filter on the label would score every row before the projection
    scores it once more). A projection holding a nondeterministic expression
    is neither pushed through nor inlined, so scoring runs once per row. The
    guard is always true and costs one comparison per row. A filter on input
    columns belongs before the classifier, where it still reaches the scan.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def _score_struct(text: Column, lex: Lexicon, scorer: str, need_t: bool = True) -> Column:
    """struct<t, found, scores[, generic]> for one text, each part computed once.

    The ``aho`` scorer also returns the generic words present; ``t`` (the
    lower-cased text) is then only built when ``need_t``.
    """
    scorer = resolve_scorer(scorer)
    if scorer == "aho":
        udf = aho_scorer(lex).asNondeterministic()
        t = F.lower(text) if need_t else F.lit(None).cast("string")
        return let(udf(text), lambda r: F.struct(t.alias("t"), r["found"].alias("found"),
                                                  r["scores"].alias("scores"), r["generic"].alias("generic")))
    if scorer == "native":
        return let(F.lower(text), lambda t: let(native_found(t, lex), lambda found: F.struct(
            t.alias("t"), found.alias("found"), native_scores(t, found, lex).alias("scores"))))
    if scorer == "arrow":
        udf = arrow_scorer(lex).asNondeterministic()
        return let(udf(text), lambda r: F.struct(F.lower(text).alias("t"), r["found"].alias("found"),
                                                  r["scores"].alias("scores")))
    raise ValueError(f"unknown scorer {scorer!r}")


def score(df: DataFrame, text_col: str = "text", lexicon: Lexicon | None = None,
          scorer: str = "native") -> DataFrame:
    """Add ``scores`` and ``found`` (and the helper ``_t``) for ``text_col``."""
    lex = lexicon or default_lexicon()
    out = df.withColumn("_sc", fence(_score_struct(F.col(text_col), lex, scorer)))
    return out.withColumns({_T: F.col("_sc.t"), "found": F.col("_sc.found"),
                            "scores": F.col("_sc.scores")}).drop("_sc")


def _first_two_best(scores: Column, best: Column, n: int) -> tuple[Column, Column]:
    first = F.array_position(scores, best)
    rel = F.array_position(F.slice(scores, (first + 1).cast("int"), n), best)
    second = F.when(rel > 0, rel + first)
    return first.cast("int"), second.cast("int")


def _decision(text: Column, sc: Column, lex: Lexicon, precomputed: tuple[str, ...] = ()) -> Column:
    """struct<Predicted_Archetype, Confidence_Score, Keywords_Found> from a score struct.

    ``precomputed`` names extra fields of ``sc`` to use instead of recomputing
    them from the text (``"generic"``: the generic words present).
    """
    n = len(lex.categories)
    cats = F.array(*[F.lit(c) for c in lex.categories])
    t, found, scores = sc["t"], sc["found"], sc["scores"]

    def with_best(best: Column) -> Column:
        first, second = _first_two_best(scores, best, n)
        return let(F.struct(best.alias("best"), first.alias("i1"), second.alias("i2")), decide_row)

    def decide_row(b: Column) -> Column:
        best, i1, i2 = b["best"], b["i1"], b["i2"]
        if "generic" in precomputed:
            generic = sc["generic"]
        else:
            generic = F.filter(F.array(*[F.lit(w) for w in lex.generic]), lambda w: t.contains(w))
        empty = text.isNull()
        if lex.needs_word_guard:
            empty = empty | ~tx.has_word(text)
        hybrid = i2.isNotNull() & (best > 0)
        arch = (F.when(empty, F.lit(UNCLASSIFIED))
                 .when(best == 0, F.when(F.size(generic) > 0, F.lit(GENERALIST)).otherwise(F.lit(UNCLASSIFIED)))
                 .when(hybrid, F.lit(HYBRID))
                 .otherwise(F.element_at(cats, i1)))
        conf = (F.when(empty | (best == 0), F.lit(LOW))
                 .when(hybrid, F.lit(MEDIUM))
                 .when(best >= HIGH_FROM, F.lit(HIGH))
                 .when(best >= MEDIUM_FROM, F.lit(MEDIUM))
                 .otherwise(F.lit(LOW)))
        kws = (F.when(empty, F.lit(""))
                .when(best == 0, F.array_join(generic, ", "))
                .when(hybrid, F.array_join(F.concat(F.element_at(found, i1), F.element_at(found, i2)), ", "))
                .otherwise(F.array_join(F.element_at(found, i1), ", ")))
        return F.struct(arch.alias("Predicted_Archetype"), conf.alias("Confidence_Score"),
                        kws.alias("Keywords_Found"))

    return with_best(F.array_max(scores))


def decide(df: DataFrame, lexicon: Lexicon | None = None, text_col: str = "text",
           keep_scores: bool = False) -> DataFrame:
    """Turn ``scores`` / ``found`` / ``_t`` into Predicted_Archetype, Confidence_Score, Keywords_Found."""
    lex = lexicon or default_lexicon()
    sc = F.struct(F.col(_T).alias("t"), F.col("found").alias("found"), F.col("scores").alias("scores"))
    out = df.withColumn("_d", let(sc, lambda s: _decision(F.col(text_col), s, lex)))
    out = out.withColumns({c: F.col(f"_d.{c}") for c in RESULT_COLUMNS}).drop("_d", _T)
    return out if keep_scores else out.drop("scores", "found")


def classify_column(text: Column, lexicon: Lexicon | None = None, scorer: str = "native",
                    keep_scores: bool = False) -> Column:
    """The whole classifier as one column: struct of the three results (+ scores/found)."""
    lex = lexicon or default_lexicon()
    scorer = resolve_scorer(scorer)

    def body(s: Column) -> Column:
        d = _decision(text, s, lex, ("generic",) if scorer == "aho" else ())
        fields = [d[c].alias(c) for c in RESULT_COLUMNS]
        if keep_scores:
            fields += [s["scores"].alias("scores"), s["found"].alias("found")]
        return F.struct(*fields)
    return fence(let(_score_struct(text, lex, scorer, need_t=False), body))


def classify_text(df: DataFrame, text_col: str = "text", lexicon: Lexicon | None = None,
                  scorer: str = "native", keep_scores: bool = False) -> DataFrame:
    """Keyword classifier over one text column (CLS-1..10): one projection."""
    out = df.withColumn("_c", classify_column(F.col(text_col), lexicon, scorer, keep_scores))
    cols = RESULT_COLUMNS + (["scores", "found"] if keep_scores else [])
    return out.withColumns({c: F.col(f"_c.{c}") for c in cols}).drop("_c")


def with_text(df: DataFrame, main: str, aux: Sequence[str] = tx.AUX_TEXT_COLUMNS,
              name: str = "combined_text") -> DataFrame:
    return df.withColumn(name, tx.combined_text(df, main, aux))


def classify_companies(df: DataFrame, main: str, aux: Sequence[str] = tx.AUX_TEXT_COLUMNS,
                       lexicon: Lexicon | None = None, scorer: str = "native",
                       keep_text: bool = False) -> DataFrame:
    """Row classifier in keyword mode: input columns + six result columns."""
    out = classify_text(with_text(df, main, aux, "_text"), "_text", lexicon, scorer)
    out = out.withColumns({"Secondary_Archetypes": F.lit(""), "Driving_Capabilities": F.lit(""),
                           "Innovation_Wave": F.lit("")})
    return out if keep_text else out.drop("_text")
