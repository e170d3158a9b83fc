"""Findings: the headline numbers of a result table, one record each.

One pass over the rows: a partial aggregate to the small profile cube
(``profiles.profile_cube``); the scalars (totals, errors, distinct labels,
waves, capability mentions, hybrid rows) and the dominant label are both
derived from it, and the findings are unpivoted from the one-row scalar
frame with ``inline`` (no join). Prose is
rendered separately by ``render_text`` so the numbers can be checked as
numbers.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorscope.operators import profiles as pf

# The sentence of each finding, worded as the reference words
# it ({value} is shown with one decimal). The wave finding has two forms.
SENTENCES: dict[str, str] = {
    "dominant_archetype": "**{label}** is the dominant archetype with {n} companies ({value}%)",
    "innovation_maturity_3": "**{value}%** of companies are in Wave 3.0, indicating a highly evolved ecosystem "
                             "with embedded insurance and open platforms",
    "innovation_maturity_2": "**{value}%** in Wave 2.0, showing strong B2B enabler presence",
    "top_capability": "**{label}** is the most prevalent driving capability across the ecosystem",
    "capability_density": "Companies leverage an average of **{value} capabilities**, showing {label} "
                          "technological sophistication",
    "classification_quality": "**{value}%** successful classifications ({n}/{label} companies)",
    "ecosystem_diversity": "Ecosystem spans **{n} different archetypes** from the framework",
    "hybrid_models": "**{value}%** of companies exhibit hybrid characteristics, operating across multiple archetypes",
}
# End of fixed values.


def _row(name: str, label: Column, n: Column, value: Column, keep: Column) -> Column:
    return F.struct(F.lit(name).alias("finding"), label.cast("string").alias("label"),
                    n.cast("bigint").alias("n"), value.cast("double").alias("value"),
                    keep.alias("keep"))


def findings(df: DataFrame) -> DataFrame:
    """Findings from one pass: everything derives from ``profiles.profile_cube``."""
    return findings_of_cube(*pf.profile_cube(df))


def findings_of_cube(cube: DataFrame, cols: list[str]) -> DataFrame:
    """Findings from a cube alone (also the one of ``live_cube``) and its capability columns."""
    label, wave = F.col("label"), F.col("wave")
    err = pf.is_error(label)
    per_row_dc = sum((F.col(c) for c in cols), F.lit(0))
    s = cube.agg(
        F.sum("n").alias("total"),
        pf._sum_if(err).alias("errors"),
        F.countDistinct(F.when(~err, label)).alias("n_distinct"),
        pf._sum_if(wave.isNotNull() & (wave != "")).alias("n_waves"),
        pf._sum_if(wave == "3.0").alias("n3"),
        pf._sum_if(wave == "2.0").alias("n2"),
        pf._sum_if(F.col("has_sec")).alias("n_hybrid"),
        (F.sum(per_row_dc * F.col("n")) / F.sum("n")).alias("avg_dcs"),
        F.array(*[F.struct(pf._sum_if(F.col(c) > 0).alias("n"), F.lit(c).alias("dc")) for c in cols])
         .alias("dc_counts"),
    )
    total, errors = F.col("total"), F.col("errors")
    dc_sum = F.aggregate("dc_counts", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    # most mentions first, ties to the first column: max of (n, -position)
    dc_top = F.array_max(F.transform("dc_counts", lambda x, i: F.struct(x["n"].alias("n"), (-i).alias("neg_i"),
                                                                       x["dc"].alias("dc"))))
    mat_n = F.when(F.col("n3") > 0, F.col("n3")).otherwise(F.col("n2"))
    mat_label = F.when(F.col("n3") > 0, F.lit("3.0")).otherwise(F.lit("2.0"))
    level = F.when(F.col("avg_dcs") >= pf.DENSITY_HIGH_FROM, F.lit(pf.DENSITY_HIGH)).otherwise(F.lit(pf.DENSITY_MODERATE))
    none_s, none_n, none_v = F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast("double")
    rows = F.array(
        _row("innovation_maturity", mat_label, mat_n, pf.pct(mat_n, F.col("n_waves")),
             (F.col("n_waves") > 0) & ((F.col("n3") > 0) | (F.col("n2") > 0))),
        _row("top_capability", dc_top["dc"], dc_top["n"], none_v, dc_sum > 0),
        _row("capability_density", level, none_n, F.col("avg_dcs"), dc_sum > 0),
        _row("classification_quality", total, total - errors,
             F.coalesce(pf.pct(total - errors, total), F.lit(0.0)), F.lit(True)),
        _row("ecosystem_diversity", none_s, F.col("n_distinct"), none_v, F.lit(True)),
        _row("hybrid_models", none_s, F.col("n_hybrid"), pf.pct(F.col("n_hybrid"), total),
             F.col("n_hybrid") > 0),
    )
    scalar = s.select(F.inline(rows)).filter("keep").drop("keep")
    # the share's base is every non-error row, null labels included (they
    # pass the error filter; only the count per label drops them). Both
    # conditions sit inside the sum or above the window, never on the cube's
    # keys, so Catalyst cannot push them into the cube: one exchange serves
    # both branches.
    counts = (cube.groupBy("label").agg(F.sum(F.when(~err, F.col("n"))).alias("n"))
                  .filter(F.col("n").isNotNull()))
    shares = pf.with_share(counts).filter(F.col("label").isNotNull())
    dom = pf.top_n(shares, "label", 1).select(
        F.lit("dominant_archetype").alias("finding"), F.col("label"),
        F.col("n").cast("bigint").alias("n"), F.col("share_pct").cast("double").alias("value"))
    return dom.unionByName(scalar)


def _fmt1(x: Column) -> Column:
    """One decimal, half-even on the binary value (Python's ``:.1f``)."""
    return F.regexp_replace(F.format_number(x, 1), ",", "")


def _sentence(template: str, fields: dict[str, Column]) -> Column:
    """``template.format(**fields)`` as one ``concat`` of literals and columns."""
    pieces: list[Column] = []
    for lit, fld, _, _ in string.Formatter().parse(template):
        if lit:
            pieces.append(F.lit(lit))
        if fld is not None:
            pieces.append(fields[fld])
    return F.concat(*pieces)


def render_text(f: DataFrame) -> DataFrame:
    """Add the sentence for each finding."""
    fields = {"label": F.col("label"), "n": F.col("n").cast("string"), "value": _fmt1(F.col("value"))}
    finding = F.col("finding")
    wave3 = (finding == "innovation_maturity") & (F.col("label") == "3.0")
    key = F.when(wave3, F.lit("innovation_maturity_3")) \
           .when(finding == "innovation_maturity", F.lit("innovation_maturity_2")).otherwise(finding)
    text = None
    for name, template in SENTENCES.items():
        branch = _sentence(template, fields)
        text = F.when(key == name, branch) if text is None else text.when(key == name, branch)
    return f.withColumn("text", text)
