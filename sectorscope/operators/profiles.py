"""Counts, shares, modes, top-N lists and per-group profiles of a result table.

Scale notes, for every operator here:
  * every ``groupBy`` is a hash aggregate with a partial (map-side) phase, so
    a label holding a third of all rows costs one partial row per task, not a
    hot reducer;
  * whole-table totals are attached to aggregated results as a scalar
    subquery (partial sums, one row); only ``archetype_summary`` sums its
    per-label rows with a window (one row per label, reason given there);
  * top-N uses ``orderBy().limit()`` (``TakeOrderedAndProject``: a partial
    top-N per task) or ``row_number() <= N`` per group, which Spark plans
    with a partial ``WindowGroupLimit`` before the shuffle;
  * the running sum has no partition key, so it is computed in two phases
    over range buckets of the ordering column (``running_sum``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectorscope.session import materialize

ARCH = "Predicted_Archetype"
WAVE = "Innovation_Wave"
DCS = "Driving_Capabilities"
SECONDARY = "Secondary_Archetypes"

# Capability codes and the labels the reference treats specially.
DC_CODES = ["DC1", "DC2", "DC3", "DC4", "DC5"]
EXACT_FAILURES = ["Unclassified", "API Error"]
ERROR_MARK = "Error"                    # a label containing it is an error
DC_MARK = "DC"                          # counted in the capability columns
DENSITY_HIGH_FROM = 3                   # average capabilities per row for "high"
DENSITY_HIGH, DENSITY_MODERATE = "high", "moderate"
# End of fixed values.


def pct(n: Column, total: Column) -> Column:
    """n * 100 / total as a double; null when total is 0."""
    return F.try_divide(n.cast("double") * F.lit(100.0), total.cast("double"))


def is_error(arch: Column | None = None) -> Column:
    """Label contains "Error"; a null label is not an error."""
    arch = F.col(ARCH) if arch is None else arch
    return F.coalesce(arch.contains(ERROR_MARK), F.lit(False))


def non_error_rows(df: DataFrame, arch_col: str = ARCH) -> DataFrame:
    return df.filter(~is_error(F.col(arch_col)))


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Rows per non-null value (like ``Series.value_counts``)."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))


def with_share(counts: DataFrame, n_col: str = "n", name: str = "share_pct",
               total: Column | None = None) -> DataFrame:
    """Share of each row of an aggregated result.

    The total is a scalar subquery: partial sums per task, one row at the
    end, and the rows themselves stay where they are (no single-partition
    window, however many labels a model returns). Spark reuses the input's
    exchange for the subquery, so the rows below are computed once; that
    holds when the subquery needs the same columns of ``counts`` as the
    query does. Pass ``total`` to use another expression of the total.
    """
    total = counts.agg(F.sum(n_col)).scalar() if total is None else total
    return counts.withColumn(name, pct(F.col(n_col), total))


def ranked(counts: DataFrame, label: str, n_col: str = "n") -> DataFrame:
    """Counts with ``place``, from 1 for the most frequent (ties: smallest label), in that order; one row a label."""
    order = Window.orderBy(F.desc(n_col), F.asc(label))
    return counts.withColumn("place", F.row_number().over(order)).orderBy("place")


def top_n(counts: DataFrame, label: str, n: int, n_col: str = "n") -> DataFrame:
    """Top ``n`` by count descending, label ascending."""
    return counts.orderBy(F.desc(n_col), F.asc(label)).limit(n)


# --- archetype distribution ---------------------------------------------------

def archetype_counts_all(df: DataFrame) -> DataFrame:
    """Rows per label, most frequent first (ties: smallest label)."""
    return value_counts(df, ARCH).orderBy(F.desc("n"), F.asc(ARCH))


def archetype_counts(df: DataFrame) -> DataFrame:
    """Rows per label without errors, most frequent first."""
    return value_counts(non_error_rows(df), ARCH).orderBy(F.desc("n"), F.asc(ARCH))


def archetype_share(df: DataFrame) -> DataFrame:
    return with_share(value_counts(non_error_rows(df), ARCH))


def archetype_mode(df: DataFrame) -> DataFrame:
    """Most frequent label over all rows; ties go to the smallest label."""
    return top_n(value_counts(df, ARCH), ARCH, 1)


def dominant_archetype(df: DataFrame) -> DataFrame:
    """Most frequent non-error label, its count and its share of non-error rows.

    Null labels are no error, so they count in the share's base; they are
    dropped only as candidates (above the window, so nothing is pushed down).
    """
    counts = non_error_rows(df).groupBy(ARCH).agg(F.count(F.lit(1)).alias("n"))
    return top_n(with_share(counts).filter(F.col(ARCH).isNotNull()), ARCH, 1)


def distinct_archetypes(df: DataFrame) -> DataFrame:
    return df.select(ARCH).distinct()


def archetype_diversity(df: DataFrame) -> DataFrame:
    return non_error_rows(df).agg(F.countDistinct(ARCH).alias("n_archetypes"))


def processed_count(saved: DataFrame, arch_col: str = ARCH) -> DataFrame:
    """Rows of a saved progress table that already hold a label (resume point), and all its rows."""
    arch = F.col(arch_col)
    return saved.agg(F.count_if(arch.isNotNull() & (arch != "")).alias("n_done"),
                     F.count(F.lit(1)).alias("n_saved"))


def confidence_mix(df: DataFrame) -> DataFrame:
    return value_counts(df, "Confidence_Score")


def success_rate_exact(df: DataFrame) -> DataFrame:
    """Share of rows not labelled exactly Unclassified / API Error."""
    ok = F.coalesce(~F.col(ARCH).isin(*EXACT_FAILURES), F.lit(True))
    out = df.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(ok).alias("n_classified"))
    return out.withColumn("success_rate", pct(F.col("n_classified"), F.col("n_total")))


def success_rate(df: DataFrame) -> DataFrame:
    """Share of rows whose label does not contain "Error"; 0 on empty input."""
    out = df.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(is_error()).alias("n_errors"))
    rate = F.coalesce(pct(F.col("n_total") - F.col("n_errors"), F.col("n_total")), F.lit(0.0))
    return out.withColumn("success_rate", rate)


# --- innovation waves ----------------------------------------------------------

def wave_counts(df: DataFrame) -> DataFrame:
    """Rows per wave, most frequent first."""
    return value_counts(df, WAVE).orderBy(F.desc("n"), F.asc(WAVE))


def wave_share(df: DataFrame) -> DataFrame:
    """Share of each wave, in order of the wave's label."""
    return with_share(value_counts(df, WAVE)).orderBy(WAVE)


def wave_maturity(df: DataFrame) -> DataFrame:
    """Share of wave 3.0 among rows with a wave; if none, share of 2.0."""
    w = F.col(WAVE)
    has = w.isNotNull() & (w != "")
    out = df.agg(F.count_if(has).alias("n_waves"),
                 F.count_if(w == "3.0").alias("n_wave3"),
                 F.count_if(w == "2.0").alias("n_wave2"),
                 F.count_if(w == "1.0").alias("n_wave1"))
    label = F.when(F.col("n_wave3") > 0, F.lit("3.0")).when(F.col("n_wave2") > 0, F.lit("2.0"))
    n = F.when(F.col("n_wave3") > 0, F.col("n_wave3")).when(F.col("n_wave2") > 0, F.col("n_wave2"))
    return out.withColumns({"maturity_wave": label, "maturity_pct": pct(n, F.col("n_waves"))})


# --- driving capabilities ------------------------------------------------------

def strip(x: Column) -> Column:
    """Leading and trailing whitespace of any kind removed (Python's ``str.strip()``)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def dc_list(col: str = DCS) -> Column:
    """Capability list: split on ",", each item stripped, empties dropped."""
    return F.filter(F.transform(F.split(F.col(col), ","), strip), lambda x: x != "")


def with_dc_flags(df: DataFrame, col: str = DCS) -> DataFrame:
    """One column per capability code: the code when listed, else null."""
    lst = dc_list(col)
    return df.withColumns({c: F.when(F.array_contains(lst, c), F.lit(c)) for c in DC_CODES})


def dc_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(DC_MARK)]


def capability_top10(df: DataFrame) -> DataFrame:
    """Split on ", " without trimming; "" counts as a value; top 10."""
    ex = df.select(F.explode(F.split(F.col(DCS), ", ")).alias("DC"))
    return top_n(value_counts(ex, "DC"), "DC", 10)


def capability_counts(df: DataFrame) -> DataFrame:
    """Mentions per capability, most frequent first."""
    ex = df.select(F.explode(dc_list()).alias("DC"))
    return value_counts(ex, "DC").orderBy(F.desc("n"), F.asc("DC"))


def _dc_mentions(df: DataFrame, cols: list[str]) -> list[Column]:
    return [F.count_if(F.coalesce(F.col(c).contains(DC_MARK), F.lit(False))).alias(c) for c in cols]


def _long_form(df: DataFrame, cols: list[str], key: str, value: str) -> DataFrame:
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias(key), F.col(c).cast("bigint").alias(value))
                                        for c in cols])))


def top_capability(df: DataFrame) -> DataFrame:
    """The DC column with most rows mentioning "DC" (ties: first column)."""
    flagged = with_dc_flags(df) if not dc_columns(df) else df
    cols = dc_columns(flagged)
    counts = flagged.agg(*_dc_mentions(flagged, cols)).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(c).alias("DC"), F.col(c).cast("bigint").alias("n"))
        for i, c in enumerate(cols)])))
    return counts.filter(F.col("n") > 0).orderBy(F.desc("n"), "place").limit(1).select("DC", "n")


def capability_density(df: DataFrame) -> DataFrame:
    """Average number of "DC" mentions per row over the DC columns."""
    flagged = with_dc_flags(df) if not dc_columns(df) else df
    cols = dc_columns(flagged)
    per_row = sum((F.coalesce(F.regexp_count(F.col(c), F.lit(DC_MARK)), F.lit(0)) for c in cols), F.lit(0))
    out = flagged.agg(F.avg(per_row).alias("avg_dcs"))
    level = F.when(F.col("avg_dcs") >= DENSITY_HIGH_FROM, F.lit(DENSITY_HIGH)).otherwise(F.lit(DENSITY_MODERATE))
    return out.withColumn("level", level)


def capability_heatmap(df: DataFrame) -> DataFrame:
    """Archetype x capability counts, capabilities as columns (fixed list: no extra job)."""
    ex = df.select(ARCH, F.explode(dc_list()).alias("DC"))
    out = ex.groupBy(ARCH).pivot("DC", DC_CODES).count()
    return out.fillna(0, subset=DC_CODES)


def wave_archetype(df: DataFrame) -> DataFrame:
    return df.groupBy(WAVE, ARCH).agg(F.count(F.lit(1)).alias("n"))


def year_archetype(df: DataFrame) -> DataFrame:
    return df.groupBy("Founded_Year", ARCH).agg(F.count(F.lit(1)).alias("n"))


def hybrid_share(df: DataFrame) -> DataFrame:
    s = F.col(SECONDARY)
    has = s.isNotNull() & (s != "") & (s != "[]")
    out = df.agg(F.count_if(has).alias("n_hybrid"), F.count(F.lit(1)).alias("n_total"))
    return out.withColumn("hybrid_pct", pct(F.col("n_hybrid"), F.col("n_total")))


# --- per-group profiles --------------------------------------------------------

def profile_cube(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Row counts per (label, wave, has-secondary, "DC" mentions per DC column).

    One hash aggregate with a map-side partial phase: every profile that
    needs several views of the rows (findings, per-label summaries) derives
    them from this small table, so the rows are read once and Spark reuses
    the one exchange across branches. Returns the cube and the DC columns.
    """
    flagged = with_dc_flags(df) if not dc_columns(df) else df
    cols = dc_columns(flagged)
    sec = F.col(SECONDARY)
    keys = [F.col(ARCH).alias("label"), F.col(WAVE).alias("wave"),
            (sec.isNotNull() & (sec != "") & (sec != "[]")).alias("has_sec")]
    keys += [F.coalesce(F.regexp_count(F.col(c), F.lit(DC_MARK)), F.lit(0)).alias(c) for c in cols]
    cube = flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return cube, cols


def _sum_if(cond: Column, n: Column | None = None) -> Column:
    n = F.col("n") if n is None else n
    return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("bigint")


def archetype_summary(df: DataFrame) -> DataFrame:
    """Per label: rows, share of all rows, dominant wave, top-3 DC columns.

    Two hash aggregates and no join, then one row per label is written to the
    shared folder and the total is a scalar over it: rows -> (label, wave) with per-column
    "DC" mention counts -> label, where the dominant wave (most rows, ties to
    the smallest wave) is a ``min_by`` with constant state per group.
    """
    flagged = with_dc_flags(df) if not dc_columns(df) else df
    cols = dc_columns(flagged)
    mentions = [F.count_if(F.coalesce(F.col(c).contains(DC_MARK), F.lit(False))).alias(c) for c in cols]
    per_wave = flagged.groupBy(F.col(ARCH).alias("label"), F.col(WAVE).alias("wave")).agg(
        F.count(F.lit(1)).alias("n"), *mentions)
    rank = F.when(F.col("wave").isNotNull(), F.struct((-F.col("n")).alias("neg"), F.col("wave").alias("wave")))
    base = per_wave.groupBy("label").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in cols],
                                         F.min_by("wave", rank).alias("dominant_wave"))
    # written once: the total and the rows below read the same small table, the input is classified once
    base = with_share(materialize(base, "labels"), name="pct").filter(F.col("label").isNotNull())
    ranked = F.sort_array(F.array(*[F.struct((-F.col(c)).alias("neg"), F.lit(i).alias("i"), F.lit(c).alias("dc"))
                                    for i, c in enumerate(cols)]))
    any_dc = sum((F.col(c) for c in cols), F.lit(0)) > 0
    top3 = F.when(any_dc, F.array_join(F.transform(F.slice(ranked, 1, 3), lambda s: s["dc"]), ", "))
    return base.select(F.col("label").alias(ARCH), F.col("n").cast("bigint").alias("n"), "pct",
                       top3.alias("top_capabilities"), "dominant_wave")


NO_WAVE = "\u0000no wave\u0000"  # join key standing in for a null wave


def wave_profile(df: DataFrame) -> DataFrame:
    """Per wave: rows, share of all rows, top-3 labels as "label: n, ...".

    Both branches read one ``per`` aggregate (wave x label counts); Spark
    shares its exchange only if neither branch filters on its keys, since
    such a filter is pushed below the aggregate and makes the branches
    differ. So null labels rank last and are dropped above the window (not a
    window key), and null waves drop out of the join, whose key is never
    null, so Catalyst infers no filter from it either.
    """
    per = df.groupBy(WAVE, ARCH).agg(F.count(F.lit(1)).alias("n"))
    sizes = with_share(per.groupBy(WAVE).agg(F.sum("n").alias("n")), name="pct")
    sizes = sizes.filter(F.col(WAVE).isNotNull())
    w = Window.partitionBy(WAVE).orderBy(F.col(ARCH).isNull(), F.desc("n"), F.asc(ARCH))
    top = (per.withColumn("rank", F.row_number().over(w))
              .filter((F.col("rank") <= 3) & F.col(ARCH).isNotNull()))
    label = lambda s: F.concat(s[ARCH], F.lit(": "), s["n"].cast("string"))
    top = (top.groupBy(WAVE)
              .agg(F.sort_array(F.collect_list(F.struct("rank", ARCH, "n"))).alias("t"))
              .select(F.coalesce(F.col(WAVE), F.lit(NO_WAVE)).alias("_w"),
                      F.array_join(F.transform("t", label), ", ").alias("top_archetypes")))
    out = sizes.join(top, F.coalesce(sizes[WAVE], F.lit(NO_WAVE)) == top["_w"], "left")
    return out.drop("_w")


def running_sum(df: DataFrame, order_col: str, value: Column, name: str, keep: list[str] | None = None) -> DataFrame:
    """Running sum of ``value`` in ``order_col`` order, without a single-partition window over the rows.

    The rows are written once to the shared folder, since finding the ranges
    reads them twice, range-partitioned on ``order_col`` (any orderable type)
    and written with the number of their partition; the partition sums (one row per partition) get an exclusive prefix sum,
    which is added to the running sum inside each partition. Ties in
    ``order_col`` must not exist (it is a row id).
    """
    cols = [order_col] + [c for c in (keep or []) if c != order_col]
    rows = materialize(df.select(*cols, value.alias("_v")), "running-sum-rows")
    parts = materialize(rows.repartitionByRange(order_col)
                        .withColumn("_part", F.spark_partition_id()), "running-sum")
    totals = parts.groupBy("_part").agg(F.sum("_v").alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_part").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return (parts.withColumn("_run", F.sum("_v").over(w)).join(offsets, "_part")
            .withColumn(name, F.col("_run") + F.col("_before")).drop("_part", "_v", "_run", "_before"))
