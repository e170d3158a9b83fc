"""The scoring lexicon as data.

A lexicon is an ordered list of categories, each with an ordered keyword
list. Category order is the tie-break order; keyword order is the order in
which found keywords are reported. Lexicons are small by nature (tens to a
few thousand keywords); ``Lexicon.check_size`` enforces an explicit bound
before a lexicon is folded into a query plan as literals. Larger keyword
sets go through ``operators.lexicon_join`` instead, which joins on keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's for identical results.
# Default lexicon: category -> keywords, in this order (order breaks ties).
DEFAULT_LEXICON: list[tuple[str, list[str]]] = [
    ("Enablers", [
        "platform", "infrastructure", "saas", "cloud", "back-end", "white-label",
        "technology provider", "software", "api", "core system", "digitize",
        "analytics", "data provider", "underwriting platform", "claims management", "b2b",
    ]),
    ("Connectors", [
        "marketplace", "comparison", "broker", "aggregator", "connect", "match",
        "distribution", "agency", "mga", "intermediary", "portal", "agent", "buying",
    ]),
    ("Innovators", [
        "on-demand", "p2p", "peer-to-peer", "parametric", "microinsurance",
        "usage-based", "gig economy", "new model", "pay-per-mile", "innovative product", "crypto",
    ]),
    ("Disruptors", [
        "automation", "ai-driven", "instant", "machine learning", "disrupt",
        "fully digital", "carrier", "full-stack", "replace", "artificial intelligence", "challenger",
    ]),
    ("Protectors", [
        "prevention", "mitigation", "monitoring", "iot", "wearables", "telematics",
        "cyber", "security", "predict", "alert", "safety", "risk management", "health", "wellness",
    ]),
    ("Integrators", [
        "embedded", "point of sale", "b2b2c", "partner", "integration", "add-on",
        "api-first", "checkout", "plugin", "ecommerce",
    ]),
    ("Transformers", [
        "digital transformation", "modernize", "legacy systems",
        "change management", "insurance transformation", "tech advisory",
        "implementation partner", "core replacement", "digitization strategy",
        "it consulting",
    ]),
]

# Generic words used when no category scores (reported in this order).
GENERIC_WORDS: list[str] = [
    "insurance", "agency", "brokerage", "services", "ltd", "inc", "group", "solutions",
]

# Result labels.
HYBRID = "Hybrid"
GENERALIST = "Traditional / Generalist"
UNCLASSIFIED = "Unclassified"
# Confidence labels, and the best scores at which High / Medium start.
HIGH, MEDIUM, LOW = "High", "Medium", "Low"
HIGH_FROM, MEDIUM_FROM = 3, 1
# End of fixed values.
# ---------------------------------------------------------------------------

# Our own high-hit lexicon for long multilingual texts (test design, not the
# reference's): seven categories p1..p7 of common function words.
PROBE_LEXICON: list[tuple[str, list[str]]] = [
    ("p1", ["the", "and"]),
    ("p2", ["that", "with"]),
    ("p3", ["der", "und"]),
    ("p4", ["que", "des"]),
    ("p5", ["for", "was"]),
    ("p6", ["los", "una"]),
    ("p7", ["this", "from"]),
]

# Folding a lexicon into the plan puts every keyword in the generated code of
# each task; keep that bounded. Above this, use the join-based scorer.
MAX_LITERAL_KEYWORDS = 5000
MAX_LITERAL_BYTES = 256 * 1024


@dataclass(frozen=True)
class Lexicon:
    categories: tuple[str, ...]
    keywords: tuple[tuple[str, ...], ...]
    generic: tuple[str, ...] = field(default=tuple(GENERIC_WORDS))

    @staticmethod
    def of(pairs: list[tuple[str, list[str]]], generic: list[str] | None = None) -> "Lexicon":
        lex = Lexicon(
            categories=tuple(c for c, _ in pairs),
            keywords=tuple(tuple(k) for _, k in pairs),
            generic=tuple(GENERIC_WORDS if generic is None else generic),
        )
        lex.check_size()
        return lex

    @property
    def match_keywords(self) -> tuple[tuple[str, ...], ...]:
        """Keywords as matched against lower-cased text."""
        return tuple(tuple(k.lower() for k in ks) for ks in self.keywords)

    @property
    def case_sensitive_display(self) -> bool:
        """True when some keyword differs from its lower-case form."""
        return any(k != k.lower() for ks in self.keywords for k in ks)

    @property
    def n_keywords(self) -> int:
        return sum(len(ks) for ks in self.keywords)

    @property
    def needs_word_guard(self) -> bool:
        """The zero-word rule only matters if a keyword has no word character.

        A text without any word character has no words; every keyword with a
        letter, digit or underscore then scores 0 on it anyway. So the regex
        guard is compiled into the plan only when the lexicon needs it.
        """
        def has_word_char(s: str) -> bool:
            return any(ch.isalnum() or ch == "_" for ch in s)
        return not all(has_word_char(k) for ks in self.keywords for k in ks)

    def check_size(self) -> None:
        nbytes = sum(len(k.encode()) for ks in self.keywords for k in ks)
        if self.n_keywords > MAX_LITERAL_KEYWORDS or nbytes > MAX_LITERAL_BYTES:
            raise ValueError(
                f"lexicon of {self.n_keywords} keywords / {nbytes} bytes is too large to fold "
                "into the plan; use operators.lexicon_join.score_by_join")
        if any(not k for ks in self.keywords for k in ks):
            raise ValueError("empty keyword")
        if any("\u0000" in k for ks in self.keywords for k in (*ks, *self.generic)):
            raise ValueError("keyword holds a NUL character")
        if len(set(self.categories)) != len(self.categories):
            raise ValueError("duplicate category")

    def rows(self) -> list[tuple[int, str, int, str]]:
        """(category ordinal, category, keyword ordinal, keyword), 1-based."""
        return [(ci + 1, c, ki + 1, k)
                for ci, (c, ks) in enumerate(zip(self.categories, self.keywords))
                for ki, k in enumerate(ks)]

    def to_df(self, spark: SparkSession) -> DataFrame:
        """Long form: one row per keyword."""
        return spark.createDataFrame(
            self.rows(), "cat_ord int, category string, kw_ord int, keyword string")

    @staticmethod
    def from_df(df: DataFrame, generic: list[str] | None = None) -> "Lexicon":
        """Read a lexicon table (category_ord, category, kw_ord, keyword).

        The table is aggregated to one row per category on the cluster and
        its size is checked before anything reaches the driver.
        """
        n = df.count()
        if n > MAX_LITERAL_KEYWORDS:
            raise ValueError(f"lexicon table has {n} keywords; use operators.lexicon_join")
        per_cat = (df.groupBy("cat_ord", "category")
                     .agg(F.sort_array(F.collect_list(F.struct("kw_ord", "keyword"))).alias("kws"))
                     .orderBy("cat_ord").collect())
        pairs = [(r["category"], [x["keyword"] for x in r["kws"]]) for r in per_cat]
        return Lexicon.of(pairs, generic)


def default_lexicon() -> Lexicon:
    return Lexicon.of(DEFAULT_LEXICON)


def probe_lexicon() -> Lexicon:
    return Lexicon.of(PROBE_LEXICON)


def read_lexicon(spark: SparkSession, path: str, fmt: str | None = None,
                 generic: list[str] | None = None) -> Lexicon:
    """Load a lexicon table (``cat_ord, category, kw_ord, keyword``) from CSV or Parquet.

    Ordinals decide the tie-break and reporting order; the size is checked
    on the cluster before the keywords are folded into a plan.
    """
    fmt = fmt or ("csv" if path.rstrip("/").lower().endswith(".csv") else "parquet")
    if fmt == "csv":
        df = (spark.read.option("header", True)
                   .schema("cat_ord int, category string, kw_ord int, keyword string").csv(path))
    else:
        df = spark.read.format(fmt).load(path)
    return Lexicon.from_df(df, generic)
