"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Inputs are the driver tables or views Spark derives from them
(``sources.tables.companies`` / ``responses``), so every query's work grows
with the data. Each computed column is aliased to the name used by the
matching DuckDB SQL in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sectorscope.functions import text as tx
from sectorscope.functions.lexicon import Lexicon, default_lexicon, probe_lexicon
from sectorscope.operators import answer_log, corrections, explore, label_sketches, live_cube, profiles, responses as rs, resume, search_index
from sectorscope.operators.classify import classify_companies, classify_text, score
from sectorscope.operators.lexicon_join import classify_by_join
from sectorscope.session import materialize, scratch_path
from sectorscope.sources import files, positions
from sectorscope.sources.tables import (COMPANY_AUX, COMPANY_DESC, companies, read_table,
                                        responses, spread)
from sectorscope.streaming import incremental, keyed

Query = Callable[[SparkSession, str], DataFrame]

INDUSTRY_COLS = ["Industries", "industry_groups"]
RESULT6 = rs.RESULT_COLUMNS
# Parameters of the registered queries (test design).
EXPLORER_LABELS = ["Hybrid", "Enablers"]
SEARCH_COMPANIES = "hybrid|iot"
SEARCH_DOCS = "licen[cs]e|passw"
AGE_CUTOFF = 2010
SCORER = "native"


# --- shared building blocks ------------------------------------------------------

def _classified(spark: SparkSession, sf_dir: str, scorer: str = SCORER) -> DataFrame:
    """companies + keyword result (six result columns)."""
    return classify_companies(spread(companies(spark, sf_dir), "company_id"), COMPANY_DESC, COMPANY_AUX, scorer=scorer)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """companies + combined text + scores / found + keyword result."""
    c = spread(companies(spark, sf_dir), "company_id")
    c = c.withColumn("text", tx.combined_text(c, COMPANY_DESC, COMPANY_AUX))
    return classify_text(c, "text", keep_scores=True)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.parse_responses(rs.answered(responses(spark, sf_dir)))


def _model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model mode: stored response where present, keyword result otherwise.

    The stored ``responses`` table answers the rendered requests (its prompt
    column is pruned, since this responder does not read it).
    """
    c = companies(spark, sf_dir)
    stored = spread(responses(spark, sf_dir), "company_id")
    return rs.classify_with_model(c, _classified(spark, sf_dir), rs.stored_responder(stored),
                                  tx.company_name(c), tx.combined_text(c, COMPANY_DESC, COMPANY_AUX),
                                  tx.industries(c, INDUSTRY_COLS))


def _scores_str(c: Column | None = None) -> Column:
    c = F.col("scores") if c is None else c
    return F.array_join(F.transform(c, lambda s: s.cast("string")), ",")


def _found_str(c: Column | None = None) -> Column:
    c = F.col("found") if c is None else c
    return F.array_join(F.transform(c, lambda ks: F.array_join(ks, ", ")), " | ")


def _rank_struct(scores: Column, cats: Column, pos: int) -> Column:
    """pos-th entry (1-based) of the stable descending sort of the category scores."""
    keyed = F.transform(scores, lambda s, i: F.struct((-s).alias("neg"), i.alias("i"), s.alias("s")))
    e = F.element_at(F.sort_array(keyed), pos)
    return F.struct(F.element_at(cats, (e["i"] + 1).cast("int")).alias("category"), e["s"].alias("score"))


def _cats(lex: Lexicon) -> Column:
    return F.array(*[F.lit(c) for c in lex.categories])


# --- scans, mapping, projections -------------------------------------------------

def q_scan_companies(spark, sf_dir):
    """Two sets of files in one folder, with their columns in opposite orders."""
    path = scratch_path(spark, "companies") + ".csv"
    c = companies(spark, sf_dir)
    odd = F.col("company_id") % 2 == 1
    files.write_csv(c.where(~odd), path)
    files.write_csv(c.where(odd).select(*reversed(c.columns)), path, mode="append")
    return files.scan(spark, path).select(*c.columns)


def _scan_as(fmt: str, write: Callable[[DataFrame, str], None]) -> Query:
    def query(spark, sf_dir):
        path = scratch_path(spark, "companies") + f".{fmt}"
        write(companies(spark, sf_dir), path)
        return files.scan(spark, path)
    return query


def q_scan_multiline(spark, sf_dir):
    """Texts with line breaks, commas and quotes in their cells, in CSV files that are read in ranges."""
    path = scratch_path(spark, "documents") + ".csv"
    files.write_csv(_docs(spark, sf_dir).select("doc_id", "text", "lang", "source"), path)
    return files.scan(spark, path)


def q_scan_inferred(spark, sf_dir):
    """CSV columns of every kind the type lattice knows, read back in their types."""
    path = scratch_path(spark, "orders") + ".csv"
    k = F.col("o_orderkey")
    files.write_csv(read_table(spark, sf_dir, "orders").select(
        k.alias("whole"), F.when(k % 7 != 0, k * 1000).alias("whole_or_null"), F.col("o_totalprice").alias("number"),
        F.when(k % 3 == 0, F.lit("1.5")).otherwise(k.cast("string")).alias("whole_or_number"),
        F.when(k % 2 == 0, F.lit("True")).when(k % 5 != 0, F.lit("false")).alias("truth"),
        F.when(k % 1000 == 1, F.lit("about 3")).otherwise(k.cast("string")).alias("mostly_whole"),
        F.when(k % 2 == 0, F.lit("true")).otherwise(F.lit("1")).alias("truth_and_number"),
        F.col("o_orderpriority").alias("text"), F.lit(None).cast("string").alias("nothing")), path)
    return files.infer_types(files.scan(spark, path))


def _ordered_csv(spark, df, order_col, label, file_count):
    """``df`` without its id, as CSV files whose rows stand in its order."""
    path = scratch_path(spark, label) + ".csv"
    ordered = df.repartitionByRange(file_count, order_col).sortWithinPartitions(order_col)
    files.write_csv(ordered.drop(order_col), path)
    return positions.scan_with_position(spark, path)


def q_input_positions(spark, sf_dir):
    """The place of every row of a table without ids, over several files."""
    return _ordered_csv(spark, companies(spark, sf_dir), "company_id", "places", 4).select(
        F.col(positions.POSITION).alias("position"), "Company", "Description")


def q_first_rows(spark, sf_dir):
    """The first ten rows of a classified table without ids."""
    placed = _ordered_csv(spark, companies(spark, sf_dir), "company_id", "places", 3)
    out = positions.first_rows(classify_companies(placed, COMPANY_DESC, COMPANY_AUX, scorer=SCORER), 10)
    return out.select(F.col(positions.POSITION).alias("position"), "Company", "Predicted_Archetype", "Confidence_Score")


def q_positional_join(spark, sf_dir):
    """Results put beside their rows by position, the two tables written in different numbers of files."""
    c = companies(spark, sf_dir)
    left = _ordered_csv(spark, c.select("company_id", "Company", "founded"), "company_id", "left", 5)
    path = scratch_path(spark, "right")
    (_classified(spark, sf_dir).select("company_id", "Predicted_Archetype", "Keywords_Found")
     .repartitionByRange(3, "company_id").sortWithinPartitions("company_id").drop("company_id").write.parquet(path))
    right = positions.scan_with_position(spark, path, "parquet")
    return positions.positional_join(left, right).withColumnRenamed(positions.POSITION, "position")


def q_upload_mapping(spark, sf_dir):
    c = companies(spark, sf_dir)
    name, desc = files.column_mapping(c.columns, rule="upload")
    return c.select(F.col(name).cast("string").alias("name"), F.col(desc).cast("string").alias("description"))


def q_null_normalise(spark, sf_dir):
    from sectorscope.sources.tables import raw_companies
    return files.null_normalise(raw_companies(spark, sf_dir))


def q_column_mapping(spark, sf_dir):
    c = companies(spark, sf_dir)
    name, desc = files.column_mapping(c.columns)
    return c.select(F.col(name).cast("string").alias("name"), F.col(desc).cast("string").alias("description"))


def q_table_shape(spark, sf_dir):
    return files.table_shape(companies(spark, sf_dir))


def q_combined_text(spark, sf_dir):
    c = companies(spark, sf_dir)
    return c.select("company_id", tx.combined_text(c, COMPANY_DESC, COMPANY_AUX).alias("combined_text"))


def q_company_name(spark, sf_dir):
    c = companies(spark, sf_dir)
    return c.select("company_id", tx.company_name(c).alias("company_name"),
                    tx.industries(c, INDUSTRY_COLS).alias("industries"))


def q_word_count(spark, sf_dir):
    c = companies(spark, sf_dir)
    t = tx.combined_text(c, COMPANY_DESC, COMPANY_AUX)
    return c.select("company_id", tx.word_count(t).cast("bigint").alias("word_count"))


# --- classification --------------------------------------------------------------

def q_archetype_scores(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("company_id", _scores_str().alias("scores"),
                    F.array_max("scores").cast("bigint").alias("best_score"))


def q_keywords_found(spark, sf_dir):
    s = _scored(spark, sf_dir)
    n = F.aggregate("found", F.lit(0), lambda acc, ks: acc + F.size(ks))
    return s.select("company_id", _found_str().alias("found"), n.cast("bigint").alias("n_found"))


def q_archetype_rank(spark, sf_dir):
    s = _scored(spark, sf_dir)
    cats = _cats(default_lexicon())
    r1, r2 = _rank_struct(F.col("scores"), cats, 1), _rank_struct(F.col("scores"), cats, 2)
    return s.select("company_id", r1["category"].alias("first_category"), r1["score"].cast("bigint").alias("first_score"),
                    r2["category"].alias("second_category"), r2["score"].cast("bigint").alias("second_score"))


def q_generic_fallback(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return (s.filter(F.array_max("scores") == 0)
             .select("company_id", "Predicted_Archetype", F.col("Keywords_Found").alias("generic_words")))


def q_hybrid_detect(spark, sf_dir):
    s = _scored(spark, sf_dir).filter(F.col("Predicted_Archetype") == "Hybrid")
    cats = _cats(default_lexicon())
    r1, r2 = _rank_struct(F.col("scores"), cats, 1), _rank_struct(F.col("scores"), cats, 2)
    return s.select("company_id", r1["category"].alias("first_category"),
                    r2["category"].alias("second_category"), "Keywords_Found")


def q_confidence_mix(spark, sf_dir):
    return profiles.confidence_mix(_classified(spark, sf_dir))


def q_classify_keywords(spark, sf_dir):
    return _classified(spark, sf_dir).select("company_id", *RESULT6)


def q_lexicon_join(spark, sf_dir):
    c = companies(spark, sf_dir)
    c = c.select("company_id", tx.combined_text(c, COMPANY_DESC, COMPANY_AUX).alias("text"))
    # written, as the operator numbers its rows and dealt rows come in any order
    c = materialize(spread(c, "company_id"), "company-texts")
    out = classify_by_join(c, "company_id", "text", default_lexicon(), keep_scores=True)
    return out.select("company_id", _scores_str().alias("scores"), "Predicted_Archetype",
                      "Confidence_Score", "Keywords_Found")


# --- documents variants (probe lexicon, whole texts) -------------------------------

def q_archetype_scores_docs(spark, sf_dir):
    s = score(_docs(spark, sf_dir), "text", probe_lexicon())
    return s.select("doc_id", _scores_str().alias("scores"), F.array_max("scores").cast("bigint").alias("best_score"))


def q_keywords_found_docs(spark, sf_dir):
    s = score(_docs(spark, sf_dir), "text", probe_lexicon())
    n = F.aggregate("found", F.lit(0), lambda acc, ks: acc + F.size(ks))
    return s.select("doc_id", _found_str().alias("found"), n.cast("bigint").alias("n_found"))


def q_classify_keywords_docs(spark, sf_dir):
    out = classify_text(_docs(spark, sf_dir), "text", probe_lexicon())
    return out.select("doc_id", "Predicted_Archetype", "Confidence_Score", "Keywords_Found")


def q_classify_keywords_docs_arrow(spark, sf_dir):
    out = classify_text(_docs(spark, sf_dir), "text", probe_lexicon(), scorer="arrow")
    return out.select("doc_id", "Predicted_Archetype", "Confidence_Score", "Keywords_Found")


def q_classify_default_docs(spark, sf_dir):
    out = classify_text(_docs(spark, sf_dir), "text", default_lexicon())
    return out.select("doc_id", "Predicted_Archetype", "Confidence_Score", "Keywords_Found")


# JVM-only variants (no Python workers): same results as the default scorer

def q_classify_keywords_docs_native(spark, sf_dir):
    out = classify_text(_docs(spark, sf_dir), "text", probe_lexicon(), scorer="native")
    return out.select("doc_id", "Predicted_Archetype", "Confidence_Score", "Keywords_Found")


def q_classify_default_docs_native(spark, sf_dir):
    out = classify_text(_docs(spark, sf_dir), "text", default_lexicon(), scorer="native")
    return out.select("doc_id", "Predicted_Archetype", "Confidence_Score", "Keywords_Found")


def q_classify_keywords_native(spark, sf_dir):
    return _classified(spark, sf_dir, scorer="native").select("company_id", *RESULT6)


def q_explorer_search_docs(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return explore.search(d, SEARCH_DOCS).select("doc_id", "lang", "source")


def _searched(spark, sf_dir):
    d = _docs(spark, sf_dir)
    path = scratch_path(spark, "postings")
    search_index.build_index(d, "doc_id", path)
    return d, *search_index.search_indexed(d, "doc_id", path, SEARCH_DOCS)


def q_explorer_search_indexed(spark, sf_dir):
    """The search of ``explorer_search_docs`` through the posting table."""
    return _searched(spark, sf_dir)[1].select("doc_id", "lang", "source")


def q_search_scanned(spark, sf_dir):
    """How many rows the indexed search tests, of how many."""
    d, found, tested = _searched(spark, sf_dir)
    count = lambda x, name: x.agg(F.count("*").alias(name))
    return count(tested, "n_tested").withColumns({"n_found": count(found, "n").scalar(), "n_total": count(d, "n").scalar()})


def word_lexicon(docs: DataFrame) -> DataFrame:
    """A lexicon table that grows with the texts: every word of eight small letters or more that two of them have."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), 0))).alias("keyword"))
    cat = F.ascii("keyword") % 7 + 1
    return (words.groupBy("keyword").count().where("count >= 2")
            .select((cat * 10).alias("cat_ord"), F.concat(F.lit("w"), cat.cast("string")).alias("category"),
                    F.length("keyword").alias("kw_ord"), "keyword"))


def q_lexicon_join_docs(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "text")
    out = classify_by_join(d, "doc_id", "text", lex_df=materialize(word_lexicon(d), "word-lexicon"), keep_scores=True)
    return out.select("doc_id", _scores_str().alias("scores"), "Predicted_Archetype",
                      "Confidence_Score", "Keywords_Found")


# --- previews, explorer, distribution ----------------------------------------------

def q_recent_classifications(spark, sf_dir):
    return explore.recent(_classified(spark, sf_dir), "company_id", 10)


def q_head_per_archetype(spark, sf_dir):
    return explore.head_per_label(_classified(spark, sf_dir), "company_id", 5)


def q_explorer_filter(spark, sf_dir):
    out = explore.filter_labels(_classified(spark, sf_dir), EXPLORER_LABELS)
    return out.select("company_id", "Company", "Predicted_Archetype", "Confidence_Score")


def q_explorer_counts(spark, sf_dir):
    return explore.filter_counts(_classified(spark, sf_dir), EXPLORER_LABELS)


def q_explorer_search_counts(spark, sf_dir):
    """Shown and total rows under the labels and the search together."""
    return explore.filter_counts(_classified(spark, sf_dir), EXPLORER_LABELS, pattern=SEARCH_COMPANIES)


def q_explorer_search(spark, sf_dir):
    out = explore.search(_classified(spark, sf_dir), SEARCH_COMPANIES)
    return out.select("company_id", "Predicted_Archetype")


def q_distinct_archetypes(spark, sf_dir):
    return profiles.distinct_archetypes(_classified(spark, sf_dir))


def q_archetype_counts_all(spark, sf_dir):
    return profiles.archetype_counts_all(_classified(spark, sf_dir))


def q_archetype_counts(spark, sf_dir):
    return profiles.archetype_counts(_classified(spark, sf_dir))


def q_archetype_ranking(spark, sf_dir):
    return profiles.ranked(profiles.archetype_counts(_classified(spark, sf_dir)), profiles.ARCH)


def q_wave_ranking(spark, sf_dir):
    return profiles.ranked(profiles.wave_counts(_model_results(spark, sf_dir)), profiles.WAVE)


def q_capability_ranking(spark, sf_dir):
    return profiles.ranked(profiles.capability_counts(_model_results(spark, sf_dir)), "DC")


def q_empty_table_rates(spark, sf_dir):
    """Both success rates and the hybrid share of a table without rows."""
    none = materialize(_classified(spark, sf_dir).where(F.col("company_id") < 0), "no-rows")  # read by three profiles
    exact = profiles.success_rate_exact(none).select(F.col("n_total").alias("n_exact"), F.col("success_rate").alias("exact_rate"))
    return (exact.join(profiles.success_rate(none), exact["n_exact"] == F.col("n_total"))
            .join(profiles.hybrid_share(none).select("n_hybrid", F.col("n_total").alias("n_rows"), "hybrid_pct"),
                  exact["n_exact"] == F.col("n_rows")))


def q_archetype_mode(spark, sf_dir):
    return profiles.archetype_mode(_classified(spark, sf_dir))


def q_archetype_share(spark, sf_dir):
    return profiles.archetype_share(_classified(spark, sf_dir))


def q_success_rate_exact(spark, sf_dir):
    return profiles.success_rate_exact(_classified(spark, sf_dir))


def _saved_progress(spark, sf_dir):
    """A saved progress table: the rows with an industry, classified earlier."""
    saved = companies(spark, sf_dir).filter(F.col("Industries").isNotNull())
    return classify_companies(saved, COMPANY_DESC, COMPANY_AUX, scorer=SCORER)


def q_resume_done_count(spark, sf_dir):
    return profiles.processed_count(_saved_progress(spark, sf_dir))


def q_resume_pending(spark, sf_dir):
    """Rows not yet in a saved progress table, classified; progress = rows with an industry."""
    path = scratch_path(spark, "progress")
    _saved_progress(spark, sf_dir).write.parquet(path)
    pending = resume.pending_rows(companies(spark, sf_dir), spark.read.parquet(path), "company_id")
    out = classify_companies(pending, COMPANY_DESC, COMPANY_AUX, scorer=SCORER)
    return out.select("company_id", "Predicted_Archetype", "Confidence_Score")


# --- founding year, age correction -------------------------------------------------

def _aged(spark, sf_dir, cutoff=AGE_CUTOFF):
    return corrections.age_correction(corrections.founding_year(_classified(spark, sf_dir)), cutoff)


def q_founding_year(spark, sf_dir):
    return corrections.founding_year(companies(spark, sf_dir)).select("company_id", "founded", "Founded_Year")


def q_founding_year_orders(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("launch_date"))
    return corrections.founding_year(o).select("o_orderkey", "Founded_Year")


def q_founding_year_dates(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    o = o.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("launch_date"))
    return corrections.founding_year(o).select("o_orderkey", "launch_date", "Founded_Year")


def q_age_correction(spark, sf_dir):
    return _aged(spark, sf_dir).select("company_id", "Predicted_Archetype", "Founded_Year", "Age_Corrected")


def q_age_correction_count(spark, sf_dir):
    a = _aged(spark, sf_dir)
    return a.agg(F.count_if(F.coalesce(F.col("Age_Corrected"), F.lit(False))).alias("n_corrected"))


def q_year_archetype(spark, sf_dir):
    return profiles.year_archetype(_aged(spark, sf_dir))


# --- requests and cost estimates ---------------------------------------------------

def _requests(spark, sf_dir):
    c = companies(spark, sf_dir)
    return rs.render_requests(c, tx.company_name(c), tx.combined_text(c, COMPANY_DESC, COMPANY_AUX),
                              tx.industries(c, INDUSTRY_COLS))


def q_request_render(spark, sf_dir):
    return _requests(spark, sf_dir).select("company_id", "prompt")


def q_token_estimate(spark, sf_dir):
    r = _requests(spark, sf_dir)
    return r.select("company_id", F.length("prompt").cast("bigint").alias("prompt_chars"),
                    rs.token_estimate(F.col("prompt")).alias("est_tokens"))


def q_cost_estimate(spark, sf_dir):
    n = companies(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_companies"))
    return n.withColumns(rs.estimated_cost(F.col("n_companies")))


# --- responses ---------------------------------------------------------------------

def q_response_parse(spark, sf_dir):
    return _parsed(spark, sf_dir).select("company_id", "error_class", *RESULT6)


def q_response_errors(spark, sf_dir):
    p = _parsed(spark, sf_dir).filter(F.col("error_class").isNotNull() | F.col("type_mismatch"))
    return p.select("company_id", "error_class", "type_mismatch", "Predicted_Archetype", "Keywords_Found")


def q_result_projection(spark, sf_dir):
    return _model_results(spark, sf_dir).select("company_id", "Secondary_Archetypes", "Driving_Capabilities")


#: Parts of the answer log's query, and the first one in which its first run fails.
LOG_PARTS, FAILING_PART = 16, 8


def _stand_in_model(pdf):
    """Answers by the length of the prompt; each third one is no JSON."""
    import json
    labels = ["Enablers", "Connectors", "Innovators", "Protectors"]
    texts = [json.dumps({"archetype": labels[len(p) % 4], "innovation_wave": f"{len(p) % 3 + 1}.0", "confidence": "High"})
             if len(p) % 3 else "no answer" for p in pdf["prompt"]]
    return pdf[["request"]].assign(response_json=texts)


def _failing_model(pdf):
    if any(int(r[:4], 16) % LOG_PARTS >= FAILING_PART for r in pdf["request"]):
        raise RuntimeError("the model is away")
    return _stand_in_model(pdf)


def q_answer_log(spark, sf_dir):
    """A run that fails half-way, then a second one that asks only for what is missing."""
    c = spread(companies(spark, sf_dir), "company_id")
    args = (tx.company_name(c), tx.combined_text(c, COMPANY_DESC, COMPANY_AUX), tx.industries(c, INDUSTRY_COLS))
    requests = rs.render_requests(c, *args).select("company_id", "prompt")
    log = scratch_path(spark, "answer-log")
    try:
        answer_log.ask(requests, _failing_model, log, "first", LOG_PARTS, batch_rows=500)
        raise RuntimeError("the first run was to fail")
    except Exception as exc:  # noqa: BLE001 - the failure this query is about
        if "the model is away" not in str(exc):
            raise
    respond = answer_log.log_responder(_stand_in_model, log, "second", parts=LOG_PARTS, batch_rows=500)
    answers = materialize(respond(requests), "log-answers")
    result = rs.merge_with_keywords(_classified(spark, sf_dir), rs.parse_responses(answers))
    times = answer_log.read_log(spark, log).groupBy("request").agg(F.count("*").alias("times_asked"))
    return (result.join(answers.select("company_id", "request", "run"), "company_id").join(times, "request")
            .select("company_id", "run", "times_asked", "result_source", "Predicted_Archetype", "Confidence_Score", "Innovation_Wave"))


def q_model_fallback(spark, sf_dir):
    return _model_results(spark, sf_dir).select("company_id", "result_source", *RESULT6)


def q_actual_cost(spark, sf_dir):
    r = responses(spark, sf_dir).agg(F.sum("input_tokens").alias("input_tokens"),
                                     F.sum("output_tokens").alias("output_tokens"))
    return r.withColumn("cost_usd", rs.actual_cost(F.col("input_tokens"), F.col("output_tokens")))


def q_cost_ledger(spark, sf_dir):
    m = _model_results(spark, sf_dir).select("company_id", "Predicted_Archetype")
    m = m.withColumn("billable", rs.billable(F.col("Predicted_Archetype")))
    out = profiles.running_sum(m, "company_id", F.col("billable").cast("bigint"), "running_billable",
                               keep=["billable"])
    return out.select("company_id", "billable", "running_billable",
                      (F.col("running_billable").cast("double") * F.lit(rs.LEDGER_COST_PER_ROW)).alias("running_cost"))


def q_cost_summary(spark, sf_dir):
    m = _model_results(spark, sf_dir)
    out = m.agg(F.count_if(rs.billable(F.col("Predicted_Archetype"))).alias("n_billable"),
                F.count(F.lit(1)).alias("n_total"))
    cost = F.col("n_billable").cast("double") * F.lit(rs.LEDGER_COST_PER_ROW)
    return out.withColumns({"total_cost": cost,
                            "cost_per_company": F.try_divide(cost, F.col("n_total").cast("double"))})


# --- model-mode profiles -----------------------------------------------------------

def q_non_error_rows(spark, sf_dir):
    return profiles.non_error_rows(_model_results(spark, sf_dir)).select("company_id", "Predicted_Archetype")


def _m(fn):
    return lambda spark, sf_dir: fn(_model_results(spark, sf_dir))


def q_findings(spark, sf_dir):
    from sectorscope.operators.findings import findings
    return findings(_model_results(spark, sf_dir))


def _live_cube(spark, sf_dir) -> str:
    """The cube of the model results that came in three waves, then of the age correction of some; its folder."""
    path = scratch_path(spark, "live-cube")
    # written once: the waves and the correction read stored results, nothing is classified again
    rows = materialize(_model_results(spark, sf_dir), "live-rows")
    for wave in range(3):
        live_cube.add_batch(rows.where(F.col("company_id") % 3 == wave), path, wave)
    aged = materialize(corrections.age_correction(corrections.founding_year(rows), AGE_CUTOFF).where("Age_Corrected"), "aged")
    before = rows.join(aged.select("company_id"), "company_id", "left_semi")
    live_cube.correct(before, aged, path, 3)
    return path


def q_findings_live(spark, sf_dir):
    from sectorscope.operators.findings import findings_of_cube
    return findings_of_cube(live_cube.current(spark, _live_cube(spark, sf_dir)), profiles.DC_CODES)


def q_label_counts_live(spark, sf_dir):
    return live_cube.label_counts(live_cube.current(spark, _live_cube(spark, sf_dir)))


def q_findings_text(spark, sf_dir):
    from sectorscope.operators.findings import findings, render_text
    return render_text(findings(_model_results(spark, sf_dir)))


def q_incremental_classify(spark, sf_dir):
    src = scratch_path(spark, "incoming")
    c = companies(spark, sf_dir)
    c.write.parquet(src)
    sink, ckpt = scratch_path(spark, "classified"), scratch_path(spark, "stream-ckpt")
    q = incremental.classify_stream(spark, src, c.schema, sink, ckpt, COMPANY_DESC, COMPANY_AUX,
                                    max_files_per_trigger=1, keep=["company_id", *RESULT6])
    q.awaitTermination()
    return spark.read.schema(_result_schema()).parquet(sink)


def q_incremental_classify_csv(spark, sf_dir):
    """The stream over CSV files, null tokens and all."""
    from sectorscope.sources.tables import raw_companies
    src = scratch_path(spark, "incoming-csv")
    c = raw_companies(spark, sf_dir)
    files.write_csv(c, src)
    sink, ckpt = scratch_path(spark, "classified"), scratch_path(spark, "stream-ckpt")
    incremental.classify_stream(spark, src, c.schema, sink, ckpt, COMPANY_DESC, COMPANY_AUX, fmt="csv",
                                keep=["company_id", *RESULT6]).awaitTermination()
    return spark.read.schema(_result_schema()).parquet(sink)


def q_stream_keyed(spark, sf_dir):
    """Companies that come again in later files, with another description: the first and the last version of each."""
    c = companies(spark, sf_dir)
    k = F.col("company_id")
    kept = {}
    for last in (False, True):
        src, sink, ckpt = (scratch_path(spark, name) for name in ("incoming", "kept", "stream-ckpt"))
        for wave in range(3):
            part = c.where((k + wave) % 2 == 0).select(
                "company_id", F.lit(wave).alias("version"), F.to_timestamp(F.lit(f"2024-01-0{wave + 1} 00:00:00")).alias("seen"),
                F.concat_ws(" ", "Description", F.lit(["", "saas platform", "robotic claims"][wave])).alias("Description"))
            part.write.mode("append").parquet(src)
            stream = spark.readStream.schema(part.schema).parquet(src)
            one = keyed.keep_one(stream, "company_id", "version", "seen", "30 days", last)
            keyed.write_kept(one, sink, ckpt).awaitTermination()
        rows = keyed.latest(spark, sink, part.schema)
        kept[last] = materialize(classify_text(rows, "Description").select(
            "company_id", F.col("version").alias("last_version" if last else "first_version"),
            F.col("Predicted_Archetype").alias("last_label" if last else "first_label")), "kept-labels")
    return kept[False].join(kept[True], "company_id")


def _label_batches(spark, sf_dir):
    """Part numbers as free-text labels, in three batches of a stream; the rows and the summaries' folder."""
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("part "), "l_partkey").alias("label"))
    src, ckpt, path = (scratch_path(spark, name) for name in ("incoming", "stream-ckpt", "sketches"))
    for wave in range(3):
        rows.where(F.col("l_orderkey") % 3 == wave).write.mode("append").parquet(src)
        (spark.readStream.schema(rows.schema).parquet(src).writeStream
         .foreachBatch(lambda batch, n: label_sketches.add_batch(batch, "label", path, n))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination())
    return rows, path


def q_top_labels(spark, sf_dir):
    rows, path = _label_batches(spark, sf_dir)
    return label_sketches.top_labels(rows, "label", path, 10).select("label", "n")


def q_distinct_labels(spark, sf_dir):
    """The estimate from the batches' sketches beside the exact number of labels."""
    rows, path = _label_batches(spark, sf_dir)
    exact = rows.agg(F.countDistinct("label")).scalar()
    out = label_sketches.distinct_labels(spark, path).withColumn("n_exact", exact)
    return out.select("n_rows", "n_exact", (F.abs(F.col("n_distinct") - F.col("n_exact")) <= 0.05 * F.col("n_exact")).alias("within_5_pct"))


def q_run_ids(spark, sf_dir):
    """The run id that each order's time would give."""
    o = read_table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date").cast("timestamp")
    at = F.timestamp_seconds(F.unix_seconds(day) + F.col("o_orderkey") % 86_400)
    return o.select("o_orderkey", files.run_id(at).alias("run_id"))


def _stream_progress(spark, sf_dir):
    """The progress table of a stream over ``companies``, whose rows arrive in three waves.

    Each run of the stream takes the files that are new, as one batch, so batches equal waves at any size.
    """
    src, sink, metrics, ckpt = (scratch_path(spark, name)
                                for name in ("incoming", "classified", "metrics", "stream-ckpt"))
    c = companies(spark, sf_dir)
    for wave in range(3):
        c.where(F.col("company_id") % 3 == wave).write.mode("append").parquet(src)
        incremental.classify_stream_with_progress(spark, src, c.schema, sink, metrics, ckpt, COMPANY_DESC,
                                                  COMPANY_AUX).awaitTermination()
    return incremental.progress_table(spark, metrics, total_rows=c.count())


def q_batch_progress(spark, sf_dir):
    """Per batch, every figure but the clock's."""
    return _stream_progress(spark, sf_dir).select("batch_id", "n_rows", "n_billable", "batch_cost", "rows_done",
                                                  "cost_so_far", "pct_done")


def q_batch_totals(spark, sf_dir):
    """The progress of a finished stream, in figures that do not depend on how it was cut into batches."""
    return _stream_progress(spark, sf_dir).agg(
        F.max("rows_done").alias("rows_done"), F.sum("n_billable").alias("n_billable"),
        F.max("cost_so_far").alias("cost"), F.max("pct_done").alias("pct_done"),
        F.max_by("eta_text", "batch_id").alias("eta_text"))


def q_export_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "export")
    files.export_results(_classified(spark, sf_dir).select("company_id", *RESULT6), path, "keywords", "r1")
    back = spark.read.parquet(path)
    return back.filter((F.col("mode") == "keywords") & (F.col("run_id") == "r1"))


def _result_schema() -> StructType:
    from pyspark.sql import types as T
    return T.StructType([T.StructField("company_id", T.LongType())] +
                        [T.StructField(c, T.StringType()) for c in RESULT6])


def queries() -> dict[str, Query]:
    return {
        "scan_companies": q_scan_companies,
        "scan_json": _scan_as("json", lambda df, path: df.write.json(path)),
        "scan_parquet": _scan_as("parquet", files.write_parquet),
        "null_normalise": q_null_normalise,
        "column_mapping": q_column_mapping,
        "upload_mapping": q_upload_mapping,
        "table_shape": q_table_shape,
        "combined_text": q_combined_text,
        "company_name": q_company_name,
        "word_count": q_word_count,
        "archetype_scores": q_archetype_scores,
        "keywords_found": q_keywords_found,
        "archetype_rank": q_archetype_rank,
        "generic_fallback": q_generic_fallback,
        "hybrid_detect": q_hybrid_detect,
        "confidence_mix": q_confidence_mix,
        "classify_keywords": q_classify_keywords,
        "lexicon_join": q_lexicon_join,
        "archetype_scores_docs": q_archetype_scores_docs,
        "keywords_found_docs": q_keywords_found_docs,
        "classify_keywords_docs": q_classify_keywords_docs,
        "classify_keywords_docs_arrow": q_classify_keywords_docs_arrow,
        "classify_default_docs": q_classify_default_docs,
        "classify_keywords_docs_native": q_classify_keywords_docs_native,
        "classify_default_docs_native": q_classify_default_docs_native,
        "classify_keywords_native": q_classify_keywords_native,
        "explorer_search_docs": q_explorer_search_docs,
        "lexicon_join_docs": q_lexicon_join_docs,
        "recent_classifications": q_recent_classifications,
        "head_per_archetype": q_head_per_archetype,
        "explorer_filter": q_explorer_filter,
        "explorer_counts": q_explorer_counts,
        "explorer_search": q_explorer_search,
        "distinct_archetypes": q_distinct_archetypes,
        "archetype_counts_all": q_archetype_counts_all,
        "archetype_counts": q_archetype_counts,
        "archetype_mode": q_archetype_mode,
        "archetype_share": q_archetype_share,
        "success_rate_exact": q_success_rate_exact,
        "resume_pending": q_resume_pending,
        "resume_done_count": q_resume_done_count,
        "founding_year": q_founding_year,
        "founding_year_orders": q_founding_year_orders,
        "founding_year_dates": q_founding_year_dates,
        "age_correction": q_age_correction,
        "age_correction_count": q_age_correction_count,
        "year_archetype": q_year_archetype,
        "request_render": q_request_render,
        "token_estimate": q_token_estimate,
        "cost_estimate": q_cost_estimate,
        "response_parse": q_response_parse,
        "response_errors": q_response_errors,
        "result_projection": q_result_projection,
        "model_fallback": q_model_fallback,
        "actual_cost": q_actual_cost,
        "cost_ledger": q_cost_ledger,
        "cost_summary": q_cost_summary,
        "non_error_rows": q_non_error_rows,
        "success_rate": _m(profiles.success_rate),
        "dominant_archetype": _m(profiles.dominant_archetype),
        "archetype_diversity": _m(profiles.archetype_diversity),
        "wave_counts": _m(profiles.wave_counts),
        "wave_share": _m(profiles.wave_share),
        "wave_maturity": _m(profiles.wave_maturity),
        "capability_top10": _m(profiles.capability_top10),
        "capability_counts": _m(profiles.capability_counts),
        "top_capability": _m(profiles.top_capability),
        "capability_density": _m(profiles.capability_density),
        "capability_heatmap": _m(profiles.capability_heatmap),
        "wave_archetype": _m(profiles.wave_archetype),
        "hybrid_share": _m(profiles.hybrid_share),
        "archetype_summary": _m(profiles.archetype_summary),
        "wave_profile": _m(profiles.wave_profile),
        "findings": q_findings,
        "findings_text": q_findings_text,
        "incremental_classify": q_incremental_classify,
        "batch_progress": q_batch_progress,
        "batch_totals": q_batch_totals,
        "export_roundtrip": q_export_roundtrip,
        "scan_multiline": q_scan_multiline,
        "scan_inferred": q_scan_inferred,
        "input_positions": q_input_positions,
        "first_rows": q_first_rows,
        "positional_join": q_positional_join,
        "explorer_search_counts": q_explorer_search_counts,
        "archetype_ranking": q_archetype_ranking,
        "wave_ranking": q_wave_ranking,
        "capability_ranking": q_capability_ranking,
        "empty_table_rates": q_empty_table_rates,
        "answer_log": q_answer_log,
        "findings_live": q_findings_live,
        "label_counts_live": q_label_counts_live,
        "incremental_classify_csv": q_incremental_classify_csv,
        "run_ids": q_run_ids,
        "stream_keyed": q_stream_keyed,
        "top_labels": q_top_labels,
        "distinct_labels": q_distinct_labels,
        "explorer_search_indexed": q_explorer_search_indexed,
        "search_scanned": q_search_scanned,
    }
