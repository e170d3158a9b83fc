"""DuckDB SQL for each registered query (the correctness oracle).

The SQL is a separate, relational formulation of the same rules: the
lexicon is a ``VALUES`` table, occurrences come from a join on ``contains``,
ranks from ``row_number``, lists from ordered ``string_agg``. Tables
``customer``, ``documents``, ``orders`` ... are views over the parquet files.
"""

from __future__ import annotations

from sectorscope.functions.lexicon import Lexicon, default_lexicon, probe_lexicon
from sectorscope.operators import responses as rs
from sectorscope.sources.tables import FAILED_CALL, PHRASES, RESPONSES

# Expected values, stated here again and not imported, so that a wrong one in the library shows as a difference.
HYBRID, GENERALIST, UNCLASSIFIED = "Hybrid", "Traditional / Generalist", "Unclassified"
DC_CODES = ["DC1", "DC2", "DC3", "DC4", "DC5"]
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
SEARCH_COMPANIES, SEARCH_DOCS = "hybrid|iot", "licen[cs]e|passw"
EXPLORER_LABELS = ["Hybrid", "Enablers"]
AGE_CUTOFF = 2010
# End of expected values.


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


PHRASE_LIST = _list(PHRASES)

COMPANIES = f"""companies AS (
  SELECT CAST(c_custkey AS BIGINT) AS company_id,
    CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_name END AS Company,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS Industries,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Segment ' || CAST(c_nationkey AS VARCHAR) END AS industry_groups,
    CASE WHEN c_custkey % 13 = 0 THEN NULL
         WHEN c_custkey % 5 = 0 THEN {PHRASE_LIST}[c_custkey % 12 + 1] || ' ' || {PHRASE_LIST}[(c_custkey * 7 + 3) % 12 + 1]
         ELSE {PHRASE_LIST}[c_custkey % 12 + 1] END AS Description,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(1995 + c_custkey % 30 AS VARCHAR) END AS founded
  FROM customer)"""

_resp_cases = " ".join(f"WHEN {k} THEN {q(v)}" for k, v in sorted(RESPONSES.items()))
# every customer; no stored answer (null response and tokens) when k % 10 = 4
RESPONSES_CTE = f"""stored AS (
  SELECT CAST(c_custkey AS BIGINT) AS company_id,
    CASE c_custkey % 10 {_resp_cases} END AS response_json,
    CASE WHEN c_custkey % 20 = 14 THEN {q(FAILED_CALL)} END AS error,
    CASE WHEN c_custkey % 10 <> 4 THEN CAST(400 + c_custkey % 100 AS BIGINT) END AS input_tokens,
    CASE WHEN c_custkey % 10 <> 4 THEN CAST(100 + c_custkey % 50 AS BIGINT) END AS output_tokens
  FROM customer), responses AS (SELECT * FROM stored WHERE response_json IS NOT NULL OR error IS NOT NULL)"""

COMPANY_TEXT = "concat_ws(' ', Description, Industries, industry_groups)"


def classify_ctes(texts_sql: str, lex: Lexicon, p: str = "", lex_sql: str | None = None) -> list[str]:
    """CTEs ending in ``{p}cls``: id, txt, scores, found_all, best, c1, s1, c2, s2, generic, result.

    The keywords are those of ``lex``, or the rows of ``lex_sql``."""
    lex_sql = lex_sql or "VALUES " + ", ".join(f"({co}, {q(c)}, {ko}, {q(k)})" for co, c, ko, k in lex.rows())
    gen_rows = ", ".join(f"({i + 1}, {q(w)})" for i, w in enumerate(lex.generic))
    return [
        f"{p}texts AS ({texts_sql})",
        f"{p}lt AS (SELECT id, txt, lower(txt) AS t FROM {p}texts)",
        f"{p}lex(cat_ord, category, kw_ord, keyword) AS ({lex_sql})",
        f"{p}cats AS (SELECT DISTINCT cat_ord, category FROM {p}lex)",
        f"{p}gen(g_ord, word) AS (VALUES {gen_rows})",
        f"""{p}hits AS (SELECT lt.id, x.cat_ord, x.kw_ord, x.keyword,
              (length(lt.t) - length(replace(lt.t, lower(x.keyword), ''))) // length(lower(x.keyword)) AS n
            FROM {p}lt lt JOIN {p}lex x ON contains(lt.t, lower(x.keyword)))""",
        f"""{p}sc AS (SELECT lt.id, c.cat_ord, c.category, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS score,
              string_agg(h.keyword, ', ' ORDER BY h.kw_ord, h.keyword) AS found,
              CAST(count(h.keyword) AS BIGINT) AS n_found
            FROM {p}lt lt CROSS JOIN {p}cats c
            LEFT JOIN {p}hits h ON h.id = lt.id AND h.cat_ord = c.cat_ord
            GROUP BY lt.id, c.cat_ord, c.category)""",
        f"""{p}rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, cat_ord) AS r FROM {p}sc)""",
        f"""{p}top AS (SELECT id,
              max(score) FILTER (WHERE r = 1) AS s1, max(category) FILTER (WHERE r = 1) AS c1,
              max(found) FILTER (WHERE r = 1) AS f1,
              max(score) FILTER (WHERE r = 2) AS s2, max(category) FILTER (WHERE r = 2) AS c2,
              max(found) FILTER (WHERE r = 2) AS f2,
              string_agg(CAST(score AS VARCHAR), ',' ORDER BY cat_ord) AS scores,
              string_agg(coalesce(found, ''), ' | ' ORDER BY cat_ord) AS found_all,
              CAST(sum(n_found) AS BIGINT) AS n_found
            FROM {p}rk GROUP BY id)""",
        f"""{p}gf AS (SELECT lt.id, string_agg(g.word, ', ' ORDER BY g.g_ord) AS g
            FROM {p}lt lt JOIN {p}gen g ON contains(lt.t, g.word) GROUP BY lt.id)""",
        f"""{p}cls AS (SELECT lt.id, lt.txt, top.scores, top.found_all, top.n_found, top.s1, top.c1, top.s2, top.c2,
              CASE WHEN lt.txt IS NULL THEN '{UNCLASSIFIED}'
                   WHEN top.s1 = 0 THEN CASE WHEN gf.g IS NOT NULL THEN '{GENERALIST}' ELSE '{UNCLASSIFIED}' END
                   WHEN top.s2 = top.s1 THEN '{HYBRID}' ELSE top.c1 END AS Predicted_Archetype,
              CASE WHEN lt.txt IS NULL OR top.s1 = 0 THEN 'Low' WHEN top.s2 = top.s1 THEN 'Medium'
                   WHEN top.s1 >= 3 THEN 'High' ELSE 'Medium' END AS Confidence_Score,
              CASE WHEN lt.txt IS NULL THEN '' WHEN top.s1 = 0 THEN coalesce(gf.g, '')
                   WHEN top.s2 = top.s1 THEN top.f1 || ', ' || top.f2 ELSE top.f1 END AS Keywords_Found
            FROM {p}lt lt JOIN {p}top top USING (id) LEFT JOIN {p}gf gf USING (id))""",
    ]


def _company_cls() -> list[str]:
    return [COMPANIES] + classify_ctes(f"SELECT company_id AS id, {COMPANY_TEXT} AS txt FROM companies",
                                       default_lexicon()) + [
        """classified AS (SELECT c.*, k.Predicted_Archetype, k.Confidence_Score, k.Keywords_Found,
              '' AS Secondary_Archetypes, '' AS Driving_Capabilities, '' AS Innovation_Wave,
              k.scores, k.found_all, k.n_found, k.s1, k.c1, k.s2, k.c2
            FROM companies c JOIN cls k ON k.id = c.company_id)"""]


def _doc_cls(lex: Lexicon, lex_sql: str | None = None) -> list[str]:
    return classify_ctes("SELECT doc_id AS id, text AS txt FROM documents", lex, lex_sql=lex_sql)


# every word of eight small letters or more in two documents, in seven categories by its first letter
WORD_LEXICON = """SELECT (ascii(word) % 7 + 1) * 10, 'w' || CAST(ascii(word) % 7 + 1 AS VARCHAR), length(word), word
    FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}'))) AS word FROM documents)
    GROUP BY word HAVING count(*) >= 2"""


_pytype = ("CASE json_type(j) WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' "
           "WHEN 'NULL' THEN 'NoneType' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END")


def _joined(field: str) -> str:
    return (f"CASE WHEN json_type(j, '$.{field}') = 'ARRAY' "
            f"THEN array_to_string(json_extract_string(j, '$.{field}[*]'), ', ') ELSE '' END")


def _mismatch(field: str) -> str:
    return f"coalesce(json_type(j, '$.{field}') NOT IN ('ARRAY', 'NULL'), false)"


PARSED = [RESPONSES_CTE, f"""parsed0 AS (SELECT company_id, response_json AS j, error, input_tokens, output_tokens,
      CASE WHEN error IS NOT NULL THEN 'processing'
           WHEN response_json IS NULL OR NOT json_valid(response_json) THEN 'json'
           WHEN json_type(response_json) <> 'OBJECT' THEN 'api' END AS error_class
    FROM responses)""", f"""parsed AS (SELECT company_id, error_class, input_tokens, output_tokens,
      CASE error_class WHEN 'processing' THEN 'Processing Error'
           WHEN 'json' THEN 'API Error - JSON' WHEN 'api' THEN 'API Error'
           ELSE coalesce(json_extract_string(j, '$.archetype'), 'Unclassified') END AS Predicted_Archetype,
      CASE WHEN error_class IS NOT NULL THEN 'Low'
           ELSE coalesce(json_extract_string(j, '$.confidence'), 'Medium') END AS Confidence_Score,
      CASE error_class WHEN 'processing' THEN left(error, 100)
           WHEN 'json' THEN 'JSON parse error'
           WHEN 'api' THEN 'Error: ' || left('''' || {_pytype} || ''' object has no attribute ''get''', 80)
           ELSE CASE WHEN length(coalesce(json_extract_string(j, '$.justification'), '')) > 200
                     THEN left(json_extract_string(j, '$.justification'), 200) || '...'
                     ELSE coalesce(json_extract_string(j, '$.justification'), '') END END AS Keywords_Found,
      CASE WHEN error_class IS NOT NULL THEN '' ELSE {_joined('secondary_archetypes')} END AS Secondary_Archetypes,
      CASE WHEN error_class IS NOT NULL THEN '' ELSE {_joined('driving_capabilities')} END AS Driving_Capabilities,
      CASE WHEN error_class IS NOT NULL THEN ''
           ELSE coalesce(json_extract_string(j, '$.innovation_wave'), '') END AS Innovation_Wave,
      CASE WHEN error_class IS NULL
           THEN {_mismatch('secondary_archetypes')} OR {_mismatch('driving_capabilities')} ELSE false END AS type_mismatch
    FROM parsed0)"""]

MODEL = _company_cls() + PARSED + ["""model AS (SELECT c.company_id,
      CASE WHEN p.company_id IS NOT NULL THEN 'model' ELSE 'keywords' END AS result_source,
      CASE WHEN p.company_id IS NOT NULL THEN p.Predicted_Archetype ELSE c.Predicted_Archetype END AS Predicted_Archetype,
      CASE WHEN p.company_id IS NOT NULL THEN p.Confidence_Score ELSE c.Confidence_Score END AS Confidence_Score,
      CASE WHEN p.company_id IS NOT NULL THEN p.Keywords_Found ELSE c.Keywords_Found END AS Keywords_Found,
      CASE WHEN p.company_id IS NOT NULL THEN p.Secondary_Archetypes ELSE '' END AS Secondary_Archetypes,
      CASE WHEN p.company_id IS NOT NULL THEN p.Driving_Capabilities ELSE '' END AS Driving_Capabilities,
      CASE WHEN p.company_id IS NOT NULL THEN p.Innovation_Wave ELSE '' END AS Innovation_Wave
    FROM classified c LEFT JOIN parsed p ON p.company_id = c.company_id)""",
    # capability list: split on ',', trimmed, empties dropped; one flag column per code
    "mdc AS (SELECT *, list_filter(list_transform(string_split(Driving_Capabilities, ','), lambda x: regexp_replace(x, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), "
    "lambda x: x <> '') AS dcl FROM model)",
    "mflag AS (SELECT *, " + ", ".join(f"CASE WHEN list_contains(dcl, '{c}') THEN '{c}' END AS {c}"
                                        for c in DC_CODES) + " FROM mdc)",
]


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def pct(n: str, total: str) -> str:
    return f"CAST({n} AS DOUBLE) * 100.0 / NULLIF(CAST({total} AS DOUBLE), 0)"


NOT_ERR = "NOT coalesce(contains(Predicted_Archetype, 'Error'), false)"
SELECT6 = "Predicted_Archetype, Confidence_Score, Keywords_Found, Secondary_Archetypes, Driving_Capabilities, Innovation_Wave"
BILLABLE = "NOT coalesce(Predicted_Archetype IN ({}), false)".format(", ".join(q(x) for x in ("API Error", "Unclassified", "Processing Error")))
PROMPT_FIELDS = {
    "framework_context": q(rs.FRAMEWORK_CONTEXT),
    "company_name": "coalesce(Company, 'Unknown Company')",
    "description": f"left({COMPANY_TEXT}, 500)",
    "industries": "coalesce(Industries, industry_groups, '')",
}


def _prompt_sql() -> str:
    parts = []
    for lit, fld in rs.template_parts(rs.PROMPT_TEMPLATE):
        if lit:
            parts.append(q(lit))
        if fld is not None:
            parts.append(PROMPT_FIELDS[fld])
    return "concat(" + ", ".join(parts) + ")"


def _dc_count(c: str) -> str:
    return f"count(*) FILTER (WHERE coalesce(contains({c}, 'DC'), false))"


_per_row_dc = " + ".join(f"coalesce(length({c}) - length(replace({c}, 'DC', '')), 0) // 2" for c in DC_CODES)
_tokens = ", ".join(q(t) for t in NULL_TOKENS)
_raw_cols = ["Company", "Industries", "industry_groups", "Description", "founded"]
_TOKEN_LIST = _list(NULL_TOKENS)


def oracle_sql() -> dict[str, str]:
    C = _company_cls()
    M = MODEL
    per_in = 458  # input tokens a company
    d = {
        "scan_companies": with_([COMPANIES], """SELECT CAST(company_id AS VARCHAR) AS company_id, Company, Industries,
            industry_groups, Description, founded FROM companies"""),
        "null_normalise": with_([COMPANIES, "raw AS (SELECT company_id, " + ", ".join(
            f"coalesce({c}, {_TOKEN_LIST}[company_id % {len(NULL_TOKENS)} + 1]) AS {c}" for c in _raw_cols)
            + " FROM companies)"],
            "SELECT company_id, " + ", ".join(f"CASE WHEN {c} IN ({_tokens}) THEN NULL ELSE {c} END AS {c}"
                                              for c in _raw_cols) + " FROM raw"),
        "column_mapping": with_([COMPANIES], "SELECT CAST(company_id AS VARCHAR) AS name, Description AS description FROM companies"),
        "table_shape": with_([COMPANIES], "SELECT count(*) AS n_rows, 6 AS n_columns FROM companies"),
        "combined_text": with_([COMPANIES], f"SELECT company_id, {COMPANY_TEXT} AS combined_text FROM companies"),
        "company_name": with_([COMPANIES], """SELECT company_id, coalesce(Company, 'Unknown Company') AS company_name,
            coalesce(Industries, industry_groups, '') AS industries FROM companies"""),
        "word_count": with_([COMPANIES], f"""SELECT company_id,
            CAST(len(regexp_extract_all({COMPANY_TEXT}, '\\b\\w+\\b')) AS BIGINT) AS word_count FROM companies"""),
        "archetype_scores": with_(C, "SELECT company_id, scores, s1 AS best_score FROM classified"),
        "keywords_found": with_(C, "SELECT company_id, found_all AS found, n_found FROM classified"),
        "archetype_rank": with_(C, """SELECT company_id, c1 AS first_category, s1 AS first_score,
            c2 AS second_category, s2 AS second_score FROM classified"""),
        "generic_fallback": with_(C, """SELECT company_id, Predicted_Archetype, Keywords_Found AS generic_words
            FROM classified WHERE s1 = 0"""),
        "hybrid_detect": with_(C, f"""SELECT company_id, c1 AS first_category, c2 AS second_category, Keywords_Found
            FROM classified WHERE Predicted_Archetype = '{HYBRID}'"""),
        "confidence_mix": with_(C, "SELECT Confidence_Score, count(*) AS n FROM classified GROUP BY 1"),
        "classify_keywords": with_(C, f"SELECT company_id, {SELECT6} FROM classified"),
        "lexicon_join": with_(C, """SELECT company_id, scores, Predicted_Archetype, Confidence_Score, Keywords_Found
            FROM classified"""),
        "archetype_scores_docs": with_(_doc_cls(probe_lexicon()), "SELECT id AS doc_id, scores, s1 AS best_score FROM cls"),
        "keywords_found_docs": with_(_doc_cls(probe_lexicon()), "SELECT id AS doc_id, found_all AS found, n_found FROM cls"),
        "classify_keywords_docs": with_(_doc_cls(probe_lexicon()), """SELECT id AS doc_id, Predicted_Archetype,
            Confidence_Score, Keywords_Found FROM cls"""),
        "classify_default_docs": with_(_doc_cls(default_lexicon()), """SELECT id AS doc_id, Predicted_Archetype,
            Confidence_Score, Keywords_Found FROM cls"""),
        "explorer_search_docs": f"""SELECT doc_id, lang, source FROM documents WHERE
            coalesce(regexp_matches(CAST(doc_id AS VARCHAR), {q(SEARCH_DOCS)}, 'i'), false)
            OR coalesce(regexp_matches(text, {q(SEARCH_DOCS)}, 'i'), false)
            OR coalesce(regexp_matches(lang, {q(SEARCH_DOCS)}, 'i'), false)
            OR coalesce(regexp_matches(source, {q(SEARCH_DOCS)}, 'i'), false)
            OR coalesce(regexp_matches(CAST(n_chars AS VARCHAR), {q(SEARCH_DOCS)}, 'i'), false)""",
        "lexicon_join_docs": with_(_doc_cls(probe_lexicon(), WORD_LEXICON), """SELECT id AS doc_id, scores, Predicted_Archetype,
            Confidence_Score, Keywords_Found FROM cls"""),
        "recent_classifications": with_(C, """SELECT company_id, Predicted_Archetype, Confidence_Score, Innovation_Wave
            FROM classified ORDER BY company_id LIMIT 10"""),
        "head_per_archetype": with_(C, f"""SELECT * FROM (SELECT company_id, Predicted_Archetype, Confidence_Score,
            Keywords_Found, row_number() OVER (PARTITION BY Predicted_Archetype ORDER BY company_id) AS rn
            FROM classified WHERE {NOT_ERR} AND Predicted_Archetype IS NOT NULL) WHERE rn <= 5"""),
        "explorer_filter": with_(C, """SELECT company_id, Company, Predicted_Archetype, Confidence_Score FROM classified
            WHERE Predicted_Archetype IN ({})""".format(", ".join(q(x) for x in EXPLORER_LABELS))),
        "explorer_counts": with_(C, """SELECT count(*) FILTER (WHERE Predicted_Archetype IN ({})) AS n_shown,
            count(*) AS n_total FROM classified""".format(", ".join(q(x) for x in EXPLORER_LABELS))),
        "explorer_search": with_(C, "SELECT company_id, Predicted_Archetype FROM classified WHERE " + " OR ".join(
            f"coalesce(regexp_matches(CAST({c} AS VARCHAR), {q(SEARCH_COMPANIES)}, 'i'), false)"
            for c in ["company_id", "Company", "Industries", "industry_groups", "Description", "founded",
                      "Predicted_Archetype", "Confidence_Score", "Keywords_Found", "Secondary_Archetypes",
                      "Driving_Capabilities", "Innovation_Wave"])),
        "distinct_archetypes": with_(C, "SELECT DISTINCT Predicted_Archetype FROM classified"),
        "archetype_counts_all": with_(C, """SELECT Predicted_Archetype, count(*) AS n FROM classified
            WHERE Predicted_Archetype IS NOT NULL GROUP BY 1"""),
        "archetype_counts": with_(C, f"""SELECT Predicted_Archetype, count(*) AS n FROM classified
            WHERE Predicted_Archetype IS NOT NULL AND {NOT_ERR} GROUP BY 1"""),
        "archetype_mode": with_(C, """SELECT Predicted_Archetype, count(*) AS n FROM classified
            WHERE Predicted_Archetype IS NOT NULL GROUP BY 1 ORDER BY n DESC, Predicted_Archetype LIMIT 1"""),
        "archetype_share": with_(C, f"""SELECT Predicted_Archetype, n, {pct('n', 'sum(n) OVER ()')} AS share_pct FROM
            (SELECT Predicted_Archetype, count(*) AS n FROM classified
             WHERE Predicted_Archetype IS NOT NULL AND {NOT_ERR} GROUP BY 1)"""),
        "success_rate_exact": with_(C, f"""SELECT n_total, n_classified, {pct('n_classified', 'n_total')} AS success_rate
            FROM (SELECT count(*) AS n_total, count(*) FILTER (WHERE coalesce(Predicted_Archetype NOT IN
            ('Unclassified', 'API Error'), true)) AS n_classified FROM classified)"""),
        "resume_pending": with_(C, """SELECT company_id, Predicted_Archetype, Confidence_Score FROM classified
            WHERE company_id NOT IN (SELECT company_id FROM classified WHERE Industries IS NOT NULL
              AND Predicted_Archetype IS NOT NULL AND Predicted_Archetype <> '')"""),
        "resume_done_count": with_(C, """SELECT count(*) FILTER (WHERE Predicted_Archetype IS NOT NULL
              AND Predicted_Archetype <> '') AS n_done, count(*) AS n_saved FROM classified WHERE Industries IS NOT NULL"""),
        "founding_year": with_([COMPANIES], "SELECT company_id, founded, TRY_CAST(founded AS DOUBLE) AS Founded_Year FROM companies"),
        "founding_year_orders": "SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS Founded_Year FROM orders",
        "founding_year_dates": """SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS launch_date,
            CAST(year(o_orderdate) AS DOUBLE) AS Founded_Year FROM orders""",
        "age_correction": with_(C + [f"""aged AS (SELECT *, TRY_CAST(founded AS DOUBLE) AS Founded_Year,
              coalesce(Predicted_Archetype IN ('Disruptors', 'Innovators') AND TRY_CAST(founded AS DOUBLE) < {AGE_CUTOFF},
                       false) AS hit FROM classified)"""],
            """SELECT company_id, CASE WHEN hit THEN 'Traditional / Generalist' ELSE Predicted_Archetype END
            AS Predicted_Archetype, Founded_Year, CASE WHEN hit THEN true END AS Age_Corrected FROM aged"""),
        "age_correction_count": with_(C, f"""SELECT count(*) FILTER (WHERE Predicted_Archetype IN ('Disruptors', 'Innovators')
            AND TRY_CAST(founded AS DOUBLE) < {AGE_CUTOFF}) AS n_corrected FROM classified"""),
        "year_archetype": with_(C, f"""SELECT Founded_Year, Predicted_Archetype, count(*) AS n FROM (
            SELECT TRY_CAST(founded AS DOUBLE) AS Founded_Year,
              CASE WHEN Predicted_Archetype IN ('Disruptors', 'Innovators') AND TRY_CAST(founded AS DOUBLE) < {AGE_CUTOFF}
              THEN 'Traditional / Generalist' ELSE Predicted_Archetype END AS Predicted_Archetype FROM classified)
            GROUP BY 1, 2"""),
        "request_render": with_([COMPANIES], f"SELECT company_id, {_prompt_sql()} AS prompt FROM companies"),
        "token_estimate": with_([COMPANIES], f"""SELECT company_id, CAST(length(p) AS BIGINT) AS prompt_chars,
            CAST(length(p) // 4 AS BIGINT) AS est_tokens
            FROM (SELECT company_id, {_prompt_sql()} AS p FROM companies)"""),
        "cost_estimate": with_([COMPANIES], f"""SELECT n_companies, input_tokens, output_tokens,
            CAST(input_tokens AS DOUBLE) / 1000000 * CAST(0.15 AS DOUBLE)
              + CAST(output_tokens AS DOUBLE) / 1000000 * CAST(0.60 AS DOUBLE) AS total_cost_usd,
            CAST(n_companies AS DOUBLE) / 2 AS est_seconds,
            '~' || CAST(floor(CAST(n_companies AS DOUBLE) / 2 / 60) AS BIGINT) || 'm '
              || CAST(floor(CAST(n_companies AS DOUBLE) / 2 % 60) AS BIGINT) || 's'
              AS est_time_text FROM (
            SELECT count(*) AS n_companies, CAST(count(*) * {per_in} AS BIGINT) AS input_tokens,
              CAST(count(*) * 250 AS BIGINT) AS output_tokens FROM companies)"""),
        "response_parse": with_(PARSED, f"SELECT company_id, error_class, {SELECT6} FROM parsed"),
        "response_errors": with_(PARSED, """SELECT company_id, error_class, type_mismatch, Predicted_Archetype, Keywords_Found
            FROM parsed WHERE error_class IS NOT NULL OR type_mismatch"""),
        "result_projection": with_(M, "SELECT company_id, Secondary_Archetypes, Driving_Capabilities FROM model"),
        "model_fallback": with_(M, f"SELECT company_id, result_source, {SELECT6} FROM model"),
        "actual_cost": with_(PARSED, f"""SELECT input_tokens, output_tokens,
            CAST(input_tokens AS DOUBLE) / 1000000 * CAST(0.15 AS DOUBLE)
              + CAST(output_tokens AS DOUBLE) / 1000000 * CAST(0.60 AS DOUBLE) AS cost_usd
            FROM (SELECT CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
                         CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM responses)"""),
        "cost_ledger": with_(M, f"""SELECT company_id, billable, running_billable,
            CAST(running_billable AS DOUBLE) * CAST(0.0002 AS DOUBLE) AS running_cost FROM (
            SELECT company_id, billable, CAST(sum(CASE WHEN billable THEN 1 ELSE 0 END) OVER (ORDER BY company_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_billable
            FROM (SELECT company_id, {BILLABLE} AS billable FROM model))"""),
        "cost_summary": with_(M, f"""SELECT n_billable, n_total,
            CAST(n_billable AS DOUBLE) * CAST(0.0002 AS DOUBLE) AS total_cost,
            CAST(n_billable AS DOUBLE) * CAST(0.0002 AS DOUBLE) / NULLIF(CAST(n_total AS DOUBLE), 0)
              AS cost_per_company
            FROM (SELECT count(*) FILTER (WHERE {BILLABLE}) AS n_billable, count(*) AS n_total FROM model)"""),
        "non_error_rows": with_(M, f"SELECT company_id, Predicted_Archetype FROM model WHERE {NOT_ERR}"),
        "success_rate": with_(M, f"""SELECT n_total, n_errors,
            coalesce({pct('n_total - n_errors', 'n_total')}, 0.0) AS success_rate FROM (
            SELECT count(*) AS n_total, count(*) FILTER (WHERE coalesce(contains(Predicted_Archetype, 'Error'), false))
              AS n_errors FROM model)"""),
        "dominant_archetype": with_(M, f"""SELECT Predicted_Archetype, n, {pct('n', 'tot')} AS share_pct FROM (
            SELECT Predicted_Archetype, n, sum(n) OVER () AS tot FROM (
              SELECT Predicted_Archetype, count(*) AS n FROM model WHERE {NOT_ERR} GROUP BY 1))
            WHERE Predicted_Archetype IS NOT NULL
            ORDER BY n DESC, Predicted_Archetype LIMIT 1"""),
        "archetype_diversity": with_(M, f"SELECT count(DISTINCT Predicted_Archetype) AS n_archetypes FROM model WHERE {NOT_ERR}"),
        "wave_counts": with_(M, "SELECT Innovation_Wave, count(*) AS n FROM model WHERE Innovation_Wave IS NOT NULL GROUP BY 1"),
        "wave_share": with_(M, f"""SELECT Innovation_Wave, n, {pct('n', 'sum(n) OVER ()')} AS share_pct FROM (
            SELECT Innovation_Wave, count(*) AS n FROM model WHERE Innovation_Wave IS NOT NULL GROUP BY 1)"""),
        "wave_maturity": with_(M, f"""SELECT n_waves, n_wave3, n_wave2, n_wave1,
            CASE WHEN n_wave3 > 0 THEN '3.0' WHEN n_wave2 > 0 THEN '2.0' END AS maturity_wave,
            {pct('CASE WHEN n_wave3 > 0 THEN n_wave3 WHEN n_wave2 > 0 THEN n_wave2 END', 'n_waves')} AS maturity_pct
            FROM (SELECT count(*) FILTER (WHERE Innovation_Wave IS NOT NULL AND Innovation_Wave <> '') AS n_waves,
              count(*) FILTER (WHERE Innovation_Wave = '3.0') AS n_wave3,
              count(*) FILTER (WHERE Innovation_Wave = '2.0') AS n_wave2,
              count(*) FILTER (WHERE Innovation_Wave = '1.0') AS n_wave1 FROM model)"""),
        "capability_top10": with_(M, """SELECT DC, count(*) AS n FROM (
            SELECT unnest(string_split(Driving_Capabilities, ', ')) AS DC FROM model WHERE Driving_Capabilities IS NOT NULL)
            GROUP BY 1 ORDER BY n DESC, DC LIMIT 10"""),
        "capability_counts": with_(M, "SELECT DC, count(*) AS n FROM (SELECT unnest(dcl) AS DC FROM mdc) GROUP BY 1"),
        "top_capability": with_(M, "SELECT DC, n FROM (" + " UNION ALL ".join(
            f"SELECT '{c}' AS DC, {_dc_count(c)} AS n FROM mflag" for c in DC_CODES)
            + ") WHERE n > 0 ORDER BY n DESC, DC LIMIT 1"),
        "capability_density": with_(M, f"""SELECT avg_dcs, CASE WHEN avg_dcs >= 3 THEN 'high' ELSE 'moderate' END AS level
            FROM (SELECT avg({_per_row_dc}) AS avg_dcs FROM mflag)"""),
        "capability_heatmap": with_(M, "SELECT Predicted_Archetype, " + ", ".join(
            f"count(*) FILTER (WHERE DC = '{c}') AS {c}" for c in DC_CODES)
            + " FROM (SELECT Predicted_Archetype, unnest(dcl) AS DC FROM mdc) GROUP BY 1"),
        "wave_archetype": with_(M, "SELECT Innovation_Wave, Predicted_Archetype, count(*) AS n FROM model GROUP BY 1, 2"),
        "hybrid_share": with_(M, f"""SELECT n_hybrid, n_total, {pct('n_hybrid', 'n_total')} AS hybrid_pct FROM (
            SELECT count(*) FILTER (WHERE Secondary_Archetypes IS NOT NULL AND Secondary_Archetypes <> ''
              AND Secondary_Archetypes <> '[]') AS n_hybrid, count(*) AS n_total FROM model)"""),
        "archetype_summary": with_(M + [
            "base AS (SELECT Predicted_Archetype, count(*) AS n, " + ", ".join(
                f"{_dc_count(c)} AS {c}" for c in DC_CODES) + " FROM mflag GROUP BY 1)",
            f"based AS (SELECT *, {pct('n', 'sum(n) OVER ()')} AS pct FROM base)",
            "dcs AS (SELECT Predicted_Archetype, string_agg(dc, ', ' ORDER BY r) FILTER (WHERE r <= 3) AS top3, "
            "sum(m) AS msum FROM (SELECT Predicted_Archetype, dc, m, row_number() OVER (PARTITION BY Predicted_Archetype "
            "ORDER BY m DESC, dc) AS r FROM (" + " UNION ALL ".join(
                f"SELECT Predicted_Archetype, '{c}' AS dc, {c} AS m FROM base" for c in DC_CODES)
            + ")) GROUP BY 1)",
            """wv AS (SELECT Predicted_Archetype, Innovation_Wave AS dominant_wave FROM (
              SELECT Predicted_Archetype, Innovation_Wave, row_number() OVER (PARTITION BY Predicted_Archetype
                ORDER BY count(*) DESC, Innovation_Wave) AS r
              FROM model WHERE Innovation_Wave IS NOT NULL AND Predicted_Archetype IS NOT NULL GROUP BY 1, 2)
              WHERE r = 1)"""],
            """SELECT b.Predicted_Archetype, b.n, b.pct, CASE WHEN d.msum > 0 THEN d.top3 END AS top_capabilities,
               w.dominant_wave FROM based b JOIN dcs d USING (Predicted_Archetype)
               LEFT JOIN wv w USING (Predicted_Archetype) WHERE b.Predicted_Archetype IS NOT NULL"""),
        "wave_profile": with_(M + [
            "per AS (SELECT Innovation_Wave, Predicted_Archetype, count(*) AS n FROM model GROUP BY 1, 2)",
            f"sizes AS (SELECT Innovation_Wave, n, {pct('n', 'sum(n) OVER ()')} AS pct FROM "
            "(SELECT Innovation_Wave, sum(n) AS n FROM per GROUP BY 1))",
            """wtop AS (SELECT Innovation_Wave, string_agg(Predicted_Archetype || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY r)
              AS top_archetypes FROM (SELECT *, row_number() OVER (PARTITION BY Innovation_Wave
                ORDER BY n DESC, Predicted_Archetype) AS r FROM per
              WHERE Innovation_Wave IS NOT NULL AND Predicted_Archetype IS NOT NULL) WHERE r <= 3 GROUP BY 1)"""],
            """SELECT s.Innovation_Wave, CAST(s.n AS BIGINT) AS n, s.pct, t.top_archetypes FROM sizes s
               LEFT JOIN wtop t USING (Innovation_Wave) WHERE s.Innovation_Wave IS NOT NULL"""),
        "findings": with_(M + [
            f"""fsc AS (SELECT count(*) AS total,
                count(*) FILTER (WHERE coalesce(contains(Predicted_Archetype, 'Error'), false)) AS errors,
                count(DISTINCT Predicted_Archetype) FILTER (WHERE {NOT_ERR}) AS n_distinct,
                count(*) FILTER (WHERE Innovation_Wave IS NOT NULL AND Innovation_Wave <> '') AS n_waves,
                count(*) FILTER (WHERE Innovation_Wave = '3.0') AS n3,
                count(*) FILTER (WHERE Innovation_Wave = '2.0') AS n2,
                count(*) FILTER (WHERE Secondary_Archetypes IS NOT NULL AND Secondary_Archetypes <> ''
                  AND Secondary_Archetypes <> '[]') AS n_hybrid,
                avg({_per_row_dc}) AS avg_dcs, """ + ", ".join(f"{_dc_count(c)} AS {c}" for c in DC_CODES)
            + " FROM mflag)",
            "dct AS (SELECT dc, m FROM (" + " UNION ALL ".join(
                f"SELECT '{c}' AS dc, {c} AS m FROM fsc" for c in DC_CODES) + ") ORDER BY m DESC, dc LIMIT 1)",
            f"""dom AS (SELECT Predicted_Archetype, n, {pct('n', 'tot')} AS v FROM (
                SELECT Predicted_Archetype, n, sum(n) OVER () AS tot FROM (
                  SELECT Predicted_Archetype, count(*) AS n FROM model WHERE {NOT_ERR} GROUP BY 1))
                WHERE Predicted_Archetype IS NOT NULL
                ORDER BY n DESC, Predicted_Archetype LIMIT 1)"""],
            f"""SELECT 'dominant_archetype' AS finding, Predicted_Archetype AS label, CAST(n AS BIGINT) AS n,
                 CAST(v AS DOUBLE) AS value FROM dom
               UNION ALL
               SELECT 'innovation_maturity', CASE WHEN n3 > 0 THEN '3.0' ELSE '2.0' END,
                 CAST(CASE WHEN n3 > 0 THEN n3 ELSE n2 END AS BIGINT),
                 {pct('CASE WHEN n3 > 0 THEN n3 ELSE n2 END', 'n_waves')} FROM fsc WHERE n_waves > 0 AND (n3 > 0 OR n2 > 0)
               UNION ALL
               SELECT 'top_capability', dct.dc, CAST(dct.m AS BIGINT), CAST(NULL AS DOUBLE) FROM dct, fsc
                 WHERE fsc.DC1 + fsc.DC2 + fsc.DC3 + fsc.DC4 + fsc.DC5 > 0
               UNION ALL
               SELECT 'capability_density', CASE WHEN avg_dcs >= 3 THEN 'high' ELSE 'moderate' END,
                 CAST(NULL AS BIGINT), avg_dcs FROM fsc WHERE DC1 + DC2 + DC3 + DC4 + DC5 > 0
               UNION ALL
               SELECT 'classification_quality', CAST(total AS VARCHAR), CAST(total - errors AS BIGINT),
                 coalesce({pct('total - errors', 'total')}, 0.0) FROM fsc
               UNION ALL
               SELECT 'ecosystem_diversity', CAST(NULL AS VARCHAR), CAST(n_distinct AS BIGINT), CAST(NULL AS DOUBLE) FROM fsc
               UNION ALL
               SELECT 'hybrid_models', CAST(NULL AS VARCHAR), CAST(n_hybrid AS BIGINT), {pct('n_hybrid', 'total')}
                 FROM fsc WHERE n_hybrid > 0"""),
        "incremental_classify": with_(C, f"SELECT company_id, {SELECT6} FROM classified"),
        # keyword mode is free; a finished stream has nothing left
        "batch_progress": with_(C + [f"""batches AS (SELECT company_id % 3 AS batch_id, count(*) AS n_rows,
                count(*) FILTER (WHERE {BILLABLE}) AS n_billable FROM classified GROUP BY 1)"""],
            """SELECT batch_id, n_rows, n_billable, CAST(0.0 AS DOUBLE) AS batch_cost, rows_done,
                CAST(0.0 AS DOUBLE) AS cost_so_far,
                CAST(rows_done AS DOUBLE) * 100.0 / CAST(sum(n_rows) OVER () AS DOUBLE) AS pct_done
            FROM (SELECT *, CAST(sum(n_rows) OVER (ORDER BY batch_id) AS BIGINT) AS rows_done FROM batches)"""),
        "batch_totals": with_(C + ["model AS (SELECT * FROM classified)"],
            f"""SELECT count(*) AS rows_done, count(*) FILTER (WHERE {BILLABLE}) AS n_billable,
                CAST(0.0 AS DOUBLE) AS cost, CAST(100.0 AS DOUBLE) AS pct_done, '0s' AS eta_text FROM model"""),
        "export_roundtrip": with_(C, f"SELECT company_id, {SELECT6}, 'keywords' AS mode, 'r1' AS run_id FROM classified"),
    }
    tokens = _list(NULL_TOKENS)
    d["scan_multiline"] = f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN list_contains({tokens}, text) THEN NULL ELSE text END
        AS text, lang, source FROM documents"""
    d["scan_inferred"] = """SELECT CAST(o_orderkey AS BIGINT) AS whole,
        CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey * 1000 AS BIGINT) END AS whole_or_null, CAST(o_totalprice AS DOUBLE) AS number,
        CASE WHEN o_orderkey % 3 = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(o_orderkey AS DOUBLE) END AS whole_or_number,
        CASE WHEN o_orderkey % 2 = 0 THEN true WHEN o_orderkey % 5 <> 0 THEN false END AS truth,
        CASE WHEN o_orderkey % 1000 = 1 THEN 'about 3' ELSE CAST(o_orderkey AS VARCHAR) END AS mostly_whole,
        CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE '1' END AS truth_and_number,
        o_orderpriority AS text, CAST(NULL AS VARCHAR) AS nothing FROM orders"""
    place = "row_number() OVER (ORDER BY company_id) - 1 AS position"
    d["input_positions"] = with_([COMPANIES], f"SELECT {place}, Company, Description FROM companies")
    d["first_rows"] = with_(C, f"""SELECT {place}, Company, Predicted_Archetype, Confidence_Score FROM classified
        ORDER BY company_id LIMIT 10""")
    d["positional_join"] = with_(C, f"SELECT {place}, Company, founded, Predicted_Archetype, Keywords_Found FROM classified")
    d["explorer_search_counts"] = with_(C, "SELECT count(*) FILTER (WHERE Predicted_Archetype IN ({}) AND ({})) AS n_shown, "
        "count(*) AS n_total FROM classified".format(", ".join(q(x) for x in EXPLORER_LABELS), " OR ".join(
            f"coalesce(regexp_matches(CAST({c} AS VARCHAR), {q(SEARCH_COMPANIES)}, 'i'), false)"
            for c in ["company_id", "Company", "Industries", "industry_groups", "Description", "founded",
                      "Predicted_Archetype", "Confidence_Score", "Keywords_Found"])))
    for name, table, col in (("archetype_ranking", "archetype_counts", "Predicted_Archetype"),
                             ("wave_ranking", "wave_counts", "Innovation_Wave"), ("capability_ranking", "capability_counts", "DC")):
        d[name] = f"SELECT {col}, n, row_number() OVER (ORDER BY n DESC, {col}) AS place FROM ({d[table]})"
    d["empty_table_rates"] = """SELECT CAST(0 AS BIGINT) AS n_exact, CAST(NULL AS DOUBLE) AS exact_rate, CAST(0 AS BIGINT) AS n_total,
        CAST(0 AS BIGINT) AS n_errors, CAST(0.0 AS DOUBLE) AS success_rate, CAST(0 AS BIGINT) AS n_hybrid,
        CAST(0 AS BIGINT) AS n_rows, CAST(NULL AS DOUBLE) AS hybrid_pct"""
    d["answer_log"] = with_(C + [f"asked AS (SELECT company_id, {_prompt_sql()} AS p FROM companies)"],
        """SELECT company_id, CASE WHEN CAST('0x' || substr(sha256(p), 1, 4) AS INTEGER) % 16 < 8 THEN 'first' ELSE 'second' END AS run,
            CAST(1 AS BIGINT) AS times_asked, 'model' AS result_source,
            CASE WHEN length(p) % 3 = 0 THEN 'API Error - JSON'
                 ELSE ['Enablers', 'Connectors', 'Innovators', 'Protectors'][length(p) % 4 + 1] END AS Predicted_Archetype,
            CASE WHEN length(p) % 3 = 0 THEN 'Low' ELSE 'High' END AS Confidence_Score,
            CASE WHEN length(p) % 3 = 0 THEN '' ELSE CAST(length(p) % 3 + 1 AS VARCHAR) || '.0' END AS Innovation_Wave FROM asked""")
    # the findings over the results after the age correction
    d["findings_live"] = d["findings"].replace("model AS (SELECT c.company_id,", "model0 AS (SELECT c.company_id,", 1).replace(
        "mdc AS (", f"""model AS (SELECT m.* REPLACE (CASE WHEN m.Predicted_Archetype IN ('Disruptors', 'Innovators')
          AND TRY_CAST(c.founded AS DOUBLE) < {AGE_CUTOFF} THEN 'Traditional / Generalist' ELSE m.Predicted_Archetype END
          AS Predicted_Archetype) FROM model0 m JOIN companies c USING (company_id)),\nmdc AS (""", 1)
    d["label_counts_live"] = d["findings_live"][:d["findings_live"].index(",\nfsc AS (")] + """
        SELECT Predicted_Archetype, CAST(count(*) AS BIGINT) AS n FROM model WHERE Predicted_Archetype IS NOT NULL GROUP BY 1"""
    d["incremental_classify_csv"] = d["incremental_classify"]
    d["explorer_search_indexed"] = d["explorer_search_docs"]
    # any match holds lic, ice and cen, or pas, ass and ssw
    held = lambda *grams: " AND ".join("(" + " OR ".join(
        f"coalesce(contains(lower(CAST({c} AS VARCHAR)), '{g}'), false)" for c in ("doc_id", "text", "lang", "source", "n_chars"))
        + ")" for g in grams)
    d["search_scanned"] = f"""SELECT (SELECT count(*) FROM documents WHERE ({held('lic', 'ice', 'cen')})
        OR ({held('pas', 'ass', 'ssw')})) AS n_tested, (SELECT count(*) FROM ({d['explorer_search_docs']})) AS n_found,
        (SELECT count(*) FROM documents) AS n_total"""
    versions = "['', 'saas platform', 'robotic claims']"
    waves = lambda even, odd: (f"SELECT company_id AS id, concat_ws(' ', Description, {versions}[v + 1]) AS txt FROM "  # noqa: E731
                               f"(SELECT *, CASE WHEN company_id % 2 = 0 THEN {even} ELSE {odd} END AS v FROM companies)")
    d["stream_keyed"] = with_([COMPANIES] + classify_ctes(waves(0, 1), default_lexicon(), "a_")
                              + classify_ctes(waves(2, 1), default_lexicon(), "b_"),
        """SELECT a.id AS company_id, CASE WHEN a.id % 2 = 0 THEN 0 ELSE 1 END AS first_version,
            CASE WHEN a.id % 2 = 0 THEN 2 ELSE 1 END AS last_version, a.Predicted_Archetype AS first_label,
            b.Predicted_Archetype AS last_label FROM a_cls a JOIN b_cls b ON a.id = b.id""")
    d["top_labels"] = """SELECT 'part ' || CAST(l_partkey AS VARCHAR) AS label, count(*) AS n FROM lineitem GROUP BY 1
        ORDER BY n DESC, label LIMIT 10"""
    d["distinct_labels"] = """SELECT CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT l_partkey) AS n_exact, true AS within_5_pct
        FROM lineitem"""
    d["run_ids"] = """SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400), '%Y%m%d_%H%M')
        AS run_id FROM orders"""
    d["scan_parquet"] = with_([COMPANIES], """SELECT company_id, Company, Industries, industry_groups, Description, founded
        FROM companies""")
    d["scan_json"] = d["scan_parquet"]
    # the first column is the name, the second the description
    d["upload_mapping"] = with_([COMPANIES], """SELECT CAST(company_id AS VARCHAR) AS name, Company AS description
        FROM companies""")
    d["findings_text"] = f"""SELECT finding, label, n, value, CASE
        WHEN finding = 'dominant_archetype'
          THEN printf('**%s** is the dominant archetype with %d companies (%.1f%%)', label, n, value)
        WHEN finding = 'innovation_maturity' AND label = '3.0'
          THEN printf('**%.1f%%** of companies are in Wave 3.0, indicating a highly evolved ecosystem ', value)
            || 'with embedded insurance and open platforms'
        WHEN finding = 'innovation_maturity'
          THEN printf('**%.1f%%** in Wave 2.0, showing strong B2B enabler presence', value)
        WHEN finding = 'top_capability'
          THEN printf('**%s** is the most prevalent driving capability across the ecosystem', label)
        WHEN finding = 'capability_density'
          THEN printf('Companies leverage an average of **%.1f capabilities**, showing %s technological sophistication',
                      value, label)
        WHEN finding = 'classification_quality'
          THEN printf('**%.1f%%** successful classifications (%d/%s companies)', value, n, label)
        WHEN finding = 'ecosystem_diversity'
          THEN printf('Ecosystem spans **%d different archetypes** from the framework', n)
        WHEN finding = 'hybrid_models'
          THEN printf('**%.1f%%** of companies exhibit hybrid characteristics, operating across multiple archetypes', value)
        END AS text FROM ({d["findings"]}) f"""
    d["classify_keywords_docs_arrow"] = d["classify_keywords_docs"]
    d["classify_keywords_docs_native"] = d["classify_keywords_docs"]
    d["classify_default_docs_native"] = d["classify_default_docs"]
    d["classify_keywords_native"] = d["classify_keywords"]
    return d
