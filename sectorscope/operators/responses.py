"""Model enrichment as table-to-table jobs.

The hosted-model call itself is outside Spark. What Spark does is the data
work on both sides of it: render one request per row (``render_requests``),
and turn a table of stored JSON responses into result columns
(``parse_responses``), then merge them with the keyword result
(``merge_with_keywords``) and account for cost. Responses join the input on
``company_id`` (an equi-join on a unique key, so no skew).
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's for identical prompts/costs.
# The framework text leaves out its source's title; it is a parameter of ``render_requests``.
FRAMEWORK_CONTEXT = """
ARQUETIPOS (7):
1. Innovators: Nuevos modelos (P2P, on-demand, paramétrico, microseguros)
2. Disruptors: Eficiencia extrema vía automatización/AI (full-stack carriers)
3. Enablers: Infraestructura tech B2B (SaaS, APIs, plataformas)
4. Connectors: Marketplaces, comparadores, brokers digitales
5. Protectors: Prevención proactiva (IoT, telemática, cyber)
6. Integrators: Embedded insurance (API-first, B2B2C)
7. Transformers: Consultoría de digitalización para legacy

DRIVING CAPABILITIES (5):
DC1: Infraestructura digital (IaaS, SaaS, cloud, APIs)
DC2: Datos & Analytics (AI, ML, Big Data, actuarial)
DC3: Experiencia Cliente (chatbots, omnicanal, UX/UI)
DC4: Diseño de Producto (on-demand, paramétrico, personalización)
DC5: Distribución Digital (venta 100% online, autoservicio)

OLAS DE INNOVACIÓN (3):
1.0 (2010-2015): Startups disruptivas, P2P, desintermediación
2.0 (2015-2020): Habilitadores B2B, APIs, colaboración
3.0 (2020-presente): Ecosistemas, embedded, open insurance
"""

PROMPT_TEMPLATE = """
{framework_context}

EMPRESA:
Nombre: {company_name}
Descripción: {description}
Industrias: {industries}

ANÁLISIS REQUERIDO:
Clasifica usando el marco. Devuelve SOLO JSON:

{{
  "archetype": "Nombre exacto del arquetipo",
  "secondary_archetypes": ["Otro1", "Otro2"] o [],
  "driving_capabilities": ["DC1", "DC2"],
  "innovation_wave": "1.0" | "2.0" | "3.0",
  "justification": "Max 150 caracteres",
  "confidence": "High" | "Medium" | "Low"
}}
"""

DESCRIPTION_CHARS = 500          # text passed to the model
JUSTIFICATION_CHARS = 200        # longer justifications are cut and get "..."
ERROR_MESSAGE_CHARS = 80         # "Error: " + first 80 chars of the message
PRICE_INPUT_PER_M = 0.15         # USD per 1M input tokens
PRICE_OUTPUT_PER_M = 0.60        # USD per 1M output tokens
FRAMEWORK_TOKENS = 258           # token estimate of the framework text, title included
EXTRA_INPUT_TOKENS = 200         # added to the framework's token estimate
OUTPUT_TOKENS_PER_COMPANY = 250
LEDGER_COST_PER_ROW = 0.0002     # running cost per billable row
RATE_ROWS_PER_SECOND = 2         # sequential model calls per second
CHARS_PER_TOKEN = 4
NOT_BILLED = ["API Error", "Unclassified", "Processing Error"]

JSON_ERROR = "API Error - JSON"
API_ERROR = "API Error"
JSON_ERROR_TEXT = "JSON parse error"
DEFAULT_ARCHETYPE = "Unclassified"
DEFAULT_CONFIDENCE = "Medium"
ERROR_CONFIDENCE = "Low"
PROCESSING_ERROR = "Processing Error"   # a request whose processing raised
PROCESSING_MESSAGE_CHARS = 100          # its message, cut to this length
ESTIMATE_TIME_FORMAT = "~%dm %ds"  # time estimate shown before a run
# End of fixed values.
# ---------------------------------------------------------------------------

RESPONSE_SCHEMA = ("archetype string, secondary_archetypes array<string>, "
                   "driving_capabilities array<string>, innovation_wave string, "
                   "justification string, confidence string")

RESULT_COLUMNS = ["Predicted_Archetype", "Confidence_Score", "Keywords_Found",
                  "Secondary_Archetypes", "Driving_Capabilities", "Innovation_Wave"]


def template_parts(template: str) -> list[tuple[str, str | None]]:
    """Split a ``str.format`` template into (literal, field) pairs at plan time."""
    return [(lit, fld) for lit, fld, _, _ in string.Formatter().parse(template)]


def render_prompt(fields: dict[str, Column], template: str = PROMPT_TEMPLATE) -> Column:
    """``template.format(**fields)`` as one ``concat`` of literals and columns."""
    pieces: list[Column] = []
    for lit, fld in template_parts(template):
        if lit:
            pieces.append(F.lit(lit))
        if fld is not None:
            pieces.append(fields[fld])
    return F.concat(*pieces)


def render_requests(df: DataFrame, name: Column, text: Column, industries: Column,
                    framework: str = FRAMEWORK_CONTEXT, template: str = PROMPT_TEMPLATE) -> DataFrame:
    """Add ``prompt``: framework text, name, first 500 characters of the text, industries."""
    prompt = render_prompt({
        "framework_context": F.lit(framework),
        "company_name": name,
        "description": F.substring(text, 1, DESCRIPTION_CHARS),
        "industries": industries,
    }, template)
    return df.withColumn("prompt", prompt)


def token_estimate(text: Column) -> Column:
    """Characters // 4."""
    return F.floor(F.length(text) / CHARS_PER_TOKEN).cast("bigint")


def _python_type_name(j: Column) -> Column:
    """Python type name of a valid non-object JSON document without outer white space (for the error text)."""
    head = F.substring(j, 1, 1)
    number = F.when(j.rlike("[.eE]"), F.lit("float")).otherwise(F.lit("int"))
    return (F.when(head == "[", F.lit("list"))
             .when(head == '"', F.lit("str"))
             .when(head.isin("t", "f"), F.lit("bool"))
             .when(head == "n", F.lit("NoneType"))
             .otherwise(number))


_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parse_responses(df: DataFrame, json_col: str = "response_json", error_col: str = "error") -> DataFrame:
    """Add the six result columns and ``error_class`` (null / 'processing' / 'json' / 'api').

    * a recorded failure (``error_col`` set, when the table has it) ->
      ("Processing Error", Low, the message cut to 100 characters)
    * not valid JSON -> ("API Error - JSON", Low, "JSON parse error")
    * valid JSON that is not an object -> ("API Error", Low, "Error: <message>")
    * an object -> fields with defaults; null and absent both get the default;
      a field of the wrong type (e.g. a string where a list is expected) is
      treated as absent and the row is flagged in ``type_mismatch``.
    """
    j = F.regexp_replace(F.col(json_col), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    out = df.withColumn("_r", F.from_json(j, RESPONSE_SCHEMA))
    # in brackets, so that anything after the document makes it invalid
    wrapped = F.try_parse_json(F.concat(F.lit("["), j, F.lit("]")))
    alone = wrapped.isNotNull() & F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    # ... and in braces, since the parser stops after the first document: "1],[2" is none in braces
    braced = F.from_json(F.concat(F.lit('{"a":'), j, F.lit("}")), "map<string,string>").isNotNull()
    # a key that occurs twice keeps its last value, as in Python's parser; a variant refuses it, plain JSON does not
    repeats = F.size(F.from_json(F.concat(F.lit("["), j, F.lit("]")), "array<string>", _STRICT)) == 1
    valid = (F.length(j) > 0) & braced & (alone | (wrapped.isNull() & F.coalesce(repeats, F.lit(False))))
    is_obj = F.substring(j, 1, 1) == "{"
    failed = F.col(error_col).isNotNull() if error_col in df.columns else F.lit(False)
    message = F.col(error_col) if error_col in df.columns else F.lit(None).cast("string")
    err = (F.when(failed, F.lit("processing"))
            .when(j.isNull() | ~valid, F.lit("json"))
            .when(~is_obj, F.lit("api")))
    out = out.withColumn("error_class", err)
    r = F.col("_r")
    just = F.coalesce(r["justification"], F.lit(""))
    just = F.when(F.length(just) > JUSTIFICATION_CHARS,
                  F.concat(F.substring(just, 1, JUSTIFICATION_CHARS), F.lit("..."))).otherwise(just)
    api_msg = F.concat(F.lit("'"), _python_type_name(j), F.lit("' object has no attribute 'get'"))
    e = F.col("error_class")
    ok = e.isNull()

    def pick(value: Column, on_json: Column, on_api: Column, on_failed: Column | None = None) -> Column:
        on_failed = on_json if on_failed is None else on_failed
        return (F.when(ok, value).when(e == "processing", on_failed)
                 .when(e == "json", on_json).otherwise(on_api))

    def joined(field: str) -> Column:
        return F.coalesce(F.array_join(r[field], ", "), F.lit(""))

    mismatch = F.lit(False)
    for field in ("secondary_archetypes", "driving_capabilities"):
        present = F.get_json_object(j, f"$.{field}").isNotNull()
        mismatch = mismatch | (present & r[field].isNull())
    out = out.withColumns({
        "Predicted_Archetype": pick(F.coalesce(r["archetype"], F.lit(DEFAULT_ARCHETYPE)),
                                    F.lit(JSON_ERROR), F.lit(API_ERROR), F.lit(PROCESSING_ERROR)),
        "Confidence_Score": pick(F.coalesce(r["confidence"], F.lit(DEFAULT_CONFIDENCE)),
                                 F.lit(ERROR_CONFIDENCE), F.lit(ERROR_CONFIDENCE)),
        "Keywords_Found": pick(just, F.lit(JSON_ERROR_TEXT),
                               F.concat(F.lit("Error: "), F.substring(api_msg, 1, ERROR_MESSAGE_CHARS)),
                               F.substring(message, 1, PROCESSING_MESSAGE_CHARS)),
        "Secondary_Archetypes": pick(joined("secondary_archetypes"), F.lit(""), F.lit("")),
        "Driving_Capabilities": pick(joined("driving_capabilities"), F.lit(""), F.lit("")),
        "Innovation_Wave": pick(F.coalesce(r["innovation_wave"], F.lit("")), F.lit(""), F.lit("")),
        "type_mismatch": ok & mismatch,
    })
    return out.drop("_r")


def merge_with_keywords(keyword_result: DataFrame, parsed: DataFrame, key: str = "company_id",
                        errors_to_keywords: bool = False) -> DataFrame:
    """Model result where a response exists, keyword result otherwise.

    ``keyword_result`` holds the input rows with the keyword result columns;
    ``parsed`` holds ``key`` + the parsed result columns + ``error_class``.
    With ``errors_to_keywords`` an error response also falls back. Of several
    responses for one key the smallest counts, by error class (none first) and
    then by the result columns, so a key never multiplies its rows.
    """
    resp = (parsed.groupBy(key).agg(F.min(F.struct("error_class", *RESULT_COLUMNS)).alias("_r"))
            .select(key, "_r.error_class", *[F.col(f"_r.{c}").alias(f"_m_{c}") for c in RESULT_COLUMNS],
                    F.lit(True).alias("_has_resp")))
    out = keyword_result.join(resp, key, "left")
    use_model = F.col("_has_resp").isNotNull()
    if errors_to_keywords:
        use_model = use_model & F.col("error_class").isNull()
    out = out.withColumns({c: F.when(use_model, F.col(f"_m_{c}")).otherwise(F.col(c))
                           for c in RESULT_COLUMNS})
    out = out.withColumn("result_source", F.when(use_model, F.lit("model")).otherwise(F.lit("keywords")))
    return out.drop(*[f"_m_{c}" for c in RESULT_COLUMNS], "_has_resp")


def billable(arch: Column, not_billed: list[str] = NOT_BILLED) -> Column:
    """Rows that cost money in model mode (null archetype counts as billable)."""
    return ~F.coalesce(arch.isin(*not_billed), F.lit(False))


def estimated_cost(n: Column, framework_tokens: int = FRAMEWORK_TOKENS) -> dict[str, Column]:
    """Cost and duration estimate for ``n`` companies (before a run)."""
    per_in = framework_tokens + EXTRA_INPUT_TOKENS
    tin = (n * per_in).cast("bigint")
    tout = (n * OUTPUT_TOKENS_PER_COMPANY).cast("bigint")
    cost = tin / 1_000_000 * PRICE_INPUT_PER_M + tout / 1_000_000 * PRICE_OUTPUT_PER_M
    secs = n / RATE_ROWS_PER_SECOND
    # minutes and seconds, both truncated
    text = F.format_string(ESTIMATE_TIME_FORMAT, F.floor(secs / 60).cast("bigint"),
                           F.floor(secs % 60).cast("bigint"))
    return {"input_tokens": tin, "output_tokens": tout, "total_cost_usd": cost,
            "est_seconds": secs, "est_time_text": text}


def actual_cost(input_tokens: Column, output_tokens: Column) -> Column:
    return input_tokens / 1_000_000 * PRICE_INPUT_PER_M + output_tokens / 1_000_000 * PRICE_OUTPUT_PER_M


# --- the model step as a pluggable DataFrame -> DataFrame --------------------------

def answered(stored: DataFrame, json_col: str = "response_json", error_col: str = "error") -> DataFrame:
    """Rows of a stored-response table that hold an answer or a recorded failure.

    A row with neither (null response, no error) was never answered.
    """
    has = F.col(json_col).isNotNull()
    if error_col in stored.columns:
        has = has | F.col(error_col).isNotNull()
    return stored.filter(has)


def stored_responder(stored: DataFrame, key: str = "company_id") -> Callable[[DataFrame], DataFrame]:
    """Answer requests from a table of earlier responses (``key``, ``response_json``, ...).

    Returns the answered rows of the stored table: ``classify_with_model``
    left-joins them to its input on ``key``, so stored rows nobody asked for
    drop out there, and no extra join against the requests (or re-scan of
    the input) is needed. A request without an answer falls back to keywords.
    """
    def respond(requests: DataFrame) -> DataFrame:
        return answered(stored)
    return respond


def pandas_responder(fn, key: str = "company_id", batch_rows: int = 1) -> Callable[[DataFrame], DataFrame]:
    """Wrap ``fn(pandas.DataFrame[key, prompt]) -> pandas.DataFrame[key, response_json]``.

    Runs with ``mapInPandas`` on the executors, so a caller can put a model
    client here; ``fn`` gets ``batch_rows`` requests a call. A call that raises
    gives its requests the message in ``error`` (parsed as "Processing Error");
    nothing is sent twice. The answers are written once to the shared folder
    and read back, so that whatever is computed from them later asks nothing
    again. The key's type is the input's.
    """
    import pandas as pd
    from pyspark.sql.types import StringType, StructField, StructType

    from sectorscope.session import materialize

    def ask(req: "pd.DataFrame") -> "pd.DataFrame":
        try:
            return fn(req).assign(error=None)
        except Exception as exc:  # noqa: BLE001 - recorded with the requests
            return pd.DataFrame({key: req[key].to_numpy(), "response_json": None, "error": str(exc)})

    def respond(requests: DataFrame) -> DataFrame:
        def run(batches):
            for pdf in batches:
                for at in range(0, len(pdf), batch_rows):
                    yield ask(pdf[[key, "prompt"]].iloc[at:at + batch_rows])[[key, "response_json", "error"]]
        schema = StructType([StructField(key, requests.schema[key].dataType), StructField("response_json", StringType()),
                             StructField("error", StringType())])
        return materialize(requests.select(key, "prompt").mapInPandas(run, schema), "answers")
    return respond


def classify_with_model(df: DataFrame, keyword_result: DataFrame, responder, name: Column, text: Column,
                        industries: Column, key: str = "company_id",
                        errors_to_keywords: bool = False) -> DataFrame:
    """Model mode: render requests, ask ``responder``, parse, fall back to keywords.

    ``keyword_result`` is ``df`` classified in keyword mode (the fallback).
    Columns of the prompt the responder does not read are pruned by Catalyst.
    """
    requests = render_requests(df.select(key, name.alias("_name"), text.alias("_text"),
                                         industries.alias("_ind")),
                               F.col("_name"), F.col("_text"), F.col("_ind")).select(key, "prompt")
    parsed = parse_responses(responder(requests))
    return merge_with_keywords(keyword_result, parsed, key, errors_to_keywords)
