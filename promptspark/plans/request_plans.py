"""Plans for request logs and the judge surface (build step 7).

``events`` plays the request log: ``error`` events are failed requests,
``value`` x 10 is the latency in ms, ``props.k`` the prompt tokens and
``user_id`` the completion tokens.  Each event is first rendered as the raw
response body its provider would send (shape by event type), so the
normaliser parses real JSON.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import approx4
from ..operators import judge as jg
from ..operators import requests as rq
from ..sources.tables import table
from . import register

GPT4 = (0.03, 0.06)
JUDGE_MODELS = ["gpt-4", "claude-3-opus", "anthropic/claude-3-haiku", "gpt-3.5-turbo", "mistral-large"]


def raw_responses(spark, sf_dir):
    return render_responses(table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type",
                                  "value", "props"))


def render_responses(ev):
    """Each event as the raw body its provider would return (batch or stream)."""
    k = F.get_json_object("props", "$.k").cast("long")
    content = F.format_string("event %d %s", "event_id", "props")
    u = F.col("user_id")
    body = (F.when(F.col("event_type") == "click", F.to_json(F.struct(
                F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"),
                F.struct(k.alias("prompt_tokens"), u.alias("completion_tokens"),
                         (k + u).alias("total_tokens")).alias("usage"),
                F.lit("gpt-4").alias("model"))))
            .when(F.col("event_type") == "view", F.to_json(F.struct(
                F.array(F.struct(F.lit("text").alias("type"), content.alias("text"))).alias("content"),
                F.struct(k.alias("input_tokens"), u.alias("output_tokens")).alias("usage"),
                F.lit("claude-3-haiku").alias("model"))))
            .when(F.col("event_type") == "signup", F.to_json(F.struct(
                content.alias("response"),
                F.struct(k.alias("prompt_tokens"), u.alias("completion_tokens")).alias("usage"))))
            .when(F.col("event_type") == "purchase", F.to_json(F.struct(content.alias("output"))))
            .otherwise(F.to_json(F.struct(F.struct(F.format_string("rate limited: %s", "props")
                                                   .alias("message")).alias("error")))))
    return ev.select("event_id", "ts", "value", "event_type", body.alias("body"))


def request_log(spark, sf_dir):
    return requests_from(raw_responses(spark, sf_dir))


def requests_from(r):
    n = rq.normalize_response("body")
    return r.select("ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("success"),
                    F.round(F.col("value") * 10).cast("long").alias("latency_ms"),
                    n.content.alias("content"), n.input_tokens.alias("input_tokens"),
                    n.output_tokens.alias("output_tokens"), n.total_tokens.alias("total_tokens"),
                    n.model.alias("model"), n.error.alias("error"))


_SQL_LOG = """
r AS (SELECT event_id, ts, value, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
             user_id AS u, props, 'event ' || event_id || ' ' || props AS c FROM events),
lg AS (SELECT ts, event_id AS seq, event_type <> 'error' AS success,
              CAST(round(value * 10) AS BIGINT) AS latency_ms,
              CASE WHEN event_type = 'error' THEN NULL ELSE c END AS content,
              CASE WHEN event_type IN ('click', 'view', 'signup') THEN k END AS input_tokens,
              CASE WHEN event_type IN ('click', 'view', 'signup') THEN u END AS output_tokens,
              CASE WHEN event_type = 'click' THEN k + u END AS total_tokens,
              CASE event_type WHEN 'click' THEN 'gpt-4' WHEN 'view' THEN 'claude-3-haiku' END AS model,
              CASE WHEN event_type = 'error' THEN 'rate limited: ' || props END AS error
       FROM r)"""


@register("response_log", "WITH " + _SQL_LOG + """
SELECT seq AS event_id, content, input_tokens, output_tokens, total_tokens, model, error FROM lg""")
def response_log(spark, sf_dir):
    return request_log(spark, sf_dir).select(F.col("seq").alias("event_id"), "content", "input_tokens",
                                             "output_tokens", "total_tokens", "model", "error")


@register("request_summary", "WITH " + _SQL_LOG + f""",
a AS (SELECT count(*) AS total_requests, count(*) FILTER (WHERE success) AS successful,
        coalesce(avg(latency_ms) FILTER (WHERE success), 0.0) AS avg_latency_ms,
        CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
        CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
        CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens_reported,
        arg_min(substr(content, 1, 80), (ts, seq)) FILTER (WHERE success) AS sample_response,
        arg_min(error, (ts, seq)) FILTER (WHERE NOT success) AS sample_error
      FROM lg)
SELECT total_requests, successful, avg_latency_ms, input_tokens, output_tokens, total_tokens_reported,
       sample_response, sample_error, total_requests - successful AS failed,
       successful::DOUBLE / total_requests * 100.0 AS success_rate,
       100.0 - successful::DOUBLE / total_requests * 100.0 AS failure_rate,
       input_tokens / 1000.0 * {GPT4[0]}::DOUBLE AS input_cost,
       output_tokens / 1000.0 * {GPT4[1]}::DOUBLE AS output_cost,
       input_tokens / 1000.0 * {GPT4[0]}::DOUBLE + output_tokens / 1000.0 * {GPT4[1]}::DOUBLE AS total_cost
FROM a""")
def request_summary(spark, sf_dir):
    return rq.summary(request_log(spark, sf_dir), *GPT4)


@register("latency_percentiles", "WITH " + _SQL_LOG + """,
s AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS n
      FROM lg WHERE success)
SELECT max(CASE WHEN i = n // 2 THEN latency_ms END) AS p50_ms,
       max(CASE WHEN i = least(CAST(ceil(n * 0.95) AS BIGINT), n - 1) THEN latency_ms END) AS p95_ms,
       max(n) AS n_successful
FROM s""")
def latency_percentiles(spark, sf_dir):
    return rq.latency_percentiles(request_log(spark, sf_dir))


# ------------------------------------------------------------------ judge

def judge_responses(spark, sf_dir):
    """Judge answers rendered from events in five shapes: fenced JSON, bare
    JSON with out-of-range scores, labelled text missing two metrics, JSON
    missing one metric (quoted-key fallback) and an answer with no score."""
    ev = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    s1, s2, s3 = k, F.pmod(F.col("value").cast("int"), F.lit(101)), F.pmod(F.col("user_id"), F.lit(101))
    s4, s5 = F.pmod(k + F.col("user_id"), F.lit(101)), F.pmod(F.col("event_id"), F.lit(101))
    js = F.format_string('{"output_equivalence": %d, "instruction_compliance": %d, '
                         '"information_completeness": %d, "quality_preservation": %d, '
                         '"overall_fidelity": %d, "justification": "event %d", "key_differences": ["%s"]}',
                         s1, s2, s3, s4, s5, "event_id", "event_type")
    resp = (F.when(F.col("event_type") == "click", F.concat(F.lit("Here you go:\n```json\n"), js, F.lit("\n```")))
            .when(F.col("event_type") == "view", F.format_string(
                '{"output_equivalence": %d, "instruction_compliance": %d, "information_completeness": %d, '
                '"quality_preservation": %d, "overall_fidelity": %d}', s1 + 50, s2 - 50, s3, s4, s5))
            .when(F.col("event_type") == "signup", F.format_string(
                "Output Equivalence: %d / Instruction Compliance: %d / Overall Fidelity: %d.5", s1, s2, s5))
            .when(F.col("event_type") == "purchase", F.format_string(
                '{"output_equivalence": %d, "instruction_compliance": %d, "information_completeness": %d, '
                '"quality_preservation": %d}', s1, s2, s3, s4))
            .otherwise(F.lit("The judge could not decide.")))
    model = F.element_at(F.array(*[F.lit(m) for m in JUDGE_MODELS]),
                         F.pmod(F.col("user_id"), F.lit(len(JUDGE_MODELS))).cast("int") + 1)
    return ev.select("event_id", resp.alias("response"), model.alias("judge_model"),
                     (k * 10).cast("long").alias("input_tokens"))



@register("judge_parse", """
WITH e AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                  CAST(trunc(value) AS INTEGER) % 101 AS s2, user_id % 101 AS s3,
                  (CAST(json_extract_string(props, '$.k') AS INTEGER) + user_id) % 101 AS s4,
                  event_id % 101 AS s5 FROM events),
v AS (SELECT event_id, event_type, k AS s1, s2, s3, s4, s5,
        ['""" + "', '".join(JUDGE_MODELS) + """'][(user_id % """ + str(len(JUDGE_MODELS)) + """) + 1] AS m,
        CAST(k * 10 AS BIGINT) AS input_tokens FROM e),
r AS (SELECT *, CASE event_type
        WHEN 'click' THEN 'Here you go:' || chr(10) || '```json' || chr(10) || '{"output_equivalence": ' || s1
          || ', "instruction_compliance": ' || s2 || ', "information_completeness": ' || s3
          || ', "quality_preservation": ' || s4 || ', "overall_fidelity": ' || s5 || ', "justification": "event '
          || event_id || '", "key_differences": ["' || event_type || '"]}' || chr(10) || '```'
        WHEN 'view' THEN '{"output_equivalence": ' || (s1 + 50) || ', "instruction_compliance": ' || (s2 - 50)
          || ', "information_completeness": ' || s3 || ', "quality_preservation": ' || s4
          || ', "overall_fidelity": ' || s5 || '}'
        WHEN 'signup' THEN 'Output Equivalence: ' || s1 || ' / Instruction Compliance: ' || s2
          || ' / Overall Fidelity: ' || s5 || '.5'
        WHEN 'purchase' THEN '{"output_equivalence": ' || s1 || ', "instruction_compliance": ' || s2
          || ', "information_completeness": ' || s3 || ', "quality_preservation": ' || s4 || '}'
        ELSE 'The judge could not decide.' END AS response FROM v),
j AS (SELECT *, CASE WHEN contains(response, '```json')
                  THEN trim(split_part(split_part(response, '```json', 2), '```', 1), ' ' || chr(10))
                  ELSE trim(response, ' ' || chr(10)) END AS body0 FROM r),
j2 AS (SELECT *, CASE WHEN json_valid(body0) AND starts_with(body0, '{') THEN body0 ELSE '{}' END AS body FROM j),
p AS (SELECT *, coalesce(json_type(body, '$.output_equivalence') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
          AND json_type(body, '$.instruction_compliance') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
          AND json_type(body, '$.information_completeness') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
          AND json_type(body, '$.quality_preservation') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
          AND json_type(body, '$.overall_fidelity') IN ('UBIGINT', 'BIGINT', 'DOUBLE'), false) AS json_ok,
        regexp_extract_all(response, '""" + jg.TEXT_PATTERNS[0].replace("'", "''") + """', 1) AS n1,
        regexp_extract_all(response, '""" + jg.TEXT_PATTERNS[0].replace("'", "''") + """', 2) AS v1,
        regexp_extract_all(response, '""" + jg.TEXT_PATTERNS[1].replace("'", "''") + """', 1) AS n2,
        regexp_extract_all(response, '""" + jg.TEXT_PATTERNS[1].replace("'", "''") + """', 2) AS v2
      FROM j2),
t AS (SELECT *, CASE WHEN len(n1) > 0 THEN list_zip(n1, v1) ELSE list_zip(n2, v2) END AS pairs FROM p),
sc AS (SELECT *, """ + ", ".join(
    f"coalesce(least(greatest(CAST(list_last(list_filter(pairs, lambda x: contains(lower(x[1]), '{a}') "
    f"AND contains(lower(x[1]), '{b}')))[2] AS DOUBLE), 0.0), 100.0), 0.0) AS t_{a}"
    for a, b in (m.split("_") for m in jg.METRICS)) + """ FROM t),
f AS (SELECT *, (""" + " + ".join(f"t_{m.split('_')[0]}" for m in jg.METRICS) + """) / 5.0 AS avg5 FROM sc)
SELECT event_id,
  CASE WHEN contains(m, '/') THEN m WHEN lower(m) = 'gpt-4' THEN 'openai/gpt-4'
       WHEN lower(m) = 'claude-3-opus' THEN 'anthropic/claude-3-opus'
       WHEN lower(m) = 'gpt-3.5-turbo' THEN 'openai/gpt-3.5-turbo'
       WHEN contains(lower(m), 'claude') THEN 'anthropic/' || m ELSE 'openai/' || m END AS judge_model,
""" + ",\n".join(
    f"  CASE WHEN json_ok THEN least(greatest(CAST(json_extract(body, '$.{m}') AS DOUBLE), 0.0), 100.0) "
    f"WHEN len(pairs) > 0 THEN (CASE WHEN t_{m.split('_')[0]} = 0.0 THEN avg5 ELSE t_{m.split('_')[0]} END) END AS {m}"
    for m in jg.METRICS) + """,
  CASE WHEN json_ok THEN 'json' WHEN len(pairs) > 0 THEN 'text' END AS source,
  CASE WHEN NOT json_ok AND len(pairs) = 0 THEN 'Could not parse judge response: no scores found' END AS error,
  input_tokens::DOUBLE / 1000.0 * (CASE WHEN contains(jm, 'gpt-4') THEN 0.03 WHEN contains(jm, 'gpt-3.5') THEN 0.0015
      WHEN contains(jm, 'claude-3-opus') THEN 0.015 WHEN contains(jm, 'claude-3-sonnet') THEN 0.003
      WHEN contains(jm, 'claude-3-haiku') THEN 0.00025 ELSE 0.001 END)::DOUBLE
  + CAST(ceil(length(response)::DOUBLE / 4.0) AS BIGINT)::DOUBLE / 1000.0 * (CASE WHEN contains(jm, 'gpt-4') THEN 0.06
      WHEN contains(jm, 'gpt-3.5') THEN 0.002 WHEN contains(jm, 'claude-3-opus') THEN 0.075
      WHEN contains(jm, 'claude-3-sonnet') THEN 0.015 WHEN contains(jm, 'claude-3-haiku') THEN 0.00125
      ELSE 0.002 END)::DOUBLE AS cost
FROM (SELECT *, CASE WHEN contains(m, '/') THEN m WHEN lower(m) = 'gpt-4' THEN 'openai/gpt-4'
       WHEN lower(m) = 'claude-3-opus' THEN 'anthropic/claude-3-opus'
       WHEN lower(m) = 'gpt-3.5-turbo' THEN 'openai/gpt-3.5-turbo'
       WHEN contains(lower(m), 'claude') THEN 'anthropic/' || m ELSE 'openai/' || m END AS jm FROM f)""")
def judge_parse(spark, sf_dir):
    j = judge_responses(spark, sf_dir)
    p = jg.parse_response("response")
    out = j.select("event_id", jg.normalize_model_name("judge_model").alias("judge_model"),
                   "input_tokens", approx4(F.col("response")).alias("output_tokens"), p.alias("p"))
    cols = [F.col(f"p.{m}").alias(m) for m in jg.METRICS]
    return out.select("event_id", "judge_model", *cols, F.col("p.source").alias("source"),
                      F.col("p.error").alias("error"),
                      jg.judge_cost("input_tokens", "output_tokens", "judge_model").alias("cost"))


def _sql_prompt(a: str, b: str, c: str, d: str) -> str:
    tpl = jg.PROMPT_TEMPLATE.replace("{{", "{").replace("}}", "}")
    out = []
    for i, e in enumerate((a, b, c, d)):
        head, tpl = tpl.split("{%d}" % i, 1)
        out += ["'" + head.replace("'", "''") + "'", e]
    out.append("'" + tpl.replace("'", "''") + "'")
    return " || ".join(out)


def _judge_inputs_sql():
    from .compress_plans import SQL_COMPRESS
    from .text_plans import sql_sentences
    p = _sql_prompt("text", "first_original", "task", "first_compressed")

    def first(column: str) -> str:
        return (f"(WITH src AS (SELECT doc_id, {column} AS text FROM z), {sql_sentences('src')} "
                "SELECT doc_id, coalesce(sents[1], '') AS first FROM s)")

    return ("WITH " + SQL_COMPRESS + f""",
j AS (SELECT z.doc_id, z.text, z.task, a.first AS first_original, b.first AS first_compressed
      FROM z JOIN {first('text')} a ON a.doc_id = z.doc_id JOIN {first('task')} b ON b.doc_id = z.doc_id)
SELECT doc_id, CAST(ceil(length({p})::DOUBLE / 4.0) AS BIGINT) AS prompt_tokens,
       CAST(length({p}) AS BIGINT) AS prompt_chars FROM j""")


@register("judge_inputs", _judge_inputs_sql())
def judge_inputs(spark, sf_dir):
    """Judge prompts for every document against its compression (the
    two model outputs are stood in by the texts' first sentences)."""
    from ..operators.extract import sentences
    from .compress_plans import compressed_documents

    def first(text):
        return F.coalesce(F.get(sentences(text), F.lit(0)), F.lit(""))

    c = compressed_documents(spark, sf_dir).select("doc_id", "text", "task")
    c = c.withColumn("first_original", first("text")).withColumn("first_compressed", first("task"))
    prompt = jg.evaluation_prompt("text", "first_original", "task", "first_compressed")
    return c.select("doc_id", approx4(prompt).alias("prompt_tokens"),
                    F.char_length(prompt).cast("long").alias("prompt_chars"))


def _model_routing_sql():
    from .library_plans import MODEL_CYCLE
    names = ", ".join(f"('{m}')" for m in sorted(set(MODEL_CYCLE + JUDGE_MODELS)))
    mapping = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in jg.MODEL_NAMES.items())
    return f"""
WITH n AS (SELECT * FROM (VALUES {names}) AS t(model)),
b AS (SELECT model, string_split(model, '/')[-1] AS base FROM n),
r AS (SELECT model, CASE WHEN base IN ('gpt-4-turbo', 'gpt-4-turbo-preview') THEN 'gpt-4-turbo-preview'
                         ELSE base END AS resolved FROM b)
SELECT model, resolved,
       CASE WHEN starts_with(resolved, 'gpt-') OR starts_with(resolved, 'text-') THEN 'openai'
            WHEN starts_with(resolved, 'gemini-') THEN 'gemini' END AS tokenizer,
       CASE WHEN contains(model, '/') THEN model
            ELSE coalesce(CASE lower(model) {mapping} END,
                          CASE WHEN contains(lower(model), 'claude') THEN 'anthropic/' || model
                               ELSE 'openai/' || model END) END AS judge_name
FROM r"""


@register("model_routing", _model_routing_sql())
def model_routing(spark, sf_dir):
    """P3 + P4 over the judge and prompt model names seen in the data."""
    from ..operators.pricing import resolve_alias, tokenizer_family
    from .library_plans import MODEL_CYCLE
    names = spark.createDataFrame([(m,) for m in sorted(set(MODEL_CYCLE + JUDGE_MODELS))], "model string")
    j = judge_responses(spark, sf_dir).select(F.col("judge_model").alias("model")).distinct()
    allm = names.unionByName(j).distinct()
    return allm.select("model", resolve_alias("model").alias("resolved"),
                       tokenizer_family("model").alias("tokenizer"),
                       jg.normalize_model_name("model").alias("judge_name"))
