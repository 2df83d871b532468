"""LLM-judge surface without calling a model.

Assembling the judge's input, parsing its answers, pricing the call and
averaging verdicts are all column expressions; the HTTP call itself is out of
scope (see README).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, let, utrim

# The five judged metrics, in report order.
METRICS = ["output_equivalence", "instruction_compliance", "information_completeness",
           "quality_preservation", "overall_fidelity"]

# Text-fallback patterns, tried in order; the first that finds
# any score is used.
TEXT_PATTERNS = [
    r"(?i)(output\s+equivalence|instruction\s+compliance|information\s+completeness|quality\s+preservation|overall\s+fidelity)[:\s]+(\d+(?:\.\d+)?)",
    r'(?i)("output_equivalence"|"instruction_compliance"|"information_completeness"|"quality_preservation"|"overall_fidelity")[:\s]+(\d+(?:\.\d+)?)',
    r"(?i)(output\s*equivalence|instruction\s*compliance|information\s*completeness|quality\s*preservation|overall\s*fidelity)[:\s=]+(\d+(?:\.\d+)?)",
]

# Judge price table by model-name substring (input, output per
# 1K), checked in order, and the fallback.
JUDGE_PRICES = [("gpt-4", 0.03, 0.06), ("gpt-3.5", 0.0015, 0.002), ("claude-3-opus", 0.015, 0.075),
                ("claude-3-sonnet", 0.003, 0.015), ("claude-3-haiku", 0.00025, 0.00125)]
JUDGE_DEFAULT_PRICE = (0.001, 0.002)

# Short model names and their provider/model form.
MODEL_NAMES = {
    "gpt-4": "openai/gpt-4", "gpt4": "openai/gpt-4",
    "gpt-4-turbo": "openai/gpt-4-turbo", "gpt4-turbo": "openai/gpt-4-turbo",
    "gpt-3.5-turbo": "openai/gpt-3.5-turbo", "gpt-3.5": "openai/gpt-3.5-turbo", "gpt35": "openai/gpt-3.5-turbo",
    "gpt-3.5-turbo-16k": "openai/gpt-3.5-turbo-16k",
    "claude-3-opus": "anthropic/claude-3-opus", "claude-opus": "anthropic/claude-3-opus",
    "claude-3-sonnet": "anthropic/claude-3-sonnet", "claude-sonnet": "anthropic/claude-3-sonnet",
    "claude-3-haiku": "anthropic/claude-3-haiku", "claude-haiku": "anthropic/claude-3-haiku",
    "claude-2": "anthropic/claude-2",
}

# The judge prompt template ({0}..{3} = original prompt, its
# output, expanded compressed prompt, its output).
PROMPT_TEMPLATE = """You are evaluating prompt compression quality by comparing outputs from original and compressed prompts.

Original Prompt:
{0}

Output from Original Prompt:
{1}

Compressed Prompt (expanded):
{2}

Output from Compressed Prompt:
{3}

Rate how well the compressed prompt preserves the original's behavior on a scale of 0-100 for:
1. Output Equivalence: Do both outputs convey the same meaning and information?
2. Instruction Compliance: Do both outputs follow the same instructions correctly?
3. Information Completeness: Does the compressed prompt's output contain all critical information from the original's output?
4. Quality Preservation: Is the quality of the compressed prompt's output equivalent to the original?
5. Overall Fidelity: Would the compressed prompt be acceptable as a replacement for the original?

CRITICAL: You MUST respond with ONLY valid JSON. Do not include markdown code blocks, explanations, or any other text. Return ONLY the JSON object below.

Required JSON format:
{{
  "output_equivalence": <0-100>,
  "instruction_compliance": <0-100>,
  "information_completeness": <0-100>,
  "quality_preservation": <0-100>,
  "overall_fidelity": <0-100>,
  "justification": "<brief explanation>",
  "key_differences": ["<difference 1>", "<difference 2>"]
}}

Example valid response:
{{"output_equivalence": 85, "instruction_compliance": 90, "information_completeness": 88, "quality_preservation": 87, "overall_fidelity": 88, "justification": "Outputs are equivalent", "key_differences": []}}

Remember: Return ONLY the JSON object, nothing else."""

# Rating thresholds.
RATINGS = [(90.0, "Excellent"), (75.0, "Good"), (60.0, "Fair"), (40.0, "Poor")]
ACCEPTABLE = 70.0


def normalize_model_name(model) -> Column:
    """provider/model form; names with '/' are kept."""
    m = col(model)
    low = F.lower(m)
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in MODEL_NAMES.items() for x in kv]), low)
    guess = F.when(low.contains("claude"), F.concat(F.lit("anthropic/"), m)).otherwise(F.concat(F.lit("openai/"), m))
    return F.when(m.contains("/"), m).otherwise(F.coalesce(mapped, guess))


def evaluation_prompt(original, original_output, compressed, compressed_output) -> Column:
    """The judge's input text (template pieces concatenated around the
    four columns, so nothing in the data is interpreted as a format)."""
    tpl = PROMPT_TEMPLATE.replace("{{", "{").replace("}}", "}")
    pieces = []
    for i, c in enumerate((original, original_output, compressed, compressed_output)):
        head, tpl = tpl.split("{%d}" % i, 1)
        pieces += [F.lit(head), col(c)]
    return F.concat(*pieces, F.lit(tpl))


def judge_cost(input_tokens, output_tokens, model) -> Column:
    """Price by the first matching model-name substring."""
    m = col(model)
    rin = rout = None
    for key, a, b in JUDGE_PRICES:
        rin = F.when(m.contains(key), F.lit(a)) if rin is None else rin.when(m.contains(key), F.lit(a))
        rout = F.when(m.contains(key), F.lit(b)) if rout is None else rout.when(m.contains(key), F.lit(b))
    rin = rin.otherwise(F.lit(JUDGE_DEFAULT_PRICE[0]))
    rout = rout.otherwise(F.lit(JUDGE_DEFAULT_PRICE[1]))
    return (col(input_tokens).cast("double") / 1000.0 * rin
            + col(output_tokens).cast("double") / 1000.0 * rout)


def _json_body(response: Column) -> Column:
    """Text inside the first ```json (else ```) fence, else the whole text."""
    def inside(tag):
        after = F.substring(response, F.locate(tag, response) + len(tag), F.char_length(response))
        closed = F.locate("```", after) > 0
        return F.when(closed, utrim(F.substring_index(after, "```", 1))).otherwise(utrim(response))
    return (F.when(response.contains("```json"), inside("```json"))
            .when(response.contains("```"), inside("```"))
            .otherwise(utrim(response)))


def _number_at(v: Column, key: str) -> Column:
    x = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(x).rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"),
                  F.try_variant_get(v, f"$.{key}", "double"))


def _string(v: Column, path: str) -> Column:
    """The JSON string at ``path``; null for anything that is not a string."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING",
                  F.try_variant_get(v, path, "string"))


def _clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))


def _text_scores(r: Column, pattern: str) -> Column:
    """struct<found, s>: matches of one fallback pattern and the last score
    per metric (0 when absent), clamped."""
    names = F.regexp_extract_all(r, F.lit(pattern), 1)
    vals = F.regexp_extract_all(r, F.lit(pattern), 2)

    def body(pairs):
        out = []
        for k in METRICS:
            a, b = k.split("_")
            last = F.try_element_at(F.filter(pairs, lambda p: p.n.contains(a) & p.n.contains(b)), F.lit(-1))
            out.append(F.coalesce(_clamp(last.v.cast("double")), F.lit(0.0)))
        return F.struct(F.size(pairs).alias("found"), F.array(*out).alias("s"))

    return let(F.arrays_zip(F.transform(names, lambda s: F.lower(s)).alias("n"), vals.alias("v")), body)


def parse_response(response) -> Column:
    """Struct of the five scores, justification, key_differences,
    source ('json' | 'text') and error.  JSON (fenced or bare) with all five
    numbers wins, clamped to 0-100; otherwise the first text pattern that
    finds a score, with missing (or zero) scores replaced by the mean of the
    five; no score at all is an error.  The parsed JSON and the chosen text
    scores are each bound once per row."""
    r = col(response)

    def from_json(v):
        nums = [_number_at(v, k) for k in METRICS]
        ok = v.isNotNull()
        for n in nums:
            ok = ok & n.isNotNull()
        return F.struct(ok.alias("ok"), F.array(*[_clamp(n) for n in nums]).alias("s"),
                        F.coalesce(_string(v, "$.justification"), F.lit("No justification provided")).alias("j"),
                        F.coalesce(F.filter(F.transform(F.try_variant_get(v, "$.key_differences", "array<variant>"),
                                                        lambda x: _string(x, "$")), lambda x: x.isNotNull()),
                                   F.array().cast("array<string>")).alias("d"))

    def first_found(t, rest):
        return let(t, lambda x: F.when(x.found > 0, x).otherwise(rest))

    chosen = None
    for p in reversed(TEXT_PATTERNS):
        t = _text_scores(r, p)
        chosen = t if chosen is None else first_found(t, chosen)

    def filled(t):
        avg = F.aggregate(t.s, F.lit(0.0), lambda a, x: a + x) / 5.0
        return F.struct(t.found.alias("found"), F.transform(t.s, lambda x: F.when(x == 0.0, avg).otherwise(x))
                        .alias("s"))

    def result(js, tx):
        fields = [F.when(js.ok, js.s[i]).when(tx.found > 0, tx.s[i]).alias(k) for i, k in enumerate(METRICS)]
        return F.struct(
            *fields,
            F.when(js.ok, js.j).when(tx.found > 0, F.lit("Parsed from text response (JSON parsing failed)"))
            .alias("justification"),
            F.when(js.ok, js.d).when(tx.found > 0, F.array().cast("array<string>")).alias("key_differences"),
            F.when(js.ok, F.lit("json")).when(tx.found > 0, F.lit("text")).alias("source"),
            F.when(~js.ok & (tx.found == 0), F.lit("Could not parse judge response: no scores found"))
            .alias("error"))

    return let(let(F.try_parse_json(_json_body(r)), from_json),
               lambda js: let(let(chosen, filled), lambda tx: result(js, tx)))


def rating(fidelity) -> Column:
    f = col(fidelity)
    expr = None
    for th, name in RATINGS:
        expr = F.when(f >= th, F.lit(name)) if expr is None else expr.when(f >= th, F.lit(name))
    return expr.otherwise(F.lit("Very Poor"))


def judge_summary(judged: DataFrame) -> DataFrame:
    """Mean overall fidelity and total cost of the parsed verdicts."""
    return judged.agg(F.avg("overall_fidelity").alias("avg_fidelity"),
                      F.sum("cost").alias("total_cost"),
                      F.count("overall_fidelity").alias("n_parsed"))
