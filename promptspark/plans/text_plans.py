"""Plans for the text scalars (build step 2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize_text, word_count
from ..functions.tokens import approx4
from ..operators import extract as ex
from ..operators import text_ops as tx
from ..sources.tables import table
from . import register
from .sqlsnip import norm_text, tok

# A rule set that fires on this corpus (the reference's keywords never occur
# in the generated prose): same shape, words that do occur.
DATA_RULES = ex.RuleSet(rules=(
    ex.Rule(2.0, (("the",), ("und",))),
    ex.Rule(1.5, (("and", "for"),)),
    ex.Rule(1.0, (("de",), ("la",))),
))

# ----------------------------------------------------------------- oracle

_WS = "' ' || chr(10) || chr(9) || chr(13)"

# P13 in DuckDB list functions (independent formulation: the punctuation
# fallback extracts pieces instead of splitting on look-arounds).
def sql_sentences(src: str = "documents") -> str:
    """CTEs l..x over a relation with (doc_id, text)."""
    return _SQL_SENTENCES_TMPL.replace("__SRC__", src)


_SQL_SENTENCES_TMPL = f"""
l AS (
  SELECT doc_id, text,
         list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_WS})),
                     lambda x: x <> '') AS ls
  FROM __SRC__),
u AS (
  SELECT doc_id, text,
    CASE WHEN len(ls) = 0 THEN []::VARCHAR[] ELSE string_split(array_to_string(
      list_transform(ls, lambda x, i: CASE WHEN i = 1 THEN x WHEN regexp_matches(x, '[.!?]$')
        OR regexp_matches(x, '^[-*•]') OR strlen(x) > 20 THEN chr(10) || x ELSE ' ' || x END),
      ''), chr(10)) END AS units,
    (length(text) - length(replace(text, '.', ''))) // 3 AS dots3
  FROM l),
f AS (
  SELECT doc_id, CASE WHEN len(units) < dots3 THEN list_filter(list_transform(
      regexp_extract_all(regexp_replace(text, '([.!?])[^\\s]$', '\\1'), '(?s)(.*?[.!?]\\s|.+)'),
      lambda p: trim(p, {_WS})), lambda p: strlen(p) > 5)
    ELSE units END AS chosen
  FROM u),
s AS (
  SELECT doc_id, list_filter(list_transform(chosen, lambda x: trim(x, {_WS})),
         lambda x: strlen(x) > 3 AND NOT regexp_full_match(x, '[\\s.]+')) AS sents
  FROM f),
x AS (
  SELECT doc_id, len(sents) AS n, unnest(sents) AS sentence,
         unnest(range(len(sents))) AS idx FROM s)"""
SQL_SENTENCES = sql_sentences()


def _sql_words(e: str) -> str:
    return f"len(list_filter(string_split_regex({e}, '\\s+'), lambda w: w <> ''))"


def _sql_score(e: str, rules) -> str:
    low = f"lower({e})"
    parts = [f"CASE WHEN {_sql_words(e)} BETWEEN {rules.length_words[0]} AND "
             f"{rules.length_words[1]} THEN {rules.length_bonus} ELSE 0.0 END"]
    for r in rules.rules:
        alts = " OR ".join("(" + " AND ".join(f"contains({low}, '{k}')" for k in alt) + ")"
                           for alt in r.any_of)
        parts.append(f"CASE WHEN {alts} THEN {r.weight} ELSE 0.0 END")
    return "(" + " + ".join(parts) + f" + {rules.base})::DOUBLE"


def _sql_density(e: str) -> str:
    w = f"list_filter(string_split_regex({e}, '\\s+'), lambda w: w <> '')"
    return (f"least(len(list_distinct({w}))::DOUBLE / greatest(len({w}), 1) * 0.5 "
            f"+ least(len({w}), 30)::DOUBLE / 30.0 * 0.5, 1.0)")


# ------------------------------------------------------------------ plans

@register("text_normalize", f"""
SELECT doc_id, {norm_text('text')} AS normalized,
       CAST({_sql_words('text')} AS INTEGER) AS words FROM documents""")
def text_normalize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    return docs.select("doc_id", normalize_text("text").alias("normalized"),
                       word_count("text").alias("words"))


@register("format_profile", """
SELECT kind, fmt, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'documents' AS kind, CASE WHEN regexp_matches(ltrim(text), '^[\\[{]') THEN 'json'
         ELSE 'text' END AS fmt FROM documents
  UNION ALL
  SELECT 'pages', CASE WHEN regexp_matches(ltrim(html), '^[\\[{]') THEN 'json' ELSE 'text' END
  FROM pages
  UNION ALL
  SELECT 'conversation_json', CASE WHEN regexp_matches(ltrim(j), '^[\\[{]') THEN 'json'
         ELSE 'text' END
  FROM (SELECT to_json(list({'role': role, 'content': text} ORDER BY turn))::VARCHAR AS j
        FROM conversations GROUP BY conv_id))
GROUP BY kind, fmt""")
def format_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "text", busy=True).select(
        F.lit("documents").alias("kind"), tx.detect_format("text").alias("fmt"))
    pages = table(spark, sf_dir, "pages", "html", busy=True).select(
        F.lit("pages").alias("kind"), tx.detect_format("html").alias("fmt"))
    conv = _conversation_json(spark, sf_dir).select(
        F.lit("conversation_json").alias("kind"), tx.detect_format("j").alias("fmt"))
    return docs.unionByName(pages).unionByName(conv).groupBy("kind", "fmt") \
        .agg(F.count(F.lit(1)).alias("n"))


def _conversation_json(spark, sf_dir):
    """Each conversation serialised as a chat-JSON document (one group per
    conversation; a conversation is one prompt, bounded by its turns)."""
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text", busy=True)
    return conv.groupBy("conv_id").agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
        lambda m: F.struct(m.role.alias("role"), m.text.alias("content")))).alias("j"))


@register("chat_json_roundtrip", """
SELECT 'conversation' AS kind, conv_id AS id,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos,
       role, CAST(length(text) AS BIGINT) AS n_chars
FROM conversations
UNION ALL
SELECT 'document', doc_id, 0, 'user', CAST(length(text) AS BIGINT) FROM documents""")
def chat_json_roundtrip(spark, sf_dir):
    conv = _conversation_json(spark, sf_dir).select(
        F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), F.col("j").alias("raw"))
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True).select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("raw"))
    both = conv.unionByName(docs)
    msgs = both.select("kind", "id", F.posexplode(tx.parse_messages("raw")).alias("pos", "m"))
    return msgs.select("kind", "id", F.col("pos").cast("int").alias("pos"),
                       F.col("m.role").alias("role"),
                       F.char_length("m.content").cast("long").alias("n_chars"))


@register("strip_markup", f"""
WITH s AS (
  SELECT page_id, html,
    replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>?|>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&apos;', '''') AS plain
  FROM pages)
SELECT page_id, plain, CAST(greatest(strlen(html) - strlen(plain), 0) AS BIGINT) AS chars_saved,
       CAST(greatest(strlen(html) - strlen(plain), 0) // 4 AS BIGINT) AS tokens_saved,
       {tok('plain')} AS tokens
FROM s""")
def strip_markup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "html", busy=True)
    s = pages.withColumn("plain", tx.strip_markup("html"))
    saved = tx.chars_saved("html", "plain").cast("long")
    return s.select("page_id", "plain", saved.alias("chars_saved"),
                    F.floor(saved / 4).cast("long").alias("tokens_saved"),
                    approx4(F.col("plain")).alias("tokens"))


def _sentence_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    return ex.sentence_table(docs, rules=(ex.REFERENCE_RULES, DATA_RULES))


@register("sentences", f"""
WITH {SQL_SENTENCES}
SELECT doc_id, CAST(idx AS INTEGER) AS idx, sentence, {tok('sentence')} AS tokens,
       CAST({_sql_words('sentence')} AS INTEGER) AS words FROM x""")
def sentences(spark, sf_dir):
    return _sentence_rows(spark, sf_dir).select("doc_id", "idx", "sentence", "tokens", "words")


@register("sentence_scores", f"""
WITH {SQL_SENTENCES}
SELECT doc_id, CAST(idx AS INTEGER) AS idx, {_sql_score('sentence', ex.REFERENCE_RULES)} AS score_ref,
       {_sql_score('sentence', DATA_RULES)} AS score_data, {_sql_density('sentence')} AS density
FROM x""")
def sentence_scores(spark, sf_dir):
    return _sentence_rows(spark, sf_dir).select(
        "doc_id", "idx", F.col("score_0").alias("score_ref"), F.col("score_1").alias("score_data"),
        "density")


@register("sentence_context", """
WITH """ + SQL_SENTENCES + """
SELECT doc_id, CAST(i AS INTEGER) AS idx,
       CAST(least(i + 2, len(sents) - 1) - greatest(i - 2, 0) + 1 AS INTEGER) AS n_context,
       array_to_string(list_slice(sents, greatest(i - 2, 0) + 1, least(i + 3, len(sents))), chr(10)) AS context
FROM (SELECT doc_id, sents, unnest(range(len(sents))) AS i FROM s)""")
def sentence_context(spark, sf_dir):
    """Every sentence's window of five with its text."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    staged = docs.select("doc_id", ex.sentences("text").alias("s"))
    windows = staged.select("doc_id", F.posexplode_outer(ex.context_window("s")).alias("idx", "w")).where(F.col("w").isNotNull())
    return windows.select("doc_id", F.col("idx").cast("int").alias("idx"), F.size("w").alias("n_context"),
                          F.array_join("w", "\n").alias("context"))


@register("pattern_candidates", f"""
WITH p AS (
  SELECT doc_id, 0 AS kind, unnest(string_split(text, chr(10) || chr(10))) AS raw,
         unnest(range(len(string_split(text, chr(10) || chr(10))))) AS i FROM documents
  UNION ALL
  SELECT doc_id, 1 AS kind, unnest(string_split(text, '.')) AS raw,
         unnest(range(len(string_split(text, '.')))) AS i FROM documents),
q AS (SELECT doc_id, kind, i, trim(raw, {_WS}) AS content FROM p WHERE trim(raw, {_WS}) <> ''),
r AS (SELECT *, {norm_text('content')} AS normalized FROM q)
SELECT doc_id, kind, CAST(i AS INTEGER) AS i, content, normalized,
  CASE WHEN contains(lower(content), 'you are') OR contains(lower(content), 'your role')
         OR contains(lower(content), 'expert') THEN 'role'
       WHEN contains(lower(content), 'example') OR contains(lower(content), 'instance')
         OR contains(lower(content), 'e.g.') THEN 'examples'
       WHEN contains(lower(content), 'must') OR contains(lower(content), 'should not')
         OR contains(lower(content), 'constraint') THEN 'constraints'
       ELSE 'general' END AS category
FROM r WHERE (kind = 0 AND {_sql_words('normalized')} >= 10)
          OR (kind = 1 AND {_sql_words('normalized')} BETWEEN 5 AND 50)""")
def pattern_candidates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    c = tx.candidates(docs)
    return c.select("doc_id", "kind", F.col("i").cast("int").alias("i"), "content", "normalized",
                    "category")


# Phrases for the repetition scan: the reference's list plus words that do
# repeat in this corpus.
DATA_PHRASES = ["the ", "and ", " de ", "ung"]


@register("repeated_phrases", """
WITH ph AS (SELECT unnest([""" + ", ".join(
    "'" + p.replace("'", "''") + "'" for p in tx.COMMON_PHRASES + DATA_PHRASES) + """]) AS phrase)
SELECT doc_id, phrase, CAST(((length(text) - length(replace(text, phrase, ''))) / length(phrase))
       AS INTEGER) AS occurrences
FROM documents CROSS JOIN ph
WHERE (length(text) - length(replace(text, phrase, ''))) / length(phrase) >= 3""")
def repeated_phrases(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    return tx.repeated_phrases(docs, tx.COMMON_PHRASES + DATA_PHRASES)


def _phrase_consolidation_sql() -> str:
    steps = ["s0 AS (SELECT doc_id, text, replace(text, '[REF:', '[REF::') AS t, 0 AS n FROM documents)"]
    for k, p in enumerate(tx.COMMON_PHRASES + DATA_PHRASES):
        q = p.replace("'", "''")
        many = f"(length(t) - length(replace(t, '{q}', ''))) // {len(p)} >= 3"
        steps.append(f"s{k + 1} AS (SELECT doc_id, text, CASE WHEN {many} THEN replace(t, '{q}', '[REF:{tx.REF_KEY % k}]') "
                     f"ELSE t END AS t, n + CASE WHEN {many} THEN 1 ELSE 0 END AS n FROM s{k})")
    return ("WITH " + ",\n".join(steps) + f"""
SELECT doc_id, CAST(n AS INTEGER) AS n_phrases, t AS consolidated, text IS NOT NULL AS restored
FROM s{len(steps) - 1} WHERE n > 0""")


@register("phrase_consolidation", _phrase_consolidation_sql())
def phrase_consolidation(spark, sf_dir):
    """P20: documents with repeated phrases, shortened by references; ``restored``:
    expansion gives the text back."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    found = docs.withColumn("c", tx.consolidate("text", tx.COMMON_PHRASES + DATA_PHRASES)).where(F.size("c.refs") > 0)
    return found.select("doc_id", F.size("c.refs").alias("n_phrases"), F.col("c.text").alias("consolidated"),
                        (tx.expand_phrases("c.text", "c.refs") == F.col("text")).alias("restored"))


# Prompt + page: a document's text followed by a page's markup, so the split
# point is the first markup line.
@register("instruction_payload_split", """
WITH c AS (SELECT coalesce(d.doc_id, p.page_id) AS doc_id,
                  coalesce(d.text, '') || chr(10) || coalesce(p.html, '') AS t
           FROM documents d FULL JOIN pages p ON d.doc_id = p.page_id),
l AS (SELECT doc_id, t, string_split(t, chr(10)) AS ls FROM c),
f AS (SELECT doc_id, t, ls, list_position(list_transform(ls, lambda x:
        (starts_with(ltrim(x), '<') AND contains(x, '>')) OR starts_with(ltrim(x), '<table')
        OR ((starts_with(ltrim(x), '{') OR starts_with(ltrim(x), '['))
            AND contains(x, '"content"') AND contains(x, '"page"'))), true) AS k FROM l)
SELECT doc_id,
  CAST(CASE WHEN strpos(t, '<Document>') > 0 THEN strpos(t, '<Document>') - 1
       WHEN k IS NOT NULL THEN list_sum(list_transform(list_slice(ls, 1, k - 1), lambda x: length(x) + 1))
       ELSE length(t) END AS BIGINT) AS instruction_chars,
  CAST(length(t) AS BIGINT) AS total_chars
FROM f""")
def instruction_payload_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    pages = table(spark, sf_dir, "pages", "page_id", "html", busy=True)
    c = docs.join(pages, docs.doc_id == pages.page_id, "full").select(
        F.coalesce("doc_id", "page_id").alias("doc_id"),
        F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.coalesce("html", F.lit(""))).alias("t"))
    head, _tail = tx.split_instructions("t")
    return c.select("doc_id", F.coalesce(F.char_length(head), F.lit(0)).cast("long")
                    .alias("instruction_chars"),
                    F.char_length("t").cast("long").alias("total_chars"))


def _fenced_documents(spark, sf_dir):
    """Markdown files built from documents: every line fenced as a block."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", busy=True)
    from ..functions.text import lines
    return docs.select("doc_id", F.array_join(F.transform(
        lines("text"), lambda l: F.concat(F.lit("```text\n"), l, F.lit("\n```"))), "\n")
        .alias("content"))


@register("harvest_prompts", f"""
WITH m AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
             lambda l: '```text' || chr(10) || l || chr(10) || '```'), chr(10)) AS content
           FROM documents),
h AS (SELECT doc_id, content,
        list_concat(
          list_filter(list_transform(regexp_extract_all(content,
            '(?s)```(?:python|text|markdown|json|yaml)?\\n(.*?)```', 1), lambda b: trim(b, {_WS})),
            lambda b: length(b) > 50),
          list_filter(list_transform(regexp_extract_all(content, '(?s)"(.*?)"', 1),
            lambda q: trim(q, {_WS})), lambda q: length(q) > 100)) AS hs
      FROM m)
SELECT doc_id, CAST(unnest(range(len(hs))) AS INTEGER) AS idx, unnest(hs) AS prompt
FROM h WHERE len(hs) > 1
UNION ALL
SELECT doc_id, NULL::INTEGER, content FROM h WHERE len(hs) <= 1""")
def harvest_prompts(spark, sf_dir):
    return tx.harvest_prompts(_fenced_documents(spark, sf_dir), "doc_id", "content") \
        .withColumn("idx", F.col("idx").cast("int"))


@register("structured_blocks")
def structured_blocks(spark, sf_dir):
    """P19 on a page bundle: the raw page, its text in a code fence and a
    page-JSON record (whole texts), one row per bracket / table / fence block."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html", busy=True)
    bundle = pages.select("page_id", F.concat_ws(
        "\n", "html", F.lit("```"), tx.strip_tags("html"), F.lit("```"),
        F.to_json(F.struct(F.col("url").alias("content"), F.col("page_id").alias("page")))).alias("t"))
    b = bundle.select("page_id", F.explode(tx.structured_blocks("t")).alias("b"))
    return b.select("page_id", "b.start", "b.end", "b.kind")
