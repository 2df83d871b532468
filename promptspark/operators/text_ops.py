"""Text operators over prompt columns (S4-S6, S12, P11, P12, P14, P15, P19,
P20, P21).  All are Catalyst expressions or narrow per-row array folds: no
Python in the hot path and no shuffle unless a function says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, let, lines, normalize_text, utrim, words

# ---------------------------------------------------------------- S4 format

# Extensions that decide the format before content sniffing.
MARKDOWN_EXT = ("md", "markdown")
YAML_EXT = ("yaml", "yml")
# Extensions picked up by the library scan.
PROMPT_EXTENSIONS = ("txt", "md", "json", "yaml", "yml", "prompt")


def looks_like_json(text) -> Column:
    return F.regexp_replace(col(text), r"^(?U)\s+", "").rlike(r"^[\[{]")


def detect_format(text, path=None) -> Column:
    """json / markdown / yaml / text.  Extension first (json only when the
    content also opens with a bracket), else sniff the content."""
    j = looks_like_json(text)
    sniff = F.when(j, F.lit("json")).otherwise(F.lit("text"))
    if path is None:
        return sniff
    ext = F.lower(F.regexp_extract(col(path), r"\.([^./]+)$", 1))
    return (F.when((ext == "json") & j, F.lit("json"))
            .when(ext.isin(*MARKDOWN_EXT), F.lit("markdown"))
            .when(ext.isin(*YAML_EXT), F.lit("yaml"))
            .otherwise(sniff))


# ------------------------------------------------------------- S5/S6 chat

MESSAGE = "struct<role:string,content:string>"


def _is_message(v: Column) -> Column:
    """Strict typing: ``role`` and ``content`` are JSON strings (a numeric
    content is a parse error, not a coerced string); other keys don't matter."""
    def string_at(path):
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.lit(False))

    return string_at("$.role") & string_at("$.content")


def parse_messages(text, fmt: Column | None = None) -> Column:
    """Chat JSON (array of {role, content}, or one such object) when the
    format says json and it parses strictly; otherwise one user message
    with the whole text.  YAML yields null (skipped)."""
    t = col(text)
    v = F.try_parse_json(t)
    is_arr = F.substring(F.schema_of_variant(v), 1, 6) == "ARRAY<"
    is_obj = F.substring(F.schema_of_variant(v), 1, 7) == "OBJECT<"
    as_arr = F.from_json(t, f"array<{MESSAGE}>")
    as_obj = F.array(F.from_json(t, MESSAGE))
    items = F.try_variant_get(v, "$", "array<variant>")
    json_msgs = F.when(is_arr & F.forall(items, _is_message), as_arr).when(is_obj & _is_message(v), as_obj)
    text_msgs = F.array(F.struct(F.lit("user").alias("role"), t.alias("content")))
    f = fmt if fmt is not None else detect_format(t)
    return (F.when(f == "yaml", F.lit(None).cast(f"array<{MESSAGE}>"))
            .when(f == "json", F.coalesce(json_msgs, text_msgs))
            .otherwise(text_msgs))


def explode_messages(df: DataFrame, id_col: str, messages: Column) -> DataFrame:
    """(id, pos, role, content) - narrow, no shuffle."""
    return (df.select(id_col, F.posexplode(messages).alias("pos", "m"))
            .select(id_col, F.col("pos").cast("int").alias("pos"),
                    F.col("m.role").alias("role"), F.col("m.content").alias("content")))


# -------------------------------------------------------------- P11 markup

# Entities decoded after tag removal, in this order.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")]


def strip_tags(html) -> Column:
    """Drop everything from '<' to the next '>' (or to the end), and stray
    '>' characters; then decode the five basic entities."""
    out = F.regexp_replace(col(html), r"<[^>]*>?|>", "")
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def strip_markdown_syntax(text) -> Column:
    """Markdown stage (rules, not a parser): headings, emphasis, strike,
    inline code, links/images and list markers lose their markup."""
    t = col(text)
    t = F.regexp_replace(t, r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", "")
    t = F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"(\*\*|__)(.+?)\1", "$2")
    t = F.regexp_replace(t, r"(?<![*\w])[*_](?!\s)(.+?)(?<!\s)[*_](?![*\w])", "$1")
    t = F.regexp_replace(t, r"~~(.+?)~~", "$1")
    t = F.regexp_replace(t, r"`([^`]*)`", "$1")
    t = F.regexp_replace(t, r"(?m)^[ \t]*(?:[-*+]|\d+\.)[ \t]+", "")
    return t


def strip_markup(text, markdown: bool = False) -> Column:
    t = strip_markdown_syntax(text) if markdown else col(text)
    return strip_tags(t)


def chars_saved(original, stripped) -> Column:
    return F.greatest(F.octet_length(col(original)) - F.octet_length(col(stripped)), F.lit(0))


# ---------------------------------------------------- P12 / W6 split point

_MARKUP_LINE = (r"(?m)^[^\S\n]*(?:<[^\n]*>|<table|"
                r"[{\[](?=[^\n]*\"content\")(?=[^\n]*\"page\"))")


def payload_start(text) -> Column:
    """1-based char position where the verbatim payload starts (after
    ``<Document>``, else at the first markup/table/page-JSON line);
    0 when the whole text is instructions."""
    t = col(text)
    doc = F.locate("<Document>", t)
    line = F.regexp_instr(t, F.lit(_MARKUP_LINE))
    return F.when(doc > 0, doc).when(line > 0, line).otherwise(F.lit(0))


def split_parts(text) -> Column:
    """struct<head, tail>: instructions and verbatim payload (split point
    computed once)."""
    t = col(text)
    return let(payload_start(t), lambda p: F.struct(
        F.when(p > 0, F.substring(t, F.lit(1), p - 1)).otherwise(t).alias("head"),
        F.when(p > 0, F.substring(t, p, F.char_length(t))).otherwise(F.lit("")).alias("tail")))


def split_instructions(text) -> tuple[Column, Column]:
    parts = split_parts(text)
    return parts.head, parts.tail


# ------------------------------------------------------------ S12 harvest

FENCE_RE = r"(?s)```(?:python|text|markdown|json|yaml)?\n(.*?)```"
QUOTE_RE = r"(?s)\"(.*?)\""
# The least length (characters, exclusive) of a harvested span;
# shorter ones are labels, not prompts.
FENCE_MIN, QUOTE_MIN = 50, 100


def harvested(content, fence_max: int | None = None, quote_max: int | None = None) -> Column:
    """Prompts found in a markdown file: fenced blocks then quoted spans, each
    stripped, over the least length and, if given, under the greatest."""
    def sized(x, low, high):
        n = F.char_length(x)
        return n > low if high is None else (n > low) & (n < high)

    c = col(content)
    blocks = F.filter(F.transform(F.regexp_extract_all(c, F.lit(FENCE_RE), 1), utrim),
                      lambda b: sized(b, FENCE_MIN, fence_max))
    quotes = F.filter(F.transform(F.regexp_extract_all(c, F.lit(QUOTE_RE), 1), utrim),
                      lambda q: sized(q, QUOTE_MIN, quote_max))
    return F.concat(blocks, quotes)


def harvest_prompts(files: DataFrame, id_col: str, content_col: str, *, per_file: int | None = None,
                    max_file_bytes: int | None = None, fence_max: int | None = None,
                    quote_max: int | None = None) -> DataFrame:
    """(id, idx, prompt): files with several prompts are split into them, files
    with 0 or 1 are kept whole (idx null).  All limits are off by default; the
    reference's own are 5 prompts a file, files up to 100,000 bytes, fenced
    blocks under 5000 and quoted spans under 3000 characters."""
    if max_file_bytes is not None:
        files = files.filter(F.octet_length(content_col) <= max_file_bytes)
    h = files.select(id_col, content_col, harvested(content_col, fence_max, quote_max).alias("_h"))
    many = h.filter(F.size("_h") > 1).select(
        id_col, F.posexplode("_h" if per_file is None else F.slice("_h", 1, per_file)).alias("idx", "prompt"))
    whole = h.filter(F.size("_h") <= 1).select(
        id_col, F.lit(None).cast("int").alias("idx"), F.col(content_col).alias("prompt"))
    return many.unionByName(whole)


# -------------------------------------------------- P14 / P15 candidates

# Category keywords, checked in this order.
CATEGORY_RULES = [
    ("role", ("you are", "your role", "expert")),
    ("examples", ("example", "instance", "e.g.")),
    ("constraints", ("must", "should not", "constraint")),
]
PARAGRAPH_MIN_WORDS = 10
SENTENCE_WORDS = (5, 50)


def categorize(content) -> Column:
    low = F.lower(col(content))
    expr = None
    for cat, kws in CATEGORY_RULES:
        cond = None
        for k in kws:
            c = low.contains(k)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
    return expr.otherwise(F.lit("general"))


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pattern candidates: paragraphs (``\\n\\n``, >= 10 words) then
    ``.``-pieces of 5-50 words.  One row per candidate with its order in the
    prompt (paragraphs first), content, normal form and category."""
    t = F.col(text_col)
    paras = df.select(id_col, F.posexplode_outer(F.split(t, "\n\n")).alias("i", "raw")) \
        .filter(utrim("raw") != "") \
        .select(id_col, F.lit(0).alias("kind"), "i", utrim("raw").alias("content"),
                normalize_text("raw").alias("normalized")) \
        .filter(F.size(words("normalized")) >= PARAGRAPH_MIN_WORDS)
    sents = df.select(id_col, F.posexplode_outer(F.split(t, r"\.")).alias("i", "raw")) \
        .select(id_col, F.lit(1).alias("kind"), "i", utrim("raw").alias("content")) \
        .filter(F.col("content") != "") \
        .withColumn("normalized", normalize_text("content")) \
        .filter(F.size(words("normalized")).between(*SENTENCE_WORDS))
    return paras.unionByName(sents).withColumn("category", categorize("content"))


# ---------------------------------------------------- P20 repeated phrases

# Phrases the reference consolidates when seen 3+ times.
COMMON_PHRASES = [
    "Extract Full Text Values:",
    "Normalize:",
    "Response Format:",
    "If you are unable to confidently identify and extract the value",
    "Provide this as your response to",
    "Use :: as the separator in your response",
]
MIN_REPEATS = 3


def occurrences(text, phrase) -> Column:
    """Non-overlapping occurrences of ``phrase`` in ``text``."""
    t, p = col(text), col(phrase)
    return F.floor((F.char_length(t) - F.char_length(F.replace(t, p, F.lit(""))))
                   / F.char_length(p)).cast("int")


def repeated_phrases(df: DataFrame, phrases: Sequence[str], id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(id, phrase, occurrences) for phrases seen at least 3 times, counted in
    the row: a text is read once, whatever the number of phrases."""
    found = F.filter(F.transform(F.array(*[F.lit(p) for p in phrases]), lambda p: F.struct(
        p.alias("phrase"), occurrences(text_col, p).alias("occurrences"))), lambda x: x.occurrences >= MIN_REPEATS)
    return df.select(id_col, F.inline(found))


REF_KEY = "PHRASE_%d"
_OPEN, _ESCAPED = "[REF:", "[REF::"


def consolidate(text, phrases: Sequence[str] = COMMON_PHRASES) -> Column:
    """P20: phrases that stand at least 3 times replaced by ``[REF:key]``, one after
    the other in the given order.  struct<text, refs array<struct<key, phrase,
    occurrences>>>; :func:`expand_phrases` is the exact inverse, as ``[REF:`` of the
    text itself is marked before."""
    if any(_OPEN in p or not p for p in phrases):
        raise ValueError(f"a phrase must not be empty or hold {_OPEN!r}")
    table = F.array(*[F.struct(F.lit(REF_KEY % k).alias("key"), F.lit(p).alias("phrase")) for k, p in enumerate(phrases)])
    none = F.array().cast("array<struct<key:string,phrase:string,occurrences:int>>")

    def step(acc, p):
        return let(occurrences(acc.text, p.phrase), lambda n: F.when(n >= MIN_REPEATS, F.struct(
            F.replace(acc.text, p.phrase, F.concat(F.lit(_OPEN), p.key, F.lit("]"))).alias("text"),
            F.concat(acc.refs, F.array(F.struct(p.key.alias("key"), p.phrase.alias("phrase"), n.alias("occurrences"))))
            .alias("refs"))).otherwise(acc))

    start = F.struct(F.replace(col(text), F.lit(_OPEN), F.lit(_ESCAPED)).alias("text"), none.alias("refs"))
    return F.aggregate(table, start, step) if phrases else start


def expand_phrases(text, refs) -> Column:
    """P20's inverse, also on a part of the text."""
    whole = F.aggregate(F.reverse(col(refs)), col(text), lambda t, r: F.replace(
        t, F.concat(F.lit(_OPEN), r.key, F.lit("]")), r.phrase))
    return F.replace(whole, F.lit(_ESCAPED), F.lit(_OPEN))


# ------------------------------------------------- P19 structured blocks

BLOCK_MIN_SPAN = 50
_BLOCKS = "array<struct<start:int,end:int,kind:string>>"


def bracket_blocks(text) -> Column:
    """Top-level ``{}``/``[]`` spans longer than 50 characters, as
    array<struct<start,end,kind>> (0-based, end exclusive).  One left fold over
    the bracket characters only; depth is clamped at 0 on a stray closer."""
    t = col(text)
    pieces = F.split(t, r"(?=[{}\[\]])")
    init = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("depth"), F.lit(-1).alias("start"),
                    F.array().cast(_BLOCKS).alias("blocks"))

    def step(acc, p):
        ch = F.substring(p, 1, 1)
        opening = ch.isin("{", "[")
        closing = ch.isin("}", "]")
        depth_after = F.when(opening, acc.depth + 1).when(closing, F.greatest(acc.depth - 1, F.lit(0))) \
            .otherwise(acc.depth)
        start_after = F.when(opening & (acc.depth == 0), acc.pos) \
            .when(closing & (depth_after == 0), F.lit(-1)).otherwise(acc.start)
        emit = closing & (acc.depth == 1) & (acc.start >= 0) & (acc.pos - acc.start > BLOCK_MIN_SPAN)
        blocks = F.when(emit, F.concat(acc.blocks, F.array(F.struct(
            acc.start.alias("start"), (acc.pos + 1).alias("end"), F.lit("json").alias("kind")))
        )).otherwise(acc.blocks)
        return F.struct((acc.pos + F.char_length(p)).alias("pos"), depth_after.alias("depth"),
                        start_after.alias("start"), blocks.alias("blocks"))

    return F.aggregate(pieces, init, step, lambda acc: acc.blocks)


def _occurrence_starts(text, literal: str) -> Column:
    """0-based char offsets of every occurrence of a regex-safe literal."""
    parts = F.split(col(text), literal)
    init = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))
    folded = F.aggregate(
        F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), init,
        lambda acc, p: F.struct((acc.pos + F.char_length(p) + len(literal)).alias("pos"),
                                F.concat(acc.out, F.array(acc.pos + F.char_length(p))).alias("out")))
    return folded.out


def table_blocks(text) -> Column:
    """``<table`` starts zipped with ``</table>`` ends (end past the tag)."""
    ends = F.transform(_occurrence_starts(text, "</table>"), lambda e: e + 8)
    pairs = F.arrays_zip(_occurrence_starts(text, "<table").alias("start"), ends.alias("end"))
    return F.transform(F.filter(pairs, lambda z: z.start.isNotNull() & z.end.isNotNull()),
                       lambda z: F.struct(z.start.alias("start"), z.end.alias("end"),
                                          F.lit("table").alias("kind")))


def fence_blocks(text) -> Column:
    """Code fences: consecutive pairs of lines whose trimmed text opens with
    ```; a block spans from the opening line start to the closing line end."""
    def body(ls):
        starts = F.aggregate(ls, F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out")),
                             lambda acc, l: F.struct((acc.pos + F.char_length(l) + 1).alias("pos"),
                                                     F.concat(acc.out, F.array(acc.pos)).alias("out"))).out
        spans = F.transform(F.arrays_zip(ls.alias("l"), starts.alias("s")), lambda z: F.struct(
            z.s.alias("start"), (z.s + F.char_length(z.l)).alias("end"),
            utrim(z.l).startswith("```").alias("fence")))
        return let(F.filter(spans, lambda x: x.fence), lambda f: F.transform(
            F.filter(F.sequence(F.lit(1), F.size(f)), lambda k: (k % 2 == 1) & (k < F.size(f))),
            lambda k: F.struct(F.element_at(f, k).start.alias("start"),
                               F.element_at(f, k + 1).end.alias("end"), F.lit("code").alias("kind"))))

    return let(lines(text), body)


def structured_blocks(text) -> Column:
    """Bracket, table and fence blocks sorted by start."""
    return F.array_sort(F.concat(bracket_blocks(text), table_blocks(text), fence_blocks(text)))


# Line openings that start a new section.
HEADER_PREFIXES = ("#", "Definition:", "Location:", "Extraction:", "Response Format:")


def is_header(line) -> Column:
    tl = utrim(line)
    cond = tl.endswith(":")
    for p in HEADER_PREFIXES:
        cond = cond | tl.startswith(p)
    return cond
