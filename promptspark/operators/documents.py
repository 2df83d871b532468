"""Directive documents as tables.

A document is a set of rows ``sections(doc_id, pos, kind, id, content,
items)`` - the tagged union flattened to a kind plus nullable columns.
Encoding and expansion are ordered per-document string aggregations (one
document is one prompt, so a group is bounded by a single prompt); parsing cuts a
document's lines at its directives within the row, without a shuffle (W5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, lines, utrim
from ..functions.tokens import TokenCounter, approx4

VERSION = "1.0"
# Section kinds and their roles.
REFERENCE_KINDS = ("ROLE", "EXAMPLES", "CONSTRAINTS", "GENERAL")  # GENERAL: deviation M16, patterns of no other category
MULTILINE_KINDS = REFERENCE_KINDS + ("TASK",)
ONE_LINE_KINDS = ("CONTEXT", "FOCUS", "STYLE", "FORMAT")
LIST_KINDS = ("FOCUS", "STYLE")
INLINE = "inline"
# Header, directive form, expansion prefixes and token overheads of
# the document format.
VERSION_RE = r"^@HIERATIC\s+(v?\d+\.\d+)"
DIRECTIVE_RE = r"^@([A-Z_]+)(\[([^\]]+)\])?:\s*(.*)$"
EXPAND_PREFIX = {"FOCUS": "Focus on: ", "STYLE": "Style: ", "FORMAT": "Format: "}
ITEM_TOKENS = 2          # focus / style items count two tokens each
FORMAT_OVERHEAD = 10


def section_schema() -> str:
    return "doc_id long, pos int, kind string, id string, content string, items array<string>"


# ------------------------------------------------------------- C6 encode

def section_text(kind: Column, sid: Column, content: Column, items: Column) -> Column:
    """One section as encoded text, including its trailing blank line."""
    ref = F.format_string("@%s[%s]\n", kind, sid)
    body = F.when(content.isNotNull(), F.concat(content, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(
        F.when(kind.isin(*REFERENCE_KINDS), F.concat(ref, body))
        .when(kind == "TASK", F.concat(F.lit("@TASK\n"), F.coalesce(content, F.lit("")), F.lit("\n")))
        .when(kind.isin(*LIST_KINDS), F.format_string("@%s: %s\n", kind, F.array_join(items, ", ")))
        .when(kind == "FORMAT", F.format_string("@FORMAT: %s\n", content))
        .when(kind == "CONTEXT", F.format_string("@CONTEXT: %s\n", content)),
        F.lit("\n"))


def encode(sections: DataFrame, context_path: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): header, optional ``@CONTEXT``, blank line, sections."""
    s = sections.select("doc_id", "pos", section_text(F.col("kind"), F.col("id"), F.col("content"),
                                                      F.col("items")).alias("t"))
    body = s.groupBy("doc_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x.t), "").alias("body"))
    header = F.lit(f"@HIERATIC v{VERSION}\n")
    if context_path is not None:
        body = body.join(context_path, "doc_id", "left")
        header = F.concat(header, F.when(F.col("context_path").isNotNull(),
                                         F.format_string("@CONTEXT: %s\n", "context_path"))
                          .otherwise(F.lit("")))
    return body.select("doc_id", F.concat(header, F.lit("\n"), "body").alias("text"))


# -------------------------------------------------------------- C7 parse

def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, pos, kind, id, content, items, error).

    Directive lines (trimmed, '@' but not '@ ') open sections; a multi-line
    section owns the following lines up to the next directive; lines after a
    one-line directive and before the first directive are ignored.  A bad
    header, an unknown directive or an unclosed bracket yields a row with
    ``error`` set (kind null)."""
    some = let(F.coalesce(lines(text_col), F.array().cast("array<string>")),
               lambda ls: F.when(F.size(ls) == 0, F.array(F.lit(""))).otherwise(ls))  # an empty document has a row

    def directive(t: Column) -> Column:
        return t.startswith("@") & ~t.startswith("@ ")

    def cut(ls, ts) -> Column:
        """One pass: the places of the directives, and the lines between them."""
        places = F.filter(F.transform(ts, lambda t, i: F.when((i > 0) & directive(t), i)), lambda i: i.isNotNull())
        return let(places, lambda at: F.transform(at, lambda p, k: F.struct(
            (k + 1).alias("sec"), F.get(ts, p).alias("head"), F.array_join(F.slice(
                ls, p + 2, F.coalesce(F.get(at, k + 1), F.size(ls)) - p - 1), "\n").alias("body"))))

    whole = let(some, lambda ls: let(F.transform(ls, utrim), lambda ts: F.struct(
        F.regexp_extract(F.get(ts, F.lit(0)), VERSION_RE, 1).alias("v"), cut(ls, ts).alias("sections"))))
    sec = docs.select(F.col(id_col).alias("doc_id"), whole.alias("d")) \
        .select("doc_id", F.when(F.col("d.v") != "", F.regexp_replace("d.v", "^v+", "")).alias("version"),
                F.explode_outer("d.sections").alias("x")) \
        .select("doc_id", "version", "x.sec", "x.head", "x.body")
    name1 = F.regexp_extract("head", DIRECTIVE_RE, 1)
    value = utrim(F.regexp_extract("head", DIRECTIVE_RE, 4))
    one_line = F.col("head").rlike(DIRECTIVE_RE) & name1.isin(*ONE_LINE_KINDS)
    has_br = F.instr("head", "[") > 0
    closed = F.instr("head", "]") > 0
    mname = F.when(has_br, F.expr("substring(head, 2, instr(head, '[') - 2)")) \
        .otherwise(utrim(F.regexp_replace("head", "^@+", "")))
    mid = F.when(has_br & closed, F.expr("substring(head, instr(head, '[') + 1, "
                                         "instr(head, ']') - instr(head, '[') - 1)"))
    body_text = utrim("body")
    kind = F.when(one_line, name1).when(mname.isin(*MULTILINE_KINDS) & (~has_br | closed), mname)
    error = (F.when(one_line, F.lit(None))
             .when(has_br & ~closed, F.lit("Unclosed bracket in directive"))
             .when(~mname.isin(*MULTILINE_KINDS), F.concat(F.lit("Unknown directive: "), mname)))
    items = F.when(one_line & name1.isin(*LIST_KINDS), F.filter(
        F.transform(F.split(value, ","), lambda x: utrim(x)), lambda x: x != ""))
    cont = (F.when(one_line & name1.isin("FORMAT", "CONTEXT"), value)
            .when(mname == "TASK", body_text)
            .when(mname.isin(*REFERENCE_KINDS), F.when(body_text == "", F.lit(None)).otherwise(body_text)))
    sid = F.when(mname.isin(*REFERENCE_KINDS), F.coalesce(mid, F.lit(INLINE)))
    return sec.select("doc_id", "version", F.col("sec").cast("int").alias("pos"), kind.alias("kind"), sid.alias("id"),
                      cont.alias("content"), items.alias("items"), error.alias("error"))


def sections_of(parsed: DataFrame) -> DataFrame:
    """Sections proper (CONTEXT goes to the document, errors are dropped)."""
    return parsed.filter(F.col("error").isNull() & F.col("kind").isNotNull() & (F.col("kind") != "CONTEXT"))


# ----------------------------------------------------------- F6 validate

def violations(parsed: DataFrame) -> DataFrame:
    """(doc_id, rule) for every broken rule, parse errors included."""
    s = parsed
    per_section = s.select("doc_id", F.when(F.col("error").isNotNull(), F.col("error"))
                           .when(F.col("kind").isin(*REFERENCE_KINDS) & (F.col("id") != INLINE)
                                 & F.col("content").isNotNull(),
                                 F.format_string("Referenced %s should not have inline content", "kind"))
                           .when(F.col("kind").isin(*REFERENCE_KINDS) & (F.col("id") == INLINE)
                                 & F.col("content").isNull(),
                                 F.format_string("Inline %s must have content", "kind"))
                           .when((F.col("kind") == "TASK") & (F.col("content") == ""),
                                 F.lit("Task content cannot be empty"))
                           .alias("rule")).filter(F.col("rule").isNotNull())
    docs = s.select("doc_id", "version").distinct()
    no_version = docs.filter(F.col("version").isNull()).select(
        "doc_id", F.lit("Missing or invalid @HIERATIC version declaration").alias("rule"))
    tasks = s.filter(F.col("kind") == "TASK").select("doc_id").distinct()
    no_task = docs.join(tasks, "doc_id", "left_anti").select(
        "doc_id", F.lit("Missing required @TASK section").alias("rule"))
    return per_section.unionByName(no_version).unionByName(no_task)


def first_of_kind(sections: DataFrame, kind: str) -> DataFrame:
    """F8: first section of a kind per document (task text, role)."""
    return sections.filter(F.col("kind") == kind).groupBy("doc_id").agg(
        F.min_by(F.struct("id", "content"), "pos").alias("first"))


# ------------------------------------------------------------ C9 expand

def expand(parsed: DataFrame, library: DataFrame) -> DataFrame:
    """C9 + J8: (doc_id, expanded, error).  Invalid documents and documents
    referring to an unknown pattern get an error instead of text.  The library
    is joined (left) on the pattern id; no collect."""
    secs = sections_of(parsed)
    lib = library.select(F.col("id").alias("lib_id"), F.col("content").alias("lib_content"))
    j = secs.join(lib, (secs.id == lib.lib_id) & secs.kind.isin(*REFERENCE_KINDS) & secs.content.isNull(), "left")
    text = (F.when(F.col("kind").isin(*REFERENCE_KINDS), F.coalesce("content", "lib_content"))
            .when(F.col("kind") == "TASK", F.col("content"))
            .when(F.col("kind").isin(*LIST_KINDS),
                  F.concat(F.when(F.col("kind") == "FOCUS", F.lit(EXPAND_PREFIX["FOCUS"]))
                           .otherwise(F.lit(EXPAND_PREFIX["STYLE"])), F.array_join("items", ", ")))
            .when(F.col("kind") == "FORMAT", F.concat(F.lit(EXPAND_PREFIX["FORMAT"]), F.col("content"))))
    missing = F.col("kind").isin(*REFERENCE_KINDS) & F.col("content").isNull() & F.col("lib_content").isNull()
    per = j.select("doc_id", "pos", text.alias("x"),
                   F.when(missing, F.concat(F.lit("Context pattern not found: "), F.col("id"))).alias("err"))
    docs = per.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))),
                                 lambda s: F.concat(s.x, F.lit("\n\n"))), "").alias("raw"),
        F.min_by("err", F.when(F.col("err").isNotNull(), F.col("pos"))).alias("ref_error"))
    bad = violations(parsed).groupBy("doc_id").agg(F.min("rule").alias("invalid"))
    all_docs = parsed.select("doc_id").distinct()
    out = all_docs.join(docs, "doc_id", "left").join(bad, "doc_id", "left")
    error = F.coalesce("invalid", "ref_error")
    return out.select("doc_id", F.when(error.isNull(), utrim(F.coalesce("raw", F.lit("")))).alias("expanded"),
                      error.alias("error"))


# ------------------------------------------------------------ A15 tokens

def document_tokens(sections: DataFrame, refs: DataFrame | None = None,
                    counter: TokenCounter = approx4) -> DataFrame:
    """10 + reference tokens + per-section tokens (items count 2)."""
    per = sections.select("doc_id", (
        F.when(F.col("kind").isin(*REFERENCE_KINDS) & F.col("content").isNotNull(), counter(F.col("content")))
        .when(F.col("kind").isin("TASK", "FORMAT"), counter(F.col("content")))
        .when(F.col("kind").isin(*LIST_KINDS), F.size("items") * ITEM_TOKENS)
        .otherwise(F.lit(0))).cast("long").alias("t"))
    out = per.groupBy("doc_id").agg(F.sum("t").alias("section_tokens"))
    if refs is not None:
        r = refs.groupBy("doc_id").agg(F.sum("compressed_tokens").alias("ref_tokens"))
        out = out.join(r, "doc_id", "left")
    else:
        out = out.withColumn("ref_tokens", F.lit(0).cast("long"))
    return out.select("doc_id", (F.lit(FORMAT_OVERHEAD) + F.col("section_tokens")
                                 + F.coalesce("ref_tokens", F.lit(0))).cast("long").alias("compressed_tokens"))
