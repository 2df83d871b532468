"""The whole compression of a prompt with a pattern library (C1, C4, C5): matched
windows become references, the rest is compressed to the budget, and both make a
directive document.

Only matching (``patterns.pattern_matches``) shuffles; everything after it works on a
prompt's own row.  References of one prompt don't overlap, so their array is bounded by
the prompt's words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, let, utrim
from . import extract as ex
from .documents import VERSION, section_text
from .patterns import MIN_SIMILARITY, pattern_matches, substitute

#: What stands in a text for a matched window.
MARKER = "[PATTERN:%s]"
REFS = ("array<struct<start_word:int,end_word:int,id:string,category:string,original_tokens:bigint,"
        "compressed_tokens:bigint,tokens_saved:bigint>>")


def replace_windows(text, refs) -> Column:
    """C4: ``refs`` (in order, without overlaps, by word) replaced by markers.
    struct<text, marks>; a mark has its reference's fields, the window's own text
    (``matched``) and the marker's place in the new text (``at``, characters)."""
    def of(pieces):
        def mark(r, i):
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(col(refs), i - 1).end_word)
            first = F.get(pieces, r.start_word)
            lead = F.regexp_extract(first, r"(?U)^(\s*)", 1)
            whole = F.array_join(F.slice(pieces, r.start_word + 1, r.end_word - r.start_word), "")
            return F.struct(
                F.concat(F.array_join(F.slice(pieces, begin + 1, r.start_word - begin), ""), lead).alias("before"),
                F.format_string(MARKER, r.id).alias("marker"),
                F.substring(whole, F.char_length(lead) + 1, F.char_length(whole)).alias("matched"),
                *[r[f].alias(f) for f in ("id", "category", "original_tokens", "compressed_tokens", "tokens_saved")])

        def built(marks):
            last = F.when(F.size(marks) == 0, F.lit(0)).otherwise(F.element_at(col(refs), -1).end_word)
            tail = F.array_join(F.slice(pieces, last + 1, F.size(pieces) - last + 1), "")
            blanks = F.regexp_extract(col(text), r"(?U)(\s*)\z", 1)
            head = F.array_join(F.transform(marks, lambda m: F.concat(m.before, m.marker)), "")
            placed = F.transform(marks, lambda m, i: F.struct(
                (F.aggregate(F.slice(marks, 1, i), F.lit(0), lambda n, o: n + F.char_length(o.before) + F.char_length(o.marker))
                 + F.char_length(m.before)).alias("at"),
                *[m[f].alias(f) for f in ("marker", "matched", "id", "category", "original_tokens", "compressed_tokens",
                                          "tokens_saved")]))
            return F.struct(F.concat(head, tail, blanks).alias("text"), placed.alias("marks"))

        return let(F.transform(col(refs), mark), built)

    return let(F.regexp_extract_all(col(text), F.lit(r"(?U)\s*\S+"), F.lit(0)), of)


def restore_windows(text, marks) -> Column:
    """The text before :func:`replace_windows`, exactly."""
    end = F.aggregate(col(marks), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda acc, m: F.struct(
        (m.at + F.char_length(m.marker)).alias("at"),
        F.concat(acc.out, F.substring(col(text), acc.at + 1, m.at - acc.at), m.matched).alias("out")))
    return let(end, lambda e: F.concat(e.out, F.substring(col(text), e.at + 1, F.char_length(col(text)))))


def without_markers(text, marks) -> Column:
    """The markers go, other brackets stay."""
    return F.aggregate(col(marks), col(text), lambda t, m: F.replace(t, m.marker, F.lit("")))


def document_text(refs, task, context_path: str | None = None) -> Column:
    """The encoded document, reference sections and then the task (M16: every
    category has its section)."""
    none = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    head = f"@HIERATIC v{VERSION}\n" + (f"@CONTEXT: {context_path}\n" if context_path else "") + "\n"
    sections = F.array_join(F.transform(col(refs), lambda r: section_text(F.upper(r.category), r.id, *none)), "")
    return F.concat(F.lit(head), sections, section_text(F.lit("TASK"), none[0], col(task), none[1]))


def compress_with_library(docs: DataFrame, lib: DataFrame | None, id_col: str = "doc_id", text_col: str = "text",
                          config: ex.CompressionConfig = ex.CompressionConfig(), tau: float = MIN_SIMILARITY,
                          structured: bool = False, context_path: str | None = None) -> DataFrame:
    """Gate -> split off the payload -> references for matched windows of the
    instructions -> extraction of the rest unless the references save enough ->
    payload back -> document.  Without a library (force inline) no window is
    replaced.  Ids are unique.  Adds to id and text: ``original_tokens``,
    ``target_tokens``, ``marks`` (see :func:`replace_windows`), ``substituted``
    (instructions with markers), ``task``, ``document``, ``compressed_tokens``,
    ``tokens_saved``, ``compression_ratio``."""
    cnt = config.counter
    st = docs.select(id_col, text_col).withColumn("original_tokens", cnt(F.col(text_col))) \
        .withColumn("_gated", F.col("original_tokens") < ex.MIN_TOKENS_FOR_COMPRESSION) \
        .withColumn("_split", ex.split_parts(F.col(text_col))) \
        .withColumn("_instr", F.col("_split.head")).withColumn("_payload", F.col("_split.tail")).drop("_split")
    if lib is not None:
        open_ = st.where(~F.col("_gated")).select(id_col, "_instr")
        found = substitute(pattern_matches(open_, lib, id_col, "_instr", tau).checkpoint(), lib, id_col, cnt)
        refs = found.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(
            "start_word", "end_word", "id", "category", "original_tokens", "compressed_tokens", "tokens_saved")))
            .cast(REFS).alias("_refs"))
        st = st.join(refs, id_col, "left").withColumn("_refs", F.coalesce("_refs", F.array().cast(REFS)))
    else:
        st = st.withColumn("_refs", F.array().cast(REFS))
    st = st.withColumn("_sub", replace_windows("_instr", "_refs")) \
        .withColumn("substituted", F.col("_sub.text")).withColumn("marks", F.col("_sub.marks")).drop("_sub", "_refs")

    def total(field):
        return F.aggregate("marks", F.lit(0).cast("bigint"), lambda n, m: n + m[field])

    st = st.withColumn("target_tokens", ex.target_tokens("original_tokens", config.ratio))
    skip = F.col("_gated") | (F.greatest(F.col("original_tokens") - total("tokens_saved"), F.lit(0)) <= F.col("target_tokens"))
    if structured:
        st = st.withColumn("_body", ex.compress_structured("substituted", F.col("target_tokens"), config.rules, cnt)["text"])
    else:
        st = ex.pick_within_budget(ex.stage_sentence_items(st, "substituted", "_c", config.rules, cnt, config=config),
                                   "substituted", "target_tokens", "_c", "_c").withColumn("_body", F.col("_c.text")).drop("_c")
    body = F.concat(F.when(skip, F.col("substituted")).otherwise(F.col("_body")), "_payload")
    st = st.withColumn("task", F.when(F.col("_gated"), F.col(text_col)).otherwise(utrim(without_markers(body, "marks"))))
    st = st.withColumn("document", document_text("marks", "task", context_path)) \
        .withColumn("compressed_tokens", F.lit(ex.FORMAT_OVERHEAD_TOKENS).cast("bigint") + total("compressed_tokens")
                    + cnt(F.col("task"))) \
        .withColumn("tokens_saved", F.greatest(F.col("original_tokens") - F.col("compressed_tokens"), F.lit(0)).cast("bigint"))
    ratio = F.when(F.col("original_tokens") > 0, F.col("tokens_saved") / F.col("original_tokens")).otherwise(F.lit(0.0))
    return st.withColumn("compression_ratio", ratio).select(
        id_col, text_col, "original_tokens", F.when(~F.col("_gated"), F.col("target_tokens")).alias("target_tokens"),
        "marks", "substituted", "task", "document", "compressed_tokens", "tokens_saved", "compression_ratio")
