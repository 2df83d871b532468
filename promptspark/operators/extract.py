"""Extractive compression.

Design: a document's sentences live in an ``array<string>`` column and every
per-document step (segmentation, scoring, the greedy budget walk, re-ordering)
is a higher-order function over that array.  The corpus is therefore
compressed in ONE narrow stage - no shuffle, no Python, one task per input
split - and work per row is bounded by that document's own length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, let, lines, utrim, word_count
from ..functions.tokens import TokenCounter, approx4
from .text_ops import split_parts

# Target reduction ratio per level.
LEVEL_RATIO = {"light": 0.35, "medium": 0.55, "aggressive": 0.75}
# Prompts below this many tokens pass through untouched.
MIN_TOKENS_FOR_COMPRESSION = 50
# Format overhead counted for every compressed document.
FORMAT_OVERHEAD_TOKENS = 10
# A line longer than this many bytes is a unit on its own.
LONG_LINE_BYTES = 20
FALLBACK_MIN_BYTES = 5
SENTENCE_MIN_BYTES = 3


# --------------------------------------------------------------- P13 split

def _is_fragment(line: Column) -> Column:
    """A short line that neither ends a sentence nor is a bullet: it is
    glued onto the previous unit."""
    return ~(line.rlike(r"[.!?]$") | line.rlike(r"^[-*•]")
             | (F.octet_length(line) > LONG_LINE_BYTES))


def line_units(text) -> Column:
    """Line-based units: trimmed non-empty lines, fragments glued to the
    previous unit with a space.  Linear: every line but the first is preceded by
    a space or a line break, whichever joins or parts it, the array is joined
    once and cut at the breaks (no line holds one)."""
    def body(ls):
        led = F.transform(ls, lambda l, i: F.when(i == 0, l).otherwise(F.concat(
            F.when(_is_fragment(l), F.lit(" ")).otherwise(F.lit("\n")), l)))
        glued = F.array_join(led, "")
        return F.when(F.size(ls) == 0, F.array().cast("array<string>")).otherwise(F.split(glued, "\n"))

    return let(F.filter(F.transform(lines(text), utrim), lambda l: l != ""), body)


def punctuation_units(text) -> Column:
    """Fallback: cut after . ! ? when followed by whitespace (or by the final
    character); pieces of 5 bytes or less are dropped."""
    pieces = F.split(col(text), r"(?sU)(?<=[.!?])(?=\s|.\z)")
    return F.filter(F.transform(pieces, utrim), lambda p: F.octet_length(p) > FALLBACK_MIN_BYTES)


def sentences(text) -> Column:
    """P13.  Line units; when they number fewer than (periods / 3) the
    punctuation split *replaces* them (deviation M12: the reference appends
    it, duplicating text).  Pieces of <= 3 bytes or only dots/blanks go."""
    t = col(text)
    dots = F.char_length(t) - F.char_length(F.replace(t, F.lit("."), F.lit("")))
    chosen = let(line_units(t), lambda units: F.when(
        F.size(units) < F.floor(dots / 3), punctuation_units(t)).otherwise(units))
    return F.filter(F.transform(chosen, utrim),
                    lambda s: (F.octet_length(s) > SENTENCE_MIN_BYTES) & ~s.rlike(r"(?U)^[\s.]+$"))


# ----------------------------------------------------------- P16 scoring

@dataclass(frozen=True)
class Rule:
    """``weight`` is added when any alternative matches; an alternative is a
    tuple of lower-case substrings that must all occur."""
    weight: float
    any_of: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]
    length_bonus: float = 1.0
    length_words: tuple[int, int] = (5, 30)
    base: float = 0.5


# The reference's heuristic rules.
REFERENCE_RULES = RuleSet(rules=(
    Rule(100.0, (("response format:",), ("separator is always",), ("do not", "output"),
                 ("extracted_value",), ("doc_page_number",))),
    Rule(2.0, (("important",), ("critical",), ("must",))),
    Rule(1.5, (("analyze",), ("provide",), ("explain",))),
    Rule(1.0, (("example",), ("such as",))),
))


def heuristic_score(sentence, rules: RuleSet = REFERENCE_RULES) -> Column:
    def scored(total, low):
        for r in rules.rules:
            cond = None
            for alt in r.any_of:
                c = None
                for kw in alt:
                    k = low.contains(kw)
                    c = k if c is None else (c & k)
                cond = c if cond is None else (cond | c)
            total = total + F.when(cond, F.lit(r.weight)).otherwise(F.lit(0.0))
        return total + F.lit(rules.base)

    # what is read more than once, also from lambdas, is computed once
    def of(x):
        length = F.when(x.n.between(*rules.length_words), F.lit(rules.length_bonus)).otherwise(F.lit(0.0))
        return scored(length, x.low)

    return let(F.struct(word_count(sentence).alias("n"), F.lower(col(sentence)).alias("low")), of)


def information_density(sentence) -> Column:
    """0.5 * unique/words + 0.5 * min(words, 30)/30, capped at 1."""
    from ..functions.text import words
    def density(w):
        n = F.size(w)
        uniq = F.size(F.array_distinct(w)).cast("double") / F.greatest(n, F.lit(1))
        return F.least(uniq * 0.5 + F.least(n, F.lit(30)).cast("double") / 30.0 * 0.5, F.lit(1.0))

    return let(words(sentence), density)


def position_score(context_size) -> Column:
    """1.0 with no context, else 0.5 (context always holds the sentence
    itself, so this is 0.5 in practice - kept as the reference has it)."""
    return F.when(col(context_size) == 0, F.lit(1.0)).otherwise(F.lit(0.5))


# -------------------------------------------------------------- W1 context

def context_window(sents, radius: int = 2) -> Column:
    """For sentence i the slice [i-2, i+2] of its document's sentences."""
    a = col(sents)
    return F.transform(a, lambda s, i: F.slice(a, F.greatest(i - radius + 1, F.lit(1)),
                                               F.least(i + radius + 1, F.size(a))
                                               - F.greatest(i - radius + 1, F.lit(1)) + 1))


# ------------------------------------------------------------ W4 budget

#: Units that one step of the budget walk takes: its state is copied once a step.
WALK_STEP = 128


def first_of_equal(items) -> Column:
    """X4 before the walk: of units (array<struct<idx, tokens, same>> in walk order)
    with the same normal form only the first stays, with the number of its
    ``copies``; neighbours are compared after sorting by normal form.  An equal
    unit has the same tokens, so one that comes after a unit which did not fit
    would not fit either."""
    def grouped(g):
        at = F.filter(F.transform(g, lambda x, i: F.when(
            (i == 0) | (x.same != F.get(g, i - 1).same), i)), lambda i: i.isNotNull())
        return let(at, lambda f: F.transform(f, lambda i, j: F.struct(
            F.get(g, i).place.alias("place"), F.get(g, i).idx.alias("idx"), F.get(g, i).tokens.alias("tokens"),
            (F.coalesce(F.get(f, j + 1), F.size(g)) - i).alias("copies"))))

    by_form = F.array_sort(F.transform(col(items), lambda x, i: F.struct(
        x.same.alias("same"), i.alias("place"), x.idx.alias("idx"), x.tokens.alias("tokens"))))
    return F.transform(F.array_sort(let(by_form, grouped)), lambda x: F.struct(
        x.idx.alias("idx"), x.tokens.alias("tokens"), x.copies.alias("copies")))


def select_within_budget(items, target) -> Column:
    """W4 over ``items`` (array<struct<idx, tokens, copies>>) already in walk
    order: a unit is taken if it still fits, and the first one always; the other
    copies of a taken unit are redundant.  The walk goes by steps of
    ``WALK_STEP`` units, each with a state of its own, so that the picks so far
    are copied once a step and not once a unit.  Returns struct<picks, total,
    dups>."""
    none = F.array().cast("array<int>")

    def take(acc, x):
        fits = (acc.total + x.tokens <= target) | ~acc.some
        return F.when(fits, F.struct(
            F.concat(acc.picks, F.array(x.idx)).alias("picks"), (acc.total + x.tokens).alias("total"),
            (acc.dups + x.copies - 1).alias("dups"), F.lit(True).alias("some"))).otherwise(acc)

    def step(acc, part):
        start = F.struct(none.alias("picks"), acc.total.alias("total"), acc.dups.alias("dups"), acc.some.alias("some"))
        return let(F.aggregate(part, start, take), lambda r: F.struct(
            F.concat(acc.picks, r.picks).alias("picks"), r.total.alias("total"), r.dups.alias("dups"),
            r.some.alias("some")))

    parts = let(items, lambda it: F.when(F.size(it) == 0, F.array(it)).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(it), F.lit(WALK_STEP)), lambda k: F.slice(it, k, WALK_STEP))))
    empty = F.struct(none.alias("picks"), F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("dups"),
                     F.lit(False).alias("some"))
    return F.aggregate(parts, empty, step, lambda acc: F.struct(
        F.array_sort(acc.picks).alias("picks"), acc.total.alias("total"), acc.dups.alias("dups")))


# ------------------------------------------------------------ C1 / C3

# The ways to score a sentence, in matrix order.
SCORINGS = ("heuristic", "semantic", "hybrid")
EMBED_DIM = 32
#: Scores are compared at this many decimals, so that sums taken in another
#: order don't reorder equal sentences.
SCORE_DECIMALS = 9


def _default_embed(sentence: Column) -> Column:
    from .vectors import hash_embed
    return hash_embed(sentence, EMBED_DIM)


def _default_critical() -> list[list[float]]:
    from .quality import CRITICAL_PATTERNS
    from .vectors import hash_embed_values
    return [hash_embed_values(p, EMBED_DIM) for p in CRITICAL_PATTERNS]


@dataclass(frozen=True)
class CompressionConfig:
    """``scoring``: heuristic rules, ``semantic`` (50 x highest cosine to the
    critical vectors + 20 x density + position) or ``hybrid`` (0.7 semantic + 0.3
    heuristic).  ``embed`` maps a sentence column to a vector column (a pandas UDF
    or ``predict_batch_udf`` of a real model, or the default word hash);
    ``critical`` are the vectors of the critical phrases under that embedding."""
    level: str = "medium"
    target_ratio: float | None = None
    rules: RuleSet = REFERENCE_RULES
    counter: TokenCounter = field(default=approx4)
    scoring: str = "heuristic"
    embed: Callable[[Column], Column] = field(default=_default_embed)
    critical: Sequence[Sequence[float]] = field(default_factory=_default_critical)

    @property
    def ratio(self) -> float:
        return self.target_ratio if self.target_ratio is not None else LEVEL_RATIO[self.level]


def semantic_part(sentence, config: CompressionConfig) -> Column:
    """What a semantic score is made of; null without an embedding."""
    from .vectors import SEMANTIC_WEIGHTS, max_cosine
    cos = max_cosine(config.embed(col(sentence)), config.critical)
    return cos * SEMANTIC_WEIGHTS[0] + information_density(sentence) * SEMANTIC_WEIGHTS[1] + F.lit(0.5)


def combined_score(rule_score, semantic, scoring: str) -> Column:
    """A sentence's score from its two parts.  A null embedding counts as no
    semantic score: semantic falls back to the rules, hybrid takes 0 for its part."""
    from .vectors import HYBRID_WEIGHTS
    if scoring == "heuristic":
        return rule_score
    if scoring == "semantic":
        return F.round(F.coalesce(semantic, rule_score), SCORE_DECIMALS)
    return F.round(F.coalesce(semantic, F.lit(0.0)) * HYBRID_WEIGHTS[0] + rule_score * HYBRID_WEIGHTS[1], SCORE_DECIMALS)


def sentence_score(sentence, scoring: str, config: CompressionConfig) -> Column:
    """A sentence's score."""
    return combined_score(heuristic_score(sentence, config.rules),
                          None if scoring == "heuristic" else semantic_part(sentence, config), scoring)


def target_tokens(original_tokens, ratio) -> Column:
    """Truncation of tokens * (1 - ratio) computed in doubles."""
    r = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    return F.floor(col(original_tokens).cast("double") * (F.lit(1.0) - r)).cast("bigint")


def stage_sentence_items(df: DataFrame, text_col: str, prefix: str,
                         rules: RuleSet = REFERENCE_RULES, counter: TokenCounter = approx4,
                         scores_col: str | None = None, config: CompressionConfig | None = None,
                         scorings: Sequence[str] | None = None) -> DataFrame:
    """First half of C3 (independent of the budget): the sentences and their
    walk order, staged as ``{prefix}__s`` / ``{prefix}__it`` columns.

    Every array that a lambda reads is staged as its own column: higher-order
    functions run interpreted and Catalyst does not share subexpressions
    inside lambdas, so an inlined ``sentences(text)`` would be recomputed per
    element.  ``scores_col`` may supply an array<double> aligned with the
    sentences (any other scorer); ``config`` chooses the mode; ``scorings``
    multiplies the rows by modes (``scoring_mode``) after segmentation."""
    s, it, parts = f"{prefix}__s", f"{prefix}__it", f"{prefix}__parts"
    staged = df.withColumn(s, sentences(text_col))

    def unit(x, i, score):
        return F.struct((-score).alias("k"), i.alias("idx"), counter(x).alias("tokens"), F.lower(x).alias("same"))

    if scorings:
        # both parts of a score once per sentence, before rows are multiplied by modes
        semantic = any(m != "heuristic" for m in scorings)
        staged = staged.withColumn(parts, F.transform(s, lambda x, i: F.struct(
            heuristic_score(x, config.rules).alias("rule"),
            (semantic_part(x, config) if semantic else F.lit(None).cast("double")).alias("semantic"),
            i.alias("idx"), counter(x).alias("tokens"), F.lower(x).alias("same"))))
        staged = staged.withColumn("scoring_mode", F.explode(F.array(*[F.lit(x) for x in scorings])))

        def by_mode(mode):
            return F.when(F.col("scoring_mode") == mode, F.transform(parts, lambda p: F.struct(
                (-combined_score(p.rule, p.semantic, mode)).alias("k"), p.idx.alias("idx"), p.tokens.alias("tokens"),
                p.same.alias("same"))))

        scored = F.coalesce(*[by_mode(m) for m in scorings])
    elif config is not None and not scores_col:
        scored = F.transform(s, lambda x, i: unit(x, i, sentence_score(x, config.scoring, config)))
    elif scores_col:
        scored = F.transform(F.arrays_zip(F.col(s).alias("x"), F.col(scores_col).alias("v")),
                             lambda z, i: unit(z.x, i, z.v))
    else:
        scored = F.transform(s, lambda x, i: unit(x, i, heuristic_score(x, rules)))
    in_order = F.transform(F.array_sort(scored), lambda x: F.struct(
        x.idx.alias("idx"), x.tokens.alias("tokens"), x.same.alias("same")))
    return staged.withColumn(it, first_of_equal(in_order)).drop(parts)


def pick_within_budget(df: DataFrame, text_col: str, target_col: str, prefix: str, out: str) -> DataFrame:
    """Second half of C3: the budget walk for ``target_col`` over staged
    items; adds ``out`` = struct<text, n_sentences, n_selected,
    redundant_removed, selected_tokens> and drops the staged columns."""
    s, it, pk = f"{prefix}__s", f"{prefix}__it", f"{prefix}__pk"
    staged = df.withColumn(pk, select_within_budget(it, F.col(target_col)))
    joined = F.array_join(F.transform(F.col(f"{pk}.picks"), lambda i: F.element_at(F.col(s), i + 1)), " ")
    return staged.withColumn(out, F.struct(
        F.when(F.size(s) == 0, F.col(text_col)).otherwise(joined).alias("text"),
        F.size(s).alias("n_sentences"),
        F.size(f"{pk}.picks").alias("n_selected"),
        F.col(f"{pk}.dups").alias("redundant_removed"),
        F.col(f"{pk}.total").alias("selected_tokens"))).drop(s, it, pk)


def with_compressed_sentences(df: DataFrame, text_col: str, target_col: str, out: str,
                              rules: RuleSet = REFERENCE_RULES, counter: TokenCounter = approx4,
                              scores_col: str | None = None) -> DataFrame:
    """C3 for one budget column (see the two halves above)."""
    staged = stage_sentence_items(df, text_col, out, rules, counter, scores_col)
    return pick_within_budget(staged, text_col, target_col, out, out)


def extractive_compress(df: DataFrame, text_col: str = "text",
                        config: CompressionConfig = CompressionConfig(),
                        levels: Sequence[str] | None = None,
                        scorings: Sequence[str] | None = None) -> DataFrame:
    """C1 without a pattern library (or after substitution): gate -> split
    instructions/payload -> sentence mode -> reattach payload -> task
    section -> token accounting.  Adds the result columns to ``df``.

    ``levels`` compresses every row at several levels in the same narrow
    stage: sentences are segmented and scored once, then the rows are
    exploded per level (``compression_level``, ``ratio``) and only the budget
    walk runs per level.  ``scorings`` does the same with scoring modes
    (``scoring_mode``): segmented once, scored and walked per mode."""
    cnt = config.counter
    staged = (df.withColumn("_split", split_parts(F.col(text_col)))
              .withColumn("_instr", F.col("_split.head")).withColumn("_payload", F.col("_split.tail"))
              .drop("_split").withColumn("original_tokens", cnt(F.col(text_col))))
    staged = stage_sentence_items(staged, "_instr", "_c", config.rules, cnt, config=config, scorings=scorings)
    if levels:
        staged = staged.withColumn("_lv", F.explode(F.array(*[
            F.struct(F.lit(lv).alias("compression_level"), F.lit(float(LEVEL_RATIO[lv])).alias("ratio"))
            for lv in levels]))).select("*", "_lv.compression_level", "_lv.ratio").drop("_lv")
        ratio = F.col("ratio")
    else:
        ratio = F.lit(float(config.ratio))
    staged = staged.withColumn("_tgt", target_tokens("original_tokens", ratio))
    staged = pick_within_budget(staged, "_instr", "_tgt", "_c", "_c")
    gated = F.col("original_tokens") < MIN_TOKENS_FOR_COMPRESSION
    skip = gated | (F.col("original_tokens") <= F.col("_tgt"))
    body = F.when(skip, F.col("_instr")).otherwise(F.col("_c.text"))
    return (staged
            .withColumn("target_tokens", F.when(gated, F.lit(None).cast("bigint")).otherwise(F.col("_tgt")))
            .withColumn("task", F.when(gated, F.col(text_col)).otherwise(utrim(F.concat(body, "_payload"))))
            .withColumn("compressed_tokens", F.lit(FORMAT_OVERHEAD_TOKENS).cast("bigint") + cnt(F.col("task")))
            .withColumn("tokens_saved", F.greatest(F.col("original_tokens") - F.col("compressed_tokens"),
                                                   F.lit(0)).cast("bigint"))
            .withColumn("compression_ratio", F.when(F.col("original_tokens") > 0,
                                                    F.col("tokens_saved") / F.col("original_tokens"))
                        .otherwise(F.lit(0.0)))
            .withColumn("n_sentences", F.when(skip, F.lit(0)).otherwise(F.col("_c.n_sentences")))
            .withColumn("n_selected", F.when(skip, F.lit(0)).otherwise(F.col("_c.n_selected")))
            .withColumn("redundant_removed", F.when(skip, F.lit(0)).otherwise(F.col("_c.redundant_removed")))
            .withColumn("low_relevance_removed", F.when(skip, F.lit(0)).otherwise(
                F.greatest(F.octet_length("_instr") - F.octet_length(F.col("_c.text")), F.lit(0))))
            .drop("_c", "_instr", "_payload", "_tgt"))


def level_ratio(level) -> Column:
    m = F.create_map(*[x for k, v in LEVEL_RATIO.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, col(level))


def sentence_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   rules: Sequence[RuleSet] = (REFERENCE_RULES,),
                   counter: TokenCounter = approx4) -> DataFrame:
    """One row per sentence: (id, idx, sentence, tokens, words, score_k...,
    density, n_context).  Narrow: posexplode after the array work."""
    with_s = df.select(id_col, sentences(text_col).alias("_s"))
    ex = with_s.select(id_col, F.size("_s").alias("_n"), F.posexplode_outer("_s").alias("idx", "sentence")) \
        .where(F.col("sentence").isNotNull())  # a plain posexplode adds a filter that computes the array once more
    # W1's size from place and length; the slices themselves are context_window's.
    n_context = F.least(F.col("idx") + 2, F.col("_n") - 1) - F.greatest(F.col("idx") - 2, F.lit(0)) + 1
    out = ex.select(id_col, F.col("idx").cast("int").alias("idx"), "sentence", n_context.cast("int").alias("n_context"))
    out = out.withColumn("tokens", counter(F.col("sentence")))
    out = out.withColumn("words", word_count("sentence"))
    for k, rs in enumerate(rules):
        out = out.withColumn(f"score_{k}", heuristic_score("sentence", rs))
    return out.withColumn("density", information_density("sentence"))


# ------------------------------------------------------ C2 structured mode

def line_offsets(ls) -> Column:
    """0-based start offset of every line (running sum of length + 1): the places
    after the breaks of the lines' own join."""
    breaks = F.transform(F.split(F.array_join(col(ls), "\n"), ""), lambda c, i: F.when(c == "\n", i + 1))
    return F.when(F.size(ls) == 0, F.array().cast("array<int>")).otherwise(
        F.concat(F.array(F.lit(0)), F.filter(breaks, lambda i: i.isNotNull())))


def segments(text, blocks) -> Column:
    """Cut before header lines that are not inside a block, and after
    the line that reaches a block's end.  Trimmed, empty segments dropped."""
    from .text_ops import is_header

    def with_lines(ls, b):
        offs = line_offsets(ls)
        spans = F.transform(F.arrays_zip(ls.alias("l"), offs.alias("s")), lambda z: F.struct(
            z.l.alias("l"), z.s.alias("s"), (z.s + F.char_length(z.l)).alias("e")))
        flagged = F.transform(spans, lambda x: F.struct(
            x.l.alias("l"),
            F.exists(b, lambda k: (x.s >= k.start) & (x.e <= k.end)).alias("inside"),
            F.exists(b, lambda k: (x.s >= k.start) & (x.e <= k.end) & (x.e >= k.end - 1)).alias("closes")))
        starts = let(flagged, lambda fl: F.filter(F.transform(fl, lambda x, i: F.when(
            (i == 0) | (is_header(x.l) & ~x.inside) | F.element_at(fl, F.greatest(i, F.lit(1))).closes, i + 1)),
            lambda i: i.isNotNull()))
        return let(starts, lambda st: F.transform(st, lambda s, k: F.array_join(F.slice(
            ls, s, F.coalesce(F.get(st, k + 1), F.size(ls) + 1) - s), "\n")))

    segs = let(lines(text), lambda ls: let(col(blocks), lambda b: with_lines(ls, b)))
    return F.filter(F.transform(segs, utrim), lambda s: s != "")


def segment_score(segment, rules: RuleSet = REFERENCE_RULES) -> Column:
    """Sentence score plus structure bonuses."""
    s = col(segment)
    low = F.lower(s)
    n_lines = F.size(lines(s))
    return (heuristic_score(s, rules)
            + F.when(utrim(s).startswith("#"), F.lit(5.0)).otherwise(F.lit(0.0))
            + F.when(s.contains("<table") | s.contains("```") | s.contains("{"), F.lit(4.0))
            .otherwise(F.lit(0.0))
            + F.when(low.contains("definition:") | low.contains("location:"), F.lit(3.5))
            .otherwise(F.lit(0.0))
            + F.when(n_lines.between(3, 20), F.lit(1.0)).when(n_lines > 20, F.lit(2.0))
            .otherwise(F.lit(0.0))
            + F.when(s.contains("[REF:"), F.lit(1.5)).otherwise(F.lit(0.0)))


def compress_structured(text, target, rules: RuleSet = REFERENCE_RULES,
                        counter: TokenCounter = approx4, phrases: Sequence[str] | None = None) -> Column:
    """Repeated phrases consolidated (P20), segments scored and walked in score
    order within the budget (no de-duplication in this mode), re-joined with
    newlines in document order (deviation M13), phrases expanded again.
    struct<text, n_segments, n_selected, selected_tokens, n_phrases>."""
    from .text_ops import COMMON_PHRASES, consolidate, expand_phrases, structured_blocks

    def picked_of(segs, refs):
        items = F.transform(F.array_sort(F.transform(segs, lambda s, i: F.struct(
            (-segment_score(s, rules)).alias("k"), i.alias("idx"), counter(s).alias("tokens")))),
            lambda x: F.struct(x.idx.alias("idx"), x.tokens.alias("tokens"), F.lit(1).alias("copies")))
        return let(select_within_budget(items, target), lambda picked: F.struct(
            expand_phrases(F.array_join(F.transform(picked.picks, lambda i: F.element_at(segs, i + 1)), "\n"),
                           refs).alias("text"),
            F.size(segs).alias("n_segments"), F.size(picked.picks).alias("n_selected"),
            picked.total.alias("selected_tokens"), F.size(refs).alias("n_phrases")))

    return let(consolidate(text, COMMON_PHRASES if phrases is None else phrases), lambda c: let(
        segments(c.text, structured_blocks(c.text)), lambda segs: picked_of(segs, c.refs)))
