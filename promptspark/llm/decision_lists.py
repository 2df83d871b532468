"""Quality rules: a decision list learned by sequential covering.

Text statistics are plain column expressions inside one narrow stage.  Rules are
conjunctions of thresholds (``symbol_share > 0.05 AND upper_share > 0.3``): on a
growing fold the literal with the best information gain is added until no kept
document is covered, on a pruning fold literals are taken back from the end
while that raises the rule's worth, a rule that is good enough there joins the
list, what it covers leaves, and the next one is grown.  All counting is Spark
aggregation over the labelled rows (every labelled row, no sample): a growing
step is one grouped count by feature and bin, and only that table of fixed size
(features times bins) reaches the driver.  The list becomes one ordered
conditional expression, so judging a corpus is a scan without a shuffle.

Defined results: null text has no words and fails the base rules; documents
without a label are judged like all others; label rows whose quality is neither
0 nor 1, and labels without a document, are left out; a repeated label row counts
as often as it stands; without usable labels the list is empty and only the base
rules reject.  Other columns pass through whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAME = "op5_decision_lists"
ORACLE_SQL = None

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MAX_RULES = 12
MAX_LITERALS = 4
#: Share of rejected documents among those that a rule covers on the pruning fold.
MIN_PRECISION = 0.9
#: Labelled documents that a rule must cover on either fold.
MIN_COVER = 3

_SHARES = [0.0, 0.0025, 0.005, 0.01, 0.015, *[k / 40 for k in range(1, 40)]]
#: Feature -> thresholds, the grid of the literals.
GRID: dict[str, list[float]] = {
    "n_words": [round(10 * 1.5 ** k, 1) for k in range(18)],
    "word_length": [k / 2 for k in range(4, 41)],
    "symbol_share": _SHARES,
    "repeat_share": _SHARES,
    "dup_line_share": _SHARES,
    "upper_share": _SHARES,
    "digit_share": _SHARES,
    "shout_share": _SHARES,
    "bar_share": _SHARES,
    "new_word_share": _SHARES,
}


def let(value: Column, body) -> Column:
    """Compute ``value`` once and use it as a lambda variable (``F.get`` of a
    one-element transform)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words inside ``window``-word runs that occur twice or more in
    the array, the first occurrence included."""
    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(placed, lambda p: F.filter(p, lambda s, k: (
            (F.get(p, k - 1)["h"] == s["h"]) | (F.get(p, k + 1)["h"] == s["h"]))))
        starts = F.sort_array(F.transform(twice, lambda s: s["i"]))
        gaps = let(starts, lambda q: F.transform(q, lambda x, k: F.least(
            F.lit(window), F.coalesce(F.get(q, k + 1) - x, F.lit(window)))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    grams = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.slice(
        F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, window)])),
        F.lit(1), F.greatest(F.size(h) - (window - 1), F.lit(0))))
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long"))
               .otherwise(covered(g)))


def count_of(text: Column, characters: str) -> Column:
    """How often the (ASCII) characters occur: bytes lost when they are taken
    out one by one, which beats a pass of ``translate``."""
    gone = F.octet_length(text)
    each = [gone - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters]
    return reduce(lambda a, b: a + b, each)


def statistics(text: str | Column) -> Column:
    """A struct of counts and shares of one text column."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))

    def lines(t: Column) -> Column:
        filled = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        return let(filled, lambda f: F.struct(
            F.size(f).cast("long").alias("n"),
            (F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("dup")))

    counts = let(common.blank_words(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_new")))
    raw = let(F.struct(counts.alias("c"), lines(t).alias("l")), lambda x: F.struct(
        x["c"]["n_words"].alias("n_words"),
        (F.char_length(t) - count_of(t, common.BLANKS)).cast("long").alias("word_chars"),
        count_of(t, SYMBOLS).cast("long").alias("n_symbols"),
        x["l"]["dup"].alias("n_dup_lines"), x["c"]["n_repeat_words"].alias("n_repeat_words"),
        x["c"]["n_new"].alias("n_new"), x["l"]["n"].alias("n_lines"),
        F.regexp_count(t, F.lit("[A-Z]")).alias("n_upper"), F.regexp_count(t, F.lit("[0-9]")).alias("n_digits"),
        count_of(t, "!").alias("n_shouts"), count_of(t, "|").alias("n_bars")))

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return let(raw, lambda r: F.struct(
        r["n_words"].alias("n_words"), r["word_chars"].alias("word_chars"), r["n_symbols"].alias("n_symbols"),
        r["n_dup_lines"].alias("n_dup_lines"), r["n_repeat_words"].alias("n_repeat_words"),
        share(r["word_chars"], r["n_words"]).alias("word_length"),
        share(r["n_symbols"], r["word_chars"]).alias("symbol_share"),
        share(r["n_repeat_words"], r["n_words"]).alias("repeat_share"),
        share(r["n_dup_lines"], r["n_lines"]).alias("dup_line_share"),
        share(r["n_upper"], r["word_chars"]).alias("upper_share"),
        share(r["n_digits"], r["word_chars"]).alias("digit_share"),
        share(r["n_shouts"], r["n_words"]).alias("shout_share"),
        share(r["n_bars"], r["n_words"]).alias("bar_share"),
        share(r["n_new"], r["n_words"]).alias("new_word_share")))


def measured(docs: DataFrame, text: str, name: str) -> DataFrame:
    """The rows with their statistics as a struct column.  A generator makes it,
    so that neither filters nor later columns compute it a second time."""
    return docs.select("*", F.explode(F.array(statistics(text))).alias(name))


def base_failed(s: str) -> Column:
    return (F.col(f"{s}.n_words") < 10) | (100 * F.col(f"{s}.n_repeat_words") > 20 * F.col(f"{s}.n_words"))


@dataclass(frozen=True)
class Literal:
    """``feature > threshold`` or ``feature <= threshold``."""

    feature: str
    above: bool
    threshold: float

    def column(self, prefix: str = "") -> Column:
        c = F.col(prefix + self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Literal, ...]


def condition(rule: Rule, prefix: str = "") -> Column:
    return reduce(lambda a, b: a & b, (x.column(prefix) for x in rule))


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """Number of the first rule that covers a row, null if none does: the
    ordered conditional expression of the list."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(condition(rule, prefix), F.lit(k)) if out is None else out.when(condition(rule, prefix), F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def passed(feature: str, thresholds: list[float]) -> Column:
    """The thresholds that a feature's value exceeds."""
    return F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col(feature) > t)


def _table(cases: DataFrame, grid: dict[str, list[float]]) -> dict[str, dict[int, tuple[int, int]]]:
    """feature -> bin -> (rejected, kept): one grouped count.  Bin ``i`` holds the
    values over threshold ``i - 1`` and up to threshold ``i``."""
    bins = F.array(*[F.struct(F.lit(f).alias("f"), F.size(passed(f, ts)).alias("b")) for f, ts in grid.items()])
    rows = (cases.select("bad", "weight", F.explode(bins).alias("x")).groupBy("x.f", "x.b")
            .agg(F.sum(F.when(F.col("bad"), F.col("weight")).otherwise(0)).alias("p"),
                 F.sum(F.when(F.col("bad"), 0).otherwise(F.col("weight"))).alias("n")).collect())
    out: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in grid}
    for r in rows:
        out[r["f"]][r["b"]] = (int(r["p"]), int(r["n"]))
    return out


def best_literal(table: dict, grid: dict[str, list[float]], p0: int, n0: int, min_cover: int):
    """The literal with the largest gain in a table of counts.  Neighbouring
    thresholds that part the rows alike tie: the middle one is taken, which
    leaves the widest margin on both sides; other ties go by grid order."""
    start = math.log2(p0 / (p0 + n0)) if p0 else 0.0
    best: list[Literal] = []
    gain, counts = 1e-9, (0, 0)
    for f, ts in grid.items():
        low_p = low_n = 0
        for i, t in enumerate(ts):
            p, n = table[f].get(i, (0, 0))
            low_p, low_n = low_p + p, low_n + n
            for above, p1, n1 in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                if p1 < min_cover:
                    continue
                g = p1 * (math.log2(p1 / (p1 + n1)) - start)
                if g > gain + 1e-12:
                    best, gain, counts = [Literal(f, above, t)], g, (p1, n1)
                elif best and best[-1].feature == f and best[-1].above == above and counts == (p1, n1):
                    best.append(Literal(f, above, t))
    return (best[len(best) // 2], *counts) if best else None


def learn(cases: DataFrame, *, grid: dict[str, list[float]] | None = None, max_rules: int = MAX_RULES,
          max_literals: int = MAX_LITERALS, min_precision: float = MIN_PRECISION,
          min_cover: int = MIN_COVER) -> list[Rule]:
    """Rules for ``bad`` from rows (bad boolean, prune boolean, one column per
    feature)."""
    grid = grid or GRID
    # Rows that no literal tells apart count as one with a weight.
    cells = [F.coalesce(F.array_max(passed(f, ts)) + F.lit(1e-9), F.lit(float(ts[0]))).alias(f)
             for f, ts in grid.items()]
    left = common.cut(cases.select("bad", "prune", *cells).groupBy("bad", "prune", *grid)
                      .agg(F.count(F.lit(1)).alias("weight")))
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule: Rule = ()
        grown = left.where("NOT prune")
        for _ in range(max_literals):
            table = _table(grown, grid)
            one = next(iter(table.values()))
            p0, n0 = (sum(x[k] for x in one.values()) for k in (0, 1))
            found = best_literal(table, grid, p0, n0, min_cover)
            if not found:
                break
            literal, _, n1 = found
            rule, grown = (*rule, literal), grown.where(literal.column())
            if n1 == 0:
                break
        if not rule:
            break
        # Worth of every prefix of the rule on the pruning fold, in one aggregate.
        sums = []
        for k in range(1, len(rule) + 1):
            hit = condition(rule[:k])
            sums += [F.sum(F.when(hit & F.col("bad"), F.col("weight")).otherwise(0)).alias(f"p{k}"),
                     F.sum(F.when(hit & ~F.col("bad"), F.col("weight")).otherwise(0)).alias(f"n{k}")]
        row = left.where("prune").agg(*sums).first()
        worth = [((row[f"p{k}"] or 0), (row[f"n{k}"] or 0)) for k in range(1, len(rule) + 1)]
        keep = max(range(len(rule)), key=lambda k: ((worth[k][0] - worth[k][1]) / (sum(worth[k]) or 1), worth[k][0], -k))
        p, n = worth[keep]
        if p < min_cover or p < min_precision * (p + n):
            break
        rules.append(rule[:keep + 1])
        left = left.where(~condition(rules[-1]))
    return rules


def labelled_cases(stats: DataFrame, labels: DataFrame, doc_id: str, name: str) -> DataFrame:
    """Training rows from measured documents and a label table (a join of narrow
    rows; texts don't move)."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col(doc_id), (F.col("quality") == 0).alias("bad"))
    rows = stats.where(~base_failed(name)).select(doc_id, *[F.col(f"{name}.{f}").alias(f) for f in GRID])
    return rows.join(known, doc_id).withColumn("prune", F.pmod(F.xxhash64(doc_id), F.lit(3)) == 0).drop(doc_id)


def fit_measured(stats: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", name: str = "quality_stats",
                 **options) -> list[Rule]:
    """Learn the list from a table (doc_id, statistics struct)."""
    return learn(labelled_cases(stats, labels, doc_id, name), **options)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> list[Rule]:
    """Learn the list from all labelled documents."""
    slim = docs.select(F.col(doc_id), F.col(text).alias("text"))
    return fit_measured(measured(slim, "text", "quality_stats").drop("text"), labels, doc_id=doc_id, **options)


def judge_measured(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows with ``quality_stats`` plus ``quality_rule``, ``base_failed`` and ``kept``."""
    rule = verdict(rules, "quality_stats.")
    return stats.withColumns({"quality_rule": rule, "base_failed": base_failed("quality_stats")}).withColumn(
        "kept", ~F.col("base_failed") & F.col("quality_rule").isNull())


def judge(docs: DataFrame, rules: list[Rule], *, text: str = "text") -> DataFrame:
    """Every row with the struct columns ``quality_stats`` and ``quality_rule``
    (number of the rule that rejects it, null: none), ``base_failed`` and
    ``kept``; columns of these names are replaced."""
    own = ("quality_stats", "quality_rule", "base_failed", "kept")
    slim = docs.drop(*[c for c in docs.columns if c.lower() in own and c != text])
    return judge_measured(measured(slim, text, "quality_stats"), rules)


def keep_good(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
              train_docs: DataFrame | None = None, **options) -> DataFrame:
    """The documents that the rules keep, same columns."""
    rules = fit(train_docs if train_docs is not None else docs, labels, doc_id=doc_id, text=text, **options)
    mark = common.fresh(docs, stem="quality_mark")
    judged = measured(docs, text, mark)
    good = ~base_failed(mark) & verdict(rules, f"{mark}.").isNull()
    return judged.where(good).select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    # Measured once: the narrow statistics serve learning and judging.
    stats = common.cut(measured(docs, "text", "quality_stats").drop("text"))
    rules = fit_measured(stats, common.read(spark, sf_dir, "labels", "doc_id", "quality"))
    s = "quality_stats"
    return judge_measured(stats, rules).select(
        "doc_id", *[F.col(f"{s}.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                         "n_repeat_words")], "base_failed", "kept")
