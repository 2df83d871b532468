"""Pattern library: mining (A17, J7, F3, W3, P14, P15), fuzzy matching of
library patterns inside prompts (J5, W2, O5, A16, C4) and library upkeep
(F4, J9, A6, O3, J6).

A *library* is a DataFrame (id, content, frequency, avg_tokens, category).
Libraries are small relative to the corpus, but nothing here collects one:
they are joined (broadcast where the size is checked) like any table.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_width, col, let, normalize_text, words
from ..functions.tokens import TokenCounter, approx4
from ..session import ensure_checkpoint_dir
from .similarity import best_window, grams_at, leader_clusters, near_texts, segment_size, similarity_join
from .text_ops import candidates as text_candidates
from .text_ops import categorize
from .window_scan import Library

MIN_FREQUENCY = 2
MIN_SIMILARITY = 0.85
MIN_TOKENS, MAX_TOKENS = 20, 500
#: Normal forms of repeated candidates (their hashes, some 100 bytes each) that are broadcast at most.
BROADCAST_FORMS = 300_000


# ------------------------------------------------------------ mining

def mine_patterns(prompts: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  tau: float = MIN_SIMILARITY, min_frequency: int = MIN_FREQUENCY,
                  min_tokens: int = MIN_TOKENS, max_tokens: int = MAX_TOKENS,
                  counter: TokenCounter = approx4) -> DataFrame:
    """E5 at corpus scale.  Candidates in (prompt, order) sequence are
    collapsed exactly on their normal form (R2), near-duplicates found with
    an exact test of all that lengths allow (R3), grouped by greedy leader clustering (R5),
    then filtered (F3: size >= ``min_frequency``, ``min_tokens`` to
    ``max_tokens`` tokens) and numbered (W3).  ``frequency`` counts candidates,
    ``n_prompts`` their prompts."""
    ensure_checkpoint_dir(prompts.sparkSession)
    # a normal form is known by its SHA-256; the total order of candidates is the scan order
    cands = text_candidates(prompts, id_col, text_col) \
        .withColumn("ord", F.struct(F.col(id_col), F.col("kind"), F.col("i"))) \
        .withColumn("form", F.unhex(F.sha2("normalized", 256)))
    edges = near_texts(cands, tau, "normalized").select("a", "b").checkpoint()
    linked = edges.select(F.explode(F.array("a", "b")).alias("form")).distinct().withColumn("linked", F.lit(True))
    # a form that is too rare on its own counts only if it has a neighbour
    forms = cands.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord")) \
        .join(linked, "form", "left").where(F.col("linked") | (F.col("n") >= min_frequency)).checkpoint()
    clusters = leader_clusters(forms.where("linked").select(F.col("form").alias("node"), "ord"), edges)
    labelled = forms.join(clusters, F.col("form") == F.col("node"), "left") \
        .select("form", "n", F.coalesce("leader", "form").alias("leader"))
    often = labelled.groupBy("leader").agg(F.sum("n").alias("frequency")).where(F.col("frequency") >= min_frequency)
    wanted = labelled.join(often, "leader").select("form", "leader").checkpoint()
    # few against the candidates, whose texts are then not shuffled for them
    members = cands.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_FORMS else wanted, "form")
    # canonical = longest member; on equal length the last in scan order
    groups = members.groupBy("leader").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.countDistinct(id_col).alias("n_prompts"),
        F.max(F.struct(F.octet_length("content").alias("bytes"), "ord", "content")).alias("canon"),
        F.min("ord").alias("first"))
    kept = (groups.filter(F.col("frequency") >= min_frequency)
            .withColumn("content", F.col("canon.content"))
            .withColumn("avg_tokens", counter(F.col("content")))
            .filter(F.col("avg_tokens").between(min_tokens, max_tokens))
            .withColumn("category", categorize("content")))
    return numbered(kept, "first", "n").select(
        F.format_string("%s_%03d", "category", "n").alias("id"), "content", "frequency", "avg_tokens", "category",
        "n_prompts")


def numbered(df: DataFrame, by: str, out: str) -> DataFrame:
    """Number the rows 1, 2, ... in the order of ``by``, without sending them
    through one task: ranges are sorted on their own, and a range's numbers
    begin after the counts of those before it."""
    ensure_checkpoint_dir(df.sparkSession)
    ranges = df.repartitionByRange(by).sortWithinPartitions(by) \
        .withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part, place = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranges.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row per range
    begins, total = [], 0
    for r in counts:
        begins += [F.lit(r["part"]), F.lit(total)]
        total += r["count"]
    begin = F.element_at(F.create_map(*begins), part) if begins else F.lit(0)
    return ranges.withColumn(out, begin + place + 1).drop("_at")


# ------------------------------------------------------- library upkeep

def library_statistics(lib: DataFrame) -> DataFrame:
    """A6 per category and overall (``is_total``): count, token sum and integer
    mean, in one grouping-sets pass; a null category is a category of its own."""
    return lib.rollup("category").agg(
        (F.grouping_id() == 1).alias("is_total"),
        F.count(F.lit(1)).alias("total_patterns"),
        F.sum("avg_tokens").cast("long").alias("total_tokens")) \
        .withColumn("avg_tokens_per_pattern",
                    F.floor(F.col("total_tokens") / F.col("total_patterns")).cast("long"))


def by_category(lib: DataFrame, category: str) -> DataFrame:
    return lib.filter(F.col("category") == category)


def prune(lib: DataFrame, min_frequency: int) -> DataFrame:
    return lib.filter(F.col("frequency") >= min_frequency)


def merge(lib: DataFrame, other: DataFrame) -> DataFrame:
    """Add the other library's patterns whose id is new."""
    return lib.unionByName(other.join(lib.select("id"), "id", "left_anti"))


def sort_by_frequency(lib: DataFrame) -> DataFrame:
    return lib.orderBy(F.desc("frequency"), "id")


def similar_patterns(lib: DataFrame, texts: DataFrame, tau: float = MIN_SIMILARITY,
                     text_id: str = "text_id", text_col: str = "text") -> DataFrame:
    """For every text, the library patterns with normalised similarity
    >= tau.  (text_id, id, similarity)."""
    a = texts.select(F.col(text_id).alias("lid"), normalize_text(text_col).alias("n"))
    b = lib.select(F.col("id").alias("rid"), normalize_text("content").alias("n"))
    return similarity_join(a, b, tau, "lid", "rid", "n", "n") \
        .select(F.col("lid").alias(text_id), F.col("rid").alias("id"), "similarity")


# ------------------------------------------------------ J5 fuzzy matches

#: Segments of a library that every task gets at most (some 30 MB); beyond it they are shuffled.
BROADCAST_SEGMENTS = 200_000
#: Largest segment: shorter ones meet more often, but more of them must be found together.
LARGEST = 5
#: Parts that a common gram's rows are split into when segments are shuffled.
SPLITS = 16
#: Characters of a bucket of window starts, and words whose windows are verified together.
BUCKET, CHUNK = 64, 128
#: Buckets of diagonals that k + 1 neighbours are cut into, and characters of prompts that a task takes.
SLICES, PIECE = 2, 1 << 20


def _window_bound(nbytes, tau: float, width: int) -> Column:
    """Largest edit distance of a pattern of ``nbytes`` bytes to a window whose
    characters have at most ``width`` bytes, at similarity > tau."""
    slack = 1.0 - (1.0 - tau) * width
    if slack <= 0:
        raise ValueError("threshold too low for exact matching in texts with characters of so many bytes")
    return F.floor(col(nbytes).cast("double") * (1.0 - tau) / slack + 1e-9).cast("int")


def _may_match(v: Column, start: Column, tau: float) -> Column:
    """Whether the window from word ``start`` of a part ``v`` has as many distinct segments in
    its row of buckets as its own bound on edits asks for."""
    begin = F.get(v.places, start)
    chars = F.get(v.places, start + v.n) - 1 - begin
    nbytes = F.when(v.width == 1, chars).otherwise(F.octet_length(F.array_join(F.slice(v.part, start + 1, v.n), " ")))
    edits = F.least(v.k, F.floor(F.greatest(v.nbytes, nbytes).cast("double") * (1.0 - tau) + 1e-9).cast("int"))
    window = F.struct(begin.alias("begin"), (chars - v.L).alias("delta"), edits.alias("d"))

    def enough(w):
        lowest = F.floor((w.begin + F.ceil((w.delta - w.d) / 2)) / v.step)
        return (F.abs(w.delta) <= w.d) & let(lowest, lambda b: F.exists(v.rows, lambda r: (r.wb == b) & (
            r.found >= F.greatest(v.segs - w.d, F.lit(1)))))

    return let(window, enough)


def _scanned_windows(docs: DataFrame, pat: DataFrame, id_col: str, text_col: str, tau: float) -> DataFrame:
    """(did, pid, m: struct<similarity, back, n>) of the best windows, ``back`` being -start."""
    rows = pat.where("pid is not null").select("pid", "needle", "n").collect()  # size checked
    ids, ns = [r["pid"] for r in rows], [r["n"] for r in rows]
    library = Library([r["needle"] for r in rows], tau)
    hay = docs.select(F.col(id_col).alias("did"), normalize_text(text_col).alias("h")).where("did is not null and h is not null")

    def scanned(batches):
        for b in batches:
            dids = b["did"].tolist()
            yield pd.DataFrame([(dids[i], ids[j], sim, -start, ns[j]) for i, j, start, sim in library.matches(b["h"].tolist())],
                               columns=["did", "pid", "similarity", "back", "n"])

    kinds = hay.schema["did"].dataType.simpleString(), pat.schema["pid"].dataType.simpleString()
    return hay.mapInPandas(scanned, "did {}, pid {}, similarity double, back int, n int".format(*kinds)) \
        .groupBy("did", "pid").agg(F.max(F.struct("similarity", "back", "n")).alias("m"))


def pattern_matches(docs: DataFrame, lib: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    tau: float = MIN_SIMILARITY) -> DataFrame:
    """For every (prompt, pattern) the best window of the pattern's word
    count whose similarity is strictly above tau (earliest on ties), as word
    offsets in the prompt's normal form.

    A library of few segments (``BROADCAST_SEGMENTS``, counted) goes to every task, which
    scans its prompts for all windows at once (``window_scan``): nothing but matches is
    shuffled.  A larger one:

    Exact q-gram count filter: a window within similarity tau is within k
    edits of the pattern, so at least ``floor(L/q) - k`` of the pattern's
    disjoint segments occur verbatim in it.  k depends on the widest character
    of the prompt, so patterns are cut once per width (1 to 4 bytes) that
    prompts have, and each prompt meets the cut for its own.  A window of
    ``delta`` more characters than the pattern, d edits away, moves a segment by x
    with ``|x| + |delta - x| <= d``: the diagonals (position - offset) of its hits
    are among d + 1 neighbours.  Buckets of diagonals are a ``SLICES``-th of k + 1,
    so ``SLICES + 1`` in a row hold them all.  Such a row of buckets with enough
    distinct segments for the pattern's k names candidate start words; each is
    tested again with the d, delta and lowest bucket of its own window, and what
    is left is verified with a banded (thresholded) ``levenshtein``.

    Prompts are dealt by id once, some ``PIECE`` characters to a task, so that
    their hits are counted where they arise.
    The segments are the library's index.  It is dealt by gram, with every gram's
    rows split into ``SPLITS`` parts by prompt, so that a common gram is no single
    task."""
    ensure_checkpoint_dir(docs.sparkSession)
    pat = lib.select(F.col("id").alias("pid"), normalize_text("content").alias("needle")) \
        .withColumn("n", F.size(words("needle"))).filter(F.col("n") > 0) \
        .withColumn("L", F.char_length("needle"))
    if (pat.agg(F.sum("L")).first()[0] or 0) <= LARGEST * BROADCAST_SEGMENTS:
        best = _scanned_windows(docs, pat, id_col, text_col, tau)
        return best.select(F.col("did").alias(id_col), F.col("pid").alias("id"), (-F.col("m.back")).alias("start_word"),
                           (F.col("m.n") - F.col("m.back")).alias("end_word"), F.col("m.similarity").alias("similarity"))
    hay = docs.select(F.col(id_col).alias("did"), normalize_text(text_col).alias("h")) \
        .withColumn("width", char_width("h")).withColumn("hL", F.char_length("h"))
    sizes = hay.groupBy("width").agg(F.sum("hL").alias("chars")).collect()  # widths 1 to 4
    widths = [r["width"] for r in sizes]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hay = hay.repartition(max(tasks, sum(r["chars"] or 0 for r in sizes) // PIECE), "did")
    cut = [pat.withColumn("width", F.lit(w)).withColumn("k", _window_bound(F.octet_length("needle"), tau, w))
           for w in widths]
    if not cut:
        cut = [pat.where("false").withColumn("width", F.lit(1)).withColumn("k", F.lit(0))]
    cut = functools.reduce(DataFrame.unionByName, cut).withColumn("q", F.coalesce(segment_size("L", "k", LARGEST), F.lit(1))) \
        .withColumn("segs", F.floor(F.col("L") / F.col("q")).cast("int")) \
        .withColumn("step", F.ceil((F.col("k") + 1) / SLICES).cast("int")).checkpoint()
    places = F.transform(F.sequence(F.lit(0), F.floor(F.col("L") / F.col("q")).cast("int") - 1), lambda j: j * F.col("q"))
    index = cut.select("pid", "width", "q", "step", F.posexplode_outer(grams_at(F.split("needle", ""), places, "q")).alias("j", "gram")) \
        .withColumn("off", F.col("j") * F.col("q"))

    grams = None
    for r in cut.select("width", "q").distinct().collect():  # at most 4 x len(QS)
        g = hay.where((F.col("width") == r["width"]) & (F.col("hL") >= r["q"])).select(
            "did", "width", F.lit(r["q"]).alias("q"), F.posexplode_outer(grams_at(
                F.split("h", ""), F.sequence(F.lit(0), F.col("hL") - r["q"]), r["q"])).alias("pos", "gram"))
        grams = g if grams is None else grams.unionByName(g)
    if grams is None:
        grams = hay.select("did", "width", F.lit(1).alias("q"), F.lit(0).alias("pos"), F.col("h").alias("gram")).where("false")
    keys = ["width", "q", "gram"]
    parts = F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))).alias("part")
    hits = grams.withColumn("part", F.pmod(F.xxhash64("did"), F.lit(SPLITS)).cast("int")) \
        .join(index.select("*", parts), [*keys, "part"])
    hits = hits.withColumn("b", F.floor((F.col("pos") - F.col("off")) / F.col("step")).cast("long"))
    # distinct segments: a bit each, and those beyond two words of bits are counted as often as they hit
    windows = hits.select("did", "pid", "width", "j", F.explode(F.sequence(F.col("b") - SLICES, F.col("b"))).alias("wb")) \
        .groupBy("did", "pid", "width", "wb").agg(
            *[F.bit_or(F.when(F.floor(F.col("j") / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j") % 64))
                       .otherwise(F.lit(0).cast("long"))).alias(f"bits{w}") for w in (0, 1)],
            F.sum(F.when(F.col("j") >= 128, 1).otherwise(0)).alias("more")) \
        .select("did", "pid", "width", "wb", (F.bit_count("bits0") + F.bit_count("bits1") + F.col("more")).cast("int").alias("found"))
    regions = windows.join(F.broadcast(cut.select("pid", "width", "segs", "step", "k", "n")), ["pid", "width"]) \
        .where("found >= greatest(segs - k, 1)") \
        .select("did", "pid", "width", "n", "wb", "found", (F.col("wb") * F.col("step")).alias("lo"),
                ((F.col("wb") + 1) * F.col("step") - 1 + F.col("k")).alias("hi")).checkpoint()
    # words whose first character lies in a region, found by buckets of places
    with_any = hay.join(regions.select("did").distinct(), "did", "left_semi").withColumn("hw", words("h")) \
        .withColumn("ats", F.concat(F.array(F.lit(0)), let(
            F.split("h", ""), lambda c: F.filter(F.transform(c, lambda x, i: F.when(x == " ", i + 1)), lambda i: i.isNotNull()))))
    begins = with_any.select("did", F.size("hw").alias("W"), F.posexplode_outer("ats").alias("word", "at")) \
        .withColumn("bucket", F.floor(F.col("at") / BUCKET))
    reach = regions.withColumn("bucket", F.explode(F.sequence(
        F.floor(F.greatest("lo", F.lit(0)) / BUCKET), F.floor(F.greatest("hi", F.lit(0)) / BUCKET))))
    found = reach.join(begins, ["did", "bucket"]).where("at between lo and hi and word + n <= W") \
        .groupBy("did", "pid", "width", F.floor(F.col("word") / CHUNK).cast("int").alias("chunk")) \
        .agg(F.collect_set("word").alias("starts"),  # at most CHUNK of them
             F.collect_set(F.struct("wb", "found")).alias("rows"))
    first = F.col("chunk") * CHUNK
    # few rows but much work in each: spread them by number, not by bytes
    spread = found.checkpoint().repartition(tasks).join(F.broadcast(cut), ["pid", "width"]) \
        .join(with_any.select("did", "hw", "hL", "ats"), "did") \
        .select("did", "pid", "needle", "n", "chunk", F.struct(
            "width", "n", "k", "L", "segs", "step", "rows", F.octet_length("needle").alias("nbytes"),
            F.transform("starts", lambda s: s - first).alias("starts"),
            F.slice("hw", first + 1, F.col("n") + CHUNK).alias("part"),
            F.slice(F.concat("ats", F.array(F.col("hL") + 1)), first + 1, F.col("n") + CHUNK + 1).alias("places")).alias("v"))
    best = spread.withColumn("m", let("v", lambda v: let(F.filter(v.starts, lambda s: _may_match(v, s, tau)), lambda starts: F.when(
        F.size(starts) > 0, best_window("needle", "n", v.part, tau, starts))))).filter(F.col("m").isNotNull()) \
        .groupBy("did", "pid").agg(F.max(F.struct("m.similarity", (-F.col("m.start") - F.col("chunk") * CHUNK).alias("back"), "n")).alias("m"))
    start = -F.col("m.back")
    return best.select(F.col("did").alias(id_col), F.col("pid").alias("id"), start.alias("start_word"),
                       (start + F.col("m.n")).alias("end_word"), F.col("m.similarity").alias("similarity"))


def substitute(matches: DataFrame, lib: DataFrame, id_col: str = "doc_id",
               counter: TokenCounter = approx4) -> DataFrame:
    """O5 + A16: matches in start order, overlaps dropped (leftmost, then
    best similarity), one reference per kept match with its token saving
    max(0, tokens(pattern) - tokens("@CATEGORY[id]"))."""
    refs = matches.join(lib.select("id", "content", "category"), "id") \
        .withColumn("original_tokens", counter(F.col("content"))) \
        .withColumn("compressed_tokens", counter(F.format_string("@%s[%s]", F.upper("category"), "id"))) \
        .withColumn("tokens_saved", F.greatest(F.col("original_tokens") - F.col("compressed_tokens"), F.lit(0)))
    ordered = refs.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(
        "start_word", F.negative("similarity").alias("neg_sim"), "id", "end_word", "category",
        "original_tokens", "compressed_tokens", "tokens_saved"))).alias("ms"))
    kept = ordered.withColumn("kept", F.aggregate(
        "ms", F.struct(F.lit(-1).alias("end"), F.array().cast(ordered.schema["ms"].dataType).alias("out")),
        lambda acc, m: F.when(m.start_word >= acc.end, F.struct(
            m.end_word.alias("end"), F.concat(acc.out, F.array(m)).alias("out"))).otherwise(acc),
        lambda acc: acc.out))
    return kept.select(id_col, F.explode("kept").alias("r")).select(
        id_col, "r.id", "r.category", "r.start_word", "r.end_word", "r.original_tokens",
        "r.compressed_tokens", "r.tokens_saved")
