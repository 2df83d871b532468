"""Similarity operators.

Similarity of two texts is ``1 - levenshtein / max(bytes)`` on their normal
forms (distance in code points, denominator in bytes, as the reference).

Joins of two tables never enumerate all pairs.  :func:`similarity_join` is exact pigeonhole
blocking.  Let X be the text of a pair with more bytes: at similarity >= tau the other
text Y is within ``k = floor((1 - tau) * bytes(X))`` edits, whatever its characters.  X is
cut into disjoint segments of q characters, q being the largest that gives more than
``k`` of them.  An edit destroys one segment at most, so at least ``segments - k`` stand
in Y, each no further from its place than the edits on its left and right allow.  Segments
meet Y's q-grams in an equi-join on (q, gram, class of length); a pair whose surviving
segments are too few is dropped, and the rest is verified with Spark's thresholded
``levenshtein``.

Where one side is small (a pattern library), every task gets it and scans its texts of the
other side for segments, many texts at once (``window_scan``): they are not shuffled.

:func:`near_texts` joins a table with itself.  Common grams made that shuffle grow with the
square of the table; it deals texts to cells by length and tests all pairs there.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import edit_pairs
from .window_scan import Library
from ..functions.text import col, let, normalize_text, words
from ..session import ensure_checkpoint_dir

QS = (8, 7, 6, 5, 4, 3, 2, 1)  # segment sizes tried, largest first
CLASS = 0.18  # lengths of one class differ by less than this in their logarithms
#: Texts, and bytes in them, of a side that every task gets at most.
BROADCAST_TEXTS, BROADCAST_BYTES = 10_000, 8 << 20
#: Stretches of lengths (difference of logarithms) that cells are made of, and texts and bytes of a cell;
#: with more than CELLS times as many texts, a cell gets more of them, up to its bytes.
STRETCH, CELL_TEXTS, CELL_BYTES, CELLS = 0.02, 120_000, 12 << 20, 16


def similarity(a, b) -> Column:
    """V1 on raw texts."""
    x, y = col(a), col(b)
    m = F.greatest(F.octet_length(x), F.octet_length(y))
    return F.when(m == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(x, y).cast("double") / m)


def normalized_similarity(a, b) -> Column:
    return similarity(normalize_text(a), normalize_text(b))


def word_jaccard(a, b) -> Column:
    """Jaccard of distinct normalised words; both empty -> 1."""
    wa = F.array_distinct(words(normalize_text(a)))
    wb = F.array_distinct(words(normalize_text(b)))
    inter = F.size(F.array_intersect(wa, wb))
    union = F.size(F.array_union(wa, wb))
    return (F.when((F.size(wa) == 0) & (F.size(wb) == 0), F.lit(1.0))
            .when(union == 0, F.lit(0.0)).otherwise(inter.cast("double") / union))


def word_cosine(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """V2 relationally: (key, cosine) from word frequencies.  One shuffle on
    (key, word) with map-side partial counts, then a per-key sum; a huge text
    spreads over as many groups as it has distinct words."""
    wa = pairs.select(key, F.explode(words(normalize_text(a))).alias("w"), F.lit(1).alias("sa"),
                      F.lit(0).alias("sb"))
    wb = pairs.select(key, F.explode(words(normalize_text(b))).alias("w"), F.lit(0).alias("sa"),
                      F.lit(1).alias("sb"))
    tf = wa.unionByName(wb).groupBy(key, "w").agg(F.sum("sa").alias("ca"), F.sum("sb").alias("cb"))
    agg = tf.groupBy(key).agg(
        F.sum(F.col("ca") * F.col("cb")).cast("double").alias("dot"),
        F.sum(F.col("ca") * F.col("ca")).cast("double").alias("na"),
        F.sum(F.col("cb") * F.col("cb")).cast("double").alias("nb"))
    cos = F.when((F.col("na") == 0) | (F.col("nb") == 0), F.lit(0.0)).otherwise(
        F.col("dot") / (F.sqrt("na") * F.sqrt("nb")))
    return pairs.select(key).join(agg.select(key, cos.alias("word_cosine")), key, "left") \
        .fillna({"word_cosine": 0.0})


#: Characters of texts that a task compares with their neighbours.
NEIGHBOUR_CHARS = 4 << 20
#: What a pair's values are made of: edit distances and bytes of the longer text, as they are and in
#: normal form, common and all distinct words, and the parts of the cosine.
PAIR = ("d", "m", "nd", "nm", "common", "distinct", "dot", "na", "nb")


def _pair_parts(pairs: list) -> list[tuple]:
    """``PAIR`` of each ((text, normal form), (text, normal form)); null texts have words of none."""
    def largest(x, y):
        return max(len(t.encode("utf-8", "surrogatepass")) for t in (x, y))

    @functools.lru_cache(2)
    def counted(n):
        return Counter(w for w in (n or "").split(" ") if w)

    whole = [p for p in pairs if None not in p[0] + p[1]]
    sides = [(a[i], b[i]) for a, b in whole for i in (0, 1)]
    distances = iter(edit_pairs.distances(list(dict.fromkeys(sides))))
    found, out = dict(zip(dict.fromkeys(sides), distances)), []
    for (ta, na), (tb, nb) in pairs:
        ca, cb = counted(na), counted(nb)
        values = (None,) * 6
        if None not in (ta, tb):
            common = len(ca.keys() & cb.keys())
            values = (found[ta, tb], largest(ta, tb), found[na, nb], largest(na, nb), common, len(ca) + len(cb) - common)
        few, many = (ca, cb) if len(ca) < len(cb) else (cb, ca)
        out.append((*values, sum(k * many[w] for w, k in few.items()), *(sum(k * k for k in c.values()) for c in (ca, cb))))
    return out


def next_similarity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """V1, V2 and X2 of each text and the next one by id: (id, similarity,
    normalized_similarity, word_jaccard, word_cosine).

    Texts are dealt once, by ranges of ids; a task goes through its texts in order, and the
    last one of a range meets the first one of the next range afterwards.  Edit distances
    (the square of a text's length) are taken by bit vectors, many pairs at once
    (``edit_pairs.distances``).  Rows that share an id share their words, as in
    :func:`word_cosine`, which is used for them alone."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id is not null")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chars = rows.agg(F.sum(F.char_length("t"))).first()[0] or 0
    ranges = rows.repartitionByRange(max(tasks, chars // NEIGHBOUR_CHARS), "id").sortWithinPartitions("id") \
        .select("id", "t", normalize_text("t").alias("n"), F.spark_partition_id().alias("part"))
    names = ["id", "part", "edge", "again", "t", "n", "t2", "n2", *PAIR]
    schema = (f"id {kind}, part int, edge int, again boolean, t string, n string, t2 string, n2 string, "
              + ", ".join(f"{c} bigint" for c in PAIR))
    none = (None,) * len(PAIR)

    def rows_of(ids, parts, again, pairs):
        # the normal forms of rows that share an id are kept for their words
        return [(i, p, 0, g, None, a[1] if g else None, None, b[1] if g else None, *v)
                for i, p, g, (a, b), v in zip(ids, parts, again, pairs, _pair_parts(pairs))]

    def frame(found):
        return pd.DataFrame(found, columns=names, dtype=object)

    def neighbours(batches):
        held, before, part = None, None, None  # the last row, and the id of the one before it
        for batch in batches:
            ids, parts, again, pairs, edges = [], [], [], [], []
            for i, t, n, part in zip(batch["id"], batch["t"], batch["n"], batch["part"]):
                if held is None:
                    edges.append((i, part, 1, False, t, n, None, None, *none))
                else:
                    ids.append(held[0])
                    parts.append(part)
                    again.append(held[0] in (i, before))
                    pairs.append((held[1:], (t, n)))
                    before = held[0]
                held = (i, t, n)
            yield frame(edges + rows_of(ids, parts, again, pairs))
        if held is not None:
            yield frame([(held[0], part, 2, held[0] == before, *held[1:], None, None, *none)])

    def across(batches):
        for b in batches:
            yield frame(rows_of(b["id"], b["part"], b["again"], list(zip(zip(b["t"], b["n"]), zip(b["t2"], b["n2"])))))

    ensure_checkpoint_dir(docs.sparkSession)
    inner = ranges.mapInPandas(neighbours, schema).checkpoint()
    used = [r["part"] for r in inner.where("edge = 1").select("part").orderBy("part").collect()]  # one per range
    first = inner.where("edge = 1").select(F.col("part").alias("next"), F.col("t").alias("t2"), F.col("n").alias("n2"))
    later = F.create_map(*[F.lit(x) for p in zip(used, used[1:]) for x in p]) if len(used) > 1 else F.lit(None).cast("map<int,int>")
    edges = inner.where("edge = 2").drop("t2", "n2").withColumn("next", F.element_at(later, F.col("part"))).join(first, "next") \
        .select(*names).mapInPandas(across, schema)
    found = inner.where("edge = 0").unionByName(edges).checkpoint()

    def ratio(d, m):
        return F.when(F.col(m) == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.col(d).cast("double") / F.col(m))

    cosine = F.when((F.col("na") == 0) | (F.col("nb") == 0), F.lit(0.0)).otherwise(
        F.col("dot").cast("double") / (F.sqrt(F.col("na").cast("double")) * F.sqrt(F.col("nb").cast("double"))))
    out = found.select(
        "id", ratio("d", "m").alias("similarity"), ratio("nd", "nm").alias("normalized_similarity"),
        F.when(F.col("distinct") == 0, F.lit(1.0)).otherwise(F.col("common").cast("double") / F.col("distinct")).alias("word_jaccard"),
        cosine.alias("word_cosine"), "again")
    shared = found.where("again")
    one = out.where("not again").drop("again")
    if not shared.isEmpty():
        one = one.unionByName(out.where("again").drop("again", "word_cosine").join(word_cosine(shared, "id", "n", "n2"), "id"))
    return one.withColumnRenamed("id", id_col)


# ----------------------------------------------------------- R3 blocking

def edit_bound(nbytes, tau: float) -> Column:
    """Largest edit distance from a text of ``nbytes`` bytes to one of no more bytes
    at similarity >= tau."""
    return F.floor(col(nbytes).cast("double") * (1.0 - tau) + 1e-9).cast("int")


def segment_size(chars, k, largest: int = QS[0]) -> Column:
    """Largest segment size up to ``largest`` that leaves more than ``k`` disjoint
    segments (null: none)."""
    q = F.lit(None).cast("int")
    for size in (s for s in reversed(QS) if s <= largest):
        q = F.when(F.floor(col(chars) / size) >= col(k) + 1, F.lit(size)).otherwise(q)
    return q


def grams_at(chars, offsets, q) -> Column:
    """The q characters from each offset; ``chars`` is the text's array of characters,
    as cutting a string by position costs as much as the position."""
    size = F.lit(q) if isinstance(q, int) else col(q)
    return let(chars, lambda c: F.transform(offsets, lambda o: F.array_join(F.slice(c, o + 1, size), "")))


def length_class(chars) -> Column:
    return F.floor(F.log(F.greatest(col(chars), F.lit(1)).cast("double")) / CLASS).cast("int")


def _profile(df: DataFrame, id_col: str, text_col: str, tau: float) -> DataFrame:
    """(id, t, L chars, B bytes, k, q); texts without a q are only compared by length."""
    p = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")) \
        .withColumn("L", F.char_length("t")).withColumn("B", F.octet_length("t")) \
        .withColumn("k", edit_bound("B", tau))
    return p.withColumn("q", segment_size("L", "k"))


def _candidates(xs: DataFrame, ys: DataFrame, order: Column) -> DataFrame:
    """(xid, yid) of the pairs that may be similar, among those that ``order`` lets
    through (over xid, xB, yid, yB); X has no fewer bytes than Y."""
    used = sorted(r["q"] for r in xs.select("q").distinct().collect() if r["q"] is not None)  # of QS
    near = (order & (F.abs(F.col("pos") - F.col("off"))
                     + F.abs((F.col("xL") - F.col("off")) - (F.col("yL") - F.col("pos"))) <= F.col("k")))
    pairs = []
    for size in used:
        places = F.transform(F.sequence(F.lit(0), F.floor(F.col("L") / size).cast("int") - 1), lambda j: j * size)
        segments = xs.where(F.col("q") == size).select(
            F.col("id").alias("xid"), F.col("L").alias("xL"), F.col("B").alias("xB"), "k",
            F.posexplode_outer(grams_at(F.split("t", ""), places, size)).alias("j", "gram"))
        segments = segments.select(
            "xid", "xL", "xB", "k", "j", (F.col("j") * size).alias("off"), "gram", F.explode(F.sequence(
                length_class(F.col("xL") - F.col("k")), length_class(F.col("xL") + F.col("k")))).alias("class"))
        grams = ys.where(F.col("L") >= size).select(
            F.col("id").alias("yid"), F.col("L").alias("yL"), F.col("B").alias("yB"), length_class("L").alias("class"),
            F.posexplode_outer(grams_at(F.split("t", ""), F.sequence(F.lit(0), F.col("L") - size), size)).alias("pos", "gram"))
        hits = segments.join(grams, ["gram", "class"]).where(near)
        pairs.append(hits.groupBy("xid", "yid", (F.floor(F.col("xL") / size) - F.col("k")).alias("need"))
                     .agg(F.countDistinct("j").alias("found")).where("found >= need").select("xid", "yid"))
    # texts with k >= L (the empty one, or a low tau): equi-join on the lengths they allow
    x = xs.where(F.col("q").isNull()).select(F.col("id").alias("xid"), F.col("B").alias("xB"), F.explode(
        F.sequence(F.greatest(F.col("L") - F.col("k"), F.lit(0)), F.col("L") + F.col("k"))).alias("yL"))
    y = ys.select(F.col("id").alias("yid"), F.col("B").alias("yB"), F.col("L").alias("yL"))
    pairs.append(x.join(y, "yL").where(order).select("xid", "yid"))
    return functools.reduce(DataFrame.unionByName, pairs)


def _verified(pairs: DataFrame, xs: DataFrame, ys: DataFrame, tau: float, strict: bool) -> DataFrame:
    """(xid, yid, similarity) of the pairs that reach tau."""
    a = xs.select(F.col("id").alias("xid"), F.col("t").alias("tx"), F.col("B").alias("xB"), "k")
    b = ys.select(F.col("id").alias("yid"), F.col("t").alias("ty"))
    # thresholded distance (banded DP; -1 beyond the bound); the Python
    # helper only takes a literal threshold, the SQL function takes a column
    v = pairs.join(a, "xid").join(b, "yid").withColumn("d", F.call_function("levenshtein", "tx", "ty", "k"))
    sim = F.when(F.col("xB") == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.col("d").cast("double") / F.col("xB"))
    v = v.where("d >= 0").select("xid", "yid", sim.alias("similarity"))
    return v.where(F.col("similarity") > tau if strict else F.col("similarity") >= tau)


def _small(p: DataFrame) -> bool:
    n, size = p.agg(F.count(F.lit(1)), F.sum("B")).first()
    return n <= BROADCAST_TEXTS and (size or 0) <= BROADCAST_BYTES


def _scanned(big: DataFrame, small: DataFrame, tau: float, strict: bool) -> DataFrame:
    """(id, sid, similarity) of the pairs that reach tau, of profiles ``big`` and
    ``small``, which every task gets (``window_scan``)."""
    rows = small.where("id is not null and t is not null").select("id", "t").collect()  # size checked
    kinds = [df.schema["id"].dataType for df in (big, small)]
    ids = pa.array([r["id"] for r in rows], to_arrow_type(kinds[1]))
    library = Library([r["t"] for r in rows], tau, whole=True)

    def scanned(batches):
        for b in batches:
            found = library.matches(b.column("t").to_pylist())
            own, other = (pa.array([m[k] for m in found], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("id").take(own), ids.take(other), pa.array([m[3] for m in found], pa.float64())],
                                             names=["id", "sid", "similarity"])

    v = big.where("id is not null and t is not null").select("id", "t") \
        .mapInArrow(scanned, "id {}, sid {}, similarity double".format(*[k.simpleString() for k in kinds]))
    return v.where(F.col("similarity") > tau) if strict else v


def similarity_join(left: DataFrame, right: DataFrame, tau: float, left_id: str = "id",
                    right_id: str = "id", left_text: str = "text", right_text: str = "text",
                    strict: bool = False) -> DataFrame:
    """All pairs (lid, rid, similarity) with similarity >= tau (> tau when
    ``strict``) over the *given* texts (normalise them first for normalised
    similarity).  Exact; see the module docstring.  Ids must be unique."""
    lp, rp = (_profile(*side, tau) for side in ((left, left_id, left_text), (right, right_id, right_text)))
    names = (left_id, right_id) if left_id != right_id else ("lid", "rid")
    if tau > 0 and _small(rp):
        return _scanned(lp, rp, tau, strict).select(F.col("id").alias(names[0]), F.col("sid").alias(names[1]), "similarity")
    if tau > 0 and _small(lp):
        return _scanned(rp, lp, tau, strict).select(F.col("sid").alias(names[0]), F.col("id").alias(names[1]), "similarity")
    lp, rp = lp.cache(), rp.cache()
    more, less = F.col("yB") <= F.col("xB"), F.col("yB") < F.col("xB")
    one = _verified(_candidates(lp, rp, more), lp, rp, tau, strict)
    other = _verified(_candidates(rp, lp, less), rp, lp, tau, strict)
    return one.select(F.col("xid").alias(names[0]), F.col("yid").alias(names[1]), "similarity").unionByName(
        other.select(F.col("yid").alias(names[0]), F.col("xid").alias(names[1]), "similarity"))


def _cells(texts: DataFrame, tau: float) -> DataFrame:
    """(cell, home, t): every text in its home and as a visitor in each cell with texts of
    fewer bytes (or of as many) that its length allows.  Cells are stretches of lengths,
    cut by hash where one length has too much; their sizes are counted first."""
    def stretch(nbytes: Column) -> Column:
        return F.floor(F.log(F.greatest(nbytes, F.lit(1)).cast("double")) / STRETCH).cast("int")

    p = texts.withColumn("B", F.octet_length("t")).withColumn("L", F.char_length("t")).withColumn("s", stretch(F.col("B")))
    sizes = p.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("B").alias("B")).orderBy("s").collect()  # some 100 a decade
    most = max(CELL_TEXTS, sum(r["n"] for r in sizes) // CELLS)
    cells, n, nbytes = [], 0, 0  # (first cell, last, parts) of each stretch
    for r in sizes:
        parts = max(1, -(-r["n"] // most), -(-r["B"] // CELL_BYTES))
        n, nbytes = n + r["n"], nbytes + r["B"]
        if not cells or parts > 1 or cells[-1][2] > 1 or n > most or nbytes > CELL_BYTES:
            cells.append((cells[-1][0] + cells[-1][2] if cells else 0, r["s"], parts))
            n, nbytes = r["n"], r["B"]
    if not cells:
        return texts.select(F.lit(0).alias("cell"), F.lit(True).alias("home"), "t")
    table = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("cell", "s", "parts"), row)]) for row in cells])

    def upto(s) -> Column:  # how many groups begin at or below a stretch
        return F.size(F.filter(table, lambda g: g.s <= s))

    at = F.get(table, upto(F.col("s")) - 1)
    lowest = F.greatest(upto(stretch(F.greatest(F.col("L") - edit_bound("B", tau), F.lit(0)))) - 1, F.lit(0))
    p = p.withColumn("own", at).withColumn("low", F.get(table, lowest)) \
        .withColumn("mine", (F.col("own.cell") + F.pmod(F.xxhash64("t"), F.col("own.parts").cast("long"))).cast("int"))
    cell = F.explode(F.sequence(F.col("low.cell"), F.col("mine"))).alias("cell")
    return p.select("t", "mine", cell).select("cell", (F.col("cell") == F.col("mine")).alias("home"), "t")


def near_texts(texts: DataFrame, tau: float, text_col: str = "text") -> DataFrame:
    """(a, b, similarity): every pair of different texts at similarity >= tau once, as
    SHA-256 of the texts.  Texts may repeat.

    All pairs whose lengths allow it meet, in the home of the one with fewer bytes, and are
    tested there (``edit_pairs``): only texts are dealt, neither grams nor candidates.  The work
    grows with the square of the texts of like length; the rows dealt grow with the texts, as
    cells do, until cells have ``CELL_BYTES``."""
    def pairs(key, batch: pd.DataFrame) -> pd.DataFrame:
        one = batch.sort_values("home", ascending=False, kind="stable").drop_duplicates("t")
        cell = edit_pairs.Texts(one["t"].tolist(), one["home"].to_numpy(), tau)
        del batch, one
        name = functools.lru_cache(1 << 16)(lambda i: hashlib.sha256(cell.texts[i].encode()).digest())
        rows = [(name(x), name(y), d, int(cell.nbytes[x])) for x, y, d in cell.pairs()]
        return pd.DataFrame(rows, columns=["a", "b", "distance", "nbytes"])

    cells = _cells(texts.select(F.col(text_col).alias("t")).where("t is not null"), tau)
    sim = F.lit(1.0) - F.col("distance").cast("double") / F.col("nbytes")
    return cells.groupBy("cell").applyInPandas(pairs, "a binary, b binary, distance int, nbytes int") \
        .select("a", "b", sim.alias("similarity")).where(F.col("similarity") >= tau)


def similar_pairs(texts: DataFrame, tau: float, id_col: str = "id", text_col: str = "text",
                  strict: bool = False) -> DataFrame:
    """Every pair (a, b, similarity) of different rows of one table once."""
    rows = texts.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.col(text_col), 256)).alias("form")).where("form is not null")
    near = near_texts(texts, tau, text_col)
    near = near.where(F.col("similarity") > tau) if strict else near
    x, y = (rows.select(F.col("id").alias(i), F.col("form").alias(f)) for i, f in (("x", "a"), ("y", "b")))
    unlike = near.join(x, "a").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b"), "similarity")
    equal = x.join(y, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))) \
        .select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1.0).alias("similarity"))
    return unlike.unionByName(equal if not strict or tau < 1 else equal.where("false"))


# ------------------------------------------------------- R5 leader rounds

def leader_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Greedy leader clustering in node order, computed in rounds.

    ``nodes``: (node, ord) with a total order; ``edges``: undirected (a, b).
    The sequential scan makes a node a leader iff no earlier leader is its
    neighbour, and gives every other node to its earliest neighbouring
    leader.  Per round, over the undecided nodes:

    * a node with no leader neighbour and no undecided earlier neighbour
      becomes a leader;
    * a node whose earliest leader neighbour (old or new) precedes all its
      still-undecided non-leader neighbours joins that leader.

    The earliest undecided node is always decided, so rounds terminate; each
    round is a few joins over the undecided part only, and lineage is cut with
    ``checkpoint()``.  Returns (node, leader)."""
    e = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) \
        .filter(F.col("a") != F.col("b")).distinct()
    o = nodes.select("node", "ord")
    e = e.join(o.select(F.col("node").alias("b"), F.col("ord").alias("ord_b")), "b").checkpoint()
    state = o.withColumn("leader", F.lit(None).cast(o.schema["node"].dataType)).checkpoint()
    while True:
        undecided = state.filter(F.col("leader").isNull()).select("node", "ord")
        if undecided.isEmpty():
            break
        leaders = state.filter(F.col("leader") == F.col("node")).select(F.col("node").alias("b"))
        und_b = undecided.select(F.col("node").alias("b"))
        touching = e.join(undecided.select(F.col("node").alias("a"), F.col("ord").alias("ord_a")), "a")
        n_und = touching.join(und_b, "b")                                  # undecided neighbours
        n_lead = touching.join(leaders, "b")                               # decided leader neighbours
        blocked = n_und.filter(F.col("ord_b") < F.col("ord_a")).select("a").unionByName(n_lead.select("a"))
        new = undecided.join(blocked.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
        new_b = new.select(F.col("node").alias("b"))
        cand = n_lead.select("a", "b", "ord_b").unionByName(n_und.join(new_b, "b").select("a", "b", "ord_b"))
        best = cand.groupBy("a").agg(F.min(F.struct("ord_b", "b")).alias("best"))
        pending = n_und.join(new_b, "b", "left_anti").groupBy("a").agg(F.min("ord_b").alias("pending"))
        claimed = best.join(pending, "a", "left") \
            .filter(F.col("pending").isNull() | (F.col("best.ord_b") < F.col("pending"))) \
            .join(new.select(F.col("node").alias("a")), "a", "left_anti") \
            .select(F.col("a").alias("node"), F.col("best.b").alias("claim"))
        state = (state.join(new.select("node", F.lit(True).alias("is_new")), "node", "left")
                 .join(claimed, "node", "left")
                 .withColumn("leader", F.coalesce("leader", F.when(F.col("is_new"), F.col("node")), "claim"))
                 .drop("is_new", "claim").checkpoint())
    return state.select("node", "leader")


# --------------------------------------------------------- J5 windows

def best_window(needle_norm, needle_words, hay_words, tau: float, candidates) -> Column:
    """J5 verification for one (pattern, text): among candidate start words
    (array<int>), the window of the needle's word count with the highest
    similarity strictly above tau; the earliest wins ties.  Distances use the
    banded form of ``levenshtein`` bounded by (1 - tau) x max bytes (-1 when
    beyond it, i.e. not a match).  Returns struct<start, end, similarity> or
    null."""
    n = col(needle_words)
    hw = col(hay_words)
    nd = col(needle_norm)

    def score(s):
        def with_window(win):
            mx = F.greatest(F.octet_length(nd), F.octet_length(win))
            bound = F.floor(mx.cast("double") * (1.0 - tau)).cast("int")
            d = F.call_function("levenshtein", nd, win, bound)
            sim = F.when(d >= 0, F.lit(1.0) - d.cast("double") / mx)
            return F.struct(sim.alias("sim"), (-s).alias("neg_start"))
        return let(F.array_join(F.slice(hw, s + 1, n), " "), with_window)

    best = F.array_max(F.filter(F.transform(col(candidates), score),
                                lambda x: x.sim.isNotNull() & (x.sim > tau)))
    return F.when(best.isNull(), F.lit(None)).otherwise(F.struct(
        (-best.neg_start).alias("start"), (-best.neg_start + n).alias("end"), best.sim.alias("similarity")))
