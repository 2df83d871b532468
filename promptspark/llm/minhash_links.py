"""Near-duplicate links from bottom-k sketches.

One hash function gives every distinct word shingle a 64-bit value; a document
keeps its ``k`` smallest ones.  Steps, all Spark jobs over rows:

1. Documents with equal shingle sets fall into one class (grouped by a 128-bit
   signature of the set, partial aggregation first); only class representatives
   go on, so a hot group of exact copies costs one row.  A class goes by a number
   of its own until step 5, so texts that share an id all keep their links.
2. Inverted lists of retained values.  Two sets over the threshold share at
   least ``need`` of their retained values (all but a ``1e-8`` share of pairs;
   sets of at most ``k`` shingles: always), so in rare-first order one shared
   value lies before a document's last ``need - 1`` ones.  Values of passages
   that many documents share come last and drop out by themselves: no cap.
3. Lists of at most ``LIST`` documents give all their pairs.  Longer lists are
   families around their first document: every member is verified against it;
   Jaccard distance is a metric, so members that it does not link are compared
   only with members at a near distance from it, in blocks of bounded size, and
   a block returns a spanning forest of its links, not all its pairs.
4. The union sketch of a pair estimates its similarity and drops what lies far
   below the threshold; the rest is verified on the full sets.
5. Links are contracted to components by rounds of large-star/small-star with
   a checkpoint each.

Defined results: null or blank text has an empty set, links with nothing and is
its own component; fewer than ``size`` words make one shingle; rows that share
an id are one document; a null id is never linked (component null, kept).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

common.by_value(sys.modules[__name__])
common.by_value(common)

NAME = "op10_minhash_links"
ORACLE_SQL = None

SHINGLE = 5
THRESHOLD = 75  # per cent
K = 64
#: Of the ``K`` smallest values of a union, a pair over 75 % shares fewer than
#: this many with a probability below 1e-8 (6e-9 for large sets at 75 %); also the filter's lowest estimate.
NEED = 27
LIST = 64
BLOCK = 256
#: Bytes of text that are hashed at once.
CHUNK = 4 << 20

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                               0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
_TOP = np.uint64(1 << 63)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    held: list[bytes] = []
    weight = 0
    for t in texts:
        held.append(t.encode("utf-8", "surrogatepass").lower() if t else b"")
        weight += len(held[-1])
        if weight > CHUNK:
            yield from _hash_chunk(held, size)
            held, weight = [], 0
    if held:
        yield from _hash_chunk(held, size)


def _hash_chunk(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    word, bounds = common.chunked_word_hashes(texts)
    if len(word) == 0:
        yield from (np.empty(0, np.uint64) for _ in texts)
        return
    terms = sum((_MIX[k % 5] + np.uint64(2 * (k // 5))) * np.r_[word[k:], np.zeros(k, np.uint64)]
                for k in range(size))
    full = common.mix(terms)
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = j - i
        if n >= size:
            yield np.unique(full[i:j - size + 1])
        elif n:
            total = sum(int(_MIX[k % 5] + np.uint64(2 * (k // 5))) * int(w) for k, w in enumerate(word[i:j]))
            yield common.mix(np.array([(total + n) & (2 ** 64 - 1)], dtype=np.uint64))
        else:
            yield np.empty(0, np.uint64)


def sketches(docs: DataFrame, doc_id: str, text: str, size: int, k: int) -> DataFrame:
    """(id, text_key, n, sig1, sig2, sketch) of every row.  The values of a sketch have
    their top bit flipped, so that Spark's signed order is the order in which the
    sketch was cut."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text_key, s in zip(batch.iloc[:, 0], batch.iloc[:, 2],
                                        shingle_sets(batch.iloc[:, 1].tolist(), size)):
                rows.append((key, text_key, len(s), common.mix(s).sum().astype(np.int64),
                             np.bitwise_xor.reduce(common.mix(s + _MIX[1]), initial=np.uint64(0)).astype(np.int64),
                             (s[:k] ^ _TOP).view(np.int64)))
            yield pd.DataFrame(rows, columns=["id", "text_key", "n", "sig1", "sig2", "sketch"])

    return docs.select(doc_id, text, F.xxhash64(text).alias("text_key")).mapInPandas(
        run, f"id {kind}, text_key long, n long, sig1 long, sig2 long, sketch array<long>")


def full_sets(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch.iloc[:, 0],
                                "s": [s.view(np.int64) for s in shingle_sets(batch.iloc[:, 1].tolist(), size)]})

    return docs.select(doc_id, text).mapInPandas(run, f"id {kind}, s array<long>")


def inverted_lists(reps: DataFrame, k: int, need: int, threshold: int) -> DataFrame:
    """(v, id, n_list): the entries of a document's rare-first prefix."""
    entries = reps.select("id", "n", F.explode("sketch").alias("v"))
    shared = entries.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Where even the larger set of a pair fits its sketch, overlaps are exact.
    least = F.when(F.col("n") * 100 <= k * threshold, F.ceil(F.col("n") * threshold / 100)).otherwise(F.lit(need))
    by_doc = (entries.join(shared, "v").groupBy("id", "n")
              .agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs")))  # at most k entries
    prefix = by_doc.select("id", F.slice("vs", F.lit(1), F.greatest(F.size("vs") - least + 1, F.lit(0)).cast("int"))
                           .alias("vs")).select("id", F.explode("vs").alias("e")).select("id", F.col("e.v").alias("v"))
    return prefix


def estimate_passes(a, b, na, nb, k: int, need: int, threshold: int):
    """Union-sketch test: exact where both sets fit their sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    whole = (na <= k) & (nb <= k)
    inter = F.size(F.array_intersect(a, b))
    return F.when(whole, 100 * inter >= threshold * (na + nb - inter)).otherwise(both >= need)


def links(reps: DataFrame, docs: DataFrame, *, doc_id: str, text: str, size: int, threshold: int,
          k: int, need: int, list_limit: int, block: int) -> DataFrame:
    """(a, b) links between classes, enough to give their components; ``reps`` is
    (id, n, sketch, first), where ``first`` (id, text_key) is the document that
    stands for the class ``id``."""
    prefix = common.cut(inverted_lists(reps, k, need, threshold))
    sizes = prefix.groupBy("v").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("first")).where("m > 1")
    small = prefix.join(sizes.where(F.col("m") <= list_limit).select("v"), "v")
    pairs = (small.alias("x").join(small.alias("y"), (F.col("x.v") == F.col("y.v")) & (F.col("x.id") < F.col("y.id")))
             .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
    family = (prefix.join(sizes.where(F.col("m") > list_limit).select("v", "first"), "v")
              .select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    slim = reps.select("id", "n", "sketch")
    rated = (pairs.join(slim.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
             .join(slim.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
             .where(estimate_passes(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"), k, need, threshold))
             .select("a", "b", F.lit(False).alias("of_family")))
    todo = common.cut(rated.unionByName(family.where("a <> b").withColumn("of_family", F.lit(True))))
    wanted = todo.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = reps.join(wanted, "id").select("id", F.col("first.id").alias("doc"), F.col("first.text_key").alias("text_key"))
    chosen = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text")).join(
        wanted, ["doc", "text_key"])
    sets = common.cut(full_sets(chosen, "id", "text", size).dropDuplicates(["id"]))
    verified = (todo.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
                .join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
                .withColumn("inter", F.size(F.array_intersect("sa", "sb")).cast("long"))
                .withColumn("all", F.size("sa") + F.size("sb") - F.col("inter"))
                .select("a", "b", "of_family", "inter", "all"))
    verified = common.cut(verified)
    linked = F.col("inter") * 100 >= F.col("all") * threshold
    direct = verified.where(linked).select("a", "b")
    members = verified.where("of_family").select(
        F.col("a").alias("family"), F.col("b").alias("id"), linked.alias("linked"),
        F.floor((1 - F.col("inter") / F.col("all")) * 20).alias("cell"))
    return direct.unionByName(family_links(members, sets, threshold, block)).distinct()


def family_links(members: DataFrame, sets: DataFrame, threshold: int, block: int) -> DataFrame:
    """Links among the members of a family that its centre does not decide.

    ``cell`` is the distance from the centre in steps of 1/20.  Linked members
    at distances d1, d2 have |d1 - d2| <= 1 - threshold, so only blocks of near
    cells meet, and two members that the centre links need no test."""
    reach = -(-(100 - threshold) * 20 // 100) + 1
    counts = members.groupBy("family", "cell", "linked").agg(F.count(F.lit(1)).alias("m")).withColumn(
        "parts", F.ceil(F.col("m") / F.lit(block)).cast("int"))
    near = (counts.alias("x").join(counts.alias("y"), (F.col("x.family") == F.col("y.family"))
                                   & ((F.col("x.cell") < F.col("y.cell")) | ((F.col("x.cell") == F.col("y.cell"))
                                                                            & (F.col("x.linked") <= F.col("y.linked"))))
                                   & (F.col("y.cell") - F.col("x.cell") <= reach)
                                   & ~(F.col("x.linked") & F.col("y.linked"))))
    meetings = near.select(
        F.col("x.family").alias("family"), F.col("x.cell").alias("c1"), F.col("x.linked").alias("l1"),
        F.col("y.cell").alias("c2"), F.col("y.linked").alias("l2"),
        F.explode(F.sequence(F.lit(0), F.col("x.parts") - 1)).alias("p1"), F.col("y.parts").alias("parts2"))
    meetings = meetings.select("*", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)).alias("p2")).where(
        (F.col("c1") < F.col("c2")) | (F.col("l1") < F.col("l2")) | (F.col("p1") <= F.col("p2"))).drop("parts2")
    meetings = meetings.withColumn("meeting", F.xxhash64("family", "c1", "l1", "p1", "c2", "l2", "p2"))
    placed = members.join(counts.select("family", "cell", "linked", "parts"), ["family", "cell", "linked"]).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    sides = meetings.select("family", F.col("c1").alias("cell"), F.col("l1").alias("linked"),
                            F.col("p1").alias("part"), "meeting", F.lit(0).alias("side")).unionByName(
        meetings.select("family", F.col("c2").alias("cell"), F.col("l2").alias("linked"),
                        F.col("p2").alias("part"), "meeting", F.lit(1).alias("side")))
    kind = sets.schema["id"].dataType.simpleString()
    rows = (placed.join(sides, ["family", "cell", "linked", "part"]).select("meeting", "side", "id")
            .join(sets, "id"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        x, y = group[group.side == 0], group[group.side == 1]
        out = forest(x.id.tolist(), [np.asarray(s) for s in x.s], y.id.tolist(), [np.asarray(s) for s in y.s],
                     threshold)
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.groupBy("meeting").applyInPandas(meet, f"a {kind}, b {kind}")


def forest(xs: list, x_sets: list, ys: list, y_sets: list, threshold: int) -> list[tuple]:
    """A spanning forest of the links between two blocks (exact overlaps by one
    0/1 matrix product over the values that both blocks hold)."""
    if not xs or not ys:
        return []
    values = np.intersect1d(np.concatenate(x_sets), np.concatenate(y_sets))
    inter = np.zeros((len(xs), len(ys)), dtype=np.float32)
    for lo in range(0, len(values), 20_000):
        part = values[lo:lo + 20_000]
        mats = []
        for sets in (x_sets, y_sets):
            m = np.zeros((len(sets), len(part)), dtype=np.float32)
            for i, s in enumerate(sets):
                at = np.searchsorted(part, s)
                at[at == len(part)] = 0
                m[i, at[part[at] == s]] = 1
            mats.append(m)
        inter += mats[0] @ mats[1].T
    nx, ny = np.array([len(s) for s in x_sets]), np.array([len(s) for s in y_sets])
    inter = inter.astype(np.int64)
    good = inter * 100 >= (nx[:, None] + ny[None, :] - inter) * threshold
    parent: dict = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for i, j in np.argwhere(good).tolist():
        a, b = root(xs[i]), root(ys[j])
        if a != b:
            parent[a] = b
            out.append((xs[i], ys[j]))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b): component is the
    smallest reachable id.  Large-star/small-star rounds, a checkpoint each."""
    def hang(rows: DataFrame) -> DataFrame:
        return rows.where("u <> v").distinct()

    def digest(rows: DataFrame):
        return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = common.cut(hang(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    before = digest(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = hang(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = common.cut(hang(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                              .unionByName(low.select("u", F.col("m").alias("v")))))
        after = digest(now)
        if after == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = after


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
                    threshold: int = THRESHOLD, k: int = K, need: int = NEED, list_limit: int = LIST,
                    block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, class_id, component_id,
    kept); ``class_id`` is the smallest id with the same shingle set."""
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    every = common.cut(sketches(slim, "id", "text", size, k))
    ranked = every.where("id IS NOT NULL AND n > 0")
    classes = ranked.groupBy("n", "sig1", "sig2").agg(F.min(F.struct("id", "text_key")).alias("first"),
                                                      F.first("sketch").alias("sketch"))
    # Numbered as they are written, so the numbers stay when a task is run again.
    classes = common.cut(classes.select("*", F.col("first.id").alias("class"),
                                        F.monotonically_increasing_id().alias("number")))
    reps = classes.select(F.col("number").alias("id"), "n", "sketch", "first")
    numbered = links(reps, slim, doc_id="id", text="text", size=size, threshold=threshold, k=k, need=need,
                  list_limit=list_limit, block=block)
    ids = classes.select("number", "class")
    edges = (numbered.join(ids.select(F.col("number").alias("a"), F.col("class").alias("x")), "a")
             .join(ids.select(F.col("number").alias("b"), F.col("class").alias("y")), "b")
             .select(F.col("x").alias("a"), F.col("y").alias("b")))
    # Rows that share an id tie their classes together.
    member = ranked.join(classes.select("n", "sig1", "sig2", "class"), ["n", "sig1", "sig2"])
    tied = member.where(F.col("id") != F.col("class")).select(F.col("id").alias("a"), F.col("class").alias("b"))
    several = member.groupBy("id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi")
    tied = tied.join(several.select(F.col("id").alias("a")), "a", "left_semi")
    comp = components(edges.unionByName(tied))
    out = every.select("id", "n", "sig1", "sig2").join(
        classes.select("n", "sig1", "sig2", "class"), ["n", "sig1", "sig2"], "left")
    whose = F.when(F.col("id").isNull() | (F.col("n") == 0), F.col("id")).otherwise(F.col("class"))
    out = out.withColumn("class", whose).join(
        comp.select(F.col("id").alias("class"), "component"), "class", "left")
    component = F.coalesce("component", "class")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("class").alias("class_id"),
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that another one of their group stands for
    (the one with the smallest id stays); same columns."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    gone = found.where("NOT kept").select(doc_id).distinct()
    return docs.join(gone, doc_id, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
