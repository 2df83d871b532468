"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are cut into blocks of bounded size; each block
becomes one generalised suffix automaton over words (the automaton of all its
items at once), and every document is streamed through it: after each word the
automaton's state and the length of the longest match that ends there are
known.  A match of at least ``window`` words is an occurrence of a benchmark
window; an item shorter than the window counts as one window of its own length.
The hit words become spans, spans and documents beyond the length and coverage
limits are removed.

Distribution: a block of items is collected and broadcast (``BLOCK_WORDS``
bounds it, whatever the benchmark's size), documents are scanned where they
lie.  With one block there is no shuffle at all; with several the hit ranges of
a document are unioned per document row.

Defined results: null text or text without words has no words and no hits; an
item with null text or without words has no windows; an item with a null id
still contaminates but is not listed; equal ids are listed once; repeated
document rows are judged one by one; an empty benchmark hits nothing.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

common.by_value(sys.modules[__name__])

NAME = "op1_benchmark_decontamination"
WINDOW = 10
#: Item words in one automaton (about 100 MB of Python objects at most).
BLOCK_WORDS = 200_000
#: The least overlap that lets a long item be cut without losing a window is
#: ``window - 1`` words; segments of an item have this many words.
SEGMENT_WORDS = 20_000

#: Bytes of a word: 0-9, a-z (after lower-casing A-Z) and everything from 0x80.
WORD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
             for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD).split() if text else []


class Automaton:
    """Generalised suffix automaton of word sequences, with the windows marked.

    ``items`` are (id or None, words).  ``near[v]`` is, for a state whose match
    may be a window's end, the state of the ``window``-word suffix; ``short[v]``
    is the chain of short items that end in state ``v``."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        nexts: list[dict] = [{}]
        link, length = [-1], [0]
        owners: list[set] = [set()]
        short_at: list[list] = [[]]

        def extend(last: int, w: bytes) -> int:
            if w in nexts[last]:  # generalised: the path exists already
                q = nexts[last][w]
                if length[q] == length[last] + 1:
                    return q
                return clone(last, w, q)
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            owners.append(set())
            short_at.append([])
            p = last
            while p != -1 and w not in nexts[p]:
                nexts[p][w] = cur
                p = link[p]
            if p != -1:
                q = nexts[p][w]
                link[cur] = q if length[q] == length[p] + 1 else clone(p, w, q)
            return cur

        def clone(p: int, w: bytes, q: int) -> int:
            c = len(nexts)
            nexts.append(dict(nexts[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            owners.append(set())
            short_at.append([])
            link[q] = c
            while p != -1 and nexts[p].get(w) == q:
                nexts[p][w] = c
                p = link[p]
            return c

        for _, words in items:
            last = 0
            for w in words:
                last = extend(last, w)
        # A second walk marks where items end windows: the state of each prefix,
        # then the ancestor that holds its suffix of ``window`` words.
        n = len(nexts)
        near = [0] * n
        for v in sorted(range(1, n), key=length.__getitem__):
            near[v] = v if length[v] >= window and length[link[v]] < window else near[link[v]]
        for name, words in items:
            v = 0
            for k, w in enumerate(words, 1):
                v = nexts[v][w]
                if k >= window:
                    owners[near[v]].add(name)
            if 0 < len(words) < window:
                v, m = 0, len(words)
                for w in words:
                    v = nexts[v][w]
                while length[link[v]] >= m:
                    v = link[v]
                short_at[v].append((m, name))
        short: list[tuple] = [()] * n
        for v in sorted(range(1, n), key=length.__getitem__):
            short[v] = (*short_at[v], *short[link[v]])
        self.nexts, self.link, self.length, self.near, self.short, self.owners = (
            nexts, link, length, near, short, owners)
        self.any_short = any(short)
        self.vocabulary = {w for _, words in items for w in words}
        self.shortest = min((min(window, len(words)) for _, words in items if words), default=0)

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(hit word ranges [start, end), unioned and ordered; ids of the items
        whose windows occur)."""
        spans: list[list[int]] = []
        found: set = set()
        if not self.shortest or self.vocabulary.isdisjoint(words):
            return [], found
        nexts, link, length, window = self.nexts, self.link, self.length, self.window
        near, owners, short, any_short = self.near, self.owners, self.short, self.any_short
        root = nexts[0]
        v = n = 0
        out = nexts[0]
        for i, w in enumerate(words):
            to = out.get(w)
            if to is not None:
                v = to
                n += 1
            else:
                if v:
                    v = link[v]
                    while v > 0 and w not in nexts[v]:
                        v = link[v]
                    to = nexts[v].get(w)
                else:
                    to = None
                if to is None:
                    v = n = 0
                    out = root
                    continue
                n = length[v] + 1
                v = to
            out = nexts[v]
            if n >= window:
                start = i + 1 - n
                found |= owners[near[v]]
                if spans and start <= spans[-1][1]:
                    spans[-1][0] = min(spans[-1][0], start)
                    spans[-1][1] = i + 1
                else:
                    spans.append([start, i + 1])
            if any_short and short[v]:
                for m, name in short[v]:
                    if m <= n:
                        found.add(name)
                        spans.append([i + 1 - m, i + 1])
        return union(spans), found


def union(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of possibly overlapping or touching ranges, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def blocks_of(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int) -> DataFrame:
    """(block, id, words): item segments dealt to blocks by a running word count
    within spread groups, so that no block exceeds ``block_words`` by more than a
    segment."""
    lowered = common.ascii_lower(F.coalesce(F.col(text), F.lit("")))
    words = F.regexp_extract_all(lowered, F.lit("([^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+)"), F.lit(1))
    segment = min(SEGMENT_WORDS, block_words)
    base = benchmark.select(F.col(item_id).cast("string").alias("id"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - F.lit(window), F.lit(0)), F.lit(segment))
    cut = (base.select("id", "words", F.explode(starts).alias("at"))
           .select("id", F.slice("words", F.col("at") + 1, F.lit(segment + window - 1)).alias("words")).distinct())
    total = cut.agg(F.sum(F.size("words"))).first()[0] or 0
    n = max(1, -(-int(total) // max(1, block_words // 2)))
    return cut.withColumn("block", F.pmod(F.xxhash64("id", "words"), F.lit(n))), n


def scanner(held, window: int):
    """The pandas UDF that streams texts through the automaton of one block."""

    @F.pandas_udf("n_words long, spans array<struct<start:long,end:long>>, items array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto = Automaton(held.value, window)
        for texts in batches:
            found = []
            for t in texts:
                words = words_of(t)
                spans, items = auto.stream(words)
                found.append((len(words), [{"start": a, "end": b} for a, b in spans],
                              sorted(x for x in items if x is not None)))
            yield pd.DataFrame(found, columns=["n_words", "spans", "items"])

    return scan.asNondeterministic()


def hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
         out: str = "hit") -> DataFrame:
    """Every row of ``docs`` with a struct column ``out`` (which replaces one of
    that name): ``n_words``, ``spans``
    (array of start/end word indexes, ordered, disjoint) and ``items`` (ids as
    strings, sorted, distinct)."""
    spark = docs.sparkSession
    dealt, n_blocks = blocks_of(benchmark, item_id, item_text, window, block_words)
    if n_blocks > 1:
        dealt = common.cut(dealt)
    docs = docs.drop(*[c for c in docs.columns if c.lower() == out.lower() and c != text])
    for block in range(n_blocks):
        rows = [(r["id"], [w.encode() for w in r["words"]])
                for r in dealt.where(F.col("block") == block).select("id", "words").collect()]
        held = spark.sparkContext.broadcast(rows)

        one = scanner(held, window)(F.col(text))
        if block == 0:
            docs = docs.withColumn(out, one)
        else:  # narrow: the row's ranges of the blocks so far and of this one
            nxt = common.fresh(docs, stem="next_hit")
            docs = docs.withColumn(nxt, one)
            docs = docs.withColumn(out, F.struct(
                F.col(out)["n_words"].alias("n_words"),
                merged(F.concat(F.col(out)["spans"], F.col(nxt)["spans"])).alias("spans"),
                F.array_sort(F.array_union(F.col(out)["items"], F.col(nxt)["items"])).alias("items"))).drop(nxt)
    return docs


def merged(spans):
    """Union of ranges: a fold over the ordered ranges."""
    kind = "array<struct<start:bigint,end:bigint>>"
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"),
            F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, min_span: int = 1,
                  max_coverage: float = 0.5) -> DataFrame:
    """Cleaned documents, same columns: hit spans of at least ``min_span`` words
    are cut out of the text (from the first to the last character of the span,
    what stands between words outside spans stays); documents of which more than
    ``max_coverage`` of the words are hit are dropped."""
    out = common.fresh(docs, stem="hit")
    marked = hits(docs, benchmark, text=text, item_id=item_id, item_text=item_text, window=window, out=out)
    spans, n_words = F.col(out)["spans"], F.col(out)["n_words"]
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])

    @F.pandas_udf("string")
    def erase(texts: pd.Series, gone: pd.Series) -> pd.Series:
        rest = []
        for t, ranges in zip(texts, gone):
            if t is None or len(ranges) == 0:
                rest.append(t)
                continue
            at = [m.span() for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", t)]
            keep, last = [], 0
            for r in ranges:
                keep.append(t[last:at[r["start"]][0]])
                last = at[r["end"] - 1][1]
            rest.append("".join(keep) + t[last:])
        return pd.Series(rest, dtype=object)

    chosen = F.filter(spans, lambda s: s["end"] - s["start"] >= min_span)
    kept = marked.where((n_words == 0) | (covered <= F.lit(max_coverage) * n_words))
    return kept.withColumn(text, F.when(F.size(chosen) > 0, erase(F.col(text), chosen)).otherwise(
        F.col(text))).select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    found = hits(docs, common.read(spark, sf_dir, "benchmark", "item_id", "text"))
    n_hit = F.aggregate("hit.spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", F.col("hit.n_words").alias("n_words"), n_hit.alias("n_hit"),
                        F.size("hit.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hit.items", ","), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.r, dw.i, dw.k, iw.item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
