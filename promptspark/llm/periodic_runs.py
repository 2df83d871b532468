"""Runs of periodic words: stretches in which a group of words is said over and over.

Method: a suffix automaton with link-cut access.  The automaton of a stretch of words
is built word by word; its link tree holds every distinct group of words, and the path
from a prefix's state to the root holds the groups that end at this word.  Each appended
word *accesses* that path: it recolours the path with its own place, and meets the
segments of one colour that earlier words have left.  A segment of colour ``e`` whose
longest group has ``m`` words says that the last ``m`` words up to ``i`` ended at ``e``
before and not since.  With ``d = i - e`` and ``m >= d`` this is a square of period
``d``; ``m`` is then the longest common suffix of both places, so the square reaches
back to word ``i - d - m + 1`` and no further, and the last word that reports the same
start and period is the end of the run.

Preferred paths are kept as stacks of coloured segments on the heavy paths of the link
tree (the tree of the whole stretch, in which the colours at each step are those of the
growing automaton), so that an access costs an amortised logarithm instead of splay
rotations.

Words that can't lie in a run are left out before the automaton is built.  In a run of
period q and L >= e*q words each word but the first q stands again within q words, so
L - q words in a row have their last occurrence at most q back.  ``stretches`` finds all
rows of words with this property for some q up to each power of two and adds the words
in front of them; a maximal run lies within one stretch as a whole, so the runs of the
stretches are the runs of the text.

Defined results: a null text has no words and no runs, its collapsed text is empty;
words are split at ASCII blanks; repeated ids and rows are worked on one by one;
columns of the input stay, but ones named like the outputs are replaced.  A text is worked
on in one task; memory is about 1 KB a word of its longest stretch.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAME = "op12_periodic_runs"
ORACLE_SQL = None

#: A run has at least this many words and this many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words that are looked at in one pass, and handed back to Spark at once.
HELD_WORDS = 300_000

Run = tuple[int, int, int]


def word_codes(texts: list[list[bytes]]) -> np.ndarray:
    """Numbers of the words of all texts behind each other: the place where the text
    has the word last, so equal numbers are equal words of one text."""
    out = np.empty(sum(map(len, texts)), np.int64)
    at = 0
    for words in texts:
        end = at + len(words)
        out[at:end] = list(map(dict(zip(words, range(at, end))).__getitem__, words))
        at = end
    return out


def distances(codes: np.ndarray) -> np.ndarray:
    """How many words ago each word was said last (more than there are words where it
    is new)."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    back = np.full(n, n + 1, np.int64)
    again = codes[order[1:]] == codes[order[:-1]]
    back[order[1:][again]] = (order[1:] - order[:-1])[again]
    return back


def stretches(back: np.ndarray, first: np.ndarray, min_words: int, min_periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the places outside of which there is no run; ``first`` is the
    place where the text of each place begins.  No stretch goes over a text's first
    word, which is new."""
    n = len(back)
    inside = np.zeros(n + 1, np.int64)
    reach, far = 1, int((np.arange(n) - first).max(initial=0)) + 1
    while reach * min_periods < 2 * far:
        least = reach // 2 + 1  # smallest period that this reach stands for
        need = max((min_periods - 1) * least, min_words - reach, 1)
        edge = np.flatnonzero(np.diff(np.r_[False, back <= reach, False].astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= need
        begin, end = begin[long], end[long]
        np.add.at(inside, np.maximum(begin - reach, first[begin]), 1)
        np.add.at(inside, end, -1)
        reach *= 2
    within = np.cumsum(inside[:n]) > 0
    edge = np.diff(np.r_[False, within, False].astype(np.int8))
    new = within & (first == np.arange(n))  # a text's stretch ends where the next text begins
    return np.flatnonzero((edge[:n] == 1) | new), np.flatnonzero((edge == -1) | (np.r_[new, False] & np.r_[False, within]))


class SuffixAutomaton:
    """States of all groups of words of ``codes``: ``length`` of the longest group,
    ``link`` to the longest shorter suffix with other ends, ``prefix`` state by word."""

    def __init__(self, codes: list[int]):
        self.length, self.link, self.prefix = [0], [-1], []
        step: list[dict[int, int]] = [{}]
        length, link = self.length, self.link
        last = 0
        for c in codes:
            new = len(length)
            length.append(length[last] + 1)
            step.append({})
            p, last = last, new
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p < 0:
                link.append(0)
            else:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link.append(q)
                else:
                    copy = new + 1
                    link.append(copy)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = copy
                    step.append(step[q].copy())
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
            self.prefix.append(new)


class LastEnds:
    """The link tree, coloured by the last end of each state's groups."""

    def __init__(self, automaton: SuffixAutomaton):
        self.length, self.link = automaton.length, automaton.link
        link, n = self.link, len(self.length)
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        weight, heavy = [1] * n, [-1] * n
        for v in reversed(order[1:]):
            weight[link[v]] += weight[v]
        for v in order[1:]:
            up = link[v]
            if heavy[up] < 0 or weight[v] > weight[heavy[up]]:
                heavy[up] = v
        self.head = list(range(n))
        for v in order[1:]:
            if heavy[link[v]] == v:
                self.head[v] = self.head[link[v]]
        self.segments: dict[int, list[tuple[int, int]]] = {}

    def access(self, v: int, end: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from ``v`` to the root with ``end``; yields (longest
        group, former end) of each segment met."""
        while v > 0:
            top, size = self.head[v], self.length[v]
            held = self.segments.setdefault(top, [])
            covered = 0
            while held and held[-1][0] <= size:
                covered = held[-1][0]
                yield held.pop()
            if held and covered < size:
                yield size, held[-1][1]
            held.append((size, end))
            v = self.link[top]


def stretch_runs(codes: list[int], min_words: int, min_periods: int) -> list[Run]:
    """All runs of one stretch."""
    automaton = SuffixAutomaton(codes)
    ends = LastEnds(automaton)
    found: dict[tuple[int, int], int] = {}
    for i, v in enumerate(automaton.prefix):
        squares: dict[int, int] = {}
        for size, end in ends.access(v, i):
            d = i - end
            if size + d >= min_words and size + d >= min_periods * d and size > squares.get(d, 0):
                squares[d] = size
        for d, size in squares.items():
            found[i - d - size + 1, d] = i
    return [(start, end - start + 1, d) for (start, d), end in found.items()]


def runs_of(texts: list[list[bytes]], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[list[Run]]:
    """(start, length, period) of the runs of each text, by start, then period."""
    bounds = np.cumsum([0] + [len(words) for words in texts])
    codes = word_codes(texts)
    first = np.repeat(bounds[:-1], np.diff(bounds))
    out: list[list[Run]] = [[] for _ in texts]
    begins, ends = stretches(distances(codes), first, min_words, min_periods)
    owners = np.searchsorted(bounds, begins, side="right") - 1
    for begin, end, k in zip(begins.tolist(), ends.tolist(), owners.tolist()):
        at = begin - int(bounds[k])
        out[k] += [(at + s, n, d) for s, n, d in stretch_runs(codes[begin:end].tolist(), min_words, min_periods)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without what repeats a run's first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()
    return [words[i] for i in kept]


def find_runs(docs: DataFrame, text: str = "text", prepare: Callable | None = None, prepare_by: str | None = None,
              min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """Add ``runs`` (array of start, length, period, in words) and ``collapsed`` (the
    text's words without the repetitions, joined by blanks) to each row.

    ``prepare(words, value)`` may change the words of a row first; its value is taken
    from column ``prepare_by``.  ``min_periods`` is 3 at least."""
    if min_periods < 3 or min_words < 1:
        raise ValueError("min_periods must be 3 or more and min_words 1 or more")
    common.by_value(sys.modules[__name__])

    @F.pandas_udf("runs array<struct<start:long,length:long,period:long>>, collapsed string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def frame(held):
            found = runs_of(held, min_words, min_periods)
            return pd.DataFrame({
                "runs": [[{"start": s, "length": n, "period": d} for s, n, d in runs] for runs in found],
                "collapsed": [b" ".join(collapse(words, runs)).decode("utf-8", "surrogatepass")
                              for words, runs in zip(held, found)]})

        for texts, values in batches:
            held, weight = [], 0
            for t, value in zip(texts, values):
                words = t.encode("utf-8", "surrogatepass").split() if t else []
                held.append(words if prepare is None else prepare(words, value))
                weight += len(held[-1])
                if weight > HELD_WORDS:
                    yield frame(held)
                    held, weight = [], 0
            if held:
                yield frame(held)

    out = common.fresh(docs, stem="runs_out")
    keep = [f"`{c}`" for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    value = F.col(prepare_by).cast("string") if prepare_by else F.lit(None).cast("string")
    return docs.withColumn(out, run.asNondeterministic()(F.col(text), value)).select(
        *keep, *[F.col(out)[c].alias(c) for c in ("runs", "collapsed")])


def planted(words: list[bytes], doc_id: str | None) -> list[bytes]:
    """The query's rule: texts whose id's CRC-32 is divisible by 10 go on in periods
    from a word that the CRC names.  A null id changes nothing."""
    if not words or not isinstance(doc_id, str):
        return words
    h = zlib.crc32(doc_id.encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    return words[:a] + (period * ((n - a) // p + 1))[:n - a]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of runs, the longest one, and digests of all runs and
    of the collapsed text."""
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    found = find_runs(docs, prepare=planted, prepare_by="doc_id")
    lines = F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n")))
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                    (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
                    F.expr("(1000 * -best.less) div best.period").alias("exponent_milli"),
                    F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
