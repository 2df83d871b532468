"""Stupid-backoff scores from n-gram counts of the corpus itself.

A word's score is the relative frequency of the longest n-gram (up to three
words) that ends in it and stands in the count tables, times ``ALPHA`` for every
order backed off.  Tables hold all words, and longer n-grams that occur at least
``CUTOFF`` times; at 1 they are complete.  A text is scored by the counts of all
other rows (``leave_out``): its own n-grams are taken off the totals, as they would
tell each text that it is likely, junk the most.

The counts are a relation partitioned by hash.  Documents are dealt to blocks of
bounded size; a block explodes its n-grams, adds up equal ones, and sends
each hash range its keys and counts (sorted, packed, one row a range).  A range
sums the counts of a key over all blocks and joins the totals back to the blocks
that asked.  With complete tables all n-grams go at once; with a higher cutoff
words and pairs go first, and of the triples only those whose two pairs both
reached it, since no other triple can.  At last the blocks sum
the scores per document.  A very common n-gram is one key a block, so no range
gets more than that of it.  The texts are shuffled once and that shuffle is
reused by all steps; recomputed tasks give the same rows.

Keys are 48-bit hashes within hash ranges (equal keys of different n-grams would
add their counts; expected for one pair in 10^14).

Defined results: words are separated by blanks and compared without case (A-Z);
a null or blank text has no words, score 0.0 and a null mean; the first word of a
text has no history and is scored by its frequency without a penalty; a word that
no other row has counts as one occurrence, an order further backed off; repeated
rows count and are scored as often as they stand, each by the others.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

common.by_value(sys.modules[__name__])
common.by_value(common)

NAME = "op7_ngram_scores"
ORACLE_SQL = None

ALPHA = 0.4
#: Occurrences from which an n-gram counts; a higher cutoff is an option.
CUTOFF = 1
BLOCK_BYTES = 5 << 20
#: Keys that one hash range should get from all blocks.
RANGE_KEYS = 400_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    """Range of a 48-bit key; ranges are equally wide and in key order."""
    return ((key >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def ranges_in(of: np.ndarray) -> Iterator[tuple[int, slice]]:
    start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
    for i, j in zip(start, [*start[1:], len(of)]):
        yield int(of[i]), slice(int(i), int(j))


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as 32-bit steps, or as they are if a step is wider."""
    steps = np.diff(keys)
    if len(steps) and int(steps.max()) >> 32:
        return b"\1" + keys.tobytes()
    return b"\0" + keys[:1].tobytes() + steps.astype(np.uint32).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if blob[:1] == b"\1":
        return np.frombuffer(blob, dtype=np.uint64, offset=1)
    first = np.frombuffer(blob, dtype=np.uint64, offset=1, count=1)
    return np.cumsum(np.r_[first, np.frombuffer(blob, dtype=np.uint32, offset=9).astype(np.uint64)])


class Grams:
    """The words of a block's texts (packed by :func:`packed`) and the keys of
    its n-grams."""

    def __init__(self, texts: list[bytes]):
        self.words, self.bounds = common.chunked_word_hashes([zlib.decompress(t) for t in texts])
        n = len(self.words)
        at = np.arange(n) - np.repeat(self.bounds[:-1], np.diff(self.bounds))
        self.place = at  # of each word in its text
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        self.keys = [self.words >> np.uint64(16)]
        for order in (2, 3):  # the n-gram that ends at each word, where there is one
            total = np.full(n, order, dtype=np.uint64)
            for k in range(order):
                back = order - 1 - k
                total[back:] += _MIX[k] * self.words[:n - back] if back else _MIX[k] * self.words
            self.keys.append(np.where(at >= order - 1, common.mix(total) >> np.uint64(16), np.uint64(0)))

    def has(self, order: int) -> np.ndarray:
        return self.place >= order - 1

    def own(self, order: int) -> np.ndarray:
        """How often each word's n-gram stands in its own text (0 where there is none)."""
        out, mask = np.zeros(len(self.words), dtype=np.int64), self.has(order)
        keys, text = self.keys[order - 1][mask], self.text[mask]
        by = np.lexsort((keys, text))
        new = np.r_[True, (keys[by][1:] != keys[by][:-1]) | (text[by][1:] != text[by][:-1])] if len(by) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        sizes = np.diff(np.r_[start, len(by)])
        mine = np.empty(len(by), np.int64)
        mine[by] = np.repeat(sizes, sizes)
        out[mask] = mine
        return out

    def short(self) -> np.ndarray:
        """All keys of words and pairs in the block."""
        return np.concatenate([self.keys[0], self.keys[1][self.has(2)]])

    def every(self) -> np.ndarray:
        return np.concatenate([self.short(), self.keys[2][self.has(3)]])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys of all n-grams, sorted; where each of :meth:`every` is
        among them)."""
        keys = self.every()
        order = np.argsort(keys)
        sorted_keys = keys[order]
        new = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]] if len(keys) else np.zeros(0, bool)
        of = np.empty(len(keys), np.int64)
        of[order] = np.cumsum(new) - 1
        return sorted_keys[new], of

    def dealt(self, counts: np.ndarray) -> list[np.ndarray]:
        """Counts of :meth:`every` as one array an order (0 where there is none)."""
        out, lo = [], 0
        for order in (1, 2, 3):
            mask = self.has(order)
            mine = np.zeros(len(self.words), dtype=np.int64)
            hi = lo + int(mask.sum())
            mine[mask] = counts[lo:hi]
            out.append(mine)
            lo = hi
        return out

    def look_up(self, order: int, mask: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Corpus count of the n-gram that ends at each word (0 where masked)."""
        out = np.zeros(len(self.words), dtype=np.int64)
        out[mask] = counts[np.searchsorted(keys, self.keys[order - 1][mask])]
        return out


def packed(texts: list[str | None]) -> list[bytes]:
    """The lower-cased texts, compressed for the shuffle."""
    return [zlib.compress(t, 6) for t in common.lowered(texts)]


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts of at least one: a bit for each that is over one, then those, byte
    by byte of their width, which compresses far better than whole integers."""
    more = counts > 1
    bits = zlib.compress(np.packbits(more).tobytes(), 6)
    large = counts[more].astype("<i8").view(np.uint8).reshape(-1, 8).T
    return len(bits).to_bytes(4, "little") + bits + zlib.compress(large.tobytes(), 6)


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    cut = 4 + int.from_bytes(blob[:4], "little")
    out = np.ones(n, dtype=np.int64)
    more = np.unpackbits(np.frombuffer(zlib.decompress(blob[4:cut]), dtype=np.uint8), count=n).astype(bool)
    large = np.frombuffer(zlib.decompress(blob[cut:]), dtype=np.uint8).reshape(8, -1).T
    out[more] = np.ascontiguousarray(large).view("<i8").ravel()
    return out


def pairs_seen(grams: Grams, keys: np.ndarray, counts: np.ndarray, cutoff: int):
    """(word counts, pair counts below the cutoff as 0, words where a triple may
    reach the cutoff)."""
    one = grams.look_up(1, grams.has(1), keys, counts)
    two = grams.look_up(2, grams.has(2), keys, counts)
    two[two < cutoff] = 0
    may = grams.has(3)
    may[1:] &= (two[1:] > 0) & (two[:-1] > 0)
    return one, two, may


def replies_of(given: pd.DataFrame, step: int, keys: np.ndarray, ranges: int) -> np.ndarray:
    """The totals of a block's sorted keys from its replies of one step."""
    counts = np.zeros(len(keys), dtype=np.int64)
    mine = {int(r): c for s, r, c in zip(given.step, given.range, given.counts) if s == step}
    for r, where in ranges_in(range_of(keys, ranges)):
        counts[where] = unpack_counts(mine[r], where.stop - where.start)
    return counts


def questions(block: int, keys: np.ndarray, ranges: int) -> pd.DataFrame:
    unique, counts = np.unique(keys, return_counts=True)
    out = [(r, block, pack(unique[w]), pack_counts(counts[w]))
           for r, w in ranges_in(range_of(unique, ranges))]
    return pd.DataFrame(out, columns=["range", "block", "keys", "counts"])


def totals(batch: pd.DataFrame, step: int) -> pd.DataFrame:
    """One hash range: the corpus count of every key, joined back to its askers."""
    keys = [unpack(x) for x in batch["keys"]]
    flat = np.concatenate(keys)
    counts = np.concatenate([unpack_counts(x, len(k)) for x, k in zip(batch.counts, keys)])
    order = np.argsort(flat, kind="stable")
    start = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
    total = np.add.reduceat(counts[order], start)
    of = np.empty(len(flat), np.int64)
    of[order] = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(flat)]))
    out, lo = [], 0
    for block, r, k in zip(batch.block, batch.range, keys):
        out.append((block, step, r, pack_counts(total[of[lo:lo + len(k)]])))
        lo += len(k)
    return pd.DataFrame(out, columns=["block", "step", "range", "counts"])


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", alpha: float = ALPHA,
          cutoff: int = CUTOFF, leave_out: bool = True) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, log_score, mean_log_score,
    n_triples, n_pairs, n_singles); logarithms to base 10, the last three say
    which order scored how many words.  ``leave_out``: by the other rows' counts."""
    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    size = common.total_bytes(slim)
    blocks = max(1, -(-size // BLOCK_BYTES))
    complete = cutoff <= 1
    ranges = max(1, -(-size // 6 * (2 if complete else 1) // RANGE_KEYS))
    dealt = slim.withColumn("block", F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(blocks)))

    def pack_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "block": batch["block"], "text": packed(batch["text"].tolist())})

    placed = dealt.mapInPandas(pack_texts, f"id {kind}, block long, text binary")

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"n": [sum(len(t.encode("utf-8", "surrogatepass").split())
                                      for batch in batches for t in batch["text"] if t)]})

    corpus = int(slim.select("text").mapInPandas(count_words, "n long").agg(F.sum("n")).first()[0] or 0)

    def ask_short(key, batch: pd.DataFrame) -> pd.DataFrame:
        grams = Grams(batch["text"].tolist())
        return questions(key[0], grams.every() if complete else grams.short(), ranges)

    def ask_triples(key, batch: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        grams = Grams(batch["text"].tolist())
        keys = np.unique(grams.short())
        _, _, may = pairs_seen(grams, keys, replies_of(given, 1, keys, ranges), cutoff)
        return questions(key[0], grams.keys[2][may], ranges)

    def finish(key, batch: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        grams = Grams(batch["text"].tolist())
        if complete:
            keys, of = grams.distinct()
            one, two, three = grams.dealt(replies_of(given, 1, keys, ranges)[of])
        else:
            keys = np.unique(grams.short())
            one, two, may = pairs_seen(grams, keys, replies_of(given, 1, keys, ranges), cutoff)
            keys = np.unique(grams.keys[2][may])
            three = grams.look_up(3, may, keys, replies_of(given, 2, keys, ranges))
        others = np.full(len(one), corpus)
        if leave_out:
            one, two, three = (np.maximum(total - grams.own(order), 0)
                               for order, total in ((1, one), (2, two), (3, three)))
            others = corpus - np.diff(grams.bounds)[grams.text]
            two[two < cutoff] = 0
        three[three < cutoff] = 0
        before_one, before_two = np.r_[1, one[:-1]], np.r_[1, two[:-1]]
        if not len(one):
            before_one = before_two = one
        by3, by2 = three > 0, (three == 0) & (two > 0)
        by1 = ~by3 & ~by2
        orders = np.minimum(grams.place, 2)  # the longest history there is
        value = np.zeros(len(one))
        value[by3] = np.log10(three[by3] / before_two[by3])
        value[by2] = np.log10(two[by2] / before_one[by2]) + (orders[by2] - 1) * np.log10(alpha)
        value[by1] = (np.log10(np.maximum(one, 1)[by1] / np.maximum(others, 1)[by1])
                      + (orders + (one == 0))[by1] * np.log10(alpha))
        first = grams.bounds[:-1]

        def per_text(x: np.ndarray) -> np.ndarray:
            sums = np.r_[np.zeros(1, x.dtype), np.cumsum(x)] if x.dtype != float else None
            if sums is not None:
                return sums[grams.bounds[1:]] - sums[first]
            return np.array([x[i:j].sum() for i, j in zip(first, grams.bounds[1:])], dtype=float)

        n = np.diff(grams.bounds)
        total = per_text(value)
        return pd.DataFrame({"id": batch["id"].tolist(), "n_words": n, "log_score": total,
                             "mean_log_score": [t / k if k else None for t, k in zip(total.tolist(), n.tolist())],
                             "n_triples": per_text(by3.astype(np.int64)), "n_pairs": per_text(by2.astype(np.int64)),
                             "n_singles": per_text(by1.astype(np.int64))})

    row = "range long, block long, keys binary, counts binary"
    reply = "block long, step int, range long, counts binary"

    def first_totals(batch: pd.DataFrame) -> pd.DataFrame:
        return totals(batch, 1)

    def triple_totals(batch: pd.DataFrame) -> pd.DataFrame:
        return totals(batch, 2)

    told = placed.groupBy("block").applyInPandas(ask_short, row).groupBy("range").applyInPandas(first_totals, reply)
    if not complete:
        told = told.unionByName(placed.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(ask_triples, row)
                                .groupBy("range").applyInPandas(triple_totals, reply))
    return (placed.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(
        finish, f"id {kind}, n_words long, log_score double, mean_log_score double, n_triples long, n_pairs long, "
                "n_singles long").withColumnRenamed("id", doc_id))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.read(spark, sf_dir, "documents", "doc_id", "text"))
