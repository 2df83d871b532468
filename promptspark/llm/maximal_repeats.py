"""Exact substring deduplication over an enhanced suffix array.

A byte goes if a ``length``-byte string that covers it also starts in a document
with a smaller id.  Sorting all suffixes of a corpus in one place does not
scale, so the suffixes are dealt out by content first:

1. Documents are dealt to blocks of bounded size by a hash of their id.  Every
   ``length``-byte window is represented by the smallest hash among its
   ``GRAM``-byte substrings (its minimiser): equal windows have equal
   minimisers wherever they stand.  Each block sends its distinct minimisers
   to hash ranges, which answer which of them occur in two documents or more.
2. Runs of neighbouring windows with a repeated minimiser become segments;
   equal segments of a block are sent once, with their smallest document id.
   A minimiser with very many segments is split: its windows go out one by one,
   keyed by their own hash, so no key gathers an unbounded group.
3. A range's task lays its distinct segments behind each other, sorts the
   suffixes at all window starts (numpy, eight bytes a key), and scans the
   common-prefix array with a stack: the intervals are the nodes of the
   common-prefix interval tree, each with all its occurrences, its smallest
   document and whether its left extensions differ (a maximal repeat).  The
   outermost interval of at least ``length`` bytes tells, for every window,
   the first document that has it.
4. The answers return to the blocks, which mark and remove the covered bytes.

All steps are one plan: the shuffle of the texts by block is written once and
reused.  Hashes only deal out work; equality is decided on the bytes, but for
equal segments within and across blocks, which are recognised by 128-bit hashes.

Defined results: null text is empty; ids are compared as longs; a null id is
neither earlier nor later than any other, so its rows keep all bytes; rows that
share an id never remove each other's bytes; texts under ``length`` bytes stay.
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

NAME = "op2_maximal_repeats"
ORACLE_SQL = None

LENGTH = 50
GRAM = 24
#: Windows in a segment at most (the bits of an answer).
RUN = 64
BLOCK_BYTES = 4 << 20
#: Minimisers and segments a range's task should get.
RANGE_MINIMISERS = 500_000
RANGE_SEGMENTS = 20_000
#: Segments of one minimiser beyond which its windows are sent one by one.
HOT = 5_000
#: Bytes that one numpy pass takes.
PASS = 1 << 19
#: Segments whose bytes are unfolded at once.
STEP = 10_000
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
ALL = np.uint64(2 ** 64 - 1)


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every ``gram``-byte substring, by doubling."""
    def joined(x, y_from, n_y, y):  # x covers [i, i+n_x), y starts n_x later
        size = len(y) - y_from
        return x[:size] * power(n_y) + y[y_from:]

    def power(n: int) -> np.uint64:
        return np.uint64(pow(int(_BASES[0]), n, 1 << 64))

    level, width, have, covered = buf.astype(np.uint64) + np.uint64(1), 1, None, 0
    rest = gram
    while rest:
        if rest & 1:
            have, covered = (level, width) if have is None else (joined(have, covered, width, level), covered + width)
        rest >>= 1
        if rest:
            level, width = joined(level, width, width, level), 2 * width
    return common.mix(have[:len(buf) - gram + 1])


def minimisers(buf: np.ndarray, length: int, gram: int) -> np.ndarray:
    """48-bit minimiser of every ``length``-byte window."""
    low, width = gram_hashes(buf, gram) >> np.uint64(16), 1
    span = length - gram + 1
    while width * 2 <= span:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    return np.minimum(low[:len(low) - (span - width)], low[span - width:])


def runs_of(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(minimiser, text number, first window, windows) of the runs of all texts,
    a pass of bounded size at a time."""
    held, weight = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), PASS):
            piece = t[at:at + PASS + length - 1]
            if len(piece) >= length:
                held.append((k, at, piece))
                weight += len(piece)
                if weight >= PASS:
                    yield _runs(held, length, gram)
                    held, weight = [], 0
    if held:
        yield _runs(held, length, gram)


def _runs(pieces: list, length: int, gram: int):
    sizes = np.array([len(p) for _, _, p in pieces])
    offset = np.r_[0, np.cumsum(sizes)[:-1]]
    m = minimisers(np.frombuffer(b"".join(p for _, _, p in pieces), dtype=np.uint8), length, gram)
    change = np.zeros(len(m) + 1, dtype=bool)
    change[1:-1] = m[1:] != m[:-1]
    change[offset] = True
    last = offset + sizes - length + 1
    change[last] = True
    edges = np.flatnonzero(np.r_[change[:-1], True])
    first, windows = edges[:-1], np.diff(edges)
    owner = np.searchsorted(offset, first, side="right") - 1
    inside = first < last[owner]
    first, windows, owner = first[inside], windows[inside], owner[inside]
    parts = -(-windows // RUN)
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, windows, owner = (np.repeat(x, parts) for x in (first, windows, owner))
        first = first + nth * RUN
        windows = np.minimum(windows - nth * RUN, RUN)
    text = np.array([k for k, _, _ in pieces])[owner]
    start = first - offset[owner] + np.array([a for _, a, _ in pieces])[owner]
    # Smallest hashes crowd at the low end; mixed again they spread over the ranges.
    return common.mix(m[first]) >> np.uint64(16), text, start, windows


def all_runs(texts: list[bytes], length: int, gram: int):
    parts = list(runs_of(texts, length, gram))
    if not parts:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*parts))


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all pieces behind each other, first index of each piece)."""
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum()), dtype=np.int64)
    at += np.repeat(start - first, size)
    return flat[at], first


def piece_hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each non-empty piece."""
    place = np.arange(len(data)) - np.repeat(first, size)
    out = []
    for base in _BASES:
        power = np.cumprod(np.full(int(size.max()), base, dtype=np.uint64))
        out.append(common.mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[place], first)
                              + size.astype(np.uint64)))
    return out[0], out[1]


class Block:
    """The distinct texts of a block with their smallest ids."""

    def __init__(self, ids: list, texts: list[str | None]):
        first: dict[bytes, int | None] = {}
        self.rows = []
        for key, t in zip(ids, texts):
            key = None if key is None or key != key else int(key)
            raw = t.encode("utf-8", "surrogatepass") if t else b""
            self.rows.append((key, raw))
            if key is not None:
                have = first.get(raw)
                first[raw] = key if have is None else min(have, key)
        order = sorted(first, key=first.__getitem__)
        self.texts = order
        self.ids = np.array([first[t] for t in order], dtype=np.int64)
        self.number = {t: k for k, t in enumerate(order)}

    def minimisers(self, length: int, gram: int):
        self.runs = all_runs(self.texts, length, gram)
        m, text = self.runs[0], self.runs[1]
        order = np.argsort(m, kind="stable")  # texts stay in id order
        sorted_m, sorted_id = m[order], self.ids[text[order]]
        new = np.r_[True, sorted_m[1:] != sorted_m[:-1]] if len(m) else np.zeros(0, bool)
        self.unique = sorted_m[new]
        self.inverse = np.empty(len(m), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        self.count = np.diff(np.r_[start, len(m)])
        lo = np.minimum.reduceat(sorted_id, start) if len(start) else start
        hi = np.maximum.reduceat(sorted_id, start) if len(start) else start
        self.several = lo != hi
        return self

    def segments(self, repeated: np.ndarray, hot: np.ndarray, length: int, ranges: int):
        """Distinct segments, ordered by range, and the segment of every run."""
        _, text, start, windows = self.runs
        wanted = repeated[self.inverse]
        split = hot[self.inverse] & wanted
        plain = wanted & ~split
        w = windows[split]
        nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        self.s_text = np.r_[text[plain], np.repeat(text[split], w)]
        self.s_start = np.r_[start[plain], np.repeat(start[split], w) + nth]
        self.s_windows = np.r_[windows[plain], np.ones(len(nth), np.int64)]
        key = np.r_[self.unique[self.inverse[plain]] << np.uint64(16), np.zeros(len(nth), np.uint64)]
        sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        base = np.cumsum(sizes) - sizes
        self.flat = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        n = len(key)
        h1, h2 = np.empty(n, np.uint64), np.empty(n, np.uint64)
        for lo in range(0, n, STEP):
            part = slice(lo, lo + STEP)
            size = self.s_windows[part] + length - 1
            data, first = gather(self.flat, base[self.s_text[part]] + self.s_start[part], size)
            h1[part], h2[part] = piece_hashes(data, first, size)
        lone = np.arange(n) >= n - len(nth)
        key = np.where(lone, h1, key)
        order = np.lexsort((self.ids[self.s_text], h2, h1, key))
        k, a, b = key[order], h1[order], h2[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if n else np.zeros(0, bool)
        self.of = np.empty(n, np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.first = order[new]
        self.u_key, self.u_id = key[self.first], self.ids[self.s_text[self.first]]
        self.u_h1, self.u_h2 = h1[self.first], h2[self.first]
        self.u_range = range_of(self.u_key, ranges)
        self.base = base
        # The byte before a segment, where all its copies here agree on it; else -1.
        at = base[self.s_text] + self.s_start
        left = np.where(self.s_start > 0, self.flat[np.maximum(at - 1, 0)].astype(np.int16) if n else 0, -1)
        same = np.ones(len(self.first), dtype=bool)
        np.logical_and.at(same, self.of, left == left[self.first][self.of])
        self.u_left = np.where(same, left[self.first], -1).astype(np.int16)
        return self


def range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    """Hash ranges of equal width, in key order."""
    return ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def ranges_in(of: np.ndarray) -> Iterator[tuple[int, slice]]:
    start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
    for i, j in zip(start, [*start[1:], len(of)]):
        yield int(of[i]), slice(int(i), int(j))


# -- the enhanced suffix array -----------------------------------------------

def suffix_words(data: np.ndarray, at: np.ndarray, size: np.ndarray, n_words: int) -> list[np.ndarray]:
    """The suffixes' bytes as big-endian words of eight, zero beyond ``size``."""
    pad = np.zeros(len(data) + 8 * n_words + 8, dtype=np.uint64)
    pad[:len(data)] = data
    eight = pad[:-1] << np.uint64(8) | pad[1:]
    del pad
    for half in (2, 4):
        eight = eight[:-half] << np.uint64(8 * half) | eight[half:]
    out = []
    for w in range(n_words):
        left = np.clip(size - 8 * w, 0, 8)
        mask = np.where(left == 0, np.uint64(0), ALL << ((8 - np.maximum(left, 1)) * 8).astype(np.uint64))
        out.append(eight[at + 8 * w] & mask)
    return out


def enhanced_suffix_array(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, common prefix of each with its predecessor).

    A suffix is ``data[at:at + size]``; a prefix is common only inside both."""
    n_words = int(-(-int(size.max()) // 8))
    words = suffix_words(data, at, size, n_words)
    order = np.lexsort((size, *words[::-1]))
    lcp = np.zeros(len(at), dtype=np.int64)
    open_ = np.ones(len(at), dtype=bool)
    open_[0] = False
    for w in words:
        sorted_w = w[order]
        diff = np.r_[np.uint64(0), sorted_w[1:] ^ sorted_w[:-1]]
        equal = diff == 0
        # leading equal bytes of an unequal word
        bits = np.zeros(len(at), dtype=np.int64)
        for step in (32, 16, 8):
            high = diff >> np.uint64(64 - step)
            zero = high == 0
            bits += np.where(zero, step, 0)
            diff = np.where(zero, diff << np.uint64(step), diff)
        lcp += np.where(open_, np.where(equal, 8, bits // 8), 0)
        open_ &= equal
    ends = size[order]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(ends[1:], ends[:-1]))
    return order, lcp


def interval_tree(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
    """Stack scan of the common-prefix array: (length, first, end, depth) of all
    intervals with at least ``least`` common bytes, inner ones first; depth 0
    are the outermost."""
    big = np.r_[False, lcp[1:] >= least, False]
    if not big.any():
        return
    group_first = np.flatnonzero(big[1:] & ~big[:-1])
    group_end = np.flatnonzero(~big[1:] & big[:-1])
    for lo, hi in zip(group_first.tolist(), group_end.tolist()):
        values = lcp[lo + 1:hi + 1].tolist()
        if len(set(values)) == 1:
            yield values[0], lo, hi + 1, 0
            continue
        stack: list[tuple[int, int]] = []
        for k, v in enumerate([*values, least - 1], lo + 1):
            left = k - 1
            while stack and stack[-1][0] > v:
                length, left = stack.pop()
                yield length, left, k, len(stack)
            if v >= least and (not stack or stack[-1][0] < v):
                stack.append((v, left))


def first_documents(pieces: list[bytes], left: np.ndarray, ids: np.ndarray, length: int):
    """For every window of every piece (distinct texts, ``left`` the byte before
    or -1, ``ids`` the smallest document): the smallest document with that
    window.  Also the maximal repeats met: (length, occurrences, first document)."""
    size = np.array([len(p) for p in pieces], dtype=np.int64)
    base = np.cumsum(size) - size
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    windows = size - length + 1
    piece = np.repeat(np.arange(len(pieces)), windows)
    inner = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = base[piece] + inner
    order, lcp = enhanced_suffix_array(data, at, size[piece] - inner)
    before = np.where(inner > 0, data[np.maximum(at - 1, 0)].astype(np.int16), left[piece])[order]
    owner = ids[piece][order]
    least = owner.copy()
    repeats = []
    for common_bytes, lo, hi, depth in interval_tree(lcp, length):
        earliest = owner[lo:hi].min()
        sides = before[lo:hi]
        if sides.min() < 0 or (sides != sides[0]).any():  # left extensions differ
            repeats.append((common_bytes, hi - lo, int(earliest)))
        if depth == 0:
            least[lo:hi] = earliest
    out = np.empty(len(piece), np.int64)
    out[order] = least
    return out, windows, repeats


# -- the plan ----------------------------------------------------------------

def repeated_ranges(batch: pd.DataFrame) -> pd.DataFrame:
    """One hash range: which minimisers of each block are in two documents."""
    sizes = [len(x) // 6 for x in batch.minimisers]
    raw = np.frombuffer(b"".join(batch.minimisers), dtype=np.uint8).reshape(-1, 6).astype(np.uint64)
    value = sum(raw[:, k] << np.uint64(8 * k) for k in range(6))
    counts = np.concatenate([np.frombuffer(zlib.decompress(x), dtype=np.uint16) for x in batch.counts])
    several = (counts & 1).astype(bool)
    order = np.argsort(value, kind="stable")
    v = value[order]
    new = np.r_[True, v[1:] != v[:-1]]
    start = np.flatnonzero(new)
    blocks = np.diff(np.r_[start, len(v)])
    repeated = (blocks > 1) | np.logical_or.reduceat(several[order], start)
    total = np.add.reduceat((counts[order] >> 1).astype(np.int64), start)
    of = np.empty(len(v), np.int64)
    of[order] = np.cumsum(new) - 1
    out, lo = [], 0
    for block, r, n in zip(batch.block, batch.range, sizes):
        mine = of[lo:lo + n]
        lo += n
        out.append((block, 0, r, np.packbits(repeated[mine]).tobytes(),
                    total[mine].clip(0, 2 ** 31 - 1).astype("<i4")[repeated[mine]].tobytes()))
    return pd.DataFrame(out, columns=["block", "step", "range", "a", "b"])


def flags_of(block: Block, replies: pd.DataFrame, ranges: int, hot: int):
    repeated, many = np.zeros(len(block.unique), bool), np.zeros(len(block.unique), bool)
    replies = {int(r): (a, b) for s, r, a, b in zip(replies.step, replies.range, replies.a, replies.b) if s == 0}
    for r, where in ranges_in(range_of(block.unique << np.uint64(16), ranges)):
        n = where.stop - where.start
        a, b = replies[r]
        bits = np.unpackbits(np.frombuffer(a, dtype=np.uint8), count=n).astype(bool)
        repeated[where] = bits
        many[np.flatnonzero(bits) + where.start] = np.frombuffer(b, dtype="<i4") > hot
    return repeated, many


def _plan(docs: DataFrame, doc_id: str, text: str, length: int, gram: int, hot: int):
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    size = common.total_bytes(slim)
    blocks = max(1, -(-size // BLOCK_BYTES))
    ranges = max(1, -(-size * 2 // (length - gram + 2) // RANGE_MINIMISERS))
    dealt = max(1, -(-size * 2 // (length - gram + 2) // RANGE_SEGMENTS))
    placed = slim.withColumn("block", F.pmod(F.xxhash64(F.coalesce("id", F.octet_length("text"))), F.lit(blocks)))

    def send_minimisers(key, batch: pd.DataFrame) -> pd.DataFrame:
        block = Block(batch.id.tolist(), batch.text.tolist()).minimisers(length, gram)
        raw = np.ascontiguousarray(block.unique).view(np.uint8).reshape(-1, 8)[:, :6]
        counts = (np.minimum(block.count, 32767).astype(np.uint16) << 1) | block.several.astype(np.uint16)
        out = [(r, key[0], raw[w].tobytes(), zlib.compress(counts[w].tobytes(), 1))
               for r, w in ranges_in(range_of(block.unique << np.uint64(16), ranges))]
        return pd.DataFrame(out, columns=["range", "block", "minimisers", "counts"])

    def send_segments(key, batch: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        block = Block(batch.id.tolist(), batch.text.tolist()).minimisers(length, gram)
        block.segments(*flags_of(block, replies, ranges, hot), length, dealt)
        out = []
        for r, w in ranges_in(block.u_range):
            first = block.first[w]
            size = block.s_windows[first] + length - 1
            data, _ = gather(block.flat, block.base[block.s_text[first]] + block.s_start[first], size)
            out.append((r, key[0], block.u_key[w].tobytes(), size.astype(np.uint8).tobytes(),
                        block.u_id[w].tobytes(), block.u_left[w].tobytes(), data.tobytes()))
        return pd.DataFrame(out, columns=["range", "block", "keys", "sizes", "ids", "lefts", "data"])

    def scan_range(batch: pd.DataFrame) -> pd.DataFrame:
        return answers(batch, length)

    asked = placed.groupBy("block").applyInPandas(
        send_minimisers, "range long, block long, minimisers binary, counts binary")
    told = asked.groupBy("range").applyInPandas(
        repeated_ranges, "block long, step int, range long, a binary, b binary")
    sent = placed.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(
        send_segments, "range long, block long, keys binary, sizes binary, ids binary, lefts binary, data binary")
    return placed, told, sent, scan_range, ranges, dealt


def answers(batch: pd.DataFrame, length: int) -> pd.DataFrame:
    """One range of segments: for each block's segments, in order, the windows
    that an earlier document has (64 bits each)."""
    sizes = [np.frombuffer(x, dtype=np.uint8).astype(np.int64) for x in batch.sizes]
    size = np.concatenate(sizes)
    key = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in batch["keys"]])
    own = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in batch.ids])
    left = np.concatenate([np.frombuffer(x, dtype=np.int16) for x in batch.lefts])
    data = np.frombuffer(b"".join(batch.data), dtype=np.uint8)
    first = np.cumsum(size) - size
    h1, h2 = piece_hashes(data, first, size)
    order = np.lexsort((own, h2, h1, key))
    k, a, b = key[order], h1[order], h2[order]
    new_key = np.r_[True, k[1:] != k[:-1]]
    new = new_key | np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    of = np.empty(len(size), np.int64)
    of[order] = np.cumsum(new) - 1
    head = order[new]
    least = own[head]
    lefts = left[head].copy()
    differ = np.zeros(len(head), bool)
    np.logical_or.at(differ, of, left != lefts[of])
    lefts[differ] = -1
    # Only keys with two distinct segments can share windows in part.
    group = (np.cumsum(new_key) - 1)[new]
    alone = np.bincount(group)[group] == 1
    mask = np.zeros(len(head), np.uint64)
    chosen = np.flatnonzero(~alone)
    if len(chosen):
        pieces = [data[first[i]:first[i] + size[i]].tobytes() for i in head[chosen].tolist()]
        firsts, windows, _ = first_documents(pieces, lefts[chosen], least[chosen], length)
        hit = firsts < np.repeat(least[chosen], windows)
        nth = np.arange(len(hit)) - np.repeat(np.cumsum(windows) - windows, windows)
        bits = np.where(hit, np.uint64(1) << nth.astype(np.uint64), np.uint64(0))
        mask[chosen] = np.bitwise_or.reduceat(bits, np.cumsum(windows) - windows)
    reply = np.where(least[of] < own, ALL, mask[of])
    out, lo = [], 0
    for block, r, x in zip(batch.block, batch.range, sizes):
        out.append((block, 1, r, zlib.compress(reply[lo:lo + len(x)].tobytes(), 1), b""))
        lo += len(x)
    return pd.DataFrame(out, columns=["block", "step", "range", "a", "b"])


def covered_bytes(block: Block, replies: pd.DataFrame, ranges: int, dealt: int, hot: int, length: int):
    """The removed ranges (start, end) of every distinct text of a block."""
    block.segments(*flags_of(block, replies, ranges, hot), length, dealt)
    mask = np.zeros(len(block.u_key), np.uint64)
    mine = {int(r): a for s, r, a in zip(replies.step, replies.range, replies.a) if s == 1}
    for r, where in ranges_in(block.u_range):
        mask[where] = np.frombuffer(zlib.decompress(mine[r]), dtype=np.uint64)
    # Further copies in this block, in later documents, go whole.
    bits = np.where(block.ids[block.s_text] > block.u_id[block.of], ALL, mask[block.of])
    some = np.flatnonzero(bits)
    bits, windows = bits[some], block.s_windows[some]
    first = block.base[block.s_text[some]] + block.s_start[some]
    change = np.zeros(len(block.flat) + 1, dtype=np.int32)
    for lo in range(0, len(some), STEP):
        b, w = bits[lo:lo + STEP], windows[lo:lo + STEP]
        nth = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        hit = (np.repeat(b, w) >> nth.astype(np.uint64) & np.uint64(1)).astype(bool)
        at = (np.repeat(first[lo:lo + STEP], w) + nth)[hit]
        np.add.at(change, at, 1)
        np.add.at(change, at + length, -1)
    inside = np.cumsum(change[:-1]) > 0
    limits = np.r_[block.base, len(block.flat)]
    edge = np.zeros(len(block.flat) + 1, dtype=bool)  # runs end where their text ends
    edge[limits] = True
    starts = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | edge[:-1]))
    ends = np.flatnonzero(inside & (np.r_[~inside[1:], True] | edge[1:])) + 1
    text = np.searchsorted(limits, starts, side="right") - 1
    # Empty texts share a limit with their successor and own no byte.
    spans: list[list[tuple[int, int]]] = [[] for _ in block.texts]
    for k, i, j in zip(text.tolist(), starts.tolist(), ends.tolist()):
        o = int(block.base[k])
        spans[k].append((i - o, j - o))
    return spans


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   gram: int = GRAM, hot: int = HOT, keep_bytes: bool = True) -> DataFrame:
    """One row per row of ``docs``: (doc_id long, n_bytes, spans
    array<struct<start,end>> of removed byte ranges, kept_sha256 and, with
    ``keep_bytes``, kept binary)."""
    placed, told, sent, scan_range, ranges, dealt = _plan(docs, doc_id, text, length, gram, hot)
    replies = told.unionByName(sent.groupBy("range").applyInPandas(
        scan_range, "block long, step int, range long, a binary, b binary"))

    def finish(key, batch: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(batch):
            return pd.DataFrame(columns=["id", "n_bytes", "spans", "kept_sha256", "kept"])
        block = Block(batch.id.tolist(), batch.text.tolist()).minimisers(length, gram)
        spans = covered_bytes(block, given, ranges, dealt, hot, length)
        out = []
        for own, raw in block.rows:
            if own is None:
                gone = []
            else:
                k = block.number[raw]
                gone = [(0, len(raw))] if own > block.ids[k] and len(raw) >= length else spans[k]
            kept, last = [], 0
            for i, j in gone:
                kept.append(raw[last:i])
                last = j
            kept.append(raw[last:])
            rest = b"".join(kept)
            out.append((own, len(raw), [{"start": i, "end": j} for i, j in gone], common.sha(rest),
                        rest if keep_bytes else None))
        frame = pd.DataFrame(out, columns=["id", "n_bytes", "spans", "kept_sha256", "kept"])
        frame["id"] = frame["id"].astype("Int64")
        return frame

    out = placed.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(
        finish, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary")
    out = out.withColumnRenamed("id", doc_id)
    return out if keep_bytes else out.drop("kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return remove_repeats(docs, keep_bytes=False).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
