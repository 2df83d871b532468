"""Windows of texts that are similar to a pattern of a small library, exactly.

A window within ``d`` edits of a pattern holds all but ``d`` of the pattern's disjoint
segments, and with ``delta`` more characters than the pattern it moves a segment by x with
``|x| + |delta - x| <= d``: the diagonals (place in the text - place in the pattern) of its
hits are among d + 1 neighbours.  Segments are looked up at all places of many texts at
once.  Sorted by pattern and diagonal, enough hits close together name the windows to look
at; each of them is tested again by its own bound, and what is left by its edit distance.
"""

from __future__ import annotations

import numpy as np

from . import edit_pairs

#: Largest segment: shorter ones meet more often, but more of them must be found together.  How much more
#: often texts have a gram than the mean of all patterns has, and by how many deviations hits shall stand out.
LARGEST, ALIKE, CLEAR = 6, 4.0, 8.0
#: Characters of texts that are scanned together, hits from which they are parted again unless they
#: have few words, and windows that are looked at together; places that share a bound;
#: pairs whose distances are taken together.
CHARS, HITS, WORDS, WINDOWS, BLOCK, PAIRS = 1 << 19, 1 << 22, 4096, 1 << 20, 64, 1 << 14


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spread_ranges(lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of the values lo[i], lo[i] + 1, ... of each range."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size - lo, size)


class Library:
    """Patterns with the segments they are found by.  ``whole``: a window is a whole text;
    otherwise as many words as the pattern has, at similarity above tau instead of
    at least tau."""

    def __init__(self, patterns: list[str], tau: float, whole: bool = False):
        self.patterns, self.tau, self.whole, self.pending = patterns, tau, whole, []
        self.chars = np.array([len(p) for p in patterns], np.int64)
        self.nbytes = np.array([len(p.encode("utf-8", "surrogatepass")) for p in patterns], np.int64)
        self.n = np.array([1 if whole else p.count(" ") + 1 for p in patterns], np.int64)
        self.q = np.ones(len(patterns), np.int64)
        rows = self._chosen()
        self.segments = np.array([len(offs) for offs in rows], np.int64)
        self.index = {}
        for q in sorted(set(self.q.tolist())):
            at = [(j, o) for j in np.flatnonzero(self.q == q).tolist() for o in rows[j]]
            if at:
                pattern, off = np.array(at, np.int64).T
                every = {j: edit_pairs.grams(codes_of(patterns[j]), q) for j in set(pattern.tolist())}
                grams = np.array([every[j][o] for j, o in at], np.uint32)
                order = np.argsort(grams, kind="stable")
                keys, first, count = np.unique(grams[order], return_index=True, return_counts=True)
                some = np.zeros(1 << 17, bool)
                some[keys >> np.uint32(15)] = True
                self.index[q] = keys, first, count, pattern[order], off[order], some

    def _chosen(self) -> list[list[int]]:
        """Where the segments of each pattern begin that are looked up.  Any choice is exact;
        leaving out common ones leaves fewer hits and asks for fewer.  The patterns' own
        grams tell what is common; windows with some more bytes are allowed for."""
        edits = self.edits(self.nbytes) * 11 // 10 + 1
        rows, best = [list(range(n)) for n in self.chars.tolist()], [-1.0] * len(self.patterns)
        for q in range(1, LARGEST + 1):
            grams = [edit_pairs.grams(codes_of(t), q)[:max(0, len(t) - q + 1)] for t in self.patterns]
            keys, times = np.unique(np.concatenate([np.zeros(0, np.uint32), *grams]), return_counts=True)
            for j, g in enumerate(grams):
                offs = np.arange(0, len(g), q)
                often = ALIKE * times[np.searchsorted(keys, g[offs])] / max(1, times.sum())
                order = np.argsort(often, kind="stable")
                expected = (edits[j] + 1) * np.cumsum(often[order])
                spare = np.arange(1, len(offs) + 1) - edits[j] - expected
                clear = spare / np.sqrt(expected + 0.25)
                if len(offs) > edits[j] and (clear.max() > best[j] and best[j] < CLEAR):
                    enough = np.flatnonzero(clear >= CLEAR)
                    m = int(enough[0] if len(enough) else clear.argmax())
                    best[j], self.q[j], rows[j] = float(clear.max()), q, sorted(offs[order[:m + 1]].tolist())
        return rows

    def edits(self, nbytes):
        """Most edits between texts of which the longer one has so many bytes."""
        return np.floor(nbytes * (1.0 - self.tau) + 1e-9).astype(np.int64)

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, float]]:
        """(text, pattern, first word, similarity) of the best window, the earliest of equal
        ones, of each text and pattern.  A long text is scanned in pieces that overlap."""
        longest = int(self.n.max(initial=1))
        best, piece, size = {}, [], 0
        possible = self._possible(texts) if self.whole else [bool(t) for t in texts]
        for i, text in enumerate(texts):
            if not possible[i]:
                continue
            if size + len(text) > CHARS and piece:
                self._scan(piece, best)
                piece, size = [], 0
            if len(text) > CHARS and not self.whole:
                begins = np.r_[0, np.flatnonzero(codes_of(text) == 32) + 1, len(text) + 1]
                step = max(WORDS, CHARS * len(begins) // len(text))
                for w in range(0, len(begins) - 1, step):
                    last = min(w + step + longest - 1, len(begins) - 1)
                    self._scan([(i, w, text[begins[w]:begins[last] - 1])], best)
                continue
            piece.append((i, 0, text))
            size += len(text)
        if piece:
            self._scan(piece, best)
        self._decide(best)
        return [(i, j, -back, sim) for (i, j), (sim, back) in best.items()]

    def _possible(self, texts: list[str]) -> list[bool]:
        """Whether the length of each text allows any pattern."""
        chars, nbytes = (np.array([len(t) for t in ts], np.int64) for ts in (texts, [t.encode("utf-8", "surrogatepass") for t in texts]))
        out, rows = np.zeros(len(texts), bool), max(1, WINDOWS // max(1, len(self.patterns)))
        for a in range(0, len(texts), rows):
            here = slice(a, a + rows)
            out[here] = (np.abs(chars[here, None] - self.chars) <= self.edits(np.maximum(nbytes[here, None], self.nbytes))).any(axis=1)
        return out.tolist()

    def _scan(self, piece: list[tuple[int, int, str]], best: dict) -> None:
        """``piece``: (text, its word that the piece begins with, piece)."""
        joined = "\0".join(t for _, _, t in piece)
        codes = codes_of(joined)
        found = {}
        for q, (keys, _, count, *_, some) in self.index.items():
            grams = edit_pairs.grams(codes, q)[:max(0, len(codes) - q + 1)]
            at = np.flatnonzero(some[grams >> np.uint32(15)])
            key = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
            hit = keys[key] == grams[at]
            found[q] = at[hit], key[hit]
        if sum(int(self.index[q][2][key].sum()) for q, (_, key) in found.items()) > HITS and self._parted(piece, best):
            return
        lengths = np.array([len(t) for _, _, t in piece], np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        begins = starts if self.whole else np.sort(np.r_[starts, np.flatnonzero(codes == 32) + 1])
        text = np.searchsorted(starts, begins, "right") - 1
        begins = np.r_[begins, len(codes) + 1]
        wide = np.zeros(len(codes) + 1, np.int64)  # bytes beyond the first of a character before each place
        np.cumsum((codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000), out=wide[1:])
        # the most bytes that a window of so many words has, and so the most edits
        most = {n: int((wide[begins[n:] - 1] - wide[begins[:-n]]).max()) for n in set(self.n.tolist()) if n < len(begins)}
        extra = np.array([most.get(n, -1) for n in self.n.tolist()], np.int64)
        k = np.maximum(self.edits(self.nbytes), self._longest(self.chars, extra))
        view = piece, joined, begins, text, wide
        near = self._near(begins, wide, k, len(codes))
        for j in np.flatnonzero((extra >= 0) & (k >= self.segments)).tolist():
            # windows with so many bytes that no segment need be left
            every = np.flatnonzero(near[j, begins[:len(begins) - self.n[j]] // BLOCK] >= self.segments[j])
            for a in range(0, len(every), WINDOWS):
                i = every[a:a + WINDOWS]
                p = np.full(len(i), j)
                _, d, delta = self._windows(p, i, view)
                ok = (np.abs(delta) <= d) & (d >= self.segments[j])
                self._verify(p[ok], i[ok], view, best)
        bits = (len(codes) + int(self.chars.max(initial=0)) + 2 * int(k.max(initial=0)) + 2).bit_length() + 1
        shift = int(self.chars.max(initial=0) + k.max(initial=0))
        low_bits = int((self.chars // self.q).max(initial=0)).bit_length()  # for the segment
        for q, (at, key) in found.items():
            _, begin, count, pattern, off, _ = self.index[q]
            which, entry = spread_ranges(begin[key], count[key])
            p = pattern[entry]
            keys = ((p << bits) + at[which] - off[entry] + shift << low_bits) + off[entry] // q
            keys = np.sort(keys[extra[p] >= 0])
            segment = keys & ((1 << low_bits) - 1)
            keys >>= low_bits
            p = keys >> bits
            d = near[p, np.clip((keys & ((1 << bits) - 1)) - shift, 0, len(codes)) // BLOCK]
            last = np.arange(len(keys)) + np.maximum(self.segments[p] - d, 1) - 1
            ok = (d >= 0) & (last < len(keys))
            ok[ok] = keys[last[ok]] - keys[ok] <= d[ok]
            p, low, high, d = p[ok], keys[ok], keys[last[ok]], d[ok]
            low, high = low - (p << bits) - shift, high - (p << bits) - shift
            lo = np.searchsorted(begins[:-1], high - d)
            hi = np.searchsorted(begins[:-1], low + d, "right")
            order = np.argsort(lo + p * len(begins), kind="stable")
            p, lo, hi = p[order], lo[order], hi[order]
            if len(p):  # each window once: what comes before the last end of a pattern was there
                ends = np.maximum.accumulate(hi + p * len(begins)) - p * len(begins)
                lo[1:] = np.where(p[1:] == p[:-1], np.maximum(lo[1:], ends[:-1]), lo[1:])
            size = np.maximum(np.minimum(hi, len(begins) - self.n[p]) - lo, 0)
            ends, a = np.cumsum(size), 0
            while a < len(p):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + WINDOWS, "right")))
                which, i = spread_ranges(lo[a:b], size[a:b])
                pj = p[a:b][which]
                begin, d, delta = self._windows(pj, i, view)
                ok = (np.abs(delta) <= d) & (d < self.segments[pj])
                pj, i, begin, d, delta = pj[ok], i[ok], begin[ok], d[ok], delta[ok]
                base = (pj << bits) + shift + begin
                first = np.searchsorted(keys, base - (d - delta) // 2)
                n = np.searchsorted(keys, base + (delta + d) // 2, "right") - first
                ok = n >= self.segments[pj] - d
                pj, i, first, n, d = pj[ok], i[ok], first[ok], n[ok], d[ok]
                which, hit = spread_ranges(first, n)  # a segment counts once
                once = np.unique((which << low_bits) + segment[hit]) >> low_bits
                ok = np.bincount(once, minlength=len(pj)) >= self.segments[pj] - d
                self._verify(pj[ok], i[ok], view, best)
                a = b

    def _parted(self, piece, best) -> bool:
        """Scans the parts of a piece with many hits on their own, if it can be parted."""
        if len(piece) > 1:
            half = len(piece) // 2
            parts = [piece[:half], piece[half:]]
        else:
            [(i, w, text)] = piece
            begins = np.r_[0, np.flatnonzero(codes_of(text) == 32) + 1, len(text) + 1]
            half, longest = len(begins) // 2, int(self.n.max(initial=1))
            if self.whole or len(begins) <= max(WORDS, 4 * longest):
                return False
            last = min(half + longest - 1, len(begins) - 1)
            parts = [[(i, w, text[:begins[last] - 1])], [(i, w + half, text[begins[half]:])]]
        for part in parts:
            self._scan(part, best)
        return True

    def _near(self, begins, wide, k, chars: int) -> np.ndarray:
        """(patterns, blocks of places): the most edits of the windows that begin within k of a block."""
        blocks, near = chars // BLOCK + 1, np.full((len(k), chars // BLOCK + 1), -1, np.int32)
        for n in set(self.n.tolist()):
            if n >= len(begins):
                continue
            begin, end = begins[:-n], begins[n:] - 1
            mine = np.flatnonzero(self.n == n)
            reach = min(int(k[mine].max()) // BLOCK + 1, blocks - 1)
            more = wide[end] - wide[begin]
            most, extra = (self._around(begin, value, blocks, reach) for value in (end - begin + more, more))
            d = np.minimum(self.edits(np.maximum(self.nbytes[mine, None], most)), np.maximum(
                self.edits(self.nbytes[mine, None]), self._longest(self.chars[mine, None], extra)))
            near[mine] = np.where(most >= 0, d, -1)
        return near

    def _longest(self, chars, extra):
        """Most edits to a window that has so many bytes more than characters."""
        return np.floor((chars + np.maximum(extra, 0)) * (1.0 - self.tau) / self.tau + 1e-9).astype(np.int64)

    @staticmethod
    def _around(begin, value, blocks: int, reach: int) -> np.ndarray:
        """The largest value in each block of places and ``reach`` blocks before and after it."""
        most = np.full(blocks, -1, np.int64)
        np.maximum.at(most, begin // BLOCK, value)
        out = most.copy()
        for r in range(1, reach + 1):
            np.maximum(out[r:], most[:-r], out=out[r:])
            np.maximum(out[:-r], most[r:], out=out[:-r])
        return out

    def _windows(self, p, i, view):
        """Where windows begin, the most edits, and the characters more than the pattern's; the
        most edits are -1 for windows across texts."""
        _, _, begins, text, wide = view
        begin, end = begins[i], begins[i + self.n[p]] - 1
        d = self.edits(np.maximum(self.nbytes[p], end - begin + wide[end] - wide[begin]))
        return begin, np.where(text[i] == text[i + self.n[p] - 1], d, -1), end - begin - self.chars[p]

    def _verify(self, p, i, view, best) -> None:
        """Puts windows down for their edit distances, which many pairs take together."""
        piece, joined, begins, text, wide = view
        ends = begins[i + self.n[p]] - 1
        nbytes = np.maximum(self.nbytes[p], ends - begins[i] + wide[ends] - wide[begins[i]])
        word = i - np.searchsorted(text, text[i])
        for j, w, t, b, e, most in zip(*(a.tolist() for a in (p, word, text[i], begins[i], ends, nbytes))):
            self.pending.append((piece[t][0], j, piece[t][1] + w, joined[b:e], most))
        if len(self.pending) >= PAIRS:
            self._decide(best)

    def _decide(self, best) -> None:
        distances = edit_pairs.distances([(self.patterns[j], window) for _, j, _, window, _ in self.pending])
        for (doc, j, word, _, most), d in zip(self.pending, distances):
            sim = 1.0 - d / most if most else 1.0
            if sim >= self.tau if self.whole else sim > self.tau and d <= int(most * (1.0 - self.tau)):
                best[doc, j] = max(best.get((doc, j), (-1.0, 0)), (sim, -word))
        self.pending.clear()
