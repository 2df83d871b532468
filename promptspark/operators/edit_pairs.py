"""Pairs of similar texts of one cell (see ``similarity.near_texts``), exactly.

Every pair whose lengths allow the similarity is tested, by bits.  An edit takes ``q`` q-grams
from a text at most (and adds as many), so of two texts within ``k`` edits neither has more than
``q * k`` grams, counted with repeats, that the other lacks; the bits that the grams are dealt to
by hash can only be fewer.  Long texts of one language share most grams: the blocks of one are
then sought in the windows of the other that ``k`` edits let them reach, and the edits that each
block needs by its best window are summed up.  What is left goes to Myers' bit vectors.

:func:`distances` takes whole texts, however unlike: the bit vectors of many pairs, in words of
64 characters, take a step at once.
"""

from __future__ import annotations

import numpy as np

#: X texts that are compared at once with one set of Y bits, and by how much their lengths may differ.
ROWS, RATIO = 8192, 1.1
#: Pairs of a tile, bytes of a table of flags before they are packed, and characters whose grams are counted at once.
TILE, FLAGS, PIECE = 1 << 17, 1 << 24, 1 << 20
#: Characters from which blocks are sought; a block, the places between windows, and the edits of a block that are told apart.
LONG, BLOCK, STRIDE, APART = 600, 64, 32, 16
#: Gram size and 64-bit words of a block.
BLOCK_GRAM, BLOCK_WORDS = 3, 16
#: Texts of fewer characters are compared by counts of so many letters in so many 64-bit words first.
SHORT, LETTERS, LETTER_WORDS = 140, 32, 2


def myers(x: str, y: str, k: int, whole: bool = True) -> int:
    """Edit distance of x and y, or, unless ``whole``, the least one of x to a
    beginning of y; -1 if it is over k."""
    m = len(x)
    if not m:
        return (len(y) if len(y) <= k else -1) if whole else 0
    masks: dict[str, int] = {}
    for i, c in enumerate(x):
        masks[c] = masks.get(c, 0) | 1 << i
    every, top, d = (1 << m) - 1, 1 << (m - 1), m
    up, down, least = every, 0, m
    for c in y:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = (down | ~(xh | up)) & every, up & xh
        if ph & top:
            d += 1
        elif mh & top:
            d -= 1
            if d < least:
                least = d
        ph, mh = ph << 1 | 1, mh << 1
        up, down = (mh | ~(xv | ph)) & every, ph & xv & every
    d = d if whole else least
    return d if d <= k else -1


def distance(x: str, y: str, k: int) -> int:
    """Edit distance of x and y, -1 if it is over k.  Unlike texts differ by far more
    than k edits, so that a beginning of x is too far from each beginning of y."""
    if x == y:
        return 0
    if k <= 0 or abs(len(x) - len(y)) > k:
        return -1
    begin = 9 * k // 4
    if begin < len(x) and myers(x[:begin], y[:begin + k], k, False) < 0:
        return -1
    return myers(x, y, k)


#: Words of 64 characters that take a step together at most, as many of them as a step without
#: any costs, and entries of their table of characters at most.
LANES, STEP, ENTRIES = 12288, 4000, 1 << 22


def distances(pairs: list[tuple[str, str]]) -> list[int]:
    """Edit distance of each (x, y).  The longer text of a pair is cut into words, a lane
    each; pairs that need like numbers of steps go together, by the cheapest division."""
    out, todo = [0] * len(pairs), []
    for i, (x, y) in enumerate(pairs):
        x, y = (x, y) if len(x) >= len(y) else (y, x)
        if x != y and y:
            todo.append((len(y) + -(-len(x) // 64) - 1, i, x, y))
        elif x != y:
            out[i] = len(x)
    todo.sort(key=lambda p: p[0])
    lanes = np.cumsum([0] + [-(-len(x) // 64) for _, _, x, _ in todo])
    cost, begin = np.zeros(len(todo) + 1), np.zeros(len(todo) + 1, np.int64)
    for b, (steps, *_) in enumerate(todo, 1):
        a = min(int(np.searchsorted(lanes, lanes[b] - LANES)), b - 1)
        costs = cost[a:b] + float(steps) * (STEP + lanes[b] - lanes[a:b])
        begin[b] = a + np.argmin(costs)
        cost[b] = costs[begin[b] - a]
    b = len(todo)
    while b:
        a = begin[b]
        for (_, i, _, _), d in zip(todo[a:b], _together([p[2:] for p in todo[a:b]])):
            out[i] = int(d)
        b = a
    return out


def _together(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Edit distances of pairs that are not empty, all in one go (Myers, Hyyro): lane w of a
    pair takes character t - w of y at step t, so that what it hands to lane w + 1 is there
    at the next step.  All pairs end at the same step.  Before a pair begins, its lanes take
    a character that changes nothing; the lowest bits of its first lane, which belong to no
    character of x, are rows of the same values as the table's first."""
    m, n = (np.array([len(p[side]) for p in pairs], np.int64) for side in (0, 1))
    lanes, chars = -(-m // 64), [np.frombuffer("".join(p[side] for p in pairs).encode("utf-32-le", "surrogatepass"), np.uint32)
                                 for side in (0, 1)]
    alphabet, xs, times = np.unique(chars[0], return_inverse=True, return_counts=True)
    rank = np.empty(len(alphabet), np.int64)
    rank[np.argsort(-times, kind="stable")] = np.arange(len(alphabet))  # common characters share cache lines
    xs = rank[xs]
    kinds, size = len(alphabet) + 2, int(lanes.sum())  # the last ones: not in x, before y
    if len(pairs) > 1 and kinds * size > ENTRIES:
        half = len(pairs) // 2
        return np.concatenate([_together(pairs[:half]), _together(pairs[half:])])
    steps = int((n + lanes).max()) - 1
    start, first, last = steps - (n + lanes - 1), np.cumsum(lanes) - lanes, np.cumsum(lanes)  # last: in h, which is a lane ahead
    spare = 64 * lanes - m
    row = np.arange(len(xs)) - np.repeat(np.cumsum(m) - m - spare, m)
    place = (np.repeat(first, m) + row // 64) * kinds + xs
    order = np.argsort(place, kind="stable")
    place, bit = place[order], (np.uint64(1) << (row % 64).astype(np.uint64))[order]
    begins = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    table = np.zeros(size * kinds, np.uint64)
    table[place[begins]] = np.bitwise_or.reduceat(bit, begins)
    low = (np.uint64(1) << spare.astype(np.uint64)) - np.uint64(1)
    table[first * kinds + kinds - 1] = low
    ys = np.minimum(np.searchsorted(alphabet, chars[1]), len(alphabet) - 1)
    ys = np.where(alphabet[ys] == chars[1], rank[ys], kinds - 2)
    lead = start + lanes - 1
    off = np.cumsum(lead + n + lanes) - (lead + n + lanes)
    dealt = np.full(int((lead + n + lanes).sum()), kinds - 1, np.int64)
    dealt[np.arange(len(ys)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(off + lead, n)] = ys
    at = np.repeat(off + lead - start + first, lanes) - np.arange(size)
    base, one, top = np.arange(size) * kinds, np.uint64(1), np.uint64(63)
    state, other = np.zeros((2, size), np.uint64), np.empty((2, size), np.uint64)  # +1 and -1 to the character before
    state[0] = ~np.uint64(0)
    state[0, first] = ~low
    carry = np.zeros((2, size + 1), np.uint64)  # what lanes get from the one before
    carry_in, carry_out, less = carry[:, :-1], carry[:, 1:], carry[1, :-1]
    i, a, eq = np.empty(size, np.int64), np.empty(size, np.uint64), np.empty(size, np.uint64)
    score, begun, starts, k = np.zeros((2, len(pairs)), np.uint64), np.zeros((2, len(pairs)), np.uint64), np.sort(start), 0
    for t in range(steps):
        if k < len(pairs) and starts[k] <= t:
            begun[0, start <= t] = 1
            k = int(np.searchsorted(starts, t, "right"))
        carry[:, first] = begun
        np.take(dealt, at, out=i, mode="clip")
        np.add(i, base, out=i)
        np.take(table, i, out=eq, mode="clip")
        np.add(at, 1, out=at)
        up, down = state
        b, c = other
        np.bitwise_or(eq, down, out=a)
        np.bitwise_or(eq, less, out=eq)
        np.bitwise_and(eq, up, out=b)
        np.add(b, up, out=b)
        np.bitwise_xor(b, up, out=b)
        np.bitwise_or(b, eq, out=b)
        np.bitwise_and(up, b, out=c)
        np.bitwise_or(b, up, out=b)
        np.invert(b, out=b)
        np.bitwise_or(b, down, out=b)
        np.left_shift(other, one, out=state)
        np.bitwise_or(state, carry_in, out=state)
        np.right_shift(other, top, out=carry_out)
        np.bitwise_or(a, up, out=b)
        np.invert(b, out=b)
        np.bitwise_or(b, down, out=b)
        np.bitwise_and(up, a, out=c)
        state, other = other, state
        score += carry[:, last]
    return m + score[0].astype(np.int64) - score[1].astype(np.int64)


def shape(chars: int, tau: float) -> tuple[int, int]:
    """Gram size and 64-bit words for texts of up to ``chars`` characters."""
    q = 3 if chars < 224 else 4 if chars < 1400 else 5
    while q > 1 and q * (1.0 - tau) > 0.8:
        q -= 1
    return q, max(2, -(-chars * (9 if chars < 256 else 12) // 128))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q-grams from each place; the last q - 1 are without meaning."""
    out = np.zeros(len(codes), np.uint32)
    for i in range(q):
        out = mixed(out ^ np.roll(codes, -i))
    return out


class Texts:
    """The texts of a cell by bytes, with their characters behind each other."""

    def __init__(self, texts: list[str], home: np.ndarray, tau: float):
        nbytes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
        order = np.argsort(nbytes, kind="stable")
        self.texts, self.home, self.nbytes = [texts[i] for i in order], home[order], nbytes[order]
        self.chars = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.chars)])
        self.codes = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.k = np.floor(self.nbytes.astype(float) * (1.0 - tau) + 1e-9).astype(np.int64)
        self.tau, self.hashes, self.blocks, self.counts = tau, {}, {}, None

    def counted(self, q: int) -> np.ndarray:
        """Per character the hash of its q-gram and of how often the text had it before."""
        if q not in self.hashes:
            out, a, n = np.zeros(len(self.codes), np.uint32), 0, len(self.texts)
            while a < n:
                b = max(a + 1, int(np.searchsorted(self.ends, self.ends[a] + PIECE, "right")) - 1)
                here = slice(self.ends[a], self.ends[b])
                key = grams(self.codes[here], q).astype(np.uint64) | np.repeat(np.arange(b - a, dtype=np.uint64), self.chars[a:b]) << np.uint64(32)
                # stable: what hangs over a text's end is counted after the grams before it
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                times = np.empty(len(key), np.uint32)
                times[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
                out[here] = mixed(grams(self.codes[here], q) + mixed(times))
                a = b
            self.hashes[q] = out
        return self.hashes[q]

    def over(self, a: int, b: int, q: int) -> np.ndarray:
        """Whether the gram from each character of the texts a to b hangs over its text's end."""
        left = np.repeat(self.ends[a + 1:b + 1] - self.ends[a], self.chars[a:b]) - np.arange(self.ends[b] - self.ends[a])
        return left < q

    def bits(self, a: int, b: int, q: int, words: int) -> np.ndarray:
        """(words, rows) of the texts a to b: a bit for each gram and time."""
        out, step = np.empty((words, b - a), np.uint64), max(1, FLAGS // (64 * words))
        for i in range(a, b, step):
            j = min(i + step, b)
            bit = (self.counted(q)[self.ends[i]:self.ends[j]].astype(np.uint64) * np.uint64(64 * words)) >> np.uint64(32)
            place = bit.astype(np.int64) + np.repeat(np.arange(j - i), self.chars[i:j]) * (64 * words)
            flags = np.zeros((j - i) * 64 * words, bool)
            flags[place[~self.over(i, j, q)]] = True
            out[:, i - a:j - a] = np.packbits(flags.reshape(j - i, 64 * words), axis=1).view(np.uint64).T
        return out

    def blocked(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits of the grams of text i's blocks, and of its windows."""
        if i not in self.blocks:
            codes = self.codes[self.ends[i]:self.ends[i + 1]]
            bit = (grams(codes, BLOCK_GRAM) % np.uint32(64 * BLOCK_WORDS)).astype(np.int64)
            at, n = np.arange(len(codes) - BLOCK_GRAM + 1), -(-len(codes) // BLOCK)
            own = np.zeros((n, 64 * BLOCK_WORDS), bool)
            inside = at[at % BLOCK <= BLOCK - BLOCK_GRAM]
            own[inside // BLOCK, bit[inside]] = True
            windows = np.zeros((len(codes) // STRIDE + 1, 64 * BLOCK_WORDS), bool)
            for d in range(-(-(BLOCK + STRIDE + APART) // STRIDE)):
                w = at // STRIDE - d
                inside = at[(w >= 0) & (at - w * STRIDE <= BLOCK + STRIDE + APART - BLOCK_GRAM)]
                windows[inside // STRIDE - d, bit[inside]] = True
            self.blocks[i] = tuple(np.packbits(f, axis=1).view(np.uint64) for f in (own, windows))
        return self.blocks[i]

    def apart(self, x: int, y: int) -> bool:
        """Whether the blocks of x need more edits than x may have to stand in y."""
        k, delta = int(self.k[x]), int(self.chars[y] - self.chars[x])
        own, windows = self.blocked(x)[0], self.blocked(y)[1]
        at = np.arange(len(own)) * BLOCK
        first = np.clip((at + (delta - k) // 2) // STRIDE, 0, len(windows) - 1)
        last = np.clip((at - (-delta - k) // 2) // STRIDE, 0, len(windows) - 1)
        reach = first[:, None] + np.arange(int((last - first).max()) + 1)
        there = windows[np.minimum(reach, last[:, None])]
        best = np.bitwise_count(there & own[:, None]).sum(axis=2, dtype=np.int32).max(axis=1)
        lost = np.bitwise_count(own).sum(axis=1, dtype=np.int32) - best
        return int(np.minimum(-(-lost // BLOCK_GRAM), APART + 1).sum()) > k

    def letters(self) -> np.ndarray:
        """(texts, LETTERS) how often each text has the commonest characters of the cell."""
        if self.counts is None:
            found, times = np.unique(self.codes, return_counts=True)
            common = np.sort(found[np.argsort(-times, kind="stable")[:LETTERS]])
            self.counts = np.zeros((len(self.texts), LETTERS), np.uint16)
            for a in range(0, len(self.texts) if len(common) else 0, ROWS):
                b = min(a + ROWS, len(self.texts))
                codes = self.codes[self.ends[a]:self.ends[b]]
                at = np.minimum(np.searchsorted(common, codes), len(common) - 1)
                at = np.where(common[at] == codes, at, LETTERS) + np.repeat(np.arange(b - a), self.chars[a:b]) * (LETTERS + 1)
                n = np.bincount(at, minlength=(b - a) * (LETTERS + 1)).reshape(b - a, LETTERS + 1)[:, :LETTERS]
                self.counts[a:b] = np.minimum(n, 65535)
        return self.counts

    def limits(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The characters and least counts that divide the texts a to b most evenly."""
        some = self.letters()[a:b:max(1, (b - a) // 512)]
        least = np.arange(1, int(some.max(initial=1)) + 1)
        share = (some[:, :, None] >= least).mean(axis=0)
        best = np.argsort(-(share * (1 - share)).ravel(), kind="stable")[:64 * LETTER_WORDS]
        best = np.resize(best, 64 * LETTER_WORDS)  # a bit twice would count twice
        new = np.zeros(len(best), bool)
        new[np.unique(best, return_index=True)[1]] = True
        return best // len(least), np.where(new, least[best % len(least)], 65536)

    def letter_bits(self, a: int, b: int, limits) -> np.ndarray:
        """(words, rows) of the texts a to b: whether they have a character so often."""
        has = np.ascontiguousarray(self.letters()[a:b][:, limits[0]] >= limits[1])
        return np.packbits(has, axis=1).view(np.uint64).T.copy()

    def maybe(self, a: int, b: int, start: int):
        """(x, y) of the pairs that may be similar, x in a to b, y in start to x."""
        most = int(self.chars[a:b].max())
        q, words = shape(most, self.tau)
        by_letters = most < SHORT
        limits = self.limits(a, b) if by_letters else None
        loss, fine = 1 if by_letters else q, 3 * words
        first = (lambda i, j: self.letter_bits(i, j, limits)) if by_letters else (lambda i, j: self.bits(i, j, q, words))
        x, x_fine = first(a, b), self.bits(a, b, q, fine).T.copy()
        x_had = np.bitwise_count(x).sum(axis=0, dtype=np.int32)
        x_spare = np.maximum(x_had - loss * self.k[a:b], 0)
        kind = np.uint8 if 64 * len(x) < 256 or most < 256 else np.uint16 if most < 65536 else np.uint32
        visits, side = not self.home[a:b].any(), max(1, min(4096, FLAGS // (8 * words)))
        for i in range(start, b, side):
            j = min(i + side, b)
            if visits and not self.home[i:j].any():
                continue
            y, y_fine = first(i, j), self.bits(i, j, q, fine).T.copy()
            y_had = np.bitwise_count(y).sum(axis=0, dtype=np.int32)
            rows = max(1, TILE // (j - i))
            both, common = np.empty((rows, j - i), np.uint64), np.empty((rows, j - i), kind)
            some = np.empty((rows, j - i), np.uint8)
            for r in range(max(a, i), b, rows):
                n = min(rows, b - r)
                np.bitwise_and(x[0, r - a:r - a + n, None], y[0], out=both[:n])
                np.bitwise_count(both[:n], out=common[:n])
                for w in range(1, len(x)):
                    np.bitwise_and(x[w, r - a:r - a + n, None], y[w], out=both[:n])
                    np.bitwise_count(both[:n], out=some[:n])
                    np.add(common[:n], some[:n], out=common[:n])
                xs, ys = np.divmod(np.flatnonzero(common[:n] >= x_spare[r - a:r - a + n, None].astype(kind)), j - i)
                had = common[xs, ys].astype(np.int64)
                xs, ys = xs + r, ys + i
                ok = ((ys < xs) & (np.abs(self.chars[xs] - self.chars[ys]) <= self.k[xs])
                      & (self.home[xs] | self.home[ys]) & (had + loss * self.k[xs] >= y_had[ys - i]))
                xs, ys = xs[ok], ys[ok]
                for c in range(0, len(xs), max(1, FLAGS // (32 * fine))):
                    xc, yc = xs[c:c + max(1, FLAGS // (32 * fine))], ys[c:c + max(1, FLAGS // (32 * fine))]
                    gone = np.bitwise_count(x_fine[xc - a] & ~y_fine[yc - i]).sum(axis=1, dtype=np.int32)
                    ok = gone <= q * self.k[xc]
                    yield from zip(xc[ok].tolist(), yc[ok].tolist())

    def groups(self):
        """Stretches a to b of X texts of like length, and the first text that may be Y."""
        a, n = 0, len(self.texts)
        while a < n:
            longest = max(self.nbytes[a] * RATIO, self.nbytes[a] + 1)
            b = min(int(np.searchsorted(self.nbytes, longest, "right")), a + ROWS)
            least = int((self.chars[a:b] - self.k[a:b]).min())
            yield a, b, int(np.searchsorted(self.nbytes, least, "left"))
            a = b

    def pairs(self):
        """(x, y, distance) of the pairs within x's k edits; y has no more bytes."""
        for a, b, start in self.groups():
            self.blocks.clear()
            for x, y in self.maybe(a, b, start):
                if self.chars[x] < LONG or not self.apart(x, y):
                    d = distance(self.texts[x], self.texts[y], int(self.k[x]))
                    if d >= 0:
                        yield x, y, d
