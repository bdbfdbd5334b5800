"""A compressed full-text index over many short texts, searched backwards in bulk.

The texts stand on end, each between marks. The index is the Burrows-Wheeler
transform, one or two bytes a character, with counts of each symbol sampled
every 64 places; the places between are counted eight (or four) at once in one
64-bit word. For 45 symbols that is about two and a half bytes a character. The
rows that start with a mark are in the order of their texts, so a match that
reaches a text's start needs no locating.

``search`` runs all patterns at once; the state is a frontier of suffix
intervals, one numpy array per column. From a text's end it follows a maximal
match backwards, may step over one slip (a letter lost, added or changed, two
neighbouring letters swapped) left of an exact tail of a given length, and
follows the next match up to the text's start. The two spans of a match are
merged: of several ways the one with the longer span at the end counts.
"""

from __future__ import annotations

import numpy as np

MARK = 0
#: Suffix intervals up to this width are read from the transform symbol by symbol.
NARROW = 4
#: Places between two samples of the counts, and samples that one far count serves.
BLOCK, FAR = 64, 512


def _codes(texts: list[str], table: dict[str, int]) -> np.ndarray:
    """Symbols of the texts on end, each followed by a mark; unknown letters get -1, other unknown characters -2."""
    points = np.frombuffer(("\x00".join(texts) + "\x00").encode("utf-32-le"), np.uint32)
    known, inverse = np.unique(points, return_inverse=True)
    symbols = np.array([table.get(chr(p), -1 if chr(p).isalpha() else -2) if p else MARK for p in known.tolist()], np.int64)
    return symbols[inverse.reshape(-1)]


class Index:
    def __init__(self, texts: list[str]):
        """texts: distinct and without the character 0."""
        chars = sorted(set("".join(texts)))
        self.table = {c: i + 1 for i, c in enumerate(chars)}
        self.letters = np.array([self.table[c] for c in chars if c.isalpha()], np.int64)
        self.is_letter = np.zeros(len(chars) + 2, bool)
        self.is_letter[self.letters] = True
        t = np.concatenate([[MARK], _codes(texts, self.table)]) if texts else np.zeros(1, np.int64)
        self.n = len(t)
        order = self._suffixes(t, len(chars) + 1)
        bwt = t[order - 1]
        self.first = np.searchsorted(np.sort(bwt), np.arange(len(chars) + 1))
        self._sample(bwt, len(chars) + 1)
        self.n_marks = len(texts) + 1
        starts = np.flatnonzero(t == MARK)
        self.text_of = np.searchsorted(starts, order[: self.n_marks])
        self.text_of[self.text_of == len(texts)] = -1  # the mark after the last text starts none

    @staticmethod
    def _suffixes(t: np.ndarray, sigma: int) -> np.ndarray:
        """Order of the cyclic suffixes, by keys of doubled width until all differ."""
        n = len(t)
        bits = max(1, int(sigma).bit_length())
        width, rank = max(1, min(n, 62 // bits)), np.zeros(n, np.int64)
        for k in range(width):
            rank = (rank << bits) | np.roll(t, -k)
        while True:
            _, rank = np.unique(rank, return_inverse=True)
            rank = rank.reshape(-1)
            top = int(rank.max()) + 1
            if top == n or width >= n:
                return np.argsort(rank, kind="stable")
            rank = rank * top + np.roll(rank, -width)
            width *= 2

    def _sample(self, bwt: np.ndarray, sigma: int) -> None:
        kind = np.uint8 if sigma <= 256 else np.uint16
        self.bits = 8 * kind().nbytes
        ones = sum(1 << k for k in range(0, 64, self.bits))
        self.ones, self.low = np.uint64(ones), np.uint64(ones * ((1 << (self.bits - 1)) - 1))
        blocks = self.n // BLOCK + 1
        self.bwt = np.zeros(blocks * BLOCK, kind)
        self.bwt[: self.n] = bwt
        self.rows = self.bwt.view(np.uint64).reshape(blocks, -1)
        # of the places before each one of a block, the top bits of their symbols
        self.masks = np.tril(np.ones((BLOCK, BLOCK), bool), -1).astype(kind)
        self.masks = (self.masks * kind(1 << (self.bits - 1))).view(np.uint64)
        held = np.bincount(bwt * blocks + np.arange(self.n) // BLOCK, minlength=sigma * blocks).reshape(sigma, blocks)
        before = np.concatenate([np.zeros((sigma, 1), np.int64), np.cumsum(held, 1)[:, :-1]], 1)
        self.far = before[:, ::FAR].astype(np.int64)
        self.near = (before - np.repeat(self.far, FAR, 1)[:, :blocks]).astype(np.uint16)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before the place."""
        block = at >> BLOCK.bit_length() - 1
        x = self.rows[block] ^ (symbol.astype(np.uint64) * self.ones)[:, None]
        x = ~(((x & self.low) + self.low) | x | self.low)  # the top bit of each equal symbol
        x &= self.masks[at & BLOCK - 1]
        return self.far[symbol, block // FAR] + self.near[symbol, block] + np.bitwise_count(x).sum(1, dtype=np.int64)

    def back(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The backward step from a place by a symbol."""
        return self.first[symbol] + self.rank(symbol, at)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals a symbol further to the left; narrow ones are read, and counted only where the symbol is there."""
        width = hi - lo
        slim = np.flatnonzero(width <= NARROW)
        there = np.zeros(len(slim), np.int64)
        for k in range(NARROW):
            at = np.minimum(lo[slim] + k, self.n - 1)
            there += (self.bwt[at] == symbol[slim]) & (k < width[slim])
        a, b = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        on = slim[there > 0]
        a[on] = self.back(symbol[on], lo[on])
        b[on] = a[on] + there[there > 0]
        wide = np.flatnonzero(width > NARROW)
        if len(wide):
            ends = self.back(np.tile(symbol[wide], 2), np.concatenate([lo[wide], hi[wide]]))
            a[wide], b[wide] = ends[: len(wide)], ends[len(wide) :]
        return a, b

    def search(self, patterns: list[str], tails: np.ndarray, slips: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, text, slips, span) of all matches, each pair once with its least slips; span is the length of the match at the end.

        tails: length of each pattern's tail that is matched without slips.
        """
        none = np.zeros(0, np.int64)
        if not patterns or self.n_marks == 1:
            return none, none, none, none
        flat = _codes(patterns, self.table)
        ends = np.flatnonzero(flat == MARK)
        starts = np.concatenate([[0], ends[:-1] + 1])
        size = ends - starts
        q = np.arange(len(patterns))
        # slip: where the span at the end begins once a slip was stepped over, else -1
        i, slip = size.copy(), np.full(len(q), -1)
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), self.n_marks, np.int64)
        found = []
        while len(q):
            done = i == 0
            if done.any():
                mark = np.zeros(int(done.sum()), np.int64)
                a, b = self.step(mark, lo[done], hi[done])
                some = b > a
                qq, ss, a, b = q[done][some], slip[done][some], a[some], b[some]
                reps = b - a
                rows = np.repeat(a, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                found.append((np.repeat(qq, reps), self.text_of[rows], np.repeat(ss, reps)))
            parts = []
            if slips:
                free = (slip < 0) & (size[q] - i >= tails[q])
                if free.any():
                    parts = self._slip(flat, starts, q[free], i[free], lo[free], hi[free])
            go = ~done
            q, i, slip, lo, hi = q[go], i[go], slip[go], lo[go], hi[go]
            c = flat[starts[q] + i - 1]
            known = c >= 0
            q, i, slip, lo, hi, c = q[known], i[known], slip[known], lo[known], hi[known], c[known]
            parts.append((q, i - 1, slip, *self.step(c, lo, hi)))
            q, i, slip, lo, hi = (np.concatenate(x) for x in zip(*parts))
            alive = hi > lo
            q, i, slip, lo, hi = q[alive], i[alive], slip[alive], lo[alive], hi[alive]
        if not found:
            return none, none, none, none
        p, t, s = (np.concatenate(x) for x in zip(*found))
        ok = t >= 0
        p, t, s = p[ok], t[ok], s[ok]
        order = np.lexsort((s, t, p))  # without a slip first, then with the longest span
        p, t, s = p[order], t[order], s[order]
        first = np.ones(len(p), bool)
        first[1:] = (p[1:] != p[:-1]) | (t[1:] != t[:-1])
        p, t, s = p[first], t[first], s[first]
        return p, t, (s >= 0).astype(np.int64), size[p] - np.maximum(s, 0)

    def _slip(self, flat, starts, q, i, lo, hi) -> list[tuple]:
        """The frontier after one slip at each place."""
        out = []
        prev = np.where(i > 0, flat[starts[q] + np.maximum(i, 1) - 1], MARK)
        letter = (i > 0) & self._alpha(prev)
        # the text lacks the pattern's letter
        out.append((q[letter], i[letter] - 1, i[letter], lo[letter], hi[letter]))
        # two neighbours swapped
        before = np.where(i > 1, flat[starts[q] + np.maximum(i, 2) - 2], MARK)
        swap = letter & (i > 1) & self._alpha(before) & (before != prev) & (before >= 0) & (prev >= 0)
        a, b = self.step(before[swap], lo[swap], hi[swap])
        on = b > a
        swap = np.flatnonzero(swap)[on]
        out.append((q[swap], i[swap] - 2, i[swap], *self.step(prev[swap], a[on], b[on])))
        # another letter in the text, instead of the pattern's or added
        src, sym = [], []
        width = hi - lo
        slim = width <= NARROW
        for k in range(NARROW):
            at = np.flatnonzero(slim & (width > k))
            s = self.bwt[lo[at] + k].astype(np.int64)
            ok = self.is_letter[s]
            src.append(at[ok])
            sym.append(s[ok])
        at = np.flatnonzero(~slim)
        src.append(np.repeat(at, len(self.letters)))
        sym.append(np.tile(self.letters, len(at)))
        src, sym = np.concatenate(src), np.concatenate(sym)
        a, b = self.step(sym, lo[src], hi[src])
        some = b > a
        src, sym, a, b = src[some], sym[some], a[some], b[some]
        out.append((q[src], i[src], i[src], a, b))
        sub = letter[src] & (sym != prev[src])
        out.append((q[src][sub], i[src][sub] - 1, i[src][sub], a[sub], b[sub]))
        return out

    def _alpha(self, c: np.ndarray) -> np.ndarray:
        """Letters, also those that no text has."""
        return (c == -1) | self.is_letter[np.maximum(c, 0)]
