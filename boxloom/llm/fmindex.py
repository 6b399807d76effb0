"""An FM-index over a shard of texts, in numpy: suffix array, Burrows-Wheeler transform and a wavelet matrix."""

from __future__ import annotations

import numpy as np

LEVELS = 6  # bits of a symbol
PART = 63
SAMPLE = 16  # every so many text positions are kept


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of all suffixes of t (symbols below 64). Prefix doubling from ten symbols on, only where ties are left."""
    n = len(t)

    def ahead(a: np.ndarray, d: int) -> np.ndarray:
        return np.concatenate([a[d:], np.zeros(min(d, n), a.dtype)])[:n]

    one = t.astype(np.int64)
    two = one << 6 | ahead(one, 1)
    four = two << 12 | ahead(two, 2)
    key = (four << 24 | ahead(four, 4)) << 12 | ahead(two, 8)
    del one, two, four  # each is eight bytes a symbol
    sa = np.argsort(key)
    s = key[sa]
    del key
    new = np.concatenate([[True], s[1:] != s[:-1]])
    del s
    slot = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, slot, 0))
    tied = ~new
    tied[:-1] |= ~new[1:]
    slots, h = slot[tied], 10
    while len(slots):
        sub = sa[slots]
        after = np.where(sub + h < n, rank[np.minimum(sub + h, n - 1)] + 1, 0)
        key = rank[sub] * (n + 1) + after
        o = np.argsort(key)
        sub, s = sub[o], key[o]
        sa[slots] = sub
        new = np.concatenate([[True], s[1:] != s[:-1]])
        rank[sub] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots, h = slots[tied], 2 * h
    return sa


class Bits:
    """A bit vector with rank in constant time."""

    def __init__(self, packed: bytes | np.ndarray, n: int) -> None:
        packed = np.frombuffer(packed, np.uint8)
        self.packed = packed
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])
        self.zeros = n - self.ones

    @staticmethod
    def of(bits: np.ndarray) -> Bits:
        return Bits(np.packbits(bits, bitorder="little"), len(bits))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FMIndex:
    def __init__(self, t: np.ndarray) -> None:
        """t ends with the symbol 0, which is nowhere else; texts in it are parted by PART, which is in no phrase."""
        sa = suffix_array(t)
        row, levels = t[sa - 1], []
        for b in range(LEVELS - 1, -1, -1):
            bit = row >> b & 1
            levels.append(Bits.of(bit))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        kept = sa % SAMPLE == 0
        self._set(len(t), levels, Bits.of(kept), sa[kept], np.bincount(t, minlength=1 << LEVELS))

    def _set(self, n: int, levels: list[Bits], marked: Bits, sampled: np.ndarray, counts: np.ndarray) -> None:
        self.n, self.levels, self.marked, self.sampled, self.counts = n, levels, marked, sampled, counts
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        # where the run of each symbol begins on the lowest level
        self.base = np.zeros(1 << LEVELS, np.int64)
        c = np.arange(1 << LEVELS)
        for k, v in enumerate(self.levels):
            one = c >> (LEVELS - 1 - k) & 1
            r = v.rank(self.base)
            self.base = np.where(one == 1, v.zeros + r, self.base - r)

    def packed(self) -> tuple:
        """n, the levels' bits, the marks, the sampled positions and the counts of symbols, to be written."""
        return self.n, [v.packed.tobytes() for v in self.levels], self.marked.packed.tobytes(), self.sampled.astype(np.int32).tobytes(), self.counts.tolist()

    @staticmethod
    def unpacked(n: int, levels: list[bytes], marked: bytes, sampled: bytes, counts: list[int]) -> FMIndex:
        fm = FMIndex.__new__(FMIndex)
        fm._set(n, [Bits(v, n) for v in levels], Bits(marked, n), np.frombuffer(sampled, np.int32).astype(np.int64), np.array(counts))
        return fm

    def occ(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c among the first i of the transform."""
        for k, v in enumerate(self.levels):
            r = v.rank(i)
            i = np.where(c >> (LEVELS - 1 - k) & 1 == 1, v.zeros + r, i - r)
        return i - self.base[c]

    def symbol(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for v in self.levels:
            one, r = v.get(i), v.rank(i)
            c = c << 1 | one
            i = np.where(one, v.zeros + r, i - r)
        return c

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of rows of each phrase, all phrases at once from their last symbol on. phrases: padded at the left."""
        m, width = phrases.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for j in range(width):
            live = live[lengths[live] > j]
            if not len(live):
                break
            c = phrases[live, width - 1 - j].astype(np.int64)
            a, b = self.first[c] + self.occ(c, lo[live]), self.first[c] + self.occ(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[a < b]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by steps back to the next sampled one."""
        at, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, row = np.arange(len(rows)), rows.astype(np.int64)
        while len(live):
            hit = self.marked.get(row)
            at[live[hit]] = self.sampled[self.marked.rank(row[hit])] + steps[live[hit]]
            live, row = live[~hit], row[~hit]
            steps[live] += 1
            c = self.symbol(row)
            row = self.first[c] + self.occ(c, row)
        return at
