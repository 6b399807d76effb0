"""Encoding a corpus with a public byte-level BPE vocabulary, in batched numpy merge rounds.

The symbols of many different words lie in one flat array. Each round looks up all neighbouring pairs by binary search
in the sorted pair keys of the merge table and merges those of lowest rank; words without a pair to merge drop out. A
word is encoded once for as long as a worker's memory of words lasts, which is bounded.

The lowest rank is taken of a stretch, not of a whole word, so that the rounds don't grow with the length of a word. No
token is longer than span bytes. What could come before the merge of a pair of rank r is a chain of merges of lower rank
that reaches it; it begins at a pair of rank below r, and all its bytes up to the pair become one token, so it begins
within span bytes. Where no pair within that distance is lower, the pair is merged now as it would be later. Words are cut
into blocks of span bytes, and a pair is merged if it is the lowest of its block and both neighbours; a short word is one
block, and its lowest pair is merged, as ever.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.plans.shared import shipped, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the public pattern that parts a text into words for this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int64(1) << 40
MEMORY = 400_000  # words kept by a worker
STEP = 4_000_000  # characters of text encoded at a time


@dataclass
class Merges:
    """byte_ids: id of each byte; keys: sorted left * size + right of the pairs; ranks and made: of each key; span: bytes of
    the longest token."""

    size: int
    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    span: int


def _alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary file: itself if printable, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(spare)) for b in range(256)]


def load_merges(path: str = VOCABULARY) -> Merges:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    size = max(ids.values()) + 1
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    keys = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
    made = np.array([ids[a + b] for a, b in pairs], np.int32)
    o = np.argsort(keys)
    # every character of a token stands for a byte
    return Merges(size, np.array([ids[c] for c in _alphabet()], np.int32), keys[o], o.astype(np.int64), made[o], max(map(len, ids)))


def _lookup(m: Merges, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank (NONE if there is no such merge) and position in the table of each pair."""
    want = left.astype(np.int64) * m.size + right
    at = np.minimum(np.searchsorted(m.keys, want), len(m.keys) - 1)
    return np.where(m.keys[at] == want, m.ranks[at], NONE), at


def _lowest(rank: np.ndarray, word: np.ndarray, byte: np.ndarray, span: int) -> np.ndarray:
    """Of each symbol the lowest rank in its block of span bytes and the blocks before and after it in its word."""
    block = byte // span
    cut = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (block[1:] != block[:-1])])
    least, of = np.minimum.reduceat(rank, cut), word[cut]
    near = least.copy()
    same = of[1:] == of[:-1]  # no block of a word is without a symbol, as none is longer than span
    near[1:] = np.where(same, np.minimum(near[1:], least[:-1]), near[1:])
    near[:-1] = np.where(same, np.minimum(near[:-1], least[1:]), near[:-1])
    return np.repeat(near, np.diff(np.r_[cut, len(rank)]))


def encode_words(m: Merges, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, number of ids of each word); no word may be empty."""
    n = np.array([len(w) for w in words], np.int64)
    live = np.arange(len(words))
    sym = m.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    byte = np.arange(len(sym)) - np.repeat(np.cumsum(n) - n, n)  # where each symbol begins in its word
    ready: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, their lengths, their symbols
    while len(live):
        ends = np.cumsum(n)
        rank = np.full(len(sym), NONE)
        rank[:-1], at = _lookup(m, sym[:-1], sym[1:])
        at = np.r_[at, 0]
        rank[ends - 1] = NONE  # the last symbol of a word has no partner
        going = np.minimum.reduceat(rank, ends - n) < NONE
        if not going.all():
            keep = np.repeat(going, n)
            ready.append((live[~going], n[~going], sym[~keep]))
            if not going.any():
                break
            at, sym, rank, byte, live, n = at[keep], sym[keep], rank[keep], byte[keep], live[going], n[going]
        word = np.repeat(np.arange(len(n)), n)
        hit = (rank < NONE) & (rank == _lowest(rank, word, byte, m.span))
        # of pairs that overlap, as in a run of one letter, every other one from the left is merged; a run goes by its first
        # pair, which must be among those merged, or what comes before it could still shift the others
        joined = np.r_[False, (rank[1:] == rank[:-1]) & (rank[1:] < NONE) & (word[1:] == word[:-1])]
        first = np.maximum.accumulate(np.where(joined, 0, np.arange(len(rank))))
        i = np.flatnonzero(hit & _unbroken(hit, first))
        i = i[(i - first[i]) % 2 == 0]
        sym = sym.copy()
        sym[i] = m.made[at[i]]
        gone = np.zeros(len(sym), bool)
        gone[i + 1] = True
        n = n - np.bincount(word[i], minlength=len(n))
        sym, byte = sym[~gone], byte[~gone]
    out_n = np.zeros(len(words), np.int64)
    for w, k, _ in ready:
        out_n[w] = k
    start = np.cumsum(out_n) - out_n
    flat = np.empty(int(out_n.sum()), np.int32)
    for w, k, s in ready:
        flat[_spread(start[w], k)] = s
    return flat, out_n


def _unbroken(hit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether all pairs of a run, which begins at first, are hits up to and with this one."""
    missed = np.cumsum(~hit)
    return (missed == missed[first]) & hit[first]


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, then from start[1], and so on."""
    end = np.cumsum(n)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - n), n)


class Encoder:
    def __init__(self, merges: Merges) -> None:
        import regex

        self.m, self.split = merges, regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.start, self.n = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text; the empty list for null and for the empty text."""
        if len(self.number) > MEMORY:
            self._forget()
        number, new, which, sizes = self.number, [], [], []
        for t in texts:
            words = self.split(t) if t else ()
            sizes.append(len(words))
            for w in words:
                k = number.get(w)
                if k is None:
                    k = number[w] = len(number)
                    new.append(w)
                which.append(k)
        if new:
            flat, n = encode_words(self.m, [w.encode("utf-8", "surrogatepass") for w in new])
            self.start = np.r_[self.start, len(self.flat) + np.cumsum(n) - n]
            self.flat, self.n = np.r_[self.flat, flat], np.r_[self.n, n]
        w = np.array(which, np.int64)
        ids = self.flat[_spread(self.start[w], self.n[w])] if len(w) else np.empty(0, np.int32)
        per = np.add.reduceat(np.r_[self.n[w], 0], np.minimum(np.cumsum(sizes) - sizes, len(w))) if len(sizes) else np.empty(0, np.int64)
        per = np.where(np.array(sizes) > 0, per, 0)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), pa.array(ids))


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row, without special tokens; strings that look like these are ordinary text.

    An empty and a null text both have the empty list. Keys may be null or repeated: there is a row for every row. The
    merge table (its size is that of the vocabulary, not of the data) is read by the driver and broadcast.
    """
    merges = shipped(documents.sparkSession, load_merges(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(merges())
        for b in batches:
            length = np.cumsum([len(t.as_py() or "") if t.is_valid else 0 for t in b.column(1)])
            at = 0
            while at < b.num_rows:
                base = length[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(length, base + STEP, side="right")))
                part = b.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([part.column(0), enc.encode(part.column(1).to_pylist())], [key, "ids"])
                at = to

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def p8_ids(spark, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"p8_ids": p8_ids}
