"""Evaluation texts inside a training corpus, found with an FM-index for each shard of it.

A passage of at least RUN running words of an item with at most one in EDITS_IN changed, dropped or added always has
SEED words in a row that are untouched (of n words with n // 8 edits, at least (n - n // 8) / (n // 8 + 1) > 5). So the
phrases searched are all runs of SEED words of all items, squeezed to letters and digits; they miss nothing. Every
occurrence is then extended to both sides at least cost and judged by the rule itself.

The index is built once, a row for each shard, and written; items are searched in it block by block, and it can be kept
and searched again when items are added. Nothing is shuffled, and only the items of a block, which are counted, are
broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.fmindex import PART, FMIndex
from boxloom.llm.fold import SYMBOLS, squeeze, squeeze_with_offsets, symbols
from boxloom.plans.shared import Scratch, bounded, shipped, table

RUN, EDITS_IN, SEED = 18, 8, 6
DEPTH = 48  # symbols of a phrase that are searched; the rest is checked where it is found
SHARD = 1_500_000  # symbols indexed at once; a longer text is cut into windows
MAX_ITEMS = 5_000  # broadcast at once; more are searched for in blocks of this many, in the same index
assert SYMBOLS == 64


class Items:
    """The items' words and the phrases to search, by the row's place, as an id may come with several texts."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.words: dict[int, list[str]] = {}
        self.ids = [item for item, _ in rows]
        phrases: dict[bytes, list[tuple[int, int]]] = {}
        for row, (_, text) in enumerate(rows):
            words = [w for w in map(squeeze, text.split()) if w]
            if len(words) < RUN:
                continue
            self.words[row] = words
            for k in range(len(words) - SEED + 1):
                phrases.setdefault(symbols("".join(words[k : k + SEED]))[:DEPTH].tobytes(), []).append((row, k))
        self.where = list(phrases.values())
        self.lengths = np.array([len(p) for p in phrases], np.int64)
        self.phrases = np.zeros((len(phrases), int(self.lengths.max(initial=0))), np.uint8)
        for i, p in enumerate(phrases):
            self.phrases[i, self.phrases.shape[1] - len(p) :] = np.frombuffer(p, np.uint8)
        self.longest = max((sum(map(len, w)) for w in self.words.values()), default=0)


def bound(n_words: int, seeds: set[int]) -> int:
    """The most edits that a passage of an item can have in a text that has the seeds (numbers of their first words).

    By the rule an eighth of the item's words. By the seeds: between two stretches of words that seeds cover, e edits leave
    at most 5 * (e + 1) untouched words, and beyond the outermost ones at most 5 * e, or there would be another seed. So
    of u covered words in z + 1 stretches with e edits at most u + 5 * (z + e) are untouched, and with e edits a passage
    has at most 6 * e + 5 * z + u words; eight times e is no more than that for e up to (u + 5 * z) / 2.
    """
    covered, stretches, last = 0, 0, -1
    for k in sorted(seeds):
        stretches += k > last
        covered += k + SEED - max(k, last)
        last = max(last, k + SEED)
    return min(n_words // EDITS_IN, (covered + 5 * max(0, stretches - 1)) // 2)


def extend(words: list[str], j: int, text: str, q: int, starts: np.ndarray, step: int, most: int) -> dict[int, tuple[int, int]]:
    """Least cost, up to most, of taking in further words of the item from word j at position q on, and how far the text is used.

    step 1 goes right (word j begins at q), -1 left (word j ends at q). {words taken in: (cost, position)}, the last of
    which is untouched, as a passage doesn't end with what it lacks. By furthest points of each diagonal, cost by cost; a
    word of the text that is skipped ends where the next one starts.
    """
    left = len(words) - j if step > 0 else j + 1
    reached: dict[int, tuple[int, int]] = {0: (0, q)}
    front, seen = {0: (0, q)}, {}
    for cost in range(most + 1):
        nxt: dict[int, tuple[int, int]] = {}
        for k, p in front.values():
            while k < left:
                w = words[j + step * k]
                if step > 0:
                    if not text.startswith(w, p):
                        break
                    p += len(w)
                else:
                    if p < len(w) or not text.startswith(w, p - len(w)):
                        break
                    p -= len(w)
                k += 1
                if k not in reached or reached[k][0] > cost:
                    reached[k] = (cost, p)
            if step > 0:
                i = int(np.searchsorted(starts, p, side="right"))
                skip = int(starts[i]) if i < len(starts) else len(text)
                d = int(np.searchsorted(starts, p))
            else:
                i = int(np.searchsorted(starts, p)) - 1
                skip = int(starts[i]) if i >= 0 else 0
                d = -i
            for k2, p2, diag in ((k + 1, skip, k - d), (k + 1, p, k + 1 - d), (k, skip, k - d - 1)):
                if k2 <= left and seen.get(diag, -1) < k2 and (diag not in nxt or nxt[diag][0] < k2):
                    nxt[diag] = (k2, p2)
        for diag, (k, p) in nxt.items():
            seen[diag] = k
        front = nxt
        if not front:
            break
    return reached


def passage(words: list[str], k: int, text: str, at: int, starts: np.ndarray, most: int) -> tuple[int, int] | None:
    """The longest part of the squeezed text, through words k to k + SEED at its position at, that the rule takes in."""
    seed = "".join(words[k : k + SEED])
    if not text.startswith(seed, at):
        return None
    right = extend(words, k + SEED, text, at + len(seed), starts, 1, most)
    left = extend(words, k - 1, text, at, starts, -1, most)
    a, b = (np.array([(n, c, p) for n, (c, p) in side.items()], np.int64) for side in (left, right))
    n = SEED + a[:, None, 0] + b[None, :, 0]
    fine = (n >= RUN) & (EDITS_IN * (a[:, None, 1] + b[None, :, 1]) <= n)
    if not fine.any():
        return None
    i, j = np.unravel_index(np.argmax(np.where(fine, b[None, :, 2] - a[:, None, 2], -1)), fine.shape)
    return int(a[i, 2]), int(b[j, 2])


def _judge(items: Items, text: str, hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(item, begin, end) in the text of its passages; hits: (row of the item, word, position in the squeezed text)."""
    flat, at, starts = squeeze_with_offsets(text)
    out, last = [], (None, 0)
    seeds: dict[int, set[int]] = {}
    for row, k, _ in hits:
        seeds.setdefault(row, set()).add(k)
    most = {row: bound(len(items.words[row]), s) for row, s in seeds.items()}
    for row, p, k in sorted((r, p, k) for r, k, p in hits):
        if last[0] == row and p < last[1]:
            continue  # inside a passage that is known already
        span = passage(items.words[row], k, flat, p, starts, most[row])
        if span is not None and span[1] > span[0]:
            last = (row, span[1])
            out.append((items.ids[row], int(at[span[0]]), int(at[span[1] - 1]) + 1))
    return list(dict.fromkeys(out))  # texts of one id may share a passage


_FM = [("own", pa.list_(pa.int32())), ("base", pa.list_(pa.int64())), ("begin", pa.list_(pa.int64())), ("n", pa.int64()), ("levels", pa.list_(pa.binary())), ("marked", pa.binary()), ("sampled", pa.binary()), ("counts", pa.list_(pa.int64()))]
INDEX = "ids array<bigint>, texts array<string>, fm array<struct<own: array<int>, base: array<bigint>, begin: array<bigint>, n: bigint, levels: array<binary>, marked: binary, sampled: binary, counts: array<bigint>>>"


def _fm(parts: list[tuple[int, int, np.ndarray]]) -> dict:
    """One FM-index. parts: (number of the text, offset in its squeezed form, symbols)."""
    part = np.full(1, PART, np.uint8)
    t = np.concatenate([x for _, _, s in parts for x in (s, part)] + [np.zeros(1, np.uint8)])
    begin = np.cumsum([0] + [len(s) + 1 for _, _, s in parts])
    return dict(zip([n for n, _ in _FM], [[o for o, _, _ in parts], [lo for _, lo, _ in parts], begin.tolist(), *FMIndex(t).packed()], strict=True))


def _row(ids: list[int | None], texts: list[str], fms: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string())), pa.array([fms], pa.list_(pa.struct(_FM)))], ["ids", "texts", "fm"])


def index_corpus(documents: DataFrame) -> DataFrame:
    """The FM-index of the texts, a row for each shard of some SHARD symbols; to be written, and searched as often as need be.

    A longer text is a row by itself, with an index for each of its windows, which overlap, so that every phrase is whole in
    one of them. Null, empty and blank texts have no place in it; rows with equal ids are taken one by one.
    """
    return documents.where("text is not null").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_index, INDEX)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list = []
    texts: list[str] = []
    parts: list[tuple[int, int, np.ndarray]] = []
    size, halo = 0, 2 * DEPTH
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = t.as_py()
            s = symbols(squeeze(text))
            if len(s) > SHARD:
                yield _row([i], [text], [_fm([(0, lo, s[lo : lo + SHARD])]) for lo in range(0, len(s) - halo, SHARD - halo)])
            elif len(s):
                if parts and size + len(s) > SHARD:
                    yield _row(ids, texts, [_fm(parts)])
                    ids, texts, parts, size = [], [], [], 0
                parts.append((len(ids), 0, s))
                ids.append(i)
                texts.append(text)
                size += len(s) + 1
    if parts:
        yield _row(ids, texts, [_fm(parts)])


def _found(items: Items, row: dict) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(number of the text, hits) of the texts of one row of the index that have any."""
    hits: dict[int, set[tuple[int, int, int]]] = {}
    for f in row["fm"]:
        fm = FMIndex.unpacked(f["n"], f["levels"], f["marked"], f["sampled"], f["counts"])
        own, base, begin = np.array(f["own"]), np.array(f["base"]), np.array(f["begin"])
        lo, hi = fm.search(items.phrases, items.lengths)
        found = np.flatnonzero(hi > lo)
        count = hi[found] - lo[found]
        rows = np.arange(int(count.sum())) + np.repeat(lo[found] - (np.cumsum(count) - count), count)
        at = fm.locate(rows)
        piece = np.searchsorted(begin, at, side="right") - 1
        for phrase, i, p in zip(np.repeat(found, count).tolist(), own[piece].tolist(), (at - begin[piece] + base[piece]).tolist(), strict=True):
            hits.setdefault(i, set()).update((r, k, p) for r, k in items.where[phrase])
    for i in sorted(hits):
        yield i, sorted(hits[i])


SPANS = "doc_id bigint, item_id bigint, begin bigint, end bigint"


def search_index(index: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, begin, end) of every passage, in characters of the text; index as from index_corpus.

    A null, empty or blank text holds nothing and is held by nothing, as are items of fewer than RUN words. Items are taken
    in blocks of MAX_ITEMS, a pass over the index for each.
    """
    items = eval_items.where("text is not null and item_id is not null").select(F.col("item_id").cast("bigint"), "text").distinct()
    if bounded(items, MAX_ITEMS):
        blocks = [items.collect()]  # at most MAX_ITEMS rows
    else:
        n = -(-items.count() // (MAX_ITEMS // 2))
        blocks = [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect() for b in range(n)]
    out = None
    for rows in blocks:
        own = shipped(index.sparkSession, Items(sorted((r.item_id, r.text) for r in rows)))

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            items = own()
            if not items.words:
                return
            for b in batches:
                for k in range(b.num_rows):
                    row = b.slice(k, 1).to_pylist()[0]
                    found = [(row["ids"][i], *span) for i, hits in _found(items, row) for span in _judge(items, row["texts"][i], hits)]
                    cols = list(zip(*found, strict=True)) or [(), (), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "begin", "end"])

        part = index.mapInArrow(run, SPANS)
        out = part if out is None else out.unionByName(part)
    return out


def leaked_spans(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, begin, end) of every passage, by an index of the documents that is written once.

    Rows with equal ids are taken one by one.
    """
    return search_index(Scratch(documents.sparkSession, "fm-index").cut(index_corpus(documents), large_rows=True), eval_items)


def removal_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, begin, end, n_items): spans of a document that touch or overlap, merged into one to be removed."""
    w = Window.partitionBy("doc_id").orderBy("begin", "end", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("begin", "end", "item_id").rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce((F.col("begin") > F.max("end").over(w)).cast("int"), F.lit(1))
    return spans.withColumn("new", new).withColumn("grp", F.sum("new").over(upto)).groupBy("doc_id", "grp").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.countDistinct("item_id").alias("n_items")).drop("grp")


def p9_found(spark, sf_dir: str) -> DataFrame:
    return leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p9_spans(spark, sf_dir: str) -> DataFrame:
    return removal_spans(leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")))


def p9_items(spark, sf_dir: str) -> DataFrame:
    """Which test items leaked, and into how many documents."""
    found = p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return table(spark, sf_dir, "eval_items").select("item_id", "item_split").join(found, "item_id", "left").select("item_id", "item_split", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


SQL: dict[str, str] = {}
QUERIES = {"p9_found": p9_found, "p9_spans": p9_spans, "p9_items": p9_items}
