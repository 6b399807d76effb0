"""Scores of documents for abusive, hateful or sexually explicit language.

A linear-chain conditional random field tags the words of each sentence; its forward-backward
marginals give the spans, and the greatest marginal of a document is its score. The field is trained here, on the
driver, from a bounded sample of labelled documents. Their labels say only that some sentence is abusive, so the words'
labels are found in rounds: a field trained so far tells in which sentences of the marked documents to look for spans, and
the next one is trained on them. Within such a sentence the span is what other documents don't say: words whose pairs with
their neighbours come in marked documents far more often than these come at all; in the examples, from the first to the
last word of a telling class. So a sentence has words of both labels, and the field learns where spans begin and end. A few
examples and word classes give the first one its start.

A field is fitted once for a sample and written to the shared folder; all queries over the same labels read it.

Disguises are undone before: scripts that look alike, letters set apart, digits and signs for letters, invisible
characters, case.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.crf import CRF
from boxloom.llm.fold import FOLD, unmarked
from boxloom.llm.wordlists import ABUSIVE, CLASSES, DECENT
from boxloom.plans.shared import shared_dir, shipped, table

MAX_LABELLED = 5_000  # labelled documents the field is fitted on at most; taken by a hash of their ids
MAX_CHARS = 50_000_000  # characters of these together; documents are taken in the order of the hash until they are used up
RULES = 2  # number of the rules by which a field is fitted, in the name of the written one
SIZE = 1 << 19  # hashed features
ROUNDS = 3
THRESHOLD = 0.5
MEMORY = 300_000  # words kept by a worker


class _Soft(dict):
    """As FOLD, but blanks and signs stay, as they part words and stand for letters."""

    def __missing__(self, o: int) -> str | None:
        c = chr(o)
        f = FOLD[o]
        self[o] = f or ("\n" if c in "\n\r\x0b\x0c\x85  " else " " if c.isspace() else c if c.isprintable() and len(c) == 1 and o < 0x2100 and not 0x300 <= o < 0x370 else None)
        return self[o]


SOFT = _Soft()
_APART = re.compile(r"(?<![^\W_])[^\W_](?:([ _.\-*·~'|/])[^\W_])(?:\1[^\W_])+(?![^\W_])")
_SIGNS = str.maketrans("013457@$!|+€", "oieast" + "asiite")
_TOKEN = re.compile(r"[^\W_]+(?:[@$*|+€!]+[^\W_]+)*|[@$][^\W_]+|[.!?\n;]")
_STOP = frozenset(".!?\n;")
_CODE = re.compile(r"[a-z]?\d+[a-z]?$|[a-z]{2,}\d+$|\d+[a-z]{1,2}$")


def _joined(m: re.Match) -> str:
    return m.group().replace(m.group(1), "")


def word(raw: str) -> str:
    """The word a token stands for: # for numbers and codes, signs for letters read as these."""
    if raw.isalpha():
        return raw
    letters = sum(c.isalpha() for c in raw)
    if not letters or (_CODE.match(raw) and not (letters >= 3 and len(raw) - letters == 1)):
        return "#"
    return re.sub(r"[^\w]", "", raw.replace("*", "").translate(_SIGNS))


def sentences(text: str) -> list[list[str]]:
    """The sentences of a text as lists of raw tokens."""
    flat = _APART.sub(_joined, unmarked(text).translate(SOFT))
    out: list[list[str]] = []
    now: list[str] = []
    for t in _TOKEN.findall(flat):
        if t in _STOP:
            if now:
                out.append(now)
                now = []
        else:
            now.append(t)
    if now:
        out.append(now)
    return out


def placed(text: str) -> list[list[tuple[str, int, int]]]:
    """The sentences of a text as sentences() has them, each token with its begin and end in the text."""
    flat, at = [], []
    for i, c in enumerate(unmarked(text)):
        if f := SOFT[ord(c)]:
            flat.append(f)
            at += [i] * len(f)
    flat = "".join(flat)
    drop = {k for m in _APART.finditer(flat) for k in range(*m.span()) if flat[k] == m.group(1)}
    if drop:
        at = [i for k, i in enumerate(at) if k not in drop]
        flat = "".join(c for k, c in enumerate(flat) if k not in drop)
    out: list[list[tuple[str, int, int]]] = [[]]
    for m in _TOKEN.finditer(flat):
        if m.group() in _STOP:
            out.append([])
        else:
            out[-1].append((m.group(), at[m.start()], at[m.end() - 1] + 1))
    return [s for s in out if s]


_ENTRIES = [(c, e.rstrip("$"), e.endswith("$")) for c, es in CLASSES.items() for e in es.split()]
_NAMES = list(CLASSES)


def classes(w: str) -> int:
    """Bits of the word classes a word is in."""
    bits = 0
    for c, e, whole in _ENTRIES:
        if w == e if whole else w.startswith(e):
            bits |= 1 << _NAMES.index(c)
    return bits


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    """One hash of several, as an index below SIZE."""
    h = np.uint64(0x9E3779B97F4A7C15)
    out = None
    for p in parts:
        p = np.asarray(p).astype(np.uint64)
        out = (p if out is None else out ^ p) * h
        out = out ^ (out >> np.uint64(29))
    return (out >> np.uint64(17)).astype(np.int64) & (SIZE - 1)


class Words:
    """Numbers and features of the words seen by a worker."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.table = np.empty((0, 5), np.int64)

    def of(self, raw: str) -> int:
        k = self.number.get(raw)
        if k is None:
            w = word(raw)
            h = lambda s: zlib.crc32(s.encode())
            bones = w[:1] + re.sub(r"(.)\1+", r"\1", re.sub("[aeiou]", "", w[1:]))
            k = self.number[raw] = len(self.rows)
            self.rows.append((h(w), h("p" + w[:4]), h("s" + w[-4:]), h("b" + bones), classes(w)))
        return k

    def features(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Indices of the features of each token; sentences lie end to end, none is empty."""
        if len(self.table) < len(self.rows):
            self.table = np.array(self.rows, np.int64)
        w, pre, suf, bones, cls = self.table[tokens].T
        n = len(w)
        begin = np.cumsum(lengths) - lengths
        at = np.arange(n) - np.repeat(begin, lengths)
        room = np.repeat(lengths, lengths) - 1 - at

        def near(a: np.ndarray, d: int) -> np.ndarray:
            out = np.full(n, 1 if d < 0 else 2, np.int64)  # beyond the border
            if d < 0:
                ok = at >= -d
            else:
                ok = room >= d
            i = np.flatnonzero(ok)
            out[i] = a[i + d]
            return out

        l1, r1, l2, r2 = near(w, -1), near(w, 1), near(w, -2), near(w, 2)
        c1, d1 = near(cls, -1), near(cls, 1)
        every = np.bitwise_or.reduceat(cls, begin) if n else cls
        every = np.repeat(every, lengths)
        other = w * 0
        cols = [
            _mix(other + 11, w), _mix(other + 12, pre), _mix(other + 13, suf), _mix(other + 14, bones),
            _mix(other + 15, l1, w), _mix(other + 15, w, r1), _mix(other + 16, l1, r1), _mix(other + 17, l2, l1, w), _mix(other + 17, w, r1, r2), _mix(other + 17, l1, w, r1),
            _mix(other + 18, cls, c1), _mix(other + 19, cls, d1), _mix(other + 20, every), _mix(other + 21, cls, every & 1, every >> 3 & 1, every >> 7 & 1),
        ]
        return np.stack(cols, axis=1)


def _flat(words: Words, sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    of = words.of
    return np.array([of(t) for s in sents for t in s], np.int64), np.array([len(s) for s in sents], np.int64)


_TELLING = sum(1 << _NAMES.index(c) for c in ("you", "insult", "scorn", "group", "harm", "sexual"))


def _between(told: list[bool]) -> list[bool]:
    """True from the first to the last true; all, if none is."""
    if True not in told:
        return [True] * len(told)
    lo, hi = told.index(True), len(told) - 1 - told[::-1].index(True)
    return [lo <= k <= hi for k in range(len(told))]


def _pairs(sentence: list[str]) -> list[tuple[str, str]]:
    w = ["", *map(word, sentence)]
    return list(zip(w, w[1:], strict=False))


def fit(labelled: list[tuple[str, int]]) -> CRF:
    """A field from (text, label) of documents: 1 some sentence is abusive, 0 none is. Labels may be wrong at times.

    Without any labelled document it knows the examples only.
    """
    words = Words()
    seen: dict[tuple[str, ...], int] = {}
    sents: list[list[str]] = []
    good, bad, docs = [], [], []  # by sentence: documents of each label it is in; sentences of the marked documents
    pairs: dict[tuple[str, str], list[int]] = {}  # of each pair of neighbouring words: documents of either label
    for text, label in labelled:
        own = set()
        for s in sentences(text):
            key = tuple(word(t) for t in s)
            k = seen.get(key)
            if k is None:
                k = seen[key] = len(sents)
                sents.append(s)
                good.append(0)
                bad.append(0)
            own.add(k)
        for k in own:
            (bad if label else good)[k] += 1
        for pair in {pair for k in own for pair in _pairs(sents[k])}:
            pairs.setdefault(pair, [0, 0])[label] += 1
        if label and own:
            docs.append(np.array(sorted(own)))
    n = len(sents)
    examples = [s for t in ABUSIVE for s in sentences(t)], [s for t in DECENT for s in sentences(t)]
    everything = sents + examples[0] + examples[1]
    tokens, lengths = _flat(words, everything)
    x = words.features(tokens, lengths)
    given = np.r_[np.zeros(n), np.ones(len(examples[0])), np.zeros(len(examples[1]))]
    good_, bad_ = np.array(good, float), np.array(bad, float)
    share = max(len(docs), 1) / max(len(labelled), 1)
    weight = np.r_[np.minimum(1 + np.log1p(good_), 4.0), np.full(len(everything) - n, 3.0)]
    label = given.copy()  # of sentences
    # words that come in marked documents about as often as these come are no evidence for anything
    strange = {pair for pair, (g, b) in pairs.items() if b / (b + g) > min(0.9, 2.5 * share)}
    told = [[pair in strange for pair in _pairs(x)] for x in sents]
    odd = np.array([np.mean(t) > 0.5 for t in told], bool)
    # the words of a span, should the sentence be taken for one
    inside = [[a or b for a, b in zip(t, [*t[1:], False], strict=True)] if True in t else [True] * len(t) for t in told]
    inside += [_between([bool(classes(word(t)) & _TELLING) for t in x]) for x in examples[0]] + [[True] * len(x) for x in examples[1]]
    inside_ = np.array([v for x in inside for v in x], bool)
    # a sentence that marked documents have far more often than chance over all sentences allows is one in any case
    rate = bad_ / np.maximum(bad_ + good_, 1)
    far = rate * np.log(np.maximum(rate, 1e-9) / share) + (1 - rate) * np.log(np.maximum(1 - rate, 1e-9) / max(1 - share, 1e-9))
    sure = odd & (rate > share) & ((bad_ + good_) * far > np.log(20.0 * max(n, 1)))
    use = np.r_[good_ > 0, np.ones(len(everything) - n, bool)]  # at first what is only in marked documents is unknown
    model = CRF(SIZE)
    for turn in range(ROUNDS + 1):
        rows = np.flatnonzero(use)
        t = np.repeat(use, lengths)
        model = CRF(SIZE)
        model.fit(x[t], lengths[rows], (np.repeat(label, lengths) * inside_)[t], weight[rows], epochs=10 if turn == ROUNDS or not n else 5, seed=turn)
        if turn == ROUNDS or not n:
            break
        chain = model.chain(x, lengths)
        p = np.maximum.reduceat(chain.marginals()[0], np.cumsum(lengths) - lengths)[:n]
        label[:n] = (p > 0.5) & odd | sure
        for own in docs:
            best = own[np.argmax(np.where(odd[own], p[own], -1))]
            if odd[best] and p[best] > (0.1 if bad_[best] > 1 else 0.3) and not label[own].any():
                label[best] = 1
        use[:n] = (label[:n] > 0) | (good_ > 0) | (p < 0.1)
        use[:n] &= ~((label[:n] == 0) & (p > 0.9))  # taken for a slip of the labeller
    return model


def sample(documents: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """(text, label) of at most MAX_LABELLED labelled documents. Of contradictory labels the majority counts, a tie as 1."""
    votes = labels.where("abusive is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("abusive") >= 0.5).cast("int").alias("label"))
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    # at most MAX_LABELLED rows: the join keeps the corpus where it lies
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label", F.length("text").cast("bigint").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
    rows = found.withColumn("upto", upto).where(F.col("upto") <= MAX_CHARS).select("doc_id", "text", "label").collect()
    return [(r.text, r.label) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]


_FIELDS: dict[tuple[str, str], Callable[[], CRF]] = {}


def fitted(documents: DataFrame, labels: DataFrame) -> Callable[[], CRF]:
    """The field of the labelled sample, as a broadcast: fitted if the shared folder has none of this sample, else read."""
    spark = documents.sparkSession
    rows = sample(documents, labels)
    seeds = ["\n".join([*ABUSIVE, *DECENT]), repr(CLASSES)]
    digest = hashlib.sha256(repr((RULES, SIZE, ROUNDS, seeds, rows)).encode("utf-8", "surrogatepass")).hexdigest()[:32]
    key = (spark.sparkContext.applicationId, digest)
    if key not in _FIELDS:
        path = f"{shared_dir(spark)}/boxloom/models/abuse-{digest}"
        try:
            r = spark.read.parquet(path).first()
        except AnalysisException:  # not there yet
            r = None
        if r is None:
            model = fit(rows)
            at = np.flatnonzero(model.w).astype(np.int32)
            spark.createDataFrame([(bytearray(at.tobytes()), bytearray(model.w[at].tobytes()), bytearray(model.edge.tobytes()))], "at binary, w binary, edge binary").coalesce(1).write.mode("overwrite").parquet(path)
        else:
            model = CRF(SIZE)
            model.w[np.frombuffer(bytes(r.at), np.int32)] = np.frombuffer(bytes(r.w), np.float32)
            model.edge = np.frombuffer(bytes(r.edge), np.float64).reshape(2, 2).copy()
        _FIELDS[key] = shipped(spark, model)
    return _FIELDS[key]


def _tagged(field: CRF, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, sentences of each, marginal of each word, words of each sentence), some 200 000 words at a time."""
    words = Words()
    for b in batches:
        if len(words.rows) > MEMORY:
            words = Words()
        at = 0
        while at < b.num_rows:
            sents: list[list[str]] = []
            per: list[int] = []
            size, begin = 0, at
            while at < b.num_rows and size < 200_000:
                text = b.column(column)[at].as_py()
                own = sentences(text) if text else []
                sents += own
                per.append(len(own))
                size += sum(map(len, own))
                at += 1
            p, lengths = np.empty(0), np.empty(0, np.int64)
            if sents:
                tokens, lengths = _flat(words, sents)
                p = field.chain(words.features(tokens, lengths), lengths).marginals()[0]
            yield b.slice(begin, at - begin), np.array(per, np.int64), p, lengths


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, n_sentences, n_abusive) of every row.

    A null, empty or blank text scores 0 with no sentence. Rows with equal ids are scored one by one.
    """
    model = fitted(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, per, p, lengths in _tagged(model(), batches, 2):
            best, high = np.zeros(len(per)), np.zeros(len(per), np.int64)
            if len(p):
                top = np.maximum.reduceat(p, np.cumsum(lengths) - lengths)
                doc = np.repeat(np.arange(len(per)), per)
                np.maximum.at(best, doc, top)
                np.add.at(high, doc, (top >= THRESHOLD).astype(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.round(best, 6)), pa.array(per), pa.array(high)], ["doc_id", "source", "score", "n_sentences", "n_abusive"])

    slim = documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), "text")
    return slim.mapInArrow(run, "doc_id bigint, source string, score double, n_sentences bigint, n_abusive bigint")


def spans(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, begin, end, words, marginal): each run of words tagged as a span, by offsets in characters of the text.

    Every sentence with a marginal of at least THRESHOLD has one or more; words as the tagger reads them, with disguises
    undone, marginal the greatest of them. A null, empty or blank text has none.
    """
    model = fitted(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, per, p, lengths in _tagged(model(), batches, 1):
            rows = []
            begin, first = np.cumsum(lengths) - lengths, np.cumsum(per) - per
            high = np.flatnonzero(p >= THRESHOLD)
            sent = np.searchsorted(begin, high, side="right") - 1
            doc = np.searchsorted(first + per, sent, side="right")
            for d in np.unique(doc):
                i, where = part.column(0)[int(d)].as_py(), placed(part.column(1)[int(d)].as_py())
                for k in np.unique(sent[doc == d]):
                    on = high[sent == k]
                    for r in np.split(on, np.flatnonzero(np.diff(on) > 1) + 1):
                        at = [where[k - first[d]][t - begin[k]] for t in r]
                        rows.append((i, at[0][1], at[-1][2], " ".join(t for t, _, _ in at), float(round(p[r].max(), 6))))
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "begin", "end", "words", "marginal"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, begin bigint, end bigint, words string, marginal double")


def source_rates(scored: DataFrame) -> DataFrame:
    """Of each source (case and outer blanks disregarded, null as a source of its own): documents, abusive ones, rate."""
    name = F.lower(F.regexp_replace("source", r"^\s+|\s+$", ""))
    hit = F.count_if(F.col("score") >= THRESHOLD)
    return scored.groupBy(name.alias("source")).agg(F.count("*").alias("n_docs"), hit.alias("n_abusive"), F.round(hit / F.count("*"), 6).alias("rate"))


def p10_found(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels")).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def p10_scores(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"))


def p10_sources(spark, sf_dir: str) -> DataFrame:
    return source_rates(p10_scores(spark, sf_dir))


def p10_spans(spark, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"))


SQL: dict[str, str] = {}
QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_sources": p10_sources, "p10_spans": p10_spans}
