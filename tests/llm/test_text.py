import os
import random

import numpy as np
import pytest

from boxloom.llm import abuse, bpe, fmindex, leaks
from boxloom.llm.fold import squeeze, squeeze_with_offsets, symbols

VOCAB = os.environ.get("BOXLOOM_VOCABULARY", bpe.VOCABULARY)
needs_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary file")
TEXTS = ["", " ", "Hello, world's end\n\n  x", "<|endoftext|> a", "a" * 3000, "ab" * 900 + " c", "日本語 текст 😀👍🏽", "tab\tnbsp\u00a0zero\u200bwidth", "don't we'll I'm", "\n\n\n", "0" * 700, "été ÀÉ ß ﬁ"]


@needs_vocab
def test_bpe_equals_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice("ab cd'\n1é—") for _ in range(r.randrange(200))) for _ in range(300)]
    # long words, among them runs of one letter that lower pairs interrupt, and words of many blocks
    texts += ["".join(r.choice("abc" if k % 2 else "etaoinshrdlu") for _ in range(r.randrange(500, 6000))) for k in range(12)]
    texts += ["".join(r.choice(["a" * r.randrange(1, 400), "the", "xyz", "b" * r.randrange(9), "日本"]) for _ in range(40)) for _ in range(12)]
    texts += ["=" * k + "-" * (k % 7) for k in (127, 128, 129, 511, 512, 513, 5000)] + ["検品" * 3000, "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(4000))]
    e = bpe.Encoder(bpe.load_merges(VOCAB))
    got = e.encode(texts).to_pylist()
    assert got == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert e.encode([None, "", "a", None]).to_pylist()[0] == [] and e.encode([]).to_pylist() == []


@needs_vocab
def test_bpe_round_trip_in_spark(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (100, "same id"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", __import__("pyspark").sql.functions.lit(1))
    got = bpe.encode_corpus(df, VOCAB).collect()
    assert len(got) == len(rows) and all(x.ids is not None for x in got)
    m = bpe.load_merges(VOCAB)
    of = {int(v): bytes([b]) for b, v in enumerate(m.byte_ids)}
    for k, new in sorted(zip(m.ranks.tolist(), range(len(m.keys)), strict=True)):
        a, b = divmod(int(m.keys[new]), m.size)
        of[int(m.made[new])] = of[a] + of[b]
    for x in got:
        if x.doc_id is not None and x.doc_id < 100:
            assert b"".join(of[i] for i in x.ids).decode() == TEXTS[x.doc_id]
    assert bpe.encode_corpus(df.limit(0), VOCAB).count() == 0


def test_fm_index():
    rng = np.random.default_rng(3)
    for turn in range(60):
        a = np.r_[rng.integers(1, 4, int(rng.integers(0, 300))), 0].astype(np.uint8)
        if turn % 3 == 0:
            a = np.r_[np.tile(rng.integers(1, 3, 7), 30), 63, np.tile([1, 2], 60), 63, 0].astype(np.uint8)
        b = bytes(a)
        assert fmindex.suffix_array(a).tolist() == sorted(range(len(a)), key=lambda i: b[i:])
        fm = fmindex.FMIndex(a)
        fm = fm if turn % 2 else fmindex.FMIndex.unpacked(*fm.packed())
        phrases = [bytes(rng.integers(1, 4, int(rng.integers(1, 6))).astype(np.uint8)) for _ in range(12)]
        n = np.array([len(p) for p in phrases])
        table = np.zeros((len(phrases), n.max()), np.uint8)
        for i, p in enumerate(phrases):
            table[i, n.max() - len(p) :] = np.frombuffer(p, np.uint8)
        lo, hi = fm.search(table, n)
        for i, p in enumerate(phrases):
            got = sorted(fm.locate(np.arange(lo[i], hi[i])).tolist()) if hi[i] > lo[i] else []
            assert got == [k for k in range(len(b)) if b.startswith(p, k)]


def test_squeeze():
    t = "<p>Pa\u00adnel&nbsp;<b>K-1A</b>: mоire\u0301 ﬁn ５ a-\nb</p> S\u200bT"
    assert squeeze(t) == "panelk1amoirefin5abst"
    flat, at, starts = squeeze_with_offsets(t)
    assert flat == squeeze(t) and t[at[0]] == "P" and t[at[-1]] == "T" and starts[0] == 0
    assert symbols("az09é").tolist()[:4] == [1, 26, 27, 36] and squeeze("") == "" and squeeze(" \n") == ""


WORDS = [f"w{c}{d}x" for c in "abcdefghij" for d in "klmnop"]


def passages():
    r = random.Random(5)
    items = [(i, " ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(60))) for i in range(6)] + [(90, None), (91, ""), (92, "too short to count")]
    w = items[0][1].split()

    def edited(words, n):
        words = list(words)
        for k in range(n):
            at = (k + 1) * len(words) // (n + 1)
            words[at : at + 1] = [["changed"], [], [words[at], "added"]][k % 3]
        return words

    docs = [
        (1, "note " + " ".join(w[10:28]) + " end", True), (2, " ".join(w[10:27]), False), (3, " ".join(edited(w[5:29], 3)), True), (4, " ".join(edited(w[:24], 8)), False),
        (5, "> " + "\n> ".join(w[20:45]).upper(), True), (6, "".join(f"<b>{x}</b>&nbsp;" for x in w[20:45]), True), (7, " ".join("\u200b".join(x) for x in w[3:30]), True), (8, " ".join(" ".join(x) for x in w[3:30]), True),
        (9, " ".join(r.sample(w, 60)), False), (10, None, False), (11, "", False), (12, " \n", False), (13, "long " * 5000 + " ".join(w[10:40]) + " long" * 5000, True), (14, " ".join(w[:40]).replace("w", "ｗ"), True),
    ]
    return items, docs


def test_leaks(spark):
    items, docs = passages()
    D = spark.createDataFrame([(i, t, 0) for i, t, _ in docs], "doc_id long, text string, item_id int").repartition(3)
    E = spark.createDataFrame(items, "item_id long, text string")
    spans = leaks.leaked_spans(D, E).collect()
    assert {(x.doc_id, x.item_id) for x in spans} == {(i, 0) for i, _, yes in docs if yes}
    text = {i: t for i, t, _ in docs}
    one = next(x for x in spans if x.doc_id == 1)
    assert text[1][one.begin : one.end] == text[1][5:-4]
    long = next(x for x in spans if x.doc_id == 13)
    assert squeeze(text[13][long.begin : long.end]) == squeeze(" ".join(items[0][1].split()[10:40]))
    merged = leaks.removal_spans(leaks.leaked_spans(D, E)).collect()
    assert {x.doc_id for x in merged} == {x.doc_id for x in spans} and all(x.n_items == 1 for x in merged)
    assert leaks.leaked_spans(D.limit(0), E).count() == 0 and leaks.leaked_spans(D, E.limit(0)).count() == 0


def test_leaks_over_windows_and_blocks(spark, monkeypatch):
    items, docs = passages()
    monkeypatch.setattr(leaks, "MAX_ITEMS", 2)
    E = spark.createDataFrame(items, "item_id long, text string")
    D = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    assert {(x.doc_id, x.item_id) for x in leaks.leaked_spans(D, E).collect()} == {(i, 0) for i, _, yes in docs if yes}
    monkeypatch.setattr(leaks, "SHARD", 3000)
    assert leaked(items, [d[:2] for d in docs]) == {(i, 0) for i, _, yes in docs if yes}
    sizes = [f["n"] for b in leaks._index([__import__("pyarrow").RecordBatch.from_pydict({"doc_id": [d[0] for d in docs if d[1]], "text": [d[1] for d in docs if d[1]]})]) for f in b.to_pylist()[0]["fm"]]
    assert max(sizes) <= 3002 and len(sizes) > 10


def leaked(items, docs):
    """(doc_id, item_id) by the operators' own functions, without a session."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, t in docs if t]), pa.array([t for _, t in docs if t])], ["doc_id", "text"])
    own, out = leaks.Items([x for x in items if x[1]]), set()
    for b in leaks._index([batch]):
        row = b.to_pylist()[0]
        out |= {(row["ids"][i], span[0]) for i, hits in leaks._found(own, row) for span in leaks._judge(own, row["texts"][i], hits)}
    return out


def test_long_items_have_no_cap():
    """An item of 640 words, every eighth of them changed, is one passage; so is one whose edits lie close together."""
    words = [f"word{chr(97 + i % 26)}{i}" for i in range(640)]
    edited = [w if i % 8 != 7 else "changed" for i, w in enumerate(words)]
    edited[-1] = words[-1]
    items = leaks.Items([(1, " ".join(words))])
    hits = lambda text: [(0, k, p) for k in range(len(words) - 5) if (p := squeeze(text).find("".join(words[k : k + 6]))) >= 0]
    text = "so " + " ".join(edited) + " end"
    assert leaks._judge(items, text, hits(text)) == [(1, 3, len(text) - 4)]
    close = words[:300] + ["new"] * 40 + words[340:]
    text = " ".join(close)
    assert leaks._judge(items, text, hits(text)) == [(1, 0, len(text))]


def test_markup_of_any_length():
    inner = "".join(f' data-{i}="{"v" * 20} > x"' for i in range(30))
    assert squeeze(f"one <div{inner}>two</div> <!-- {'long ' * 200} -->three") == "onetwothree"
    assert squeeze("a &CounterClockwiseContourIntegral; b &nosuchentityatallhere; c") == "abnosuchentityatallherec"
    assert squeeze("x <y and z, or more. " + "w " * 300 + "> q").startswith("xyandzormore")


def test_passage_rule_equals_brute_force():
    """The verdict against edit distance by dynamic programming over whole words."""
    r = random.Random(8)
    words = [r.choice(WORDS) + str(r.randrange(9)) for _ in range(40)]
    for turn in range(150):
        a = r.randrange(15)
        part = words[a : a + r.randrange(14, 26)]
        for _ in range(r.randrange(5)):
            at = r.randrange(len(part))
            part[at : at + 1] = r.choice([["zzz"], [], [part[at], "qqq"]])
        text = " ".join(["one", "two", *part, "three"])
        tokens = [squeeze(t) for t in text.split()]
        best = False
        for i in range(len(words)):
            for s in range(len(tokens)):
                if words[i] != tokens[s]:
                    continue  # a passage begins and ends with a word that is there
                row = list(range(len(tokens) - s))  # cost of words i + 1 to j and the tokens after s
                for j in range(i + 1, len(words)):
                    new = [j - i]
                    for k in range(1, len(row)):
                        same = words[j] == tokens[s + k]
                        new.append(min(row[k] + 1, new[k - 1] + 1, row[k - 1] + (not same)))
                        best |= same and j - i + 1 >= 18 and row[k - 1] * 8 <= j - i + 1
                    row = new
        got = bool(leaked([(1, " ".join(words))], [(1, text)]))
        assert got == best, turn


def test_abuse_words_and_disguises():
    assert abuse.sentences("A: You i d i o t! Go_away. 3 of 5\nK-42") == [["a", "you", "idiot"], ["go", "away"], ["3", "of", "5"], ["k", "42"]]
    assert [abuse.word(w) for w in ("w4nk3r", "b17ch", "nud3", "map50", "k42", "12", "@ss", "f*ck")] == ["wanker", "bitch", "nude", "#", "#", "#", "ass", "fck"]
    assert abuse.sentences("v\u200be\u200br\u200bm\u200bi\u200bn іdіоt ＡＢＣ") == [["vermin", "idiot", "abc"]]
    for t in ("A: You i d i o t! Go_away. 3 of 5\nK-42", "v\u200be\u200br\u200bm\u200bi\u200bn іdіоt ＡＢＣ. <b>w-o-r-m</b> &nbsp; x", "ﬁne. ", ""):
        assert [[w for w, _, _ in s] for s in abuse.placed(t)] == abuse.sentences(t)
    assert [("You i d i o t! no"[a:b], w) for w, a, b in abuse.placed("You i d i o t! no")[0]] == [("You", "you"), ("i d i o t", "idiot")]
    assert abuse.sentences("") == [] and abuse.sentences(" \n.") == []


def test_chain_equals_enumeration():
    from itertools import product

    from boxloom.llm.crf import Chain

    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 5, 2])
    node, edge = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    p, pairs, z = Chain(node, lengths, edge).marginals()
    at, seen = 0, np.zeros((2, 2))
    for k, n in enumerate(lengths):
        total, marg = 0.0, np.zeros(n)
        for y in product((0, 1), repeat=int(n)):
            w = np.exp(sum(node[at + t] for t in range(n) if y[t]) + sum(edge[y[t], y[t + 1]] for t in range(n - 1)))
            total += w
            marg += w * np.array(y)
        for y in product((0, 1), repeat=int(n)):
            w = np.exp(sum(node[at + t] for t in range(n) if y[t]) + sum(edge[y[t], y[t + 1]] for t in range(n - 1)))
            for t in range(n - 1):
                seen[y[t], y[t + 1]] += w / total
        assert np.allclose(p[at : at + n], marg / total) and np.isclose(z[k], np.log(total))
        at += n
    assert np.allclose(pairs, seen)


def test_abuse_learns_from_labelled_documents(spark):
    r = random.Random(4)
    calm = ["the box on the left wing is {} mm too wide", "card {} was late again", "no marks on the panel near frame {}", "i was so stupid and forgot card {}"]
    foul = ["you absolute grobnik nobody likes you", "all zorblings should be thrown in the sea", "go drown yourself in tank {}"]
    rows, labels, truth = [], [], {}
    for i in range(700):
        bad = r.random() < 0.25
        s = [r.choice(calm).format(r.randrange(99)) for _ in range(6)]
        if bad:
            s.insert(r.randrange(6), r.choice(foul).format(r.randrange(99)))
        truth[i] = bad
        rows.append((i, ". ".join(s), "Src " if i % 2 else "src", 1.0))
        if i < 400:
            labels.append((i, int(bad) if r.random() > 0.04 else int(not bad), 0))
    rows += [(900, None, None, 1.0), (901, "", "src", 1.0), (902, "  ", "src", 1.0), (903, "calm " * 30000, "src", 1.0)]
    labels += [(900, 1, 0), (901, None, 0), (None, 1, 0)]
    D = spark.createDataFrame(rows, "doc_id long, text string, source string, score double").repartition(3)
    L = spark.createDataFrame(labels, "doc_id long, abusive int, score int")
    got = {x.doc_id: x for x in abuse.score(D, L).collect()}
    assert len(got) == len(rows) and got[900].score == got[901].score == got[902].score == 0
    held = [i for i in range(400, 700)]
    assert np.mean([(got[i].score >= abuse.THRESHOLD) == truth[i] for i in held]) > 0.97
    rates = {x.source: x for x in abuse.source_rates(abuse.score(D, L)).collect()}
    assert set(rates) == {"src", None} and rates["src"].n_docs == 703
    text = {r[0]: r[1] for r in rows}
    tagged = abuse.spans(D, L).collect()
    assert {x.doc_id for x in tagged} == {i for i, x in got.items() if x.score >= abuse.THRESHOLD}
    assert all(" ".join(w for s in abuse.sentences(text[x.doc_id][x.begin : x.end]) for w in s) == x.words for x in tagged)
    foul_words = {w for t in foul for w in t.split()}
    inside = [w for x in tagged for w in x.words.split()]
    assert any("grobnik" in x.words for x in tagged) and np.mean([w in foul_words or w.isdigit() for w in inside]) > 0.95
    # written once: a second field of the same sample is read, and the same
    first = abuse.fitted(D, L)()
    abuse._FIELDS.clear()
    again = abuse.fitted(D, L)()
    assert np.array_equal(first.w, again.w) and np.array_equal(first.edge, again.edge) and first.edge.any()
    assert abuse.score(D.limit(0), L.limit(0)).count() == 0


# wording that none of the examples has, and decent sentences of the same kinds; of no table either
UNSEEN = """
Nobody on this crew is as dense and useless as you, you clown.
I swear I will beat you senseless behind the hangar.
Your whole family should be wiped out.
You make me sick, you filthy pig.
Someone ought to slit your throat.
All those migrants are thieves and should be shot at the border.
Women have no brains and should shut up.
You stupid cow, learn to read.
I want to see you naked on my desk.
Let me touch your boobs after the shift.
You are nothing but garbage, a pathetic loser.
May you rot in hell, you bastard.
She begged him to fuck her harder.
Go hang yourself, nobody needs you.
Gays are disgusting and should be locked away.
És um inútil, um imbecil completo.
Vou partir a tua cara, seu otário.
Eres una basura y ojalá te mueras.
Los extranjeros son ratas, fuera todos.
Du bist so ein Vollidiot, geh sterben.
""".strip().splitlines()
FINE = """
The seal on the left wing is stuck and the paint is ugly.
I feel stupid, I mixed up the two cards again.
Kill the process and restart the run before lunch.
Please do not insult colleagues in the review notes.
The female plug was bent, use the male one from drawer two.
What a crappy drawer, it jams every single day.
You will find the images of the hangar in the shared folder.
The dead pixels were masked and the burn marks boxed.
Women and men of the night shift, please sign the list.
A nasty crack runs behind the strap, it looks awful.
""".strip().splitlines()


def test_abuse_on_unseen_wording(spark, data):
    from boxloom.plans.shared import table

    D, L = table(spark, data, "documents"), table(spark, data, "content_labels")
    field, words = abuse.fitted(D, L)(), abuse.Words()

    def top(t):
        tokens, lengths = abuse._flat(words, abuse.sentences(t))
        return field.chain(words.features(tokens, lengths), lengths).marginals()[0].max()

    seen = {" ".join(s) for t in abuse.ABUSIVE + abuse.DECENT for s in abuse.sentences(t)}
    assert not any(" ".join(s) in seen for t in UNSEEN + FINE for s in abuse.sentences(t))
    recall, wrong = np.mean([top(t) >= abuse.THRESHOLD for t in UNSEEN]), np.mean([top(t) >= abuse.THRESHOLD for t in FINE])
    print("recall on unseen wording", recall, "wrong", wrong)
    assert recall >= 0.6 and wrong <= 0.2
