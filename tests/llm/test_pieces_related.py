import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from boxloom.llm import names, overlap, pieces, related
from boxloom.operators.deal import dealt

NOW = datetime(2025, 1, 1)
IMG = "id long, file_name string, width int, height int, source_file_name string, source_split string, source_group string, received_at timestamp, deleted_at timestamp, start double"
ANN = "id long, image_id long, bbox array<double>, received_at timestamp, axis string"


def img(i, w=None, h=None, name=None, src=None, split=None, grp=None, at=0, gone=None):
    return (i, name, w, h, src, split, grp, NOW + timedelta(hours=at), gone, 0.0)


def test_pieces_hold_boxes(spark):
    r = random.Random(2)
    images = [img(i, r.choice([100, 1280, 1281, 1400, 2600, 9000, 20000]), r.choice([50, 1281, 3000])) for i in range(25)]
    images += [img(90, 5000, 5000), img(90, 5000, 5000, at=1, gone=NOW), img(91, None, 5000), img(92, 0, 5000), img(None, 5000, 5000), img(93, 5000, -1)]
    boxes = []
    for k in range(500):
        j = r.choice(images)
        w, h = (r.choice([r.uniform(1, 200), 1280.0, 1279.75, 1500.0, 5.0]) for _ in range(2))
        boxes.append((k, j[0], [round(r.uniform(-100, (j[2] or 1) + 50) * 4) / 4, round(r.uniform(-100, (j[3] or 1)) * 4) / 4, w, h], NOW, "z"))
    boxes += [(900, 0, None, NOW, "z"), (901, 0, [1.0], NOW, "z"), (902, 0, [1.0, 1.0, float("nan"), 2.0], NOW, "z"), (None, 0, [0.0, 0.0, 9.0, 9.0], NOW, "z"), (903, None, [0.0, 0.0, 9.0, 9.0], NOW, "z")]
    I, A = spark.createDataFrame(images, IMG), spark.createDataFrame(boxes + boxes[:20], ANN)
    got = defaultdict(list)
    cut = {}
    for p in pieces.axis_pieces(I, A, span=4096).orderBy("piece").collect():
        got[p.image_id, p.axis].append((p.start, p.stop))
        cut[p.image_id, p.axis] = p.cut
    want = {(j[0], a): n for j in images[:25] for a, n in (("x", j[2]), ("y", j[3])) if n > 1280}
    assert set(got) == set(want)
    for (i, a), length in want.items():
        s = got[i, a]
        assert s[0][0] == 0 and s[-1][1] == length and all(e - b <= 1280 for b, e in s)
        assert all(nb > b and e - nb >= 128 for (b, e), (nb, _) in zip(s, s[1:], strict=False))
        forced = False
        for _, j, b, *_ in boxes:
            if j != i or b is None or len(b) != 4 or b[2] != b[2]:
                continue
            lo, hi = (max(b[k], 0.0) for k in (0, 1)), (min(b[k] + b[k + 2], float(n)) for k, n in ((0, images[i][2]), (1, images[i][3])))
            lo, hi = list(lo), list(hi)
            if hi[0] <= lo[0] or hi[1] <= lo[1]:
                continue
            k = 0 if a == "x" else 1
            forced |= hi[k] - lo[k] > 1280
            assert hi[k] - lo[k] > 1280 or any(x <= lo[k] and hi[k] <= y for x, y in s)
        assert cut[i, a] == ("forced" if forced else "clean")
    assert pieces.axis_pieces(I.limit(0), A).count() == 0
    assert pieces.axis_pieces(I, A.limit(0)).where("cut = 'forced'").count() == 0
    cover = defaultdict(set)
    for p in pieces.image_pieces(I, A, span=4096).collect():
        cover[p.image_id].add((p.x, p.y, p.width, p.height))
    assert all(len(cover[i]) == len(got.get((i, "x"), [0])) * len(got.get((i, "y"), [0])) for i in {k for k, _ in want})
    with pytest.raises(ValueError):
        pieces.axis_pieces(I, A, overlap=1280)


def test_ranges_are_cut_by_themselves():
    """Ranges of a long axis, each from its own boxes and the halo alone, against the rules of pieces."""
    r = random.Random(6)
    for turn in range(400):
        length, span = r.randrange(1281, 12000), r.choice([2560, 3000, 4096])
        boxes = []
        for _ in range(r.randrange(40)):
            a = r.choice([r.randrange(length), r.uniform(0, length - 1), r.randrange(0, length, 50)])
            boxes.append((float(a), float(min(length, a + r.choice([1280, 1279.5, r.uniform(1, 1280), 5])))))
        boxes = [(a, b) for a, b in boxes if a < b]
        own = {}
        for a, b in boxes:
            own.setdefault(min((math.ceil(b) - 1) // span, (length - 1) // span), []).append((b, a))
        at = []
        for k in range((length - 1) // span + 1):
            halo = [(a, b) for b, a in own.get(k + 1, []) if a < (k + 1) * span]
            at += pieces._range_pieces(k * span, length, sorted(own.get(k, [])), halo, 1280, 128, span)
        assert at[0] == 0 and at[-1] + 1280 == length and all(y > x and x + 1280 - y >= 128 for x, y in zip(at, at[1:], strict=False)), turn
        assert all(any(x <= a and b <= x + 1280 for x in at) for a, b in boxes), turn


@pytest.mark.parametrize(
    ("text", "key"),
    [("norrvik-2501-00101", "norrvik-2501-101"), (" NORRVIK--2501-00101\t", "norrvik-2501-101"), ("Norrvik 2501 101", "norrvik-2501-101"), ("n/a", None), ("", None), (None, None), ("TBD", None), ("-", None), ("unknown", None), (" ", None)],
)
def test_session_key(text, key):
    assert names.session_key(text) == key


def test_source_key():
    want = "walk-norrvik-22607"
    for s in ("walk_norrvik_022607.mp4", "WALK_NORRVIK_022607.MP4", "D:\\cards\\walk norrvik 022607 (2).mp4", "/mnt/a/walk-norrvik-022607.mp4 ", "walk_norrvik_022607_copy.mp4", "walk_norrvik_022607_jpg.rf.0dfa83ba1ce545be45938a86993266b2.jpg", "walk%20norrvik%20022607.jpg"):
        assert names.source_key(s) == want
    for s in (None, "", "image.jpg", "untitled.jpg", "unknown", "n/a", "-"):
        assert names.source_key(s) is None


def test_shot():
    want = ("castrovalejo", "sparcap", "6", "1632")
    for s in ("castroválejo_sparcap_c6_001632.jpg", "CASTROVÁLEJO_SPARCAP_c6_００１６３２_jpg.rf.b922af7ced074a968c98acc51902d21e.jpg", "raw/day/1632_castrovalejo_sparcap_c6 - Copy.webp", "castrovalejo.sparcap.c6.01632-resized640.JPEG", "castroválejo%20sparcap%20c6%201632 (2).jpg"):
        assert names.shot(s) == want
    for s in (None, "", "a.jpg", "a_b_12.jpg", "a_b_c_c1_12.jpg"):
        assert names.shot(s) is None


def test_letter_codes_bound_slips():
    r = random.Random(1)
    for _ in range(500):
        w = [r.choice("abcdefghij") for _ in range(8)]
        pair = []
        for _ in range(2):
            v, k = list(w), r.randrange(7)
            r.choice([lambda v, k: v.pop(k), lambda v, k: v.insert(k, r.choice("abcxyz")), lambda v, k: v.__setitem__(k, r.choice("abcxyz")), lambda v, k: v.__setitem__(slice(k, k + 2), v[k : k + 2][::-1])])(v, k)
            pair.append("".join(v))
        assert (names.letter_code(pair[0]) ^ names.letter_code(pair[1])).bit_count() <= overlap.RADIUS
        assert names.slips(*pair, 4) <= 2 + 1  # a swap inside of another edit may count as one more


def brute_sets(rows):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, g, f in rows:
        for k in (("g", names.session_key(g)), ("f", names.source_key(f))):
            if k[1] is not None:
                up[find(("i", i))] = find(k)
    least = {}
    for i, *_ in rows:
        least[find(("i", i))] = min(least.get(find(("i", i)), i), i)
    return {i: least[find(("i", i))] for i, *_ in rows}


def test_related_sets_and_splits(spark):
    r = random.Random(7)
    rows = [(i, r.choice([None, "n/a", "hot-2501-1", f"s-2501-{r.randrange(300)}", f"S 2501 {r.randrange(300):05d}"]), r.choice([None, "", "image.jpg", f"walk_a_{r.randrange(500):06d}.mp4"])) for i in range(900)]
    rows += [(1000 + i, f"chain-1-{i // 2}", f"walk_c_{(i + 1) // 2}.mp4") for i in range(200)]  # one long chain
    rows += [(5, "other-2501-9", None), (5, None, "walk_z_1.mp4"), (2000, "other-2501-9", None)]  # an id with two names
    df = spark.createDataFrame([img(i, src=f, grp=g) for i, g, f in rows + rows[:30]], IMG)
    got = {x.image_id: x.first_image_id for x in related.related_sets(spark, df).collect()}
    assert got == brute_sets(rows)
    s = related.assign_splits(spark, df).collect()
    assert {x.image_id: x.first_image_id for x in s} == got
    by = defaultdict(set)
    for x in s:
        by[x.first_image_id].add(x.split)
    assert all(len(v) == 1 for v in by.values()) and len(s) == len(got)
    assert related.related_sets(spark, df.limit(0)).count() == 0
    tree = [(x.image_id_a, x.image_id_b) for x in related.forest_edges(spark, df).collect()]
    up = {i: i for i in got}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in tree:
        assert got[a] == got[b] and top(a) != top(b)  # no cycle
        up[top(a)] = top(b)
    assert related.forest_edges(spark, df.limit(0)).count() == 0


def test_deal_keeps_proportions(spark):
    r = random.Random(1)
    sizes = [1500, 300, 200, 60] + [r.choice([1, 1, 1, 2, 3, 5, 8]) for _ in range(3000)]
    sets = spark.createDataFrame(list(enumerate(sizes)), "first_image_id long, set_size long")
    got = dealt(sets, "first_image_id", "set_size", [], dict(related.SPLITS)).collect()
    n = Counter()
    for x in got:
        n[x.split] += sizes[x.first_image_id]
    assert len(got) == len(sizes)
    for name, share in related.SPLITS:
        assert abs(n[name] / sum(sizes) - share) < 0.01


def test_forest_spans(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 3), (7, 8), (None, 4), (1, 3)], "a long, b long")
    tree, roots, _ = related.spanning_forest(spark, edges)
    assert tree.count() == 3
    of = {x.vertex: x.root for x in roots.collect()}
    assert of[1] == of[2] == of[3] != of[7] == of[8] and set(of) == {1, 2, 3, 7, 8}
    assert related.spanning_forest(spark, edges.limit(0))[0] is None


def test_overlap(spark):
    rows = [
        img(1, name="norrvik_sparcap_c1_000123.jpg", split="train", grp="g-1"), img(2, name="C:\\x\\norrvk_sparcap_c1_123 (2).jpg", split=" TEST", grp="G 1"), img(3, name="norrvik_spacrap_c1_00123_jpg.rf.aa11.jpg", split="val", grp=None),
        img(4, name="norrvik_sparcap_c2_000123.jpg", split="valid"), img(5, name="norrvik_sparcap_c1_000124.jpg", split="valid"), img(6, name="norvvvik_sparcap_c1_123.jpg", split="training"), img(7, name=None, split="test"), img(8, name="norrvik_sparcap_c1_000123.jpg", split=None),
        img(9, name="mirowitz_sparcap_c1_000123.jpg", split="test"), img(1, name="norrvik_sparcap_c1_000123.jpg", split="train", grp="g-1", at=2),
    ]
    df = spark.createDataFrame(rows, IMG)
    got = {(x.train_id, x.eval_id) for x in overlap.cross_split_pairs(df).collect()}
    assert got == {(1, 2), (1, 3), (6, 3)} | ({(6, 2)} if names.slips("norvvvik", "norrvk", 2) <= 2 else set()) - (set() if names.slips("norvvvik", "norrvik", 2) <= 2 else {(6, 3)})
    rep = {(x.source_split, x.source_group): (x.n_stills, x.n_pairs) for x in overlap.overlap_report(df).collect()}
    assert rep["test", "g-1"][0] == 1 and sum(v[1] for v in rep.values()) == len(got)
    assert overlap.cross_split_pairs(df.limit(0)).count() == 0
    members = {(x.image_id, x.side): (x.class_id, x.n_links) for x in overlap.Overlap(df).members().collect()}
    for (i, side), (_, n) in members.items():
        assert n == len([p for p in got if p[side == "eval"] == i])
    assert {i for i, side in members if side == "eval"} == {b for _, b in got} and {i for i, side in members if side == "train"} == {a for a, _ in got}


def test_segments_lose_no_pair(spark):
    """The blocks of the fingerprint against all pairs of names: recall is one, and links are counted as pairs are."""
    r = random.Random(12)
    sites, views = ["norrvik", "mirowitz", "calderham", "norrvick"], ["sparcap", "elevator", "sparcup"]

    def slip(w):
        k = r.randrange(len(w) - 1)
        return r.choice([w, w[:k] + w[k + 1 :], w[:k] + r.choice("abcxyz") + w[k:], w[:k] + r.choice("abcxyz") + w[k + 1 :], w[:k] + w[k + 1] + w[k] + w[k + 2 :]])

    rows = [img(i % 560, name=f"{slip(r.choice(sites))}_{slip(r.choice(views))}_c{r.randrange(2)}_{r.randrange(3):04d}.jpg", split=r.choice(["train", "valid", "test"])) for i in range(600)]
    df = spark.createDataFrame(rows, IMG)
    side = {True: set(), False: set()}
    for x in rows:
        side[x[5] == "train"].add((x[0], names.shot(x[1])))
    want = {(a, b) for a, s in side[True] for b, t in side[False] if a != b and s[2:] == t[2:] and names.slips(s[0], t[0], 2) <= 2 and names.slips(s[1], t[1], 2) <= 2}
    o = overlap.Overlap(df)
    assert {(x.train_id, x.eval_id) for x in o.pairs().collect()} == want and len(want) > 1000
    for which, k in (("train", 0), ("eval", 1)):
        assert {x.image_id: x.n_links for x in o.linked(which).collect()} == dict(Counter(p[k] for p in want))
