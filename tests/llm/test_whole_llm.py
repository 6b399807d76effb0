"""Ids with several texts, and slips that overlap."""

from itertools import product

from boxloom.llm import leaks, names


def test_items_of_one_id_with_two_texts(spark):
    first = [f"alpha{chr(97 + i)}" for i in range(26)]
    second = [f"bravo{chr(97 + i)}" for i in range(19)]  # sorted after the first, and shorter
    items = spark.createDataFrame([(7, " ".join(first)), (7, " ".join(second)), (8, " ".join(first))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + " ".join(first)), (2, " ".join(second) + " end"), (3, " ".join(first[:10] + second[:10]))], "doc_id long, text string")
    got = leaks.leaked_spans(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 7), (1, 8), (2, 7)]


def one_slip(w, letters="abx"):
    """w and all that one slip of the keys makes of it."""
    put = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    changed = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
    swapped = {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}
    return {w} | put | out | changed | swapped


def test_slips_of_two_names_may_overlap():
    assert names.slips("ba", "axb", 2) == 2
    words = ["".join(w) for n in range(5) for w in product("abx", repeat=n)]
    near = {w: one_slip(w) for w in words}
    for a in words:
        for b in words:
            want = 0 if a == b else 1 if b in near[a] else 2 if near[a] & near[b] else 3
            assert names.slips(a, b, 2) == want, (a, b)
