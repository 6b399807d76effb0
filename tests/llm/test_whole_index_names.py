"""The written index is read in bounded pieces; names that don't read as a shot are compared too."""

import glob
import random

import pyarrow.parquet as pq
import pytest

from boxloom.llm import leaks, names, overlap
from boxloom.plans.shared import shared_dir


def test_index_is_written_in_bounded_row_groups(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(7)) for _ in range(5000)]
    text = lambda: " ".join(r.choice(words) for _ in range(130_000))
    docs = spark.createDataFrame([(i, text()) for i in range(12)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, docs.first().text[80_000:80_400])], "item_id long, text string")
    root = shared_dir(spark).removeprefix("file://") + "/boxloom/"
    known = set(glob.glob(f"{root}fm-index-*"))
    assert {x.doc_id for x in leaks.leaked_spans(docs, items).collect()} == {0}
    (new,) = set(glob.glob(f"{root}fm-index-*")) - known
    (file,) = glob.glob(f"{new}/1/*.parquet")
    groups = [pq.ParquetFile(file).metadata.row_group(i) for i in range(pq.ParquetFile(file).num_row_groups)]
    assert sum(g.num_rows for g in groups) == 12
    # 16 MB, and what the last row has beyond that
    assert max(g.total_byte_size for g in groups) < 20 << 20 < sum(g.total_byte_size for g in groups)


IMG = "id long, file_name string, source_split string, source_group string"


@pytest.mark.parametrize(
    ("name", "shot"),
    [
        ("norrvik_sparcap_c1_123.jfif", "norrvik sparcap"), ("Copy of norrvik_sparcap_c1_123.jpg", "norrvik sparcap"), ("https://h/x/norrvik_sparcap_c1_00123.jpg?v=1", "norrvik sparcap"),
        ("norr-vik_sparcap_c1_123.jpg", "norr_vik sparcap"), ("norrv1k_sparcap_c1_123.jpg", "norrv1k sparcap"), ("norrvik1_spa cap_c1_123 (2).png", "norrvik1 spa_cap"), ("123_c1_norrvik_9sparcap.jpg", "norrvik 9sparcap"),
        ("c4lderham_sparcap_c1_123.jpg", "c4lderham sparcap"), ("c1_norrvik_small_0123.jpg", "norrvik small"),
    ],
)
def test_names_that_do_not_read_as_a_shot_at_once(name, shot):
    assert names.shot(name) is None
    assert (*shot.split(), "1", "123") in names.readings(name)


def test_readings_of_other_names():
    for s in ("norrvik_sparcap_c1_123.jpg", "raw/day/123_norrvik_sparcap_c1 - Copy.webp"):
        assert names.readings(s) == [("norrvik", "sparcap", "1", "123")]
    for s in (None, "", " ", "n/a", "image.jpg", "unknown", "Copy of image.jfif", "???"):
        assert names.readings(s) == []
    assert names.readings("IMG_0001.jpg") == names.readings("img 1.png") != names.readings("img_2.jpg")


def test_overlap_of_names_that_are_no_shot(spark):
    """Equal names and names within the slips are linked, whatever they read as."""
    rows = [
        ("norr-vik_sparcap_c1_123.jpg", "norrvik_sparcap_c1_123.jpg", True), ("mirow1tz_spar cap_c2_7.jpg", "mirowitz_sparcap_c2_7.jpg", True), ("mirowitz_sparcap_c3_8.jfif", "mirowitz_sparcap_c3_8.jpg", True),
        ("norrvik1_sparcap_c4_9.jpg", "norrvik_sparcap_c4_1.jpg", False), ("IMG_0041.JPG", "img_41.png", True), ("IMG_0042.JPG", "IMG_0043.JPG", False), ("hangar_norrvik_12.jpg", "hanger_norvik_12.jpg", True), ("a_77.jpg", "b_77.jpg", False),
        ("unknown", "unknown", False), ("walk_calderham_c9_5_6.jpg", "walk_calderham_c9_5_6.webp", True), ("walk_elevator_c9_5_7.jpg", "walk_elevator_c8_5_7.jpg", False), ("stern.jpg", "rudder.jpg", False),
    ]
    df = spark.createDataFrame([(2 * k + e, name, ("train", "valid")[e], "g") for k, (*pair, _) in enumerate(rows) for e, name in enumerate(pair)], IMG)
    want = {(2 * k, 2 * k + 1) for k, (*_, yes) in enumerate(rows) if yes}
    o = overlap.Overlap(df)
    assert {(x.train_id, x.eval_id) for x in o.pairs().collect()} == want
    assert {(x.image_id, x.n_links) for x in o.linked().collect()} == {(b, 1) for _, b in want}
    assert {x.image_id for x in o.members().collect()} == {i for p in want for i in p}
