"""The queries of the subpackage: against DuckDB where there is SQL, else that they run and have the columns agreed on."""

import os

import pytest

from boxloom.llm import bpe, catalog

COLUMNS = {
    "p1_found": ["image_id", "axis", "cut"], "p2_found": ["first_image_id", "image_id"], "p3_found": ["image_id", "det_id"], "p5_found": ["image_id_a", "image_id_b"],
    "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, name):
    if name == "p8_ids" and not os.path.exists(bpe.VOCABULARY):
        pytest.skip("no vocabulary file")
    df = catalog.QUERIES[name](spark, data)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
    if name in catalog.SQL:
        import duckdb

        c = duckdb.connect()
        for f in os.listdir(data):
            c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
        want = c.execute(f"select {', '.join(df.columns)} from ({catalog.SQL[name]})").fetchall()
        assert sorted(map(tuple, rows)) == sorted(want)
