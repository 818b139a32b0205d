"""Every registered query of the subpackage on sf0.001: its columns, one row where one is due, and its SQL where it has one."""

import os
from pathlib import Path

import duckdb
import pytest
from runlens.llm import queries

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
#: Table whose rows the result has one by one (None: another number), and its columns and types.
RESULTS = {
    "op1_packing": (None, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"),
    "op2_toxicity": ("documents", "doc_id bigint, held_out boolean, score double, predicted int"),
    "op3_decontam": (None, "doc_id bigint, item_id bigint, distance int, start bigint, end bigint"),
    "op4_simhash": ("documents", "doc_id bigint, fingerprint string, component_id bigint"),
    "op5_sharding": ("documents", "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"),
    "op6_embeddings": ("embeddings", "vec_id bigint, n_links bigint, component_id bigint, kept boolean"),
    "op7_chat": ("conversations", "conv_id bigint, position bigint, turn bigint, role string, new_role string, action string, inserted string, closed boolean, cost int, rendered string"),
    "op8_urlfilter": ("pages", "page_id bigint, host string, path string, rule string, verdict string"),
    "op9_suffix": ("documents", "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"),
    "op10_htmltext": ("pages", "page_id bigint, url string, text string, n_chars bigint"),
}


def test_all_are_there():
    assert set(queries.QUERIES) == set(RESULTS) and set(queries.ORACLE_SQL) <= set(RESULTS)


@pytest.mark.parametrize("name", RESULTS)
def test_result(spark, name):
    table, columns = RESULTS[name]
    frame = queries.QUERIES[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in frame.dtypes) == columns
    got = sorted(map(repr, map(tuple, frame.select(sorted(frame.columns)).collect())))
    assert got and (table is None or len(got) == spark.read.parquet(f"{SF}/{table}.parquet").count())
    if name in queries.ORACLE_SQL:
        duck = duckdb.connect()
        for f in Path(SF).glob("*.parquet"):
            duck.sql(f"create view {f.stem} as select * from '{f}'")
        want = duck.sql(queries.ORACLE_SQL[name])
        order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
        assert sorted(want.columns) == sorted(frame.columns)
        assert got == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
