"""Queries with SQL against DuckDB, the others for their columns and rows, on a small table set."""

import os

import duckdb
import pytest
from packlane.llm import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")

COLUMNS = {
    "op1_token_ids": "doc_id start n_tokens ids_crc32",
    "op2_mixing": "doc_id size source_size target taken",
    "op3_language": "doc_id held_out lang_pred score",
    "op4_near_dedup": "doc_id n_shingles component_id kept",
    "op5_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6_decontaminate": "doc_id item_id start item_start length matched item_words",
    "op7_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op8_quality": "doc_id held_out score predicted",
    "op9_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op10_exact_dedup": "doc_id keep_id group_size kept text_sha256",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert df.columns == COLUMNS[name].split()
    n = df.count()
    assert n == (50 if name == "op7_warc" else 200) or name == "op6_decontaminate" and n > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    cursor = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    got = queries.QUERIES[name](spark, SMALL).select(*names).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
