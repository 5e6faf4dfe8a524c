"""Every query against its SQL in DuckDB on a small table set, and every outcome occurs."""

import math
import os

import duckdb
import pytest
from packlane import bridges, roundtrips  # noqa: F401

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float) and math.isfinite(value) and value == int(value):
        return int(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(bridges.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = bridges.QUERIES[name](spark, SMALL)
    got = df.collect()
    cursor = duck.execute(bridges.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got) == rows_of(columns, cursor.fetchall())
    assert got


OUTCOMES = {
    "coverage_tiling": ("code", {None, "archive.malformed.overlapping_ranges", "archive.malformed.prefix_bytes", "archive.malformed.unclaimed_bytes"}),
    "entry_lookup_first": ("marker", {"first", "not_first", "prefixed"}),
    "name_safety": ("unsafe", {None, "empty", "control_byte", "backslash", "absolute_path", "drive_prefix", "parent_component", "directory_with_data"}),
    "fold_collision": ("code", {"archive.ambiguous.case_folded_duplicate_name", "archive.ambiguous.duplicate_name"}),
    "reference_resolution": ("resolution", {"resolved", "prefix_variant", "missing"}),
    "declared_count_agrees": ("outcome", {"pass", "fail", "not_applicable"}),
    "check_matrix_summary": ("summary", {"consistent", "unresolved", "inconsistent"}),
    "flag_method_predicates": ("kind", {"regular", "directory", "symlink", "special", "unknown"}),
    "edit_plan": ("action", {"preserved", "changed", "added"}),
    "edit_targets": ("code", {"repack.invalid.no_such_attachment", "repack.invalid.duplicate_target"}),
    "strict_json_keys": ("code", {None, "manifest.invalid.syntax", "manifest.invalid.unknown_field", "manifest.invalid.missing_field"}),
    "classify_codes": ("exit_status", {3, 5, 6, 7, 8, 9}),
}


@pytest.mark.parametrize("name", sorted(OUTCOMES))
def test_every_outcome_occurs(spark, name):
    column, want = OUTCOMES[name]
    got = {r[0] for r in bridges.QUERIES[name](spark, SMALL).select(column).distinct().collect()}
    assert got >= want if name != "fold_collision" else got <= want and got


def test_layout_and_paths_reach_their_codes(spark):
    got = {r.code for r in bridges.QUERIES["layout_recognition"](spark, SMALL).collect()}
    assert got >= {None, *(f"repack.unsupported.{k}" for k in ("metadata_missing", "root_prefix", "metadata_name", "marker", "extra_entry"))}
    codes = {r.code for r in bridges.QUERIES["component_safety"](spark, SMALL).collect()}
    assert len(codes) >= 11
    plans = {r.code for r in bridges.QUERIES["extraction_plan"](spark, SMALL).collect()}
    assert {"planned", "extract.unsupported.link", "extract.unsupported.special_file", "extract.unsupported.non_utf8_name", "extract.unsafe_path.reserved_device_name"} <= plans


def test_crc_and_catalogue(spark):
    import zlib

    import pyarrow.parquet as pq

    want = {r["page_id"]: zlib.crc32(r["html"].encode()) for r in pq.read_table(f"{SMALL}/pages.parquet").to_pylist()}
    got = bridges.QUERIES["crc32_column"](spark, SMALL).collect()
    assert {r.page_id: r.crc32 for r in got} == want and all(r.crc32_hex == f"{r.crc32:08x}" for r in got)
    rows = bridges.QUERIES["code_catalogue"](spark, SMALL).collect()
    assert len(rows) == 147 and all(r.exit_status in (3, 5, 6, 7, 8, 9) for r in rows)


def test_entry_point(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["package_id", "summary", "exit_status", "attachments"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
