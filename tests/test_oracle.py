"""A sample of queries against their SQL in DuckDB on the smallest tables; the driver runs them all."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["metric_dice", "metric_mutinf", "metric_mahlnbs", "metric_hdrfdst", "eval_every_metric", "eval_user_metric", "eval_all_segmentation", "metric_psnr", "sel_percentile", "sel_compose", "udtf_patches", "metric_ssim", "eval_merged_labels", "ext_pad_zero", "idx_patch_incomplete", "tfm_clip_percentile", "tfm_size_pad", "aug_rot90", "asm_planes_mean", "report_console", "flt_largest_cc_consecutive", "flt_otsu_mask", "create_rel_files", "sink_data_roundtrip", "datasource_patches", "datasource_item", "ext_datasource", "ext_pad_sides", "create_files", "ext_filesystem_datasource", "tfm_loop_entries", "asm_closed", "sink_fill"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    want = duck.sql(entry.oracle_sql()[name])
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(want.fetchall(), want.columns)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
