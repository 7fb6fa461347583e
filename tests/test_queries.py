import duckdb
import pytest

from corroborate import media_oracle, media_queries, oracle, queries

from .conftest import SF, TABLES, same

QUERIES, SQL = queries.QUERIES | media_queries.QUERIES, oracle.SQL | media_oracle.SQL
ROWS_ONLY = {"nearest_cases_mahalanobis", "dct_peak", "psd_projection", "tracker", "tracker_retiring", "picture_statistics", "picture_patches", "picture_agreement", "picture_calibration"}
LARGER = "/root/testdata/sf0.01"


def test_all_have_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY and set(SQL) <= set(QUERIES) and not set(queries.QUERIES) & set(media_queries.QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, SQL[name])


@pytest.fixture(scope="module")
def larger():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{LARGER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["fusion_full", "pipeline_verdict", "early_stop_decisions", "geometry_checks", "manifest_scores", "track_flags", "evasion_flags", "nearest_cases", "ema_smoothing", "progress_rows"])
def test_same_rows_as_sql_on_more(spark, larger, name):
    same(QUERIES[name](spark, LARGER), larger, SQL[name])


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
