"""Values exactly at a threshold or half way between two digits: the same rows as SQL."""

import datetime

import duckdb
import pytest

from corroborate import oracle, queries

from .conftest import same

EVENTS = "event_id long, ts timestamp, user_id long, event_type string"
DAY = datetime.datetime(2024, 1, 11, 6)


def check(spark, folder, events, name):
    spark.createDataFrame([(i, DAY, u, t) for i, u, t in events], EVENTS).coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    same(queries.QUERIES[name](spark, str(folder)), con, oracle.SQL[name])


# Two votes of one category each, their deviation is 0.175 but for the last bit.
SCORE = [(334304, 4864, "signup"), (335039, 4864, "view")]
VERDICT = [(3808060, 58411, "view"), (3809327, 58411, "signup")]
WEIGHTED = [(526635, 7771, "view"), (529398, 7771, "error"), (529904, 7771, "signup")]


@pytest.mark.parametrize("name,events", [("fusion_full", SCORE), ("fusion_base", VERDICT), ("conflict_stats", VERDICT), ("fusion_confidence_weighted", WEIGHTED)])
def test_deviation_at_its_threshold(spark, tmp_path, name, events):
    check(spark, tmp_path, events, name)


def test_mean_half_way_between_two_digits(spark, tmp_path):
    """The sum of these 64 numbers of two digits comes out a bit below the tie."""
    ends = [1, 82, 21, 76, 34, 39, 50, 33, 24, 43, 83, 96, 85, 31, 5, 68, 51, 12, 73, 25, 16, 96, 88, 17, 29, 2, 83, 44, 56, 24, 36, 4, 14, 40, 87, 67, 76, 18, 42, 92, 70, 75, 27, 29, 74, 97, 86, 31, 66, 74, 18, 37, 11, 55, 58, 26, 57, 10, 95, 68, 95, 94, 1, 25]
    check(spark, tmp_path, [(100 * k + x, 225, "view") for k, x in enumerate(ends)], "patch_consistency")
