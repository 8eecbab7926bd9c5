"""Queries against DuckDB on events with values that the smallest tables don't have."""

import datetime

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.plans.queries import ORACLE, QUERIES

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture
def differs(spark, tmp_path):
    def run(name, rows, again=False):
        if not again:
            spark.createDataFrame([(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n), user, kind, value, "{}") for n, (k, user, kind, value) in enumerate(rows)], SCHEMA).write.parquet(f"{tmp_path}/events.parquet")
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        return oracle.difference(QUERIES[name](spark, str(tmp_path)), con, ORACLE[name])

    return run


def test_states_of_odd_events(differs):
    values = [0.0, -5.0, None, 1e-7, 9.99, 10.0, 20.0, 30.0, 39.99, 40.0, 44.99, 45.0, 1e9, float("nan"), float("inf"), float("-inf")]
    kinds = ["click", "user", None, "ml", "ml_confirmed"]
    rows = [(k, 1, kinds[k % 5], values[k % 16]) for k in range(-80, 80)] + [(None, 1, "view", 12.0), (None, None, None, None)]
    assert differs("state_functions", rows) is None


def test_durations_that_count(spark):
    series = F.array(F.struct(F.lit(100.0).alias("tMs")))
    row = spark.range(1).select(*[labels.duration_or_last(F.lit(x).cast("double"), series, F.lit(50)).alias(f"c{k}") for k, x in enumerate((7, 0, -1, None))], labels.duration_or_last(F.lit(0), series, F.lit(50), known=F.lit(True)).alias("own")).first()
    assert tuple(row) == (7.0, 150.0, 150.0, 150.0, 0.0)


def test_runs_at_the_last_bit_of_the_threshold(differs):
    """A value that lies on its user's threshold, by a percentile that two ways to interpolate give with different last bits."""
    users = [(10.35, 12.91, 30.99), (10.42, 10.7, 30.49), (10.42, 12.98, 31.06), (10.42, 13.7, 31.24), (10.49, 13.05, 31.13)]
    rows = [(0, 99, "view", None), (1, 99, "view", None), (2, 98, "view", 5.0), (3, 97, "view", float("nan")), (4, 97, "view", None), (5, 97, "view", float("inf"))]
    for user, (lo, hi, on) in enumerate(users):
        rows += [(10 * user + 10 + k, user, "view", x) for k, x in enumerate((1.0, lo, None, hi, on, 15.0, 70.0))]
    assert differs("threshold_runs", rows) is None
    assert differs("noise_floor", rows, again=True) is None
