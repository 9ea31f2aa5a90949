"""Operators keep the rows they should: undated, null-keyed, equal, and feeds over their cap."""

import datetime

from pyspark.sql import functions as F

from panelwright.operators import clean, ranks, resample


def test_feed_over_the_cap_on_one_day_keeps_its_row(spark):
    day = datetime.datetime(2024, 1, 2)
    df = spark.createDataFrame([("a", day)] * 5 + [("b", day)], "feed string, ts timestamp")
    got = {r.feed: (str(r.start_day), r.rows_kept) for r in clean.cap_start_date(df, "feed", "ts", 3).collect()}
    assert got == {"a": (clean.START_DATE, 5), "b": ("2024-01-02", 1)}


def test_undated_rows_are_the_oldest(spark):
    day = datetime.datetime(2024, 1, 2)
    df = spark.createDataFrame([("a", day, 1), ("a", None, 2), ("a", None, 3), ("b", None, 4)], "feed string, ts timestamp, k int")
    kept = lambda cap: sorted(r.k for r in clean.cap_recent(df, "feed", "ts", "k", cap).collect())
    assert kept(10) == [1, 2, 3, 4] and kept(2) == [1, 2, 4] and kept(1) == [1, 4]


def test_rows_with_a_null_key_stay(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, 5)], "g string, v int")
    got = sorted(((r.g, r.v, r.m) for r in ranks.with_group(df, ["g"], m=F.avg("v")).collect()), key=str)
    assert got == [("a", 1, 2.0), ("a", 3, 2.0), (None, 5, None)]


def test_equal_rows_are_units_of_their_own(spark):
    """Exact chance that a resample of 2 + 5 equal rows has one x only: (2/7)^7 + (5/7)^7, so the rest have a slope."""
    rows = [(1, 0.0, 1.0)] * 2 + [(1, 1.0, 3.0)] * 5
    df = spark.createDataFrame(rows, "k int, x double, y double")
    got = resample.iid_bootstrap_wls(df, ["k"], "x", "y", F.lit(1.0), reps=1000).first()
    want = 1000 * (1 - (2 / 7) ** 7 - (5 / 7) ** 7)
    assert abs(got.draws - want) < 45       # about 4.8 standard deviations
