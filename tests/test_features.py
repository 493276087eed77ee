"""The full feature table: its generated code, its calendar and its cluster labels."""

import contextlib
import datetime
import io
import re

import numpy as np
from pyspark.sql import functions as F

from tripweave import views
from tripweave.functions import calendar as cal
from tripweave.operators import cluster, features

JIT_LIMIT = 8_000  # bytes; the JVM interprets larger methods for ever


def test_no_step_of_the_feature_table_is_too_long_to_be_compiled(spark, monkeypatch):
    sizes, write = {}, features.materialize

    def listed(df):
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            df.explain("codegen")
        return [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]

    def watched(df, tag):
        sizes[tag] = listed(df)
        return write(df, tag)

    monkeypatch.setattr(features, "materialize", watched)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # adaptive plans do not show their code before they run
    try:
        trips = views.trips(spark, "/root/testdata/sf0.001")
        out = features.all_features(trips)
        sizes["last"] = listed(out)
        parts = out.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes["features-spatial"] and sizes["last"] and parts < 100
    assert {k: v for k, v in sizes.items() if max(v, default=0) > JIT_LIMIT} == {}
    assert out.count() == trips.count()


def test_holidays_of_every_day_by_plain_python(spark):
    def fixed(d):
        return any((d.month, d.day) == (m, n) and d.year >= since for m, n, since in cal.FIXED_HOLIDAYS)

    def want(d):
        floating = any(d.month == m and d.weekday() == w and lo <= d.day <= hi for m, w, lo, hi in cal.FLOATING_HOLIDAYS)
        one = datetime.timedelta(days=1)
        return fixed(d) or floating or (d.weekday() == 4 and fixed(d + one)) or (d.weekday() == 0 and fixed(d - one))

    days = [datetime.date(2015, 1, 1) + datetime.timedelta(days=i) for i in range(15 * 366)]
    df = spark.createDataFrame([(d,) for d in days] + [(None,)], "d date").withColumn("h", cal.is_us_holiday(F.col("d")))
    got = {r["d"]: r["h"] for r in df.collect()}
    assert got.pop(None) is None
    assert [d for d in days if got[d] != want(d)] == []


def test_nearest_centre_ties_and_missing_values(spark):
    rows = [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 5.0, 5.0), (3, None, 1.0), (4, float("nan"), 1.0), (5, 0.4, 0.0)]
    df = spark.createDataFrame(rows, "i int, a double, b double")
    at = [F.col("a"), F.col("b")]

    def got(centers):
        return [r["c"] for r in df.withColumn("c", cluster.nearest(at, np.array(centers))).orderBy("i").collect()]

    assert got([[0.0, 0.0], [2.0, 0.0], [5.0, 5.0]]) == [0, 0, 2, None, 0, 0]  # the second row lies halfway
    assert got([[2.0, 0.0], [0.0, 0.0]]) == [1, 0, 0, None, 0, 1]
    assert got([[7.0, 7.0]]) == [0, 0, 0, None, 0, 0]
    assert df.select(cluster.nearest(at, np.zeros((0, 2))).alias("c")).where("c IS NOT NULL").count() == 0
