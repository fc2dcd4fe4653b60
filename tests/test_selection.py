"""Quantiles by selection and nearest places in adaptive cells against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricepanel.operators import features, panel, quantiles, serve, store


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 20)
    monkeypatch.setattr(quantiles, "PARTS", 8)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)


PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def test_quantiles_equal_sorting(spark, small_parts):
    rnd = random.Random(1)
    values = {
        "even": [rnd.uniform(0, 1) for _ in range(700)], "steep": [10.0 ** rnd.uniform(-300, 300) for _ in range(500)], "same": [7.0] * 300,
        "mostly one": [5.0] * 400 + [rnd.gauss(5, 1e-9) for _ in range(60)], "few": [3.0, 1.0], "one": [-2.5], None: [rnd.randrange(4) * 1.0 for _ in range(200)], "none": [None, float("nan")],
    }
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("even", None), ("even", float("nan"))]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: r.quantiles for r in quantiles.exact_quantiles(df, "v", PROBABILITIES, ["k"]).collect()}
    assert set(got) == set(values) - {"none"}
    for k, found in got.items():
        assert np.allclose(found, np.quantile(values[k], PROBABILITIES), rtol=1e-12, atol=0), k
    whole = quantiles.exact_quantiles(df, "v", [0.3]).first().quantiles
    known = [v for _, v in rows if v is not None and v == v]
    assert math.isclose(whole[0], float(np.quantile(known, 0.3)), rel_tol=1e-12)
    assert quantiles.exact_quantiles(df.limit(0), "v", [0.5], ["k"]).count() == 0


def test_selection_never_gathers_many_values(spark, small_parts):
    """The plan's only list of values is of parts of ``SMALL`` rows; a value repeated a thousand times is settled by counts."""
    df = spark.createDataFrame([(float(v),) for v in [1] * 1000 + [2] * 3 + [3] * 1000], "v double")
    assert quantiles.exact_quantiles(df, "v", [0.5, 0.4999, 0.7]).first().quantiles == [2.0, 2.0, 3.0]


def brute_nearest(points, places, k):
    out = set()
    for i, lat, lon in points:
        far = []
        for j, a, b in places:
            h = math.sin(math.radians(a - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(a)) * math.sin(math.radians(b - lon) / 2) ** 2
            far.append((round(2 * 6371.0 * math.asin(math.sqrt(min(1.0, h))), 9), j))
        out |= {(i, r + 1, j) for r, (_, j) in enumerate(sorted(far)[:k])}
    return out


def test_nearest_in_a_dense_city(spark):
    """Most places and points stand in one city, the others anywhere, the poles and the date line included."""
    rnd = random.Random(7)
    city = lambda: (14.6 + rnd.gauss(0, 0.01), 121.0 + rnd.gauss(0, 0.01))
    anywhere = lambda: (math.degrees(math.asin(rnd.uniform(-1, 1))), rnd.uniform(-180, 180))
    places = [(k, *(city() if k % 10 else anywhere())) for k in range(3000)] + [(5000 + k, 14.6, 121.0) for k in range(50)]
    points = [(k, *(city() if k % 2 else anywhere())) for k in range(60)] + [(100, 90.0, 0.0), (101, -90.0, 10.0), (102, 0.0, 180.0), (103, 14.6, 121.0)]
    place_df = spark.createDataFrame([*places, (9999, None, 1.0)], "place_id long, lat double, lon double")
    point_df = spark.createDataFrame([*points, (999, None, None)], "point_id long, lat double, lon double")
    got = serve.nearest(point_df, place_df, 3, leaf=16)
    assert {(r.point_id, r.rank, r.place_id) for r in got.collect()} == brute_nearest(points, places, 3)
    levels, leaves = serve._split_cells(store.kept(place_df.where("lat IS NOT NULL").selectExpr("place_id", "lat", "lon", "cos(radians(lat)) * cos(radians(lon)) AS x", "cos(radians(lat)) * sin(radians(lon)) AS y", "sin(radians(lat)) AS z").where("place_id < 5000"), "spots"), 16)
    assert len(levels) > 3 and leaves.groupBy("level", "i", "j", "l").count().where("count > 16").isEmpty() and leaves.count() == 3000


def test_replay_sees_what_was_known(spark):
    """Features of each cutoff against a panel that is built from the versions known by then; a corrected day is found."""
    rnd = random.Random(2)
    first = dt.date(2024, 1, 1)
    day = lambda k: first + dt.timedelta(days=k)
    versions = [(s, day(k), day(k + rnd.choice([0, 0, 1, 3])), round(rnd.uniform(40, 60), 2)) for s in ("Rice||a", "Rice||b") for k in range(90) if rnd.random() < 0.8]
    versions += [(s, d, d + dt.timedelta(days=9), p + 7) for s, d, _, p in versions if rnd.random() < 0.1]
    cuts = [20, 45, 70, 88]
    df = spark.createDataFrame(versions, "series string, report_date date, available_on date, observed_price double")
    got = features.replayed(df, spark.createDataFrame([(day(c),) for c in cuts], "origin date")).cache()
    assert got.count() == 2 * len(cuts)
    plain = None
    for c in cuts:
        known = {}
        for s, d, on, p in sorted((v for v in versions if v[2] <= day(c)), key=lambda v: v[2]):
            known[s, d] = p
        rows = [(s, d, p) for (s, d), p in known.items()] + [(s, day(c + 1), None) for s in ("Rice||a", "Rice||b")]
        view = features.price_windows(panel.reindex_daily(spark.createDataFrame(rows, "series string, report_date date, observed_price double")))
        view = view.where(F.col("report_date") == F.lit(day(c + 1))).withColumn("origin", F.lit(day(c)))
        plain = view if plain is None else plain.unionByName(view)
    assert {tuple(r)[1:] for r in features.leaks(got, plain).collect()} == {(2, 0, 0)}
    last = features.price_windows(panel.reindex_daily(spark.createDataFrame([(s, d, p) for (s, d), p in {(v[0], v[1]): v[3] for v in sorted(versions, key=lambda v: v[2])}.items()], "series string, report_date date, observed_price double")))
    leaking = features.leaks(got, last.withColumn("origin", F.date_sub("report_date", 1)).join(got.select("series", "origin"), ["series", "origin"], "left_semi")).collect()
    assert sum(r.differing for r in leaking) > 0
