"""Golden cases of cleaning, panel, features, backtests, scoring and serving."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricepanel.operators import backtest, calibrate, clean, features, panel, score, serve, store

DAY = dt.date(2024, 1, 1)


def daily(spark, prices, observed=None, series="Vegetables||Lettuce||Romaine||Local||kg"):
    observed = observed or [True] * len(prices)
    rows = [(series, DAY + dt.timedelta(days=i), float(p) if o else None) for i, (p, o) in enumerate(zip(prices, observed, strict=True))]
    return panel.reindex_daily(spark.createDataFrame(rows, "series string, report_date date, observed_price double"))


def test_units_and_variants(spark):
    rows = [
        ("Oils", "Palm", "1L", "bottle", "liter"), ("Oils", "Palm", "350ML", None, "350ml"), ("Oils", "Palm", "Standard", "1L", "liter"), ("Oils", "Palm", "500ml", "Btl", "bottle"),
        ("Coconut Oils", "Palm", "1L", "bottle", "bottle"), ("Poultry", "Chicken Egg", "Large", "kg", "piece"), ("Oils", "Chicken Egg", "1L", "kg", "piece"), ("Poultry", "Chicken Egg, brown", "Large", "kg", "kg"),
        ("Rice", "A", None, " Per KG", "kg"), ("Rice", "A", "1L", None, "unknown"), ("Fish", "B", "x", "btl", "bottle"), ("Fish", "B", "x", "", ""),
    ]
    out = spark.createDataFrame(rows, "c string, n string, v string, u string, expected string").withColumn("unit", clean.normalise_unit(F.col("u"), F.col("c"), F.col("n"), F.col("v")))
    assert [r.unit for r in out.collect()] == [r[4] for r in rows]
    variants = [("",), (None,), ("Unknown",), ("null",), ("NULL",), ("R",)]
    assert [r[0] for r in spark.createDataFrame(variants, "v string").select(clean.default_variant(F.col("v"))).collect()] == ["Standard"] * 4 + ["NULL", "R"]


def test_rsi_starts_with_the_first_change(spark):
    prices = [10.0, 10.0, 11.0, 10.5, 10.8, None, 11.0, 9.0] + [9.0 + k % 3 for k in range(20)]
    df = spark.createDataFrame([("s", DAY + dt.timedelta(days=i), p) for i, p in enumerate(prices)], "series string, report_date date, price_index double")
    got = [r.rsi for r in features.rsi(df).orderBy("report_date").collect()]
    shifted = pd.Series(prices, dtype=float).shift(1).diff()
    gain, loss = (shifted.where(shifted > 0, 0).rolling(14, min_periods=1).mean(), (-shifted.where(shifted < 0, 0)).rolling(14, min_periods=1).mean())
    assert np.allclose(got, 100 - 100 / (1 + gain / (loss + 1e-6)))
    assert got[:3] == [0, 0, 0] and got[3] > 99


def test_source_date(spark):
    rows = spark.createDataFrame([("Price-Monitoring-March-5-2024.pdf",), ("x-February-30-2024",), ("Foo-1-2024",), (None,)], "d string")
    assert [r[0] for r in rows.select(clean.source_date(F.col("d"))).collect()] == [dt.date(2024, 3, 5), None, None, None]


def test_copied_rows_are_no_truth(spark):
    raw = spark.createDataFrame(
        [(1, "Rice", "A", None, "Local", "kg", DAY, 50.0, "P-January-1-2024.pdf"), (2, "Rice", "A", None, "Local", None, DAY + dt.timedelta(days=1), 999.0, "P-January-1-2024.pdf"), (3, "Rice", "A", None, "Local", "KG", DAY + dt.timedelta(days=9), 51.0, "P-January-10-2024.pdf")],
        "id long, product_category string, product_name string, product_variant string, origin string, unit string, report_date date, price_index double, source_pdf string",
    )
    rows = panel.reindex_daily(clean.validate(raw)).orderBy("report_date").collect()
    assert len(rows) == 10 and not rows[1].is_observed and rows[1].observed_price is None and rows[1].price_index == 50.0
    assert rows[7].price_index == 50.0 and rows[8].price_index is None and rows[9].price_index == 51.0


def test_observation_history(spark):
    rows = features.observation_history(daily(spark, [100 + 2 * i for i in range(10)], [i not in (1, 2, 4) for i in range(10)])).orderBy("report_date").collect()
    assert rows[7].observed_7 == 4 and math.isclose(rows[7].slope_7, 2.0)
    late = features.observation_history(daily(spark, [100 + 2 * i for i in range(12)], [i in (0, 11) for i in range(12)])).orderBy("report_date").collect()
    assert late[9].observed_7 == 0 and late[9].observed_age == 9 and late[9].slope_7 is None


def test_future_does_not_move_past_features(spark):
    prices = [50 + math.sin(i / 7) for i in range(60)]
    a = features.price_windows(daily(spark, prices)).where("report_date < DATE '2024-02-10'").drop("observed_price")
    b = features.price_windows(daily(spark, prices[:45] + [999.0] * 15)).where("report_date < DATE '2024-02-10'").drop("observed_price")
    assert a.exceptAll(b).count() == 0


def test_macd_against_pandas(spark):
    prices = [50 + math.sin(i / 3) for i in range(40)]
    rows = features.macd(daily(spark, prices)).orderBy("report_date").toPandas()
    s = pd.Series(prices).shift(1)
    line = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    assert (rows["macd"] - line).abs().max() < 1e-9 and (rows["macd_signal"] - line.ewm(span=9, adjust=False).mean()).abs().max() < 1e-9


def test_recursive_paths(spark):
    h = spark.createDataFrame([(DAY, "c", "s", [10.0, 11.0])], "origin date, product_category string, series string, last_prices array<double>")
    rows = backtest.recursive_paths(h, {"own": 0.5}, horizon=3).orderBy("horizon").collect()
    expected, p, change = [], 11.0, 0.1
    for _ in range(3):
        change = 0.5 * change
        p *= 1 + change
        expected.append(p)
    assert [round(r.price, 9) for r in rows] == [round(e, 9) for e in expected]


def test_pooled_model_beats_zero(spark):
    rows = spark.createDataFrame([(float(i % 7), 0.5 * (i % 7) + 1) for i in range(100)], "x1 double, target double")
    model = backtest.fit_relative(rows, ["x1"], ridge=0.0)
    assert abs(model.coefficients[0] - 0.5) < 1e-6 and abs(model.intercept - 1) < 1e-6


def test_blend_endpoint(spark):
    rows = spark.createDataFrame([(10.0 + i, 10.0 + i, 5.0, 1) for i in range(20)], "actual double, a double, b double, horizon int").withColumn("persistence", F.lit(9.0))
    assert calibrate.blend_weight(rows, "a", "b").first().weight == 0.0
    assert calibrate.horizon_trust(rows, "a", 1).first().trust == 1.0


def test_cents_half_even(spark):
    mean = sum(map(__import__("decimal").Decimal, ("108.45", "95.45", "109.61", "91.15"))) / 4
    rows = spark.createDataFrame([(str(mean),), ("2.665",), ("2.675",)], "p string").select(score.cents(F.col("p").cast("decimal(20,6)")).cast("string"))
    assert [r[0] for r in rows.collect()] == ["101.16", "2.66", "2.68"]


def test_published_periods(spark):
    origin = dt.date(2026, 9, 27)
    rows = spark.createDataFrame([("s", origin, origin + dt.timedelta(days=h), 100.0 + h) for h in range(1, 31)], "series string, origin date, date date, price double")
    out = score.published(rows).orderBy("grain", "step").collect()
    weeks, months = [r for r in out if r.grain == "weekly"], [r for r in out if r.grain == "monthly"]
    assert [float(r.price) for r in weeks] == [104.0, 111.0, 118.0, 125.0, 129.5] and weeks[-1].covered_days == 2 and weeks[-1].period_days == 7
    assert [float(r.price) for r in months] == [102.0, 117.0]


def test_interval_coverage(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.0, 2.0), ("a", 3.0, 0.0, 2.0), ("a", 1.5, 1.0, 2.0), ("a", 1.0, 1.0, 1.0), ("b", 1.0, 2.0, 0.0)], "k string, actual double, low double, high double")
    out = {r.k: (r.status, r.picp) for r in score.interval_coverage(rows, ["k"]).collect()}
    assert out == {"a": ("ok", 75.0), "b": ("invalid", None)}


def test_pooled_leads(spark):
    rows = spark.createDataFrame([("a", h, 20, 17 + h % 2) for h in range(1, 8)] + [("b", 1, 20, 20)], "series string, horizon int, n long, hits long")
    out = score.pooled_leads(rows).collect()
    assert len(out) == 1 and out[0].n == 140


def test_cheaper_keeps_k(spark):
    rows = spark.createDataFrame([(f"s{i}", "c", f"n{i % 3}", "kg", DAY, i, float(i)) for i in range(20)], "series string, product_category string, product_name string, unit string, report_date date, id int, price_index double")
    out = serve.cheaper(rows, 5)
    for i in (19, 4, 0):
        expected = sorted(j for j in range(i) if j % 3 != i % 3)[:5]
        assert [r.alternative for r in out.where(F.col("series") == f"s{i}").orderBy("rank").collect()] == [f"s{j}" for j in expected]


def test_publish_and_snapshot(spark, tmp_path):
    rows = spark.createDataFrame([("p", "daily", DAY, 1.0), ("p", "weekly", DAY, 1.0)], "product_id string, grain string, date date, price double")
    store.publish(spark, rows, str(tmp_path / "v"), "r1", 2)
    assert len(store.published_runs(spark, str(tmp_path / "v"))) == 1 and store.published_daily(spark, str(tmp_path / "v")).count() == 1
    with pytest.raises(ValueError):
        store.publish(spark, rows, str(tmp_path / "v"), "r2", 3)
    assert store.published_daily(spark, str(tmp_path / "v")).first().run_id == "r1"  # a failed run does not show
    store.publish(spark, rows, str(tmp_path / "v"), "r2", 2)
    assert [(r.run_id, r.price) for r in store.published_daily(spark, str(tmp_path / "v")).collect()] == [("r2", 1.0)]
    with pytest.raises(ValueError):
        store.publish(spark, rows, str(tmp_path / "v"), "r1", 2)  # what is published stays as it is
    (tmp_path / "a.json").write_text('{"rows": [{"id": "1", "product_name": "A", "price_index": 2.5, "report_date": "2024-01-02"}, {"id": "2", "report_date": "2024-03-02"}]}')
    (tmp_path / "b.json").write_text('[{"id": "1", "product_name": "A", "price_index": 2.5, "report_date": "2024-01-02"}]')
    assert [r.id for r in store.read_snapshot(spark, str(tmp_path / "a.json"), "2024-02-01").collect()] == ["1"]
    assert store.read_snapshot(spark, str(tmp_path / "b.json")).first().price_index == 2.5


def test_fingerprint_ignores_order(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    assert store.fingerprint(rows, ["a", "b"]).first() == store.fingerprint(rows.orderBy(F.desc("a")), ["a", "b"]).first()


def test_nearest_equals_brute_force(spark):
    rnd = random.Random(5)
    spot = lambda: rnd.choice([(rnd.uniform(-90, 90), rnd.uniform(-180, 180)), (10 + rnd.gauss(0, 0.001), 20 + rnd.gauss(0, 0.001)), (5.0, 5.0), (rnd.choice([-90.0, 90.0]), 0.0), (0.0, rnd.choice([-180.0, 180.0]))])
    points, places = [(i, *spot()) for i in range(120)], [(1000 + i, *spot()) for i in range(90)]
    out = serve.nearest(spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(places, "place_id long, lat double, lon double"), 3)
    found = {(r.point_id, r.rank): r.km for r in out.collect()}

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    for i, a, b in points:
        best = sorted(km(a, b, c, d) for _, c, d in places)[:3]
        assert all(abs(found[i, r + 1] - x) < 1e-5 for r, x in enumerate(best)), i
    few = spark.createDataFrame(places[:2], "place_id long, lat double, lon double")
    assert serve.nearest(spark.createDataFrame(points[:5], "point_id long, lat double, lon double"), few, 3).count() == 10
    assert serve.nearest(spark.createDataFrame(points[:5], "point_id long, lat double, lon double"), few.limit(0), 3).count() == 0


def test_halves_split_inside_a_day(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), DAY + dt.timedelta(rnd.randrange(4)), i, float(rnd.randrange(100))) for i in range(61)] + [("c", DAY, 99, 5.0)]
    out = {r.k: (r.previous, r.current) for r in serve.halves(spark.createDataFrame(rows, "k string, report_date date, id int, price_index double"), "k").collect()}
    for k in "ab":
        own = [p for _, _, _, p in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))]
        cut = -(-len(own) // 2)
        assert math.isclose(out[k][0], sum(own[:cut]) / cut) and math.isclose(out[k][1], sum(own[cut:]) / (len(own) - cut))
    assert out["c"] == (5.0, None)


def test_multi_horizon_equals_plain_windows(spark):
    rnd = random.Random(9)
    prices = [None if rnd.random() < 0.1 else 50 + rnd.random() for _ in range(100)]
    day = lambda k: DAY + dt.timedelta(k)
    panel = spark.createDataFrame([("s", day(k), p, p) for k, p in enumerate(prices)], "series string, report_date date, price_index double, observed_price double")
    for stride in (30, 10):
        out = features.multi_horizon(panel, 30, stride, str(day(35))).collect()
        seen = set()
        for r in out:
            o, t = (r.origin - DAY).days, (r.target_date - DAY).days
            seen.add((o, r.horizon))
            assert t == o + r.horizon and math.isclose(r.y, prices[t] / prices[o] - 1)
            for w in (7, 14, 30):
                x = np.array([np.nan if p is None else p for p in prices[max(0, o - w + 1) : o + 1]], dtype=float)
                for name, value in (("mean", np.nanmean(x)), ("std", np.nanstd(x)), ("median", np.nanmedian(x)), ("min", np.nanmin(x)), ("max", np.nanmax(x))):
                    assert math.isclose(r[f"x_{name}_{w}"], value / prices[o], rel_tol=1e-9, abs_tol=1e-12)
                there = ~np.isnan(x)
                if there.sum() > 1:
                    assert math.isclose(r[f"x_slope_{w}"], np.polyfit(np.arange(len(x))[there], x[there], 1)[0] / prices[o], rel_tol=1e-6, abs_tol=1e-9)
        assert seen == {(o, h) for o in range(35, 100, stride) if prices[o] is not None for h in range(1, 31) if o + h < 100 and prices[o + h] is not None}


def test_recursive_paths_equal_a_plain_loop(spark):
    rnd = random.Random(4)
    rows = [(DAY, c, f"{c}{i}", [50 + rnd.random() for _ in range(n)]) for c in "xy" for i, n in enumerate((7, 7, 3, 1))]
    found = {(r.series, r.horizon): r.price for r in backtest.recursive_paths(spark.createDataFrame(rows, "origin date, product_category string, series string, last_prices array<double>"), {"own": -0.05, "gap": -0.2, "peer": 0.1}).collect()}
    for c in "xy":
        last = {s: list(p) for _, k, s, p in rows if k == c}
        for h in range(1, 31):
            change = {s: p[-1] / p[-2] - 1 if len(p) > 1 else 0.0 for s, p in last.items()}
            peer = float(np.median(list(change.values())))
            for s, p in last.items():
                p.append(max(0.01, p[-1] * (1 - 0.05 * change[s] - 0.2 * (p[-1] / np.mean(p[-7:]) - 1) + 0.1 * peer)))
                assert math.isclose(found[s, h], p[-1], rel_tol=1e-9)


def test_pooled_model_is_a_ridge_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2)) * [1, 5] + [0, 3]
    y = 0.5 * x[:, 0] - 0.1 * x[:, 1] + rng.normal(size=400) * 0.1
    df = spark.createDataFrame([(float(a), float(b), 1.0, float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, flat double, target double")
    model = backtest.fit_relative(df, ["a", "b", "flat"], ridge=0.0)
    exact = np.linalg.lstsq(np.column_stack([x, np.ones(400)]), y, rcond=None)[0]
    assert np.allclose([*model.coefficients, model.intercept], [exact[0], exact[1], 0.0, exact[2]], atol=1e-9)


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_dense_panel_joins_nothing(spark):
    """Days that a sequence makes are in no side of a join, whose size would be judged before they are made."""
    rnd = random.Random(4)
    rows = [(f"Rice||{s}", DAY + dt.timedelta(days=d), None if rnd.random() < 0.3 else float(d)) for s in "ab" for d in sorted(rnd.sample(range(90), 25))]
    df = spark.createDataFrame(rows, "series string, report_date date, observed_price double")
    out = panel.reindex_daily(df)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.series, r.report_date): r for r in out.collect()}
    expected = 0
    for s in ("Rice||a", "Rice||b"):
        own = {d: p for x, d, p in rows if x == s}
        for k in range((max(own) - min(own)).days + 1):
            day, expected = min(own) + dt.timedelta(days=k), expected + 1
            carried = [own[d] for d in (day - dt.timedelta(days=b) for b in range(8)) if own.get(d) is not None]
            r = got[s, day]
            assert (r.observed_price, r.price_index, r.is_observed, r.product_name) == (own.get(day), carried[0] if carried else None, own.get(day) is not None, s[-1])
    assert len(got) == expected
    ends = panel.extend_to(df, "2024-05-01").groupBy("series").agg(F.max("report_date").alias("hi")).collect()
    assert {r.hi for r in ends} == {dt.date(2024, 5, 1)}
    with pytest.raises(Exception, match="rows after the origin"):
        panel.extend_to(df, "2024-01-20").collect()


def test_paths_broadcast_no_truth(spark):
    """The truth is never sent to the driver, however small it is judged, and is that of the panel where the given prices stand in for it."""
    day = dt.date(2024, 1, 1)
    rows = [(f"Rice||{s}||Standard||Local||kg", day + dt.timedelta(days=3 * k), None if k % 5 == 4 else float(10 * s + k)) for s in range(3) for k in range(30)] + [("Rice||0||Standard||Local||kg", None, 5.0)]
    prices = spark.createDataFrame(rows, "series string, report_date date, observed_price double")
    dense = panel.reindex_daily(prices)
    anchored = backtest.anchors(dense, backtest.origins(spark, "2024-01-20", "2024-04-30"))
    of = lambda truth: backtest.paths(anchored, truth)
    got = of(prices)
    assert sorted(map(str, got.collect())) == sorted(map(str, of(dense).collect())) and got.where("actual IS NOT NULL").count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "LeftOuter" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_first_row_of_a_day_carries_only_what_is_asked(spark):
    key = "product_category string, product_name string, product_variant string, origin string, unit string, report_date date"
    one = ("Rice", "A", "Standard", "Local", "kg", DAY)
    rows = [(*one, 5, False, 1.0, "x"), (*one, 9, True, 2.0, None), (*one, 7, True, None, "y"), (*one, -3, False, 4.0, "z"), (*one[:5], None, None, True, 6.0, "u"), (*one[:5], None, 2, True, 7.0, "v")]
    for kind in ("long", "string"):
        df = spark.createDataFrame(rows, f"{key}, id long, is_observed boolean, price double, source string").withColumn("id", F.col("id").cast(kind))
        got = sorted(((r.id, r.is_observed, r.price, r.source) for r in clean.deduplicate(df).collect()), key=str)
        assert got == sorted([(7 if kind == "long" else "7", True, None, "y"), (None, True, 6.0, "u")], key=str)
        plan = clean.deduplicate(df).select("report_date", "price")._jdf.queryExecution().optimizedPlan().toString()
        assert "source" not in plan.split("Aggregate", 1)[1].split("\n", 1)[0]
        if kind == "long":
            assert "SortAggregate" not in clean.deduplicate(df).select("report_date", "price")._jdf.queryExecution().sparkPlan().toString()


def test_rolling_alone_is_that_of_all_windows(spark):
    rnd = random.Random(9)
    rows = [(f"s{s}", DAY + dt.timedelta(days=d), None if rnd.random() < 0.4 else rnd.uniform(1, 900)) for s in range(3) for d in range((70, 5, 1)[s])]
    dense = spark.createDataFrame(rows, "series string, report_date date, price_index double").withColumns({"is_observed": F.lit(True), "observed_price": F.col("price_index")}).repartition(5)
    names = [f"{n}_{w}" for w in features.WINDOWS for n in ("mean", "std", "min", "max")]
    key = ["series", "report_date"]
    a, b = ([tuple(r) for r in x.select(*key, *names).orderBy(*key).collect()] for x in (features.rolling(dense), features.price_windows(dense)))
    assert len(a) == 76
    for x, y in zip(a, b, strict=True):
        assert x[:2] == y[:2] and all((p is None) == (q is None) and (p is None or math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-9)) for p, q in zip(x[2:], y[2:], strict=True))
