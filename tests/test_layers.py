"""The layers of the blend against plain loops over the rows, fitted one after the other."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from pricepanel.operators import backtest, calibrate
from pricepanel.operators import score as scoring

DAY = dt.date(2024, 1, 1)
COLUMNS = "product_category string, product_name string, origin date, horizon int, actual double, anchor double, persistence double, seasonal7 double, moving_average7 double"


def frame(seed, products=6, origins=10):
    """Paths in which prices stay at their anchor, save that jumps fall back; one product follows its season, horizon 29 has one row and 30 none."""
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(products):
        for o in range(origins):
            level = 50.0 + 5 * p
            jump = rng.choice([1.0, 1.0, 1.0, 1.0, 1.35, 1.8])
            anchor, mean = float(level * jump), float(level * (rng.uniform(0.9, 1.1) if jump == 1 else 1))
            for h in range(1, 29 + (p == o == 0)):
                actual = level + (anchor - level) * np.exp(-h / 4) + rng.normal(0, 1)
                season = actual + rng.normal(0, 0.5) if p == 1 else level * rng.uniform(0.5, 1.5)
                rows.append(("Rice" if p < 4 else "Fish", f"P{p}", DAY + dt.timedelta(days=30 * o), h, None if rng.random() < 0.1 else float(actual), anchor, anchor, float(season), float(mean)))
    return [r for r in rows if not (r[0] == "Fish" and r[3] == 7 and r[2] > DAY)]  # too few rows for a trust of their own


def errors(rows, value):
    e = value - rows.actual
    return np.array([e.abs().mean(), np.sqrt((e**2).mean()), (e / rows.actual).abs().mean()])


def score(rows, value):
    return round(float((errors(rows, value) / np.maximum(errors(rows, rows.anchor), 1e-12)).sum()), 9)


def first_best(tried):
    """The first of the lowest scores; scores within 1e-9 are one."""
    return min(tried, key=lambda x: x[0])


def plain_layers(df):
    k = df[df.actual.notna()].copy()
    grid = [round(i / 100, 2) for i in range(101)]
    w = first_best([(round(float(((1 - w) * k.seasonal7 + w * k.moving_average7 - k.actual).abs().mean()), 9), w) for w in grid])[1]
    k["f"] = (1 - w) * k.seasonal7 + w * k.moving_average7
    out = {"weight": w, "horizon": {}, "category": {}, "special": {}}
    for h in range(1, 31):
        rows = k[k.horizon == h]
        rows = k if len(rows) < 2 else rows
        out["horizon"][h] = first_best([(score(rows, rows.anchor + t * (rows.f - rows.anchor)), t) for t in grid])[1]
    k["f"] = k.anchor + k.horizon.map(out["horizon"]) * (k.f - k.anchor)
    for (c, h), rows in k.groupby(["product_category", "horizon"]):
        out["category"][c, h] = 1.0 if len(rows) < 10 else first_best([(score(rows, rows.anchor + t * (rows.f - rows.anchor)), t) for t in grid[::5]])[1]
    trust = np.array([out["category"][x] for x in zip(k.product_category, k.horizon, strict=True)])
    k["f"] = k.anchor + trust * (k.f - k.anchor)
    best = (score(k, k.f), 1e9, 0.0, 1.0)
    for t in [0.15, 0.2, 0.25, 0.3, 0.5, 0.75, 1.0]:
        hit = np.log(k.anchor / k.moving_average7).abs() > t
        for s in [0.25, 0.5, 0.75, 1.0]:
            for d in [1.0, 3.0, 7.0, 14.0]:
                moved = k.f.where(~hit, k.f + s * (1 - np.exp(-k.horizon / d)) * (k.moving_average7 - k.f))
                if hit.any() and score(k, moved) < best[0]:
                    best = (score(k, moved), t, s, d)
    out["anomaly"] = best[1:]
    hit = np.log(k.anchor / k.moving_average7).abs() > best[1]
    k["f"] = k.f.where(~hit, k.f + best[2] * (1 - np.exp(-k.horizon / best[3])) * (k.moving_average7 - k.f))
    days = sorted(k.origin.unique())
    k["bin"] = np.select([k.horizon <= 3, k.horizon <= 7, k.horizon <= 14, k.horizon <= 21], ["01-03", "04-07", "08-14", "15-21"], "22-30")
    for key, rows in k.groupby(["product_category", "product_name", "bin"]):
        halves = [rows[rows.origin <= days[len(days) // 2 - 1]], rows[rows.origin > days[len(days) // 2 - 1]]]
        if min(map(len, halves)) < 20:
            continue
        ratio = lambda r, a, x: errors(r, (1 - x) * r.f + x * r[a]) / errors(r, r.f)
        picks = [first_best([(round(float(ratio(r, a, x).mean()), 9), a, x) for a in ("seasonal7", "persistence", "moving_average7") for x in [round(i * 0.05, 2) for i in range(1, 11)]]) for r in halves]
        if picks[0][0] < 1 and picks[1][0] < 1 and picks[0][1] == picks[1][1]:
            checks = [ratio(halves[1], *picks[0][1:]), ratio(halves[0], *picks[1][1:])]
            if all((q < 1).all() and q.mean() <= 0.9975 for q in checks):
                out["special"][key] = (picks[0][1], min(picks[0][2], picks[1][2]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_layers_are_fitted_in_order(spark, seed):
    rows = frame(seed)
    df = pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])
    df["actual"] = df.actual.astype(float)
    plain = plain_layers(df)
    got = calibrate.fit_layers(spark.createDataFrame(rows, COLUMNS).cache(), "seasonal7", "moving_average7", ["seasonal7", "persistence", "moving_average7"], lambda t, _: spark.createDataFrame(t.collect(), t.schema))
    assert got["weight"].first().weight == plain["weight"]
    assert {r.horizon: r.trust for r in got["horizon"].collect()} == plain["horizon"]
    assert {r.horizon: r.n for r in got["horizon"].collect()}[30] == 0
    assert {(r.product_category, r.horizon): r.trust for r in got["category"].collect()} == plain["category"]
    x = got["anomaly"].first()
    assert (x.threshold, x.strength, x.decay) == plain["anomaly"] and x.strength > 0
    assert {(r.product_category, r.product_name, r.bin): (r.alternative, r.weight) for r in got["special"].collect()} == plain["special"] != {}


def test_layers_without_help_or_rows(spark):
    calm = [("Rice", "A", DAY, h, 10.0, 10.0, 10.0, 9.0, 10.0) for h in range(1, 31)]
    same = lambda t, _: spark.createDataFrame(t.collect(), t.schema)
    got = calibrate.fit_layers(spark.createDataFrame(calm, COLUMNS), "seasonal7", "moving_average7", ["seasonal7", "persistence", "moving_average7"], same)
    x = got["anomaly"].first()
    assert (x.threshold, x.strength, x.decay) == (1e9, 0.0, 1.0) and got["special"].count() == 0  # one origin
    assert {r.trust for r in got["category"].collect()} == {1.0}
    nothing = calibrate.horizon_trust(spark.createDataFrame([], COLUMNS), "seasonal7")
    assert {(r.n, r.trust) for r in nothing.collect()} == {(0, 1.0)}


def test_weighted_fit_and_stacked_prices(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key, n in (("a", 200), ("b", 3), ("c", 40)):
        for _ in range(n):
            x, z = rng.normal(1e4, 1), rng.normal()
            rows.append((key, float(x), 7.0 if key == "c" else float(z), float(2 * x - z + rng.normal(0, 0.1)), float(rng.uniform(0.1, 3)), 10.0))
    rows += [("a", None, 1.0, 1.0, 1.0, 10.0), ("a", 1.0, 1.0, 1.0, 0.0, 10.0)]
    df = spark.createDataFrame(rows, "key string, x double, z double, y double, q double, anchor double")
    got = {r.key: r for r in backtest.fit_weighted(df, ["x", "z"], "y", "q", ["key"], ridge=1e-3).collect()}
    for key in "abc":
        own = np.array([r[1:5] for r in rows if r[0] == key and r[1] is not None and r[4] > 0])
        q = own[:, 3] / own[:, 3].sum()
        mean = q @ own[:, :3]
        left = own[:, :3] - mean
        cov = (left * q[:, None]).T @ left
        kept = [0] if key == "c" else [0, 1]  # a column without spread
        weights = np.zeros(2)
        weights[kept] = np.linalg.solve(cov[np.ix_(kept, kept)] + 1e-3 * np.diag(np.diag(cov)[kept]), cov[kept, 2])
        assert np.allclose(got[key].weights, weights) and np.isclose(got[key].intercept, mean[2] - weights @ mean[:2]) and got[key].n == len(own)
    fit = spark.createDataFrame([("a", [0.1, 0.0], 0.0), ("b", [1.0, 0.0], 5.0)], "key string, weights array<double>, intercept double")
    few = spark.createDataFrame([("a", 2.0, 1.0, 10.0), ("b", 1.0, 1.0, 10.0), ("z", 1.0, 1.0, 10.0), ("a", None, 1.0, 10.0)], "key string, x double, z double, anchor double")
    assert sorted(r.price for r in backtest.stacked_prices(few, fit, ["x", "z"], ["key"]).collect()) == [10.0, 10.0, 12.0, 15.0]


def test_replay_tables(spark):
    rows = [("s", DAY, DAY + dt.timedelta(days=h), h, float(10 + h) if h != 2 else None, 12.0) for h in range(1, 11)] + [("t", DAY, DAY + dt.timedelta(days=h), h, None, 5.0) for h in range(1, 4)]
    paths = spark.createDataFrame(rows, "series string, origin date, date date, horizon int, actual double, f double")
    # 1 January 2024 is a Monday: the first week has six days of the path, the second four
    got = {(r.level, r.grain, r.step, r.series): (r.n, round(r.mae, 6), round(r.rmse, 6)) for r in scoring.replay_tables(scoring.period_rows(paths, "f")).collect()}
    first, second = np.mean([11, 13, 14, 15, 16]), np.mean([17, 18, 19, 20])
    assert got["step", "weekly", 1, None][1] == round(abs(first - 12), 6) and got["step", "weekly", 2, None][1] == round(abs(second - 12), 6)
    assert got["all", "daily", None, None][0] == 9 and got["series", "monthly", None, "s"][0] == 1 and not any(k[3] == "t" for k in got)
    worst = scoring.worst_series(scoring.replay_tables(scoring.period_rows(paths, "f")), 5).collect()
    assert {(r.grain, r.place, r.series) for r in worst} == {("daily", 1, "s"), ("weekly", 1, "s"), ("monthly", 1, "s")}


def test_target_gates(spark):
    kinds = "series string, origin date, date date, horizon int, actual double, f double"
    rows = [("s", DAY, DAY + dt.timedelta(days=h), h, 20.0, 20.0 + (h % 3 - 1)) for h in range(1, 31)]
    targets = {"within_10": ("min", 90.0), "mae": ("max", 5.0), "rmse": ("max", 5.0), "mape": ("max", 5.0)}
    gate = lambda rows, targets=targets: tuple(scoring.target_gates(spark.createDataFrame(rows, kinds), "f", targets).first())
    assert gate(rows) == (3, True, True, True)
    assert gate([*rows, ("s", DAY, DAY + dt.timedelta(days=31), 31, None, 20.0)]) == (3, True, False, False)  # a day without its truth
    assert gate(rows, targets | {"mae": ("max", 0.1)})[1:] == (False, True, False)
    assert gate([(*r[:5], r[5] + 15) for r in rows])[0] == 0
    assert gate([(*r[:4], None, r[5]) for r in rows])[1:] == (False, False, False)  # nothing to score
