"""Backtests of baseline forecasts over many origins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .panel import by_series, known_runs, series_names

HORIZON = 30


def origins(spark, start: str, end: str, horizon: int = HORIZON, stride: int = 30) -> DataFrame:
    """BT1: the day before ``start``, every ``stride`` days up to ``end - horizon``, and that last day."""
    first, last = F.date_sub(F.lit(start).cast("date"), 1), F.date_sub(F.lit(end).cast("date"), horizon)
    days = F.array_union(F.sequence(first, last, F.expr(f"INTERVAL {stride} DAYS")), F.array(last))
    return spark.range(1).select(F.explode(days).alias("origin"))


def anchors(panel: DataFrame, days: DataFrame) -> DataFrame:
    """BT2: series with a (filled) price at an origin: the anchor, the mean of the last 7 known prices and those prices."""
    known = panel.where("price_index IS NOT NULL")
    last = F.collect_list("price_index").over(by_series().rowsBetween(-6, 0))
    rows = known.withColumn("last_prices", last).join(F.broadcast(days), F.col("report_date") == F.col("origin"))  # a row per origin day
    total = F.aggregate("last_prices", F.lit(0.0), lambda a, x: a + x)
    return rows.select("series", "product_category", "product_name", "origin", F.col("price_index").alias("anchor"), (total / F.size("last_prices")).alias("moving_average7"), "last_prices")


def anchors_of_prices(prices: DataFrame, days: DataFrame) -> DataFrame:
    """BT2: ``anchors`` of the panel of ``prices``, whose days are not made.

    A run of days with a price has at least one, so the last 7 known prices lie in the run that holds the
    origin and the 6 before it.
    """
    back = F.collect_list(F.struct("price_index", (F.datediff("last_day", "first_day") + 1).alias("n"))).over(Window.partitionBy("series").orderBy("first_day").rowsBetween(-6, -1))
    rows = known_runs(prices).withColumn("back", back).join(F.broadcast(days), F.col("origin").between(F.col("first_day"), F.col("last_day")))  # a row per origin day
    earlier = F.flatten(F.transform("back", lambda x: F.array_repeat(x["price_index"], x["n"])))
    rows = rows.withColumn("upto", F.concat(earlier, F.array_repeat("price_index", F.datediff("origin", "first_day") + 1)))
    rows = rows.withColumn("last_prices", F.slice("upto", F.greatest(F.size("upto") - 6, F.lit(1)), 7)).withColumns(series_names())
    total = F.aggregate("last_prices", F.lit(0.0), lambda a, x: a + x)
    return rows.select("series", "product_category", "product_name", "origin", F.col("price_index").alias("anchor"), (total / F.size("last_prices")).alias("moving_average7"), "last_prices")


def folded_paths(anchored: DataFrame, prices: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """BT3: the anchors with ``truth``, the days of the path as (horizon, actual), null where not observed: a row per series and origin.

    ``prices``: the panel, or the prices that it was made of. Only what was observed is shuffled, and days
    without truth are made after the join. The truth grows with the series but packs so well that it may be
    judged small enough to broadcast, so a merge join is asked for.
    """
    each = F.sequence(F.lit(1), F.lit(horizon))
    days = anchored.select("origin").distinct().select("origin", F.explode(each).alias("horizon")).withColumn("date", F.date_add("origin", F.col("horizon")))
    seen = prices.where("observed_price IS NOT NULL").select("series", F.col("report_date").alias("date"), F.col("observed_price").alias("actual"))
    dealt = seen.join(F.broadcast(days), "date").select("series", "origin", "horizon", "actual").repartition("series", "origin")  # a row per origin and horizon
    truth = dealt.groupBy("series", "origin").agg(F.collect_list(F.struct("horizon", "actual")).alias("truth"))
    known = F.coalesce("truth", F.array().cast("array<struct<horizon:int,actual:double>>"))
    unseen = F.transform(F.array_except(each, known["horizon"]), lambda h: F.struct(h.alias("horizon"), F.lit(None).cast("double").alias("actual")))
    return anchored.join(truth.hint("merge"), ["series", "origin"], "left").withColumn("truth", F.concat(known, unseen))


def unfolded(folded: DataFrame) -> DataFrame:
    """BT3: persistence, mean-7 and seasonal-7 paths with the truth, a row per day of ``folded_paths``."""
    rows = folded.select("*", F.inline("truth")).drop("truth")
    seasonal = F.element_at("last_prices", ((F.col("horizon") - 1) % F.size("last_prices") + 1).cast("int"))
    return rows.withColumns({"date": F.date_add("origin", F.col("horizon")), "persistence": F.col("anchor"), "seasonal7": seasonal}).drop("last_prices")


def paths(anchored: DataFrame, prices: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """BT3: ``folded_paths`` unfolded at once."""
    return unfolded(folded_paths(anchored, prices, horizon))


def persistence_paths(panel: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """BT4: each series' last known price for the days after its last day."""
    last = panel.groupBy("series").agg(F.max("report_date").alias("origin"), F.max_by("price_index", F.when(F.col("price_index").isNotNull(), F.col("report_date"))).alias("price"))
    return last.where("price IS NOT NULL").select("series", "origin", "price", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon")).withColumn("date", F.date_add("origin", F.col("horizon")))


@dataclass
class Linear:
    coefficients: list[float]
    intercept: float


def fit_relative(rows: DataFrame, columns: list[str], target: str = "target", ridge: float = 0.001) -> Linear:
    """BT5: a pooled linear model of the one-day relative return: ridge on standardised columns and target.

    One aggregation gives all covariances; the small system is solved from that one row. A column
    without spread gets no weight; rows with a null are left out.
    """
    known = rows.dropna(subset=[*columns, target])
    pairs = [(a, b) for i, a in enumerate(columns) for b in [*columns[i + 1 :], target]]
    sums = known.agg(
        *[F.avg(c).alias(f"m_{c}") for c in [*columns, target]], *[F.stddev_pop(c).alias(f"s_{c}") for c in [*columns, target]], *[F.covar_pop(a, b).alias(f"r_{a}_{b}") for a, b in pairs]
    ).first()
    kept = [c for c in columns if sums[f"s_{c}"]]
    if not kept or not sums[f"s_{target}"]:
        return Linear([0.0] * len(columns), float(sums[f"m_{target}"] or 0.0))
    known_pairs = {frozenset(p): sums[f"r_{p[0]}_{p[1]}"] / (sums[f"s_{p[0]}"] * sums[f"s_{p[1]}"]) for p in pairs if p[0] in kept and (p[1] in kept or p[1] == target)}
    r = lambda a, b: 1 + ridge if a == b else known_pairs[frozenset((a, b))]
    beta = np.linalg.solve(np.array([[r(a, b) for b in kept] for a in kept]), np.array([r(a, target) for a in kept]))
    own = dict(zip(kept, (float(x) * sums[f"s_{target}"] / sums[f"s_{c}"] for x, c in zip(beta, kept, strict=True)), strict=True))
    weights = [own.get(c, 0.0) for c in columns]
    return Linear(weights, float(sums[f"m_{target}"] - sum(w * sums[f"m_{c}"] for w, c in zip(weights, columns, strict=True))))


def recursive_paths(history: DataFrame, weights: dict[str, float], intercept: float = 0.0, horizon: int = HORIZON) -> DataFrame:
    """BT6: recursive paths of all series of an (origin, category), one day at a time.

    ``history``: ``origin, product_category, series, last_prices`` (array, oldest first). Each day's
    relative change is linear in the series' last change, its gap to the mean of its last 7 prices and
    the category's median change of the day before (a missing one counts as 0); all series of a
    category move together because of the last. The task of a category and origin holds a matrix of 8
    prices per series; a day is a few operations on it.
    """
    own, gap, peer = (weights.get(k, 0.0) for k in ("own", "gap", "peer"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        last = np.full((len(rows), 8), np.nan)
        for i, prices in enumerate(rows["last_prices"]):
            tail = np.asarray(prices, dtype=float)[-8:]
            last[i, 8 - len(tail) :] = tail
        out = np.empty((len(rows), horizon))
        for h in range(horizon):
            change = np.where(np.isnan(last[:, 6]), 0.0, last[:, 7] / last[:, 6] - 1)
            move = intercept + own * change + gap * (last[:, 7] / np.nanmean(last[:, 1:], axis=1) - 1) + peer * np.median(change)
            out[:, h] = np.maximum(0.01, last[:, 7] * (1 + move))
            last = np.column_stack([last[:, 1:], out[:, h]])
        return pd.DataFrame({
            "origin": rows["origin"].iloc[0], "product_category": rows["product_category"].iloc[0], "series": np.repeat(rows["series"].to_numpy(), horizon),
            "horizon": np.tile(np.arange(1, horizon + 1), len(rows)), "price": out.ravel(),
        })

    kind = "origin date, product_category string, series string, horizon int, price double"
    return history.select("origin", "product_category", "series", "last_prices").groupBy("origin", "product_category").applyInPandas(one, kind)


def parity(a: DataFrame, b: DataFrame, key: list[str], values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """BT7: rows of both sides, rows that only one has, values that differ by more than the tolerance, the largest difference.

    A null equals a null alone.
    """
    both = a.select(*key, F.struct(*values).alias("a")).join(b.select(*key, F.struct(*values).alias("b")), key, "full")
    off = [F.abs(F.col(f"a.{v}") - F.col(f"b.{v}")) for v in values]
    torn = [F.col(f"a.{v}").isNull() != F.col(f"b.{v}").isNull() for v in values]
    there = F.col("a").isNotNull() & F.col("b").isNotNull()
    apart = F.lit(False)
    for far, one in zip(off, torn, strict=True):
        apart = apart | one | F.coalesce(far > tolerance, F.lit(False))
    return both.agg(
        F.count("a").alias("batch"), F.count("b").alias("incremental"), F.count_if(~there).alias("unmatched"), F.count_if(there & apart).alias("differing"),
        F.coalesce(F.max(F.greatest(*off) if len(off) > 1 else off[0]), F.lit(0.0)).alias("largest"),
    )


def stacking_design(rows: DataFrame, forecasters: list[str], categories: list[str]) -> DataFrame:
    """BT8: returns of each forecaster on the anchor, their disagreement, horizon and category indicators."""
    returns: dict[str, Column] = {f"r_{f}": F.col(f) / F.col("anchor") - 1 for f in forecasters}
    out = rows.withColumns(returns)
    names = list(returns)
    spread = F.greatest(*names) - F.least(*names) if len(names) > 1 else F.lit(0.0)
    return out.withColumns({"disagreement": spread, "h": F.col("horizon") / HORIZON, "y": F.col("actual") / F.col("anchor") - 1} | {f"is_{c.lower()}": (F.col("product_category") == c).cast("int") for c in categories})


def fit_weighted(rows: DataFrame, columns: list[str], target: str, weight: str, keys: list[str], ridge: float = 0.001) -> DataFrame:
    """BT8: weighted ridge regressions by ``keys``: ``keys, n, weights`` (an array in the order of ``columns``) and ``intercept``.

    Two aggregations give the sufficient statistics: weighted means, then weighted products of what is
    left of them (so that large means cost no digits). A small system is solved per key, in the task
    that holds the key's one row. The ridge is relative to each column's own spread; a column without
    spread gets no weight, rows with a null or without weight are left out.
    """
    known = rows.dropna(subset=[*columns, target, weight]).where(F.col(weight) > 0)
    mean = lambda c: (F.sum(F.col(weight) * F.col(c)) / F.sum(weight)).alias(f"m_{c}")
    means = known.groupBy(*keys).agg(*[mean(c) for c in [*columns, target]])
    pairs = [(a, b) for i, a in enumerate(columns) for b in [*columns[i:], target]]
    product = lambda a, b: F.sum(F.col(weight) * (F.col(a) - F.col(f"m_{a}")) * (F.col(b) - F.col(f"m_{b}"))) / F.sum(weight)
    sums = known.join(means, keys).groupBy(*keys, *[f"m_{c}" for c in [*columns, target]]).agg(F.count("*").alias("n"), *[product(a, b).alias(f"p_{a}_{b}") for a, b in pairs])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                kept = [c for c in columns if row[f"p_{c}_{c}"] > 1e-20 * row[f"m_{c}"] ** 2]  # more than rounding
                of = lambda a, b, row=row: row[f"p_{a}_{b}"] if (a, b) in pairs else row[f"p_{b}_{a}"]
                found = dict.fromkeys(columns, 0.0)
                if kept:
                    system = np.array([[of(a, b) * (1 + ridge * (a == b)) for b in kept] for a in kept])
                    found |= dict(zip(kept, np.linalg.solve(system, np.array([of(a, target) for a in kept])).tolist(), strict=True))
                weights = [found[c] for c in columns]
                out.append([*[row[k] for k in keys], row["n"], weights, row[f"m_{target}"] - sum(w * row[f"m_{c}"] for w, c in zip(weights, columns, strict=True))])
            yield pd.DataFrame(out, columns=[*keys, "n", "weights", "intercept"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(solve, f"{kinds}, n long, weights array<double>, intercept double")


def stacked_prices(rows: DataFrame, fit: DataFrame, columns: list[str], keys: list[str], limit: float = 0.5) -> DataFrame:
    """BT8: the anchor moved by the fitted return, which is held within ``limit`` either way; keys without a fit stay at their anchor."""
    value = sum((F.col("__w")[k] * F.col(c) for k, c in enumerate(columns)), F.col("__i"))
    out = rows.join(fit.select(*keys, F.col("weights").alias("__w"), F.col("intercept").alias("__i")), keys, "left")
    move = F.greatest(F.lit(-limit), F.least(F.lit(limit), F.coalesce(value, F.lit(0.0))))
    return out.withColumn("price", F.col("anchor") * (1 + move)).drop("__w", "__i")
