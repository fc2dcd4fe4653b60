"""Features of the daily panel. Price windows end on the day before the row, so no row sees its own price."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .panel import FILL_DAYS, by_series, fill

LAGS = (1, 2, 3, 7, 8, 14, 30)
WINDOWS = (3, 7, 14, 30)
#: Fixed holidays as (month, day): the days near them count as holiday season (fixed values).
HOLIDAYS = ((1, 1), (2, 14), (2, 25), (4, 9), (5, 1), (6, 12), (8, 21), (11, 1), (11, 30), (12, 25))


def before(days: int) -> Window:
    return by_series().rowsBetween(-days, -1)


def calendar(rows: DataFrame, day: str = "report_date") -> DataFrame:
    """FE1: 21 calendar features."""
    d = F.col(day)
    cycle = lambda value, period, f: f(2 * math.pi * value / period)
    month, dow, doy = F.month(d), F.weekday(d), F.dayofyear(d)
    return rows.withColumns({
        "day_of_week": dow, "day_of_month": F.dayofmonth(d), "day_of_year": doy, "week_of_year": F.weekofyear(d), "month": month, "quarter": F.quarter(d), "year": F.year(d),
        "is_weekend": (dow >= 5).cast("int"), "is_month_start": (F.dayofmonth(d) == 1).cast("int"), "is_month_end": (d == F.last_day(d)).cast("int"),
        "month_sin": cycle(month, 12, F.sin), "month_cos": cycle(month, 12, F.cos), "dow_sin": cycle(dow, 7, F.sin), "dow_cos": cycle(dow, 7, F.cos),
        "doy_sin": cycle(doy, 365, F.sin), "doy_cos": cycle(doy, 365, F.cos),
        "is_wet_season": month.between(6, 11).cast("int"), "is_christmas": (month >= 11).cast("int"), "days_since_epoch": F.datediff(d, F.lit("2000-01-01").cast("date")),
        "is_payday": payday(d).cast("int"), "near_holiday": near_holiday(d).cast("int"),
    })


def payday(d: Column) -> Column:
    """FE2"""
    return F.dayofmonth(d).between(13, 17) | (F.dayofmonth(d) >= 28) | (F.dayofmonth(d) <= 2)


def near_holiday(d: Column) -> Column:
    """FE2: within 3 days, round the year's end, of a fixed holiday; or between 25 March and 5 April."""
    import datetime

    days = F.array(*[F.lit(datetime.date(2001, m, k).timetuple().tm_yday) for m, k in HOLIDAYS])
    near = F.exists(days, lambda h: F.least(F.abs(F.dayofyear(d) - h), 365 - F.abs(F.dayofyear(d) - h)) <= 3)
    md = F.month(d) * 100 + F.dayofmonth(d)
    return near | md.between(325, 405)


def price_windows(panel: DataFrame) -> DataFrame:
    """FE3-FE8: lags, rolling statistics, volatility, returns, Bollinger position, expanding mean; one sort by series."""
    p = F.col("price_index")
    cols: dict[str, Column] = {f"lag_{k}": F.lag(p, k).over(by_series()) for k in LAGS}
    for w in WINDOWS:
        cols |= {f"mean_{w}": F.avg(p).over(before(w)), f"std_{w}": F.stddev_samp(p).over(before(w)), f"min_{w}": F.min(p).over(before(w)), f"max_{w}": F.max(p).over(before(w))}
    cols["n_14"] = F.count(p).over(before(14))
    cols["lag_9"] = F.lag(p, 9).over(by_series())
    cols["expanding_mean"] = F.avg(p).over(by_series().rowsBetween(Window.unboundedPreceding, -1))
    out = panel.withColumns(cols)
    change = lambda a, b: F.when(F.col(a).isNull(), None).when(F.col(b).isNull() | (F.col(b) == 0), 0.0).otherwise((F.col(a) - F.col(b)) / F.col(b))
    out = out.withColumns({
        "volatility_14": F.when((F.col("n_14") >= 2) & (F.col("mean_14") != 0), F.col("std_14") / F.col("mean_14")),
        "return_1": change("lag_1", "lag_2"), "return_7": change("lag_1", "lag_8"), "return_1_before": change("lag_2", "lag_3"),
        "bollinger": F.when(F.col("lag_1").isNull(), None).when(F.coalesce(F.col("std_14"), F.lit(0.0)) == 0, 0.0).otherwise((F.col("lag_1") - F.col("mean_14")) / (2 * F.col("std_14"))),
        "from_expanding_mean": F.when(F.col("expanding_mean") != 0, (F.col("lag_1") - F.col("expanding_mean")) / F.col("expanding_mean")),
    })
    return out.withColumn("acceleration", F.col("return_1") - F.col("return_1_before")).drop("n_14", "lag_9", "return_1_before")


def rolled(prices: np.ndarray, windows: tuple[int, ...] = WINDOWS) -> dict[str, np.ndarray]:
    """Mean, deviation, least and largest of the up to ``w`` prices before each of a series in order; NaN where there is none (of a deviation: one)."""
    known = ~np.isnan(prices)
    values, least, largest = (np.where(known, prices, x) for x in (0.0, np.inf, -np.inf))
    total, n, low, high = np.zeros(len(prices)), np.zeros(len(prices), dtype=np.int64), np.full(len(prices), np.inf), np.full(len(prices), -np.inf)
    out = {}
    for lag in range(1, max(windows) + 1):
        seen = slice(0, max(len(prices) - lag, 0))
        total[lag:] += values[seen]
        n[lag:] += known[seen]
        low[lag:], high[lag:] = np.minimum(low[lag:], least[seen]), np.maximum(high[lag:], largest[seen])
        if lag in windows:
            mean, squares = total / np.maximum(n, 1), np.zeros(len(prices))
            for back in range(1, lag + 1):
                seen = slice(0, max(len(prices) - back, 0))
                squares[back:] += known[seen] * (values[seen] - mean[back:]) ** 2
            found = {"mean": (mean, 1), "std": (np.sqrt(squares / np.maximum(n - 1, 1)), 2), "min": (low, 1), "max": (high, 1)}
            out |= {f"{name}_{lag}": np.where(n < least_n, np.nan, v) for name, (v, least_n) in found.items()}
    return out


def rolling(panel: DataFrame) -> DataFrame:
    """FE4: ``series, report_date`` and the rolling statistics of ``price_windows`` alone; per series in numpy, since Spark's sliding frames visit every price of a frame again for each row."""
    names = [f"{n}_{w}" for w in WINDOWS for n in ("mean", "std", "min", "max")]

    def one(rows: pa.Table) -> pa.Table:
        days = rows.column("report_date").cast(pa.int32()).to_numpy()
        order = np.argsort(days, kind="stable")
        found = rolled(rows.column("price_index").to_numpy().astype(float)[order])
        kept = {"series": rows.column("series"), "report_date": pa.array(days[order], pa.int32()).cast(pa.date32())}
        return pa.table(kept | {c: pa.array(found[c], pa.float64(), from_pandas=True) for c in names})

    return panel.select("series", "report_date", "price_index").groupBy("series").applyInArrow(one, "series string, report_date date, " + ", ".join(f"{c} double" for c in names))


def rsi(panel: DataFrame, days: int = 14) -> DataFrame:
    """FE9: simple means of gains and losses of the shifted price over up to ``days`` rows; a missing change counts as 0."""
    delta = F.lag("price_index", 1).over(by_series()) - F.lag("price_index", 2).over(by_series())
    out = panel.withColumn("__d", delta)
    frame = by_series().rowsBetween(-days + 1, 0)
    gain, loss = F.avg(F.greatest(F.coalesce("__d", F.lit(0.0)), F.lit(0.0))).over(frame), F.avg(F.greatest(-F.coalesce("__d", F.lit(0.0)), F.lit(0.0))).over(frame)
    return out.withColumn("rsi", 100 - 100 / (1 + gain / (loss + 1e-6))).drop("__d")


def ema(values: pd.Series, span: int) -> pd.Series:
    return values.ewm(span=span, adjust=False).mean()


def macd(panel: DataFrame) -> DataFrame:
    """FE10: ``series, report_date, macd, macd_signal``. Recursive, so per series in pandas; only key, day and price are sent."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("report_date")
        shifted = rows["price_index"].astype(float).shift(1)
        line = ema(shifted, 12) - ema(shifted, 26)
        return pd.DataFrame({"series": rows["series"], "report_date": rows["report_date"], "macd": line, "macd_signal": ema(line, 9)})

    out = panel.select("series", "report_date", "price_index").groupBy("series").applyInPandas(one, "series string, report_date date, macd double, macd_signal double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("macd", "macd_signal")})


def peer_returns(panel: DataFrame) -> DataFrame:
    """FE11: the category's median daily change, per category and day, and its lag, weekly mean and deviation."""
    change = (F.col("price_index") - F.lag("price_index").over(by_series())) / F.lag("price_index").over(by_series())
    median = panel.select("product_category", "report_date", change.alias("r")).groupBy("product_category", "report_date").agg(F.percentile("r", F.lit(0.5)).alias("m"))
    by = Window.partitionBy("product_category").orderBy("report_date")
    week = by.rowsBetween(-7, -1)
    return median.select(
        "product_category", "report_date", F.coalesce(F.lag("m").over(by), F.lit(0.0)).alias("peer_lag_1"), F.coalesce(F.avg("m").over(week), F.lit(0.0)).alias("peer_mean_7"),
        F.coalesce(F.when(F.count("m").over(week) >= 2, F.stddev_pop("m").over(week)), F.lit(0.0)).alias("peer_std_7"),
    )


def encode_labels(rows: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """FE12: places of sorted distinct training values; unseen values get the next number."""
    seen = train.select(column).distinct()
    codes = seen.select(column, (F.row_number().over(Window.orderBy(column)) - 1).alias(f"{column}_id"))  # a row per category value
    n = seen.agg(F.count("*").alias("__n"))
    return rows.join(codes, column, "left").join(F.broadcast(n)).withColumn(f"{column}_id", F.coalesce(f"{column}_id", F.col("__n"))).drop("__n")


def observation_history(panel: DataFrame) -> DataFrame:
    """FE13, FE14: counts, age and slopes of true observations before the row; filled rows never count."""
    seen = F.when(F.col("is_observed"), F.col("report_date"))
    day = F.datediff("report_date", F.lit("1970-01-01").cast("date")).cast("double")
    slope = lambda w: F.when(F.count("observed_price").over(before(w)) >= 2, F.expr("regr_slope(observed_price, __day)").over(before(w)))
    out = panel.withColumn("__day", F.when(F.col("is_observed"), day))
    return out.withColumns({
        "observed_7": F.count("observed_price").over(before(7)), "observed_30": F.count("observed_price").over(before(30)),
        "observed_age": F.datediff("report_date", F.last(seen, ignorenulls=True).over(by_series().rowsBetween(Window.unboundedPreceding, -1))),
        "slope_7": slope(7), "slope_14": slope(14),
    }).drop("__day")


def usable(rows: DataFrame, columns: list[str]) -> DataFrame:
    """FE15: rows with an observed price and all features there."""
    ok = F.col("is_observed") & F.col("price_index").isNotNull()
    for c in columns:
        ok &= F.col(c).isNotNull()
    return rows.withColumn("usable", F.coalesce(ok, F.lit(False)))


def relative_target(price: Column, anchor: Column) -> Column:
    """FE16"""
    return F.try_divide(price, anchor) - 1


def from_relative(value: Column, anchor: Column) -> Column:
    """FE16, inverse; a price is at least 0.01."""
    return F.greatest(F.lit(0.01), anchor * (1 + value))


def sequences(panel: DataFrame, columns: list[str], start: str, end: str, length: int = 30, horizon: int = 30, stride: int = 7) -> DataFrame:
    """FE17: per series and row of [start, end], every ``stride`` days: the features of the last ``length`` rows and the next returns.

    ``inputs``: array of arrays; ``targets``: returns on the price before the row, null where not
    observed or outside the range. Rows without a full window or any target are left out.
    """
    back, ahead = by_series().rowsBetween(-length + 1, 0), by_series().rowsBetween(0, horizon - 1)
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    out = panel.withColumns({
        "anchor": F.lag("price_index").over(by_series()), "__x": F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(back),
        "__y": F.collect_list(F.struct("report_date", "observed_price")).over(ahead),
    }).where(F.col("report_date").between(lo, hi) & (F.datediff("report_date", lo) % stride == 0) & (F.size("__x") == length) & (F.col("anchor") > 0))
    target = F.transform("__y", lambda y: F.when(y["report_date"] <= hi, y["observed_price"] / F.col("anchor") - 1))
    return out.select("series", "report_date", "anchor", F.col("__x").alias("inputs"), target.alias("targets")).where(F.exists("targets", lambda t: t.isNotNull()))


def multi_horizon(panel: DataFrame, horizon: int = 30, stride: int = 30, start: str = "1998-01-01", longest: int = 30) -> DataFrame:
    """FE19: a training row per (series, origin, horizon) whose target day was observed.

    Features of the origin, all relative to its price: lags and returns of 1, 7 and 14 days; mean,
    standard deviation, median, least, largest and slope of the last 7, 14 and 30 days; the yearly cycle
    of origin and target day; functions of the horizon. Every panel row is dealt to the origins whose
    ``longest`` days it belongs to (one, where ``stride`` is at least that), and one aggregation by series
    and origin gives all of them, without frames over rows that are no origin. The panel has a row a day.
    """
    first = F.lit(start).cast("date")
    ahead = F.datediff("report_date", first)
    # the first origin on or after the row, and later ones within reach
    next_ = F.greatest(F.lit(0), F.ceil(ahead / stride)).cast("int")
    reach = F.floor((ahead + longest - 1) / stride).cast("int")
    dealt = panel.where(reach >= next_).select("series", "report_date", F.col("price_index").alias("p"), F.explode(F.sequence(next_, reach)).alias("k"))
    dealt = dealt.withColumn("origin", F.date_add(first, F.col("k") * stride)).withColumn("age", F.datediff("origin", "report_date"))
    at = lambda k: F.max(F.when(F.col("age") == k, F.col("p")))
    sums = [at(0).alias("anchor"), *[at(k).alias(f"p_{k}") for k in (1, 7, 14)]]
    for w in (7, 14, 30):
        inside = F.when(F.col("age") < w, F.col("p"))
        sums += [
            F.avg(inside).alias(f"mean_{w}"), F.stddev_pop(inside).alias(f"std_{w}"), F.percentile(inside, F.lit(0.5)).alias(f"median_{w}"), F.min(inside).alias(f"min_{w}"),
            F.max(inside).alias(f"max_{w}"), F.regr_slope(inside, -F.col("age").cast("double")).alias(f"slope_{w}"),
        ]
    origins = dealt.groupBy("series", "origin").agg(*sums).where("anchor IS NOT NULL")
    scaled = [F.col(c) / F.col("anchor") for w in (7, 14, 30) for c in (f"mean_{w}", f"std_{w}", f"median_{w}", f"min_{w}", f"max_{w}", f"slope_{w}")]
    names = [f"x_{c}_{w}" for w in (7, 14, 30) for c in ("mean", "std", "median", "min", "max", "slope")]
    lags = [(F.col(f"p_{k}") / F.col("anchor")).alias(f"x_lag_{k}") for k in (1, 7, 14)] + [(F.try_divide(F.col("anchor"), F.col(f"p_{k}")) - 1).alias(f"x_return_{k}") for k in (1, 7, 14)]
    rows = origins.select("series", "origin", "anchor", *lags, *[c.alias(n) for c, n in zip(scaled, names, strict=True)], F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon"))
    rows = rows.withColumn("target_date", F.date_add("origin", F.col("horizon")))
    truth = panel.where("observed_price IS NOT NULL").select("series", F.col("report_date").alias("target_date"), "observed_price")
    turn = lambda day: 2 * math.pi * F.dayofyear(day) / 365
    return rows.join(truth, ["series", "target_date"]).withColumns({
        "y": F.col("observed_price") / F.col("anchor") - 1, "h_sqrt": F.sqrt("horizon"), "h_log": F.log1p("horizon"), "origin_sin": F.sin(turn("origin")), "origin_cos": F.cos(turn("origin")),
        "target_sin": F.sin(turn("target_date")), "target_cos": F.cos(turn("target_date")),
    }).drop("observed_price")


#: Features of a day that the prices of the month before it decide.
REPLAYED = [*[f"lag_{k}" for k in LAGS], *[f"{n}_{w}" for w in WINDOWS for n in ("mean", "std", "min", "max")], "volatility_14", "return_1", "return_7", "acceleration"]


def replayed(versions: DataFrame, origins: DataFrame) -> DataFrame:
    """FE18: ``series, origin`` and the ``REPLAYED`` features of the day after each origin, from what was known on the origin's day.

    ``versions``: ``series, report_date, available_on, observed_price``, several versions of a day allowed; of
    those available by the origin the newest counts (ties: the least price). Only the days within reach
    of a feature are dealt to an origin, so an origin costs a month of rows and not the history. A series
    that was not seen within that reach has no row.
    """
    reach = max(*LAGS, *WINDOWS) + FILL_DAYS
    days = F.sequence(F.col("report_date"), F.date_add("report_date", reach))
    own = origins.select("origin")
    dealt = versions.select("series", "report_date", "available_on", "observed_price", F.explode(days).alias("origin")).join(F.broadcast(own), "origin")  # a row per origin day
    seen = dealt.where(F.col("available_on") <= F.col("origin")).groupBy("series", "origin", "report_date")
    newest = seen.agg(F.max_by("observed_price", F.struct("available_on", -F.col("observed_price"))).alias("observed_price"))
    # each origin's view of a series is a series of its own, which ends with the day after the origin
    after = newest.select("series", "origin").distinct().withColumns({"report_date": F.date_add("origin", 1), "observed_price": F.lit(None).cast("double")})
    views = newest.unionByName(after.select(*newest.columns)).withColumn("name", F.col("series")).withColumn("series", F.concat_ws("@", "series", "origin"))
    spans = views.groupBy("series").agg(F.min("report_date").alias("lo"), F.max("report_date").alias("hi"), F.first("name").alias("name"), F.first("origin").alias("origin"))
    dense = spans.select("series", "name", "origin", F.explode(F.sequence("lo", "hi")).alias("report_date")).join(views.select("series", "report_date", "observed_price"), ["series", "report_date"], "left")
    out = price_windows(dense.withColumn("price_index", fill()))
    return out.where(F.col("report_date") > F.col("origin")).select(F.col("name").alias("series"), "origin", *REPLAYED)


def leaks(replay: DataFrame, once: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """FE18: per origin the rows that both have, those of one alone, and those of which some feature differs: it saw what came later."""
    both = replay.select("series", "origin", F.struct(*REPLAYED).alias("a")).join(once.select("series", "origin", F.struct(*REPLAYED).alias("b")), ["series", "origin"], "full")
    apart = F.lit(False)
    for c in REPLAYED:
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        apart = apart | (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > tolerance, F.lit(False))
    there = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.groupBy("origin").agg(F.count_if(there).alias("compared"), F.count_if(~there).alias("unmatched"), F.count_if(there & apart).alias("differing"))
