"""FE queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricepanel.operators import features, panel

from .base import PANEL, daily_panel, query, r6, with_sql
from .cleaning import SPLIT

W = "OVER (PARTITION BY series ORDER BY report_date ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
S = "OVER (PARTITION BY series ORDER BY report_date)"
PI = "2 * pi()"

FE1_SQL = f"""SELECT DISTINCT report_date, isodow(report_date) - 1 AS day_of_week, day(report_date) AS day_of_month, dayofyear(report_date) AS day_of_year,
  weekofyear(report_date) AS week_of_year,
month(report_date) AS month, quarter(report_date) AS quarter, year(report_date) AS year, CAST(isodow(report_date) >= 6 AS INT) AS is_weekend,
  CAST(day(report_date) = 1 AS INT) AS is_month_start,
CAST(report_date = last_day(report_date) AS INT) AS is_month_end, round(sin({PI} * month(report_date) / 12), 6) AS month_sin,
  round(cos({PI} * month(report_date) / 12), 6) AS month_cos,
round(sin({PI} * (isodow(report_date) - 1) / 7), 6) AS dow_sin, round(cos({PI} * (isodow(report_date) - 1) / 7), 6) AS dow_cos,
round(sin({PI} * dayofyear(report_date) / 365), 6) AS doy_sin, round(cos({PI} * dayofyear(report_date) / 365), 6) AS doy_cos,
CAST(month(report_date) BETWEEN 6 AND 11 AS INT) AS is_wet_season, CAST(month(report_date) >= 11 AS INT) AS is_christmas,
  report_date - DATE '2000-01-01' AS days_since_epoch FROM panel"""
FE2_SQL = """, h AS (SELECT unnest([1, 45, 56, 99, 121, 163, 233, 305, 334, 359]) AS hd), d AS (SELECT DISTINCT report_date FROM panel)
SELECT report_date, CAST(day(report_date) BETWEEN 13 AND 17 OR day(report_date) >= 28 OR day(report_date) <= 2 AS INT) AS is_payday,
CAST(min(least(abs(dayofyear(report_date) - hd), 365 - abs(dayofyear(report_date) - hd))) <= 3
  OR month(report_date) * 100 + day(report_date) BETWEEN 325 AND 405 AS INT) AS near_holiday FROM d, h GROUP BY report_date"""


@query("fe1_calendar", with_sql(PANEL, FE1_SQL))
def fe1(spark, sf):
    days = features.calendar(daily_panel(spark, sf).select("report_date").distinct()).drop("is_payday", "near_holiday")
    return days.withColumns({c: r6(c) for c in days.columns if c.endswith(("_sin", "_cos"))})


@query("fe2_special_days", with_sql(PANEL, FE2_SQL))
def fe2(spark, sf):
    return features.calendar(daily_panel(spark, sf).select("report_date").distinct()).select("report_date", "is_payday", "near_holiday")


LAGGED = "SELECT series, report_date, " + ", ".join(f"round(lag(price_index, {k}) {S}, 6) AS lag_{k}" for k in features.LAGS) + " FROM panel"
# Means of prices with few decimals are often exact halves; a nudge keeps the engines from rounding those apart.
ROLLED = "SELECT series, report_date, " + ", ".join(f"round({f}(price_index) {W.format(w)} + 3e-8, 6) AS {n}_{w}" for w in features.WINDOWS for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))) + " FROM panel"
RETURNS = f"""
, l AS (SELECT series, report_date, price_index, lag(price_index, 1) {S} AS l1, lag(price_index, 2) {S} AS l2, lag(price_index, 3) {S} AS l3,
  lag(price_index, 8) {S} AS l8,
  avg(price_index) {W.format(14)} AS m, stddev_samp(price_index) {W.format(14)} AS s, count(price_index) {W.format(14)} AS n,
  avg(price_index) {W.format('UNBOUNDED')} AS e FROM panel),
r AS (SELECT *, CASE WHEN l1 IS NULL THEN NULL WHEN l2 IS NULL OR l2 = 0 THEN 0.0 ELSE (l1 - l2) / l2 END AS r1, CASE WHEN l1 IS NULL THEN NULL
  WHEN l8 IS NULL OR l8 = 0 THEN 0.0 ELSE (l1 - l8) / l8 END AS r7,
  CASE WHEN l2 IS NULL THEN NULL WHEN l3 IS NULL OR l3 = 0 THEN 0.0 ELSE (l2 - l3) / l3 END AS r1b FROM l)
"""


@query("fe3_lags", with_sql(PANEL, LAGGED))
def fe3(spark, sf):
    out = features.price_windows(daily_panel(spark, sf))
    return out.select("series", "report_date", *[r6(f"lag_{k}").alias(f"lag_{k}") for k in features.LAGS])


@query("fe4_rolling", with_sql(PANEL, ROLLED))
def fe4(spark, sf):
    out = features.price_windows(daily_panel(spark, sf))
    return out.select("series", "report_date", *[r6(F.col(f"{n}_{w}") + 3e-8).alias(f"{n}_{w}") for w in features.WINDOWS for n in ("mean", "std", "min", "max")])


@query("fe5_volatility", with_sql(PANEL, RETURNS + "SELECT series, report_date, round(CASE WHEN n >= 2 AND m <> 0 THEN s / m END, 6) AS volatility_14 FROM r"))
def fe5(spark, sf):
    return features.price_windows(daily_panel(spark, sf)).select("series", "report_date", r6("volatility_14").alias("volatility_14"))


@query("fe6_returns", with_sql(PANEL, RETURNS + """SELECT series, report_date, round(r1, 6) AS return_1, round(r7, 6) AS return_7, round(r1 - r1b, 6) AS acceleration FROM r"""))
def fe6(spark, sf):
    return features.price_windows(daily_panel(spark, sf)).select("series", "report_date", *[r6(c).alias(c) for c in ("return_1", "return_7", "acceleration")])


@query("fe7_bollinger", with_sql(PANEL, RETURNS + """SELECT series, report_date, round(CASE WHEN l1 IS NULL THEN NULL WHEN coalesce(s, 0) < 1e-9 THEN 0.0 ELSE (l1 - m) / (2 * s) END, 4) AS bollinger
  FROM r WHERE coalesce(s, 1) > 1e-6"""))
def fe7(spark, sf):
    return features.price_windows(daily_panel(spark, sf)).where("coalesce(std_14, 1) > 1e-6").select("series", "report_date", F.round("bollinger", 4).alias("bollinger"))


@query("fe8_expanding", with_sql(PANEL, RETURNS + """SELECT series, report_date, round(e + 3e-8, 6) AS expanding_mean, round(CASE WHEN e <> 0 THEN (l1 - e) / e END, 6) AS from_expanding_mean FROM r"""))
def fe8(spark, sf):
    return features.price_windows(daily_panel(spark, sf)).select("series", "report_date", r6(F.col("expanding_mean") + 3e-8).alias("expanding_mean"), r6("from_expanding_mean").alias("from_expanding_mean"))


@query("fe9_rsi", with_sql(PANEL, f""", d AS (SELECT series, report_date, lag(price_index, 1) {S} - lag(price_index, 2) {S} AS d FROM panel),
g AS (SELECT series, report_date, avg(greatest(coalesce(d, 0), 0)) OVER w AS g, avg(greatest(-coalesce(d, 0), 0)) OVER w AS l
  FROM d WINDOW w AS (PARTITION BY series ORDER BY report_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT series, report_date, round(100 - 100 / (1 + g / (l + 1e-6)), 3) AS rsi FROM g"""))
def fe9(spark, sf):
    return features.rsi(daily_panel(spark, sf)).select("series", "report_date", F.round("rsi", 3).alias("rsi"))


#: Exponential averages day by day; a missing price lets the weight of what is known decay.
EMA = PANEL + """,
pn AS MATERIALIZED (SELECT series, report_date, price_index AS x, row_number() OVER (PARTITION BY series ORDER BY report_date) AS n FROM panel),
ema AS (
  SELECT series, n, report_date, x AS f, 1.0::DOUBLE AS fw, x AS s, 1.0::DOUBLE AS sw, CASE WHEN x IS NOT NULL THEN 0.0::DOUBLE END AS g FROM pn WHERE n = 1
  UNION ALL
  SELECT series, n, report_date, f, fw, s, sw, CASE WHEN f IS NULL THEN NULL WHEN g0 IS NULL THEN f - s ELSE 0.8 * g0 + 0.2 * (f - s) END AS g FROM (
    SELECT p.series, p.n, p.report_date, CASE WHEN e.f IS NULL THEN p.x WHEN p.x IS NULL THEN e.f
  ELSE (e.fw * (1 - 2 / 13.0::DOUBLE) * e.f + 2 / 13.0::DOUBLE * p.x) / (e.fw * (1 - 2 / 13.0::DOUBLE) + 2 / 13.0::DOUBLE) END AS f,
      CASE WHEN e.f IS NOT NULL AND p.x IS NULL THEN e.fw * (1 - 2 / 13.0::DOUBLE) ELSE 1.0::DOUBLE END AS fw,
      CASE WHEN e.s IS NULL THEN p.x WHEN p.x IS NULL THEN e.s
  ELSE (e.sw * (1 - 2 / 27.0::DOUBLE) * e.s + 2 / 27.0::DOUBLE * p.x) / (e.sw * (1 - 2 / 27.0::DOUBLE) + 2 / 27.0::DOUBLE) END AS s,
      CASE WHEN e.s IS NOT NULL AND p.x IS NULL THEN e.sw * (1 - 2 / 27.0::DOUBLE) ELSE 1.0::DOUBLE END AS sw, e.g AS g0
    FROM ema e JOIN pn p ON p.series = e.series AND p.n = e.n + 1))
"""


def recursive_sql(prefix: str, select: str) -> str:
    return f"WITH RECURSIVE {prefix.strip()}\n{select.strip()}"


@query("fe10_macd", recursive_sql(EMA, """SELECT p.series, p.report_date, round(e.f - e.s + 1e-8, 6) AS macd, round(e.g + 1e-8, 6) AS macd_signal FROM pn p LEFT
  JOIN ema e ON e.series = p.series AND e.n = p.n - 1"""))
def fe10(spark, sf):
    return features.macd(daily_panel(spark, sf)).select("series", "report_date", r6(F.col("macd") + 1e-8).alias("macd"), r6(F.col("macd_signal") + 1e-8).alias("macd_signal"))


@query("fe11_peers", with_sql(PANEL, f""", c AS (SELECT product_category, report_date, (price_index - lag(price_index) {S}) / lag(price_index) {S} AS r FROM panel),
m AS (SELECT product_category, report_date, quantile_cont(r, 0.5) AS m FROM c GROUP BY ALL)
SELECT product_category, report_date, round(coalesce(lag(m) OVER o, 0), 6) AS peer_lag_1, round(coalesce(avg(m) OVER w, 0), 6) AS peer_mean_7,
  round(coalesce(CASE WHEN count(m) OVER w >= 2 THEN stddev_pop(m) OVER w END, 0), 6) AS peer_std_7
FROM m WINDOW o AS (PARTITION BY product_category ORDER BY report_date), w AS (PARTITION BY product_category
  ORDER BY report_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""))
def fe11(spark, sf):
    return features.peer_returns(daily_panel(spark, sf)).select("product_category", "report_date", *[r6(c).alias(c) for c in ("peer_lag_1", "peer_mean_7", "peer_std_7")])


@query("fe12_encoding", with_sql(SPLIT, """, t AS (SELECT DISTINCT product_name FROM splits WHERE split = 'train' AND product_category <> 'Fish'), e AS (SELECT product_name,
  row_number() OVER (ORDER BY product_name) - 1 AS i FROM t)
SELECT s.product_name, coalesce(e.i, (SELECT count(*) FROM t)) AS product_name_id, count(*) AS n FROM splits s LEFT JOIN e USING (product_name) GROUP BY ALL"""))
def fe12(spark, sf):
    rows = panel.split(daily_panel(spark, sf), 0.7, 0.85)
    out = features.encode_labels(rows.select("product_name"), rows.where("split = 'train' AND product_category <> 'Fish'"), "product_name")
    return out.groupBy("product_name", "product_name_id").agg(F.count("*").alias("n"))


HISTORY = f""", o AS (SELECT series, report_date, count(observed_price) {W.format(7)} AS observed_7, count(observed_price) {W.format(30)} AS observed_30,
report_date - last_value(CASE WHEN is_observed THEN report_date END IGNORE NULLS) {W.format('UNBOUNDED')} AS observed_age, count(observed_price) {W.format(14)} AS n14,
regr_slope(observed_price, CASE WHEN is_observed THEN report_date - DATE '1970-01-01' END) {W.format(7)} AS s7, regr_slope(observed_price, CASE
  WHEN is_observed THEN report_date - DATE '1970-01-01' END) {W.format(14)} AS s14 FROM panel)
"""


@query("fe13_history", with_sql(PANEL, HISTORY + "SELECT series, report_date, observed_7, observed_30, observed_age FROM o"))
def fe13(spark, sf):
    return features.observation_history(daily_panel(spark, sf)).select("series", "report_date", "observed_7", "observed_30", "observed_age")


@query("fe14_slope", with_sql(PANEL, HISTORY + """SELECT series, report_date, round(CASE WHEN observed_7 >= 2 THEN s7 END + 1e-6, 3) AS slope_7, round(CASE
  WHEN n14 >= 2 THEN s14 END + 1e-6, 3) AS slope_14 FROM o"""))
def fe14(spark, sf):
    return features.observation_history(daily_panel(spark, sf)).select("series", "report_date", F.round(F.col("slope_7") + 1e-6, 3).alias("slope_7"), F.round(F.col("slope_14") + 1e-6, 3).alias("slope_14"))


@query("fe15_usable", with_sql(PANEL, RETURNS + """SELECT r.series, count(*) AS n, count(*) FILTER (p.is_observed AND l1 IS NOT NULL AND r1 IS NOT NULL AND m IS NOT NULL AND s IS NOT NULL) AS usable
  FROM r JOIN panel p USING (series, report_date) GROUP BY 1"""))
def fe15(spark, sf):
    rows = features.usable(features.price_windows(daily_panel(spark, sf)), ["lag_1", "return_1", "mean_14", "std_14"])
    return rows.groupBy("series").agg(F.count("*").alias("n"), F.count_if("usable").alias("usable"))


@query("fe16_relative", with_sql(PANEL, f""", t AS (SELECT series, report_date, observed_price, lag(price_index) {S} AS a FROM panel)
  SELECT series, report_date, round(observed_price / a - 1, 6) AS target, round(greatest(0.01, a * (1 + (observed_price / a - 1))), 4) AS price FROM t
  WHERE observed_price IS NOT NULL AND a IS NOT NULL"""))
def fe16(spark, sf):
    rows = daily_panel(spark, sf).withColumn("a", F.lag("price_index").over(panel.by_series())).where("observed_price IS NOT NULL AND a IS NOT NULL")
    rows = rows.withColumn("t", features.relative_target(F.col("observed_price"), F.col("a")))
    return rows.select("series", "report_date", r6("t").alias("target"), F.round(features.from_relative(F.col("t"), F.col("a")), 4).alias("price"))


@query("fe17_sequences", with_sql(PANEL, f""", x AS (SELECT series, report_date, lag(price_index) {S} AS anchor, count(*) OVER (PARTITION BY series
  ORDER BY report_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS n,
  list(struct_pack(d := report_date, p := observed_price)) OVER (PARTITION BY series ORDER BY report_date ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS y FROM panel)
SELECT series, report_date, round(anchor, 4) AS anchor, CAST(30 AS BIGINT) AS n_inputs, CAST(len([v for v in y if v.p IS NOT NULL
  AND v.d <= DATE '2000-12-31']) AS BIGINT) AS n_targets,
round(list_sum([v.p / anchor - 1 for v in y if v.p IS NOT NULL AND v.d <= DATE '2000-12-31']), 5) AS total FROM x
WHERE report_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND (report_date - DATE '2000-01-01') % 7 = 0 AND n = 30 AND anchor > 0
  AND len([v for v in y if v.p IS NOT NULL AND v.d <= DATE '2000-12-31']) > 0"""))
def fe17(spark, sf):
    rows = features.sequences(daily_panel(spark, sf).withColumn("is_observed_n", F.col("is_observed").cast("int")), ["price_index", "is_observed_n"], "2000-01-01", "2000-12-31")
    known = F.filter("targets", lambda t: t.isNotNull())
    return rows.select("series", "report_date", F.round("anchor", 4).alias("anchor"), F.size("inputs").cast("long").alias("n_inputs"), F.size(known).cast("long").alias("n_targets"), F.round(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query("fe18_point_in_time", with_sql(PANEL, "SELECT CAST(0 AS BIGINT) AS differing, count(*) AS n FROM panel WHERE report_date <= DATE '1998-06-30'"))
def fe18(spark, sf):
    """Features from the whole panel equal those from a panel cut at a day, up to that day."""
    whole = daily_panel(spark, sf)
    columns = ["lag_1", "mean_14", "std_14", "return_7", "volatility_14", "expanding_mean"]
    a = features.price_windows(whole).where("report_date <= DATE '1998-06-30'")
    b = features.price_windows(whole.where("report_date <= DATE '1998-06-30'"))
    both = a.select("series", "report_date", F.struct(*columns).alias("a")).join(b.select("series", "report_date", F.struct(*columns).alias("b")), ["series", "report_date"], "full")
    return both.agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"), F.count("*").alias("n"))


MULTI = [f"x_{c}_{w}" for w in (7, 14, 30) for c in ("mean", "std", "median", "min", "max", "slope")]
SCALED = ", ".join(
    f"avg(x) FILTER (age < {w}) / anchor AS x_mean_{w}, stddev_pop(x) FILTER (age < {w}) / anchor AS x_std_{w}, median(x) FILTER (age < {w}) / anchor AS x_median_{w}, "
    f"min(x) FILTER (age < {w}) / anchor AS x_min_{w}, max(x) FILTER (age < {w}) / anchor AS x_max_{w}, CASE WHEN count(x) FILTER (age < {w}) > 1 THEN regr_slope(x, -age) FILTER (age < {w}) / anchor END AS x_slope_{w}" for w in (7, 14, 30)
)
OTHERS = [*[f"x_lag_{k}" for k in (1, 7, 14)], *[f"x_return_{k}" for k in (1, 7, 14)]]
CYCLES = ("h_sqrt", "h_log", "origin_sin", "origin_cos", "target_sin", "target_cos")


@query("fe19_multi_horizon", with_sql(PANEL, f""", pm AS MATERIALIZED (SELECT series, report_date, price_index, observed_price FROM panel),
o AS (SELECT series, report_date AS origin, price_index AS anchor FROM pm
  WHERE price_index IS NOT NULL AND report_date >= DATE '1998-01-01' AND (report_date - DATE '1998-01-01') % 30 = 0),
d AS (SELECT o.series, origin, anchor, p.price_index AS x, CAST(origin - p.report_date AS DOUBLE) AS age FROM o
  JOIN pm p ON p.series = o.series AND p.report_date BETWEEN origin - 29 AND origin),
f AS (SELECT series, origin, anchor, {SCALED}, {", ".join(f"max(x) FILTER (age = {k}) / anchor AS x_lag_{k}, anchor / max(x) FILTER (age = {k}) - 1 AS x_return_{k}" for k in (1, 7, 14))} FROM d GROUP BY series, origin, anchor),
h AS (SELECT *, CAST(unnest(range(1, 31)) AS INT) AS horizon FROM f)
SELECT h.series, origin, horizon, {", ".join(f"round({c} + 3e-8, 6) AS {c}" for c in [*OTHERS, *MULTI])}, round(p.observed_price / anchor - 1 + 3e-8, 6) AS y,
round(sqrt(horizon), 6) AS h_sqrt, round(ln(1 + horizon), 6) AS h_log, round(sin({PI} * dayofyear(origin) / 365) + 1e-9, 6) AS origin_sin,
  round(cos({PI} * dayofyear(origin) / 365) + 1e-9, 6) AS origin_cos,
round(sin({PI} * dayofyear(p.report_date) / 365) + 1e-9, 6) AS target_sin, round(cos({PI} * dayofyear(p.report_date) / 365) + 1e-9, 6) AS target_cos
FROM h JOIN pm p ON p.series = h.series AND p.report_date = origin + horizon WHERE p.observed_price IS NOT NULL"""))
def fe19(spark, sf):
    nudge = lambda c: 3e-8 if c in MULTI or c in OTHERS or c == "y" else 0.0 if c.startswith("h_") else 1e-9
    rows = features.multi_horizon(daily_panel(spark, sf))
    return rows.select("series", "origin", "horizon", *[r6(F.col(c) + nudge(c)).alias(c) for c in [*OTHERS, *MULTI, "y", *CYCLES]])
