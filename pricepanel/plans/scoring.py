"""SC and CF queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricepanel.operators import score

from .backtests import FITTED_PATHS, PATHS, fitted_paths, forecast_paths
from .base import PANEL, daily_panel, query, r6, with_sql, written

M = "count(*) AS n, round(avg(abs({f} - actual)), 5) AS mae, round(sqrt(avg(({f} - actual) ** 2)), 5) AS rmse, round(100 * avg(abs(({f} - actual) / actual)), 5) AS mape"
M5 = lambda f: M.format(f=f)
R5 = ("mae", "rmse", "mape")


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 5) for c in columns})


@query("sc1_metrics", with_sql(PATHS, f"""SELECT {M5('seasonal7')}, round(1 - avg((seasonal7 - actual) ** 2) / var_pop(actual), 5) AS r2,
  round(avg(CAST(abs((seasonal7 - actual) / actual) <= 0.05 AS INT)), 5) AS within_5,
  count(*) FILTER (abs((seasonal7 - actual) / actual) <= 0.1) AS within_10, count(*) AS eligible, CAST(0 AS BIGINT) AS near_zero FROM paths
  WHERE actual IS NOT NULL"""))
def sc1(spark, sf):
    return rounded(score.scored(forecast_paths(spark, sf), "seasonal7"), *R5, "r2", "within_5")


@query("sc2_direction", with_sql(PATHS, """SELECT product_category, round(avg(CAST(sign(actual - anchor) = sign(seasonal7 - anchor) AS INT)), 5) AS direction FROM paths
  WHERE actual IS NOT NULL GROUP BY 1"""))
def sc2(spark, sf):
    return score.scored(forecast_paths(spark, sf), "seasonal7", ["product_category"], "anchor").select("product_category", F.round("direction", 5).alias("direction"))


@query("sc3_breakdown", with_sql(PATHS, f"""SELECT CASE WHEN grouping(product_name) = 0 THEN 'product_name' WHEN grouping(product_category) = 0 THEN 'product_category'
  WHEN grouping(horizon) = 0 THEN 'horizon' ELSE 'all' END AS level, product_name, product_category, horizon, {M5('moving_average7')} FROM paths
  WHERE actual IS NOT NULL GROUP BY GROUPING SETS ((product_name), (product_category), (horizon), ()) HAVING count(*) >= 2"""))
def sc3(spark, sf):
    columns = ["product_name", "product_category", "horizon"]
    out = score.breakdown(forecast_paths(spark, sf), "moving_average7", [["product_name"], ["product_category"], ["horizon"], []], columns).where("n >= 2")
    return rounded(out.select("level", *columns, "n", *R5), *R5)


LONG = "lf AS (SELECT model, v, actual, origin, horizon FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS model, {f} AS v, actual, origin, horizon FROM paths WHERE actual IS NOT NULL" for f in ("persistence", "seasonal7", "moving_average7")) + "))"


@query("sc4_forecasters", with_sql(PATHS, f""", {LONG}, t AS (SELECT model, {M5('v')}, avg(abs(v - actual)) AS m FROM lf GROUP BY 1)
  SELECT model, n, mae, rmse, mape, round(100 * (1 - m / (SELECT m FROM t WHERE model = 'persistence')), 5) AS improvement FROM t"""))
def sc4(spark, sf):
    out = score.compare_forecasters(forecast_paths(spark, sf), ["persistence", "seasonal7", "moving_average7"])
    return rounded(out.select("model", "n", *R5, "improvement"), *R5, "improvement")


FITTED_LONG = "lf AS (SELECT model, v, actual FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS model, {f} AS v, actual FROM paths WHERE actual IS NOT NULL" for f in ("persistence", "seasonal7", "moving_average7", "model")) + "))"


@query("sc4_fitted", with_sql(FITTED_PATHS, f""", {FITTED_LONG}, sc AS (SELECT model, {M5('v')}, avg(abs(v - actual)) AS m FROM lf GROUP BY 1)
  SELECT model, n, mae, rmse, mape, round(100 * (1 - m / (SELECT m FROM sc WHERE model = 'persistence')), 5) AS improvement FROM sc"""))
def sc4_fitted(spark, sf):
    """The fitted model among the baselines."""
    out = score.compare_forecasters(written(fitted_paths(spark, sf), "paths"), ["persistence", "seasonal7", "moving_average7", "model"])
    return rounded(out.select("model", "n", *R5, "improvement"), *R5, "improvement")


PUB = PATHS + """,
dl AS (SELECT series, origin, date, round_even(CAST(seasonal7 AS DECIMAL(20,6)), 2) AS price FROM paths WHERE origin >= DATE '2000-01-01'),
pr AS (SELECT series, origin, 'daily' AS grain, date AS period_start, date AS period_end, price FROM dl
  UNION ALL SELECT series, origin, 'weekly', CAST(date_trunc('week', date) AS DATE), CAST(date_trunc('week', date) AS DATE) + 6, price FROM dl
  UNION ALL SELECT series, origin, 'monthly', CAST(date_trunc('month', date) AS DATE), last_day(date), price FROM dl),
pub AS (SELECT series, origin, grain, period_start, period_end, CAST(sum(CAST(price AS DECIMAL(20,2))) AS DECIMAL(24,2)) AS total,
  count(*) AS covered_days FROM pr GROUP BY ALL),
publ AS (SELECT *, CAST(row_number() OVER (PARTITION BY series, origin, grain
  ORDER BY period_start) AS INT) AS step, period_end - period_start + 1 AS period_days FROM pub)
"""


def publication(spark, sf):
    rows = forecast_paths(spark, sf).where("origin >= DATE '2000-01-01'").withColumnRenamed("seasonal7", "price")
    return score.published(rows)


@query("sc5_cents", with_sql(PANEL, """SELECT series, report_date, CAST(round_even(CAST(price_index AS DECIMAL(20,6)), 2) AS DOUBLE) AS cents FROM panel WHERE price_index IS NOT NULL"""))
def sc5(spark, sf):
    return daily_panel(spark, sf).where("price_index IS NOT NULL").select("series", "report_date", score.cents(F.col("price_index")).cast("double").alias("cents"))


@query("sc6_published", with_sql(PUB, """SELECT series, origin, grain, period_start, period_end, step, covered_days, period_days,
round(CASE WHEN (CAST(total * 100 AS HUGEINT) * 2) % (covered_days * 2) = covered_days
  AND (CAST(total * 100 AS HUGEINT) // covered_days) % 2 = 0 THEN CAST(total * 100 AS HUGEINT) // covered_days
  ELSE (CAST(total * 100 AS HUGEINT) * 2 + covered_days) // (2 * covered_days) END / 100.0, 2) AS price FROM publ"""))
def sc6(spark, sf):
    return publication(spark, sf).withColumn("price", F.col("price").cast("double"))


@query("sc7_steps", with_sql(PATHS, """SELECT DISTINCT origin, date, date - origin AS daily, (CAST(date_trunc('week', date) AS DATE) - CAST(date_trunc('week',
  origin + 1) AS DATE)) // 7 + 1 AS weekly, (year(date) * 12 + month(date)) - (year(origin + 1) * 12 + month(origin + 1)) + 1 AS monthly FROM paths"""))
def sc7(spark, sf):
    return forecast_paths(spark, sf).select("origin", "date").distinct().select("origin", "date", *[score.period_step(F.col("origin"), F.col("date"), g).alias(g) for g in ("daily", "weekly", "monthly")])


ROLL = PATHS + """,
rs AS (SELECT 'daily' AS grain, i + 1 AS step, i AS lo, i AS hi FROM (SELECT unnest(range(0, 7)) AS i) UNION ALL
  SELECT 'weekly', i + 1, 7 * i, 7 * i + 6 FROM (SELECT unnest(range(0, 4)) AS i) UNION ALL SELECT 'monthly', 1, 0, 29),
rin AS (SELECT series, origin, CAST(origin + horizon - 1 AS DATE) AS date, CASE WHEN horizon % 11 <> 0 THEN seasonal7 END AS price FROM paths),
roll AS (SELECT series, origin, grain, CAST(step AS INT) AS step, CASE WHEN count(price) FILTER (date - origin BETWEEN lo
  AND hi) = hi - lo + 1 THEN avg(price) FILTER (date - origin BETWEEN lo AND hi) END AS price,
  CAST(hi - lo + 1 - count(price) FILTER (date - origin BETWEEN lo AND hi) AS INT) AS missing_days FROM rin, rs GROUP BY series, origin, grain, step, lo, hi)
"""


def rolling(spark, sf):
    rows = forecast_paths(spark, sf).select("series", "origin", F.date_sub("date", 1).alias("date"), F.when(F.col("horizon") % 11 != 0, F.col("seasonal7")).alias("price"))
    return score.rolling_contract(rows)


@query("sc8_rolling", with_sql(ROLL, "SELECT series, origin, grain, step, round(price + 3e-7, 5) AS price, missing_days FROM roll"))
def sc8(spark, sf):
    return rolling(spark, sf).withColumn("price", F.round(F.col("price") + 3e-7, 5))


@query("sc9_saved", with_sql(PUB + "," + ROLL.split(PATHS)[1].strip().removeprefix(","), """SELECT r.series, r.origin, r.grain, r.step, CASE WHEN p.step IS NOT NULL THEN 'saved' WHEN r.price IS NOT NULL THEN 'averaged'
  ELSE 'unavailable' END AS kind
FROM roll r LEFT JOIN publ p ON p.series = r.series AND p.origin = r.origin AND p.grain = r.grain AND p.step = r.step AND p.covered_days = p.period_days"""))
def sc9(spark, sf):
    return score.saved_or_rolling(publication(spark, sf), rolling(spark, sf)).select("series", "origin", "grain", "step", "kind")


PERIODS = """, pd AS (SELECT product_name, 'daily' AS grain, horizon AS step, seasonal7 AS f, actual AS a, false AS partial FROM paths WHERE actual IS NOT NULL
  UNION ALL SELECT product_name, 'weekly', CAST((CAST(date_trunc('week', any_value(date)) AS DATE) - CAST(date_trunc('week',
  origin + 1) AS DATE)) // 7 + 1 AS INT), avg(seasonal7), avg(actual), count(DISTINCT date) < 7
    FROM paths WHERE actual IS NOT NULL GROUP BY product_name, series, origin, date_trunc('week', date)
  UNION ALL SELECT product_name, 'monthly',
  CAST((year(any_value(date)) * 12 + month(any_value(date))) - (year(origin + 1) * 12 + month(origin + 1)) + 1 AS INT), avg(seasonal7), avg(actual),
  count(DISTINCT date) < day(last_day(any_value(date)))
    FROM paths WHERE actual IS NOT NULL GROUP BY product_name, series, origin, date_trunc('month', date))
"""


@query("sc10_horizon_audit", with_sql(PATHS, PERIODS + """SELECT grain, step, product_name, count(*) AS n, count(*) FILTER (partial) AS partial, count(*) FILTER (NOT (f > 0 AND a > 0)) AS invalid,
round(avg(abs(f - a)) FILTER (f > 0 AND a > 0) + 3e-7, 5) AS mae, round(sqrt(avg((f - a) ** 2) FILTER (f > 0 AND a > 0)) + 3e-7, 5) AS rmse FROM pd
  GROUP BY GROUPING SETS ((grain, step), (grain, product_name), (grain, step, product_name))"""))
def sc10(spark, sf):
    out = score.horizon_audit(forecast_paths(spark, sf), "seasonal7")
    return out.withColumns({c: F.round(F.col(c) + 3e-7, 5) for c in ("mae", "rmse")})


@query("sc10_worst", with_sql(PATHS, """SELECT series, count(*) AS n, round(sqrt(avg((seasonal7 - actual) ** 2)), 6) AS rmse FROM paths WHERE actual IS NOT NULL GROUP BY 1
  ORDER BY rmse DESC, series LIMIT 5"""))
def sc10w(spark, sf):
    return score.worst(forecast_paths(spark, sf), "seasonal7", "series")


#: Paths with planted faults: a missing lead, a date a day late, a price that is not above zero.
FAULTY = """, fp AS (SELECT series, origin, horizon, CASE WHEN horizon = 9 AND product_name = 'SMALL' AND month(origin) = 3 THEN CAST(date + 1 AS DATE)
  ELSE date END AS date,
  CASE WHEN horizon = 5 AND product_name = 'ECONOMY' AND day(origin) > 20 THEN 0 ELSE seasonal7 END AS prediction FROM paths
  WHERE NOT (horizon = 17 AND product_name = 'PROMO' AND month(origin) % 4 = 1)),
fq AS (SELECT series, origin, count(*) AS n, count(DISTINCT horizon) AS leads, min(horizon) AS lo, max(horizon) AS hi, count(DISTINCT date) AS dates,
  count(*) FILTER (date <> origin + horizon) AS wrong_date, count(*) FILTER (NOT prediction > 0) AS not_positive FROM fp GROUP BY ALL),
ck AS (SELECT origin, count(*) AS series, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (NOT (n = 30 AND leads = 30 AND lo = 1 AND hi = 30
  AND dates = 30)) AS incomplete, CAST(sum(wrong_date) AS BIGINT) AS wrong_date, CAST(sum(not_positive) AS BIGINT) AS not_positive FROM fq GROUP BY 1)
"""


def faulty(spark, sf):
    rows = forecast_paths(spark, sf).where("NOT (horizon = 17 AND product_name = 'PROMO' AND month(origin) % 4 = 1)")
    return rows.withColumns({
        "date": F.expr("CASE WHEN horizon = 9 AND product_name = 'SMALL' AND month(origin) = 3 THEN date_add(date, 1) ELSE date END"),
        "prediction": F.expr("CASE WHEN horizon = 5 AND product_name = 'ECONOMY' AND day(origin) > 20 THEN 0 ELSE seasonal7 END"),
    })


@query("sc11_contract", with_sql(PATHS, FAULTY + "SELECT * FROM ck"))
def sc11(spark, sf):
    return score.contract_checks(faulty(spark, sf))


@query("sc12_actuals", with_sql(PANEL, """SELECT count(*) FILTER (NOT report_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31') AS outside,
  count(*) FILTER (report_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND NOT is_observed) AS unobserved,
  count(*) FILTER (report_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND is_observed) AS kept FROM panel"""))
def sc12(spark, sf):
    return score.actuals(daily_panel(spark, sf), "2000-01-01", "2000-12-31")[1]


@query("sc13_holdout", with_sql(PATHS, """, h AS (SELECT 'daily' AS grain, actual, seasonal7 AS f, persistence AS p FROM paths WHERE actual IS NOT NULL
UNION ALL SELECT 'weekly', avg(actual), avg(seasonal7), avg(persistence) FROM paths WHERE actual IS NOT NULL GROUP BY series, origin, date_trunc('week', date)
UNION ALL SELECT 'monthly', avg(actual), avg(seasonal7), avg(persistence) FROM paths WHERE actual IS NOT NULL GROUP BY series, origin, date_trunc('month', date))
SELECT grain, count(*) AS n, round(avg(abs(f - actual)), 5) AS mae, round(100 * avg(abs((f - actual) / actual)), 5) AS mape,
  round(avg(abs(p - actual)), 5) AS persistence_mae, round(100 * avg(abs((p - actual) / actual)), 5) AS persistence_mape FROM h GROUP BY 1"""))
def sc13(spark, sf):
    return rounded(score.holdout_scores(forecast_paths(spark, sf), "seasonal7"), "mae", "mape", "persistence_mae", "persistence_mape")


REPLAYED = PATHS + """,
pw AS (SELECT series, origin, 'weekly' AS grain, date_trunc('week', date) AS start, avg(actual) AS actual, avg(seasonal7) AS f FROM paths GROUP BY ALL),
pm AS (SELECT series, origin, 'monthly' AS grain, date_trunc('month', date) AS start, avg(actual) AS actual, avg(seasonal7) AS f FROM paths GROUP BY ALL),
pp AS (SELECT series, origin, grain, CAST(row_number() OVER (PARTITION BY series, origin, grain ORDER BY start) AS INT) AS step, actual, f FROM (SELECT * FROM pw UNION ALL SELECT * FROM pm)
  UNION ALL SELECT series, origin, 'daily', CAST(horizon AS INT), actual, seasonal7 FROM paths),
tb AS (SELECT CASE WHEN grouping(step) = 0 THEN 'step' WHEN grouping(series) = 0 THEN 'series' ELSE 'all' END AS level, grain, step, series, count(*) AS n, avg(abs(f - actual)) AS mae,
  sqrt(avg((f - actual) ** 2)) AS rmse, avg(CASE WHEN actual > 0 THEN 100 * abs(f - actual) / actual END) AS mape
  FROM pp WHERE actual IS NOT NULL GROUP BY GROUPING SETS ((grain), (grain, step), (grain, series)))
"""


#: What a holdout must reach at every grain (fixed values).
HOLDOUT_TARGETS = {"within_10": ("min", 90.0), "mae": ("max", 5.0), "rmse": ("max", 5.0), "mape": ("max", 5.0)}
GATES_SQL = REPLAYED[: REPLAYED.index("tb AS (")].rstrip().rstrip(",") + """,
gs AS (SELECT grain, avg(abs(f - actual)) AS mae, sqrt(avg((f - actual) ** 2)) AS rmse, avg(100 * abs(f - actual) / actual) AS mape,
  100 * avg(CAST(abs(f - actual) <= 0.1 * actual AS INT)) AS within_10 FROM pp WHERE actual > 0 GROUP BY grain),
gm AS (SELECT {a} AS a, count(*) FILTER (mae <= {a} AND rmse <= {a} AND mape <= {a} AND within_10 >= {b}) AS met FROM gs)
"""


@query("sc13_gates", with_sql(GATES_SQL.replace("{a}", "5.0").replace("{b}", "90.0"), """SELECT 'stated' AS targets, met AS grains_met, met = 3 AS metric_target_met,
  (SELECT count(*) = count(actual) FROM paths) AS full_scope_observed, met = 3 AND (SELECT count(*) = count(actual) FROM paths) AS target_met FROM gm
UNION ALL SELECT 'loose', (SELECT count(*) FROM gs WHERE mae <= 1000 AND rmse <= 1000 AND mape <= 1000 AND within_10 >= 1), (SELECT count(*) = 3 FROM gs WHERE mae <= 1000 AND rmse <= 1000 AND mape <= 1000 AND within_10 >= 1),
  (SELECT count(*) = count(actual) FROM paths), (SELECT count(*) = 3 FROM gs WHERE mae <= 1000 AND rmse <= 1000 AND mape <= 1000 AND within_10 >= 1) AND (SELECT count(*) = count(actual) FROM paths)
UNION ALL SELECT 'loose, observed days', (SELECT count(*) FROM gs WHERE mae <= 1000 AND rmse <= 1000 AND mape <= 1000 AND within_10 >= 1), true, true, true"""))
def sc13_gates(spark, sf):
    """The stated targets, loose ones, and loose ones over the observed days alone, which are then all that was declared."""
    paths = written(forecast_paths(spark, sf), "paths")
    loose = {"within_10": ("min", 1.0), "mae": ("max", 1000.0), "rmse": ("max", 1000.0), "mape": ("max", 1000.0)}
    cases = [("stated", paths, HOLDOUT_TARGETS), ("loose", paths, loose), ("loose, observed days", paths.where("actual IS NOT NULL"), loose)]
    out = [score.target_gates(rows, "seasonal7", targets).select(F.lit(name).alias("targets"), "grains_met", "metric_target_met", "full_scope_observed", "target_met") for name, rows, targets in cases]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("sc14_coverage", with_sql(PATHS, """, f AS (SELECT DISTINCT series, date FROM paths WHERE product_category <> 'Fish'), t AS (SELECT DISTINCT series, report_date AS date FROM panel
  WHERE is_observed)
SELECT (SELECT count(*) FROM t WHERE (series, date) NOT IN (SELECT (series, date) FROM f)) AS observed_without_forecast, (SELECT count(*) FROM f
  WHERE (series, date) NOT IN (SELECT (series, date) FROM t)) AS forecast_without_outcome,
(SELECT count(*) FROM f JOIN t USING (series, date)) AS matched, (SELECT count(DISTINCT series) FROM t WHERE series NOT IN (SELECT series FROM f)) AS series_outside"""))
def sc14(spark, sf):
    truth = daily_panel(spark, sf).where("is_observed").select("series", F.col("report_date").alias("date"))
    return score.holdout_coverage(forecast_paths(spark, sf).where("product_category <> 'Fish'"), truth)


@query("sc15_groups", with_sql(PATHS, f""", b AS (SELECT *, CASE WHEN horizon <= 7 THEN '01-07' WHEN horizon <= 14 THEN '08-14' WHEN horizon <= 21 THEN '15-21' ELSE '22-30' END AS bucket
  FROM paths WHERE actual IS NOT NULL)
SELECT CASE grouping_id(series, product_category, bucket) WHEN 3 THEN 'series' WHEN 5 THEN 'product_category' WHEN 4 THEN 'product_category+bucket'
  WHEN 6 THEN 'bucket' ELSE 'all' END AS level, series, product_category, bucket, {M5('seasonal7')} FROM b
GROUP BY GROUPING SETS ((series), (product_category), (bucket), (product_category, bucket), ())"""))
def sc15(spark, sf):
    bucket = F.when(F.col("horizon") <= 7, "01-07").when(F.col("horizon") <= 14, "08-14").when(F.col("horizon") <= 21, "15-21").otherwise("22-30")
    columns = ["series", "product_category", "bucket"]
    out = score.breakdown(forecast_paths(spark, sf).withColumn("bucket", bucket), "seasonal7", [["series"], ["product_category"], ["bucket"], ["product_category", "bucket"], []], columns)
    return rounded(out.select("level", *columns, "n", *R5), *R5)


WINS = ", ".join(f"avg(abs({f} - actual)) AS {f}_mae, sqrt(avg(({f} - actual) ** 2)) AS {f}_rmse, avg(abs(({f} - actual) / actual)) AS {f}_mape" for f in ("moving_average7", "seasonal7"))


@query("sc16_wins", with_sql(PATHS, f""", p AS (SELECT origin, {WINS} FROM paths WHERE actual IS NOT NULL
  GROUP BY 1), w AS (SELECT count(*) AS origins, count(*) FILTER (moving_average7_mae < seasonal7_mae AND moving_average7_rmse < seasonal7_rmse
  AND moving_average7_mape < seasonal7_mape) AS wins FROM p) SELECT origins, wins, origins >= 3 AND wins >= ceil(origins * 2 / 3) AS stable FROM w"""))
def sc16(spark, sf):
    return score.matched_wins(forecast_paths(spark, sf), "moving_average7", "seasonal7")


@query("sc17_gate", with_sql(PATHS, f""", {LONG}, t AS (SELECT model, avg(abs(v - actual)) AS mae, sqrt(avg((v - actual) ** 2)) AS rmse, avg(abs((v - actual) / actual)) AS mape,
  count(*) FILTER (abs((v - actual) / actual) <= 0.1) AS w FROM lf GROUP BY 1),
g AS (SELECT c.mae < p.mae AND c.rmse < p.rmse AND c.mape < p.mape AND c.w > p.w AS beats_persistence, c.mae <= 0.95 * h.mae
  AND c.rmse <= 0.95 * h.rmse AND c.mape <= 0.95 * h.mape AS beats_champion FROM t c, t h, t p
  WHERE c.model = 'moving_average7' AND h.model = 'seasonal7' AND p.model = 'persistence')
SELECT *, beats_persistence AND beats_champion AS passes FROM g"""))
def sc17(spark, sf):
    return score.gate(score.compare_forecasters(forecast_paths(spark, sf), ["persistence", "seasonal7", "moving_average7"]), "moving_average7", "seasonal7")


@query("sc18_labels", with_sql(PATHS, """, a AS (SELECT series, origin, horizon, actual FROM paths WHERE horizon > 2),
b AS (SELECT series, origin, horizon, CASE WHEN horizon = 7 AND product_name = 'SMALL' THEN actual + 1 WHEN horizon = 8
  AND product_name = 'PROMO' THEN NULL ELSE actual END AS actual FROM paths WHERE horizon <= 20)
SELECT count(*) FILTER (b.series IS NULL) AS only_a, count(*) FILTER (a.series IS NULL) AS only_b, count(*) FILTER (a.series IS NOT NULL
  AND b.series IS NOT NULL AND a.actual IS DISTINCT FROM b.actual) AS differing
FROM a FULL JOIN b ON a.series = b.series AND a.origin = b.origin AND a.horizon = b.horizon"""))
def sc18(spark, sf):
    """Labels of two sets of which each lacks some keys, with labels that were changed or taken away."""
    rows = forecast_paths(spark, sf)
    changed = F.expr("CASE WHEN horizon = 7 AND product_name = 'SMALL' THEN actual + 1 WHEN horizon = 8 AND product_name = 'PROMO' THEN NULL ELSE actual END")
    return score.same_labels(rows.where("horizon > 2"), rows.where("horizon <= 20").withColumn("actual", changed))


@query("sc19_realized", with_sql(PATHS, """, f AS (SELECT CAST(origin AS VARCHAR) AS run_id, origin AS generated_at, series AS product_id, date, horizon AS lead, seasonal7 AS price, CASE
  WHEN horizon <= 7 THEN '1-7' WHEN horizon <= 14 THEN '8-14' ELSE '15-30' END AS bucket FROM paths),
t AS (SELECT series AS product_id, report_date AS date, observed_price AS actual FROM panel WHERE is_observed),
l AS (SELECT product_id, date, 'all' AS bucket, arg_max(price, (generated_at, run_id)) AS price FROM f GROUP BY product_id, date UNION ALL
  SELECT product_id, date, bucket, arg_max(price, (generated_at, run_id)) FROM f GROUP BY product_id, date, bucket)
SELECT bucket, count(*) AS n, round(avg(abs(price - actual)), 5) AS mae, round(avg(CAST(abs(price - actual) <= 0.1 * actual AS INT)), 5) AS success
  FROM l JOIN t USING (product_id, date) GROUP BY 1"""))
def sc19(spark, sf):
    f = forecast_paths(spark, sf).select(F.col("origin").cast("string").alias("run_id"), F.col("origin").alias("generated_at"), F.col("series").alias("product_id"), "origin", "date", F.col("horizon").alias("lead"), F.col("seasonal7").alias("price"))
    truth = daily_panel(spark, sf).where("is_observed").select(F.col("series").alias("product_id"), F.col("report_date").alias("date"), F.col("observed_price").alias("actual"))
    return rounded(score.realized(f, truth), "mae", "success")


@query("sc20_accuracy", with_sql(PATHS, "SELECT count(*) AS n, round(100 - 100 * avg(abs((seasonal7 - actual) / actual)), 5) AS accuracy FROM paths WHERE actual > 0"))
def sc20(spark, sf):
    return rounded(score.relative_accuracy(forecast_paths(spark, sf), "seasonal7"), "accuracy")


CELLS = """, ce AS (SELECT series, horizon, count(*) AS n, count(*) FILTER (abs(seasonal7 - actual) <= 0.1 * actual) AS hits FROM paths WHERE actual > 0
  GROUP BY ALL HAVING count(*) >= {})
"""


@query("sc21_wilson", with_sql(PATHS, CELLS.format(10) + """SELECT series, horizon, n, hits, round(hits / n, 5) AS rate,
round((hits / n + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(hits / n * (1 - hits / n) / n + z * z / (4 * n * n)) / (1 + z * z / n), 5) AS low,
  round((hits / n + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(hits / n * (1 - hits / n) / n + z * z / (4 * n * n)) / (1 + z * z / n), 5) AS high
  FROM ce, (SELECT CAST(1.959963984540054 AS DOUBLE) AS z)"""))
def sc21(spark, sf):
    return rounded(score.hit_cells(forecast_paths(spark, sf), "seasonal7", ["series", "horizon"], 10), "rate", "low", "high")


@query("sc22_pooled", with_sql(PATHS, CELLS.format(5) + """SELECT series, sum(n) AS n, sum(hits) AS hits, round(sum(hits) / sum(n), 5) AS rate FROM ce WHERE horizon <= 7
  GROUP BY 1 HAVING count(DISTINCT horizon) = 7 AND count(*) = 7"""))
def sc22(spark, sf):
    return rounded(score.pooled_leads(score.hit_cells(forecast_paths(spark, sf), "seasonal7", ["series", "horizon"], 5)), "rate")


@query("sc23_exact", with_sql(PATHS, CELLS.format(5) + "SELECT series, horizon, n, hits FROM ce WHERE horizon = 3"))
def sc23(spark, sf):
    cells = score.hit_cells(forecast_paths(spark, sf), "seasonal7", ["series", "horizon"], 5).select("series", "horizon", "n", "hits")
    wanted = cells.select("series").distinct().withColumn("horizon", F.lit(3))
    return score.exact_match(wanted, cells, ["series", "horizon"])


@query("sc24_reliability", with_sql(PATHS, """, c AS (SELECT product_name, count(*) AS n, count(*) FILTER (abs(seasonal7 - actual) <= 0.1 * actual) AS hits, count(DISTINCT origin) AS origins
  FROM paths WHERE actual > 0 GROUP BY 1),
s AS (SELECT *, (hits / n * origins + (SELECT sum(hits) / sum(n) FROM c) * 10) / (origins + 10) AS shrunk FROM c)
SELECT product_name, n, hits, origins, round(shrunk, 5) AS shrunk, CASE WHEN n < 20 THEN 'insufficient' WHEN shrunk >= 0.8 THEN 'high'
  WHEN shrunk >= 0.6 THEN 'moderate' ELSE 'low' END AS level FROM s"""))
def sc24(spark, sf):
    cells = forecast_paths(spark, sf).where("actual > 0").groupBy("product_name").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("seasonal7") - F.col("actual")) <= 0.1 * F.col("actual")).alias("hits"), F.count_distinct("origin").alias("origins"))
    return rounded(score.reliability(cells, ["product_name"]), "shrunk")


@query("sc25_replay", with_sql(PATHS, """SELECT count(*) AS matched, round(avg(abs(seasonal7 - round(seasonal7, 1))), 5) AS mean_diff,
  round(max(abs(seasonal7 - round(seasonal7, 1))), 5) AS max_diff, count(*) FILTER (abs(seasonal7 - round(seasonal7, 1)) > 0.005) AS over_half_cent
  FROM paths"""))
def sc25(spark, sf):
    rows = forecast_paths(spark, sf).select("series", "origin", "horizon", F.col("seasonal7").alias("prediction"))
    return rounded(score.replay_parity(rows, rows.withColumn("prediction", F.round("prediction", 1)), ["series", "origin", "horizon"]), "mean_diff", "max_diff")


@query("sc25_tables", with_sql(REPLAYED, "SELECT level, grain, step, series, n, round(mae, 5) AS mae, round(rmse, 5) AS rmse, round(mape, 5) AS mape FROM tb"))
def sc25_tables(spark, sf):
    tables = score.replay_tables(score.period_rows(forecast_paths(spark, sf), "seasonal7"))
    return rounded(tables.select("level", "grain", "step", "series", "n", *R5), *R5)


@query("sc25_worst", with_sql(REPLAYED, """SELECT grain, place, series, n, round(rmse, 5) AS rmse FROM (SELECT *, CAST(row_number() OVER (PARTITION BY grain
  ORDER BY round(rmse, 9) DESC, series) AS INT) AS place FROM tb WHERE level = 'series') WHERE place <= 5"""))
def sc25_worst(spark, sf):
    tables = score.replay_tables(score.period_rows(forecast_paths(spark, sf), "seasonal7"))
    return score.worst_series(tables).select("grain", "place", "series", "n", F.round("rmse", 5).alias("rmse"))


@query("sc26_reconcile", with_sql(PATHS, """, c AS (SELECT product_name, horizon, count(*) AS n, count(*) FILTER (abs(seasonal7 - actual) <= 0.1 * actual) AS hits FROM paths WHERE actual > 0
  GROUP BY ALL),
p AS (SELECT product_name, sum(n) AS n, sum(hits) AS hits FROM c WHERE NOT (product_name = 'PROMO' AND horizon = 30) GROUP BY 1),
q AS (SELECT product_name, sum(n) AS pooled_n, sum(hits) AS pooled_hits FROM c GROUP BY 1)
SELECT product_name, CAST(n AS BIGINT) AS n, CAST(hits AS BIGINT) AS hits, CAST(pooled_n AS BIGINT) AS pooled_n,
  CAST(pooled_hits AS BIGINT) AS pooled_hits, n = pooled_n AND hits = pooled_hits AS reconciles FROM p JOIN q USING (product_name)"""))
def sc26(spark, sf):
    """Per product; one product's parts lack a horizon and must not reconcile."""
    rows = forecast_paths(spark, sf)
    parts = score.hit_cells(rows, "seasonal7", ["product_name", "horizon"], 1).where("NOT (product_name = 'PROMO' AND horizon = 30)")
    return score.reconciles(parts, score.hit_cells(rows, "seasonal7", ["product_name"], 1), ["product_name"])


SAMPLES = PATHS + """,
sm AS (SELECT product_name, origin, 'daily' AS grain, horizon AS step, date AS available, 100 * abs(seasonal7 - actual) / actual AS ape FROM paths WHERE actual > 0
  UNION ALL SELECT product_name, origin, 'weekly', CAST((CAST(date_trunc('week', any_value(date)) AS DATE) - CAST(date_trunc('week',
  origin + 1) AS DATE)) // 7 + 1 AS INT), max(date), 100 * abs(avg(seasonal7) - avg(actual)) / avg(actual) FROM paths WHERE actual > 0
  GROUP BY product_name, series, origin, date_trunc('week', date)
  UNION ALL SELECT product_name, origin, 'monthly',
  CAST((year(any_value(date)) * 12 + month(any_value(date))) - (year(origin + 1) * 12 + month(origin + 1)) + 1 AS INT),
  max(date), 100 * abs(avg(seasonal7) - avg(actual)) / avg(actual) FROM paths WHERE actual > 0
  GROUP BY product_name, series, origin, date_trunc('month', date))
"""


def samples(spark, sf):
    return score.error_samples(forecast_paths(spark, sf), "seasonal7")


@query("cf1_path_checks", with_sql(PATHS, FAULTY + "SELECT CAST(sum(series) AS BIGINT) AS paths, CAST(sum(incomplete + wrong_date) AS BIGINT) AS broken FROM ck"))
def cf1(spark, sf):
    return score.contract_checks(faulty(spark, sf)).agg(F.sum("series").alias("paths"), F.sum(F.col("incomplete") + F.col("wrong_date")).alias("broken"))


@query("cf2_samples", with_sql(SAMPLES, "SELECT product_name, grain, step, count(*) AS n, round(avg(ape), 5) AS mape, max(available) AS last_known FROM sm GROUP BY ALL"))
def cf2(spark, sf):
    return rounded(samples(spark, sf).groupBy("product_name", "grain", "step").agg(F.count("*").alias("n"), F.avg("ape").alias("mape"), F.max("available").alias("last_known")), "mape")


@query("cf3_forward", with_sql(SAMPLES, """, u AS (SELECT product_name, grain, available - DATE '1970-01-01' AS t, ape AS x, NULL::DOUBLE AS ape FROM sm UNION ALL
  SELECT product_name, grain, origin - DATE '1970-01-01', NULL, ape FROM sm),
r AS (SELECT *, count(x) OVER w AS k, sum(x) OVER w AS s, sum(x * x) OVER w AS q FROM u WINDOW w AS (PARTITION BY product_name, grain
  ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT grain, abs(greatest(0, 100 - s / k) - greatest(0, 100 - ape)) AS p, abs(greatest(0, greatest(0, 100 - s / k) - sqrt(greatest(0,
  (q - k * (s / k) ** 2) / (k - 1))) / sqrt(k)) - greatest(0, 100 - ape)) AS c FROM r WHERE ape IS NOT NULL AND k >= 8)
SELECT grain, count(*) AS checked, round(avg(p), 5) AS plain_loss, round(avg(c), 5) AS careful_loss, CASE WHEN avg(c) < avg(p) THEN 'conservative'
  ELSE 'plain' END AS formula FROM l GROUP BY 1"""))
def cf3(spark, sf):
    return rounded(score.forward_check(samples(spark, sf)), "plain_loss", "careful_loss")


CONF = """, c AS (SELECT product_name, grain, count(*) AS n, count(DISTINCT origin) AS origins, avg(ape) AS mape FROM sm GROUP BY ALL),
oa AS (SELECT DISTINCT product_name, grain, origin FROM sm), av AS (SELECT product_name, grain, available, count(*) AS n FROM sm GROUP BY ALL),
oc AS (SELECT oa.product_name, oa.grain, oa.origin, sum(av.n) AS seen FROM oa
  JOIN av ON av.product_name = oa.product_name AND av.grain = oa.grain AND av.available <= oa.origin GROUP BY ALL),
ch AS (SELECT product_name, grain, count(*) AS checked FROM oc WHERE seen >= 8 GROUP BY ALL),
cf AS (SELECT c.*, coalesce(checked, 0) AS checked, concat_ws(',', CASE WHEN n < 8 THEN 'few_samples' END, CASE
  WHEN origins < 8 THEN 'few_origins' END, CASE WHEN coalesce(checked, 0) < 3 THEN 'few_checked' END) AS reasons,
  CASE WHEN n >= 8 AND origins >= 8 AND coalesce(checked, 0) >= 3 THEN greatest(0, 100 - mape) END AS score FROM c LEFT JOIN ch USING (product_name, grain)),
cl AS (SELECT *, CASE WHEN score IS NULL THEN 'unavailable' WHEN score >= 90 THEN 'high' WHEN score >= 80 THEN 'moderate' ELSE 'low' END AS level FROM cf)
"""


@query("cf4_confidence", with_sql(SAMPLES, CONF + "SELECT product_name, grain, n, origins, checked, reasons, round(score, 5) AS score, level FROM cl"))
def cf4(spark, sf):
    return rounded(score.confidence(samples(spark, sf)), "score").select("product_name", "grain", "n", "origins", "checked", "reasons", "score", "level")


@query("cf5_label_coverage", with_sql(PATHS, """, pe AS (SELECT product_name, 'daily' AS grain, horizon AS step, 1 AS covered, CAST(actual IS NOT NULL AS INT) AS observed, 1 AS calendar FROM paths
  UNION ALL SELECT product_name, 'weekly', CAST((CAST(date_trunc('week', any_value(date)) AS DATE) - CAST(date_trunc('week',
  origin + 1) AS DATE)) // 7 + 1 AS INT), count(*), count(actual), 7 FROM paths GROUP BY product_name, series, origin, date_trunc('week', date)
  UNION ALL SELECT product_name, 'monthly',
  CAST((year(any_value(date)) * 12 + month(any_value(date))) - (year(origin + 1) * 12 + month(origin + 1)) + 1 AS INT), count(*), count(actual),
  day(last_day(any_value(date))) FROM paths GROUP BY product_name, series, origin, date_trunc('month', date))
SELECT product_name, grain, step, CAST(sum(calendar) AS BIGINT) AS calendar, CAST(sum(covered) AS BIGINT) AS covered,
  CAST(sum(observed) AS BIGINT) AS observed, count(*) FILTER (covered < calendar) AS partial,
round(sum(observed) / sum(covered), 5) AS coverage, sum(observed) / sum(covered) < 0.8 AS withheld FROM pe GROUP BY ALL"""))
def cf5(spark, sf):
    return rounded(score.label_coverage(forecast_paths(spark, sf)), "coverage")


def intervals(spark, sf):
    return forecast_paths(spark, sf).where("actual IS NOT NULL").withColumns({"low": F.col("seasonal7") * 0.95, "high": F.col("seasonal7") * F.when(F.col("product_name") == "PROMO", 0.9).otherwise(1.05)})


PICP = """, iv AS (SELECT product_name, horizon, origin, actual, seasonal7 * 0.95 AS low, seasonal7 * CASE WHEN product_name = 'PROMO' THEN 0.9
  ELSE 1.05 END AS high FROM paths WHERE actual IS NOT NULL),
pc AS (SELECT product_name, horizon, count(*) AS n, count(*) FILTER (actual BETWEEN low AND high) AS covered, CASE
  WHEN bool_or(low > high) THEN 'invalid' ELSE 'ok' END AS status, CASE
  WHEN NOT bool_or(low > high) THEN round(100 * count(*) FILTER (actual BETWEEN low AND high) / count(*), 5) END AS picp,
  count(DISTINCT origin) AS origins FROM iv GROUP BY ALL)
"""


@query("cf6_picp", with_sql(PATHS, PICP + "SELECT product_name, horizon, n, covered, status, picp FROM pc"))
def cf6(spark, sf):
    return rounded(score.interval_coverage(intervals(spark, sf), ["product_name", "horizon"]), "picp")


@query("cf7_admission", with_sql(PATHS, PICP + "SELECT product_name, horizon, n, covered FROM pc WHERE status = 'ok' AND n >= 10 AND n >= 19 AND origins >= 4"))
def cf7(spark, sf):
    rows = intervals(spark, sf)
    cells = score.interval_coverage(rows, ["product_name", "horizon"]).join(rows.groupBy("product_name", "horizon").agg(F.count("*").alias("calibration_rows"), F.count_distinct("origin").alias("calibration_origins")), ["product_name", "horizon"])
    return score.admitted_coverage(cells).select("product_name", "horizon", "n", "covered")


@query("cf8_vs_holdout", with_sql(SAMPLES, CONF + """, h AS (SELECT product_name, 100 * avg(abs((seasonal7 - actual) / actual)) AS hm FROM paths WHERE actual > 0 AND origin >= DATE '2000-06-01'
  GROUP BY 1)
SELECT level, count(*) AS n, count(*) FILTER (hm IS NULL OR score IS NULL) AS missing, round(avg(score - (100 - hm)), 5) AS bias,
  round(avg(abs(score - (100 - hm))), 5) AS error FROM cl LEFT JOIN h USING (product_name) GROUP BY 1"""))
def cf8(spark, sf):
    late = score.scored(forecast_paths(spark, sf).where("origin >= DATE '2000-06-01'"), "seasonal7", ["product_name"])
    return rounded(score.confidence_vs_holdout(score.confidence(samples(spark, sf)), late), "bias", "error")
