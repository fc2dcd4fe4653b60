"""SV, DR and IO queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricepanel.operators import serve, store

from .backtests import PATHS, forecast_paths
from .base import CLEAN, PANEL, clean_prices, daily_panel, query, r6, raw_prices, table, with_sql, written
from .scoring import rounded

L = "row_number() OVER (PARTITION BY series ORDER BY report_date DESC) AS k"
TAIL = ", tl AS (SELECT *, " + L + " FROM panel WHERE price_index IS NOT NULL)"
WEEK = ", fw AS (SELECT series, avg(seasonal7) AS predicted FROM paths WHERE origin = DATE '2001-05-31' AND horizon <= 7 GROUP BY 1)"
PROD = PATHS + TAIL + WEEK + """, nw AS (SELECT series, max(CASE WHEN k = 1 THEN price_index END) AS current, max(CASE WHEN k = 8 THEN price_index END) AS week_back FROM tl
  WHERE k <= 8 GROUP BY 1),
pl AS (SELECT nw.*, predicted, 100 * (predicted - current) / current AS change, CASE WHEN 100 * (predicted - current) / current > 1 THEN 'Bullish'
  WHEN 100 * (predicted - current) / current < -1 THEN 'Bearish' WHEN predicted IS NOT NULL THEN 'Neutral' END AS label,
  split_part(series, '||', 2) AS product_name FROM nw LEFT JOIN fw USING (series))
"""


def products(spark, sf):
    week = forecast_paths(spark, sf).where("origin = DATE '2001-05-31' AND horizon <= 7").select("series", F.col("seasonal7").alias("price"))
    return serve.product_list(daily_panel(spark, sf), week).withColumn("product_name", F.split("series", r"\|\|")[1])


@query("sv1_summary", with_sql(CLEAN, """, r AS (SELECT * FROM clean WHERE report_date >= DATE '2000-01-01'), t AS (SELECT series, list(price_index ORDER BY report_date) AS last_prices
  FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY report_date DESC) AS k FROM r) WHERE k <= 7 GROUP BY 1)
SELECT series, count(*) AS n, arg_min(price_index, report_date) AS first_price, arg_max(price_index, report_date) AS last_price,
  max(report_date) AS last_day, count(*) <> count(DISTINCT report_date) AS ambiguous, round(list_sum(any_value(last_prices)), 4) AS week_sum FROM r
  JOIN t USING (series) GROUP BY 1 HAVING count(*) >= 2"""))
def sv1(spark, sf):
    return serve.summary(clean_prices(spark, sf), "2000-01-01").withColumn("week_sum", F.round(F.aggregate("last_prices", F.lit(0.0), lambda a, x: a + x), 4)).drop("last_prices")


@query("sv3_contiguous", with_sql(PATHS, """, f AS (SELECT series, origin, date, seasonal7 AS price FROM paths
  WHERE NOT (horizon = 5 AND product_name = 'PROMO') AND origin >= DATE '2001-01-01'), s AS (SELECT *, row_number() OVER (PARTITION BY series, origin
  ORDER BY date) AS step FROM f WHERE price > 0) SELECT series, origin, date, price, CAST(step AS INT) AS step FROM s
  WHERE date - origin = step AND step <= 7"""))
def sv3(spark, sf):
    f = forecast_paths(spark, sf).where("NOT (horizon = 5 AND product_name = 'PROMO') AND origin >= DATE '2001-01-01'")
    return serve.contiguous(f.select("series", "origin", "date", F.col("seasonal7").alias("price"), F.col("horizon").alias("id")))


@query("sv2_summary_forecast", with_sql(PATHS, """, f AS (SELECT series, origin, date, seasonal7 AS price FROM paths WHERE origin = DATE '2001-05-31' AND NOT (horizon = 5 AND product_name = 'PROMO')),
s AS (SELECT *, row_number() OVER (PARTITION BY series, origin ORDER BY date) AS step
  FROM f), c AS (SELECT series, count(*) AS days, round(avg(price), 5) AS mean FROM s WHERE date - origin = step AND step <= 7 GROUP BY 1),
l AS (SELECT series, arg_max(price_index, report_date) AS last_price FROM clean WHERE report_date BETWEEN DATE '2000-01-01' AND DATE '2001-05-31'
  GROUP BY 1 HAVING count(*) >= 2)
SELECT series, last_price, days, mean FROM l LEFT JOIN c USING (series)"""))
def sv2(spark, sf):
    f = forecast_paths(spark, sf).where("origin = DATE '2001-05-31' AND NOT (horizon = 5 AND product_name = 'PROMO')").select("series", "origin", "date", F.col("seasonal7").alias("price"), F.col("horizon").alias("id"))
    week = serve.contiguous(f).groupBy("series").agg(F.count("*").alias("days"), F.round(F.avg("price"), 5).alias("mean"))
    now = serve.summary(clean_prices(spark, sf).where("report_date <= DATE '2001-05-31'"), "2000-01-01").select("series", "last_price")
    return now.join(week, "series", "left")


@query("sv4_products", with_sql(PROD, "SELECT series, current, week_back, round(predicted, 5) AS predicted, round(change, 5) AS change, label FROM pl"))
def sv4(spark, sf):
    return rounded(products(spark, sf), "predicted", "change").drop("sparkline", "product_name")


@query("sv5_chart", with_sql(PANEL, """, d AS (SELECT product_name, report_date, avg(observed_price) AS price FROM panel WHERE observed_price IS NOT NULL GROUP BY ALL)
SELECT product_name, 'daily' AS grain, report_date AS start, round(price + 3e-7, 5) AS price FROM d UNION ALL
  SELECT product_name, 'weekly', CAST(date_trunc('week', report_date) AS DATE), round(avg(price) + 3e-7, 5) FROM d
  GROUP BY product_name, date_trunc('week', report_date) HAVING CAST(date_trunc('week', any_value(report_date)) AS DATE) + 6 <= DATE '2001-05-20'
UNION ALL SELECT product_name, 'monthly', CAST(date_trunc('month', report_date) AS DATE), round(avg(price) + 3e-7, 5) FROM d
  GROUP BY product_name, date_trunc('month', report_date) HAVING last_day(any_value(report_date)) <= DATE '2001-05-20'"""))
def sv5(spark, sf):
    return serve.chart(daily_panel(spark, sf), "2001-05-20").withColumn("price", F.round(F.col("price") + 3e-7, 5))


@query("sv6_overlay", with_sql(PANEL, """, pm AS MATERIALIZED (SELECT series, report_date, price_index, observed_price FROM panel WHERE report_date >= DATE '2001-01-01'),
kn AS (SELECT series, report_date, price_index, row_number() OVER (PARTITION BY series
  ORDER BY report_date DESC) AS k, count(*) OVER (PARTITION BY series) AS n FROM pm
  WHERE price_index IS NOT NULL AND report_date <= DATE '2001-05-31'),
an AS (SELECT DISTINCT series FROM kn WHERE k = 1 AND report_date = DATE '2001-05-31'),
ls AS (SELECT series, list(price_index ORDER BY report_date) AS l FROM kn JOIN an USING (series) WHERE k <= 7 GROUP BY series),
f AS (SELECT series, CAST(DATE '2001-05-31' + h AS DATE) AS date, l[(h - 1) % len(l) + 1] AS forecast FROM ls, (SELECT CAST(unnest(range(1, 31)) AS INT) AS h)),
h AS (SELECT series, report_date AS date, observed_price AS observed FROM pm WHERE observed_price IS NOT NULL AND report_date >= DATE '2001-04-01')
SELECT series, date, observed, forecast, coalesce(forecast, observed) AS shown FROM h FULL JOIN f USING (series, date)"""))
def sv6(spark, sf):
    history = daily_panel(spark, sf).where("observed_price IS NOT NULL AND report_date >= DATE '2001-04-01'").select("series", F.col("report_date").alias("date"), F.col("observed_price").alias("price"))
    return serve.overlay(history, forecast_paths(spark, sf).where("origin = DATE '2001-05-31'").withColumnRenamed("seasonal7", "price"))


HALVES = """, h AS (SELECT *, ntile(2) OVER (PARTITION BY {k} ORDER BY report_date, id) AS half
  FROM clean), a AS (SELECT {k}, avg(price_index) FILTER (half = 1) AS p, avg(price_index) FILTER (half = 2) AS c FROM h GROUP BY 1)
  SELECT {k}, round(p, 5) AS previous, round(c, 5) AS current, round(100 * (c - p) / p, 5) AS change FROM a"""


@query("sv7_halves", with_sql(CLEAN, HALVES.format(k="origin")))
def sv7(spark, sf):
    return rounded(serve.halves(clean_prices(spark, sf), "origin"), "previous", "current", "change")


@query("sv7_variants", with_sql(CLEAN, HALVES.format(k="product_variant")))
def sv7v(spark, sf):
    return rounded(serve.halves(clean_prices(spark, sf), "product_variant"), "previous", "current", "change")


@query("sv7_last_points", with_sql(CLEAN, """, d AS (SELECT product_variant, report_date, avg(price_index) AS price FROM clean
  GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY product_variant ORDER BY report_date DESC) AS k FROM d)
  SELECT product_variant, k, report_date, round(price + 3e-7, 5) AS price FROM r WHERE k <= 14"""))
def sv7p(spark, sf):
    return serve.last_points(clean_prices(spark, sf), "product_variant", 14).select("product_variant", F.col("k").cast("long").alias("k"), "report_date", F.round(F.col("price") + 3e-7, 5).alias("price"))


@query("sv8_cheaper", with_sql(CLEAN, """, l AS (SELECT series, product_category, product_name, unit, arg_max(price_index, (report_date, id)) AS price FROM clean GROUP BY ALL),
j AS (SELECT a.series, b.series AS alternative, b.price AS alternative_price, a.price - b.price AS saving, 100 * (a.price - b.price) / a.price AS pct,
  row_number() OVER (PARTITION BY a.series ORDER BY b.price, b.series) AS rank FROM l a
  JOIN l b ON a.product_category = b.product_category AND a.unit = b.unit AND a.product_name <> b.product_name AND b.price < a.price)
SELECT series, CAST(rank AS INT) AS rank, alternative, alternative_price, round(saving, 5) AS saving, round(pct, 5) AS saving_pct FROM j WHERE rank <= 5"""))
def sv8(spark, sf):
    return rounded(serve.cheaper(clean_prices(spark, sf)), "saving", "saving_pct")


@query("sv9_movers", with_sql(PROD, "SELECT series, round(change, 5) AS change FROM pl WHERE change IS NOT NULL ORDER BY abs(change) DESC, series LIMIT 10"))
def sv9(spark, sf):
    return rounded(serve.movers(products(spark, sf)).select("series", "change"), "change")


@query("sv10_featured", with_sql(PROD, """, o AS (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY (label = 'Bullish') DESC, change DESC, series) AS r FROM pl
  WHERE change IS NOT NULL) SELECT product_name, series, label FROM o WHERE r = 1 ORDER BY (label = 'Bullish') DESC, change DESC, series LIMIT 6"""))
def sv10(spark, sf):
    return serve.featured(products(spark, sf)).select("product_name", "series", "label")


EV = "ev AS (SELECT CAST(user_id AS VARCHAR) AS product_id, CAST(ts AS DATE) AS day, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY ALL), ld AS (SELECT max(day) AS d FROM ev)"


@query("sv11_trending", f"""WITH {EV} SELECT product_id, CAST(sum(views) AS BIGINT) AS views FROM ev, ld WHERE day > d - 30 AND day <= d GROUP BY 1
  ORDER BY views DESC, product_id LIMIT 10""")
def sv11(spark, sf):
    views = table(spark, sf, "events").where("event_type = 'view'").groupBy(F.col("user_id").cast("string").alias("product_id"), F.to_date("ts").alias("day")).agg(F.count("*").alias("views"))
    last = views.agg(F.max("day")).first()[0]
    return serve.trending(views, str(last))


@query("sv12_market", with_sql(CLEAN, """SELECT product_name, origin, count(*) AS n, min(price_index) AS lowest, max(price_index) AS highest, round(avg(price_index), 5) AS mean FROM clean
  WHERE product_category = 'Vegetables' AND lower(product_name) LIKE '%m%' AND price_index >= 850 AND price_index <= 950 GROUP BY ALL"""))
def sv12(spark, sf):
    return rounded(serve.market(clean_prices(spark, sf), "Vegetables", "M", 850, 950), "mean")


A, B = "Rice||PROMO||Standard||Local||kg", "Fish||STANDARD||R||Local||kg"


@query("sv13_side_by_side", with_sql(PANEL, TAIL.strip().removeprefix(",").join([", ", ""]) + f" SELECT CAST(k AS INT) AS k, max(CASE WHEN series = '{A}' THEN price_index END) AS a, max(CASE WHEN series = '{B}' THEN price_index END) AS b FROM tl WHERE k <= 30 AND series IN ('{A}', '{B}') GROUP BY k"))
def sv13(spark, sf):
    return serve.side_by_side(daily_panel(spark, sf), A, B)


GEO = "CAST({k} * 37 % 180 AS DOUBLE) - 90 AS lat, CAST({k} * 73 % 360 AS DOUBLE) - 180 AS lon"


@query("sv14_nearest", f"""WITH p AS (SELECT c_custkey AS point_id, {GEO.format(k='c_custkey')} FROM customer), s AS (SELECT s_suppkey AS place_id, {GEO.format(k='s_suppkey')}
  FROM supplier),
d AS (SELECT point_id, place_id, 2 * 6371.0 * asin(sqrt(sin(radians(s.lat - p.lat) / 2) ** 2 + cos(radians(p.lat)) * cos(radians(s.lat)) * sin(radians(s.lon - p.lon) / 2) ** 2)) AS km FROM p, s)
SELECT point_id, rank, round(km, 4) AS km FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, place_id) AS rank FROM d) WHERE rank <= 3""")
def sv14(spark, sf):
    geo = lambda k: (f"CAST({k} * 37 % 180 AS DOUBLE) - 90 AS lat", f"CAST({k} * 73 % 360 AS DOUBLE) - 180 AS lon")
    points = table(spark, sf, "customer").selectExpr("c_custkey AS point_id", *geo("c_custkey"))
    places = table(spark, sf, "supplier").selectExpr("s_suppkey AS place_id", *geo("s_suppkey"))
    return serve.nearest(points, places, 3).select("point_id", F.col("rank").cast("long").alias("rank"), F.round("km", 4).alias("km"))


@query("sv15_facets", with_sql(CLEAN, """SELECT 'product_category' AS facet, product_category AS value, count(*) AS n FROM clean GROUP BY 2 UNION ALL SELECT 'origin', origin, count(*)
  FROM clean GROUP BY 2"""))
def sv15(spark, sf):
    return serve.facets(clean_prices(spark, sf), ["product_category", "origin"])


@query("sv16_trend_facts", with_sql(PANEL, TAIL + """, a AS (SELECT series, max(CASE WHEN k = 1 THEN price_index END) AS l, avg(CASE WHEN k <= 5 THEN price_index END) AS r, avg(CASE WHEN k BETWEEN 6
  AND 30 THEN price_index END) AS o, max(CASE WHEN k = 6 THEN price_index END) AS p5, max(CASE WHEN k = 31 THEN price_index END) AS p30,
stddev_samp(CASE WHEN k <= 7 THEN price_index END) / avg(CASE WHEN k <= 7 THEN price_index END) AS cv, avg(CASE
  WHEN k <= 30 THEN price_index END) AS m FROM tl WHERE k <= 31 GROUP BY 1)
SELECT series, CASE WHEN r / o - 1 > 0.02 THEN 'rising' WHEN r / o - 1 < -0.02 THEN 'falling' ELSE 'stable' END AS trend,
  round(100 * (l / p5 - 1), 5) AS change_5, round(100 * (l / p30 - 1), 5) AS change_30, round(cv, 5) AS cv_7,
  round(100 * (l / m - 1), 5) AS from_mean_30 FROM a"""))
def sv16(spark, sf):
    return rounded(serve.trend_facts(daily_panel(spark, sf)), "change_5", "change_30", "cv_7", "from_mean_30")


@query("sv17_gaps", with_sql(PATHS, """, g AS (SELECT *, seasonal7 / anchor - 1 AS gap, abs(seasonal7 / lag(seasonal7) OVER (PARTITION BY series, origin ORDER BY horizon) - 1) AS st
  FROM paths)
SELECT series, origin, round(arg_min(gap, horizon), 5) AS first_gap, round(arg_max(gap, horizon), 5) AS last_gap,
  round(max(abs(gap)), 5) AS largest_gap, round(avg(CASE WHEN horizon <= 7 THEN gap END), 5) AS week_gap, round(max(st), 5) AS largest_step FROM g
  GROUP BY series, origin ORDER BY round(max(abs(gap)), 9) DESC, series, origin LIMIT 20"""))
def sv17(spark, sf):
    out = serve.forecast_gaps(forecast_paths(spark, sf).withColumnRenamed("seasonal7", "price"))
    return rounded(out, "first_gap", "last_gap", "largest_gap", "week_gap", "largest_step")


@query("sv18_freshness", with_sql(CLEAN, """, s AS (SELECT series, max(report_date) AS last_day, count(*) FILTER (is_observed) < 600 AS f FROM clean GROUP BY 1)
  SELECT last_day, count(*) AS n, count(*) FILTER (f) AS fallbacks, last_day >= DATE '2001-10-30' AS current FROM s GROUP BY last_day"""))
def sv18(spark, sf):
    per = clean_prices(spark, sf).groupBy("series").agg(F.max("report_date").alias("last_day"), (F.count_if("is_observed") < 600).alias("is_fallback"))
    return serve.freshness(per, "2001-10-30")


@query("dr1_psi", with_sql(CLEAN, """, ed AS (SELECT product_category, list_distinct(quantile_cont(price_index, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS e FROM clean
  WHERE report_date < DATE '1999-01-01' GROUP BY 1),
b AS (SELECT product_category, report_date < DATE '1999-01-01' AS ref, CASE WHEN price_index = list_max(e) THEN len(e) - 1
  ELSE len([x for x in e if x <= price_index]) END AS bin FROM clean JOIN ed USING (product_category)
  WHERE price_index BETWEEN list_min(e) AND list_max(e)),
c AS (SELECT product_category, bin, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM b GROUP BY ALL),
p AS (SELECT product_category, greatest(r / sum(r) OVER w, 1e-6) AS p, greatest(c / sum(c) OVER w, 1e-6) AS q
  FROM c WINDOW w AS (PARTITION BY product_category)) SELECT product_category, round(sum((q - p) * ln(q / p)), 6) AS psi FROM p GROUP BY 1"""))
def dr1(spark, sf):
    rows = written(clean_prices(spark, sf), "clean")
    return serve.stability_index(rows.where("report_date < DATE '1999-01-01'"), rows.where("report_date >= DATE '1999-01-01'"), "price_index", ["product_category"]).select("product_category", r6("psi").alias("psi"))


@query("dr2_performance", with_sql(PATHS, """, m AS (SELECT product_name, avg(abs((seasonal7 - actual) / actual)) FILTER (origin < DATE '2000-01-01') AS o,
  avg(abs((seasonal7 - actual) / actual)) FILTER (origin >= DATE '2000-01-01') AS n FROM paths WHERE actual > 0 GROUP BY 1)
  SELECT product_name, CASE WHEN o > 0 THEN (n - o) / o > 0.15 ELSE false END AS drifted FROM m"""))
def dr2(spark, sf):
    ape = F.abs((F.col("seasonal7") - F.col("actual")) / F.col("actual"))
    m = forecast_paths(spark, sf).where("actual > 0").groupBy("product_name").agg(F.avg(F.when(F.col("origin") < F.lit("2000-01-01").cast("date"), ape)).alias("o"), F.avg(F.when(F.col("origin") >= F.lit("2000-01-01").cast("date"), ape)).alias("n"))
    return m.select("product_name", serve.performance_drift(F.col("o"), F.col("n")).alias("drifted"))


@query("io2_scan", with_sql(CLEAN, "SELECT id, product_name, report_date, price_index FROM clean WHERE report_date BETWEEN DATE '1999-03-01' AND DATE '1999-04-30'"))
def io2(spark, sf):
    return store.bounded(clean_prices(spark, sf), "1999-03-01", "1999-04-30").select("id", "product_name", "report_date", "price_index")


@query("io2_months", with_sql(CLEAN, """, bound AS (SELECT max(report_date) AS hi FROM clean WHERE product_category = 'Fish' AND product_variant = 'R')
SELECT id, product_name, report_date, price_index FROM clean, bound WHERE report_date <= hi AND report_date > hi - 45"""))
def io2_months(spark, sf):
    """The prices laid out by month, then those of the 45 days up to a day that is known only when the table is read."""
    rows = written(clean_prices(spark, sf).select("id", "product_category", "product_name", "product_variant", "report_date", "price_index"), "clean")
    root = store.shared_folder(spark, "months")
    store.write_by_month(rows, root)
    through = rows.where("product_category = 'Fish' AND product_variant = 'R'").agg(F.max("report_date").alias("day"))
    since = through.select(F.date_sub("day", 45))
    return store.read_months(spark, root, since, through, ", ".join(f"{n} {t}" for n, t in rows.dtypes)).select("id", "product_name", "report_date", "price_index")


@query("io3_history", with_sql(CLEAN, """SELECT report_date, price_index FROM clean WHERE product_name = 'PROMO' AND product_variant = 'R' AND origin = 'Local'
  AND product_category = 'Rice' ORDER BY report_date DESC LIMIT 50"""))
def io3(spark, sf):
    return store.history(clean_prices(spark, sf), "PROMO", "R", "Local", "Rice", 50).select("report_date", "price_index")


@query("io4_upsert", with_sql(CLEAN, """, b AS (SELECT product_name, product_variant, origin, report_date, price_index * 2 AS price_index, id FROM clean
  WHERE report_date >= DATE '2001-06-01'), s AS (SELECT product_name, product_variant, origin, report_date, price_index, id FROM clean
  WHERE report_date <= DATE '2001-07-31'),
k AS (SELECT *, row_number() OVER (PARTITION BY product_name, product_variant, origin, report_date ORDER BY src DESC, id) AS r
  FROM (SELECT *, 1 AS src FROM b UNION ALL SELECT *, 0 FROM s)) SELECT product_name, product_variant, origin, report_date, price_index FROM k
  WHERE r = 1"""))
def io4(spark, sf):
    rows = clean_prices(spark, sf).select("product_name", "product_variant", "origin", "report_date", "price_index", "id")
    return store.upsert_prices(rows.where("report_date <= DATE '2001-07-31'"), rows.where("report_date >= DATE '2001-06-01'").withColumn("price_index", F.col("price_index") * 2)).drop("id")


@query("io5_unprocessed", with_sql(CLEAN, """SELECT DISTINCT source_pdf FROM raw WHERE source_pdf NOT IN (SELECT source_pdf FROM raw WHERE report_date < DATE '2001-06-01')"""))
def io5(spark, sf):
    rows = raw_prices(spark, sf)
    return store.unprocessed(rows.select("source_pdf").distinct(), rows.where("report_date < DATE '2001-06-01'"))


@query("io7_verify", with_sql(PATHS, """, v AS (SELECT CAST(origin AS VARCHAR) AS run_id, series AS product_id, CASE WHEN horizon = 9 AND day(origin) % 2 = 0 THEN date - 1
  ELSE date END AS date,
  CASE WHEN horizon = 4 AND month(origin) % 3 = 0 THEN -seasonal7 ELSE seasonal7 END AS price FROM paths
  WHERE origin >= DATE '2001-01-01' AND NOT (horizon = 20 AND month(origin) % 2 = 0)),
g AS (SELECT run_id, product_id, count(*) AS n, count(DISTINCT date) AS d, max(date) - min(date) AS span, bool_and(price > 0) AS ok FROM v GROUP BY ALL)
SELECT run_id, CAST(sum(n) AS BIGINT) AS n, bool_and(n = d) AS unique_days, bool_and(span = d - 1) AS consecutive, bool_and(ok) AS positive FROM g GROUP BY 1"""))
def io7(spark, sf):
    """Runs with planted faults, by month and day of the origin: a doubled day, a missing day, a price below zero."""
    rows = forecast_paths(spark, sf).where("origin >= DATE '2001-01-01' AND NOT (horizon = 20 AND month(origin) % 2 = 0)")
    rows = rows.select(
        F.col("origin").cast("string").alias("run_id"), F.col("series").alias("product_id"), F.expr("CASE WHEN horizon = 9 AND day(origin) % 2 = 0 THEN date_sub(date, 1) ELSE date END").alias("date"),
        F.expr("CASE WHEN horizon = 4 AND month(origin) % 3 = 0 THEN -seasonal7 ELSE seasonal7 END").alias("price"),
    )
    return store.verify(rows)


@query("io7_view", with_sql(PATHS, """, f AS (SELECT *, CASE WHEN horizon = 3 THEN 0 WHEN horizon = 5 THEN 2 ELSE 1 END AS copies, horizon = 9 AS is_new FROM paths)
SELECT CAST(count(*) AS BIGINT) AS run_rows, CAST(sum(copies) + count(*) FILTER (horizon = 30) AS BIGINT) AS view_rows, count(*) FILTER (horizon = 3) AS missing,
  count(*) FILTER (horizon = 5) AS doubled, count(*) FILTER (horizon = 30) AS foreign, count(*) FILTER (is_new) AS changed FROM f"""))
def io7_view(spark, sf):
    """Every run's daily view, from which one horizon is missing, in which one is doubled and one changed, and to which days beyond the last are added."""
    run = written(forecast_paths(spark, sf).select("series", "origin", "horizon", "date", F.col("seasonal7").alias("price")), "run")
    view = run.where("horizon <> 3").withColumn("price", F.when(F.col("horizon") == 9, F.col("price") + 1).otherwise(F.col("price")))
    view = view.unionByName(run.where("horizon = 5")).unionByName(run.where("horizon = 30").withColumn("date", F.date_add("date", 1)))
    return store.view_differences(run, view, ["series", "origin", "date"], ["price"])


@query("io8_evaluations", with_sql(PATHS, """, e AS (SELECT CAST(origin AS VARCHAR) AS model_run_id, product_name AS commodity_id, horizon, count(actual) AS n FROM paths
  WHERE origin >= DATE '2001-01-01' GROUP BY ALL)
SELECT model_run_id, commodity_id, horizon, CASE WHEN horizon <= 10 THEN n + 1 ELSE n END AS n, horizon > 10 AS approved FROM e"""))
def io8(spark, sf):
    rows = forecast_paths(spark, sf).where("origin >= DATE '2001-01-01'").groupBy(F.col("origin").cast("string").alias("model_run_id"), F.col("product_name").alias("commodity_id"), "horizon").agg(F.count("actual").alias("n"))
    return store.upsert_evaluations(rows.withColumn("approved", F.lit(True)), rows.where("horizon <= 10").withColumn("n", F.col("n") + 1), ["model_run_id", "commodity_id", "horizon"])


@query("io9_latest_run", with_sql(PATHS, "SELECT series, horizon, seasonal7 AS price FROM paths WHERE origin = (SELECT max(origin) FROM paths)"))
def io9(spark, sf):
    rows = forecast_paths(spark, sf).select(F.col("origin").cast("string").alias("run_id"), "origin", "series", "horizon", F.col("seasonal7").alias("price"))
    runs = rows.select("run_id", F.col("origin").cast("timestamp").alias("generated_at")).distinct()
    return store.latest_run(runs, rows).select("series", "horizon", "price")


@query("io10_fingerprint", with_sql(CLEAN, """, h AS (SELECT md5(concat_ws('|', series, CAST(report_date AS VARCHAR), CAST(CAST(round(price_index * 10000) AS BIGINT) AS VARCHAR), source_pdf)) AS h
  FROM clean),
s AS (SELECT count(*) AS n, sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) AS a, sum(CAST('0x' || substr(h, 17, 15) AS HUGEINT)) AS b FROM h)
  SELECT n, sha256(concat_ws('|', CAST(n AS VARCHAR), CAST(a AS VARCHAR), CAST(b AS VARCHAR))) AS sha256 FROM s"""))
def io10(spark, sf):
    rows = clean_prices(spark, sf).withColumn("price", F.round(F.col("price_index") * 10000).cast("long"))
    return store.fingerprint(rows, ["series", "report_date", "price", "source_pdf"])
