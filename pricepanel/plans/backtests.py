"""BT and CA queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricepanel.operators import backtest, calibrate, features, store
from pricepanel.operators.panel import fill

from .base import PANEL, daily_panel, many, many_prices, near6, query, r6, raw_prices, series_prices, with_sql, written
from .feature_plans import RETURNS, ROLLED

START, END = "1998-01-01", "2001-06-30"

PATHS = PANEL + f""",
o0 AS (SELECT CAST(unnest(generate_series(DATE '{START}' - 1, DATE '{END}' - 30, INTERVAL 30 DAY)) AS DATE) AS origin UNION SELECT DATE '{END}' - 30),
kn AS (SELECT series, product_category, product_name, report_date, price_index, list(price_index) OVER (PARTITION BY series
  ORDER BY report_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS last_prices FROM panel WHERE price_index IS NOT NULL),
anc AS (SELECT series, product_category, product_name, origin, price_index AS anchor, list_sum(last_prices) / len(last_prices) AS moving_average7,
  last_prices FROM kn JOIN o0 ON report_date = origin),
pt AS (SELECT *, CAST(unnest(range(1, 31)) AS INT) AS horizon FROM anc),
paths AS (SELECT pt.series, pt.product_category, pt.product_name, origin, horizon, CAST(origin + horizon AS DATE) AS date, anchor,
  anchor AS persistence, moving_average7, last_prices[(horizon - 1) % len(last_prices) + 1] AS seasonal7, p.observed_price AS actual
  FROM pt LEFT JOIN panel p ON p.series = pt.series AND p.report_date = origin + horizon AND p.observed_price IS NOT NULL)
"""


def anchored(spark, sf):
    return backtest.anchors(daily_panel(spark, sf), backtest.origins(spark, START, END))


def folded_forecasts(spark, sf, raw=raw_prices):
    """The baseline paths, a row per series and origin; the prices and the anchors are written once, and no plan holds the panel."""
    prices = written(series_prices(spark, sf, raw), "prices")
    anchored = written(backtest.anchors_of_prices(prices, backtest.origins(spark, START, END)), "anchors")
    return backtest.folded_paths(anchored, prices)


def forecast_paths(spark, sf, raw=raw_prices):
    return backtest.unfolded(folded_forecasts(spark, sf, raw))


@query("bt1_origins", with_sql(PATHS, "SELECT origin FROM o0"))
def bt1(spark, sf):
    # the span of the data bounds the origins
    span = raw_prices(spark, sf).agg(F.min("report_date").alias("lo"), F.max("report_date").alias("hi"))
    return backtest.origins(spark, START, END).join(F.broadcast(span)).where("origin BETWEEN lo AND hi").select("origin")


@query("bt2_anchors", with_sql(PATHS, "SELECT series, origin, anchor, round(moving_average7 + 3e-8, 6) AS moving_average7, CAST(len(last_prices) AS INT) AS n FROM anc"))
def bt2(spark, sf):
    return anchored(spark, sf).select("series", "origin", "anchor", r6(F.col("moving_average7") + 3e-8).alias("moving_average7"), F.size("last_prices").alias("n"))


@query("bt3_paths", with_sql(PATHS, "SELECT series, origin, horizon, date, persistence, seasonal7, actual FROM paths"))
def bt3(spark, sf):
    return forecast_paths(spark, sf).select("series", "origin", "horizon", "date", "persistence", "seasonal7", "actual")


@query("bt4_persistence", with_sql(PANEL, """, l AS (SELECT series, max(report_date) AS origin, arg_max(price_index, report_date) FILTER (price_index IS NOT NULL) AS price FROM panel GROUP BY 1)
SELECT series, origin, price, horizon, CAST(origin + horizon AS DATE) AS date FROM l, (SELECT CAST(unnest(range(1, 31)) AS INT) AS horizon) WHERE price IS NOT NULL"""))
def bt4(spark, sf):
    return backtest.persistence_paths(daily_panel(spark, sf))


FIT = ["return_1", "return_7", "from_expanding_mean"]
RIDGE = 0.001


def training_rows(spark, sf):
    rows = features.price_windows(daily_panel(spark, sf))
    return rows.withColumn("target", F.when(F.col("is_observed"), features.relative_target(F.col("observed_price"), F.col("lag_1")))).where("target IS NOT NULL AND return_7 IS NOT NULL AND from_expanding_mean IS NOT NULL AND return_1 IS NOT NULL")


# the three normal equations of standardised columns, by determinants
SOLVED = f"""
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(c) AS sc, stddev_pop(y) AS sy,
  corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc, corr(a, y) AS ay, corr(b, y) AS by_, corr(c, y) AS cy, 1 + {RIDGE} AS d FROM k),
w AS (SELECT *, d * (d * d - bc * bc) - ab * (ab * d - bc * ac) + ac * (ab * bc - d * ac) AS det FROM m),
v AS (SELECT *, (ay * (d * d - bc * bc) - ab * (by_ * d - bc * cy) + ac * (by_ * bc - d * cy)) / det * sy / sa AS wa,
  (d * (by_ * d - bc * cy) - ay * (ab * d - bc * ac) + ac * (ab * cy - by_ * ac)) / det * sy / sb AS wb,
  (d * (d * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - d * ac)) / det * sy / sc AS wc FROM w)"""
BT5_SQL = RETURNS + f""",
t AS (SELECT r.series, r.report_date, r1 AS a, r7 AS b, CASE WHEN e <> 0 THEN (l1 - e) / e END AS c, CASE WHEN p.is_observed
  AND l1 <> 0 THEN p.observed_price / l1 - 1 END AS y
  FROM r JOIN panel p USING (series, report_date)),
k AS (SELECT * FROM t WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND y IS NOT NULL),{SOLVED}
SELECT series, report_date, round(y, 6) AS target, round(my + wa * (a - ma) + wb * (b - mb) + wc * (c - mc), 6) AS predicted FROM k, v"""


@query("bt5_pooled_model", with_sql(PANEL, BT5_SQL))
def bt5(spark, sf):
    rows = written(training_rows(spark, sf), "training")
    model = backtest.fit_relative(rows, FIT, ridge=RIDGE)
    value = sum((F.col(c) * float(w) for c, w in zip(FIT, model.coefficients, strict=True)), F.lit(float(model.intercept)))
    return rows.select("series", "report_date", r6("target").alias("target"), r6(value).alias("predicted"))


def recursion_steps(own: str, gap: str, peer: str, intercept: str = "0", source: str = "") -> str:
    """One CTE a day: the list of a series' prices grows by the next one; ``source`` gives the weights, where they are columns."""
    steps = [", s0 AS (SELECT origin, product_category, series, len(last_prices) AS n0, last_prices AS l FROM anc)"]
    for h in range(1, 31):
        steps.append(
            f"s{h} AS (SELECT origin, product_category, series, n0, list_append(l, greatest(0.01, l[-1] * (1 + {intercept} + {own} * own + {gap} * (l[-1] / list_avg(l[-7:]) - 1) + {peer} * peer))) AS l"
            f" FROM (SELECT *, quantile_cont(own, 0.5) OVER (PARTITION BY origin, product_category) AS peer FROM (SELECT *, CASE WHEN len(l) > 1 THEN l[-1] / l[-2] - 1 ELSE 0.0 END AS own FROM s{h - 1})){source})"
        )
    return ",\n".join(steps)


def recursion_sql(own: float, gap: float, peer: float) -> str:
    return recursion_steps(str(own), str(gap), str(peer)) + "\nSELECT origin, product_category, series, h AS horizon, round(l[n0 + h], 5) AS price FROM s30, (SELECT CAST(unnest(range(1, 31)) AS INT) AS h)"


@query("bt6_recursive", with_sql(PATHS, recursion_sql(-0.05, -0.2, 0.1)))
def bt6(spark, sf):
    return backtest.recursive_paths(anchored(spark, sf), {"own": -0.05, "gap": -0.2, "peer": 0.1}).withColumn("price", F.round("price", 5))


@query("bt8_stacking", with_sql(PATHS, """SELECT series, origin, horizon, round(seasonal7 / anchor - 1, 6) AS r_seasonal7, round(moving_average7 / anchor - 1, 6) AS r_moving_average7,
round(abs(seasonal7 / anchor - moving_average7 / anchor), 6) AS disagreement, round(horizon / 30, 6) AS h,
  CAST(product_category = 'Rice' AS INT) AS is_rice, round(actual / anchor - 1, 6) AS y FROM paths WHERE actual IS NOT NULL"""))
def bt8(spark, sf):
    rows = backtest.stacking_design(forecast_paths(spark, sf).where("actual IS NOT NULL"), ["seasonal7", "moving_average7"], ["Rice"])
    return rows.select("series", "origin", "horizon", *[r6(c).alias(c) for c in ("r_seasonal7", "r_moving_average7", "disagreement", "h", "y")], "is_rice")


#: What the stacked model is fitted on beside an intercept.
STACK = ["r_seasonal7", "r_moving_average7", "h"]

# weighted normal equations of each horizon bin: rows of near days weigh more
STACK_SQL = f"""
, sd AS (SELECT series, origin, horizon, anchor, actual, CASE WHEN horizon <= 3 THEN '01-03' WHEN horizon <= 7 THEN '04-07' WHEN horizon <= 14 THEN '08-14'
  WHEN horizon <= 21 THEN '15-21' ELSE '22-30' END AS bin, seasonal7 / anchor - 1 AS a, moving_average7 / anchor - 1 AS b, horizon / 30 AS c, actual / anchor - 1 AS y,
  1 / sqrt(horizon) AS q FROM paths WHERE actual IS NOT NULL),
me AS (SELECT bin, sum(q * a) / sum(q) AS ma, sum(q * b) / sum(q) AS mb, sum(q * c) / sum(q) AS mc, sum(q * y) / sum(q) AS my FROM sd GROUP BY bin),
co AS (SELECT bin, any_value(ma) AS ma, any_value(mb) AS mb, any_value(mc) AS mc, any_value(my) AS my, sum(q * (a - ma) * (a - ma)) / sum(q) AS aa, sum(q * (b - mb) * (b - mb)) / sum(q) AS bb,
  sum(q * (c - mc) * (c - mc)) / sum(q) AS cc, sum(q * (a - ma) * (b - mb)) / sum(q) AS ab, sum(q * (a - ma) * (c - mc)) / sum(q) AS ac, sum(q * (b - mb) * (c - mc)) / sum(q) AS bc,
  sum(q * (a - ma) * (y - my)) / sum(q) AS ay, sum(q * (b - mb) * (y - my)) / sum(q) AS by_, sum(q * (c - mc) * (y - my)) / sum(q) AS cy FROM sd JOIN me USING (bin) GROUP BY bin),
rg AS (SELECT *, aa * {1 + RIDGE} AS da, bb * {1 + RIDGE} AS db, cc * {1 + RIDGE} AS dc FROM co),
dt AS (SELECT *, da * (db * dc - bc * bc) - ab * (ab * dc - bc * ac) + ac * (ab * bc - db * ac) AS det FROM rg),
sw8 AS (SELECT bin, ma, mb, mc, my, (ay * (db * dc - bc * bc) - ab * (by_ * dc - bc * cy) + ac * (by_ * bc - db * cy)) / det AS wa,
  (da * (by_ * dc - bc * cy) - ay * (ab * dc - bc * ac) + ac * (ab * cy - by_ * ac)) / det AS wb,
  (da * (db * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - db * ac)) / det AS wc FROM dt)
"""


def stacked(spark, sf):
    rows = backtest.stacking_design(forecast_paths(spark, sf).where("actual IS NOT NULL"), ["seasonal7", "moving_average7"], ["Rice"])
    return written(rows.withColumns({"bin": calibrate.horizon_bin(F.col("horizon")), "q": 1 / F.sqrt("horizon")}), "stacking")


@query("bt8_fit", with_sql(PATHS, STACK_SQL + "SELECT bin, round(wa, 5) AS r_seasonal7, round(wb, 5) AS r_moving_average7, round(wc, 5) AS h, round(my - wa * ma - wb * mb - wc * mc, 6) AS intercept FROM sw8"))
def bt8_fit(spark, sf):
    fit = backtest.fit_weighted(stacked(spark, sf), STACK, "y", "q", ["bin"], RIDGE)
    return fit.select("bin", *[F.round(F.col("weights")[k], 5).alias(c) for k, c in enumerate(STACK)], r6("intercept").alias("intercept"))


@query("bt8_predict", with_sql(PATHS, STACK_SQL + """SELECT series, origin, horizon, round(anchor * (1 + greatest(-0.5, least(0.5, my + wa * (a - ma) + wb * (b - mb) + wc * (c - mc)))), 4) AS price FROM sd JOIN sw8 USING (bin)"""))
def bt8_predict(spark, sf):
    rows = stacked(spark, sf)
    fit = backtest.fit_weighted(rows, STACK, "y", "q", ["bin"], RIDGE)
    return backtest.stacked_prices(rows, fit, STACK, ["bin"]).select("series", "origin", "horizon", F.round("price", 4).alias("price"))


PARTS = PATHS + """,
od AS (SELECT origin, row_number() OVER (ORDER BY origin) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT origin FROM paths)),
cu AS (SELECT origin AS cutoff FROM od WHERE i = floor(n * 2.0 / 3)),
parts AS (SELECT paths.*, CASE WHEN date <= cutoff THEN 'tuning' WHEN origin >= cutoff THEN 'calibration' END AS part FROM paths, cu),
tun AS (SELECT * FROM parts WHERE part = 'tuning' AND actual IS NOT NULL),
bins AS (SELECT *, CASE WHEN horizon <= 3 THEN '01-03' WHEN horizon <= 7 THEN '04-07' WHEN horizon <= 14 THEN '08-14' WHEN horizon <= 21 THEN '15-21'
  ELSE '22-30' END AS bin FROM tun)
"""


def tuning(spark, sf):
    return calibrate.split_forecasts(forecast_paths(spark, sf)).where("part = 'tuning'")


@query("ca1_split", with_sql(PARTS, "SELECT part, origin, count(*) AS n FROM parts WHERE part IS NOT NULL GROUP BY ALL"))
def ca1(spark, sf):
    return calibrate.split_forecasts(forecast_paths(spark, sf)).groupBy("part", "origin").agg(F.count("*").alias("n"))


G01 = "SELECT unnest(range(0, 101)) / 100 AS {}"


@query("ca2_blend_weight", with_sql(PARTS, f""", e AS (SELECT w, round(avg(abs((1 - w) * seasonal7 + w * moving_average7 - actual)), 9) AS mae FROM tun, ({G01.format('w')}) GROUP BY w)
  SELECT arg_min(w, (mae, w)) AS weight, round(min(mae), 6) AS mae FROM e"""))
def ca2(spark, sf):
    return calibrate.blend_weight(tuning(spark, sf), "seasonal7", "moving_average7").select("weight", r6("mae").alias("mae"))


def score_sql(f: str) -> str:
    """MAE, RMSE and MAPE of ``f``, each over that of persistence, summed."""
    pairs = [("avg(abs({} - actual))",), ("sqrt(avg(({} - actual) ** 2))",), ("avg(abs(({} - actual) / actual))",)]
    return "round(" + " + ".join(f"{m.format(f)} / greatest({m.format('persistence')}, 1e-12)" for (m,) in pairs) + ", 9)"


#: Each layer from the path that the earlier ones give: ``ly2`` has the blend, ``ly3`` the horizon's trust, and so on.
LAYERED = PARTS + f""",
bw AS (SELECT arg_min(w, (mae, w)) AS weight, min(mae) AS mae FROM (SELECT w, round(avg(abs((1 - w) * {{a}} + w * {{b}} - actual)), 9) AS mae
  FROM tun, ({G01.format('w')}) GROUP BY w)),
ly2 AS (SELECT tun.*, (1 - weight) * {{a}} + weight * {{b}} AS f2 FROM tun, bw WHERE actual <> 0),
hn AS (SELECT h AS horizon, (SELECT count(*) FROM ly2 WHERE horizon = h) AS n FROM (SELECT CAST(unnest(range(1, 31)) AS INT) AS h)),
bh AS (SELECT horizon, any_value(n) AS n, arg_min(t, (score, t)) AS trust FROM (
  SELECT hn.horizon, n, t, {score_sql('(persistence + t * (f2 - persistence))')} AS score
  FROM hn JOIN ly2 ON ly2.horizon = hn.horizon OR n < 2, ({G01.format('t')}) GROUP BY hn.horizon, n, t) GROUP BY horizon),
ly3 AS (SELECT ly2.*, persistence + trust * (f2 - persistence) AS f3 FROM ly2 JOIN bh USING (horizon)),
bc AS (SELECT product_category, horizon, any_value(n) AS n, CASE WHEN any_value(n) < 10 THEN 1.0 ELSE arg_min(t, (score, t)) END AS trust FROM (
  SELECT product_category, horizon, t, count(*) AS n, {score_sql('(persistence + t * (f3 - persistence))')} AS score
  FROM ly3, (SELECT unnest(range(0, 21)) * 5 / 100 AS t) GROUP BY product_category, horizon, t) GROUP BY product_category, horizon),
ly4 AS (SELECT ly3.*, persistence + trust * (f3 - persistence) AS f4 FROM ly3 JOIN bc USING (product_category, horizon)),
gr AS (SELECT * FROM (SELECT unnest([0.15, 0.2, 0.25, 0.3, 0.5, 0.75, 1.0])::DOUBLE AS threshold),
  (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS strength), (SELECT unnest([1.0, 3.0, 7.0, 14.0])::DOUBLE AS decay)),
mv AS (SELECT threshold, strength, decay, actual, persistence, abs(ln(anchor / moving_average7)) > threshold AS hit,
  CASE WHEN hit THEN f4 + strength * (1 - exp(-horizon / decay)) * (moving_average7 - f4) ELSE f4 END AS f FROM ly4, gr),
ba AS (SELECT coalesce(threshold, 1e9) AS threshold, coalesce(strength, 0.0) AS strength, coalesce(decay, 1.0) AS decay, coalesce(score, base) AS score, base
  FROM (SELECT {score_sql('f4')} AS base FROM ly4)
  LEFT JOIN (SELECT threshold, strength, decay, bool_or(hit) AS hits, {score_sql('f')} AS score FROM mv GROUP BY ALL) ON hits AND score < base
  ORDER BY score, threshold, strength, decay LIMIT 1),
b1r AS (SELECT threshold, strength, decay FROM ba),
ly5 AS (SELECT ly4.*, CASE WHEN abs(ln(anchor / moving_average7)) > threshold
  THEN f4 + strength * (1 - exp(-horizon / decay)) * (moving_average7 - f4) ELSE f4 END AS f5 FROM ly4, b1r),
og AS (SELECT origin, row_number() OVER (ORDER BY origin) AS i, count(*) OVER () AS k FROM (SELECT DISTINCT origin FROM ly5)),
hv AS (SELECT product_category, product_name, CASE WHEN horizon <= 3 THEN '01-03' WHEN horizon <= 7 THEN '04-07' WHEN horizon <= 14 THEN '08-14'
  WHEN horizon <= 21 THEN '15-21' ELSE '22-30' END AS bin, origin <= (SELECT origin FROM og WHERE k >= 4 AND i = k // 2) AS early, actual, f5,
  unnest([{{a}}, persistence, moving_average7]) AS v, unnest(['{{a}}', 'persistence', 'moving_average7']) AS alternative, unnest([0, 1, 2]) AS place FROM ly5),
er AS (SELECT product_category, product_name, bin, early, alternative, place, w, count(*) AS n, avg(abs(f5 - actual)) AS b1, sqrt(avg((f5 - actual) ** 2)) AS b2,
  avg(abs((f5 - actual) / actual)) AS b3, avg(abs((1 - w) * f5 + w * v - actual)) AS e1, sqrt(avg(((1 - w) * f5 + w * v - actual) ** 2)) AS e2,
  avg(abs(((1 - w) * f5 + w * v - actual) / actual)) AS e3 FROM hv, (SELECT unnest(range(1, 11)) * 5 / 100 AS w) WHERE early IS NOT NULL GROUP BY ALL),
rt AS (SELECT *, round((e1 / b1 + e2 / b2 + e3 / b3) / 3, 9) AS mr, e1 < b1 AND e2 < b2 AND e3 < b3 AND round((e1 / b1 + e2 / b2 + e3 / b3) / 3, 9) <= 0.9975 AS ok
  FROM er WHERE n >= 20 AND b1 > 1e-12 AND b2 > 1e-12 AND b3 > 1e-12),
pk AS (SELECT product_category, product_name, bin, early, arg_min(alternative, (mr, place, w)) AS alternative, arg_min(w, (mr, place, w)) AS w
  FROM rt WHERE mr < 1 GROUP BY ALL),
bs AS (SELECT product_category, product_name, bin, p.alternative, least(p.w, q.w) AS weight
  FROM pk p JOIN pk q USING (product_category, product_name, bin, alternative)
  JOIN rt rp USING (product_category, product_name, bin, alternative) JOIN rt rq USING (product_category, product_name, bin, alternative)
  WHERE p.early AND NOT q.early AND rp.w = p.w AND NOT rp.early AND rp.ok AND rq.w = q.w AND rq.early AND rq.ok)
"""
BASELINES = ("seasonal7", "moving_average7")
BASE_LAYERED = LAYERED.replace("{a}", BASELINES[0]).replace("{b}", BASELINES[1])


def layer_of(spark, sf, layer):
    """The parameters of a layer, fitted after those before it on the tuning rows, which are written once."""
    return calibrate.fit_layers(written(tuning(spark, sf), "tuning"), *BASELINES, [BASELINES[0], "persistence", "moving_average7"], written, layer)[layer]


@query("ca3_horizon_trust", with_sql(BASE_LAYERED, "SELECT horizon, n, trust FROM bh"))
def ca3(spark, sf):
    return layer_of(spark, sf, "horizon")


@query("ca4_category_trust", with_sql(BASE_LAYERED, "SELECT product_category, horizon, n, trust FROM bc"))
def ca4(spark, sf):
    return layer_of(spark, sf, "category")


@query("ca5_reversion", with_sql(BASE_LAYERED, "SELECT threshold, strength, decay, round(score, 6) AS score, round(base, 6) AS base FROM ba"))
def ca5(spark, sf):
    return layer_of(spark, sf, "anomaly").withColumns({"score": r6("score"), "base": r6("base")})


@query("ca6_references", with_sql(PANEL, """, k AS (SELECT * FROM panel WHERE price_index IS NOT NULL) SELECT series, report_date, round(avg(price_index) OVER (PARTITION BY series
  ORDER BY report_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) + 3e-8, 6) AS mean_7, """ + ", ".join(f"round(quantile_cont(price_index, 0.5) OVER (PARTITION BY series ORDER BY report_date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) + 3e-8, 6) AS median_{w}" for w in (7, 14, 30)) + " FROM k"))
def ca6(spark, sf):
    return calibrate.references(daily_panel(spark, sf)).select("series", "report_date", *[r6(F.col(c) + 3e-8).alias(c) for c in ("mean_7", "median_7", "median_14", "median_30")])


@query("ca7_bins", with_sql(PARTS, "SELECT bin, count(*) AS n FROM bins GROUP BY 1"))
def ca7(spark, sf):
    return tuning(spark, sf).where("actual IS NOT NULL").groupBy(calibrate.horizon_bin(F.col("horizon")).alias("bin")).agg(F.count("*").alias("n"))


@query("ca8_specialists", with_sql(BASE_LAYERED, "SELECT product_category, product_name, bin, alternative, weight FROM bs"))
def ca8(spark, sf):
    return layer_of(spark, sf, "special")


SWITCHES = [("all", ""), *[(f"no_{layer}", layer) for layer in calibrate.LAYERS]]

BLEND = BASE_LAYERED + f""",
sw AS (SELECT * FROM (VALUES {', '.join(f"('{name}', '{off}')" for name, off in SWITCHES)}) v(layer, off)),
b1 AS (SELECT p.*, layer, off, CASE WHEN off = 'weight' THEN 0 ELSE bw.weight END AS w, CASE WHEN off = 'horizon' THEN 1
  ELSE coalesce(bh.trust, 1) END AS th, CASE WHEN off = 'category' THEN 1 ELSE coalesce(bc.trust, 1) END AS tc,
  threshold, strength, decay, CASE WHEN off = 'special' THEN NULL WHEN bs.alternative = 'seasonal7' THEN seasonal7
  WHEN bs.alternative = 'moving_average7' THEN moving_average7 WHEN bs.alternative = 'persistence' THEN persistence END AS picked, bs.weight AS x
  FROM parts p CROSS JOIN bw CROSS JOIN b1r CROSS JOIN sw LEFT JOIN bh ON bh.horizon = p.horizon LEFT
  JOIN bc ON bc.horizon = p.horizon AND bc.product_category = p.product_category
  LEFT JOIN bs ON bs.product_category = p.product_category AND bs.product_name = p.product_name AND bs.bin = CASE WHEN p.horizon <= 3 THEN '01-03' WHEN p.horizon <= 7 THEN '04-07'
  WHEN p.horizon <= 14 THEN '08-14' WHEN p.horizon <= 21 THEN '15-21' ELSE '22-30' END WHERE part = 'calibration'),
b2 AS (SELECT *, persistence + th * tc * ((1 - w) * seasonal7 + w * moving_average7 - persistence) AS e1 FROM b1),
b3 AS (SELECT *, CASE WHEN off <> 'anomaly'
  AND abs(ln(anchor / moving_average7)) > threshold THEN e1 + strength * (1 - exp(-horizon / decay)) * (moving_average7 - e1) ELSE e1 END AS e2
  FROM b2),
bl AS (SELECT *, CASE WHEN picked IS NOT NULL THEN e2 + x * (picked - e2) ELSE e2 END AS ensemble FROM b3)
"""


def layered(spark, sf, raw=raw_prices):
    """Calibration rows with the parameters of all layers, fitted on the tuning rows; the forecasts are computed once, and kept as a row per series and origin."""
    folded = written(folded_forecasts(spark, sf, raw), "paths")
    cut = written(calibrate.cutoff(folded), "cutoff")
    rows = calibrate.parted(backtest.unfolded(folded).join(F.broadcast(cut)))  # one row
    found = calibrate.fit_layers(rows.where("part = 'tuning'"), *BASELINES, [BASELINES[0], "persistence", "moving_average7"], written)
    return calibrate.with_layers(rows.where("part = 'calibration'"), **found)


@query("ca9_blend", with_sql(BLEND, "SELECT series, origin, horizon, round(ensemble + 3e-7, 5) AS ensemble FROM bl WHERE layer = 'all'"))
def ca9(spark, sf):
    return layered(spark, sf).select("series", "origin", "horizon", F.round(calibrate.blended("seasonal7", "moving_average7") + 3e-7, 5).alias("ensemble"))


@query("ca10_ablation", with_sql(BLEND, """SELECT layer, count(*) AS n, round(avg(abs(ensemble - actual)), 5) AS mae, round(sqrt(avg((ensemble - actual) ** 2)), 5) AS rmse,
round(avg(CASE WHEN actual <> anchor THEN CAST(sign(round(ensemble - anchor, 9)) = sign(actual - anchor) AS INT) END), 5) AS direction FROM bl
  WHERE actual IS NOT NULL GROUP BY 1"""))
def ca10(spark, sf):
    """The blend, and the blend without each of its layers, in one pass over the rows."""
    switch = F.explode(F.array(*[F.struct(F.lit(name).alias("layer"), F.lit(off).alias("off")) for name, off in SWITCHES])).alias("s")
    rows = layered(spark, sf).where("actual IS NOT NULL").select("*", switch).select("*", "s.layer", "s.off")
    rows = rows.withColumn("ensemble", calibrate.blended("seasonal7", "moving_average7", {layer: F.col("off") != layer for layer in calibrate.LAYERS}))
    e = F.col("ensemble") - F.col("actual")
    right = (F.signum(F.round(F.col("ensemble") - F.col("anchor"), 9)) == F.signum(F.col("actual") - F.col("anchor"))).cast("int")
    return rows.groupBy("layer").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 5).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 5).alias("rmse"), F.round(F.avg(F.when(F.col("actual") != F.col("anchor"), right)), 5).alias("direction"))


@query("ca11_residual_bias", with_sql(PARTS, """, r AS (SELECT *, (actual - moving_average7) / moving_average7 AS r FROM bins), b AS (SELECT bin, avg(r) AS bb FROM r GROUP BY 1)
SELECT product_category, r.bin, count(*) AS n, round(any_value(bb), 6) AS bin_bias,
  round((count(*) * avg(r) + 50 * any_value(bb)) / (count(*) + 50), 6) AS bias FROM r JOIN b USING (bin) GROUP BY ALL"""))
def ca11(spark, sf):
    return calibrate.residual_bias(tuning(spark, sf), "moving_average7", ["product_category"]).select("product_category", "bin", "n", r6("bin_bias").alias("bin_bias"), r6("bias").alias("bias"))


@query("ca12_regime_trust", with_sql(PARTS, """, mid AS (SELECT quantile_cont(origin - DATE '1970-01-01', 0.5) AS m FROM bins),
hv AS (SELECT bin, CAST(sign(moving_average7 / anchor - 1) AS INT) AS sign, CASE WHEN abs(moving_average7 / anchor - 1) < 0.01 THEN 'small'
  WHEN abs(moving_average7 / anchor - 1) < 0.05 THEN 'middle' ELSE 'large' END AS size,
  CASE WHEN origin - DATE '1970-01-01' <= m THEN 0 ELSE 1 END AS half, actual, anchor, moving_average7 AS f FROM bins, mid),
s AS (SELECT bin, sign, size, half, alpha, round(avg(abs(anchor + alpha * (f - anchor) - actual)), 9) AS mae
  FROM hv, (SELECT unnest(range(0, 16)) / 10 AS alpha) GROUP BY ALL),
b AS (SELECT bin, sign, size, 1 - half AS half, arg_min(alpha, (mae, abs(alpha - 1), alpha)) AS alpha FROM s GROUP BY bin, sign, size, half),
c AS (SELECT b.*, s.mae <= 0.9975 * p.mae AS ok FROM b JOIN s USING (bin, sign, size, half, alpha)
  JOIN s p ON p.bin = b.bin AND p.sign = b.sign AND p.size = b.size AND p.half = b.half AND p.alpha = 1.0)
SELECT bin, sign, size, CASE WHEN bool_and(ok) AND count(*) = 2 THEN arg_min(alpha, (abs(alpha - 1), alpha)) ELSE 1.0 END AS alpha FROM c GROUP BY bin, sign, size"""))
def ca12(spark, sf):
    return calibrate.regime_trust(tuning(spark, sf), "moving_average7")


@query("ca13_baseline_blend", with_sql(PARTS, """, s AS (SELECT product_name, bin, w, avg(abs((1 - w) * persistence + w * moving_average7 - actual)) AS mae
  FROM bins, (SELECT unnest(range(0, 21)) * 5 / 100 AS w) GROUP BY ALL),
z AS (SELECT s.*, o.mae AS zero, round(s.mae + 0.01 * s.w * o.mae, 9) AS sc FROM s JOIN s o ON o.product_name = s.product_name AND o.bin = s.bin AND o.w = 0),
x AS (SELECT product_name, bin, arg_min(w, (sc, w)) AS w, arg_min(mae, (sc, w)) AS mae, any_value(zero) AS zero FROM z GROUP BY ALL)
SELECT product_name, bin, CASE WHEN mae <= 0.995 * zero THEN w ELSE 0.0 END AS weight FROM x"""))
def ca13(spark, sf):
    return calibrate.baseline_blend(tuning(spark, sf).withColumn("bin", calibrate.horizon_bin(F.col("horizon"))), "persistence", "moving_average7", ["product_name", "bin"])


#: The fitted model: its columns, as the recursion computes them day by day.
MODEL = ["own", "gap", "peer"]

#: ``paths`` with a column ``model``: fitted on the days before the first origin, then moved day by day.
FITTED_PATHS = (
    PATHS.replace("\npaths AS (", "\npaths0 AS (")
    + RETURNS.replace("\n, l AS (", ", l AS (", 1)
    + f""",
ch AS (SELECT product_category, report_date, price_index / lag(price_index) OVER (PARTITION BY series ORDER BY report_date) - 1 AS r FROM panel),
pl AS (SELECT product_category, report_date, coalesce(lag(m) OVER (PARTITION BY product_category ORDER BY report_date), 0) AS peer
  FROM (SELECT product_category, report_date, quantile_cont(r, 0.5) AS m FROM ch GROUP BY ALL)),
m7 AS (SELECT series, report_date, avg(price_index) OVER (PARTITION BY series ORDER BY report_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean_7 FROM panel),
k AS (SELECT r1 AS a, l1 / mean_7 - 1 AS b, peer AS c, p.observed_price / l1 - 1 AS y FROM r JOIN panel p USING (series, report_date) JOIN m7 USING (series, report_date)
  JOIN pl ON pl.product_category = p.product_category AND pl.report_date = p.report_date
  WHERE p.is_observed AND l1 <> 0 AND r1 IS NOT NULL AND p.report_date < DATE '{START}'),{SOLVED}"""
    + recursion_steps("wa", "wb", "wc", "(my - wa * ma - wb * mb - wc * mc)", ", v")
    + """,
mp AS (SELECT origin, series, h AS horizon, l[n0 + h] AS model FROM s30, (SELECT CAST(unnest(range(1, 31)) AS INT) AS h)),
paths AS (SELECT paths0.*, mp.model FROM paths0 JOIN mp USING (series, origin, horizon))
"""
)
FITTED_PARTS = FITTED_PATHS + PARTS[len(PATHS) :]
FITTED_BLEND = FITTED_PARTS + (LAYERED[len(PARTS) :] + BLEND[len(BASE_LAYERED) :].replace("seasonal7", "model")).replace("{a}", "model").replace("{b}", "moving_average7")


def model_rows(panel):
    """FE columns of the recursion beside the next day's relative change, of observed days."""
    rows = features.price_windows(panel).join(features.peer_returns(panel), ["product_category", "report_date"])
    target = F.when(F.col("is_observed"), features.relative_target(F.col("observed_price"), F.col("lag_1")))
    return rows.select("series", "report_date", F.col("return_1").alias("own"), (F.col("lag_1") / F.col("mean_7") - 1).alias("gap"), F.col("peer_lag_1").alias("peer"), target.alias("target"))


def fitted_paths(spark, sf):
    """The baseline paths with those of the fitted model; the model is fitted before the first origin, saved, and read by its version."""
    panel = written(daily_panel(spark, sf), "panel")
    root = store.shared_folder(spark, "models")
    version = store.save_model(spark, root, MODEL, backtest.fit_relative(model_rows(panel).where(F.col("report_date") < F.lit(START).cast("date")), MODEL, ridge=RIDGE))
    weights, intercept = store.read_model(spark, root, version)
    anchored = written(backtest.anchors(panel, backtest.origins(spark, START, END)), "anchors")
    moved = backtest.recursive_paths(anchored, weights, intercept).select("series", "origin", "horizon", F.col("price").alias("model"))
    return backtest.paths(anchored, panel).join(moved, ["series", "origin", "horizon"])


@query("bt6_fitted", with_sql(FITTED_PATHS, "SELECT series, origin, horizon, round(model, 4) AS price, actual FROM paths"))
def bt6_fitted(spark, sf):
    """Paths of the fitted model beside the truth."""
    return fitted_paths(spark, sf).select("series", "origin", "horizon", F.round("model", 4).alias("price"), "actual")


@query("ca9_fitted", with_sql(FITTED_BLEND, "SELECT series, origin, horizon, round(ensemble + 3e-6, 4) AS ensemble FROM bl WHERE layer = 'all'"))
def ca9_fitted(spark, sf):
    """The blend of the fitted model and the week's mean, all layers fitted on the tuning rows."""
    rows = written(calibrate.split_forecasts(fitted_paths(spark, sf)), "paths")
    found = calibrate.fit_layers(rows.where("part = 'tuning'"), "model", "moving_average7", ["model", "persistence", "moving_average7"], written)
    blended = calibrate.with_layers(rows.where("part = 'calibration'"), **found)
    return blended.select("series", "origin", "horizon", F.round(calibrate.blended("model", "moving_average7") + 3e-6, 4).alias("ensemble"))


@query("pn1_many_series", with_sql(many(PANEL), "SELECT series, report_date, price_index, observed_price, is_observed FROM panel"))
def pn1_many(spark, sf):
    return daily_panel(spark, sf, many_prices).select("series", "report_date", "price_index", "observed_price", "is_observed")


@query("fe4_many_series", with_sql(many(PANEL), ROLLED))
def fe4_many(spark, sf):
    out = features.rolling(daily_panel(spark, sf, many_prices))
    return out.select("series", "report_date", *[near6(F.col(f"{n}_{w}") + 3e-8).alias(f"{n}_{w}") for w in features.WINDOWS for n in ("mean", "std", "min", "max")])


@query("bt3_many_series", with_sql(many(PATHS), "SELECT series, origin, horizon, date, persistence, seasonal7, actual FROM paths"))
def bt3_many(spark, sf):
    return forecast_paths(spark, sf, many_prices).select("series", "origin", "horizon", "date", "persistence", "seasonal7", "actual")


@query("ca9_many_series", with_sql(many(BLEND), "SELECT series, origin, horizon, round(ensemble + 3e-7, 5) AS ensemble FROM bl WHERE layer = 'all'"))
def ca9_many(spark, sf):
    return layered(spark, sf, many_prices).select("series", "origin", "horizon", F.round(calibrate.blended("seasonal7", "moving_average7") + 3e-7, 5).alias("ensemble"))


#: A day whose prices were corrected ten days later.
CORRECTED = "1999-06-24"


@query("fe18_replay", with_sql(PATHS, f""", a AS (SELECT p.series, o.origin, n.price_index IS NOT NULL OR n.report_date IS NOT NULL AS there, p.observed_price, p.report_date
  FROM panel p JOIN o0 o ON p.report_date = o.origin JOIN panel n ON n.series = p.series AND n.report_date = o.origin + 1),
k AS (SELECT a.series, a.origin, a.observed_price FROM a WHERE EXISTS (SELECT 1 FROM panel q WHERE q.series = a.series AND q.observed_price IS NOT NULL AND q.report_date BETWEEN a.origin - 37 AND a.origin))
SELECT origin, count(*) AS compared, CAST(0 AS BIGINT) AS unmatched, count(*) FILTER (origin = DATE '{CORRECTED}' AND observed_price IS NOT NULL) AS differing FROM k GROUP BY origin"""))
def fe18_replay(spark, sf):
    """Features replayed at every origin against those of one pass over the corrected prices; at one origin these know what came later."""
    panel = written(daily_panel(spark, sf), "panel")
    seen = panel.where("observed_price IS NOT NULL").select("series", "report_date", "observed_price")
    day = F.lit(CORRECTED).cast("date")
    right = F.when(F.col("report_date") == day, F.col("observed_price") + 5).otherwise(F.col("observed_price"))
    versions = seen.withColumn("available_on", F.col("report_date")).unionByName(seen.where(F.col("report_date") == day).withColumns({"observed_price": right, "available_on": F.date_add("report_date", 10)}))
    days = backtest.origins(spark, START, END)
    replay = features.replayed(versions, days)
    corrected = panel.withColumn("observed_price", right).withColumn("price_index", fill())
    once = features.price_windows(corrected).join(F.broadcast(days), F.col("report_date") == F.date_add("origin", 1))
    # series that have a row after the origin and were seen within reach of it
    once = once.join(replay.select("series", "origin"), ["series", "origin"], "left_semi")
    ends = panel.groupBy("series").agg(F.max("report_date").alias("hi"))
    replay = replay.join(ends, "series").where(F.col("origin") < F.col("hi"))
    return features.leaks(replay, once)
