"""CL and PN queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricepanel.operators import clean, panel

from .base import CLEAN, PANEL, RAW, clean_prices, daily_panel, query, r6, raw_prices, with_sql, written

KEY = "product_category, product_name, product_variant, origin, unit"


@query("cl1_coerce", with_sql(RAW, """SELECT id, product_category, product_name, coalesce(product_variant, 'Unknown') AS product_variant, coalesce(trim(unit), 'Unknown') AS unit,
  report_date, price_index FROM raw"""))
def cl1(spark, sf):
    return clean.coerce(raw_prices(spark, sf)).select("id", "product_category", "product_name", "product_variant", "unit", "report_date", "price_index")


#: Variants, products and units that the tables lack, planted by the row's id.
PLANTED_VARIANT = "CASE id % 7 WHEN 0 THEN 'null' WHEN 1 THEN '' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'NULL' ELSE product_variant END"
PLANTED_PRODUCT = {
    "product_category": "CASE id % 5 WHEN 0 THEN 'Oils' WHEN 1 THEN 'Coconut Oils' ELSE product_category END",
    "product_name": "CASE id % 11 WHEN 0 THEN 'Chicken Egg' WHEN 1 THEN 'Chicken Egg, brown' ELSE product_name END",
    "product_variant": "CASE id % 3 WHEN 0 THEN '1L' WHEN 1 THEN '350ml' ELSE product_variant END",
    "unit": "CASE id % 13 WHEN 0 THEN 'Btl' WHEN 1 THEN ' 350 ML' WHEN 2 THEN '1 Liter' WHEN 3 THEN 'per piece' WHEN 4 THEN '' ELSE unit END",
}


@query("cl2_variant", with_sql(RAW, f"""SELECT CASE WHEN v IS NULL OR v IN ('', 'Unknown', 'null') THEN 'Standard' ELSE v END AS product_variant, count(*) AS n
  FROM (SELECT {PLANTED_VARIANT} AS v FROM raw) GROUP BY 1"""))
def cl2(spark, sf):
    return raw_prices(spark, sf).withColumn("product_variant", clean.default_variant(F.expr(PLANTED_VARIANT))).groupBy("product_variant").agg(F.count("*").alias("n"))


@query("cl3_unit", with_sql(RAW, f"""SELECT product_category, CASE WHEN product_name = 'Chicken Egg' THEN 'piece' WHEN product_category = 'Oils' AND lower(product_variant) = '1l' THEN 'liter'
  WHEN product_category = 'Oils' AND lower(product_variant) = '350ml' THEN '350ml' ELSE CASE lower(trim(coalesce(unit, 'unknown'))) WHEN 'per kg' THEN 'kg' WHEN 'kilogram' THEN 'kg'
  WHEN 'btl' THEN 'bottle' WHEN '350 ml' THEN '350ml' WHEN '1 liter' THEN 'liter' WHEN 'per piece' THEN 'piece' ELSE lower(trim(coalesce(unit, 'unknown'))) END END AS unit, count(*) AS n
  FROM (SELECT {', '.join(f"{e} AS {c}" for c, e in PLANTED_PRODUCT.items())} FROM raw) GROUP BY 1, 2"""))
def cl3(spark, sf):
    planted = raw_prices(spark, sf).select(*[F.expr(e).alias(c) for c, e in PLANTED_PRODUCT.items()])
    unit = clean.normalise_unit(*[F.col(c) for c in ("unit", "product_category", "product_name", "product_variant")])
    return planted.withColumn("unit", unit).groupBy("product_category", "unit").agg(F.count("*").alias("n"))


@query("cl4_infer_unit", with_sql(CLEAN, f"SELECT {KEY}, count(*) AS n FROM c2 GROUP BY {KEY}"))
def cl4(spark, sf):
    return clean_prices(spark, sf).groupBy(*clean.SERIES_KEY).agg(F.count("*").alias("n"))


@query("cl5_valid", with_sql(RAW, "SELECT product_category, count(*) AS n, round(sum(price_index), 4) AS total FROM raw WHERE price_index > 0 GROUP BY 1"))
def cl5(spark, sf):
    return clean.valid_rows(clean.coerce(raw_prices(spark, sf))).groupBy("product_category").agg(F.count("*").alias("n"), F.round(F.sum("price_index"), 4).alias("total"))


@query("cl6_source_date", with_sql(RAW, r"""SELECT id, CAST(strptime(regexp_extract(source_pdf, '([A-Za-z]+-\d{1,2}-\d{4})', 1), '%B-%-d-%Y') AS DATE) AS source_date FROM raw"""))
def cl6(spark, sf):
    return raw_prices(spark, sf).select("id", clean.source_date(F.col("source_pdf")).alias("source_date"))


@query("cl7_observed", with_sql(CLEAN, "SELECT series, report_date, is_observed, observed_price FROM clean"))
def cl7(spark, sf):
    return clean_prices(spark, sf).select("series", "report_date", "is_observed", "observed_price")


@query("cl8_conflicts", with_sql(RAW, """SELECT product_category, product_name, coalesce(product_variant, 'Standard') AS product_variant, report_date, min(price_index) AS lowest,
  max(price_index) AS highest, count(*) AS n FROM raw0 WHERE is_observed GROUP BY ALL HAVING min(price_index) <> max(price_index)"""))
def cl8(spark, sf):
    from .base import table

    lines = table(spark, sf, "lineitem").where("l_linestatus = 'O'").select("l_partkey", "l_shipdate", "l_discount", "l_returnflag")
    parts = table(spark, sf, "part").select("p_partkey", "p_type", "p_retailprice")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.expr("CASE WHEN p_type IN ('ECONOMY','PROMO') THEN 'Rice' WHEN p_type IN ('SMALL','MEDIUM') THEN 'Vegetables' ELSE 'Fish' END").alias("product_category"),
        F.col("p_type").alias("product_name"), clean.default_variant(F.expr("nullif(l_returnflag, 'N')")).alias("product_variant"), F.lit("all").alias("origin"), F.lit("kg").alias("unit"),
        F.to_date("l_shipdate").alias("report_date"), F.expr("CAST(CAST(p_retailprice AS DECIMAL(10,2)) * (1 - CAST(l_discount AS DECIMAL(10,2))) AS DOUBLE)").alias("observed_price"),
    )
    return clean.conflicts(rows).drop("origin", "unit")


@query("cl9_dedup", with_sql(CLEAN, f"SELECT {KEY}, report_date, id, is_observed FROM clean"))
def cl9(spark, sf):
    return clean_prices(spark, sf).select(*clean.SERIES_KEY, "report_date", "id", "is_observed")


@query("cl10_repair", with_sql(RAW, """, m AS (SELECT *, max(product_variant = 'A') OVER w AS std, row_number() OVER (PARTITION BY product_name, origin, report_date
  ORDER BY (product_variant IS NULL) DESC, id) AS rn FROM raw WINDOW w AS (PARTITION BY product_name, origin, report_date))
SELECT id, product_name, coalesce(CASE product_variant WHEN 'A' THEN 'Standard' ELSE product_variant END, 'Standard') AS product_variant FROM m
  WHERE product_variant IS NOT NULL OR (NOT coalesce(std, false) AND rn = 1)"""))
def cl10(spark, sf):
    rows = raw_prices(spark, sf).withColumn("product_variant", F.when(F.col("product_variant") == "A", "Standard").otherwise(F.col("product_variant")))
    return clean.repair_variants(rows).select("id", "product_name", "product_variant")


@query("cl11_gap_fill", with_sql(CLEAN, """, g AS (SELECT * FROM clean WHERE dayofweek(report_date) NOT IN (0, 6)),
cal AS (SELECT CAST(unnest(generate_series(DATE '1996-12-25', DATE '1997-12-31', INTERVAL 1 DAY)) AS DATE) AS day),
rec AS (SELECT day, r.report_date FROM cal LEFT JOIN (SELECT DISTINCT report_date FROM g) r ON day = r.report_date),
f AS (SELECT day, last_value(report_date IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS from_day, report_date FROM rec)
SELECT f.day AS report_date, count(*) AS n, round(sum(price_index), 4) AS total FROM g JOIN f ON g.report_date = f.from_day
  WHERE f.report_date IS NULL AND f.day >= DATE '1997-01-01' GROUP BY 1"""))
def cl11(spark, sf):
    rows = clean_prices(spark, sf).where("weekday(report_date) < 5")
    filled = clean.fill_missing_days(rows, "1997-01-01", "1997-12-31")
    return filled.where("is_copy").groupBy("report_date").agg(F.count("*").alias("n"), F.round(F.sum("price_index"), 4).alias("total"))


@query("cl12_quarantine", with_sql(RAW, """, q AS (SELECT *, CASE WHEN product_category IN ('Rice', 'Vegetables') THEN '' ELSE 'category' END AS a, CASE WHEN unit IS NULL THEN 'unit'
  ELSE '' END AS b,
  CASE WHEN count(*) OVER (PARTITION BY source_pdf, product_name, product_variant, origin) > 1 THEN 'duplicate' ELSE '' END AS c FROM raw),
r AS (SELECT source_pdf, concat_ws(',', nullif(a, ''), nullif(b, ''), nullif(c, '')) AS reasons FROM q),
d AS (SELECT source_pdf, max(reasons <> '') AS rejected FROM r GROUP BY 1)
SELECT reasons, rejected, count(*) AS n FROM r JOIN d USING (source_pdf) GROUP BY ALL"""))
def cl12(spark, sf):
    return clean.quarantine(raw_prices(spark, sf), ["rice", "VEGETABLES"]).groupBy("reasons", "rejected").agg(F.count("*").alias("n"))


@query("cl13_source_audit", with_sql(RAW, """SELECT count(*) AS n, count(*) FILTER (is_observed) AS matches, count(*) FILTER (NOT is_observed) AS copied, CAST(0 AS BIGINT) AS later,
  CAST(0 AS BIGINT) AS unparsed FROM raw"""))
def cl13(spark, sf):
    return clean.source_audit(raw_prices(spark, sf))


@query("cl14_profile", with_sql(CLEAN, """, g AS (SELECT report_date - lag(report_date) OVER (PARTITION BY series ORDER BY report_date) AS gap FROM clean)
SELECT count(*) AS n, min(report_date) AS first_day, max(report_date) AS last_day, count(DISTINCT report_date) AS n_days,
  count(DISTINCT series) AS n_series, count(*) FILTER (observed_price IS NULL) AS null_observed,
count(DISTINCT unit) AS n_units, quantile_cont(price_index, 0.25) AS q25, quantile_cont(price_index, 0.5) AS q50, quantile_cont(price_index, 0.75) AS q75,
(SELECT count(*) FROM g WHERE gap > 1) AS n_gaps, (SELECT max(gap) FROM g) AS longest_gap FROM clean"""))
def cl14(spark, sf):
    return clean.profile(written(clean_prices(spark, sf), "clean"))


@query("cl15_catalog", with_sql(CLEAN, """SELECT product_name, product_variant, origin, unit, arg_min(product_category, (report_date, id)) AS product_category, md5(concat_ws('|',
  product_name, product_variant, origin, unit)) AS product_id FROM clean WHERE unit <> 'unknown' GROUP BY product_name, product_variant, origin, unit"""))
def cl15(spark, sf):
    return clean.catalog(clean_prices(spark, sf))


@query("pn1_daily_panel", with_sql(PANEL, "SELECT series, report_date, price_index, observed_price, is_observed FROM panel"))
def pn1(spark, sf):
    return daily_panel(spark, sf).select("series", "report_date", "price_index", "observed_price", "is_observed")


@query("pn2_extend", with_sql(CLEAN, """, d AS (SELECT series, CAST(unnest(generate_series(min(report_date), DATE '2002-01-31', INTERVAL 1 DAY)) AS DATE) AS report_date FROM clean
  GROUP BY series),
p AS (SELECT d.series, d.report_date, c.observed_price, last_value(c.observed_price IGNORE NULLS) OVER (PARTITION BY d.series
  ORDER BY d.report_date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS price_index FROM d LEFT JOIN clean c USING (series, report_date))
SELECT series, count(*) AS n, count(price_index) AS n_filled, max(report_date) AS last_day FROM p GROUP BY 1"""))
def pn2(spark, sf):
    return panel.extend_to(clean_prices(spark, sf), "2002-01-31").groupBy("series").agg(F.count("*").alias("n"), F.count("price_index").alias("n_filled"), F.max("report_date").alias("last_day"))


@query("pn3_as_of", with_sql(PANEL.replace("FROM clean GROUP BY series)", "FROM clean WHERE report_date <= DATE '1999-06-30' GROUP BY series)"), "SELECT series, report_date, price_index FROM panel"))
def pn3(spark, sf):
    return panel.as_of(clean_prices(spark, sf), "1999-06-30T15:59:59Z").select("series", "report_date", "price_index")


@query("pn4_label_audit", with_sql(PANEL, """SELECT count(*) AS n, count(*) FILTER (is_observed) AS observed, count(*) FILTER (is_observed AND report_date <= DATE '1999-12-31') AS available,
  count(*) FILTER (is_observed AND report_date > DATE '1999-12-31') AS after_cutoff, round(count(*) FILTER (is_observed
  AND report_date <= DATE '1999-12-31') / count(*), 6) AS coverage FROM panel"""))
def pn4(spark, sf):
    return panel.label_audit(daily_panel(spark, sf), "1999-12-31")


SPLIT = PANEL + """,
dd AS (SELECT report_date, row_number() OVER (ORDER BY report_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT report_date FROM panel)),
cuts AS (SELECT min(report_date) FILTER (i >= floor(n * 0.7)) AS a, min(report_date) FILTER (i >= floor(n * 0.85)) AS b FROM dd),
splits AS (SELECT panel.*, CASE WHEN report_date < a THEN 'train' WHEN report_date < b THEN 'validation' ELSE 'test' END AS split FROM panel, cuts)
"""


@query("pn5_split", with_sql(SPLIT, "SELECT split, report_date, count(*) AS n FROM splits GROUP BY ALL"))
def pn5(spark, sf):
    return panel.split(daily_panel(spark, sf), 0.7, 0.85).groupBy("split", "report_date").agg(F.count("*").alias("n"))


@query("pn6_bounds", with_sql(SPLIT, """SELECT split, min(report_date) AS first_day, max(report_date) AS last_day, count(*) AS n, count(*) FILTER (is_observed) AS observed FROM splits
  GROUP BY 1"""))
def pn6(spark, sf):
    return panel.split_bounds(panel.split(daily_panel(spark, sf), 0.7, 0.85))


@query("pn7_integrity", with_sql(CLEAN, """SELECT series, report_date, step FROM (SELECT series, report_date, report_date - lag(report_date) OVER (PARTITION BY series
  ORDER BY report_date) AS step FROM clean) WHERE step <> 1"""))
def pn7(spark, sf):
    return panel.violations(clean_prices(spark, sf))


@query("pn8_eligibility", with_sql(PANEL, """SELECT series, arg_max_null(price_index, report_date) AS last_price, max(CASE WHEN is_observed THEN report_date END) AS last_observed,
  count(*) FILTER (is_observed) AS n_observed,
CASE WHEN arg_max_null(price_index, report_date) IS NULL THEN 'unavailable' WHEN count(*) FILTER (is_observed) >= 30 THEN 'model'
  ELSE 'persistence' END AS served_by FROM panel GROUP BY 1"""))
def pn8(spark, sf):
    return panel.eligibility(daily_panel(spark, sf))
