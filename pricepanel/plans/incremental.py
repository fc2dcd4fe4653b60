"""Queries of what arrives in steps: streams run over tables that are written in batches, snapshots and publications.

Each stream is run to the end of what is there (``availableNow``) after every batch, with one checkpoint,
in a new folder of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.operators import backtest, features, panel, state, store, streams

from .backtests import PATHS, forecast_paths
from .base import CLEAN, PANEL, RAW, clean_prices, query, r6, raw_prices, table, with_sql, written
from .feature_plans import EMA, recursive_sql
from .signals import ART, articles


def run_in_batches(batches: list[DataFrame], name: str, start) -> str:
    """Write one batch after the other and run the stream after each; ``start(stream, root)`` gives the writer. Returns the root folder."""
    spark = batches[0].sparkSession
    root = store.shared_folder(spark, name)
    for batch in batches:
        batch.write.mode("append").parquet(f"{root}/input")
        stream = spark.readStream.schema(batch.schema).parquet(f"{root}/input")
        start(stream, root).trigger(availableNow=True).start().awaitTermination()
    return root


def sunk(spark, root: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/output")


def counted(counts):
    """Start a stream of counts: every micro-batch writes them all, as they stand, into a folder of its own."""

    def start(stream, root: str):
        def keep(rows: DataFrame, number: int) -> None:
            rows.write.mode("overwrite").parquet(f"{root}/output/batch={number}")

        return counts(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint")

    return start


def last_counts(spark, root: str) -> DataFrame:
    rows = spark.read.parquet(f"{root}/output")
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")


@query("st1_daily_views", "SELECT CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS product_id, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY ALL")
def st1(spark, sf):
    """Views in two batches: up to the middle day of the table, then the rest."""
    rows = table(spark, sf, "events").where("event_type = 'view'").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("product_id"))
    span = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    middle = F.lit(span["lo"] + (span["hi"] - span["lo"]) / 2) if span["lo"] else F.lit(None).cast("timestamp")
    return last_counts(spark, run_in_batches([rows.where(F.col("ts") <= middle), rows.where(F.col("ts") > middle)], "views", counted(streams.daily_views)))


@query("st5_news_volume", f"""WITH {ART}, a AS (SELECT unnest(products) AS product, published_date FROM art)
  SELECT CAST(published_date - k AS DATE) AS from_day, CAST(published_date - k + 7 AS DATE) AS to_day, product, count(*) AS n
  FROM a, (SELECT CAST(unnest(range(0, 7)) AS INT) AS k) GROUP BY ALL""")
def st5(spark, sf):
    """Articles in two batches by publication day."""
    rows = articles(spark, sf).select(F.explode("products").alias("product"), F.col("published_date").cast("timestamp").alias("created_at"))
    batches = [rows.where("created_at < DATE '1997-01-01'"), rows.where("created_at >= DATE '1997-01-01'")]
    return last_counts(spark, run_in_batches(batches, "volume", counted(streams.news_volume)))


@query("st2_ingest", with_sql(RAW, """SELECT product_name, coalesce(product_variant, 'Standard') AS product_variant, origin, report_date,
round(price_index + CASE WHEN report_date >= DATE '1998-07-01' AND product_name = 'PROMO' THEN 1 ELSE 0 END, 4) AS price_index FROM raw"""))
def st2(spark, sf):
    """Prices up to 1998; then those from July 1998 on, with other prices for one product, which take the place of the first ones."""
    names = [c.split()[0] for c in store.PRICE_SCHEMA.split(", ")]
    rows = raw_prices(spark, sf).withColumn("id", F.col("id").cast("string")).select(*names)
    later = rows.where("report_date >= DATE '1998-07-01'").withColumn("price_index", F.when(F.col("product_name") == "PROMO", F.col("price_index") + 1).otherwise(F.col("price_index")))
    root = run_in_batches([rows.where("report_date < DATE '1999-01-01'"), later], "ingest", lambda stream, at: streams.ingest_prices(stream, f"{at}/store", f"{at}/checkpoint"))
    return streams.stored_prices(spark, f"{root}/store").select("product_name", "product_variant", "origin", "report_date", F.round("price_index", 4).alias("price_index"))


@query("st3_articles", f"WITH {ART} SELECT DISTINCT sha256(coalesce(text, '')) AS content_hash FROM art")
def st3(spark, sf):
    """Articles in two batches of one day each; the second has all that the first had again."""
    rows = articles(spark, sf).select("id", "source", F.coalesce("text", F.lit("")).alias("content"))
    first = rows.where("coalesce(source, '') < 'src2'").select("content", F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    second = rows.select("content", F.lit("2024-01-02").cast("timestamp").alias("created_at"))
    out = "content_hash string"
    root = run_in_batches([first, second], "articles", lambda stream, at: streams.distinct_articles(stream).select("content_hash").writeStream.format("parquet").option("path", f"{at}/output").option("checkpointLocation", f"{at}/checkpoint"))
    return sunk(spark, root, out)


#: Days at which the clean prices are cut into the stream's batches.
CUTS = ("1997-03-01", "1999-10-15")


def next_rows(spark, clean: DataFrame) -> DataFrame:
    """The next rows of all series, from the clean prices in three batches.

    The second batch has the first one's prices again, doubled: they are late and must not count.
    """
    rows = clean.select("series", "report_date", "observed_price")
    first, second = (F.lit(c).cast("date") for c in CUTS)
    early = rows.where(F.col("report_date") < first)
    batches = [early, rows.where((F.col("report_date") >= first) & (F.col("report_date") < second)).union(early.withColumn("observed_price", 2 * F.col("observed_price"))), rows.where(F.col("report_date") >= second)]
    root = run_in_batches(batches, "states", lambda stream, at: state.next_rows(stream).writeStream.format("parquet").option("path", f"{at}/output").option("checkpointLocation", f"{at}/checkpoint").outputMode("append"))
    # rows that timers gave beyond a series' last day belong to no row of the panel
    ends = clean.groupBy("series").agg(F.max("report_date").alias("hi"))
    return sunk(spark, root, state.SCHEMA).join(ends, "series").where(F.col("report_date") <= F.date_add("hi", 1)).drop("hi")


@query("st4_state", recursive_sql(EMA, "SELECT series, report_date, round(f - s + 1e-8, 6) AS macd, round(g + 1e-8, 6) AS macd_signal FROM ema"))
def st4(spark, sf):
    """The averages of the state after each day."""
    rows = next_rows(spark, written(clean_prices(spark, sf), "clean"))
    return rows.select("series", F.date_sub("report_date", 1).alias("report_date"), r6(F.col("macd") + 1e-8).alias("macd"), r6(F.col("macd_signal") + 1e-8).alias("macd_signal"))


def _next_sql() -> str:
    upto = "OVER (PARTITION BY series ORDER BY report_date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    lag = lambda k: "price_index" if k == 1 else f"lag(price_index, {k - 1}) OVER (PARTITION BY series ORDER BY report_date)"
    stats = [f"{f}(price_index) {upto.format(w - 1)} AS {n}_{w}" for w in features.WINDOWS for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))]
    moves = "price_index - lag(price_index) OVER (PARTITION BY series ORDER BY report_date)"
    # a rounded nothing below zero is zero
    plain = ", ".join(c if c.startswith("observed") else f"{c} + 0.0::DOUBLE AS {c}" for c in state.COLUMNS)
    return f"""
, mo AS (SELECT *, {moves} AS d, row_number() OVER (PARTITION BY series ORDER BY report_date) AS rn, report_date - DATE '1970-01-01' AS dn FROM panel),
nx AS (SELECT series, report_date, rn, {', '.join(f"{lag(k)} AS lag_{k}" for k in features.LAGS)}, {', '.join(stats)}, count(price_index) {upto.format(13)} AS n_14,
  avg(price_index) {upto.format('UNBOUNDED')} AS expanding_mean,
  sum(greatest(coalesce(d, 0), 0)) {upto.format(12)} AS g13, sum(greatest(coalesce(d, 0), 0)) {upto.format(13)} AS g14,
  sum(greatest(-coalesce(d, 0), 0)) {upto.format(13)} AS l14,
  count(observed_price) {upto.format(6)} AS observed_7, count(observed_price) {upto.format(29)} AS observed_30,
  CAST(report_date + 1 - last_value(CASE WHEN is_observed THEN report_date END IGNORE NULLS) {upto.format('UNBOUNDED')} AS INT) AS observed_age,
  CASE WHEN count(observed_price) {upto.format(6)} >= 2 THEN regr_slope(observed_price, CASE WHEN is_observed THEN dn END) {upto.format(6)} END AS slope_7,
  CASE WHEN count(observed_price) {upto.format(13)} >= 2 THEN regr_slope(observed_price, CASE WHEN is_observed THEN dn END) {upto.format(13)} END AS slope_14 FROM mo),
ra AS (SELECT *, CASE WHEN lag_1 IS NULL THEN NULL WHEN coalesce(lag_2, 0) = 0 THEN 0.0 ELSE (lag_1 - lag_2) / lag_2 END AS return_1,
  CASE WHEN lag_1 IS NULL THEN NULL WHEN coalesce(lag_8, 0) = 0 THEN 0.0 ELSE (lag_1 - lag_8) / lag_8 END AS return_7,
  CASE WHEN lag_2 IS NULL THEN NULL WHEN coalesce(lag_3, 0) = 0 THEN 0.0 ELSE (lag_2 - lag_3) / lag_3 END AS return_1b FROM nx)
SELECT series, report_date, {plain} FROM (SELECT series, CAST(ra.report_date + 1 AS DATE) AS report_date, {', '.join(f'round(lag_{k}, 6) AS lag_{k}' for k in features.LAGS)},
  {', '.join(f'round({n}_{w} + 3e-7, 5) AS {n}_{w}' for w in features.WINDOWS for n in ('mean', 'std', 'min', 'max'))},
  round(CASE WHEN n_14 >= 2 AND mean_14 <> 0 THEN std_14 / mean_14 END, 5) AS volatility_14, round(return_1, 6) AS return_1, round(return_7, 6) AS return_7,
  round(return_1 - return_1b, 6) AS acceleration, round(CASE WHEN std_14 > 1e-6 THEN (lag_1 - mean_14) / (2 * std_14) END, 4) AS bollinger,
  round(expanding_mean + 3e-7, 5) AS expanding_mean, round((lag_1 - expanding_mean) / expanding_mean, 6) AS from_expanding_mean,
  round(100 - 100 / (1 + (g14 / least(14, rn + 1)) / (l14 / least(14, rn + 1) + 1e-6)), 3) AS rsi,
  round(f - s + 1e-8, 6) AS macd, round(g + 1e-8, 6) AS macd_signal, round(slope_7 + 3e-7, 5) AS slope_7, round(slope_14 + 3e-7, 5) AS slope_14, observed_7, observed_30, observed_age
FROM ra JOIN (SELECT series AS es, report_date AS ed, f, s, g FROM ema) ON es = series AND ed = ra.report_date)"""


def rounded_features(rows: DataFrame) -> DataFrame:
    """The columns of a next row as the SQL rounds them."""
    out = {c: F.round(F.col(c) + 3e-7, 5) for c in rows.columns if c.startswith(("mean_", "std_", "min_", "max_", "slope_")) or c == "expanding_mean"}
    out |= {"volatility_14": F.round("volatility_14", 5), "bollinger": F.when(F.col("std_14") > 1e-6, F.round("bollinger", 4)), "rsi": F.round("rsi", 3)}
    out |= {c: r6(c) for c in rows.columns if c.startswith(("lag_", "return_")) or c in ("acceleration", "from_expanding_mean")}
    out |= {c: r6(F.col(c) + 1e-8) for c in ("macd", "macd_signal")}
    return rows.select("series", "report_date", *[(out[c] + 0.0 if c in out else F.col(c)).alias(c) for c in state.COLUMNS])


@query("st4_next_row", recursive_sql(EMA, _next_sql()))
def st4_next_row(spark, sf):
    """All features of each day's next row, from the state alone."""
    return rounded_features(next_rows(spark, written(clean_prices(spark, sf), "clean")))


#: Days at which the kept rows are changed and left out, so that the comparison has something to find.
PLANTED_CHANGE, PLANTED_GAP = "1999-06-15", "1998-03-03"


@query("bt7_parity", with_sql(PANEL, f""", p AS (SELECT *, lag(price_index) OVER (PARTITION BY series ORDER BY report_date) AS l, row_number() OVER (PARTITION BY series ORDER BY report_date) AS rn FROM panel)
SELECT count(*) AS batch, count(*) FILTER (report_date <> DATE '{PLANTED_GAP}') AS incremental, count(*) FILTER (report_date = DATE '{PLANTED_GAP}') AS unmatched,
  count(*) FILTER (report_date = DATE '{PLANTED_CHANGE}' AND l IS NOT NULL) AS differing, CAST(max(CASE WHEN report_date = DATE '{PLANTED_CHANGE}' AND l IS NOT NULL THEN 1 ELSE 0 END) AS DOUBLE) AS largest
FROM p WHERE rn > 1"""))
def bt7(spark, sf):
    """The next rows, kept over three runs of the stream, against all features of the whole panel; one day's are changed, another's left out."""
    clean = written(clean_prices(spark, sf), "clean")
    dense = written(panel.reindex_daily(clean), "panel")
    batch = features.observation_history(features.rsi(features.price_windows(dense))).join(features.macd(dense), ["series", "report_date"])
    ends = dense.groupBy("series").agg(F.min("report_date").alias("lo"), F.max("report_date").alias("hi"))
    batch = batch.join(ends, "series").where("report_date > lo").select("series", "report_date", *state.COLUMNS)
    kept = next_rows(spark, clean).join(ends, "series").where("report_date <= hi").where(F.col("report_date") != F.lit(PLANTED_GAP).cast("date"))
    kept = kept.withColumn("lag_1", F.when(F.col("report_date") == F.lit(PLANTED_CHANGE).cast("date"), F.col("lag_1") + 1).otherwise(F.col("lag_1")))
    # where prices don't move the deviation is rounding alone, and so is what is divided by it
    steady = [c for c in state.COLUMNS if c != "bollinger"]
    return backtest.parity(batch, kept, ["series", "report_date"], steady).withColumn("largest", F.round("largest", 6))


@query("io1_snapshot", with_sql(CLEAN, """SELECT product_name, product_variant, count(*) AS n, CAST(sum(CAST(round(price_index * 10000) AS BIGINT)) AS BIGINT) AS total,
  max(report_date) AS last FROM raw WHERE report_date <= DATE '1998-12-31' GROUP BY ALL"""))
def io1(spark, sf):
    """The prices as a CSV snapshot in the shared folder, read up to a day."""
    names = [c.split()[0] for c in store.PRICE_SCHEMA.split(", ")]
    path = store.shared_folder(spark, "snapshot") + ".csv"
    raw_prices(spark, sf).select(*names).write.option("header", True).csv(path)
    return store.read_snapshot(spark, path, "1998-12-31").groupBy("product_name", "product_variant").agg(F.count("*").alias("n"), F.sum(F.round(F.col("price_index") * 10000).cast("long")).alias("total"), F.max("report_date").alias("last"))


@query("io6_publish", with_sql(PATHS, """SELECT series, date, seasonal7 AS price, CAST(origin AS VARCHAR) AS run_id FROM paths WHERE origin = (SELECT max(origin) FROM paths)"""))
def io6(spark, sf):
    """Two runs published in turn, and between them one whose declared count is wrong, which must not show."""
    root = store.shared_folder(spark, "publication")
    paths = written(forecast_paths(spark, sf).select("series", "date", F.lit("daily").alias("grain"), F.col("seasonal7").alias("price"), "origin"), "paths")
    runs = [r["origin"] for r in paths.select("origin").distinct().orderBy(F.desc("origin")).limit(2).collect()][::-1]
    for k, origin in enumerate(runs):
        own = paths.where(F.col("origin") == F.lit(origin)).drop("origin")
        if k:
            try:
                store.publish(spark, own, root, "broken", own.count() + 1)
            except ValueError:
                pass
        store.publish(spark, own, root, str(origin), own.count())
    return store.published_daily(spark, root).select("series", "date", "price", "run_id")
