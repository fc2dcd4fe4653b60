"""Registration of queries, the adapters from the driver's tables, and the SQL they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricepanel.operators import clean, panel, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Spark's setting: shuffle files go when the query that made them ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def query(name: str, sql: str | None = None):
    """Register a query and, where given, its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a table in the shared folder, so that what several parts of a plan need is computed once; ``df`` itself where there is none.

    Shuffle files of the write are dropped when it is done: no later plan reads them, and without that they
    take disk until the driver happens to collect its garbage.
    """
    if not store.can_share(df.sparkSession):
        return df
    path, conf = store.shared_folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, "false")
    conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(DROP_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def near6(column: Column) -> Column:
    """``r6`` without a decimal per value, for columns that are moved off ties."""
    return F.rint(column * 1e6) / 1e6


#: Category, product and variant of a line: six products, or one per supplier.
FEW_SERIES = (
    "CASE WHEN p_type IN ('ECONOMY','PROMO') THEN 'Rice' WHEN p_type IN ('SMALL','MEDIUM') THEN 'Vegetables' ELSE 'Fish' END",
    "p_type", "CASE l_returnflag WHEN 'N' THEN NULL ELSE l_returnflag END",
)
MANY_SERIES = ("CASE l_suppkey % 3 WHEN 0 THEN 'Rice' WHEN 1 THEN 'Vegetables' ELSE 'Fish' END", "concat('S', l_suppkey)", "CAST(NULL AS STRING)")


def many_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw reports as one series per supplier."""
    return raw_prices(spark, sf_dir, MANY_SERIES, ["l_suppkey"])


def raw_prices(spark: SparkSession, sf_dir: str, names: tuple[str, str, str] = FEW_SERIES, of: list[str] | None = None) -> DataFrame:
    """``lineitem`` and ``part`` as raw price reports, one per series and day.

    Of the lines of a series and day the first by order, line, part and supplier, which tell lines apart.
    ``of``: columns that tell the series apart as well as its names do; lines are then grouped by them and
    named afterwards.
    """
    series = [*[F.expr(e).alias(c) for c, e in zip(("product_category", "product_name", "product_variant"), names, strict=True)], F.expr("CASE WHEN l_suppkey % 2 = 0 THEN 'Local' ELSE 'Imported' END").alias("origin")]
    # narrow before the join: where parts are too many to broadcast, all lines are shuffled for it
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_discount").cast("decimal(10,2)").alias("discount"),
        (F.col("l_linestatus") == "O").alias("is_observed"), F.to_date("l_shipdate").alias("report_date"),
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.col("p_retailprice").cast("decimal(10,2)").alias("price"))
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        *([] if of else series), "report_date", F.expr("CAST(price * (1 - discount) AS DOUBLE)").alias("price_index"), "is_observed", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )
    if of:  # next to no two lines share a supplier and day: their places and sums would take more than they do
        rows = rows.repartition(*of, "report_date")
    named = ["product_category", "product_name", "product_variant", "origin"]
    # the first row of each key: its order packed into one number, so that the aggregates hash and need no sort
    place = F.expr(
        "CAST(l_orderkey * 10 + l_linenumber AS DECIMAL(20,0)) * CAST(1000000000000000000 AS DECIMAL(19,0))"
        " + CAST(CAST(l_partkey AS BIGINT) * 1000000000 + l_suppkey AS DECIMAL(18,0))"
    ).cast("decimal(38,0)")
    least = lambda c: F.min_by(c, "place").alias(c)
    first = rows.withColumn("place", place).groupBy(*(of or named), "report_date").agg(least("l_orderkey"), least("l_linenumber"), least("price_index"), least("is_observed"))
    first = first.select("*", *series) if of else first
    unit = F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'per kg' WHEN 1 THEN 'KG ' WHEN 2 THEN 'kilogram' ELSE NULL END")
    day = F.when(F.col("is_observed"), F.col("report_date")).otherwise(F.date_sub("report_date", 1))
    return first.select(
        *named, unit.alias("unit"), "report_date", "price_index", "is_observed", F.concat(F.lit("Price-Monitoring-"), F.date_format(day, "MMMM-d-yyyy"), F.lit(".pdf")).alias("source_pdf"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
    )


RAW = """
raw0 AS (
  SELECT CASE WHEN p.p_type IN ('ECONOMY','PROMO') THEN 'Rice' WHEN p.p_type IN ('SMALL','MEDIUM') THEN 'Vegetables' ELSE 'Fish' END AS product_category,
         p.p_type AS product_name, CASE l.l_returnflag WHEN 'N' THEN NULL ELSE l.l_returnflag END AS product_variant,
         CASE WHEN l.l_suppkey % 2 = 0 THEN 'Local' ELSE 'Imported' END AS origin,
         CASE l.l_linenumber % 4 WHEN 0 THEN 'per kg' WHEN 1 THEN 'KG ' WHEN 2 THEN 'kilogram' ELSE NULL END AS unit,
         CAST(l.l_shipdate AS DATE) AS report_date,
         CAST(CAST(p.p_retailprice AS DECIMAL(10,2)) * (1 - CAST(l.l_discount AS DECIMAL(10,2))) AS DOUBLE) AS price_index,
         l.l_linestatus = 'O' AS is_observed, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
raw AS (
  SELECT product_category, product_name, product_variant, origin, unit, report_date, price_index, is_observed,
         'Price-Monitoring-' || strftime(CASE WHEN is_observed THEN report_date ELSE report_date - 1 END, '%B-%-d-%Y') || '.pdf' AS source_pdf,
         l_orderkey * 10 + l_linenumber AS id
  FROM (SELECT *, row_number() OVER (PARTITION BY product_category, product_name, coalesce(product_variant, 'Standard'), origin, report_date
               ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM raw0) WHERE rn = 1)
"""

#: The same lines as one series per supplier, so that series grow with the data; a category is a third of the suppliers.
MANY_RAW = """
raw0 AS (
  SELECT """ + MANY_SERIES[0] + """ AS product_category, 'S' || l.l_suppkey AS product_name, CAST(NULL AS VARCHAR) AS product_variant,
         CASE WHEN l.l_suppkey % 2 = 0 THEN 'Local' ELSE 'Imported' END AS origin,
         CASE l.l_linenumber % 4 WHEN 0 THEN 'per kg' WHEN 1 THEN 'KG ' WHEN 2 THEN 'kilogram' ELSE NULL END AS unit,
         CAST(l.l_shipdate AS DATE) AS report_date,
         CAST(CAST(p.p_retailprice AS DECIMAL(10,2)) * (1 - CAST(l.l_discount AS DECIMAL(10,2))) AS DOUBLE) AS price_index,
         l.l_linestatus = 'O' AS is_observed, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
""" + RAW[RAW.index("raw AS (") :]


def many(sql: str) -> str:
    """SQL over the series of ``MANY_RAW`` in place of those of ``RAW``."""
    return sql.replace(RAW, MANY_RAW)


CLEAN = RAW + """,
c1 AS (SELECT product_category, product_name, coalesce(product_variant, 'Standard') AS product_variant, origin,
              CASE WHEN unit IS NULL THEN 'unknown' ELSE 'kg' END AS unit, report_date, price_index, is_observed, source_pdf, id FROM raw),
c2 AS (SELECT * REPLACE (CASE WHEN unit = 'unknown' AND (count(DISTINCT CASE
  WHEN unit <> 'unknown' THEN unit END) OVER (PARTITION BY product_category, product_name, product_variant, origin)) = 1
              THEN max(CASE WHEN unit <> 'unknown' THEN unit END) OVER (PARTITION BY product_category, product_name, product_variant, origin)
  ELSE unit END AS unit) FROM c1),
clean AS (SELECT concat_ws('||', product_category, product_name, product_variant, origin, unit) AS series, *, CASE
  WHEN is_observed THEN price_index END AS observed_price FROM c2)
"""

PANEL = CLEAN + """,
span AS (SELECT series, min(report_date) AS lo, max(report_date) AS hi FROM clean GROUP BY series),
days AS (SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS report_date FROM span),
panel AS (SELECT d.series, split_part(d.series, '||', 1) AS product_category, split_part(d.series, '||', 2) AS product_name, d.report_date, c.observed_price,
                 last_value(c.observed_price IGNORE NULLS) OVER (PARTITION BY d.series ORDER BY d.report_date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS price_index,
                 c.observed_price IS NOT NULL AS is_observed
          FROM days d LEFT JOIN clean c ON c.series = d.series AND c.report_date = d.report_date)
"""


def clean_prices(spark: SparkSession, sf_dir: str, raw: Callable[[SparkSession, str], DataFrame] = raw_prices) -> DataFrame:
    """The clean prices; the normalised rows, of which units are inferred and which take them, are written once."""
    return clean.validate(raw(spark, sf_dir), lambda rows: written(rows, "raw"))


def series_prices(spark: SparkSession, sf_dir: str, raw: Callable[[SparkSession, str], DataFrame] = raw_prices) -> DataFrame:
    """What the daily panel takes of the clean prices; of the raw ones only what it takes is written."""
    rows = clean_prices(spark, sf_dir, lambda s, d: raw(s, d).drop("source_pdf"))
    return rows.select("series", "report_date", "observed_price")


def daily_panel(spark: SparkSession, sf_dir: str, raw: Callable[[SparkSession, str], DataFrame] = raw_prices) -> DataFrame:
    """The daily panel; of the raw and the clean prices only what it takes is written."""
    return panel.reindex_daily(series_prices(spark, sf_dir, raw))


def with_sql(prefix: str, select: str) -> str:
    return f"WITH {prefix.strip()}\n{select.strip()}"
