"""Cleaning of raw price reports. Missing values are NULL throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import exact_quantiles

SERIES_KEY = ["product_category", "product_name", "product_variant", "origin", "unit"]

#: Unit spellings and their names (fixed values).
UNIT_ALIASES = {
    "per kg": "kg", "kilogram": "kg", "pc": "piece", "per piece": "piece", "l": "liter", "1 liter": "liter", "1l": "liter",
    "350 ml": "350ml", "milliliter": "ml", "btl": "bottle",
}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def coerce(raw: DataFrame) -> DataFrame:
    """CL1: dates without time (invalid: null), prices as double, identity trimmed, null as ``Unknown``."""
    out = raw.withColumn("report_date", F.expr("try_cast(report_date AS date)")).withColumn("price_index", F.expr("try_cast(price_index AS double)"))
    out = out.withColumn("price_index", F.when(~F.isnan("price_index"), F.col("price_index")))
    return out.withColumns({c: F.coalesce(F.trim(F.col(c)), F.lit("Unknown")) for c in SERIES_KEY})


def default_variant(variant: Column) -> Column:
    """CL2: the text ``null`` is a missing variant too, in this spelling alone."""
    return F.when(variant.isNull() | variant.isin("", "Unknown", "null"), "Standard").otherwise(variant)


def normalise_unit(unit: Column, category: Column, name: Column, variant: Column) -> Column:
    """CL3: lower-case, aliases, then what the size of an oil or the name of a product decides. A null unit is ``unknown``, an empty one stays."""
    low = F.lower(F.trim(F.coalesce(unit, F.lit("unknown"))))
    aliases = F.create_map(*[F.lit(x) for pair in UNIT_ALIASES.items() for x in pair])
    known = F.coalesce(F.try_element_at(aliases, low), low)
    size = F.when(category == "Oils", F.lower(variant))
    return F.when(name == "Chicken Egg", "piece").when(size == "1l", "liter").when(size == "350ml", "350ml").otherwise(known)


def infer_unit(rows: DataFrame) -> DataFrame:
    """CL4: an unknown unit takes the one known unit of its four-part identity, if there is exactly one."""
    identity = SERIES_KEY[:4]
    known = rows.where("unit <> 'unknown'").groupBy(*identity).agg(F.min("unit").alias("__lo"), F.max("unit").alias("__hi")).where("__lo = __hi")
    return rows.join(known.drop("__hi"), identity, "left").withColumn("unit", F.when((F.col("unit") == "unknown") & F.col("__lo").isNotNull(), F.col("__lo")).otherwise(F.col("unit"))).drop("__lo")


def valid_rows(rows: DataFrame) -> DataFrame:
    """CL5"""
    price = F.col("price_index")
    return rows.where(F.col("report_date").isNotNull() & price.isNotNull() & (price > 0) & (price < float("inf")) & ~F.col("product_name").isin("", "Unknown") & ~F.col("product_category").isin("", "Unknown"))


def source_date(document: Column) -> Column:
    """CL6: the first ``Month-d-yyyy`` of a document's name; null for impossible dates."""
    pattern = r"([A-Za-z]+)-(\d{1,2})-(\d{4})"
    month = F.lower(F.regexp_extract(document, pattern, 1))
    number = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), month)
    text = F.concat_ws("-", F.regexp_extract(document, pattern, 3), number.cast("string"), F.regexp_extract(document, pattern, 2))
    return F.when(number > 0, F.try_to_date(text, "yyyy-M-d"))


def observation_flag(rows: DataFrame) -> DataFrame:
    """CL7: observed if so stated (null: no), else if the document's date is the report's; prices of copies are no truth."""
    flag = F.coalesce(F.col("is_observed"), F.lit(False)) if "is_observed" in rows.columns else F.coalesce(source_date(F.col("source_pdf")) == F.col("report_date"), F.lit(False))
    return rows.withColumn("is_observed", flag).withColumn("observed_price", F.when(flag, F.col("price_index")))


def series_id(columns: list[str] | None = None) -> Column:
    return F.concat_ws("||", *(columns or SERIES_KEY))


def conflicts(rows: DataFrame) -> DataFrame:
    """CL8: series and days with more than one observed price."""
    seen = rows.where("observed_price IS NOT NULL").groupBy(*SERIES_KEY, "report_date")
    return seen.agg(F.min("observed_price").alias("lowest"), F.max("observed_price").alias("highest"), F.count("*").alias("n")).where("lowest <> highest")


def deduplicate(rows: DataFrame) -> DataFrame:
    """CL9: one row per series and day, observed first, then the smallest id.

    Each column is the one of the first row, so what a query doesn't ask for is not carried along. Where
    ids are whole numbers the order is packed into one: the aggregates then hash and need no sort.
    """
    key = [*SERIES_KEY, "report_date"]
    order = F.struct(~F.col("is_observed"), F.col("id"))
    if rows.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        whole = lambda n: F.lit(str(n)).cast("decimal(38,0)")
        place = F.when(F.col("is_observed").isNull(), whole(-(1 << 66))).when(F.col("is_observed"), whole(0)).otherwise(whole(1 << 66))
        order = place + F.coalesce(F.col("id").cast("decimal(38,0)"), whole(-(1 << 64)))  # what is missing comes first
    best = rows.withColumn("__order", order).groupBy(*key).agg(*[F.min_by(c, "__order").alias(c) for c in rows.columns if c not in key])
    return best.select(*rows.columns)


def validate(raw: DataFrame, write: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """CL1-CL7 and CL9 in order, with the series id.

    ``write(rows)`` gives a table back from storage: units are inferred of the normalised rows, which take
    them, so these are computed once there.
    """
    rows = coerce(raw)
    rows = rows.withColumn("product_variant", default_variant(F.col("product_variant")))
    rows = rows.withColumn("unit", normalise_unit(F.nullif("unit", F.lit("Unknown")), F.col("product_category"), F.col("product_name"), F.col("product_variant")))
    rows = observation_flag(valid_rows(infer_unit(write(rows))))
    return deduplicate(rows).withColumn("series", series_id())


def repair_variants(rows: DataFrame) -> DataFrame:
    """CL10: where a product and day has both ``Standard`` and missing variants the missing go; of several missing one stays, as ``Standard``."""
    missing = F.col("product_variant").isNull() | (F.lower("product_variant") == "null")
    by = Window.partitionBy("product_name", "origin", "report_date")
    marked = rows.withColumn("__missing", missing).withColumn("__standard", F.max(F.coalesce(F.col("product_variant") == "Standard", F.lit(False))).over(by))
    marked = marked.withColumn("__n", F.row_number().over(by.orderBy(F.desc("__missing"), "id")))
    kept = marked.where(~F.col("__missing") | (~F.col("__standard") & (F.col("__n") == 1)))
    return kept.withColumn("product_variant", F.when(F.col("__missing"), "Standard").otherwise(F.col("product_variant"))).drop("__missing", "__standard", "__n")


def fill_missing_days(rows: DataFrame, start: str, end: str, lookback: int = 7) -> DataFrame:
    """CL11: a day of [start, end] without rows copies the rows of the latest recorded day before it."""
    recorded = rows.where(F.col("report_date").between(F.date_sub(F.lit(start).cast("date"), lookback), F.lit(end).cast("date"))).select("report_date").distinct()
    days = rows.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(start).cast("date"), lookback), F.lit(end).cast("date"))).alias("day"))
    marked = days.join(recorded, F.col("day") == F.col("report_date"), "left")
    # a calendar of days, so one ordered window over it is small
    latest = F.last("report_date", ignorenulls=True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    gaps = marked.withColumn("from_day", latest).where(F.col("report_date").isNull() & F.col("from_day").isNotNull() & (F.col("day") >= F.lit(start).cast("date"))).select("day", "from_day")
    copies = rows.join(F.broadcast(gaps), F.col("report_date") == F.col("from_day")).drop("report_date", "from_day").withColumnRenamed("day", "report_date")
    return rows.withColumn("is_copy", F.lit(False)).unionByName(copies.withColumn("is_copy", F.lit(True)))


def quarantine(rows: DataFrame, categories: list[str]) -> DataFrame:
    """CL12: reasons against each parsed row of a document, and whether its document is rejected (any bad row rejects it)."""
    low = [c.lower() for c in categories]
    origin = F.coalesce(F.nullif(F.trim("origin"), F.lit("")), F.lit("Local"))
    n = F.count("*").over(Window.partitionBy("source_pdf", "product_name", "product_variant", "origin"))
    checks = {
        "category": ~F.coalesce(F.lower("product_category").isin(low), F.lit(False)), "unit": F.coalesce(F.trim("unit"), F.lit("")) == "",
        "origin": ~origin.isin("Local", "Imported"), "price": ~F.coalesce((F.col("price_index") > 0) & (F.col("price_index") < float("inf")), F.lit(False)), "duplicate": n > 1,
    }
    reasons = F.array_compact(F.array(*[F.when(bad, name) for name, bad in checks.items()]))
    marked = rows.withColumn("reasons", F.concat_ws(",", reasons))
    return marked.withColumn("rejected", F.max(F.col("reasons") != "").over(Window.partitionBy("source_pdf")))


def source_audit(rows: DataFrame) -> DataFrame:
    """CL13: rows by how their document's date stands to their report date."""
    d = source_date(F.col("source_pdf"))
    return rows.agg(
        F.count("*").alias("n"), F.count_if(d == F.col("report_date")).alias("matches"), F.count_if(d < F.col("report_date")).alias("copied"),
        F.count_if(d > F.col("report_date")).alias("later"), F.count_if(d.isNull()).alias("unparsed"),
    )


def profile(rows: DataFrame) -> DataFrame:
    """CL14: one row of rows, span, days, series, nulls, units, price quartiles and gaps of more than a day."""
    gaps = rows.select("series", "report_date").withColumn("gap", F.datediff("report_date", F.lag("report_date").over(Window.partitionBy("series").orderBy("report_date"))))
    n_gaps = gaps.agg(F.count_if(F.col("gap") > 1).alias("n_gaps"), F.max("gap").alias("longest_gap"))
    facts = rows.agg(
        F.count("*").alias("n"), F.min("report_date").alias("first_day"), F.max("report_date").alias("last_day"), F.count_distinct("report_date").alias("n_days"),
        F.count_distinct("series").alias("n_series"), F.count_if(F.col("observed_price").isNull()).alias("null_observed"), F.count_distinct("unit").alias("n_units"),
    )
    quartiles = exact_quantiles(rows, "price_index", [0.25, 0.5, 0.75])
    at = lambda k: F.max(F.get("quantiles", k))  # noqa: E731  null without prices
    quartiles = quartiles.agg(at(0).alias("q25"), at(1).alias("q50"), at(2).alias("q75"))
    return facts.join(F.broadcast(n_gaps)).join(F.broadcast(quartiles))  # one row each


def catalog(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """CL15: products by name, variant, origin and unit with their first category; only new ones if ``existing`` is given."""
    key = ["product_name", "product_variant", "origin", "unit"]
    known = rows.where((F.col("unit") != "unknown") & (F.col("product_name") != "Unknown"))
    products = known.groupBy(*key).agg(F.min_by("product_category", F.struct("report_date", "id")).alias("product_category"))
    products = products.withColumn("product_id", F.md5(F.concat_ws("|", *key)))
    return products if existing is None else products.join(existing, key, "left_anti")
