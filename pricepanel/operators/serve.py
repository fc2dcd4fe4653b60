"""Serving queries: summaries, movers, comparisons, alternatives; drift; publication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import exact_quantiles
from .store import kept


def newest(n: int, keys: list[str], order: str = "report_date") -> tuple[Window, int]:
    return Window.partitionBy(*keys).orderBy(F.desc(order)), n


def last_rows(rows: DataFrame, n: int, key: str = "series", order: str = "report_date") -> DataFrame:
    """The newest ``n`` rows of each key, numbered from 1 (newest)."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("k") <= n)


def summary(rows: DataFrame, since: str) -> DataFrame:
    """SV1: per series of two rows or more: first and last price, the last 7 in order, and whether a day stands twice."""
    recent = rows.where(F.col("report_date") >= F.lit(since).cast("date"))
    facts = recent.groupBy("series").agg(
        F.count("*").alias("n"), F.min_by("price_index", "report_date").alias("first_price"), F.max_by("price_index", "report_date").alias("last_price"),
        F.max("report_date").alias("last_day"), (F.count("*") != F.count_distinct("report_date")).alias("ambiguous"),
    ).where("n >= 2")
    tail = last_rows(recent, 7).groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("report_date", "price_index"))), lambda x: x["price_index"]).alias("last_prices"))
    return facts.join(tail, "series")


def contiguous(forecasts: DataFrame, most: int = 7) -> DataFrame:
    """SV2, SV3: per series the unbroken run of days from the origin on, at most ``most`` of them; the last value of a day counts."""
    day = forecasts.where("price > 0 AND date > origin").groupBy("series", "origin", "date").agg(F.max_by("price", "id").alias("price"))
    n = F.row_number().over(Window.partitionBy("series", "origin").orderBy("date"))
    return day.withColumn("step", n).where((F.datediff("date", "origin") == F.col("step")) & (F.col("step") <= most))


def product_list(rows: DataFrame, forecasts: DataFrame) -> DataFrame:
    """SV4: current price, price 7 rows back, mean of the forecast week, change and its label, 7-point sparkline."""
    tail = last_rows(rows.where("price_index IS NOT NULL"), 8)
    now = tail.groupBy("series").agg(
        F.max(F.when(F.col("k") == 1, F.col("price_index"))).alias("current"), F.max(F.when(F.col("k") == 8, F.col("price_index"))).alias("week_back"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 7, F.struct("report_date", "price_index")))), lambda x: x["price_index"]).alias("sparkline"),
    )
    week = forecasts.groupBy("series").agg(F.avg("price").alias("predicted"))
    out = now.join(week, "series", "left").withColumn("change", 100 * (F.col("predicted") - F.col("current")) / F.col("current"))
    return out.withColumn("label", F.when(F.col("change") > 1, "Bullish").when(F.col("change") < -1, "Bearish").when(F.col("change").isNotNull(), "Neutral"))


def chart(rows: DataFrame, until: str) -> DataFrame:
    """SV5: daily means, and means of daily means of closed weeks and months."""
    daily = rows.where("observed_price IS NOT NULL").groupBy("product_name", "report_date").agg(F.avg("observed_price").alias("price"))
    end = F.lit(until).cast("date")
    week = daily.groupBy("product_name", F.to_date(F.date_trunc("week", "report_date")).alias("start")).agg(F.avg("price").alias("price")).where(F.date_add("start", 6) <= end)
    month = daily.groupBy("product_name", F.trunc("report_date", "month").alias("start")).agg(F.avg("price").alias("price")).where(F.last_day("start") <= end)
    return daily.select("product_name", F.lit("daily").alias("grain"), F.col("report_date").alias("start"), "price").unionByName(week.withColumn("grain", F.lit("weekly"))).unionByName(month.withColumn("grain", F.lit("monthly")))


def overlay(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """SV6: history and forecast by date; both values kept, the forecast shown where it is there."""
    both = history.select("series", "date", F.col("price").alias("observed")).join(forecast.select("series", "date", F.col("price").alias("forecast")), ["series", "date"], "full")
    return both.withColumn("shown", F.coalesce("forecast", "observed"))


def halves(rows: DataFrame, key: str) -> DataFrame:
    """SV7: mean of the earlier and the later half of each group's rows (by day, then id; the earlier has one more if odd), and the change.

    Rows are counted by group and day; running sums over the days find the day in which the middle
    falls, and of that day alone the rows are put in order. So a group is never sorted as a whole.
    """
    rows = rows.select(F.col(key).alias("group"), "report_date", "id", "price_index")
    daily = rows.groupBy("group", "report_date").agg(F.count("*").alias("c"), F.sum("price_index").alias("s"))
    upto = Window.partitionBy("group").orderBy("report_date").rowsBetween(Window.unboundedPreceding, -1)  # a row per day
    daily = daily.withColumns({"before": F.coalesce(F.sum("c").over(upto), F.lit(0)), "all": F.sum("c").over(Window.partitionBy("group"))})
    daily = daily.withColumn("first", F.ceil(F.col("all") / 2).cast("long"))
    daily = daily.withColumn("take", F.greatest(F.lit(0), F.least(F.col("c"), F.col("first") - F.col("before"))))
    torn = daily.where("take > 0 AND take < c").select(F.col("group").alias("g"), F.col("report_date").alias("d"), "take")
    inside = rows.join(torn, F.col("group").eqNullSafe(F.col("g")) & (F.col("report_date") == F.col("d")))
    inside = inside.withColumn("n", F.row_number().over(Window.partitionBy("group", "report_date").orderBy("id"))).where("n <= take")
    part = inside.groupBy(F.col("group").alias("g")).agg(F.sum("price_index").alias("part"))
    out = daily.groupBy("group").agg(F.sum("s").alias("sum"), F.max("all").alias("n"), F.max("first").alias("first"), F.sum(F.when(F.col("take") == F.col("c"), F.col("s")).otherwise(0.0)).alias("early"))
    out = out.join(part, F.col("group").eqNullSafe(F.col("g")), "left").withColumn("early", F.col("early") + F.coalesce("part", F.lit(0.0)))
    out = out.select(F.col("group").alias(key), (F.col("early") / F.col("first")).alias("previous"), F.try_divide(F.col("sum") - F.col("early"), F.col("n") - F.col("first")).alias("current"))
    return out.withColumn("change", 100 * (F.col("current") - F.col("previous")) / F.col("previous"))


def last_points(rows: DataFrame, key: str, n: int) -> DataFrame:
    """SV7: the newest ``n`` days of each group with the mean price of the day, numbered from the newest."""
    daily = rows.groupBy(key, "report_date").agg(F.avg("price_index").alias("price"))
    return last_rows(daily, n, key)


def cheaper(rows: DataFrame, k: int = 5) -> DataFrame:
    """SV8: per series the ``k`` cheapest others of its category and unit with another product name and a lower price.

    Only the latest price per series takes part. A category's names are ranked by price once, so a
    series needs at most its own name's series and ``k`` more, and no all-pairs join.
    """
    latest = rows.groupBy("series", "product_category", "product_name", "unit").agg(F.max_by("price_index", F.struct("report_date", "id")).alias("price"))
    group = ["product_category", "unit"]
    # the k cheapest series of each name, and of those the cheapest overall: k + (k of the own name) rows suffice
    per_name = latest.withColumn("r", F.row_number().over(Window.partitionBy(*group, "product_name").orderBy("price", "series"))).where(F.col("r") <= k)
    cheapest = per_name.withColumn("q", F.row_number().over(Window.partitionBy(*group).orderBy("price", "series"))).where(F.col("q") <= 2 * k)
    other = cheapest.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("price", "series", "product_name"))).alias("offers"))
    found = F.slice(F.filter("offers", lambda o: (o["product_name"] != F.col("product_name")) & (o["price"] < F.col("price"))), 1, k)
    out = latest.join(other, group).select("series", "price", F.posexplode(found).alias("rank", "o"))
    return out.select("series", (F.col("rank") + 1).alias("rank"), F.col("o.series").alias("alternative"), F.col("o.price").alias("alternative_price"), (F.col("price") - F.col("o.price")).alias("saving"), (100 * (F.col("price") - F.col("o.price")) / F.col("price")).alias("saving_pct"))


def movers(products: DataFrame, k: int = 10) -> DataFrame:
    """SV9"""
    return products.where("change IS NOT NULL").orderBy(F.desc(F.abs("change")), "series").limit(k)


def featured(products: DataFrame, k: int = 6) -> DataFrame:
    """SV10: one row per name, bullish first, then by change."""
    order = [F.desc((F.col("label") == "Bullish").cast("int")), F.desc("change"), F.asc("series")]
    one = products.where("change IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("product_name").orderBy(*order))).where("r = 1").drop("r")
    return one.orderBy(*order).limit(k)


def trending(views: DataFrame, last_day: str, days: int = 30, k: int = 10) -> DataFrame:
    """SV11"""
    end = F.lit(last_day).cast("date")
    recent = views.where((F.col("day") > F.date_sub(end, days)) & (F.col("day") <= end))
    return recent.groupBy("product_id").agg(F.sum("views").alias("views")).orderBy(F.desc("views"), "product_id").limit(k)


def market(rows: DataFrame, category: str | None = None, text: str | None = None, low: float | None = None, high: float | None = None, origin: str | None = None) -> DataFrame:
    """SV12"""
    for value, condition in ((category, F.col("product_category") == category), (text, F.lower("product_name").contains((text or "").lower())), (low, F.col("price_index") >= low), (high, F.col("price_index") <= high), (origin, F.col("origin") == origin)):
        if value is not None:
            rows = rows.where(condition)
    return rows.groupBy("product_name", "origin").agg(F.count("*").alias("n"), F.min("price_index").alias("lowest"), F.max("price_index").alias("highest"), F.avg("price_index").alias("mean"))


def side_by_side(rows: DataFrame, a: str, b: str, n: int = 30) -> DataFrame:
    """SV13: two series' last prices, aligned from the end."""
    tail = last_rows(rows.where(F.col("series").isin(a, b) & F.col("price_index").isNotNull()), n)
    return tail.groupBy("k").agg(F.max(F.when(F.col("series") == a, F.col("price_index"))).alias("a"), F.max(F.when(F.col("series") == b, F.col("price_index"))).alias("b"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(d))


#: Parts of a cell by each axis, and the level of the smallest cells (a few metres wide).
FAN, DEEPEST = 4, 10


def _split_cells(spots: DataFrame, leaf: int) -> tuple[list[DataFrame], DataFrame | None]:
    """The cells of each level, split where they hold more than ``leaf`` places, and the places by their last cell.

    A cell's row has the box around its places, their number and whether it is split no further.
    """
    levels: list[DataFrame] = []
    leaves, inside = None, spots
    for level in range(1, DEEPEST + 1):
        cell = lambda c, level=level: F.least(F.floor((F.col(c) + 1) / 2 * FAN**level), F.lit(FAN**level - 1)).cast("long")
        placed = inside.withColumns({"i": cell("x"), "j": cell("y"), "l": cell("z")})
        box = [f(c).alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("lo", F.min), ("hi", F.max))]
        cells = placed.groupBy("i", "j", "l").agg(F.count("*").alias("n"), *box)
        cells = kept(cells.withColumn("is_leaf", (F.col("n") <= leaf) | F.lit(level == DEEPEST)).withColumn("level", F.lit(level)), "cells")
        levels.append(cells)
        ended = placed.join(cells.where("is_leaf").select("i", "j", "l", "level"), ["i", "j", "l"]).select("place_id", "lat", "lon", "level", "i", "j", "l")
        leaves = ended if leaves is None else leaves.unionByName(ended)
        if cells.where("NOT is_leaf").isEmpty():
            break
        inside = kept(placed.join(cells.where("NOT is_leaf").select("i", "j", "l"), ["i", "j", "l"], "left_semi").drop("i", "j", "l"), "places")
    return levels, leaves


def nearest(points: DataFrame, places: DataFrame, k: int = 3, leaf: int = 64) -> DataFrame:
    """SV14: the ``k`` nearest places of each point by great-circle distance (ties: smaller id), for tables of any size and density.

    Cells of the cube around the unit sphere are split where they hold more than ``leaf`` places. A point
    goes down level by level: the nearest cells that surely hold ``k`` places bound its distance, and
    cells farther than that are left out; only the places of the last cells that are left meet the point.
    So a point meets a few cells of at most ``leaf`` places, in a dense city as elsewhere. Of places at one
    position only the ``k`` smallest ids take part (more than ``leaf`` of those within the smallest cell
    stay together). ``point_id`` is unique; points and places without a position have no result.
    """

    def position(df: DataFrame) -> DataFrame:
        lat, lon = F.radians("lat"), F.radians("lon")
        return df.where("lat IS NOT NULL AND lon IS NOT NULL").withColumns({"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)})

    same = Window.partitionBy("lat", "lon").orderBy("place_id")
    spots = kept(position(places.select("place_id", "lat", "lon").withColumn("n", F.row_number().over(same)).where(F.col("n") <= k).drop("n")), "places")
    levels, leaves = _split_cells(spots, leaf)
    asked = position(points.select("point_id", "lat", "lon")).select("point_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    open_, ended = asked.withColumns({c: F.lit(0).cast("long") for c in ("pi", "pj", "pl")}), None
    kinds = ["point_id", "px", "py", "pz", "level", "i", "j", "l", "n", "is_leaf", "least", "most"]
    for cells in levels:
        up = lambda c: F.floor(F.col(c) / FAN).cast("long")
        met = open_.join(cells.withColumns({"pi": up("i"), "pj": up("j"), "pl": up("l")}), ["pi", "pj", "pl"])
        # the least and largest chord from the point to the box of a cell's places
        squares = lambda f: F.sqrt(sum(f(F.col(f"p{c}"), F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in ("x", "y", "z")))
        near = squares(lambda p, lo, hi: F.pow(F.greatest(lo - p, p - hi, F.lit(0.0)), 2))
        far = squares(lambda p, lo, hi: F.pow(F.greatest(F.abs(p - lo), F.abs(p - hi)), 2))
        met = met.withColumns({"least": near, "most": far}).select(*kinds)
        both = met if ended is None else met.unionByName(ended)
        upto = F.sum("n").over(Window.partitionBy("point_id").orderBy("most", "level", "i", "j", "l"))
        bound = F.min(F.when(F.col("upto") >= k, F.col("most"))).over(Window.partitionBy("point_id"))
        left = both.withColumn("upto", upto).withColumn("bound", F.coalesce(bound, F.lit(2.0))).where(F.col("least") <= F.col("bound") + 1e-9).select(*kinds)
        left = kept(left, "frontier")
        ended = left.where("is_leaf")
        open_ = left.where("NOT is_leaf").select("point_id", "px", "py", "pz", F.col("i").alias("pi"), F.col("j").alias("pj"), F.col("l").alias("pl"))
    met = ended.select("point_id", "level", "i", "j", "l").join(leaves, ["level", "i", "j", "l"]).join(points.select("point_id", F.col("lat").alias("plat"), F.col("lon").alias("plon")), "point_id")
    met = met.select("point_id", "place_id", haversine(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")).alias("km"))
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("point_id").orderBy("km", "place_id")))
    return ranked.where(F.col("rank") <= k).select("point_id", "rank", "place_id", "km")


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """SV15"""
    return rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns])).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def trend_facts(rows: DataFrame) -> DataFrame:
    """SV16: recent 5 against older prices, 5- and 30-row changes, weekly variation, deviation from the last 30."""
    tail = last_rows(rows.where("price_index IS NOT NULL"), 31)
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("price_index")))
    mean = lambda lo, hi: F.avg(F.when(F.col("k").between(lo, hi), F.col("price_index")))
    out = tail.groupBy("series").agg(at(1).alias("last"), mean(1, 5).alias("recent"), mean(6, 30).alias("older"), at(6).alias("p5"), at(31).alias("p30"), (F.stddev_samp(F.when(F.col("k") <= 7, F.col("price_index"))) / mean(1, 7)).alias("cv_7"), mean(1, 30).alias("mean_30"))
    ratio = F.col("recent") / F.col("older") - 1
    return out.select("series", F.when(ratio > 0.02, "rising").when(ratio < -0.02, "falling").otherwise("stable").alias("trend"), (100 * (F.col("last") / F.col("p5") - 1)).alias("change_5"), (100 * (F.col("last") / F.col("p30") - 1)).alias("change_30"), "cv_7", (100 * (F.col("last") / F.col("mean_30") - 1)).alias("from_mean_30"))


def forecast_gaps(paths: DataFrame, k: int = 20) -> DataFrame:
    """SV17: first, last and largest gap of a path to its anchor, the first week's mean change, the largest daily step; top ``k``."""
    step = F.abs(F.col("price") / F.lag("price").over(Window.partitionBy("series", "origin").orderBy("horizon")) - 1)
    gap = F.col("price") / F.col("anchor") - 1
    out = paths.withColumns({"step": step, "gap": gap}).groupBy("series", "origin").agg(
        F.min_by("gap", "horizon").alias("first_gap"), F.max_by("gap", "horizon").alias("last_gap"), F.max(F.abs("gap")).alias("largest_gap"),
        F.avg(F.when(F.col("horizon") <= 7, F.col("gap"))).alias("week_gap"), F.max("step").alias("largest_step"),
    )
    return out.orderBy(F.desc(F.round("largest_gap", 9)), "series", "origin").limit(k)


def freshness(series: DataFrame, issue: str) -> DataFrame:
    """SV18: series by last day, and whether they are current."""
    return series.groupBy("last_day").agg(F.count("*").alias("n"), F.count_if("is_fallback").alias("fallbacks")).withColumn("current", F.col("last_day") >= F.lit(issue).cast("date"))


def stability_index(reference: DataFrame, current: DataFrame, column: str, keys: list[str] | None = None, eps: float = 1e-6) -> DataFrame:
    """DR1: population stability over deciles of the reference (duplicates merged, last bin closed, outside values dropped)."""
    keys = keys or []
    edges = exact_quantiles(reference, column, [k / 10 for k in range(11)], keys).select(*keys, F.array_distinct("quantiles").alias("edges"))
    labelled = reference.select(*keys, column, F.lit(1).alias("ref")).unionByName(current.select(*keys, column, F.lit(0).alias("ref")))
    joined = labelled.join(edges, keys) if keys else labelled.join(F.broadcast(edges))  # one row
    v = F.col(column)
    bin_ = F.size(F.filter("edges", lambda e: e <= v))
    bin_ = F.when(v == F.element_at("edges", -1), F.size("edges") - 1).otherwise(bin_)
    inside = joined.where((v >= F.element_at("edges", 1)) & (v <= F.element_at("edges", -1))).withColumn("bin", bin_)
    counts = inside.groupBy(*keys, "bin").agg(F.sum("ref").alias("r"), F.sum(1 - F.col("ref")).alias("c"))
    # bins that neither side fills add nothing; totals come from the counts
    total = counts.groupBy(*keys).agg(F.sum("r").alias("rt"), F.sum("c").alias("ct"))
    both = counts.join(total, keys) if keys else counts.join(F.broadcast(total))
    p, q = F.greatest(F.col("r") / F.col("rt"), F.lit(eps)), F.greatest(F.col("c") / F.col("ct"), F.lit(eps))
    return both.groupBy(*keys).agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))


def performance_drift(old_mape: Column, new_mape: Column, limit: float = 0.15) -> Column:
    """DR2"""
    return F.when(old_mape > 0, (new_mape - old_mape) / old_mape > limit).otherwise(False)
