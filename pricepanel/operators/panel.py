"""The causal daily panel and its splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILL_DAYS = 7
ZONE = "Asia/Manila"


def by_series() -> Window:
    return Window.partitionBy("series").orderBy("report_date")


def fill(observed: str = "observed_price", days: int = FILL_DAYS) -> Column:
    return F.last(observed, ignorenulls=True).over(by_series().rowsBetween(-days, 0))


def _given(rows: DataFrame) -> DataFrame:
    """Each series' given rows in order: ``__day``, the ``__next`` one, and of the truth up to it the ``__last`` price and the day ``__seen``."""
    by = Window.partitionBy("series").orderBy("__day")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("observed_price").isNotNull()
    return rows.where("report_date IS NOT NULL").select("series", F.col("report_date").alias("__day"), "observed_price").withColumns({
        "__next": F.lead("__day").over(by), "__last": F.last("observed_price", ignorenulls=True).over(upto),
        "__seen": F.last(F.when(known, F.col("__day")), ignorenulls=True).over(upto),
    })


def series_names() -> dict[str, Column]:
    """The category and the product that a series' id begins with."""
    parts = F.split("series", r"\|\|")
    return {"product_category": parts[0], "product_name": parts[1]}


def _dense(rows: DataFrame, end: Column | None = None) -> DataFrame:
    """Every day from a series' first row to its last one, or to ``end`` of that row.

    Each row is dealt to the days before the next one, with the last truth up to it: only given rows are
    shuffled and sorted, and no side of a join grows by days after its size was judged.
    """
    until = F.greatest("__day", F.coalesce(F.date_sub("__next", 1), F.col("__day") if end is None else end))
    later = F.explode(F.sequence(F.lit(0), F.datediff(until, "__day"))).alias("__later")  # numbers: a sequence of dates goes through time zones
    days = _given(rows).select("*", *[c.alias(n) for n, c in series_names().items()], later).withColumn("report_date", F.date_add("__day", F.col("__later")))
    truth = F.when(F.col("__later") == 0, F.col("observed_price"))
    carried = F.when(F.datediff("report_date", "__seen") <= FILL_DAYS, F.col("__last"))
    return days.select("series", "report_date", truth.alias("observed_price"), carried.alias("price_index"), truth.isNotNull().alias("is_observed"), "product_category", "product_name")


def known_runs(rows: DataFrame) -> DataFrame:
    """The days of ``reindex_daily`` that have a price, as runs of one price: ``series, first_day, last_day, price_index``, at most a row per given row.

    They stand in the order of series and day, so a window over them sorts nothing and no day is made.
    """
    until = F.greatest("__day", F.coalesce(F.date_sub("__next", 1), F.col("__day")))
    runs = _given(rows).select("series", F.col("__day").alias("first_day"), F.least(until, F.date_add("__seen", FILL_DAYS)).alias("last_day"), F.col("__last").alias("price_index"))
    return runs.where("price_index IS NOT NULL AND first_day <= last_day")


def reindex_daily(rows: DataFrame) -> DataFrame:
    """PN1: every day from a series' first to its last; the input price is the truth carried at most a week."""
    return _dense(rows)


def extend_to(rows: DataFrame, origin: str) -> DataFrame:
    """PN2: every series up to one issue day; a later row is an error."""
    day = F.lit(origin).cast("date")
    return _dense(rows, F.when(F.col("__day") <= day, day).otherwise(F.raise_error(F.lit("rows after the origin")).cast("date")))


def as_of(rows: DataFrame, cutoff: str) -> DataFrame:
    """PN3: the panel as known at a UTC instant: a report is known at the end of its day in Manila."""
    day = F.date_sub(F.to_date(F.from_utc_timestamp(F.lit(cutoff).cast("timestamp"), ZONE)), 0)
    return reindex_daily(rows.where(F.col("report_date") <= day))


def label_audit(rows: DataFrame, cutoff_day: str) -> DataFrame:
    """PN4: labels observed, available at the cutoff and after it."""
    late = F.col("report_date") > F.lit(cutoff_day).cast("date")
    return rows.agg(
        F.count("*").alias("n"), F.count_if("is_observed").alias("observed"), F.count_if(F.col("is_observed") & ~late).alias("available"),
        F.count_if(F.col("is_observed") & late).alias("after_cutoff"), F.round(F.count_if(F.col("is_observed") & ~late) / F.count("*"), 6).alias("coverage"),
    )


def split(rows: DataFrame, first: float, second: float | None = None) -> DataFrame:
    """PN5: ``split`` by distinct days in order: train, (validation,) test at int(n * fraction)."""
    days = rows.select("report_date").distinct()
    # a row per calendar day: one ordered window over it is small
    ranked = days.withColumn("__i", F.row_number().over(Window.orderBy("report_date")) - 1).withColumn("__n", F.count("*").over(Window.partitionBy()))
    cut = lambda f: F.min(F.when(F.col("__i") >= F.floor(F.col("__n") * f), F.col("report_date")))
    cuts = ranked.agg(cut(first).alias("__a"), (cut(second) if second else F.lit(None).cast("date")).alias("__b"))
    out = rows.join(F.broadcast(cuts))  # one row
    label = F.when(F.col("report_date") < F.col("__a"), "train").when(F.col("__b").isNotNull() & (F.col("report_date") < F.col("__b")), "validation").otherwise("test")
    return out.withColumn("split", label).drop("__a", "__b")


def split_bounds(rows: DataFrame) -> DataFrame:
    """PN6"""
    return rows.groupBy("split").agg(F.min("report_date").alias("first_day"), F.max("report_date").alias("last_day"), F.count("*").alias("n"), F.count_if("is_observed").alias("observed"))


def violations(rows: DataFrame) -> DataFrame:
    """PN7: rows whose day is not the day after the row before."""
    step = F.datediff("report_date", F.lag("report_date").over(by_series()))
    return rows.withColumn("step", step).where("step <> 1").select("series", "report_date", "step")


def eligibility(panel: DataFrame, min_history: int = 30) -> DataFrame:
    """PN8: how each series can be served at its last day: by the model, by its last price, or not."""
    out = panel.groupBy("series").agg(
        F.max_by("price_index", "report_date").alias("last_price"), F.max(F.when(F.col("is_observed"), F.col("report_date"))).alias("last_observed"), F.count_if("is_observed").alias("n_observed"),
    )
    state = F.when(F.col("last_price").isNull(), "unavailable").when(F.col("n_observed") >= min_history, "model").otherwise("persistence")
    return out.withColumn("served_by", state)
