"""Scoring of forecasts: metrics, breakdowns, published periods, coverage and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NEAR_ZERO = 1e-8


def metrics(forecast: str, actual: str = "actual", anchor: str | None = None) -> list[Column]:
    """SC1, SC2 as aggregates of one pass; directions need the anchor."""
    e, a = F.col(forecast) - F.col(actual), F.col(actual)
    eligible = F.abs(a) >= NEAR_ZERO
    ape = F.when(eligible, F.abs(e / a))
    out = [
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(ape)).alias("mape"),
        F.when(F.var_pop(a) > 0, 1 - F.avg(e * e) / F.var_pop(a)).alias("r2"), F.avg((ape <= 0.05).cast("double")).alias("within_5"),
        F.count_if(ape <= 0.10).alias("within_10"), F.count_if(eligible).alias("eligible"), F.count_if(~eligible).alias("near_zero"),
    ]
    if anchor:
        out.append(F.avg((F.signum(a - F.col(anchor)) == F.signum(F.col(forecast) - F.col(anchor))).cast("double")).alias("direction"))
    return out


def scored(rows: DataFrame, forecast: str, keys: list[str] | None = None, anchor: str | None = None) -> DataFrame:
    known = rows.where(F.col("actual").isNotNull() & F.col(forecast).isNotNull())
    return known.groupBy(*(keys or [])).agg(*metrics(forecast, "actual", anchor))


def breakdown(rows: DataFrame, forecast: str, sets: list[list[str]], columns: list[str]) -> DataFrame:
    """SC3, SC15: several groupings in one pass; ``level`` names the grouping."""
    known = rows.where(F.col("actual").isNotNull())
    out = known.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(F.grouping_id().alias("gid"), *metrics(forecast))
    n = len(columns)
    names = {sum(1 << (n - 1 - columns.index(c)) for c in columns if c not in s): "+".join(s) or "all" for s in sets}
    level = F.create_map(*[F.lit(x) for gid, name in names.items() for x in (gid, name)])
    return out.withColumn("level", F.try_element_at(level, F.col("gid").cast("int"))).drop("gid")


def compare_forecasters(rows: DataFrame, forecasters: list[str], base: str = "persistence") -> DataFrame:
    """SC4: metrics of each forecast column, and the improvement on ``base`` in percent."""
    long = rows.where("actual IS NOT NULL").select("actual", F.explode(F.array(*[F.struct(F.lit(f).alias("model"), F.col(f).alias("value")) for f in forecasters])).alias("x")).select("actual", "x.*")
    table = long.groupBy("model").agg(*metrics("value"))
    floor = table.where(F.col("model") == base).select(F.col("mae").alias("base_mae"))
    return table.join(F.broadcast(floor)).withColumn("improvement", 100 * (1 - F.try_divide("mae", "base_mae"))).drop("base_mae")  # one row


def cents(price: Column) -> Column:
    """SC5: half-even cents."""
    return F.bround(price.cast("decimal(20,6)"), 2)


def published(rows: DataFrame, price: str = "price") -> DataFrame:
    """SC6: daily rows in cents, calendar weeks and months as decimal means of the rounded days, steps and coverage."""
    daily = rows.select("series", "origin", "date", cents(F.col(price)).alias("price"))
    periods = []
    for name, start, end in (("daily", F.col("date"), F.col("date")), ("weekly", F.to_date(F.date_trunc("week", "date")), F.date_add(F.to_date(F.date_trunc("week", "date")), 6)), ("monthly", F.trunc("date", "month"), F.last_day("date"))):
        part = daily.withColumns({"period_start": start, "period_end": end})
        total = F.sum("price").cast("decimal(24,6)") / F.count("*")
        periods.append(part.groupBy("series", "origin", "period_start", "period_end").agg(F.bround(total.cast("decimal(24,8)"), 2).cast("decimal(20,2)").alias("price"), F.count("*").alias("covered_days")).withColumn("grain", F.lit(name)))
    out = periods[0].unionByName(periods[1]).unionByName(periods[2])
    step = F.row_number().over(Window.partitionBy("series", "origin", "grain").orderBy("period_start"))
    return out.withColumns({"step": step, "period_days": F.datediff("period_end", "period_start") + 1})


def period_step(origin: Column, date: Column, grain: str) -> Column:
    """SC7: the step of a date's period from the origin's first forecast day."""
    first = F.date_add(origin, 1)
    if grain == "daily":
        return F.datediff(date, origin)
    if grain == "weekly":
        return (F.datediff(F.date_trunc("week", date), F.date_trunc("week", first)) / 7).cast("int") + 1
    return F.months_between(F.trunc(date, "month"), F.trunc(first, "month")).cast("int") + 1


def rolling_contract(rows: DataFrame, price: str = "price") -> DataFrame:
    """SC8: 7 days, 4 seven-day means and one 30-day mean from the origin day on; a missing day makes its period unavailable."""
    offset = F.datediff("date", "origin")
    spans = F.array(*[F.struct(F.lit("daily").alias("grain"), F.lit(k + 1).alias("step"), F.lit(k).alias("lo"), F.lit(k).alias("hi")) for k in range(7)], *[F.struct(F.lit("weekly").alias("grain"), F.lit(k + 1).alias("step"), F.lit(7 * k).alias("lo"), F.lit(7 * k + 6).alias("hi")) for k in range(4)], F.struct(F.lit("monthly").alias("grain"), F.lit(1).alias("step"), F.lit(0).alias("lo"), F.lit(29).alias("hi")))
    cells = rows.select("series", "origin", "date", price, offset.alias("offset"), F.explode(spans).alias("p")).select("*", "p.*")
    sums = cells.groupBy("series", "origin", "grain", "step", "lo", "hi").agg(
        F.count_if(F.col("offset").between(F.col("lo"), F.col("hi")) & F.col(price).isNotNull()).alias("days"), F.avg(F.when(F.col("offset").between(F.col("lo"), F.col("hi")), F.col(price))).alias("mean"),
        F.collect_set(F.when(F.col("offset").between(F.col("lo"), F.col("hi")) & F.col(price).isNotNull(), F.col("offset"))).alias("seen"),
    )
    full = F.col("hi") - F.col("lo") + 1
    missing = F.size(F.array_except(F.sequence("lo", "hi"), "seen"))
    return sums.select("series", "origin", "grain", "step", F.when(F.col("days") == full, F.col("mean")).alias("price"), missing.alias("missing_days"))


def saved_or_rolling(saved: DataFrame, rolling: DataFrame) -> DataFrame:
    """SC9: a saved period that matches grain, step and coverage exactly, else the average of the days."""
    ok = saved.where("covered_days = period_days").select("series", "origin", "grain", "step", F.col("price").alias("saved"))
    return rolling.join(ok, ["series", "origin", "grain", "step"], "left").select("series", "origin", "grain", "step", F.coalesce(F.col("saved").cast("double"), "price").alias("price"), F.when(F.col("saved").isNotNull(), "saved").when(F.col("price").isNotNull(), "averaged").otherwise("unavailable").alias("kind"))


def horizon_audit(rows: DataFrame, forecast: str) -> DataFrame:
    """SC10: days, and weeks and months rebuilt from observed days only: errors by grain and step, by product, and by both.

    A period with fewer observed days than it has is partial; one whose forecast or truth is not above
    zero is invalid and counts as such alone. One pass of grouping sets over the periods.
    """
    known = rows.where("actual IS NOT NULL")
    parts = [known.select("product_name", F.lit("daily").alias("grain"), F.col("horizon").alias("step"), F.col(forecast).alias("f"), F.col("actual").alias("a"), F.lit(False).alias("partial"))]
    for name, start, days in (("weekly", F.to_date(F.date_trunc("week", "date")), F.lit(7)), ("monthly", F.trunc("date", "month"), F.dayofmonth(F.last_day("start")))):
        periods = known.groupBy("product_name", "series", "origin", start.alias("start")).agg(F.avg(forecast).alias("f"), F.avg("actual").alias("a"), F.count_distinct("date").alias("days"))
        parts.append(periods.select("product_name", F.lit(name).alias("grain"), period_step(F.col("origin"), F.col("start"), name).alias("step"), "f", "a", (F.col("days") < days).alias("partial")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("invalid", ~F.coalesce((F.col("f") > 0) & (F.col("a") > 0), F.lit(False)))
    off = F.when(~F.col("invalid"), F.col("f") - F.col("a"))
    sets = [[F.col("grain"), F.col("step")], [F.col("grain"), F.col("product_name")], [F.col("grain"), F.col("step"), F.col("product_name")]]
    return every.groupingSets(sets, "grain", "step", "product_name").agg(
        F.count("*").alias("n"), F.count_if("partial").alias("partial"), F.count_if("invalid").alias("invalid"), F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse")
    )


def worst(rows: DataFrame, forecast: str, key: str, k: int = 5) -> DataFrame:
    """SC10: the k keys of largest RMSE."""
    table = rows.where("actual IS NOT NULL").groupBy(key).agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(F.col(forecast) - F.col("actual"), 2))), 6).alias("rmse"))
    return table.orderBy(F.desc("rmse"), key).limit(k)


def contract_checks(rows: DataFrame, horizon: int = 30) -> DataFrame:
    """SC11, CF1: per origin, the series and rows, and how many break a rule of the frozen contract."""
    per = rows.groupBy("series", "origin").agg(
        F.count("*").alias("n"), F.size(F.collect_set("horizon")).alias("leads"), F.min("horizon").alias("lo"), F.max("horizon").alias("hi"), F.size(F.collect_set("date")).alias("dates"),
        F.count_if(F.col("date") != F.date_add("origin", F.col("horizon"))).alias("wrong_date"), F.count_if(~(F.col("prediction") > 0)).alias("not_positive"),
    )
    full = (F.col("n") == horizon) & (F.col("leads") == horizon) & (F.col("lo") == 1) & (F.col("hi") == horizon) & (F.col("dates") == horizon)
    return per.groupBy("origin").agg(F.count("*").alias("series"), F.sum("n").alias("rows"), F.count_if(~full).alias("incomplete"), F.sum("wrong_date").alias("wrong_date"), F.sum("not_positive").alias("not_positive"))


def actuals(panel: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """SC12: in-period observed non-negative prices; and the counts of what was left out."""
    inside = F.col("report_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    kept = panel.where(inside & F.col("is_observed") & (F.col("observed_price") >= 0)).select("series", F.col("report_date").alias("date"), F.col("observed_price").alias("actual"))
    counts = panel.agg(F.count_if(~inside).alias("outside"), F.count_if(inside & ~F.col("is_observed")).alias("unobserved"), F.count_if(inside & F.col("is_observed")).alias("kept"))
    return kept, counts


def holdout_scores(rows: DataFrame, forecast: str) -> DataFrame:
    """SC13: daily, weekly and monthly scores of a forecast and of persistence on the same rows."""
    known = rows.where("actual IS NOT NULL")
    frames = [known.select(F.lit("daily").alias("grain"), "actual", F.col(forecast).alias("f"), F.col("persistence").alias("p"))]
    for name, start in (("weekly", F.to_date(F.date_trunc("week", "date"))), ("monthly", F.trunc("date", "month"))):
        frames.append(known.groupBy("series", "origin", start.alias("s")).agg(F.avg("actual").alias("actual"), F.avg(forecast).alias("f"), F.avg("persistence").alias("p")).select(F.lit(name).alias("grain"), "actual", "f", "p"))
    both = frames[0].unionByName(frames[1]).unionByName(frames[2])
    ape = lambda c: 100 * F.avg(F.abs((F.col(c) - F.col("actual")) / F.col("actual")))
    return both.groupBy("grain").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("f") - F.col("actual"))).alias("mae"), ape("f").alias("mape"), F.avg(F.abs(F.col("p") - F.col("actual"))).alias("persistence_mae"), ape("p").alias("persistence_mape"))


def target_gates(paths: DataFrame, forecast: str, targets: dict[str, tuple[str, float]]) -> DataFrame:
    """SC13: one row: whether every grain meets every target, whether all that was declared was observed, and both.

    ``targets``: a column of the scores by grain (``mae``, ``rmse``, ``mape``, ``r2``, ``within_10``) with
    ``min`` or ``max`` and a bound; a score that is missing fails. The declared scope is observed if
    every forecast day has its truth.
    """
    rows = period_rows(paths, forecast)
    e = F.col("forecast") - F.col("actual")
    scores = rows.groupBy("grain").agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.when(F.col("actual") > 0, F.abs(e) / F.col("actual")))).alias("mape"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop("actual") * F.count("*"))).alias("r2"),
        (100 * F.avg(F.when(F.col("actual") > 0, (F.abs(e) <= 0.1 * F.col("actual")).cast("int")))).alias("within_10"),
    )
    met = F.lit(True)
    for column, (side, bound) in targets.items():
        met &= F.coalesce(F.col(column) <= bound if side == "max" else F.col(column) >= bound, F.lit(False))
    by_grain = scores.select("grain", met.alias("met")).agg(F.count_if("met").alias("grains_met"), (F.count_if("met") == 3).alias("metric_target_met"))
    scope = paths.agg((F.count("*") == F.count("actual")).alias("full_scope_observed"))
    return by_grain.join(F.broadcast(scope)).withColumn("target_met", F.col("metric_target_met") & F.col("full_scope_observed"))  # one row each


def holdout_coverage(forecasts: DataFrame, truth: DataFrame) -> DataFrame:
    """SC14: keys on one side only, and series out of scope."""
    key = ["series", "date"]
    f, t = forecasts.select(*key).distinct(), truth.select(*key).distinct()
    both = f.withColumn("f", F.lit(1)).join(t.withColumn("t", F.lit(1)), key, "full")
    series = f.select("series").distinct()
    outside = t.select("series").distinct().join(series, "series", "left_anti").agg(F.count("*").alias("series_outside"))
    counts = both.agg(F.count_if(F.col("f").isNull()).alias("observed_without_forecast"), F.count_if(F.col("t").isNull()).alias("forecast_without_outcome"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("matched"))
    return counts.join(F.broadcast(outside))  # one row each


def matched_wins(rows: DataFrame, candidate: str, champion: str) -> DataFrame:
    """SC16: per origin whether the candidate wins on MAE, RMSE and MAPE; stable with 3 origins and two thirds of them won."""
    known = rows.where("actual IS NOT NULL AND actual <> 0")
    e = lambda c: F.col(c) - F.col("actual")
    per = known.groupBy("origin").agg(*[x for c in (candidate, champion) for x in (F.avg(F.abs(e(c))).alias(f"{c}_mae"), F.sqrt(F.avg(e(c) * e(c))).alias(f"{c}_rmse"), F.avg(F.abs(e(c) / F.col("actual"))).alias(f"{c}_mape"))])
    win = (F.col(f"{candidate}_mae") < F.col(f"{champion}_mae")) & (F.col(f"{candidate}_rmse") < F.col(f"{champion}_rmse")) & (F.col(f"{candidate}_mape") < F.col(f"{champion}_mape"))
    return per.agg(F.count("*").alias("origins"), F.count_if(win).alias("wins")).withColumn("stable", (F.col("origins") >= 3) & (F.col("wins") >= F.ceil(F.col("origins") * 2 / 3)))


def gate(table: DataFrame, candidate: str, champion: str, margin: float = 0.05) -> DataFrame:
    """SC17: beats persistence on MAE, RMSE, MAPE and within-10; beats the champion by the margin on the first three."""
    one = lambda name, p: table.where(F.col("model") == name).select(*[F.col(c).alias(f"{p}_{c}") for c in ("mae", "rmse", "mape", "within_10")])
    row = one(candidate, "c").join(F.broadcast(one(champion, "h"))).join(F.broadcast(one("persistence", "p")))  # one row each
    beats = (F.col("c_mae") < F.col("p_mae")) & (F.col("c_rmse") < F.col("p_rmse")) & (F.col("c_mape") < F.col("p_mape")) & (F.col("c_within_10") > F.col("p_within_10"))
    ahead = (F.col("c_mae") <= (1 - margin) * F.col("h_mae")) & (F.col("c_rmse") <= (1 - margin) * F.col("h_rmse")) & (F.col("c_mape") <= (1 - margin) * F.col("h_mape"))
    return row.select(beats.alias("beats_persistence"), ahead.alias("beats_champion"), (beats & ahead).alias("passes"))


def same_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    """SC18: keys that only one side has, and labels that differ."""
    key = ["series", "origin", "horizon"]
    both = a.select(*key, F.col("actual").alias("a"), F.lit(1).alias("x")).join(b.select(*key, F.col("actual").alias("b"), F.lit(1).alias("y")), key, "full")
    return both.agg(F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"), F.count_if(~F.col("a").eqNullSafe(F.col("b")) & F.col("x").isNotNull() & F.col("y").isNotNull()).alias("differing"))


def realized(forecasts: DataFrame, truth: DataFrame) -> DataFrame:
    """SC19: the latest vintage of every product and date (and lead bucket) against the truth: overall, per bucket, per product.

    ``forecasts``: run_id, generated_at, product_id, origin, date, lead, price. Keys of one run with
    different prices, and dates with different truths, are dropped before.
    """
    key = ["run_id", "product_id", "date"]
    f = forecasts.where(F.col("lead").between(1, 30)).groupBy(*key).agg(F.min("price").alias("price"), F.max("price").alias("hi"), F.max("generated_at").alias("generated_at"), F.min("lead").alias("lead")).where("price = hi").drop("hi")
    t = truth.groupBy("product_id", "date").agg(F.min("actual").alias("actual"), F.max("actual").alias("hi")).where("actual = hi").drop("hi")
    f = f.withColumn("bucket", F.when(F.col("lead") <= 7, "1-7").when(F.col("lead") <= 14, "8-14").otherwise("15-30"))
    newest = F.struct("generated_at", "run_id")
    overall = f.groupBy("product_id", "date").agg(F.max_by("price", newest).alias("price")).withColumn("bucket", F.lit("all"))
    buckets = f.groupBy("product_id", "date", "bucket").agg(F.max_by("price", newest).alias("price"))
    joined = overall.unionByName(buckets).join(t, ["product_id", "date"])
    e = F.abs(F.col("price") - F.col("actual"))
    return joined.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(e).alias("mae"), F.avg((e <= 0.1 * F.col("actual")).cast("double")).alias("success"))


def relative_accuracy(rows: DataFrame, forecast: str) -> DataFrame:
    """SC20"""
    known = rows.where("actual > 0")
    return known.agg(F.count("*").alias("n"), (100 - 100 * F.avg(F.abs((F.col(forecast) - F.col("actual")) / F.col("actual")))).alias("accuracy"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = hits / n
    middle, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return middle - spread, middle + spread


def hit_cells(rows: DataFrame, forecast: str, keys: list[str], least: int = 20) -> DataFrame:
    """SC21: hit rates within 10% with Wilson intervals, from ``least`` rows on."""
    cells = rows.where("actual > 0").groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.abs(F.col(forecast) - F.col("actual")) <= 0.1 * F.col("actual")).alias("hits")).where(F.col("n") >= least)
    lo, hi = wilson(F.col("hits"), F.col("n"))
    return cells.withColumns({"rate": F.col("hits") / F.col("n"), "low": lo, "high": hi})


def pooled_leads(cells: DataFrame, key: str = "series", leads: int = 7) -> DataFrame:
    """SC22: pooled hits of leads 1..7, only if each has one cell."""
    seven = cells.where(F.col("horizon").between(1, leads)).groupBy(key).agg(F.count_distinct("horizon").alias("k"), F.count("*").alias("c"), F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return seven.where((F.col("k") == leads) & (F.col("c") == leads)).select(key, "n", "hits", (F.col("hits") / F.col("n")).alias("rate"))


def exact_match(wanted: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """SC23: the one row of an identity, else none; keys compare null-safely."""
    unique = rows.withColumn("__n", F.count("*").over(Window.partitionBy(*key))).where("__n = 1").drop("__n")
    renamed = wanted.select(*[F.col(c).alias(f"__{c}") for c in key])
    condition = F.lit(True)
    for c in key:
        condition &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return renamed.join(unique, condition).drop(*[f"__{c}" for c in key])


def reliability(cells: DataFrame, keys: list[str], strength: int = 10, least: int = 20) -> DataFrame:
    """SC24: rates shrunk to the overall rate by ``strength`` origins, with a level."""
    prior = cells.agg((F.sum("hits") / F.sum("n")).alias("prior"))
    out = cells.join(F.broadcast(prior)).withColumn("shrunk", (F.col("hits") / F.col("n") * F.col("origins") + F.col("prior") * strength) / (F.col("origins") + strength))  # one row
    level = F.when(F.col("n") < least, "insufficient").when(F.col("shrunk") >= 0.8, "high").when(F.col("shrunk") >= 0.6, "moderate").otherwise("low")
    return out.withColumn("level", level).drop("prior")


def replay_parity(replayed: DataFrame, saved: DataFrame, key: list[str]) -> DataFrame:
    """SC25"""
    d = F.abs(F.col("a") - F.col("b"))
    both = replayed.select(*key, F.col("prediction").alias("a")).join(saved.select(*key, F.col("prediction").alias("b")), key)
    return both.agg(F.count("*").alias("matched"), F.avg(d).alias("mean_diff"), F.max(d).alias("max_diff"), F.count_if(d > 0.005).alias("over_half_cent"))


def period_rows(paths: DataFrame, forecast: str) -> DataFrame:
    """SC25: ``series, origin, grain, step, actual, forecast`` of days, Monday weeks and calendar months of the paths.

    A period's forecast is the mean of all its days that the path covers, its truth the mean of those
    that were observed; a period without an observation is left out, and periods keep their number.
    """
    days = paths.select("series", "origin", F.lit("daily").alias("grain"), F.col("horizon").cast("int").alias("step"), "actual", F.col(forecast).alias("forecast"))
    for grain, start in (("weekly", F.date_trunc("week", "date")), ("monthly", F.date_trunc("month", "date"))):
        periods = paths.groupBy("series", "origin", start.alias("start")).agg(F.avg("actual").alias("actual"), F.avg(forecast).alias("forecast"))
        step = F.row_number().over(Window.partitionBy("series", "origin").orderBy("start"))  # a row per period of a path
        days = days.unionByName(periods.select("series", "origin", F.lit(grain).alias("grain"), step.alias("step"), "actual", "forecast"))
    return days.where("actual IS NOT NULL")


def replay_tables(rows: DataFrame) -> DataFrame:
    """SC25: errors of ``period_rows`` by grain, by grain and step and by grain and series, in one pass; ``level`` tells which.

    MAPE is over rows of a positive truth, null without any.
    """
    e = F.col("forecast") - F.col("actual")
    sets = [[F.col("grain")], [F.col("grain"), F.col("step")], [F.col("grain"), F.col("series")]]
    out = rows.groupingSets(sets, "grain", "step", "series").agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.when(F.col("actual") > 0, 100 * F.abs(e) / F.col("actual"))).alias("mape"),
        F.grouping("step").alias("no_step"), F.grouping("series").alias("no_series"),
    )
    return out.withColumn("level", F.when(F.col("no_step") == 0, "step").when(F.col("no_series") == 0, "series").otherwise("all")).drop("no_step", "no_series")


def worst_series(tables: DataFrame, k: int = 5) -> DataFrame:
    """SC25: the ``k`` series of each grain with the largest RMSE (ties: by name)."""
    place = F.row_number().over(Window.partitionBy("grain").orderBy(F.desc(F.round("rmse", 9)), "series"))
    return tables.where("level = 'series'").withColumn("place", place).where(F.col("place") <= k)


def reconciles(parts: DataFrame, pooled: DataFrame, keys: list[str]) -> DataFrame:
    """SC26: per key, parts' samples and hits must sum to the pooled ones."""
    sums = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    both = sums.join(pooled.select(*keys, F.col("n").alias("pooled_n"), F.col("hits").alias("pooled_hits")), keys)
    return both.withColumn("reconciles", (F.col("n") == F.col("pooled_n")) & (F.col("hits") == F.col("pooled_hits")))


# Confidence


def error_samples(rows: DataFrame, forecast: str) -> DataFrame:
    """CF2: percentage errors of days, weeks and months by product, with the day the outcome is known."""
    known = rows.where("actual > 0")
    parts = [known.select("product_name", "origin", F.lit("daily").alias("grain"), F.col("horizon").alias("step"), F.col("date").alias("available"), (100 * F.abs(F.col(forecast) - F.col("actual")) / F.col("actual")).alias("ape"))]
    for name, start, end in (("weekly", F.to_date(F.date_trunc("week", "date")), F.max("date")), ("monthly", F.trunc("date", "month"), F.max("date"))):
        g = known.groupBy("product_name", "series", "origin", start.alias("s")).agg(F.avg(forecast).alias("f"), F.avg("actual").alias("a"), end.alias("available"))
        parts.append(g.select("product_name", "origin", F.lit(name).alias("grain"), period_step(F.col("origin"), F.col("s"), name).alias("step"), "available", (100 * F.abs(F.col("f") - F.col("a")) / F.col("a")).alias("ape")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def forward_check(samples: DataFrame, least: int = 8) -> DataFrame:
    """CF3: per grain, the mean loss of the plain and the conservative score, each from outcomes known at the origin.

    Running sums over a union of outcomes (by the day they become known) and origins; no self-join.
    """
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    known = samples.select("product_name", "grain", day("available").alias("t"), F.col("ape").alias("x"), F.lit(None).cast("double").alias("ape"))
    asked = samples.select("product_name", "grain", day("origin").alias("t"), F.lit(None).cast("double").alias("x"), "ape")
    upto = Window.partitionBy("product_name", "grain").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    run = known.unionByName(asked).withColumns({"k": F.count("x").over(upto), "s": F.sum("x").over(upto), "q": F.sum(F.col("x") * F.col("x")).over(upto)}).where(F.col("ape").isNotNull() & (F.col("k") >= least))
    mean = F.col("s") / F.col("k")
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("k") * mean * mean) / (F.col("k") - 1)))
    true = F.greatest(F.lit(0.0), 100 - F.col("ape"))
    plain = F.greatest(F.lit(0.0), 100 - mean)
    careful = F.greatest(F.lit(0.0), plain - sd / F.sqrt("k"))
    out = run.groupBy("grain").agg(F.count("*").alias("checked"), F.avg(F.abs(plain - true)).alias("plain_loss"), F.avg(F.abs(careful - true)).alias("careful_loss"))
    return out.withColumn("formula", F.when(F.col("careful_loss") < F.col("plain_loss"), "conservative").otherwise("plain"))


def checked_origins(samples: DataFrame, least: int = 8) -> DataFrame:
    """CF4: per product and grain the origins at which ``least`` outcomes were known before, so that a score could be checked."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    known = samples.select("product_name", "grain", day("available").alias("t"), F.lit(1).alias("x"), F.lit(None).cast("date").alias("origin"))
    asked = samples.select("product_name", "grain", day("origin").alias("t"), F.lit(0).alias("x"), "origin").distinct()
    upto = Window.partitionBy("product_name", "grain").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    run = known.unionByName(asked).withColumn("seen", F.sum("x").over(upto)).where(F.col("origin").isNotNull() & (F.col("seen") >= least))
    return run.groupBy("product_name", "grain").agg(F.count_distinct("origin").alias("checked"))


def confidence(samples: DataFrame, least: int = 8, least_origins: int = 8, least_checked: int = 3) -> DataFrame:
    """CF4: score 100 - mean APE per product and grain, a level, or the reasons for none."""
    out = samples.groupBy("product_name", "grain").agg(F.count("*").alias("n"), F.count_distinct("origin").alias("origins"), F.avg("ape").alias("mape"))
    out = out.join(checked_origins(samples, least), ["product_name", "grain"], "left").fillna(0, ["checked"])
    reasons = F.concat_ws(",", F.when(F.col("n") < least, "few_samples"), F.when(F.col("origins") < least_origins, "few_origins"), F.when(F.col("checked") < least_checked, "few_checked"))
    score = F.greatest(F.lit(0.0), 100 - F.col("mape"))
    out = out.withColumns({"reasons": reasons, "score": F.when(reasons == "", score)})
    return out.withColumn("level", F.when(F.col("score").isNull(), "unavailable").when(F.col("score") >= 90, "high").when(F.col("score") >= 80, "moderate").otherwise("low"))


def label_coverage(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """CF5: per product, grain and step of the paths: calendar days, days covered by the path, observed labels, partial periods.

    A period (a day, week or month) is partial where the path covers fewer days than it has; below
    ``least`` observed of covered days the score is withheld.
    """
    parts = []
    for name, start, days in (("daily", F.col("date"), F.lit(1)), ("weekly", F.to_date(F.date_trunc("week", "date")), F.lit(7)), ("monthly", F.trunc("date", "month"), F.dayofmonth(F.last_day("start")))):
        periods = rows.groupBy("product_name", "series", "origin", start.alias("start")).agg(F.count("*").alias("covered"), F.count("actual").alias("observed"), F.min("horizon").alias("lead"))
        step = F.col("lead") if name == "daily" else period_step(F.col("origin"), F.col("start"), name)
        parts.append(periods.select("product_name", F.lit(name).alias("grain"), step.alias("step"), "covered", "observed", days.alias("calendar")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out = every.groupBy("product_name", "grain", "step").agg(
        F.sum("calendar").alias("calendar"), F.sum("covered").alias("covered"), F.sum("observed").alias("observed"), F.count_if(F.col("covered") < F.col("calendar")).alias("partial")
    )
    share = F.col("observed") / F.col("covered")
    return out.withColumns({"coverage": share, "withheld": share < least})


def interval_coverage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """CF6: share of actuals in [low, high]; any broken interval makes the group invalid, none at all insufficient."""
    bad = F.col("low").isNull() | F.col("high").isNull() | (F.col("low") > F.col("high")) | F.col("actual").isNull()
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_or(bad).alias("bad"), F.count_if(F.col("actual").between(F.col("low"), F.col("high"))).alias("covered"))
    return out.withColumns({"status": F.when(F.col("n") == 0, "insufficient").when(F.col("bad"), "invalid").otherwise("ok"), "picp": F.when(~F.col("bad"), 100 * F.col("covered") / F.col("n"))}).drop("bad")


def admitted_coverage(cells: DataFrame, least: int = 10, calibration: int = 19, origins: int = 4) -> DataFrame:
    """CF7"""
    return cells.where((F.col("status") == "ok") & (F.col("n") >= least) & (F.col("calibration_rows") >= calibration) & (F.col("calibration_origins") >= origins) & (F.abs(F.col("picp") - 100 * F.col("covered") / F.col("n")) <= 0.01))


def confidence_vs_holdout(conf: DataFrame, holdout: DataFrame) -> DataFrame:
    """CF8: by level, how far the score was from 100 - MAPE of the holdout."""
    both = conf.join(holdout.select("product_name", F.col("mape").alias("holdout_mape")), "product_name", "left")
    off = F.col("score") - (100 - F.col("holdout_mape"))
    return both.groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("holdout_mape").isNull() | F.col("score").isNull()).alias("missing"), F.avg(off).alias("bias"), F.avg(F.abs(off)).alias("error"))
