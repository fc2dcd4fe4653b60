"""Exact quantiles by distributed selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import kept

#: Parts into which the values around a rank are cut in each round.
PARTS = 64
#: Accuracy of the sketch that says where to cut; counts are exact whatever it says.
ACCURACY = 2000
#: Values among which a rank is looked up in one task.
SMALL = 200_000


def exact_quantiles(rows: DataFrame, column: str, probabilities: list[float], keys: list[str] | None = None) -> DataFrame:
    """``keys, quantiles`` (an array in the order of ``probabilities``): values interpolated between the two ranks around ``p * (n - 1)``.

    A sketch of bounded size proposes cuts; rows are counted between them (and on each of them, so that a
    value that is repeated without end is a part of its own), and the part that holds a rank is cut again
    until it has ``SMALL`` rows or one value. So no task holds more than that, whatever the values and
    their repetition, and a round reads only rows that are still in question. Nulls and NaN don't count; a
    key without values has no row; null keys are a key.
    """
    keys = keys or []
    v = F.col("v")
    base = rows.select(F.struct(*[F.col(k) for k in keys] or [F.lit(0).alias("all")]).alias("key"), F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    base = kept(base, "quantile-values")
    facts = base.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    places = F.posexplode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("i", "p")
    wanted = kept(facts.select("key", "n", "lo", "hi", places).withColumn("at", F.col("p") * (F.col("n") - 1)), "quantile-ranks")
    ranks = wanted.select("key", "lo", "hi", "n", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    # key, rank, the values it lies between, rows below them and between them
    open_ = kept(ranks.select("key", "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("size")), "quantile-open")
    found = None
    while True:
        part = ["key", "lo", "hi"]
        settled = open_.where("lo = hi").select("key", "rank", F.col("lo").alias("value"))
        small = open_.where(f"lo < hi AND size <= {SMALL}")
        values = base.join(small.select(*part).distinct(), "key").where(v.between(F.col("lo"), F.col("hi")))
        values = values.groupBy(*part).agg(F.sort_array(F.collect_list("v")).alias("values"))  # at most SMALL values
        looked_up = small.join(values, part).select("key", "rank", F.element_at("values", (F.col("rank") - F.col("below") + 1).cast("int")).alias("value"))
        done = kept(settled.union(looked_up), "quantile-found")
        found = done if found is None else found.union(done)
        large = open_.where(f"lo < hi AND size > {SMALL}")
        if large.isEmpty():
            break
        inside = base.join(large.select(*part).distinct(), "key").where(v.between(F.col("lo"), F.col("hi")))
        cuts = inside.groupBy(*part).agg(F.array_sort(F.array_distinct(F.percentile_approx("v", [k / PARTS for k in range(PARTS + 1)], ACCURACY))).alias("cuts"))
        placed = inside.join(cuts, part)
        at = F.size(F.filter("cuts", lambda c: c <= v))
        placed = placed.select(*part, at.alias("cut"), (F.get("cuts", at - 1) < v).alias("beyond"), "v")
        counts = placed.groupBy(*part, "cut", F.coalesce("beyond", F.lit(True)).alias("beyond")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*part).orderBy("cut", "beyond").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per cut
        counts = counts.withColumn("before", before)
        narrowed = large.join(counts, part).where("rank >= below + before AND rank < below + before + n")
        open_ = kept(narrowed.select("key", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("before")).alias("below"), F.col("n").alias("size")), "quantile-open")
    at = lambda side: found.select("key", F.col("rank").alias(f"rank_{side}"), F.col("value").alias(side))
    both = wanted.select("key", "i", "at", F.floor("at").alias("rank_low"), F.ceil("at").alias("rank_high")).join(at("low"), ["key", "rank_low"]).join(at("high"), ["key", "rank_high"])
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.col("rank_low"))
    out = both.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", value.alias("x")))).alias("xs"))  # a value per probability
    return out.select(*[F.col(f"key.{k}").alias(k) for k in keys], F.transform("xs", lambda x: x["x"]).alias("quantiles"))


def quantile(quantiles: Column, k: int) -> Column:
    return F.get(quantiles, k)
