"""Calibration of blends: small grids, summed errors per candidate, the lowest candidate on ties."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def grid(lo: float, hi: float, step: float) -> Column:
    """The candidates as an array column: exploding it takes the place of a cross join."""
    n = round((hi - lo) / step)
    return F.array(*[F.lit(round(lo + k * step, 10)) for k in range(n + 1)])


def cutoff(days: DataFrame, share: float = 2 / 3) -> DataFrame:
    """CA1: one row, the origin at ``share`` of the distinct ``origin`` days."""
    ranked = days.select("origin").distinct().withColumn("i", F.row_number().over(Window.orderBy("origin")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))  # a row per origin
    return ranked.where(F.col("i") == F.least(F.floor(F.col("n") * share), F.col("n") - 1)).select(F.col("origin").alias("cutoff"))


def parted(rows: DataFrame) -> DataFrame:
    """CA1: rows with a ``cutoff``: tuning rows end by it, calibration origins start there; rows across it are purged."""
    return rows.withColumn("part", F.when(F.col("date") <= F.col("cutoff"), "tuning").when(F.col("origin") >= F.col("cutoff"), "calibration")).where("part IS NOT NULL").drop("cutoff")


def split_forecasts(rows: DataFrame, share: float = 2 / 3) -> DataFrame:
    """CA1: ``parted`` by the ``cutoff`` of the rows' own origins."""
    return parted(rows.join(F.broadcast(cutoff(rows, share))))  # one row


def blend_weight(rows: DataFrame, a: str, b: str, keys: list[str] | None = None, candidates: Column | None = None) -> DataFrame:
    """CA2: the weight of ``b`` with the least mean absolute error, per ``keys``."""
    keys = keys or []
    tried = rows.where("actual IS NOT NULL").select(*keys, "actual", a, b, F.explode(candidates if candidates is not None else grid(0, 1, 0.01)).alias("w"))
    error = tried.groupBy(*keys, "w").agg(F.avg(F.abs((1 - F.col("w")) * F.col(a) + F.col("w") * F.col(b) - F.col("actual"))).alias("mae"))
    return error.groupBy(*keys).agg(F.min(F.struct(F.round("mae", 9).alias("mae"), "w")).alias("x")).select(*keys, F.col("x.w").alias("weight"), F.col("x.mae").alias("mae"))


def _error_sums(rows: DataFrame, value: Column, keys: list[str]) -> DataFrame:
    """By ``keys``: rows and sums of the absolute, squared and relative errors of ``value`` and of persistence."""
    e, b = value - F.col("actual"), F.col("persistence") - F.col("actual")
    terms = {"e1": F.abs(e), "e2": e * e, "e3": F.abs(e / F.col("actual")), "b1": F.abs(b), "b2": b * b, "b3": F.abs(b / F.col("actual"))}
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(v).alias(c) for c, v in terms.items()])


def _ratio_score() -> Column:
    """The sum of MAE, RMSE and MAPE, each over that of persistence, from the sums of ``_error_sums``."""
    mean = lambda c: F.sqrt(F.col(c) / F.col("n")) if c.endswith("2") else F.col(c) / F.col("n")
    return F.round(sum(mean(f"e{k}") / F.greatest(mean(f"b{k}"), F.lit(1e-12)) for k in (1, 2, 3)), 9)


_SUMS = ("n", "e1", "e2", "e3", "b1", "b2", "b3")


def _trust_sums(rows: DataFrame, forecast: str, keys: list[str], step: float) -> DataFrame:
    tried = rows.where("actual IS NOT NULL AND actual <> 0").select(*keys, "actual", "persistence", forecast, F.explode(grid(0, 1, step)).alias("t"))
    return _error_sums(tried, F.col("persistence") + F.col("t") * (F.col(forecast) - F.col("persistence")), [*keys, "t"])


def horizon_trust(rows: DataFrame, forecast: str, horizon: int = 30, step: float = 0.01) -> DataFrame:
    """CA3: per horizon 1 to ``horizon`` how far from persistence towards the forecast, by ``_ratio_score``.

    A horizon of fewer than two rows is judged by the rows of all horizons; without any rows trust is 1.
    ``n`` counts the horizon's own rows. One pass over the rows; the fallback adds up the sums by horizon.
    """
    sums = _trust_sums(rows, forecast, ["horizon"], step)
    spark = rows.sparkSession
    own = sums.groupBy("horizon").agg(F.max("n").alias("own"), F.min(F.struct(_ratio_score().alias("score"), "t")).alias("x"))
    whole = sums.groupBy("t").agg(*[F.sum(c).alias(c) for c in _SUMS]).agg(F.min(F.struct(_ratio_score().alias("score"), "t")).alias("all"))
    every = spark.range(1, horizon + 1).select(F.col("id").cast("int").alias("horizon"))
    out = every.join(own, "horizon", "left").join(F.broadcast(whole))  # one row
    n = F.coalesce("own", F.lit(0)).cast("long")
    return out.select("horizon", n.alias("n"), F.coalesce(F.when(n < 2, F.col("all.t")).otherwise(F.col("x.t")), F.lit(1.0)).alias("trust"))


def group_trust(rows: DataFrame, forecast: str, keys: list[str], step: float = 0.05, least_rows: int = 10) -> DataFrame:
    """CA4: the same per ``keys``, to be applied to the path after CA3; groups of fewer than ``least_rows`` rows get trust 1."""
    sums = _trust_sums(rows, forecast, keys, step)
    best = sums.groupBy(*keys).agg(F.max("n").alias("n"), F.min(F.struct(_ratio_score().alias("score"), "t")).alias("x"))
    return best.select(*keys, "n", F.when(F.col("n") < least_rows, 1.0).otherwise(F.col("x.t")).alias("trust"))


#: What CA5 tries (fixed values).
THRESHOLDS, STRENGTHS, DECAYS = (0.15, 0.2, 0.25, 0.3, 0.5, 0.75, 1.0), (0.25, 0.5, 0.75, 1.0), (1.0, 3.0, 7.0, 14.0)


def reversion(rows: DataFrame, forecast: str, reference: str = "moving_average7") -> DataFrame:
    """CA5: threshold, strength and decay of moving anomalous anchors to their reference, if any lowers the score of the forecast.

    One row with ``score`` and ``base`` (the forecast as it is); where nothing helps, a threshold that no
    anchor exceeds, strength 0 and decay 1. A triple that touches no row is
    not tried; of equal scores the first in the order of threshold, strength and decay stands.
    """
    triples = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(s).alias("strength"), F.lit(d).alias("decay")) for t in THRESHOLDS for s in STRENGTHS for d in DECAYS])
    known = rows.where("actual IS NOT NULL AND actual <> 0")
    tried = known.select("actual", "persistence", "anchor", "horizon", forecast, reference, F.explode(triples).alias("g")).select("*", "g.*")
    hit = F.coalesce(F.abs(F.ln(F.col("anchor") / F.col(reference))) > F.col("threshold"), F.lit(False))
    pull = F.col("strength") * (1 - F.exp(-F.col("horizon") / F.col("decay")))
    moved = F.when(hit, F.col(forecast) + pull * (F.col(reference) - F.col(forecast))).otherwise(F.col(forecast))
    keys = ["threshold", "strength", "decay"]
    sums = _error_sums(tried.withColumns({"__moved": moved, "__hit": hit}).drop(forecast), F.col("__moved"), [*keys, "__hit"])
    scores = sums.groupBy(*keys).agg(F.bool_or("__hit").alias("hits"), *[F.sum(c).alias(c) for c in _SUMS]).where("hits").select(*keys, _ratio_score().alias("score"))
    base = _error_sums(known, F.col(forecast), []).select(_ratio_score().alias("base"))
    best = scores.agg(F.min(F.struct("score", *keys)).alias("x"))
    none = {"score": F.col("base"), "threshold": F.lit(1e9), "strength": F.lit(0.0), "decay": F.lit(1.0)}
    both = base.join(F.broadcast(best)).select("base", F.col("x.score").alias("score"), *[F.col(f"x.{c}").alias(c) for c in keys])  # one row each
    helps = F.coalesce(F.col("score") < F.col("base"), F.lit(False))
    return both.select(*[F.when(helps, F.col(c)).otherwise(v).alias(c) for c, v in none.items()], "base")


def references(panel: DataFrame) -> DataFrame:
    """CA6: mean-7 and medians of 7, 14 and 30 of the known prices up to each day."""
    known = panel.where("price_index IS NOT NULL")
    upto = lambda w: Window.partitionBy("series").orderBy("report_date").rowsBetween(-w + 1, 0)
    out = {"mean_7": F.avg("price_index").over(upto(7))} | {f"median_{w}": F.percentile("price_index", F.lit(0.5)).over(upto(w)) for w in (7, 14, 30)}
    return known.select("series", "report_date", *[c.alias(n) for n, c in out.items()])


def horizon_bin(h: Column) -> Column:
    """CA7"""
    return F.when(h <= 3, "01-03").when(h <= 7, "04-07").when(h <= 14, "08-14").when(h <= 21, "15-21").otherwise("22-30")


def specialists(rows: DataFrame, forecast: str, alternatives: list[str], least_rows: int = 20, gain: float = 0.9975) -> DataFrame:
    """CA8: per product and horizon bin an alternative that both halves of the origins pick, and that helps the other half.

    The earlier half are the first half of the distinct origins (of fewer than four there is no result).
    A half of ``least_rows`` rows or more picks the alternative and weight (.05 to .5) of least mean ratio
    of MAE, RMSE and MAPE to those of the forecast, if that is below 1; of equal ones the first in the
    order of ``alternatives``, then the lesser weight. Both must pick one alternative, and each pick must
    lower all three errors of the other half, and their mean ratio to ``gain``. The lesser weight is kept.
    """
    known = rows.where("actual IS NOT NULL").withColumn("bin", horizon_bin(F.col("horizon")))
    days = known.select("origin").distinct().withColumns({"i": F.row_number().over(Window.orderBy("origin")), "k": F.count("*").over(Window.partitionBy())})  # a row per origin
    cutoff = days.where("k >= 4 AND i = floor(k / 2)").select(F.col("origin").alias("__cutoff"))
    known = known.join(F.broadcast(cutoff)).withColumn("half", F.when(F.col("origin") <= F.col("__cutoff"), "early").otherwise("late"))  # one row
    group = ["product_category", "product_name", "bin"]
    # rows move once, to their group, and not a sum for each of the candidates; these are made and compared where the rows are
    own = dict.fromkeys((*group, "half", "actual", forecast, *alternatives))
    picks = F.array(*[F.struct(F.lit(k).alias("place"), F.col(a).alias("v")) for k, a in enumerate(alternatives)])
    moved = known.where("product_category IS NOT NULL AND product_name IS NOT NULL").select(*own).repartition(*group, "half")
    tried = moved.select(*group, "half", "actual", F.col(forecast).alias("f"), F.explode(picks).alias("x")).select("*", "x.*")
    weights = [round(0.05 * k, 10) for k in range(1, 11)]
    base = F.col("f") - F.col("actual")
    err = [(1 - F.lit(w)) * F.col("f") + F.lit(w) * F.col("v") - F.col("actual") for w in weights]
    scale = F.greatest(F.abs("actual"), F.lit(1e-8))
    terms = lambda e: (F.avg(F.abs(e)), F.avg(e * e), F.avg(F.abs(e) / scale))
    sums = tried.groupBy(*group, "half", "place").agg(F.count("*").alias("n"), *[a.alias(f"b{q}") for q, a in enumerate(terms(base))], *[a.alias(f"e{q}_{k}") for k, e in enumerate(err) for q, a in enumerate(terms(e))])
    root = lambda c, q: F.sqrt(c) if q == 1 else F.col(c)
    least = lambda q, k: F.when(root(f"b{q}", q) > 1e-12, root(f"e{q}_{k}", q) / root(f"b{q}", q)).alias(f"q{q + 1}")  # noqa: E731  an error of zero can't be lowered
    each = F.array(*[F.struct(F.lit(w).alias("w"), *[least(q, k) for q in range(3)]) for k, w in enumerate(weights)])
    ratios = sums.where(F.col("n") >= least_rows).select(*group, "half", "place", F.inline(each)).withColumn("mean_ratio", F.round((F.col("q1") + F.col("q2") + F.col("q3")) / 3, 9))
    ok = (F.col("q1") < 1) & (F.col("q2") < 1) & (F.col("q3") < 1) & (F.col("mean_ratio") <= gain)
    halves = ratios.where((F.col("mean_ratio") < 1) | ok).groupBy(*group, "half").agg(
        F.min(F.when(F.col("mean_ratio") < 1, F.struct("mean_ratio", "place", "w"))).alias("p"), F.collect_list(F.when(ok, F.struct("place", "w"))).alias("good"),
    )
    of = lambda half, c: F.max(F.when(F.col("half") == half, F.col(c)))
    both = halves.groupBy(*group).agg(*[of(half, c).alias(f"{half}_{c}") for half in ("early", "late") for c in ("p", "good")])
    helps = lambda half, other: F.array_contains(F.col(f"{other}_good"), F.struct(F.col(f"{half}_p.place"), F.col(f"{half}_p.w")))
    name = lambda half: F.element_at(F.array(*[F.lit(a) for a in alternatives]), F.col(f"{half}_p.place") + 1)
    both = both.where("early_p IS NOT NULL AND late_p IS NOT NULL").where(helps("early", "late") & helps("late", "early") & (name("early") == name("late")))
    return both.select(*group, name("early").alias("alternative"), F.least("early_p.w", "late_p.w").alias("weight"))


#: The layers of the blend, in the order in which they apply.
LAYERS = ("weight", "horizon", "category", "anomaly", "special")


def fit_layers(rows: DataFrame, a: str, b: str, alternatives: list[str], write: Callable[[DataFrame, str], DataFrame], upto: str = "special") -> dict[str, DataFrame]:
    """CA2 to CA5 and CA8 in order, each fitted to the path that the earlier ones give; a table of parameters by layer, up to ``upto``.

    ``write(table, name)`` gives a table back from storage: a later fit reads the parameters and does not
    fit the earlier layers again.
    """
    none = {layer: None for layer in LAYERS}
    found: dict[str, DataFrame] = {}
    path = lambda: with_layers(rows, **(none | found)).withColumn("__path", blended(a, b))
    fits = {
        "weight": lambda: blend_weight(rows, a, b), "horizon": lambda: horizon_trust(path(), "__path"), "category": lambda: group_trust(path(), "__path", ["product_category", "horizon"]),
        "anomaly": lambda: reversion(path(), "__path"), "special": lambda: specialists(path(), "__path", alternatives),
    }
    for layer in LAYERS:
        found[layer] = write(fits[layer](), f"layer-{layer}")
        if layer == upto:
            break
    return found


def with_layers(rows: DataFrame, weight: DataFrame, horizon: DataFrame | None, category: DataFrame | None, anomaly: DataFrame | None, special: DataFrame | None) -> DataFrame:
    """CA9: the rows with the parameters of every layer (columns from ``__w`` on), null where a layer has none or isn't fitted yet.

    Parameter tables have a row per key and are small; the optimizer broadcasts them by their size.
    """
    none = lambda **kinds: {c: F.lit(None).cast(t) for c, t in kinds.items()}
    out = rows.join(F.broadcast(weight.select(F.col("weight").alias("__w"))))  # one row
    out = out.withColumns(none(__h="double")) if horizon is None else out.join(horizon.select("horizon", F.col("trust").alias("__h")), "horizon", "left")
    keys = ["product_category", "horizon"]
    out = out.withColumns(none(__c="double")) if category is None else out.join(category.select(*keys, F.col("trust").alias("__c")), keys, "left")
    if anomaly is None:
        out = out.withColumns(none(__t="double", __s="double", __d="double"))
    else:
        one = anomaly.agg(F.first("threshold").alias("__t"), F.first("strength").alias("__s"), F.first("decay").alias("__d"))
        out = out.join(F.broadcast(one))  # one row
    if special is None:
        return out.withColumns(none(__a="string", __x="double"))
    keys = ["product_category", "product_name", "bin"]
    out = out.withColumn("bin", horizon_bin(F.col("horizon")))
    return out.join(special.select(*keys, F.col("alternative").alias("__a"), F.col("weight").alias("__x")), keys, "left").drop("bin")


def blended(a: str, b: str, on: dict[str, Column] | None = None) -> Column:
    """CA9: the blend of rows of ``with_layers``: weight, horizon trust, category trust, anomaly reversion, specialists, in that order.

    ``on``: for a layer a condition under which it applies; without one it does.
    """
    use = lambda layer: (on or {}).get(layer, F.lit(True))
    w = F.when(use("weight"), F.col("__w")).otherwise(0.0)
    mixed = (1 - w) * F.col(a) + w * F.col(b)
    trusted = [F.when(use(layer), F.coalesce(c, F.lit(1.0))).otherwise(1.0) for layer, c in (("horizon", "__h"), ("category", "__c"))]
    value = F.col("persistence") + trusted[0] * trusted[1] * (mixed - F.col("persistence"))
    hit = use("anomaly") & F.coalesce(F.abs(F.ln(F.col("anchor") / F.col("moving_average7"))) > F.col("__t"), F.lit(False))
    value = F.when(hit, value + F.col("__s") * (1 - F.exp(-F.col("horizon") / F.col("__d"))) * (F.col("moving_average7") - value)).otherwise(value)
    picked = F.coalesce(*[F.when(F.col("__a") == c, F.col(c)) for c in dict.fromkeys((a, b, "persistence", "moving_average7"))])
    return F.when(use("special") & picked.isNotNull(), value + F.col("__x") * (picked - value)).otherwise(value)


def residual_bias(rows: DataFrame, forecast: str, group: list[str], k: float = 50.0) -> DataFrame:
    """CA11: mean relative residual per group and bin, shrunk to the bin's by k / (n + k)."""
    known = rows.where("actual IS NOT NULL").withColumn("bin", horizon_bin(F.col("horizon"))).withColumn("r", (F.col("actual") - F.col(forecast)) / F.col(forecast))
    wide = known.groupBy("bin").agg(F.avg("r").alias("bin_bias"))
    own = known.groupBy(*group, "bin").agg(F.count("*").alias("n"), F.avg("r").alias("own"))
    return own.join(wide, "bin").withColumn("bias", (F.col("n") * F.col("own") + k * F.col("bin_bias")) / (F.col("n") + k)).drop("own")


def regime_trust(rows: DataFrame, forecast: str, gain: float = 0.9975) -> DataFrame:
    """CA12: per bin, direction and size of the forecast move an alpha (0 to 1.5) that both halves support; 1 otherwise.

    Each half picks its alpha by mean absolute error; it stays if it lowers the other half's error to
    ``gain`` or less on both sides; of the two the one nearest to 1 is taken.
    """
    known = rows.where("actual IS NOT NULL").withColumn("bin", horizon_bin(F.col("horizon")))
    move = F.col(forecast) / F.col("anchor") - 1
    size = F.when(F.abs(move) < 0.01, "small").when(F.abs(move) < 0.05, "middle").otherwise("large")
    middle = known.agg(F.percentile(F.datediff("origin", F.lit("1970-01-01").cast("date")), F.lit(0.5)).alias("middle"))
    known = known.join(F.broadcast(middle)).withColumns({"sign": F.signum(move).cast("int"), "size": size, "half": F.when(F.datediff("origin", F.lit("1970-01-01").cast("date")) <= F.col("middle"), 0).otherwise(1)})
    keys = ["bin", "sign", "size"]
    tried = known.select(*keys, "half", "actual", "anchor", F.col(forecast).alias("f"), F.explode(grid(0, 1.5, 0.1)).alias("alpha"))
    err = F.avg(F.abs(F.col("anchor") + F.col("alpha") * (F.col("f") - F.col("anchor")) - F.col("actual")))
    sums = tried.groupBy(*keys, "half", "alpha").agg(F.round(err, 9).alias("mae"))
    plain = sums.where("alpha = 1.0").select(*keys, "half", F.col("mae").alias("plain"))
    best = sums.groupBy(*keys, "half").agg(F.min(F.struct("mae", F.abs(F.col("alpha") - 1).alias("off"), "alpha")).alias("x")).select(*keys, (1 - F.col("half")).alias("half"), F.col("x.alpha").alias("alpha"))
    crossed = best.join(sums, [*keys, "half", "alpha"]).join(plain, [*keys, "half"]).withColumn("ok", F.col("mae") <= gain * F.col("plain"))
    return crossed.groupBy(*keys).agg((F.bool_and("ok") & (F.count("*") == 2)).alias("ok"), F.min_by("alpha", F.struct(F.abs(F.col("alpha") - 1), "alpha")).alias("a")).select(*keys, F.when(F.col("ok"), F.col("a")).otherwise(1.0).alias("alpha"))


def baseline_blend(rows: DataFrame, a: str, b: str, group: list[str], gain: float = 0.995, penalty: float = 0.01) -> DataFrame:
    """CA13: per group the weight of ``b`` by penalised error, if it gains enough on weight 0."""
    tried = rows.where("actual IS NOT NULL").select(*group, "actual", F.col(a).alias("a"), F.col(b).alias("b"), F.explode(grid(0, 1, 0.05)).alias("w"))
    sums = tried.groupBy(*group, "w").agg(F.avg(F.abs((1 - F.col("w")) * F.col("a") + F.col("w") * F.col("b") - F.col("actual"))).alias("mae"))
    zero = sums.where("w = 0").select(*group, F.col("mae").alias("zero"))
    best = sums.join(zero, group).groupBy(*group).agg(F.min(F.struct(F.round(F.col("mae") + penalty * F.col("w") * F.col("zero"), 9).alias("s"), "w", "mae", "zero")).alias("x"))
    return best.select(*group, F.when(F.col("x.mae") <= gain * F.col("x.zero"), F.col("x.w")).otherwise(0.0).alias("weight"))
