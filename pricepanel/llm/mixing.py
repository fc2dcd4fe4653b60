"""Mixing sources to target weights by entropy balancing.

Rates of words stay as near to one as the constraints allow (in relative entropy, every word weighing
the same). Constraints: the words taken of a source equal its target, exactly; the words taken of
each language keep the share that the language has in the corpus, and the words taken come from
documents as long (in the mean of the logarithm) as the corpus's words do, both as far as the targets
leave room (``RIDGE``, ``WALL``). Of the languages, the ``CLASSES - 1`` with most words have a constraint each,
all others share one. The dual of that problem is convex and smooth; its optimum gives exponentially
tilted document rates ``min(cap, exp(a[source] + b[language] + c * z))``, ``z`` being the document's
standardised log size. Damped Newton steps solve it from all duals zero (every rate one): counts by
(source, language, size) hold all that the dual needs, each step sums them by source and language,
every source eliminates its own dual, and what is left is one small system for ``b`` and ``c``.

Rates become whole copies by a hashed offset per document, and a threshold per source, found by
refining a histogram, moves as many copies as it takes to meet the target to within about one
document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_materialized, materialize, table

WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often.
MAX_COPIES = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: Duals for languages; the languages beyond the first CLASSES - 1 share one.
CLASSES = 16
#: Penalties of the duals of languages and log size, by square and fourth power: small ones are all but free and meet
#: their margin, and none goes far beyond 2 where the sources' targets leave a margin no room.
RIDGE, WALL = 1e-3, 0.05
#: Largest share that a constraint may be off at the end, and most evaluations of the dual.
TOLERANCE, MAX_STEPS = 1e-10, 80
#: Bits of each of the three steps that find a source's threshold.
BITS = 8
#: Passes that move copies; each later one moves documents no larger than what the last left open.
PASSES = 3


def _ordered(sources: DataFrame) -> DataFrame:
    """Add ``place`` (from 0) in code point order of ``source``, null last: ranges, then places inside each."""
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "mix-ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row per range
    starts = starts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("inside", inside).join(starts, F.col("part") == F.col("p")).withColumn("place", F.col("start") + F.col("inside")).drop("part", "p", "start", "inside")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """Add ``target`` to rows of ``source, source_size``: shares of all words by weight, at most ``cap`` sizes.

    Sources in code point order, null last, weigh as in ``weights``, repeating. What capped sources
    leave is shared again by weight until none is above its cap; each round is one sum over the sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = materialize(_ordered(sources).withColumn("weight", weight).withColumn("most", F.col("source_size") * cap), "mix-ranked")
    level, capped = 0.0, -1
    while True:
        over = F.col("most") < F.lit(level) * F.col("weight")
        sums = ranked.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("most"))).alias("held"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weight"), F.count_if(over).alias("capped"),
        ).first()
        if sums["capped"] == capped or not sums["weight"]:
            break
        capped = sums["capped"]
        level = ((sums["all"] or 0) - (sums["held"] or 0)) / sums["weight"]
    target = F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


@dataclass
class Tilt:
    """What all documents share of the dual: the classes, their duals, and the scale of the log sizes."""

    classes: list
    duals: np.ndarray  # of the classes, of the rest, of z
    mean: float
    spread: float

    def number(self, column: Column) -> Column:
        out = F.lit(len(self.classes))
        for i, value in enumerate(self.classes):
            out = F.when(column.eqNullSafe(F.lit(value)), i).otherwise(out)
        return out

    def z(self, size: Column) -> Column:
        return (F.log(size) - self.mean) / self.spread

    def of(self, number: Column, z: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.duals[:-1].tolist())), (number + 1).cast("int")) + F.lit(float(self.duals[-1])) * z


def _summed(cells: DataFrame, state: DataFrame, tilt: Tilt, step: float, cap: int) -> DataFrame:
    """By source, at duals moved by ``step``: words taken and the words that still move, by class, and the dual's value."""
    at = cells.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    at = at.withColumn("eta", tilt.of(F.col("cls"), F.col("z")) + F.col("a") + F.lit(step) * F.col("da"))
    free = F.exp(F.least("eta", F.lit(60.0)))
    inside = (free < cap) & ~F.col("fixed")
    taken = F.when(inside, free).otherwise(float(cap)) * F.col("words")
    moving = F.when(inside, free * F.col("words")).otherwise(0.0)
    value = F.when(inside, free).when(F.col("fixed"), F.col("eta") * cap).otherwise(F.col("eta") * cap - cap * math.log(cap) + cap) * F.col("words")
    by_class = at.groupBy("source", "cls").agg(
        F.first("a").alias("a"), F.first("da").alias("da"), F.first("target").alias("target"), F.first("fixed").alias("fixed"),
        F.sum(taken).alias("r"), F.sum(taken * F.col("z")).alias("rz"), F.sum(moving).alias("d"), F.sum(moving * F.col("z")).alias("dz"), F.sum(moving * F.col("z") * F.col("z")).alias("dzz"), F.sum(value).alias("value"),
    )
    # at most CLASSES rows a source
    return by_class.groupBy("source").agg(
        (F.first("a") + F.lit(step) * F.first("da")).alias("a"), F.first("target").alias("target"), F.first("fixed").alias("fixed"), F.sum("value").alias("value"),
        F.sort_array(F.collect_list(F.struct("cls", "r", "rz", "d", "dz", "dzz"))).alias("parts"),
    )


def _system(k: int):
    """Sums of a partition's sources: value, gradient and matrix of the shared duals, sources eliminated, and what is off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, off, gradient, reduced, matrix = 0.0, 0.0, np.zeros(k), np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for a, target, fixed, worth, parts in zip(*(batch.column(c).to_pylist() for c in ("a", "target", "fixed", "value", "parts")), strict=True):
                c = np.zeros(k)
                taken = own = 0.0
                for p in parts:
                    i = p["cls"]
                    gradient[i] += p["r"]
                    gradient[-1] += p["rz"]
                    c[i], c[-1] = p["d"], c[-1] + p["dz"]
                    matrix[i, i] += p["d"]
                    matrix[i, -1] += p["dz"]
                    matrix[-1, i] += p["dz"]
                    matrix[-1, -1] += p["dzz"]
                    taken, own = taken + p["r"], own + p["d"]
                value += worth
                if not fixed:
                    value -= a * target
                    off = max(off, abs(taken - target) / target)
                    if own > 0:
                        matrix -= np.outer(c, c) / own
                        reduced -= c * (taken - target) / own
        yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([off]), *(pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in (gradient, reduced, matrix))], names=["value", "off", "gradient", "reduced", "matrix"])

    return run


def balance(counts: DataFrame, targets: DataFrame, cap: int = MAX_COPIES, ridge: float = RIDGE, wall: float = WALL) -> tuple[DataFrame, Tilt]:
    """Duals of the sources (``source, a``; none for one that is taken ``cap`` times) and of all else.

    ``counts``: ``source, class, size, n``. To the driver go one row per language that has a dual,
    and per task the sums of one small system.
    """
    counts = counts.where("size > 0").withColumn("words", (F.col("size") * F.col("n")).cast("double"))
    sizes = counts.agg(F.sum("words").alias("words"), F.sum(F.col("words") * F.log("size")).alias("m"), F.sum(F.col("words") * F.log("size") * F.log("size")).alias("v")).first()
    total = sizes["words"] or 1.0
    mean = round((sizes["m"] or 0.0) / total, 9)
    spread = round(math.sqrt(max(0.0, (sizes["v"] or 0.0) / total - mean * mean)), 9) or 1.0
    shares = counts.groupBy("class").agg(F.sum("words").alias("words")).orderBy(F.desc("words"), F.col("class").asc_nulls_last()).limit(CLASSES - 1).collect()
    k = len(shares) + 2
    tilt = Tilt([r["class"] for r in shares], np.zeros(k), mean, spread)
    known = targets.select(F.col("source").alias("s"), "target", (F.col("target") >= cap * F.col("source_size")).alias("fixed")).where("target > 0")
    cells = counts.join(known.select("s"), F.col("source").eqNullSafe(F.col("s"))).select("source", tilt.number(F.col("class")).alias("cls"), tilt.z(F.col("size")).alias("z"), "words")
    cells = materialize(cells, "mix-cells")
    wanted = known.agg(F.sum("target")).first()[0] or 0.0
    margin = np.array([r["words"] for r in shares] + [total - sum(r["words"] for r in shares), 0.0]) / total * wanted
    state = materialize(known.select(F.col("s").alias("source"), "target", "fixed", F.lit(0.0).alias("a"), F.lit(0.0).alias("da")), "mix-dual")
    value, at, move, step, slope = math.inf, tilt.duals, np.zeros(k), 1.0, 0.0
    for _ in range(MAX_STEPS):
        tilt.duals = at + step * move
        sums = materialize(_summed(cells, state, tilt, step, cap), "mix-sums")
        rows = sums.mapInArrow(_system(k), "value double, off double, gradient array<double>, reduced array<double>, matrix array<double>").collect()  # a row per task
        found = sum(r["value"] for r in rows) / total - tilt.duals @ margin / total + (ridge / 2 * tilt.duals**2 + wall / 4 * tilt.duals**4).sum()
        if found > value + 1e-4 * step * slope + 1e-13 * abs(found) and step > 1e-6:
            step /= 2
            drop_materialized(sums)
            continue
        gradient = (sum((np.array(r["gradient"]) for r in rows), np.zeros(k)) - margin) / total + ridge * tilt.duals + wall * tilt.duals**3
        reduced = gradient + sum((np.array(r["reduced"]) for r in rows), np.zeros(k)) / total
        matrix = sum((np.array(r["matrix"]).reshape(k, k) for r in rows), np.zeros((k, k))) / total + np.diag(ridge + 3 * wall * tilt.duals**2)
        value, at = found, tilt.duals
        move = -np.linalg.solve(matrix, reduced)
        # the sources' own steps follow from that of the shared duals
        moved = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["r"]) - F.col("target")
        coupled = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["d"] * F.element_at(F.array(*map(F.lit, move[:-1].tolist())), (p["cls"] + 1).cast("int")) + p["dz"] * F.lit(float(move[-1])))
        own = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["d"])
        da = F.when(F.col("fixed") | (own <= 0), 0.0).otherwise(-(moved + coupled) / own)
        after = materialize(sums.select("source", "target", "fixed", "a", da.alias("da"), F.when(F.col("fixed"), 0.0).otherwise(moved * da).alias("down")), "mix-dual")
        downs = after.agg(F.sum("down"), F.max(F.abs("da"))).first()
        slope = float(gradient @ move + (downs[0] or 0.0) / total)
        drop_materialized(sums)
        drop_materialized(state)
        state = after
        if max(r["off"] for r in rows) < TOLERANCE and np.abs(gradient).max() < TOLERANCE:
            break
        step = min(1.0, 3.0 / max(downs[1] or 0.0, np.abs(move).max(), 1e-300))
    tilt.duals = np.round(at, 10)
    return state.where("NOT fixed").select("source", F.round("a", 10).alias("a")), tilt


def _crossing(binned: DataFrame) -> DataFrame:
    """Per source the first bin at which the words of its bins reach ``need``; at most ``2 ** BITS`` bins a source."""
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = binned.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") >= F.col("need"))
    first = run.groupBy("source").agg(F.min(F.struct("bin", (F.col("need") - F.col("upto") + F.col("words")).alias("need"), "words")).alias("c"))
    return first.select(F.col("source").alias("f"), F.col("c.bin").alias("prefix"), F.col("c.need").alias("need"), F.col("c.words").alias("words"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", class_col: str | None = "lang",
    weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES, ridge: float = RIDGE, wall: float = WALL,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, rate, source_dual, tilt`` (source, class) of every row.

    ``copies`` (0 to ``cap``) says how often the mix takes the document, ``taken`` its words then;
    ``rate`` is ``min(cap, exp(source_dual + tilt))``, ``source_dual`` null where the source is taken
    ``cap`` times. A null or empty text has size 0 and is not taken; a null source is a source, last
    in order; a null language is a language; without ``class_col`` all rows are of one. Rows of one id
    get the same offset and so the same copies within a source, language and size; an empty table gives
    no rows. The offset is a hash of the id, so reruns agree. Other columns are ignored.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    kind = F.col(class_col) if class_col else F.lit("")
    sized = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), kind.alias("class"), size.alias("size")), "mix-sizes")
    counts = materialize(sized.groupBy("source", "class", "size").agg(F.count("*").alias("n")), "mix-counts")
    targets = source_targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap)
    targets = materialize(targets, "mix-targets")
    dual, tilt = balance(counts, targets, cap, ridge, wall)
    plan = materialize(targets.withColumnRenamed("source", "s").join(dual, F.col("s").eqNullSafe(F.col("source")), "left").drop("source"), "mix-plan")

    leaning = F.when(F.col("size") > 0, tilt.of(tilt.number(F.col("class")), tilt.z(F.col("size")))).otherwise(0.0)
    tilted = F.least(F.lit(float(cap)), F.exp(F.least(F.col("a") + F.col("tilt"), F.lit(60.0))))
    rate = F.when((F.col("size") == 0) | (F.col("target") <= 0), 0.0).when(F.col("target") >= cap * F.col("source_size"), float(cap)).otherwise(tilted)
    state = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("tilt", F.round(leaning, 9))
    state = state.select("id", "source", "class", "size", "source_size", "target", F.col("a").alias("source_dual"), "tilt", F.round(rate, 9).alias("rate"))
    offset = F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(1 << 40)) / float(1 << 40)
    fixed = (F.col("rate") <= 0) | (F.col("rate") >= cap)
    state = state.withColumns({"x": F.when(fixed, F.col("rate")).otherwise(F.col("rate") + offset), "moved": F.lit(False)})
    state = state.withColumns({"copies": F.least(F.lit(cap), F.floor("x")).cast("long"), "over": F.col("x") - F.floor("x")}).drop("x")
    state = materialize(state, "mix-state")
    for k in range(PASSES):
        moved = materialize(_move(state, cap, any_size=k == 0), "mix-state")
        drop_materialized(state)
        state = moved
    return state.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("class").alias(class_col or "class"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate", "source_dual", "tilt",
    )


def _move(state: DataFrame, cap: int, any_size: bool) -> DataFrame:
    """Give or take one copy of as many documents as bring every source nearest to its target.

    Documents move in the order of how near their rate and offset are to the next copy, those that
    moved before after all others. Unless ``any_size``, only those no larger than what is open move.
    """
    gap = state.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap"))
    gap = materialize(gap.withColumnRenamed("source", "g"), "mix-gap")
    free = (F.col("rate") > 0) & (F.col("rate") < cap) & (F.lit(any_size) | (F.col("size") <= F.abs("gap")))
    near = F.when(free & (F.col("gap") > 0) & (F.col("copies") < cap), 1 - F.col("over")).when(free & (F.col("gap") < 0) & (F.col("copies") > 0), F.col("over"))
    place = (near + F.col("moved").cast("int")) / 2
    whole = 1 << 3 * BITS
    keyed = state.join(gap, F.col("source").eqNullSafe(F.col("g"))).withColumn("key", F.floor(F.least(F.lit(whole - 1.0), place * whole)).cast("long"))
    movable = keyed.where("key IS NOT NULL").select("source", "key", "size")
    front = gap.select(F.col("g").alias("f"), F.lit(0).cast("long").alias("prefix"), F.abs("gap").alias("need"))
    for shift in (2 * BITS, BITS, 0):
        inside = movable.join(front, F.col("source").eqNullSafe(F.col("f")) & (F.expr(f"shiftright(key, {shift + BITS})") == F.col("prefix")))
        binned = inside.groupBy("source", F.expr(f"shiftright(key, {shift})").alias("bin")).agg(F.sum("size").alias("words"), F.first("need").alias("need"))
        front = materialize(_crossing(binned), "mix-front")
    # the documents of the last key move too if that comes nearer to the target
    cut = front.select("f", F.when(F.col("need") >= F.col("words") / 2, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("cut"))
    # where all that may move is too little, all of it moves
    moves = F.col("key").isNotNull() & (F.col("key") < F.coalesce("cut", F.lit(whole)))
    done = keyed.join(cut, F.col("source").eqNullSafe(F.col("f")), "left")
    return done.select(
        "id", "source", "class", "size", "source_size", "target", "source_dual", "tilt", "rate", (F.col("moved") | moves).alias("moved"),
        (F.col("copies") + F.when(moves, F.signum("gap").cast("long")).otherwise(0)).alias("copies"), "over",
    )


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", class_col: str | None = "lang", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``, whatever their names.

    Copies depend on id, source, language and size alone, so these bring them back to the rows. A null
    or empty text is not taken; rows that are equal in these four are taken alike; an empty table gives
    no rows.
    """
    mixed = mix(docs, id_col, text_col, source_col, class_col, **options).where("copies > 0")
    kind = lambda: F.col(class_col) if class_col else F.lit("")
    taken = mixed.select(F.struct(F.col(id_col).alias("a"), F.col(source_col).alias("b"), F.col(class_col or "class").alias("c"), F.col("size").alias("d")).alias("__row"), F.col("copies").alias("__copies")).dropDuplicates(["__row"])
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    own = F.struct(F.col(id_col).alias("a"), F.col(source_col).alias("b"), kind().alias("c"), size.alias("d"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), own.alias("__own"))
    rows = rows.join(taken, F.col("__own").eqNullSafe(F.col("__row")))
    return rows.select("__doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__copy")).select("__doc.*")


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source", "lang")
