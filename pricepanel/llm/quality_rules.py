"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Every text gives a few signals as whole numbers from 0 to 1000. Labelled documents are split by a
hash of their id. On one half, cutoffs of all signals are read off the good documents' histograms at
a ladder of strictness levels. On the other half each level is tested by the exact binomial tail: a
level is certified for a stratum if so few good documents fail it that a false rejection rate of
``ALPHA`` or more is refuted at confidence ``1 - DELTA``. Levels are tested from lenient to strict and
the first failure ends the ladder (fixed sequence), strata share ``DELTA`` evenly (Bonferroni); so
with probability ``1 - DELTA`` no stratum loses more than ``ALPHA`` of its good documents. Strata with
too few labels to refute ``ALPHA`` even without a failure are tested as one pool, for which the same
holds. Among the certified levels the one that separates the first half's labels best is taken.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

#: Share of a stratum's good documents that may be rejected, and the risk of exceeding it anywhere.
ALPHA, DELTA = 0.02, 0.05
#: Levels, lenient to strict: share of good documents, in thousandths, beyond a cutoff; below 0: so far above them all.
LEVELS = (-100, -50, -20, 0, 1, 2, 4, 8)
#: A false rejection weighs so much against a caught bad document.
COST = 5
SIGNALS = ("s_symbols", "s_repeat", "s_lines", "s_upper", "s_bang", "s_long", "s_short")
SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the array has twice or more; sorts the windows, so n log n."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))

    def covered(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, k: (F.get(ordered, k + 1)["w"] == x["w"]) | (F.get(ordered, k - 1)["w"] == x["w"]))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
        return F.aggregate(places, start, lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(p, acc["upto"])).alias("n"), (p + 3).alias("upto")), lambda acc: acc["n"])

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(F.sort_array(windows), covered))


def signals(docs: DataFrame, text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``docs`` with a struct ``q`` of stratum, counts, the base verdict and the signals."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def measured(t: Column) -> Column:
        def with_words(words: Column) -> Column:
            word_chars = F.length(F.translate(t, " \t\n\x0b\x0c\r", ""))
            lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(rf"[^{SPACE}]"))
            return F.struct(
                F.size(words).cast("long").alias("n_words"), word_chars.cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
                _repeat_words(words).cast("long").alias("n_repeat_words"),
                F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
                (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long").alias("n_bang"),
            )

        return _let(F.regexp_extract_all(t, F.lit(rf"([^{SPACE}]+)"), F.lit(1)), with_words)

    def share(part: str, whole: str) -> str:
        return f"least(1000, (1000 * {part}) DIV greatest({whole}, 1))"

    q = F.transform(F.array(text), measured)  # an array of one, so that the struct is computed once
    out = docs.withColumn("__q", F.explode(q))
    base = "__q.n_words < 50 OR 100 * __q.n_repeat_words > 50 * __q.n_words"
    return out.withColumn("q", F.struct(
        F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
        *[F.col(f"__q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols")],
        F.col("__q.lines.dup").alias("n_dup_lines"), F.col("__q.n_repeat_words").alias("n_repeat_words"), F.expr(base).alias("base_failed"),
        F.expr(share("__q.n_symbols", "__q.word_chars")).alias("s_symbols"), F.expr(share("__q.n_repeat_words", "__q.n_words")).alias("s_repeat"),
        F.expr(share("__q.lines.dup", "__q.lines.n")).alias("s_lines"), F.expr(share("__q.n_upper", "__q.word_chars")).alias("s_upper"),
        F.expr(share("__q.n_bang", "__q.word_chars")).alias("s_bang"),
        F.expr("least(1000, (10 * __q.word_chars) DIV greatest(__q.n_words, 1))").alias("s_long"),
        F.expr("1000 - least(1000, (10 * __q.word_chars) DIV greatest(__q.n_words, 1))").alias("s_short"),
    )).drop("__q")


def binomial_tail(n: Column, k: Column, alpha: float) -> Column:
    """P(Bin(n, alpha) <= k), exact, summed in logarithms; 1 where k is above the mean."""
    log_odds = math.log(alpha) - math.log1p(-alpha)
    start = F.struct((n * math.log1p(-alpha)).alias("term"), (n * math.log1p(-alpha)).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + log_odds
        top = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["sum"] - top) + F.exp(term - top))).alias("sum"))

    up = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.when(k > n * alpha, 1.0).otherwise(F.exp(F.aggregate(up, start, step, lambda acc: acc["sum"])))


def thresholds(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``stratum``, one cutoff per signal and ``certified``, for strata with a certified level.

    ``certified``: ``alone`` where the stratum's own labels prove the bound, ``pool`` where it was proved for
    the strata with too few labels together; the latter holds for the pool, not for each of its members.

    ``measured`` has ``id_col`` and ``q``; all labelled documents take part. A document fails if a
    signal is above its cutoff. Labels of one id that disagree count as bad; null labels are ignored.
    A stratum without labels has no cutoffs.
    """
    one = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("good"))
    q = measured.select(F.col(id_col).alias("__id"), "q.*").where("NOT base_failed")
    known = q.join(one, "__id").withColumn("fit", F.substring(F.md5(F.col("__id").cast("string")), 1, 1) < "8").withColumn("good", F.col("good") >= 1)
    known = materialize(known.select("stratum", "fit", "good", *SIGNALS), "rules-labelled")
    held = known.groupBy("stratum").agg(F.count_if(~F.col("fit") & F.col("good")).alias("n"))
    strata = max(1, held.count())
    enough = F.col("n") * math.log1p(-ALPHA) + math.log(strata) <= math.log(DELTA)
    groups = materialize(held.select(F.col("stratum").alias("s"), F.when(enough, F.concat(F.lit("="), "stratum")).otherwise("*").alias("grp")), "rules-groups")
    tested = max(1, groups.select("grp").distinct().count())
    known = known.join(groups, F.col("stratum") == F.col("s")).drop("s")
    good_fit = known.where("fit AND good")
    levels = F.explode(F.array(*map(F.lit, LEVELS))).alias("level")
    # the smallest cutoff beyond which at most level/1000 of the good documents lie
    long = good_fit.select("grp", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("value")) for s in SIGNALS])).alias("x")).select("grp", "x.*")
    histogram = long.groupBy("grp", "signal", "value").agg(F.count("*").alias("n"))
    by = Window.partitionBy("grp", "signal")
    histogram = histogram.withColumn("beyond", F.coalesce(F.sum("n").over(by.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(by))
    cutoffs = histogram.select("*", levels).where("1000 * beyond <= greatest(level, 0) * all").groupBy("grp", "level").pivot("signal", list(SIGNALS)).agg(F.min(F.expr("value - least(level, 0)")))
    cutoffs = materialize(cutoffs.select(F.col("grp").alias("at"), "level", *[F.col(s).alias(f"cut_{s}") for s in SIGNALS]), "rules-cutoffs")
    failed = known.join(cutoffs, F.col("grp") == F.col("at")).withColumn("failed", F.expr(" OR ".join(f"{s} > cut_{s}" for s in SIGNALS)))
    counts = failed.groupBy("grp", "level").agg(
        F.count_if(~F.col("fit") & F.col("good")).alias("n"), F.count_if(~F.col("fit") & F.col("good") & F.col("failed")).alias("k"),
        F.count_if(F.col("fit") & F.col("good")).alias("good"), F.count_if(F.col("fit") & F.col("good") & F.col("failed")).alias("good_failed"),
        F.count_if(F.col("fit") & ~F.col("good")).alias("bad"), F.count_if(F.col("fit") & ~F.col("good") & F.col("failed")).alias("bad_failed"),
    )
    passed = counts.withColumn("passes", binomial_tail(F.col("n"), F.col("k"), ALPHA) * tested <= DELTA)
    ladder = Window.partitionBy("grp").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    certified = passed.withColumn("certified", F.bool_and("passes").over(ladder)).where("certified")
    gain = (F.col("bad_failed") * F.col("good") - COST * F.col("good_failed") * F.col("bad")).alias("gain")
    best = certified.groupBy("grp").agg(F.max_by("level", F.struct(gain, -F.col("level"))).alias("best"))
    chosen = best.join(cutoffs, (F.col("grp") == F.col("at")) & (F.col("best") == F.col("level"))).drop("grp")
    return groups.join(chosen, F.col("grp") == F.col("at")).select(F.col("s").alias("stratum"), *[f"cut_{s}" for s in SIGNALS], F.when(F.col("grp") == "*", "pool").otherwise("alone").alias("certified"))


def judged(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``kept`` and ``certified`` (``none`` where there is no cutoff) to rows of ``q`` and columns without clashes; a stratum without a certified level has the base rule alone."""
    out = measured.join(cuts.withColumnRenamed("stratum", "at"), F.col("q.stratum") == F.col("at"), "left")
    fails = F.expr(" OR ".join(f"coalesce(q.{s} > cut_{s}, false)" for s in SIGNALS))
    out = out.withColumn("certified", F.coalesce("certified", F.lit("none")))
    return out.withColumn("kept", ~F.col("q.base_failed") & ~fails).drop("at", *[f"cut_{s}" for s in SIGNALS])


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, certified`` of every row.

    A null or empty text has no words and fails the base rule; a null stratum is that of the empty
    name; a signal that ties with its cutoff passes; repeated rows give repeated results; without labels
    the base rule alone decides; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(stratum_col).alias("lang"))
    measured = materialize(signals(rows).select("id", "q"), "rules-signals")
    cuts = materialize(thresholds(measured.withColumnRenamed("id", id_col), labels, id_col), "rules-cuts")
    done = judged(measured, cuts)
    return done.select(F.col("id").alias(id_col), *[F.col(f"q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], "kept", "certified")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with the columns of ``docs``, whatever their names.

    Rows stay as they are, repeated ones as often as they come; all else as for ``quality_rules``.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    measured = materialize(signals(rows, f"row.`{text_col}`", f"row.`{stratum_col}`"), "rules-measured")
    cuts = materialize(thresholds(measured.select(F.col(f"row.`{id_col}`").alias(id_col), "q"), labels, id_col), "rules-cuts")
    return judged(measured, cuts).where("kept").select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_FAILED = " OR ".join(f"{s} > cut_{s}" for s in SIGNALS)
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM t),
m AS (SELECT *, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
        len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, length(regexp_replace(text, '[^!]', '', 'g')) AS n_bang FROM w),
x AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM (SELECT row_number() OVER (ORDER BY doc_id, text) AS rid, words, unnest(range(1, len(words) - 1)) AS i FROM (SELECT * FROM w WHERE len(words) >= 3))),
r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS n FROM x) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + d) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS d) GROUP BY rid),
o AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS rid, doc_id, text FROM w WHERE len(words) >= 3),
q AS (SELECT m.*, CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN o USING (doc_id, text) LEFT JOIN c USING (rid)),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        least(1000, (1000 * n_symbols) // greatest(word_chars, 1)) AS s_symbols, least(1000, (1000 * n_repeat_words) // greatest(n_words, 1)) AS s_repeat,
        least(1000, (1000 * n_dup_lines) // greatest(n_lines, 1)) AS s_lines, least(1000, (1000 * n_upper) // greatest(word_chars, 1)) AS s_upper,
        least(1000, (1000 * n_bang) // greatest(word_chars, 1)) AS s_bang, least(1000, (10 * word_chars) // greatest(n_words, 1)) AS s_long,
        1000 - least(1000, (10 * word_chars) // greatest(n_words, 1)) AS s_short FROM q),
labelled AS (SELECT s.*, l.quality >= 1 AS good, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' AS fit
          FROM s JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) l USING (doc_id) WHERE NOT base_failed),
held AS (SELECT stratum, count(*) FILTER (NOT fit AND good) AS n FROM labelled GROUP BY stratum),
g AS (SELECT stratum, CASE WHEN n * ln(1 - {ALPHA}) + ln((SELECT count(*) FROM held)) <= ln({DELTA}) THEN '=' || stratum ELSE '*' END AS grp FROM held),
known AS (SELECT labelled.*, grp FROM labelled JOIN g USING (stratum)),
h AS (SELECT grp, signal, value, count(*) AS n FROM (UNPIVOT (SELECT grp, {', '.join(SIGNALS)} FROM known WHERE fit AND good) ON {', '.join(SIGNALS)} INTO NAME signal VALUE value) GROUP BY ALL),
b AS (SELECT *, sum(n) OVER (PARTITION BY grp, signal) AS n_all, coalesce(sum(n) OVER (PARTITION BY grp, signal ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beyond FROM h),
k AS (SELECT grp, level, {', '.join(f"min(value - least(level, 0)) FILTER (signal = '{s}') AS cut_{s}" for s in SIGNALS)} FROM b, (SELECT unnest([{', '.join(map(str, LEVELS))}]) AS level) WHERE 1000 * beyond <= greatest(level, 0) * n_all GROUP BY ALL),
f AS (SELECT grp, level, count(*) FILTER (NOT fit AND good) AS n, count(*) FILTER (NOT fit AND good AND failed) AS k,
        count(*) FILTER (fit AND good) AS good, count(*) FILTER (fit AND good AND failed) AS good_failed,
        count(*) FILTER (fit AND NOT good) AS bad, count(*) FILTER (fit AND NOT good AND failed) AS bad_failed
      FROM (SELECT known.*, k.level, ({_FAILED}) AS failed FROM known JOIN k USING (grp)) GROUP BY ALL),
p AS (SELECT *, CASE WHEN k > n * {ALPHA} THEN 1.0 ELSE list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})) for i in range(0, k + 1)]) END
        * (SELECT count(DISTINCT grp) FROM known) <= {DELTA} AS passes FROM f),
z AS (SELECT *, bool_and(passes) OVER (PARTITION BY grp ORDER BY level) AS certified FROM p),
best AS (SELECT grp, arg_max(level, (bad_failed * good - {COST} * good_failed * bad) * 100 - level) AS level FROM z WHERE certified GROUP BY grp),
cuts AS (SELECT k.* FROM k JOIN best USING (grp, level))
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce({_FAILED}, false) AS kept, CASE WHEN cuts.grp IS NULL THEN 'none' WHEN cuts.grp = '*' THEN 'pool' ELSE 'alone' END AS certified
FROM s LEFT JOIN g USING (stratum) LEFT JOIN cuts USING (grp)
"""
