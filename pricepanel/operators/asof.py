"""As-of lookups of released vintages, their validation and admission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(origins: DataFrame, releases: DataFrame, key: list[str], max_age: int, lag: int = 0) -> DataFrame:
    """AS1-AS3: per origin and key the release with the latest reference end (then availability) known ``lag`` days before.

    One sorted pass per key over the union of releases and origins instead of a range join: a running
    maximum of (reference end, available, value) up to the cutoff. The age is taken at the origin; an
    older reference gives null and the reason ``stale_reference``, none at all ``no_available_quote``.
    """
    r = releases.select(*key, F.to_date("available_at").alias("t"), F.lit(0).alias("o"), F.lit(None).cast("date").alias("origin"), F.struct("reference_end", F.to_date("available_at").alias("available"), "value").alias("x"))
    q = origins.select(*key, F.date_sub("origin", lag).alias("t"), F.lit(1).alias("o"), "origin", F.lit(None).cast(r.schema["x"].dataType).alias("x"))
    run = Window.partitionBy(*key).orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    out = r.unionByName(q).withColumn("best", F.max("x").over(run)).where("o = 1")
    age = F.datediff("origin", F.col("best.reference_end"))
    reason = F.when(F.col("best").isNull(), "no_available_quote").when((age > max_age) | (age < 0), "stale_reference").otherwise("available")
    return out.select(*key, "origin", reason.alias("reason"), F.when(reason == "available", F.col("best.value")).alias("value"), F.when(reason == "available", F.col("best.reference_end")).alias("reference_end"))


def monthly_as_of(origins: DataFrame, levels: DataFrame, key: list[str], max_age: int, lag: int = 0) -> DataFrame:
    """AS3: as-of lookup of monthly index levels: a release (``period`` any day of its month, ``available_at``, ``value``) refers to that month's last day.

    With sectors among ``key`` the same serves monthly changes by sector (``monthly_changes``).
    """
    return as_of(origins, levels.withColumn("reference_end", F.last_day("period")), key, max_age, lag)


def monthly_changes(levels: DataFrame, key: list[str]) -> DataFrame:
    """AS3: per key and month the relative change on the month before, known when both levels are; none without a level just before.

    Of several releases of a month the first to be available counts.
    """
    first = levels.groupBy(*key, F.last_day("period").alias("period")).agg(F.min(F.struct(F.to_date("available_at").alias("available_at"), "value")).alias("x"))
    before = Window.partitionBy(*key).orderBy("period")
    out = first.withColumns({"p": F.lag("period").over(before), "b": F.lag("x").over(before)}).where(F.col("p") == F.last_day(F.add_months("period", -1)))
    return out.select(*key, "period", F.greatest("x.available_at", "b.available_at").alias("available_at"), (F.try_divide(F.col("x.value"), F.col("b.value")) - 1).alias("value")).where("value IS NOT NULL")


def validate(releases: DataFrame, key: list[str]) -> DataFrame:
    """AS4: the broken rules of each release; empty if it may be used.

    A value is positive and finite. Where releases have a ``missing_reason``, a missing value needs one and a
    value that is there must have none; where they have ``availability_evidence``, it must not be blank.
    """
    n = F.count("*").over(Window.partitionBy(*key, "reference_end", "available_at"))
    usable = F.coalesce((F.col("value") > 0) & (F.col("value") < float("inf")), F.lit(False))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    if "missing_reason" in releases.columns:
        usable = F.when(F.col("value").isNull(), ~blank("missing_reason")).otherwise(usable & blank("missing_reason"))
    rules = {"duplicate": n > 1, "not_yet": F.col("reference_end") > F.to_date("available_at"), "value": ~usable, "hash": ~F.col("sha256").rlike("^[0-9a-f]{64}$"), "url": ~F.col("source_url").startswith("https://")}
    if "availability_evidence" in releases.columns:
        rules["evidence"] = blank("availability_evidence")
    return releases.withColumn("broken", F.concat_ws(",", F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()]))))


def admit(reviewed: DataFrame, available: DataFrame) -> DataFrame:
    """AS5: reviewed rows joined to availability by (hash, url); ``admitted`` or the reason against."""
    one = available.groupBy("sha256", "source_url").agg(F.count("*").alias("n"), F.min("available_at").alias("available_at"))
    out = reviewed.join(one, ["sha256", "source_url"], "left")
    return out.withColumn("state", F.when(F.col("n").isNull(), "no_availability").when(F.col("n") > 1, "ambiguous").otherwise("admitted")).drop("n")


def canonical_url(url):
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(url, "[?#].*$", "")), "^http://", "https://"), "^https://(www|m)\\.", "https://")


def first_availability(documents: DataFrame, captures: DataFrame) -> DataFrame:
    """AS6: the earliest capture of the same payload at the same canonical address."""
    d = documents.withColumn("u", canonical_url(F.col("url")))
    c = captures.withColumn("u", canonical_url(F.col("url"))).groupBy("sha256", "u").agg(F.min("captured_at").alias("first_seen"), F.count("*").alias("captures"))
    return d.join(c, ["sha256", "u"], "left").drop("u")


def coverage_grid(origins: DataFrame, releases: DataFrame, key: list[str], lags: list[int], ages: list[int]) -> DataFrame:
    """AS7: usable rows for every lag and greatest age."""
    out = None
    for lag in lags:
        for age in ages:
            part = as_of(origins, releases, key, age, lag).agg(F.count("*").alias("n"), F.count("value").alias("usable")).select(F.lit(lag).alias("lag"), F.lit(age).alias("max_age"), "n", "usable")
            out = part if out is None else out.unionByName(part)
    return out


def reviewed_price(text):
    """AS8: ``$d.ddd`` as decimal, ``NA`` as null."""
    return F.expr(f"try_cast(nullif(regexp_extract({text}, '^\\\\$([0-9]+\\\\.[0-9]{{3}})$', 1), '') AS DECIMAL(12,3))")


def range_check(rows: DataFrame) -> DataFrame:
    """AS11: stated low and high against the positive prices of ``prices``; 0-0 without any means missing."""
    p = F.filter("prices", lambda x: x > 0)
    state = F.when((F.size(p) == 0) & (F.col("low") == 0) & (F.col("high") == 0), "missing").when((F.array_min(p) == F.col("low")) & (F.array_max(p) == F.col("high")), "ok").otherwise("range")
    return rows.withColumn("state", state)


def text_metrics(documents: DataFrame, specs: list[tuple[str, str, str]]) -> DataFrame:
    """AS9: per document (id, text) and (metric, pattern, multiplier) the number in group 1 of the only match.

    ``accepted`` needs exactly one match and a number of at least zero; else ``no_match``, ``many_matches``
    or ``not_a_number``, without a value. ``start`` counts from 1. A null text has no match.
    """
    text, found = F.coalesce("text", F.lit("")), []
    for metric, pattern, multiplier in specs:
        p = F.lit(pattern)
        found.append(F.struct(
            F.lit(metric).alias("metric"), F.regexp_count(text, p).cast("long").alias("n"), F.regexp_extract(text, pattern, 1).alias("original"), F.regexp_extract(text, pattern, 0).alias("evidence"),
            F.regexp_instr(text, p).cast("long").alias("start"), F.lit(multiplier).cast("decimal(12,6)").alias("multiplier"),
        ))
    rows = documents.select("id", F.explode(F.array(*found)).alias("m")).select("id", "m.*")
    value = F.expr("try_multiply(try_cast(replace(original, ',', '') AS DECIMAL(20,6)), multiplier)").cast("double")
    state = F.when(F.col("n") == 0, "no_match").when(F.col("n") > 1, "many_matches").when(value >= 0, "accepted").otherwise("not_a_number")
    kept = lambda c: F.when(F.col("state") == "accepted", F.col(c))
    return rows.withColumn("value", value).withColumn("state", state).select("id", "metric", "n", "state", *[kept(c).alias(c) for c in ("original", "value", "evidence", "start")])


def listed(rows: DataFrame, hosts: list[str], cells: int = 3) -> DataFrame:
    """AS10: rows (n_cells, url, ...) with their canonical address and the reason they are set aside, null if none."""
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    own = F.exists(F.array(*map(F.lit, hosts)), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))
    reason = F.when(F.coalesce(F.col("n_cells") != cells, F.lit(True)), "cells").when(host.isNull(), "link").when(~own, "host")
    return rows.withColumns({"reason": reason, "document": canonical_url(F.col("url"))})


#: Occurrences in one array of the document index; a document listed more often has several rows.
OCCURRENCES = 10_000


def document_index(rows: DataFrame, commodity: str, place: str = "place") -> DataFrame:
    """AS10: per document of the rows that ``listed`` admits: its occurrences (place, year, subject), year labels, and whether all subjects name the commodity.

    Occurrences are an array in order of ``place`` (a unique column). So that no array grows without
    bound, a document of more than ``OCCURRENCES`` has a row per that many, numbered by ``part``; counts
    and the candidate flag are of the whole document on each. A null subject names nothing.
    """
    named = F.coalesce(F.col("subject").rlike("(?i)" + commodity), F.lit(False))
    good = rows.where("reason IS NULL").withColumn("named", named)
    whole = good.groupBy("document").agg(F.count("*").alias("occurrences"), F.count_distinct("year").alias("years"), F.bool_and("named").alias("candidate"))
    numbered = good.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("document").orderBy(place)) - 1) / OCCURRENCES).cast("int"))
    arrays = numbered.groupBy("document", "part").agg(F.array_sort(F.collect_list(F.struct(place, "year", "subject"))).alias("listed"))
    return arrays.join(whole, "document").select("document", "part", "occurrences", "years", "candidate", "listed")


def corroborate(releases: DataFrame, candidates: DataFrame) -> DataFrame:
    """AS12: releases (link, metric, value, month) against linked candidates (link, value, context).

    ``corroborated`` needs exactly one candidate of equal value whose context has the metric's name, and the
    month's name in it; else ``none``, ``ambiguous`` or ``other_month``. Null values match nothing.
    """
    hits = releases.select("link", "value", "metric").distinct().join(candidates, ["link", "value"]).where("contains(context, metric)").groupBy("link", "value", "metric").agg(F.count("*").alias("n"), F.max("context").alias("context"))
    out = releases.join(hits, ["link", "value", "metric"], "left")
    month = F.coalesce(F.expr(r"regexp_like(context, concat('(?<!\\w)', month, '(?!\\w)'))"), F.lit(False))
    return out.withColumn("state", F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "ambiguous").when(month, "corroborated").otherwise("other_month")).drop("n", "context")
