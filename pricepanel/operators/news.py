"""News articles: matching, events, windowed features, filters, deduplication."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from .store import shared_folder


def products_of(value: Column) -> Column:
    """NW1: an array from a JSON string or a comma list, lower-cased and distinct."""
    return F.array_distinct(F.transform(F.coalesce(F.from_json(value, "array<string>"), F.split(value, ",")), lambda x: F.lower(F.trim(x))))


def match(articles: DataFrame, product: str, since: str | None = None) -> DataFrame:
    """NW1"""
    rows = articles.where(F.array_contains("products", product.lower()))
    return rows if since is None else rows.where(F.col("published_date") >= F.lit(since).cast("date"))


def impact(sentiment: Column) -> Column:
    """NW2"""
    return F.when(sentiment < -0.2, "increase").when(sentiment > 0.2, "decrease").otherwise("neutral")


def windows(articles: DataFrame, days: DataFrame, sizes: tuple[int, ...] = (3, 7, 14)) -> DataFrame:
    """NW3: per product and day of ``days`` (product, day): news of the last 3, 7 and 14 days, zero where there is none.

    Counts, rising and falling news, shocks, mentions of inflation, mean sentiment, mean confidence (its
    size) and the mean signed score (the sign of the impact times the confidence). Articles are summed by
    product and day first, each such row is spread over the days it counts for, and the rest is an
    equality join; a hot product costs its days, not its articles.
    """
    word = F.coalesce(F.col("text").rlike(whole_word(["inflation", "cpi"])), F.lit(False)) if "text" in articles.columns else F.lit(False)
    kind = impact(F.col("sentiment"))
    signed = F.when(kind == "increase", F.abs("sentiment")).when(kind == "decrease", -F.abs("sentiment")).otherwise(0.0)
    rows = articles.select(F.explode("products").alias("product"), "published_date", "sentiment", "is_shock", word.alias("inflation"), signed.alias("signed"), kind.alias("kind"))
    daily = rows.groupBy("product", "published_date").agg(
        F.count("*").alias("n"), F.sum("sentiment").alias("s"), F.sum(F.abs("sentiment")).alias("c"), F.sum("signed").alias("d"),
        F.count_if(F.col("kind") == "increase").alias("rising"), F.count_if(F.col("kind") == "decrease").alias("falling"), F.count_if("is_shock").alias("shocks"), F.count_if("inflation").alias("inflation"),
    )
    parts = ["n", "s", "c", "d", "rising", "falling", "shocks", "inflation"]
    spread = daily.select("product", F.explode(F.sequence(F.lit(0), F.lit(max(sizes)))).alias("age"), "published_date", *parts).withColumn("day", F.date_add("published_date", F.col("age")))
    sums = [F.sum(F.when(F.col("age") <= w, F.col(c))).alias(f"{c}_{w}") for w in sizes for c in parts]
    out = days.join(spread.groupBy("product", "day").agg(*sums), ["product", "day"], "left").fillna(0)
    mean = lambda c, w: F.coalesce(F.try_divide(F.col(f"{c}_{w}"), F.col(f"n_{w}")), F.lit(0.0))
    means = {f"{name}_{w}": mean(c, w) for w in sizes for c, name in (("s", "mean_sentiment"), ("c", "mean_confidence"), ("d", "signed_score"))}
    return out.withColumns(means).drop(*[f"{c}_{w}" for w in sizes for c in ("s", "c", "d")])


def whole_word(terms: list[str]) -> str:
    return r"(?i)(?<!\w)(" + "|".join(terms) + r")(?!\w)"


def topical(text: Column, topics: list[str], effects: list[str]) -> Column:
    """NW4: a whole word of both lists."""
    return text.rlike(whole_word(topics)) & text.rlike(whole_word(effects))


#: The line before an article's body, and how the lines after it begin (fixed values).
PUBLISHED_LINE = r"Published\s+\w+\s+\d{1,2},?\s+\d{4}"
BODY_ENDS = ("Read More", "Copyright ©", "Privacy Preference Center")


def clean_body(text: Column) -> Column:
    """NW5: the lines after the publication line up to ``Read More`` or the footer, without markdown; null below 200 characters.

    Without a publication line the whole text counts.
    """
    body = F.regexp_replace(text, rf"(?s)\A.*?(?m:^)[ \t]*{PUBLISHED_LINE}[^\n]*(\n|\z)", "")
    body = F.regexp_replace(body, rf"(?ms)^[ \t]*({'|'.join(BODY_ENDS)}).*\z", "")
    plain = F.regexp_replace(body, r"!\[[^\]]*\]\([^)]*\)", "")
    plain = F.regexp_replace(plain, r"\[([^\]]*)\]\([^)]*\)", "$1")
    plain = F.regexp_replace(F.regexp_replace(plain, r"#{1,6}\s*|[*_~`]{1,3}", ""), r"\n{3,}", "\n\n")
    plain = F.regexp_replace(plain, r"\A\s+|\s+\z", "")
    return F.when(F.length(plain) >= 200, plain)


def allowed_url(url: Column, hosts: list[str], skipped: list[str]) -> Column:
    """NW7: a host of the list or below one, and no skipped section."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    own = F.exists(F.array(*map(F.lit, hosts)), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))
    return F.coalesce(own & ~url.rlike("/(" + "|".join(skipped) + ")(/|$|\\?)"), F.lit(False))


def new_articles(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """NW8: first of each content hash that is not stored, by url or by content."""
    hashed = batch.withColumn("content_hash", F.sha2("content", 256))
    one = hashed.groupBy("content_hash").agg(F.min_by(F.struct(*batch.columns), F.col("id")).alias("r")).select("content_hash", "r.*")
    return one.join(stored.select("content_hash"), "content_hash", "left_anti").join(stored.select("url"), "url", "left_anti")


#: Where a page states its publication, in order, and the name of that source (fixed values).
PUBLISHED_IN_PAGE = (
    (r"(?i)<meta[^>]+property=[\"']article:published_time[\"'][^>]+content=[\"']([^\"']+)", "article_published_meta"),
    (r"(?i)<meta[^>]+content=[\"']([^\"']+)[\"'][^>]+property=[\"']article:published_time", "article_published_meta"),
    (r'(?i)\"datePublished\"\s*:\s*\"([^\"]+)\"', "json_ld_date_published"),
)


def publication(meta: Column, html: Column, url: Column) -> tuple[Column, Column, Column]:
    """NW10: (timestamp, date, source) by the first that can be read: crawler metadata, the page's meta tag, its JSON-LD, the address.

    A timestamp needs a time and a zone; a date alone, or a time without zone, stays a date (of the text's own zone).
    """
    y, m, d = (F.regexp_extract(url, r"/(\d{4})/(\d{1,2})/(\d{1,2})/", k) for k in (1, 2, 3))
    found = [
        (meta, "crawler_metadata"), *[(F.regexp_extract(html, pattern, 1), source) for pattern, source in PUBLISHED_IN_PAGE], (F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))), "url_date"),
    ]
    read = lambda v: F.try_to_date(F.regexp_extract(F.trim(v), r"^(\d{4}-\d{2}-\d{2})([T ].*)?$", 1), "yyyy-MM-dd")
    good = F.filter(F.array(*[F.struct(F.trim(v).alias("v"), read(v).alias("day"), F.lit(s).alias("source")) for v, s in found]), lambda x: x["day"].isNotNull())
    first = F.get(good, 0)
    zoned = first["v"].rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.try_to_timestamp(first["v"])), first["day"], F.coalesce(first["source"], F.lit("unknown"))


def listing(articles: DataFrame, text: str | None, since: str, page: int, size: int) -> DataFrame:
    """NW11"""
    rows = articles.where((F.size("products") > 0) & (F.col("published_date") >= F.lit(since).cast("date")))
    if text:
        rows = rows.where(F.lower("title").contains(text.lower()))
    return rows.orderBy(F.desc("published_date"), "id").offset(page * size).limit(size)


def factors(articles: DataFrame, day: str, k: int = 5) -> DataFrame:
    """NW13: the newest ``k`` articles of 14 days per product, with a sentiment label."""
    end = F.lit(day).cast("date")
    rows = articles.where(F.col("published_date").between(F.date_sub(end, 14), end)).select(F.explode("products").alias("product"), "id", "published_date", "sentiment")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("product").orderBy(F.desc("published_date"), "id"))).where(F.col("rank") <= k)
    return rows.withColumn("label", F.when(F.col("sentiment") > 0.3, "positive").when(F.col("sentiment") < -0.3, "negative").otherwise("neutral"))


LPG = r"(?<!\w)(lpg|liquefied petroleum gas)(?!\w)"


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def any_word(text: Column, terms: list[str]) -> Column:
    return text.rlike(r"(?<!\w)(" + "|".join(rf"\Q{t}\E" for t in terms) + r")(?!\w)")


def first_keywords(keywords: Column, banned: str, k: int = 3) -> Column:
    """The first ``k`` keywords, spaces squeezed, upper-cased, distinct, without those that match ``banned``."""
    clean = F.transform(keywords, lambda x: F.upper(spaced(x)))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: (x != "") & ~x.rlike("(?i)" + banned))), 1, k)


def evidenced(articles: DataFrame, impact_terms: list[str], product_terms: dict[str, list[str]], event_terms: dict[str, list[str]]) -> DataFrame:
    """NW6: articles (title, content, evidence, event_type, products, keywords) whose quote proves a supported product's case.

    The quote has 12 characters or more, occurs in the article (spaces and case apart), has an impact term and a term
    of a named product; an event type outside ``event_terms`` fails, and one with terms there must show one. Products
    that the quote names replace ``products``, in the article's order. Nulls fail.
    """
    quote = F.regexp_replace(spaced(F.col("evidence")), "^[\"']+|[\"']+$", "")
    q = F.lower(spaced(quote))
    whole = F.lower(spaced(F.concat_ws(" ", "title", "content")))
    kind = F.lower(F.trim("event_type"))
    fits = F.lit(False)
    for name, terms in event_terms.items():
        fits = fits | ((kind == name) & (any_word(F.col("q"), terms) if terms else F.lit(True)))

    def proven(p: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, terms in product_terms.items():
            out = F.when((F.lower(F.trim(p)) == name.lower()) & any_word(F.col("q"), terms), F.lit(name)).otherwise(out)
        return out

    rows = articles.withColumns({"q": q, "quote": quote}).where((F.length("quote") >= 12) & F.contains(whole, F.col("q")) & any_word(F.col("q"), impact_terms) & fits)
    rows = rows.withColumns({"products": F.array_distinct(F.array_compact(F.transform("products", proven))), "keywords": first_keywords(F.col("keywords"), LPG), "event_type": kind, "evidence": F.col("quote")})
    return rows.where(F.size("products") > 0).drop("q", "quote")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def identity(articles: DataFrame) -> DataFrame:
    """NW9: the address key and the story key of articles (id, url, title, source, date); null where the address or title is empty."""
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim("url")), r"^https?://(www\.)?", ""), "[?#].*$", ""), "/+$", "")
    norm = lambda c: F.lower(spaced(nfkc(F.coalesce(F.col(c), F.lit("")))))
    title = norm("title")
    return articles.withColumns({"url_key": F.when(url != "", url), "story_key": F.when(title != "", F.concat_ws("|", title, norm("source"), norm("date")))})


def unique_stories(articles: DataFrame) -> DataFrame:
    """NW9: in order of id, articles that share neither key with an earlier kept one; ids are unique.

    Greedy by rounds: of the undecided, those that come first under both keys are kept and all others under
    these keys go, until none is undecided. Rows equal in both keys are reduced to the first before; each round is
    two minimum aggregates and joins, written to the checkpoint folder. Rows without either key are all kept.
    """
    spark = articles.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "stories"))
    keyed = identity(articles).select("id", "url_key", "story_key")
    kept = keyed.where("url_key IS NULL AND story_key IS NULL").select("id")
    left = keyed.where("url_key IS NOT NULL OR story_key IS NOT NULL").groupBy("url_key", "story_key").agg(F.min("id").alias("id")).checkpoint()
    while not left.isEmpty():
        tagged = left
        for key in ("url_key", "story_key"):
            tagged = tagged.join(left.where(f"{key} IS NOT NULL").groupBy(key).agg(F.min("id").alias(f"first_{key}")), key, "left")
        wins = (F.coalesce("first_url_key", "id") == F.col("id")) & (F.coalesce("first_story_key", "id") == F.col("id"))
        tagged = tagged.withColumn("wins", wins).checkpoint()
        won = tagged.where("wins")
        kept = kept.unionByName(won.select("id"))
        left = tagged.where("NOT wins").select("id", "url_key", "story_key")
        for key in ("url_key", "story_key"):
            left = left.join(won.select(key).where(f"{key} IS NOT NULL").distinct(), key, "left_anti")
        left = left.checkpoint()
    return articles.join(kept, "id", "left_semi")


def tags(articles: DataFrame, today: str, k: int = 3, least: float = 0.6) -> DataFrame:
    """NW12: up to ``k`` tags per product from articles (id, products, published_date, validity_days, probability, keywords), newest first.

    An article counts with probability of at least ``least`` (null: sure) until its validity ends (null: never) and gives
    its first 3 keywords; ``YELLOW ALERT`` goes where a product also has ``RED ALERT``.
    """
    valid = (F.coalesce("probability", F.lit(1.0)) >= least) & F.coalesce(F.date_add("published_date", F.col("validity_days")) >= F.lit(today).cast("date"), F.lit(True))
    decoded = F.transform("keywords", lambda x: F.coalesce(F.try_url_decode(x), x))
    rows = articles.where(valid).select(F.explode(F.array_distinct("products")).alias("product"), "id", "published_date", F.posexplode(first_keywords(decoded, LPG)).alias("pos", "tag"))
    first = rows.groupBy("product", "tag").agg(F.min(F.struct(F.datediff(F.lit(today).cast("date"), "published_date").alias("age"), "id", "pos")).alias("at"))
    red = first.where("tag = 'RED ALERT'").select("product", F.lit("YELLOW ALERT").alias("tag"))
    return first.join(red, ["product", "tag"], "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("product").orderBy("at"))).where(F.col("rank") <= k).select("product", "tag", "rank")
