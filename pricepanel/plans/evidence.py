"""Queries of extraction, corroboration, evidence and story identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricepanel.operators import asof, news

from .base import query, table
from .signals import ART, articles

METRICS = [("number", "([0-9]{3,9})", "1"), ("share", "([0-9][0-9,]*)%", "0.01"), ("version", "[Vv]ersion ([0-9]+)", "10")]
FOUND = " UNION ALL ".join(
    f"""SELECT doc_id AS id, '{m}' AS metric, len(regexp_extract_all(coalesce(text, ''), '{p}')) AS n, regexp_extract(coalesce(text, ''), '{p}', 1) AS o,
  regexp_extract(coalesce(text, ''), '{p}', 0) AS e, {k} AS k, coalesce(text, '') AS t FROM documents""" for m, p, k in METRICS
)


@query("as9_text_metrics", f"""WITH f AS ({FOUND}) SELECT id, metric, CAST(n AS BIGINT) AS n, CASE n WHEN 0 THEN 'no_match' WHEN 1 THEN 'accepted'
  ELSE 'many_matches' END AS state, CASE WHEN n = 1 THEN o END AS original, CASE
  WHEN n = 1 THEN round(CAST(replace(o, ',', '') AS DOUBLE) * k, 6) END AS value, CASE WHEN n = 1 THEN e END AS evidence, CASE
  WHEN n = 1 THEN CAST(strpos(t, e) AS BIGINT) ELSE 0 END AS start FROM f""")
def as9(spark, sf):
    return asof.text_metrics(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), METRICS).withColumns({"value": F.round("value", 6), "start": F.coalesce("start", F.lit(0).cast("long"))})


CANON = r"regexp_replace(regexp_replace(lower(regexp_replace(url, '[?#].*$', '')), '^http://', 'https://'), '^https://(www|m)\.', 'https://')"


@query("as10_index", rf"""WITH r AS (SELECT {CANON} AS u, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, page_id
  FROM pages), d AS (SELECT regexp_replace(u, '/[0-9]+$', '') AS document, page_id, page_id % 5 AS year, u LIKE '%com/%' AS named FROM r
  WHERE page_id % 17 <> 0 AND (host = 'example.com' OR host LIKE '%.example.com' OR host = 'example.org' OR host LIKE '%.example.org'))
  SELECT document, 0 AS part, count(*) AS occurrences, count(DISTINCT year) AS years, bool_and(named) AS candidate,
  string_agg(page_id || ':' || year, ',' ORDER BY page_id) AS listed FROM d GROUP BY 1""")
def as10(spark, sf):
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("place"), F.when(F.col("page_id") % 17 == 0, 2).otherwise(3).alias("n_cells"), F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/[0-9]+$", "").alias("url"), (F.col("page_id") % 5).alias("year"), F.lower("url").alias("subject"))
    index = asof.document_index(asof.listed(rows, ["example.com", "example.org"]), "com/")
    return index.withColumn("listed", F.array_join(F.transform("listed", lambda x: F.concat_ws(":", x["place"], x["year"])), ","))


@query("as12_corroborate", """WITH h AS (SELECT l_orderkey, count(*) AS n, max(strftime(CAST(l_shipdate AS DATE), '%B')) AS month FROM lineitem
  WHERE l_linestatus = 'O' AND l_linenumber % 3 = l_orderkey % 3 GROUP BY 1)
  SELECT o_orderkey AS link, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'ambiguous'
  WHEN month = strftime(CAST(o_orderdate AS DATE), '%B') THEN 'corroborated' ELSE 'other_month' END AS state FROM orders LEFT
  JOIN h ON l_orderkey = o_orderkey""")
def as12(spark, sf):
    releases = table(spark, sf, "orders").select(F.col("o_orderkey").alias("link"), (F.col("o_orderkey") % 3).cast("long").alias("value"), F.lit("price index").alias("metric"), F.date_format("o_orderdate", "MMMM").alias("month"))
    context = F.concat(F.when(F.col("l_linestatus") == "O", "price index, ").otherwise("volume, "), F.date_format("l_shipdate", "MMMM"), F.lit("."))
    candidates = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("link"), (F.col("l_linenumber") % 3).cast("long").alias("value"), context.alias("context"))
    return asof.corroborate(releases, candidates).select("link", "state")


@query("as6_first_availability", f"""WITH d AS (SELECT doc_id, sha256(text) AS h, doc_id % 3 AS u, coalesce(lang, '') <> 'fr' AS captured
  FROM documents), c AS (SELECT h, u, CAST(min(DATE '2020-01-01' + CAST(doc_id % 700 AS INT)) AS DATE) AS first_seen, count(*) AS captures FROM d
  WHERE captured GROUP BY 1, 2) SELECT doc_id, first_seen, coalesce(captures, 0) AS captures FROM d LEFT JOIN c USING (h, u)""")
def as6(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 3).cast("string").alias("u"), (F.coalesce("lang", F.lit("")) != "fr").alias("captured"))
    documents = rows.select("doc_id", "sha256", F.concat(F.lit("http://www.Example.org/"), "u", F.lit("?v=1")).alias("url"))
    captures = rows.where("captured").select("sha256", F.concat(F.lit("https://example.org/"), "u").alias("url"), F.expr("date_add(DATE '2020-01-01', CAST(doc_id % 700 AS INT))").alias("captured_at"))
    return asof.first_availability(documents, captures).select("doc_id", "first_seen", F.coalesce("captures", F.lit(0).cast("long")).alias("captures"))


@query("as8_reviewed_price", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN NULL ELSE CAST(CAST(p_retailprice AS DECIMAL(12,3)) AS DOUBLE) END AS price
  FROM part""")
def as8(spark, sf):
    text = F.expr("CASE WHEN p_partkey % 5 = 0 THEN 'NA' WHEN p_partkey % 7 = 0 THEN '$12' ELSE concat('$', CAST(CAST(p_retailprice AS DECIMAL(12,3)) AS STRING)) END")
    return table(spark, sf, "part").withColumn("stated", text).select("p_partkey", asof.reviewed_price("stated").cast("double").alias("price"))


@query("as11_ranges", """WITH r AS (SELECT l_tax AS a, l_discount AS b, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_discount END AS low, CASE WHEN l_linenumber = 1 THEN 0
  ELSE l_tax END AS high FROM lineitem), p AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN least(a, b) WHEN a > 0 THEN a WHEN b > 0 THEN b END AS lo,
  CASE WHEN a > 0 OR b > 0 THEN greatest(a, b) END AS hi FROM r)
  SELECT CASE WHEN lo IS NULL AND low = 0 AND high = 0 THEN 'missing' WHEN lo = low AND hi = high THEN 'ok' ELSE 'range' END AS state, count(*) AS n
  FROM p GROUP BY 1""")
def as11(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("array(l_tax, l_discount) AS prices", "CASE WHEN l_linenumber = 1 THEN 0 ELSE l_discount END AS low", "CASE WHEN l_linenumber = 1 THEN 0 ELSE l_tax END AS high")
    return asof.range_check(rows).groupBy("state").agg(F.count("*").alias("n"))


IMPACT = ["the", "and", "der", "le"]
PRODUCTS = {f"p{k}": terms for k, terms in enumerate((["is", "of"], ["in", "un"], ["on", "und"], ["la", "a"], ["to"], ["by"], ["that"]))}
EVENTS: dict[str, list[str]] = {"supply": [], "fuel_energy": ["for", "with", "from"]}


def word_sql(text: str, terms: list[str]) -> str:
    return f"regexp_matches({text}, '(^|[^\\w])({'|'.join(terms)})([^\\w]|$)')"


NAMED = " ".join(f"WHEN p = '{p}' AND {word_sql('q', t)} THEN '{p}'" for p, t in PRODUCTS.items())


@query("nw6_evidence", rf"""WITH {ART}, r AS (SELECT id, products, trim(regexp_replace(substr(text, 1, 60), '\s+', ' ', 'g')) AS quote, text FROM art),
q AS (SELECT *, lower(quote) AS q FROM r), ok AS (SELECT * FROM q
  WHERE length(quote) >= 12 AND {word_sql('q', IMPACT)} AND (id % 3 = 0 OR (id % 3 = 1 AND {word_sql('q', EVENTS['fuel_energy'])})) AND id % 5 <> 0),
n AS (SELECT id, list_distinct(list(CASE {NAMED} END) FILTER ((CASE {NAMED} END) IS NOT NULL)) AS ps FROM (SELECT id, q, unnest(products) AS p FROM ok) GROUP BY id)
SELECT id, array_to_string(list_sort(ps), ',') AS products FROM n WHERE len(ps) > 0""")
def nw6(spark, sf):
    rows = articles(spark, sf).select(
        "id", F.col("source").alias("title"), F.col("text").alias("content"), F.expr("CASE WHEN id % 5 = 0 THEN 'a quote of no article at all' ELSE substring(text, 1, 60) END").alias("evidence"),
        F.expr("CASE id % 3 WHEN 0 THEN ' Supply' WHEN 1 THEN 'FUEL_energy' ELSE 'other' END").alias("event_type"), F.transform("products", lambda p: F.upper(p)).alias("products"), F.array(F.lit("LPG price"), F.lit("rice"), F.lit("Rice ")).alias("keywords"),
    )
    return news.evidenced(rows, IMPACT, PRODUCTS, EVENTS).select("id", F.array_join(F.array_sort("products"), ",").alias("products"))


@query("nw9_stories", """WITH RECURSIVE it AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS i,
  doc_id AS id, 'u' || md5(coalesce(text, '')) AS k1, 's' || substr(md5(substr(coalesce(text, ''), 1, 40)), 1, 12) || coalesce(lang, '') AS k2
  FROM documents),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS BIGINT) AS id, false AS kept
      UNION ALL SELECT it.i, CASE WHEN list_has_any(seen, [k1, k2]) THEN seen ELSE list_concat(seen, [k1, k2]) END, it.id, NOT list_has_any(seen, [k1,
  k2]) FROM g JOIN it ON it.i = g.i + 1)
SELECT id FROM g WHERE kept""")
def nw9(spark, sf):
    """The address from the whole text, the title from its beginning, so copies share both and near copies one."""
    rows = table(spark, sf, "documents").selectExpr("doc_id AS id", "concat('HTTPS://www.u', md5(coalesce(text, '')), '/?v=', CAST(doc_id AS STRING)) AS url", "concat(' S  ', substr(md5(substring(coalesce(text, ''), 1, 40)), 1, 12)) AS title", "lang AS source", "'2024-01-01' AS date")
    return news.unique_stories(rows).select("id")


@query("nw10_publication", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN TIMESTAMP '2024-05-01 05:08:09' + to_days(CAST(page_id % 28 AS INT))
  WHEN 3 THEN TIMESTAMP '2024-03-01 23:30:00' + to_days(CAST(page_id % 28 AS INT)) END AS published_at,
CASE page_id % 6 WHEN 0 THEN DATE '2024-05-01' + CAST(page_id % 28 AS INT) WHEN 1 THEN DATE '2023-11-07' WHEN 2 THEN DATE '2022-02-03'
  WHEN 3 THEN DATE '2024-03-02' + CAST(page_id % 28 AS INT) WHEN 4 THEN DATE '2021-07-09' END AS published_on,
CASE page_id % 6 WHEN 0 THEN 'article_published_meta' WHEN 1 THEN 'article_published_meta' WHEN 2 THEN 'json_ld_date_published'
  WHEN 3 THEN 'crawler_metadata' WHEN 4 THEN 'url_date' ELSE 'unknown' END AS source FROM pages""")
def nw10(spark, sf):
    """The pages with a publication tag put in by page id: meta tags in both orders, JSON-LD, crawler metadata, a dated address, nothing."""
    day = "date_format(date_add(DATE '2024-05-01', CAST(page_id % 28 AS INT)), 'yyyy-MM-dd')"
    html = f"""CASE page_id % 6 WHEN 0 THEN concat('<meta property="article:published_time" content="', {day}, 'T07:08:09+02:00">', html)
      WHEN 1 THEN concat('<META content="2023-11-07T10:00:00" property=\\'article:published_time\\'>', html)
  WHEN 2 THEN concat('<script type="application/ld+json">{{"datePublished" : "2022-02-03"}}</script>', html) ELSE html END"""
    meta = "CASE page_id % 6 WHEN 3 THEN concat(date_format(date_add(DATE '2024-03-02', CAST(page_id % 28 AS INT)), 'yyyy-MM-dd'), ' 01:30:00+02:00') WHEN 4 THEN 'soon' END"
    rows = table(spark, sf, "pages").selectExpr("page_id", f"{html} AS html", f"{meta} AS meta", "CASE WHEN page_id % 6 = 4 THEN concat(url, '/2021/7/9/x') ELSE url END AS url")
    at, on, source = news.publication(F.col("meta"), F.col("html"), F.col("url"))
    return rows.select("page_id", F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")).alias("published_at"), on.alias("published_on"), source.alias("source"))


@query("nw12_tags", f"""WITH {ART}, a AS (SELECT id, products, published_date, CASE WHEN id % 4 = 0 THEN 1.0 ELSE id % 10 / 10.0 END AS probability, CASE
  WHEN id % 6 > 0 THEN CAST(id % 2500 AS INT) END AS days FROM art),
v AS (SELECT *, list_filter(['FUEL PRICE', CASE WHEN id % 29 = 0 THEN 'RED ALERT' END, CASE
  WHEN id % 5 = 0 THEN 'YELLOW ALERT' END, 'K' || CAST(id % 19 AS VARCHAR)], lambda x: x IS NOT NULL)[1:3] AS kw FROM a
  WHERE probability >= 0.6 AND (days IS NULL OR published_date + days >= DATE '1999-01-01')),
e AS (SELECT unnest(products) AS product, id, published_date, kw
  FROM v), t AS (SELECT product, id, published_date, unnest(kw) AS tag, generate_subscripts(kw, 1) AS pos FROM e),
f AS (SELECT product, tag, min(row(DATE '1999-01-01' - published_date, id, pos)) AS f_at FROM t GROUP BY 1, 2),
g AS (SELECT product, tag, row_number() OVER (PARTITION BY product ORDER BY f_at) AS rank FROM f
  WHERE NOT (tag = 'YELLOW ALERT' AND product IN (SELECT product FROM f WHERE tag = 'RED ALERT')))
SELECT product, tag, rank FROM g WHERE rank <= 3""")
def nw12(spark, sf):
    keywords = F.expr("array_compact(array('Fuel%20price', ' fuel  price', CASE WHEN id % 29 = 0 THEN 'Red Alert' END, CASE WHEN id % 5 = 0 THEN 'yellow alert' END, 'lpg supply', concat('k', CAST(id % 19 AS STRING))))")
    rows = articles(spark, sf).withColumns({"probability": F.expr("CASE WHEN id % 4 > 0 THEN CAST(id % 10 / 10.0 AS DOUBLE) END"), "validity_days": F.expr("CASE WHEN id % 6 > 0 THEN CAST(id % 2500 AS INT) END"), "keywords": keywords})
    return news.tags(rows, "1999-01-01").withColumn("rank", F.col("rank").cast("long"))
