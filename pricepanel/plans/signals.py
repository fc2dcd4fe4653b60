"""AS and NW queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricepanel.operators import asof, news

from .base import query, table

REL = "rel AS (SELECT o_orderpriority AS grade, CAST(o_orderdate AS DATE) AS reference_end, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 AS INT) AS available_at, CAST(o_totalprice AS DOUBLE) AS value, o_orderkey FROM orders), og AS (SELECT DISTINCT grade, CAST(unnest(generate_series(DATE '1996-01-15', DATE '1998-01-15', INTERVAL 30 DAY)) AS DATE) AS origin FROM rel)"


def releases(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grade"), F.to_date("o_orderdate").alias("reference_end"), F.expr("date_add(to_date(o_orderdate), CAST(o_orderkey % 20 AS INT))").alias("available_at"), F.col("o_totalprice").cast("double").alias("value"), "o_orderkey")


def asked(spark, sf):
    return releases(spark, sf).select("grade").distinct().select("grade", F.explode(F.expr("sequence(DATE '1996-01-15', DATE '1998-01-15', INTERVAL 30 DAYS)")).alias("origin"))


ASOF = """, j AS (SELECT og.grade, og.origin, max(struct_pack(reference_end := reference_end, available := available_at, value := value)) AS b FROM og LEFT
  JOIN rel ON rel.grade = og.grade AND available_at <= origin - {lag} GROUP BY og.grade, og.origin),
s AS (SELECT grade, origin, CASE WHEN b.reference_end IS NULL THEN 'no_available_quote' WHEN origin - b.reference_end > {age}
  OR origin < b.reference_end THEN 'stale_reference' ELSE 'available' END AS reason, b FROM j)
"""
ASK = """SELECT grade, origin, reason, CASE WHEN reason = 'available' THEN b.value END AS value, CASE
  WHEN reason = 'available' THEN b.reference_end END AS reference_end FROM s"""


@query("as1_vintage", "WITH " + REL + ASOF.format(lag=0, age=10) + ASK)
def as1(spark, sf):
    return asof.as_of(asked(spark, sf), releases(spark, sf), ["grade"], 10)


@query("as2_lagged", "WITH " + REL + ASOF.format(lag=7, age=8) + ASK)
def as2(spark, sf):
    return asof.as_of(asked(spark, sf), releases(spark, sf), ["grade"], 8, 7)


@query("as3_monthly", "WITH " + REL.replace("CAST(o_orderdate AS DATE) AS reference_end", "last_day(CAST(o_orderdate AS DATE)) AS reference_end") + ASOF.format(lag=5, age=45) + ASK)
def as3(spark, sf):
    return asof.monthly_as_of(asked(spark, sf), releases(spark, sf).withColumnRenamed("reference_end", "period"), ["grade"], 45, 5)


@query("as3_sectors", "WITH " + REL + """, f AS (SELECT grade, last_day(reference_end) AS period, min(struct_pack(available := available_at, value := value)) AS x FROM rel GROUP BY ALL),
l AS (SELECT *, lag(period) OVER w AS p, lag(x) OVER w AS b FROM f WINDOW w AS (PARTITION BY grade ORDER BY period)),
rel2 AS (SELECT grade, period AS reference_end, greatest(x.available, b.available) AS available_at, x.value / b.value - 1 AS value FROM l WHERE p = last_day(period - INTERVAL 1 MONTH))""" + ASOF.format(lag=0, age=60).replace("JOIN rel ON rel.", "JOIN rel2 rel ON rel.") + """SELECT grade, origin, reason, CASE WHEN reason = 'available' THEN round(b.value, 6) END AS value, CASE WHEN reason = 'available' THEN b.reference_end END AS reference_end FROM s""")
def as3s(spark, sf):
    changes = asof.monthly_changes(releases(spark, sf).withColumnRenamed("reference_end", "period"), ["grade"])
    return asof.monthly_as_of(asked(spark, sf), changes, ["grade"], 60).withColumn("value", F.round("value", 6))


@query("as4_validate", "WITH " + REL + """, v AS (SELECT concat_ws(',', CASE WHEN count(*) OVER (PARTITION BY grade, reference_end, available_at) > 1 THEN 'duplicate' END, CASE
  WHEN o_orderkey % 5 = 0 THEN 'hash' END, CASE WHEN o_orderkey % 7 = 0 THEN 'url' END) AS broken FROM rel) SELECT broken, count(*) AS n FROM v
  GROUP BY 1""")
def as4(spark, sf):
    rows = releases(spark, sf).withColumns({"sha256": F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.sha2(F.col("o_orderkey").cast("string"), 256)), "source_url": F.when(F.col("o_orderkey") % 7 == 0, "http://a").otherwise("https://a")})
    return asof.validate(rows, ["grade"]).groupBy("broken").agg(F.count("*").alias("n"))


@query("as4_reasons", "WITH " + REL + """, p AS (SELECT grade, reference_end, available_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE value END AS v,
  CASE WHEN o_orderkey % 6 = 0 THEN 'not published' WHEN o_orderkey % 10 = 1 THEN 'late' WHEN o_orderkey % 9 = 0 THEN ' ' END AS reason, o_orderkey FROM rel),
v AS (SELECT concat_ws(',', CASE WHEN count(*) OVER (PARTITION BY grade, reference_end, available_at) > 1 THEN 'duplicate' END,
  CASE WHEN v IS NULL AND trim(coalesce(reason, '')) = '' OR v IS NOT NULL AND reason IN ('not published', 'late') THEN 'value' END,
  CASE WHEN o_orderkey % 11 = 0 THEN 'evidence' END) AS broken FROM p) SELECT broken, count(*) AS n FROM v GROUP BY 1""")
def as4_reasons(spark, sf):
    """Releases of which some lack a value, with and without a reason, some have both, and some no evidence of when they appeared."""
    k = F.col("o_orderkey")
    rows = releases(spark, sf).withColumns({
        "value": F.when(k % 3 != 0, F.col("value")), "missing_reason": F.when(k % 6 == 0, "not published").when(k % 10 == 1, "late").when(k % 9 == 0, " "),
        "availability_evidence": F.when(k % 11 != 0, "archive"), "sha256": F.sha2(k.cast("string"), 256), "source_url": F.lit("https://a"),
    })
    return asof.validate(rows, ["grade"]).groupBy("broken").agg(F.count("*").alias("n"))


@query("as5_admission", """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE year(CAST(o_orderdate AS DATE)) = 1997 GROUP BY 1)
  SELECT CASE WHEN n IS NULL THEN 'no_availability' WHEN n > 1 THEN 'ambiguous' ELSE 'admitted' END AS state, count(*) AS n FROM customer LEFT
  JOIN a ON k = c_custkey GROUP BY 1""")
def as5(spark, sf):
    """Customers as reviewed rows of one address, orders as availability by customer and year."""
    available = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("sha256"), F.year("o_orderdate").cast("string").alias("source_url"), F.to_date("o_orderdate").alias("available_at"))
    reviewed = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("sha256"), F.lit("1997").alias("source_url"))
    return asof.admit(reviewed, available).groupBy("state").agg(F.count("*").alias("n"))


@query("as7_coverage", "WITH " + REL + """, g AS (SELECT 0 AS lag, 5 AS max_age UNION ALL SELECT 7, 10), j AS (SELECT lag, max_age, og.grade, origin, max(struct_pack(r := reference_end,
  a := available_at, v := value)) AS b FROM og CROSS JOIN g LEFT JOIN rel ON rel.grade = og.grade AND available_at <= origin - lag GROUP BY ALL)
  SELECT lag, max_age, count(*) AS n, count(*) FILTER (origin - b.r <= max_age AND b.r <= origin) AS usable FROM j GROUP BY ALL""")
def as7(spark, sf):
    o, r = asked(spark, sf), releases(spark, sf)
    return asof.coverage_grid(o, r, ["grade"], [0], [5]).unionByName(asof.coverage_grid(o, r, ["grade"], [7], [10]))


ART = """art AS (SELECT doc_id AS id, text, source, list_distinct(['p' || CAST(doc_id % 7 AS VARCHAR), 'p' || CAST(doc_id % 11 AS VARCHAR)]) AS products, CAST(DATE '1995-01-02' + CAST(doc_id % 2499 AS INT) AS DATE) AS published_date, (doc_id * 37 % 201 - 100) / 100.0::DOUBLE AS sentiment, doc_id % 13 = 0 AS is_shock FROM documents)"""


def articles(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "text", "source", F.expr("array_distinct(array(concat('p', CAST(doc_id % 7 AS STRING)), concat('p', CAST(doc_id % 11 AS STRING))))").alias("products"),
        F.expr("date_add(DATE '1995-01-02', CAST(doc_id % 2499 AS INT))").alias("published_date"), F.expr("CAST((doc_id * 37 % 201 - 100) / 100.0 AS DOUBLE)").alias("sentiment"), (F.col("doc_id") % 13 == 0).alias("is_shock"),
    )


@query("nw1_match", f"WITH {ART} SELECT id, published_date FROM art WHERE list_contains(products, 'p3') AND published_date >= DATE '1995-06-01'")
def nw1(spark, sf):
    return news.match(articles(spark, sf), "P3", "1995-06-01").select("id", "published_date")


@query("nw2_events", f"""WITH {ART} SELECT CASE WHEN sentiment < -0.2 THEN 'increase' WHEN sentiment > 0.2 THEN 'decrease' ELSE 'neutral' END AS impact, count(*) AS n,
  round(avg(abs(sentiment)), 6) AS confidence FROM art GROUP BY 1""")
def nw2(spark, sf):
    return articles(spark, sf).groupBy(news.impact(F.col("sentiment")).alias("impact")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs("sentiment")), 6).alias("confidence"))


@query("nw3_windows", f"""WITH {ART}, a AS (SELECT unnest(products) AS product, published_date, sentiment, is_shock,
  coalesce(regexp_matches(text, '(?i)(^|[^\\w])(inflation|cpi)([^\\w]|$)'), false) AS inflation,
  CASE WHEN sentiment < -0.2 THEN abs(sentiment) WHEN sentiment > 0.2 THEN -abs(sentiment) ELSE 0 END AS signed
  FROM art), d AS (SELECT DISTINCT product, published_date AS day FROM a)
SELECT d.product, d.day, count(a.product) FILTER (day - published_date <= 3) AS n_3, count(a.product) FILTER (day - published_date <= 7) AS n_7,
  count(a.product) AS n_14, count(*) FILTER (is_shock AND day - published_date <= 7) AS shocks_7,
count(*) FILTER (inflation) AS inflation_14, count(*) FILTER (sentiment < -0.2 AND day - published_date <= 7) AS rising_7,
  count(*) FILTER (sentiment > 0.2 AND day - published_date <= 7) AS falling_7,
round(coalesce(avg(sentiment), 0) + 3e-8, 6) AS mean_sentiment_14,
  round(coalesce(avg(abs(sentiment)) FILTER (day - published_date <= 7), 0) + 3e-8, 6) AS mean_confidence_7,
  round(coalesce(avg(signed) FILTER (day - published_date <= 3), 0) + 3e-8, 6) AS signed_score_3
FROM d LEFT JOIN a ON a.product = d.product AND a.published_date BETWEEN d.day - 14 AND d.day GROUP BY ALL""")
def nw3(spark, sf):
    rows = articles(spark, sf)
    days = rows.select(F.explode("products").alias("product"), F.col("published_date").alias("day")).distinct()
    means = ("mean_sentiment_14", "mean_confidence_7", "signed_score_3")
    return news.windows(rows, days).select("product", "day", "n_3", "n_7", "n_14", "shocks_7", "inflation_14", "rising_7", "falling_7", *[F.round(F.col(c) + 3e-8, 6).alias(c) for c in means])


@query("nw4_topics", f"""WITH {ART} SELECT id FROM art WHERE regexp_matches(lower(text), '\\b(worthless|idiot|clown)\\b')
  AND regexp_matches(lower(text), '\\b(the|that|from)\\b')""")
def nw4(spark, sf):
    return articles(spark, sf).where(news.topical(F.col("text"), ["worthless", "idiot", "clown"], ["the", "that", "from"])).select("id")


BODY = r"""WITH t AS (SELECT doc_id AS id, CASE doc_id % 3
  WHEN 0 THEN 'Menu' || chr(10) || 'Published April 27, 2026 02:55 PM PHT' || chr(10) || coalesce(text, '') || chr(10) || 'Read More: [x](y)' || chr(10) || 'more'
  WHEN 1 THEN '# Head [one](http://a) ![pic](b)' || chr(10) || coalesce(text, '') ELSE text END AS t FROM documents),
b AS (SELECT id, regexp_replace(regexp_replace(t, '(?s)\A.*?(?m:^)[ \t]*Published\s+\w+\s+\d{1,2},?\s+\d{4}[^\n]*(\n|\z)', ''), '(?ms)^[ \t]*(Read More|Copyright ©|Privacy Preference Center).*\z', '') AS t FROM t),
p AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '#{1,6}\s*|[*_~`]{1,3}', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM b),
c AS (SELECT id, regexp_replace(regexp_replace(t, '\A\s+', ''), '\s+\z', '') AS t FROM p)
SELECT id, length(t) AS n_chars, sha256(t) AS sha256 FROM c WHERE length(t) >= 200"""


@query("nw5_body", BODY)
def nw5(spark, sf):
    """Documents as pages in markdown: with a publication line and footer, with a heading of links, or bare."""
    page = F.expr(
        "CASE doc_id % 3 WHEN 0 THEN concat('Menu\\nPublished April 27, 2026 02:55 PM PHT\\n', coalesce(text, ''), '\\nRead More: [x](y)\\nmore') "
        "WHEN 1 THEN concat('# Head [one](http://a) ![pic](b)\\n', coalesce(text, '')) ELSE text END"
    )
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), news.clean_body(page).alias("body")).where("body IS NOT NULL")
    return rows.select("id", F.length("body").cast("long").alias("n_chars"), F.sha2("body", 256).alias("sha256"))


@query("nw7_hosts", r"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM pages) SELECT page_id FROM u
  WHERE (host = 'example.net' OR host LIKE '%.example.net') AND NOT regexp_matches(url, '/(fr|de)(/|$|\?)')""")
def nw7(spark, sf):
    return table(spark, sf, "pages").where(news.allowed_url(F.col("url"), ["example.net"], ["fr", "de"])).select("page_id")


@query("nw8_dedup", f"""WITH {ART}, s AS (SELECT DISTINCT sha256(text) AS h FROM art WHERE coalesce(source, '') < 'src2' AND text IS NOT NULL)
  SELECT min(id) AS id, sha256(text) AS content_hash FROM art WHERE coalesce(source, '') >= 'src2' AND sha256(text) NOT IN (SELECT h FROM s)
  GROUP BY sha256(text)""")
def nw8(spark, sf):
    """Articles of some sources as the store, those of all others as the batch."""
    rows = articles(spark, sf).select("id", F.col("text").alias("content"), F.col("id").cast("string").alias("url"), F.coalesce("source", F.lit("")).alias("source")).where("content IS NOT NULL")
    stored = rows.where("source < 'src2'").select("url", F.sha2("content", 256).alias("content_hash"))
    return news.new_articles(rows.where("source >= 'src2'").drop("source"), stored).select("id", "content_hash")


@query("nw11_listing", f"""WITH {ART} SELECT id, published_date FROM art WHERE published_date >= DATE '1995-03-01' AND contains(lower(source), 'src1')
  ORDER BY published_date DESC, id LIMIT 20 OFFSET 20""")
def nw11(spark, sf):
    return news.listing(articles(spark, sf).withColumnRenamed("source", "title"), "SRC1", "1995-03-01", 1, 20).select("id", "published_date")


@query("nw13_factors", f"""WITH {ART}, a AS (SELECT unnest(products) AS product, id, published_date, sentiment FROM art
  WHERE published_date BETWEEN DATE '1995-06-16' AND DATE '1995-06-30'), r AS (SELECT *, row_number() OVER (PARTITION BY product
  ORDER BY published_date DESC, id) AS rank FROM a) SELECT product, id, rank, CASE WHEN sentiment > 0.3 THEN 'positive'
  WHEN sentiment < -0.3 THEN 'negative' ELSE 'neutral' END AS label FROM r WHERE rank <= 5""")
def nw13(spark, sf):
    return news.factors(articles(spark, sf), "1995-06-30").select("product", "id", F.col("rank").cast("long").alias("rank"), "label")
