"""URL filters with redirect equivalence: rules by host and path, carried over to aliases.

Rules decide on the addresses they fit. Addresses that redirect to each other or name each other as
canonical are names of one page: the links (from the heads of the pages, and from a log of redirects
where there is one) make a graph whose connected components are found by star rounds. A component of
which some address is blocked by a rule is blocked, unless a rule explicitly allows one of its
addresses; an address on which a rule itself decides keeps that decision whatever its aliases say.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import connected_components

#: Rules of the query: host (and its subdomains), beginning of the path, verdict (fixed values).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def key_of(url: Column) -> Column:
    """One name for spellings of an address: no scheme, no default port, no fragment, ``/`` for an empty path; null without a host."""
    host = F.regexp_replace(host_of(url), ":(80|443)?$", "")
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    query = F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))
    return F.when(host != "", F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


#: Elements that may stand in a head; the first other start tag begins the body.
_HEAD = {"html", "head", "title", "base", "link", "meta", "style", "script", "noscript", "template"}
#: Elements whose content is skipped.
_SKIPPED = {"title", "style", "script", "noscript", "template"}
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?""")
#: What stands before the address in a refresh.
_REFRESH = re.compile(r"(?i)\s*+[\d.]++\s*+[;,]?\s*+(?:url\s*+=\s*+)?+")


def head_links(page: str, url: str) -> list[str]:
    """Addresses that the head names as canonical or refreshes to, resolved against ``<base>`` or ``url``.

    Links outside the head (comments, scripts, the body, where visitors may write) count for nothing.
    One pass; the text is left at the first tag of the body.
    """
    found, base, at = [], url, int(page.startswith("\ufeff"))
    while (start := page.find("<", at)) >= 0 and not page[at:start].strip():
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3
        elif page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start)
            at = end + 1
        elif tag := _TAG.match(page, start):
            end, name = tag.end(), tag[2].lower()
            at = end
            if name not in _HEAD or (tag[1] and name == "head"):
                break
            if not tag[1] and name in ("base", "link", "meta"):
                has: dict[str, str] = {}
                for a in _ATTRIBUTE.finditer(tag[3]):
                    has.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or "").strip())
                if name == "base" and base is url and has.get("href"):
                    base = urljoined(url, has["href"])
                elif name == "link" and "canonical" in has.get("rel", "").lower().split() and has.get("href"):
                    found.append(has["href"])
                elif name == "meta" and has.get("http-equiv", "").lower() == "refresh" and (wait := _REFRESH.match(has.get("content", ""))):
                    if to := has["content"][wait.end() :].strip(" \t\r\n\f\"'"):
                        found.append(to)
            elif not tag[1] and name in _SKIPPED:
                close = re.compile(rf"(?i)</{name}\b[^>]*>").search(page, end)
                if not close:
                    break
                at = close.end()
        else:
            break
        if end < 0:
            break
    return [urljoined(base, x) for x in found]


def urljoined(base: str, href: str) -> str:
    """``href`` seen from ``base``; as it stands where either is no address."""
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``url, target`` of the canonical and refresh links of pages; only pages whose text has such a word are parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, targets = [], []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html"), strict=True):
                for target in head_links(page.as_py(), url):
                    urls.append(url)
                    targets.append(target)
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(targets, pa.string())], names=["url", "target"])

    rows = pages.select(pages[url_col].alias("url"), pages[html_col].alias("html"))
    return rows.where(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|refresh")).mapInArrow(run, "url string, target string")


def fitting_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path`` (different ones) with the ``rule`` and ``verdict`` of the longest rule that fits, where one does.

    A host meets the rules of itself and of each domain above it by equality. Of rules of one length the
    one of the longer host decides, of equal rules the allowing one.
    """
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = places.where("host <> ''").select("host", "path", F.explode(F.array_distinct(above)).alias("domain"))
    fits = asked.join(rules, "domain").where(F.expr("startswith(path, prefix)"))
    best = F.max(F.struct(F.length("rule"), F.length("domain"), F.col("verdict") == "allow", "rule", "verdict")).alias("best")
    return fits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict`` and ``alias_verdict`` (what the aliases would say, if anything) of every row of ``pages``.

    ``rules``: ``domain, prefix, verdict``; ``redirects``: ``url, target``, links known from elsewhere.
    ``verdict`` is the longest fitting rule's, else that of the aliases, else allow. A null address, or
    one without ``://``, has an empty host and path, no rule and no aliases, and is allowed. Repeated
    rows give repeated results, other columns are ignored, an empty table gives no rows; empty or null
    pages have no links. Rules with a null part fit nothing.
    """
    own = pages.select(pages[id_col].alias("id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"), key_of(pages[url_col]).alias("key"))
    rules = rules.select("domain", "prefix", F.concat("domain", "prefix").alias("rule"), "verdict").dropna().distinct()
    links = [] if html_col is None else [page_links(pages, url_col, html_col)]
    links += [] if redirects is None else [redirects.select("url", "target")]
    decided = None
    if links:
        links = links[0] if len(links) == 1 else links[0].union(links[1])
        named = links.select(key_of(F.col("url")).alias("u"), key_of(F.col("target")).alias("v")).where("u <> v").distinct()
        named = materialize(named, "url-links")
        if not named.isEmpty():
            nodes = connected_components(named)
            place = F.regexp_extract("node", r"(?s)^([^/]*)([^?]*)", 1).alias("host"), F.regexp_extract("node", r"(?s)^([^/]*)([^?]*)", 2).alias("path")
            nodes = materialize(nodes.distinct().select("node", "root", *place), "url-nodes")
            ruled = nodes.join(fitting_rules(nodes.select("host", "path").distinct(), rules), ["host", "path"])
            said = ruled.groupBy("root").agg(F.max(F.col("verdict") == "allow").alias("allowed"))
            said = said.select("root", F.when(F.col("allowed"), "allow").otherwise("block").alias("alias_verdict"))
            decided = nodes.join(said, "root").select(F.col("node").alias("key"), "alias_verdict")
    fitted = fitting_rules(own.select("host", "path").distinct(), rules)
    out = own.join(fitted, ["host", "path"], "left")
    out = out.withColumn("alias_verdict", F.lit(None).cast("string")) if decided is None else out.join(decided, "key", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", "alias_verdict", F.lit("allow")).alias("verdict"), "alias_verdict")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "domain string, prefix string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules).drop("alias_verdict")


#: Links by plain patterns, components by a recursive reach.
ORACLE = r"""
WITH RECURSIVE page AS (
    SELECT page_id, url, html,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
        regexp_replace(url, '(?s)^.*?://([^#]*).*$', '\1') AS name
    FROM pages
),
rules(host, prefix, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
link AS (
    SELECT name AS u, regexp_replace(regexp_extract(html, '(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1), '(?s)^.*?://([^#]*).*$', '\1') AS v
    FROM page WHERE regexp_matches(html, '(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"')
),
both_ways AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach(a, b) AS (SELECT u, v FROM both_ways UNION SELECT a, v FROM reach JOIN both_ways ON b = u),
place AS (
    SELECT host, path, name FROM page
    UNION SELECT lower(regexp_extract(v, '(?s)^([^/?]*)([^?]*)', 1)), regexp_extract(v, '(?s)^([^/?]*)([^?]*)', 2), v FROM link
),
fits AS (
    SELECT p.host, p.path, r.host || r.prefix AS rule, r.verdict
    FROM (SELECT DISTINCT host, path FROM place) p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.prefix)
),
longest AS (SELECT host, path, rule, verdict FROM fits QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC) = 1),
alias AS (
    SELECT a, CASE WHEN bool_or(l.verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict
    FROM (SELECT a, b FROM reach UNION SELECT a, a FROM reach) JOIN place ON name = b JOIN longest l ON l.host = place.host AND l.path = place.path GROUP BY a
)
SELECT page_id, page.host, page.path, rule, coalesce(l.verdict, alias.verdict, 'allow') AS verdict
FROM page LEFT JOIN longest l ON page.host = l.host AND page.path = l.path LEFT JOIN alias ON page.name = alias.a
"""
