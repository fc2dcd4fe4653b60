"""Text metrics, document index, corroboration, evidence, stories and tags."""

import datetime as dt
import random

from pricepanel.operators import asof, news


def test_text_metrics_need_exactly_one_match(spark):
    docs = spark.createDataFrame([(1, "loss of 1,250 ha"), (2, "loss of 3 ha and loss of 4 ha"), (3, ""), (4, None), (5, "loss of , ha")], "id long, text string")
    out = {r.id: (r.state, r.value, r.start) for r in asof.text_metrics(docs, [("area", "loss of ([0-9,]+) ha", "2")]).collect()}
    assert out == {1: ("accepted", 2500.0, 1), 2: ("many_matches", None, None), 3: ("no_match", None, None), 4: ("no_match", None, None), 5: ("not_a_number", None, None)}


def test_document_index_sets_bad_rows_aside(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(1, 3, "http://www.a.org/f?x", 2001, "Rice"), (2, 3, "https://a.org/f", 2002, "rice, corn"), (3, 2, "https://a.org/f", 2003, "rice"), (4, 3, "https://b.com/f", 2003, "rice"), (5, 3, None, 2003, "rice"), (6, 3, "https://a.org/g", None, None)],
        "place int, n_cells int, url string, year int, subject string",
    )
    rows = asof.listed(rows, ["a.org"])
    assert [r.reason for r in rows.collect()] == [None, None, "cells", "host", "link", None]
    out = {r.document: (r.part, r.occurrences, r.years, r.candidate, [x.place for x in r.listed]) for r in asof.document_index(rows, "rice").collect()}
    assert out == {"https://a.org/f": (0, 2, 2, True, [1, 2]), "https://a.org/g": (0, 1, 0, False, [6])}
    monkeypatch.setattr(asof, "OCCURRENCES", 1)
    assert sorted((r.document, r.part, r.occurrences, r.listed[0].place) for r in asof.document_index(rows, "rice").collect()) == [("https://a.org/f", 0, 2, 1), ("https://a.org/f", 1, 2, 2), ("https://a.org/g", 0, 1, 6)]


def test_corroboration_states(spark):
    releases = spark.createDataFrame([(k, "index", 1.5, "May") for k in range(5)], "link long, metric string, value double, month string")
    linked = spark.createDataFrame([(0, 1.5, "index of May"), (1, 1.5, "index of Mayor"), (2, 1.5, "index of May"), (2, 1.5, "index, May"), (3, 1.5, "volume of May"), (4, 2.0, "index of May")], "link long, value double, context string")
    assert {r.link: r.state for r in asof.corroborate(releases, linked).collect()} == {0: "corroborated", 1: "other_month", 2: "ambiguous", 3: "none", 4: "none"}


def test_evidence_must_be_quoted_and_named(spark):
    text = "Heavy rain means\n rice prices rise in the north."
    case = lambda k, quote, kind="supply", products=("RICE", "corn"), title="t": (k, title, text, quote, kind, list(products) if products else None, ["LPG price", "a  b", "A b", "c", "d", "e"])
    rows = [
        case(1, '"Rice prices  RISE"'), case(2, "rice prices fall"), case(3, "prices rise in"), case(4, "rise"), case(5, "rice prices rise", "gossip"), case(6, "rice prices rise", "fuel_energy"),
        case(7, None), case(8, "rice prices rise", None), case(9, "rice prices rise", products=None), case(10, "rice prices rise", title=None),
    ]
    df = spark.createDataFrame(rows, "id long, title string, content string, evidence string, event_type string, products array<string>, keywords array<string>")
    out = {r.id: r for r in news.evidenced(df, ["rise", "fall"], {"rice": ["rice"], "corn": ["corn", "maize"]}, {"supply": [], "fuel_energy": ["diesel"]}).collect()}
    assert set(out) == {1, 10} and out[1].products == ["rice"] and out[1].keywords == ["A B", "C", "D"]


def test_unique_stories_equal_the_greedy_pass(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["", f"http://www.a.org/{rng.randrange(40)}/?q={k}"]), rng.choice(["", f" Ｔ {rng.randrange(30)}"]), "s", "2024-01-01") for k in range(300)]
    seen, want = set(), []
    for k, url, title, _, _ in rows:
        keys = {x for x in (url.split("?")[0].rstrip("/"), title and "s:" + title) if x}
        if not keys & seen:
            want.append(k)
            seen |= keys
    df = spark.createDataFrame(rows, "id long, url string, title string, source string, date string")
    assert sorted(r.id for r in news.unique_stories(df).collect()) == want
    assert news.unique_stories(df.limit(0)).count() == 0


def test_tags_prefer_new_articles_and_the_red_alert(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, ["p"], d, 30, 0.9, ["Red%20Alert", "x", "X "]), (2, ["p"], d + dt.timedelta(1), None, None, ["yellow alert", "y"]), (3, ["p", "q"], d, 2, 0.9, ["gone"]), (4, ["q"], d, None, 0.5, ["weak"]), (5, None, d, None, 1.0, ["z"]), (6, ["q"], None, None, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, products array<string>, published_date date, validity_days int, probability double, keywords array<string>")
    assert [tuple(r) for r in news.tags(df, "2024-01-10").orderBy("product", "rank").collect()] == [("p", "Y", 1), ("p", "RED ALERT", 2), ("p", "X", 3)]
