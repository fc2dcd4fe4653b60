"""As-of lookups, news rules and streaming operators."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from pricepanel.operators import asof, backtest, features, news, panel, state, store, streams

D = dt.date(2024, 1, 1)
day = lambda k: D + dt.timedelta(days=k)


def test_as_of_reasons(spark):
    releases = spark.createDataFrame([("g", day(0), day(2), 1.0), ("g", day(5), day(9), 2.0), ("g", day(4), day(30), 9.0)], "k string, reference_end date, available_at date, value double")
    origins = spark.createDataFrame([("g", day(k)) for k in (1, 3, 9, 10, 40)] + [("h", day(3))], "k string, origin date")
    out = {(r.k, r.origin): (r.reason, r.value) for r in asof.as_of(origins, releases, ["k"], 10, 1).collect()}
    assert out[("g", day(1))] == ("no_available_quote", None) and out[("g", day(3))] == ("available", 1.0) and out[("g", day(9))] == ("available", 1.0)
    assert out[("g", day(10))] == ("available", 2.0) and out[("g", day(40))] == ("stale_reference", None) and out[("h", day(3))][0] == "no_available_quote"


def test_first_availability_and_ranges(spark):
    docs = spark.createDataFrame([("a", "http://www.X.org/f?q=1")], "sha256 string, url string")
    seen = spark.createDataFrame([("a", "https://x.org/f", day(3)), ("a", "https://x.org/f#z", day(1)), ("b", "https://x.org/f", day(0))], "sha256 string, url string, captured_at date")
    assert asof.first_availability(docs, seen).first().first_seen == day(1)
    rows = spark.createDataFrame([([0.0, 0.0], 0.0, 0.0), ([1.0, 0.0, 3.0], 1.0, 3.0), ([1.0], 1.0, 2.0)], "prices array<double>, low double, high double")
    assert [r.state for r in asof.range_check(rows).collect()] == ["missing", "ok", "range"]
    prices = spark.createDataFrame([("$1.234",), ("NA",), ("1.2",)], "t string").select(asof.reviewed_price("t").cast("string"))
    assert [r[0] for r in prices.collect()] == ["1.234", None, None]


def test_publication_time(spark):
    tag = '<p><meta name="x" property="article:published_time" content="{}"></p>'
    rows = [
        ("2024-03-01T10:00:00+08:00", tag.format("2020-01-01"), "u"), ("2024-03-01", None, "u"), ("2024-03-01T10:00:00", None, "u"), (None, None, "https://a/2024/5/06/x"), ("soon", tag.format("2024-02-02 10:00:00Z"), "u"),
        (None, "<meta content='2024-02-03' property='article:published_time'>", "u"), (None, '{"datePublished": "2024-02-04T01:00:00+00:00"}', "https://a/2024/05/06/x"), (None, "<p>none</p>", "https://a/2024/13/40/x"),
    ]
    at, d, source = news.publication(F.col("m"), F.col("h"), F.col("u"))
    out = spark.createDataFrame(rows, "m string, h string, u string").select(at.isNotNull(), d, source).collect()
    assert [r[0] for r in out] == [True, False, False, False, True, False, True, False]
    assert [r[1] for r in out] == [dt.date(2024, 3, 1)] * 3 + [dt.date(2024, 5, 6), dt.date(2024, 2, 2), dt.date(2024, 2, 3), dt.date(2024, 2, 4), None]
    assert [r[2] for r in out] == ["crawler_metadata"] * 3 + ["url_date", "article_published_meta", "article_published_meta", "json_ld_date_published", "unknown"]


def test_body_and_json_products(spark):
    long = "words " * 50
    rows = [(f"head\nPublished March 3, 2024 02:00 PM\n## Rice **up** [here](http://x) now {long}\nRead More\nfoot", '["Rice", "rice ", "Fish"]'), ("Published March 3, 2024\ntoo short", "a"), (f"bare {long}", None), (None, None)]
    out = spark.createDataFrame(rows, "t string, p string").select(news.clean_body(F.col("t")).alias("t"), news.products_of(F.col("p")).alias("p")).collect()
    assert out[0].t == f"Rice up here now {long}".strip() and out[0].p == ["rice", "fish"]
    assert [r.t for r in out[1:]] == [None, f"bare {long}".strip(), None]


def test_monthly_changes_need_the_month_before(spark):
    rows = [("a", dt.date(2024, 1, 3), dt.date(2024, 2, 5), 100.0), ("a", dt.date(2024, 2, 9), dt.date(2024, 3, 5), 110.0), ("a", dt.date(2024, 2, 9), dt.date(2024, 3, 9), 999.0), ("a", dt.date(2024, 4, 1), dt.date(2024, 5, 1), 120.0), ("b", dt.date(2024, 2, 1), dt.date(2024, 3, 1), 5.0)]
    out = asof.monthly_changes(spark.createDataFrame(rows, "k string, period date, available_at date, value double"), ["k"]).collect()
    assert [(r.k, r.period, r.available_at, round(r.value, 9)) for r in out] == [("a", dt.date(2024, 2, 29), dt.date(2024, 3, 5), 0.1)]


def run_states(spark, tmp_path, batches, name):
    """The next rows after each batch has been streamed in turn."""
    schema = "series string, report_date date, observed_price double"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.next_rows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.schema(state.SCHEMA).parquet(str(tmp_path / "out"))


def test_next_rows_equal_the_batch_features(spark, tmp_path):
    """Gaps inside and across batches, shorter and longer than a price is carried; a first day without a price; late rows."""
    rnd = random.Random(3)
    days = {"Rice||s": [k for k in range(90) if rnd.random() < 0.7 and not 40 <= k < 55], "Rice||t": [*range(0, 20), 60, 61, 75], "Rice||u": [5]}
    rows = [(s, day(k), None if (s, k) in (("Rice||s", days["Rice||s"][0]), ("Rice||t", 3)) else round(50 + rnd.uniform(-5, 5), 2)) for s, ks in days.items() for k in ks]
    of = lambda lo, hi: [r for r in rows if day(lo) <= r[1] < day(hi)]
    late = [("Rice||s", day(2), 999.0), ("Rice||t", day(19), 999.0)]
    got = run_states(spark, tmp_path, [of(0, 30), of(30, 61) + late, of(61, 90)], "next")
    dense = panel.reindex_daily(spark.createDataFrame(rows, "series string, report_date date, observed_price double")).cache()
    batch = features.observation_history(features.rsi(features.price_windows(dense))).join(features.macd(dense), ["series", "report_date"])
    ends = dense.groupBy("series").agg(F.min("report_date").alias("lo"), F.max("report_date").alias("hi"))
    found = backtest.parity(batch.join(ends, "series").where("report_date > lo"), got.join(ends, "series").where("report_date <= hi"), ["series", "report_date"], state.COLUMNS).first()
    assert found.batch == found.incremental > 150 and found.unmatched == found.differing == 0
    assert got.count() == got.select("series", "report_date").distinct().count()


def test_timers_fill_days_that_the_watermark_has_passed(spark, tmp_path):
    got = run_states(spark, tmp_path, [[("a", day(0), 5.0), ("b", day(0), 7.0)], [("a", day(4), 6.0)], [("a", day(30), 6.0)]], "timers")
    rows = {r.report_date: r for r in got.where("series = 'b'").collect()}
    # a price is carried for seven days; then the series waits for its next price
    assert max(rows) == day(8) and sorted(rows) == [day(k) for k in range(1, 9)]
    assert rows[day(8)].lag_1 == 7.0 and rows[day(8)].observed_age == 8 and rows[day(8)].observed_7 == 0
    assert got.where("series = 'a'").count() == 31

def test_price_ingestion(spark, tmp_path):
    names = [c.split()[0] for c in store.PRICE_SCHEMA.split(", ")]
    row = lambda i, variant, on, price: dict.fromkeys(names) | {"id": str(i), "product_name": "A", "product_variant": variant, "origin": "Local", "report_date": on, "price_index": price}
    first = [row(1, "null", D, 1.0), row(2, "Standard", D, 2.0), row(3, "Standard", dt.date(2024, 3, 1), 3.0)]
    second = [row(4, None, D, 7.0), row(5, "Standard", dt.date(2024, 2, 1), 5.0)]
    root = str(tmp_path / "store")
    assert streams.stored_prices(spark, root) is None
    for rows in (first, second):
        spark.createDataFrame([tuple(r[n] for n in names) for r in rows], store.PRICE_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(store.PRICE_SCHEMA).parquet(str(tmp_path / "in"))
        streams.ingest_prices(stream, root, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    found = {(r.report_date, r.product_variant): r.price_index for r in streams.stored_prices(spark, root).collect()}
    assert found == {(D, "Standard"): 7.0, (dt.date(2024, 2, 1), "Standard"): 5.0, (dt.date(2024, 3, 1), "Standard"): 3.0}
    newest, first = streams.manifest(spark, root), json.loads(store.read_entry(spark, f"{root}/manifest/{store.numbered(0)}"))
    untouched = {m for m, e in newest["months"].items() if e == first["months"].get(m)}
    assert newest["number"] == 1 and set(newest["months"]) == {"2024-01", "2024-02", "2024-03"} and untouched == {"2024-03"}  # a month that the second batch did not touch stays where it is


def test_distinct_articles(spark, tmp_path):
    spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 2)), ("b", dt.datetime(2024, 1, 1))], "content string, created_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("content string, created_at timestamp").parquet(str(tmp_path / "in"))
    streams.distinct_articles(stream).writeStream.format("memory").queryName("articles_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    assert sorted(r.content for r in spark.table("articles_out").collect()) == ["a", "b"]


def prices(spark, *rows):
    kinds = [c.split()[0] for c in store.PRICE_SCHEMA.split(", ")]
    full = [{"id": i, "product_name": n, "product_variant": "Standard", "origin": "Local", "product_category": "Rice", "unit": "kg", "price_index": p, "report_date": d, "source_pdf": "x"} for i, n, d, p in rows]
    return spark.createDataFrame([tuple(r[k] for k in kinds) for r in full], store.PRICE_SCHEMA)


def test_of_two_writers_one_wins_and_the_other_merges_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    assert streams.merge_prices(prices(spark, ("1", "A", day(0), 1.0)), root, "first") == 1
    commit, met = store.create_once, []

    def late(spark_, path, text):
        if not met:  # another writer is done between this one's reading and its commit
            met.append(path)
            monkeypatch.setattr(store, "create_once", commit)
            assert streams.merge_prices(prices(spark, ("2", "B", day(1), 2.0), ("3", "A", day(0), 9.0)), root, "other") == 1
        return commit(spark_, path, text)

    monkeypatch.setattr(store, "create_once", late)
    assert streams.merge_prices(prices(spark, ("4", "C", day(2), 3.0)), root, "mine") == 2
    assert sorted((r.product_name, r.price_index) for r in streams.stored_prices(spark, root).collect()) == [("A", 9.0), ("B", 2.0), ("C", 3.0)]
    assert streams.merge_prices(prices(spark, ("4", "C", day(2), 4.0)), root, "mine") == 0  # a repeated batch
    assert streams.manifest(spark, root)["number"] == 2


def test_entries_are_made_once(spark, tmp_path):
    path = str(tmp_path / "e" / "one.json")
    assert store.create_once(spark, path, "é") and not store.create_once(spark, path, "other")
    assert store.read_entry(spark, path) == "é" and store.entries(spark, str(tmp_path / "e")) == ["one.json"]


def test_of_two_publications_of_a_run_one_fails(spark, tmp_path, monkeypatch):
    root, rows = str(tmp_path / "v"), spark.createDataFrame([("p", D, "daily", 1.0)], "product_id string, date date, grain string, price double")
    commit, met = store.create_once, []

    def late(spark_, path, text):
        if not met:
            met.append(path)
            store.publish(spark, rows.withColumn("price", F.lit(2.0)), root, "r", 1)
        return commit(spark_, path, text)

    monkeypatch.setattr(store, "create_once", late)
    try:
        store.publish(spark, rows, root, "r", 1)
        raise AssertionError("published twice")
    except ValueError:
        pass
    assert [e["run_id"] for e in store.published_runs(spark, root)] == ["r"] and store.published_daily(spark, root).first().price == 2.0


def test_view_differences(spark):
    kinds = "product string, date date, price double"
    run = [("a", day(0), 1.0), ("a", day(1), 2.0), ("b", day(0), None), ("b", day(1), 3.0), ("c", day(0), 4.0), ("c", day(0), 4.0)]
    view = [("a", day(0), 1.0), ("a", day(1), 2.5), ("b", day(0), None), ("b", day(0), None), ("c", day(0), 4.0), ("d", day(0), 1.0), (None, day(0), 1.0)]
    found = store.view_differences(spark.createDataFrame(run, kinds), spark.createDataFrame(view, kinds), ["product", "date"], ["price"]).first()
    assert found.asDict() == {"run_rows": 6, "view_rows": 7, "missing": 2, "doubled": 1, "foreign": 2, "changed": 1}
    assert store.view_differences(spark.createDataFrame(run, kinds), spark.createDataFrame(run[::-1], kinds), ["product", "date"], ["price"]).first()[2:] == (0, 0, 0, 0)
    assert store.view_differences(spark.createDataFrame([], kinds), spark.createDataFrame([], kinds), ["product", "date"], ["price"]).first().run_rows == 0


def test_bounded_reads_open_the_months_of_their_bounds(spark, tmp_path):
    root = str(tmp_path / "months")
    store.write_by_month(spark.createDataFrame([(k, day(k * 7)) for k in range(60)], "k int, report_date date"), root)
    bound = lambda k: spark.createDataFrame([(day(k),)], "day date")
    read = store.read_months(spark, root, bound(100), bound(150), "k int, report_date date")
    assert sorted(r.k for r in read.collect()) == [k for k in range(60) if 100 < 7 * k <= 150]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "(month" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert {r.f.split("month=")[1][:7] for r in read.select(F.input_file_name().alias("f")).collect()} == {"2024-04", "2024-05"}
    open_end = store.read_months(spark, root, None, spark.createDataFrame([], "day date"), "k int, report_date date")
    assert open_end.count() == 60


def test_models_are_saved_by_version(spark, tmp_path):
    root = str(tmp_path / "models")
    versions = [store.save_model(spark, root, ["a", "b"], backtest.Linear([k, 0.5], 0.25)) for k in (1.0, 2.0)]
    assert versions == [0, 1] and store.read_model(spark, root, 0) == ({"a": 1.0, "b": 0.5}, 0.25) and store.read_model(spark, root, 1)[0]["a"] == 2.0
