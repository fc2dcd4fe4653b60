"""What the queries of many series put on disk: rows that are shuffled, and shuffle files that stay."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from pricepanel.operators import backtest, calibrate, panel
from pricepanel.plans import base

DAY = dt.date(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_paths_shuffle_a_row_per_origin(spark):
    """The days of a path are made after its join with the truth; each observed day keeps its truth, given twice or at two origins too."""
    rnd = random.Random(3)
    anchors = [(f"s{s}", "Rice", f"S{s}", DAY + dt.timedelta(days=o), 5.0 + s, 6.0, [1.0 * k for k in range(1, 2 + (s + o) % 7)]) for s in range(4) for o in (0, 7, 40) if s or o]
    prices = [(f"s{s}", DAY + dt.timedelta(days=d), None if d % 5 == 0 else float(d)) for s in range(3) for d in rnd.sample(range(-3, 80), 40)] + [("s1", DAY + dt.timedelta(days=9), 1.5)] * 2
    a = spark.createDataFrame(anchors, "series string, product_category string, product_name string, origin date, anchor double, moving_average7 double, last_prices array<double>")
    p = spark.createDataFrame(prices, "series string, report_date date, observed_price double")
    got = backtest.paths(a, p, horizon=12)
    expected = []
    for series, _, _, origin, anchor, _, last in anchors:
        for h in range(1, 13):
            seen = [v for s, d, v in prices if s == series and d == origin + dt.timedelta(days=h) and v is not None]
            expected += [(series, origin, h, origin + dt.timedelta(days=h), anchor, last[(h - 1) % len(last)], v) for v in seen or [None]]
    columns = ["series", "origin", "horizon", "date", "persistence", "seasonal7", "actual"]
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, expected)) and len(expected) > 12 * len(anchors)
    left = plan_of(got).split("LeftOuter", 1)
    assert "inline" in left[0] and "explode" not in left[1].split("LogicalRDD", 1)[0]
    assert backtest.folded_paths(a, p, horizon=12).count() == len(anchors)


def test_anchors_sort_no_days(spark):
    """The anchors of the given prices are those of the panel, of which no day is made or sorted."""
    rnd = random.Random(8)
    rows = [("Rice||0||x", DAY, None), ("Rice||0||x", None, 4.0), ("Rice||0||x", DAY + dt.timedelta(days=90), None)]
    for s, share, days in ((1, 0.9, 60), (2, 0.3, 25), (3, 0.6, 90), (4, 0.1, 12), (5, 1.0, 1)):
        rows += [(f"Rice||{s}||x", DAY + dt.timedelta(days=d), rnd.uniform(1, 99) if rnd.random() < share else None) for d in sorted(rnd.sample(range(90), days))]
    prices = spark.createDataFrame(rows, "series string, report_date date, observed_price double").repartition(3)
    days = spark.range(92).select(F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("origin"))
    got = backtest.anchors_of_prices(prices, days)
    expected = backtest.anchors(panel.reindex_daily(prices), days)
    assert got.columns == expected.columns and sorted(map(str, got.collect())) == sorted(map(str, expected.collect())) and got.count() > 150
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan.split("BroadcastExchange")[0] and plan.split("== Initial")[0].count("Sort [series") == 1


def test_specialists_shuffle_rows_and_no_candidates(spark):
    schema = "product_category string, product_name string, origin date, horizon int, actual double, f double, u double, v double"
    rows = spark.createDataFrame([("Rice", None, DAY + dt.timedelta(days=o), h, 10.0, 12.0, 9.0, 10.5) for o in range(8) for h in range(1, 31)], schema)
    rows = rows.unionByName(rows.withColumn("product_name", F.lit("A")))
    got = calibrate.specialists(rows, "f", ["u", "v"])
    assert {(r.product_name, r.alternative, r.weight) for r in got.collect()} == {("A", "u", 0.5)} and got.count() == 3  # up to 4 days by 4 origins are too few
    plan = plan_of(got)
    assert " Join LeftOuter" not in plan and plan.count("Join") == 1  # the one row that cuts the origins
    assert plan.index("Generate explode") < plan.index("RepartitionByExpression") and plan.count("Generate") == plan[: plan.index("RepartitionByExpression")].count("Generate")


@pytest.mark.parametrize("missing", [None, 1])
def test_first_line_of_a_supplier_and_day(spark, tmp_path, missing):
    """Lines move once as they are, and of a supplier's day the first with a part stands."""
    t = dt.datetime(2024, 1, 1)
    lines = [(o, n, p, s, 0.05 * (o % 3), "N", "O" if o % 2 else "F", t + dt.timedelta(days=o % 2)) for o in range(1, 9) for n, p, s in ((2, 1, 1), (1, 2, 1), (1, 1, 1), (3, 2, 2))]
    parts = [(p, "PROMO", 100.0 + p) for p in (1, 2) if p != missing]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    df = base.many_prices(spark, str(tmp_path))
    known = {p: v for p, _, v in parts}
    expected = {}
    for o, n, p, s, d, _, status, at in sorted(lines):
        if p in known:
            expected.setdefault((f"S{s}", at.date()), (round(known[p] * (1 - d), 4), status == "O", o * 10 + n))
    got = {(r.product_name, r.report_date): (round(r.price_index, 4), r.is_observed, r.id) for r in df.collect()}
    assert got == expected and len(got) == 4
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("REPARTITION" if "REPARTITION" in plan else "Exchange") > plan.rindex("Aggregate")


def test_written_leaves_no_shuffle_files(spark):
    jvm = spark.sparkContext._jvm
    kept = lambda: jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())
    files = lambda: {f.getName() for f in kept() if f.getName().startswith("shuffle_")}
    before, setting = files(), spark.conf.get(base.DROP_SHUFFLES)
    rows = base.written(spark.range(20000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "few")
    until = time.time() + 20
    while files() - before and time.time() < until:  # they go in the background
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(base.DROP_SHUFFLES) == setting
    assert rows.count() == 7 and rows.agg(F.sum("count")).first()[0] == 20000
