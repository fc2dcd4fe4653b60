"""Structured Streaming forms of the incremental operations."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .store import PRICE_SCHEMA, upsert_prices


def daily_views(events: DataFrame, late: str = "2 days") -> DataFrame:
    """ST1: views per product and day; events within the watermark still count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "product_id").agg(F.count("*").alias("views")).select(F.to_date("w.start").alias("day"), "product_id", "views")


def stored_prices(spark: SparkSession, root: str) -> DataFrame | None:
    """ST2: the prices that the newest version under ``root`` names; None before the first."""
    newest = manifest(spark, root)
    if not newest:
        return None
    return spark.read.schema(PRICE_SCHEMA).parquet(*[f"{root}/data/{e['folder']}/month={m}" for m, e in newest["months"].items()])


def manifest(spark: SparkSession, root: str) -> dict | None:
    """ST2: the newest version: its number, and for every month the folder that holds it and the batch that wrote it; a row per month."""
    names = store.entries(spark, f"{root}/manifest")
    return json.loads(store.read_entry(spark, f"{root}/manifest/{names[-1]}")) if names else None


def merge_prices(batch: DataFrame, root: str, name: str) -> int:
    """ST2: merge a batch by key into the months that it touches, as a new version; the number of times it was merged (0: it was there already).

    The months go to a folder of the try's own; then the version's file is made, which only one writer can
    do. A writer that comes second merges again into what the first one left.
    """
    spark = batch.sparkSession
    batch = batch.withColumn("month", F.date_format("report_date", "yyyy-MM")).persist()
    touched = [r["month"] for r in batch.select("month").distinct().collect()]
    tries = 0
    while touched:
        known = manifest(spark, root) or {"number": -1, "months": {}}
        if any(e["batch"] == name for e in known["months"].values()) or name in known.get("batches", []):
            break
        tries += 1
        old = [f"{root}/data/{known['months'][m]['folder']}/month={m}" for m in touched if m in known["months"]]
        rows = batch.drop("month")
        stored = spark.read.schema(PRICE_SCHEMA).parquet(*old) if old else rows.limit(0)
        folder = uuid.uuid4().hex
        merged = upsert_prices(stored, rows).withColumn("month", F.date_format("report_date", "yyyy-MM"))
        merged.repartition("month").write.partitionBy("month").parquet(f"{root}/data/{folder}")
        months = known["months"] | {m: {"folder": folder, "batch": name} for m in touched}
        number = known["number"] + 1
        # the last batches by name: one that a later one has written over altogether must be known too
        batches = [*known.get("batches", []), name][-1000:]
        if store.create_once(spark, f"{root}/manifest/{store.numbered(number)}", json.dumps({"number": number, "months": months, "batches": batches})):
            break
    batch.unpersist()
    return tries


def ingest_prices(batches: DataFrame, root: str, checkpoint: str):
    """ST2: each micro-batch is merged by key into the months that it touches, and these months alone are written anew.

    A version is a file under ``manifest`` that names, for every month, the folder that holds it. Readers
    take the newest, so a version that was not finished is never seen; a repeated batch finds its own
    name and does nothing; several streams may write to one ``root``.
    """
    return batches.writeStream.foreachBatch(lambda batch, number: merge_prices(batch, root, f"{checkpoint}#{number}")).option("checkpointLocation", checkpoint)


def distinct_articles(articles: DataFrame, late: str = "7 days") -> DataFrame:
    """ST3"""
    return articles.withColumn("content_hash", F.sha2("content", 256)).withWatermark("created_at", late).dropDuplicatesWithinWatermark(["content_hash"])


def news_volume(articles: DataFrame, size: str = "7 days", late: str = "3 days") -> DataFrame:
    """ST5: articles per product in sliding windows of a day's step."""
    return articles.withWatermark("created_at", late).groupBy(F.window("created_at", size, "1 day").alias("w"), "product").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("from_day"), F.to_date("w.end").alias("to_day"), "product", "n")
