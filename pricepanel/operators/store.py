"""Sources and sinks: snapshots, keyed upserts, immutable vintages."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE_SCHEMA = "id string, product_category string, product_name string, product_variant string, unit string, origin string, price_index double, report_date date, source_pdf string"


def read_snapshot(spark: SparkSession, path: str, through: str | None = None) -> DataFrame:
    """IO1: a CSV or JSON snapshot; JSON may be a list or wrapped in ``rows`` or ``data``; ``through`` is inclusive."""
    if path.endswith(".csv"):
        rows = spark.read.schema(PRICE_SCHEMA).option("header", True).csv(path)
    else:
        wrapped = f"{PRICE_SCHEMA}, rows array<struct<{PRICE_SCHEMA.replace(' ', ':').replace(',:', ',')}>>, data array<struct<{PRICE_SCHEMA.replace(' ', ':').replace(',:', ',')}>>"
        read = spark.read.schema(wrapped).option("multiLine", True).json(path)
        own = [c.split()[0] for c in PRICE_SCHEMA.split(", ")]
        inner = F.coalesce("rows", "data", F.array(F.struct(*own)))
        rows = read.select(F.explode(inner).alias("r")).select("r.*")
    return rows if through is None else rows.where(F.col("report_date") <= F.lit(through).cast("date"))


def bounded(rows: DataFrame, since: str | None, through: str) -> DataFrame:
    """IO2: inclusive bounds, strict dates, since <= through."""
    for day in filter(None, (since, through)):
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
            raise ValueError(f"not a date: {day}")
    if since and since > through:
        raise ValueError("since is after through")
    out = rows.where(F.col("report_date") <= F.lit(through).cast("date"))
    return out.where(F.col("report_date") >= F.lit(since).cast("date")) if since else out


def latest_day(rows: DataFrame) -> DataFrame:
    """IO3"""
    return rows.agg(F.max("report_date").alias("latest"))


def history(rows: DataFrame, name: str, variant: str | None, origin: str, category: str, limit: int) -> DataFrame:
    """IO3: a product's newest rows; a null variant matches null only."""
    own = (F.col("product_name") == name) & F.col("product_variant").eqNullSafe(F.lit(variant)) & (F.col("origin") == origin) & (F.col("product_category") == category)
    return rows.where(own).orderBy(F.desc("report_date"), "id").limit(limit)


def upsert_prices(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """IO4: variants defaulted, the first row of a key wins within a batch, the batch wins over what is stored."""
    key = ["product_name", "product_variant", "origin", "report_date"]
    variant = F.when(F.coalesce(F.lower(F.trim("product_variant")), F.lit("")).isin("", "null", "none"), "Standard").otherwise(F.col("product_variant"))
    both = stored.withColumn("__src", F.lit(1)).unionByName(batch.withColumn("__src", F.lit(0))).withColumn("product_variant", variant)
    columns = stored.columns
    return both.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct("__src", "id")).alias("r")).select("r.*")


def unprocessed(links: DataFrame, stored: DataFrame) -> DataFrame:
    """IO5"""
    return links.join(stored.select("source_pdf").distinct(), "source_pdf", "left_anti")


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file with ``text`` unless there is one at ``path``; whether it was made. Of several writers one succeeds.

    The text is written aside and moved into place without replacing anything, so a reader sees the
    whole file or none.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(conf)
    aside = jvm.org.apache.hadoop.fs.Path(to.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(aside), fs.makeQualified(to), none)
        return True
    except Py4JJavaError as error:
        fs.delete(aside, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise


def read_entry(spark: SparkSession, path: str) -> str:
    """The text of a file of ``create_once``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def entries(spark: SparkSession, folder: str) -> list[str]:
    """The names of the files of ``create_once`` in a folder, in order."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(n for n in names if not n.startswith((".", "_")))


def numbered(number: int) -> str:
    return f"{number:012d}.json"


def publish(spark: SparkSession, values: DataFrame, root: str, run_id: str, declared: int) -> None:
    """IO6: values into a folder of the try's own, counted, then the run's entry, which can be made once; a listed run never changes.

    A failed publication leaves no entry. Of two writers of one run the first to make the entry wins and
    the other fails, whatever it has written stays unread. Entries are numbered in the order in which
    they were made; the daily view is the last one's daily rows (``published_daily``), so it needs no
    copy that could fall behind.
    """
    if any(e["run_id"] == run_id for e in published_runs(spark, root)):
        raise ValueError(f"{run_id} is published already")
    folder = f"{root}/values/{uuid.uuid4().hex}"
    values.write.parquet(folder)
    n = spark.read.parquet(folder).count()
    if n == 0 or n != declared:
        raise ValueError(f"{n} rows written, {declared} declared")
    while True:
        listed = published_runs(spark, root)
        if any(e["run_id"] == run_id for e in listed):
            raise ValueError(f"{run_id} is published already")
        entry = {"run_id": run_id, "row_count": n, "values": folder}
        if create_once(spark, f"{root}/runs/{numbered(len(listed))}", json.dumps(entry)):
            return


def published_runs(spark: SparkSession, root: str) -> list[dict]:
    """IO6: the entries of all published runs in order: ``run_id``, ``row_count`` and the folder of the values."""
    return [json.loads(read_entry(spark, f"{root}/runs/{name}")) for name in entries(spark, f"{root}/runs")]  # a row per run


def published(spark: SparkSession, entry: dict) -> DataFrame:
    return spark.read.parquet(entry["values"]).withColumn("run_id", F.lit(entry["run_id"]))


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def published_daily(spark: SparkSession, root: str) -> DataFrame:
    """IO6: the daily rows of the newest published run."""
    return published(spark, published_runs(spark, root)[-1]).where("grain = 'daily'")


def view_differences(run: DataFrame, view: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """IO7: how a view departs from the run that it should equal: one row of counts.

    Both are multisets of rows. By ``keys``: ``missing`` rows of the run that the view lacks, ``doubled`` rows
    beyond those of the run, ``foreign`` rows of keys that the run hasn't, ``changed`` rows whose ``values``
    differ; a null equals a null. Rows are counted before they are shuffled, so only different rows meet.
    """
    both = run.select(*keys, *values, F.lit(1).alias("r"), F.lit(0).alias("v")).unionByName(view.select(*keys, *values, F.lit(0).alias("r"), F.lit(1).alias("v")))
    rows = both.groupBy(*keys, *values).agg(F.sum("r").alias("r"), F.sum("v").alias("v"))
    by_key = rows.groupBy(*keys).agg(F.sum("r").alias("r"), F.sum("v").alias("v"), F.sum(F.least("r", "v")).alias("same"))
    known = F.col("r") > 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return by_key.agg(
        total("r").alias("run_rows"), total("v").alias("view_rows"), total(F.when(known, F.greatest(F.col("r") - F.col("v"), F.lit(0)))).alias("missing"),
        total(F.when(known, F.greatest(F.col("v") - F.col("r"), F.lit(0)))).alias("doubled"), total(F.when(~known, F.col("v"))).alias("foreign"),
        total(F.when(known, F.least("r", "v") - F.col("same"))).alias("changed"),
    )


def verify(rows: DataFrame) -> DataFrame:
    """IO7: per run: rows, unique product-days, consecutive days, finite positive prices."""
    per = rows.groupBy("run_id", "product_id").agg(F.count("*").alias("n"), F.count_distinct("date").alias("d"), F.datediff(F.max("date"), F.min("date")).alias("span"), F.bool_and((F.col("price") > 0) & (F.col("price") < float("inf"))).alias("ok"))
    return per.groupBy("run_id").agg(F.sum("n").alias("n"), F.bool_and(F.col("n") == F.col("d")).alias("unique_days"), F.bool_and(F.col("span") == F.col("d") - 1).alias("consecutive"), F.bool_and("ok").alias("positive"))


def upsert_evaluations(stored: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """IO8: the batch replaces rows of its keys and takes back their approval."""
    fresh = batch.withColumn("approved", F.lit(False))
    return stored.join(batch.select(*key).distinct(), key, "left_anti").unionByName(fresh)


def latest_run(runs: DataFrame, values: DataFrame) -> DataFrame:
    """IO9: the values of the newest run; ties go to the larger id."""
    newest = runs.agg(F.max_by("run_id", F.struct("generated_at", "run_id")).alias("run_id"))  # one row
    return values.join(F.broadcast(newest), "run_id")


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """IO10: a digest of a table's content, whatever its order: sums of the two halves of each row's MD5.

    Columns are taken as text, a null as ``\\N``; a row that occurs twice counts twice.
    """
    h = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]))
    half = lambda a: F.sum(F.conv(F.substring(h, a, 15), 16, 10).cast("decimal(38,0)"))
    sums = rows.agg(F.count("*").alias("n"), half(1).alias("a"), half(17).alias("b"))
    text = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(38,0)")).cast("string")
    return sums.select("n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), text("a"), text("b")), 256).alias("sha256"))


def can_share(spark: SparkSession) -> bool:
    """Whether there is a folder that driver and executors share: ``spark.checkpoint.dir`` is set, or all is in one process."""
    master = spark.sparkContext.master
    return bool(spark.sparkContext.getConf().get("spark.checkpoint.dir")) or (master.startswith("local") and not master.startswith("local-cluster"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; a local one in local mode where it is unset."""
    if not can_share(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a table in the shared folder: computed once, and there again when an executor is lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_by_month(rows: DataFrame, root: str) -> None:
    """IO2: prices laid out by month, so that a bounded read opens the months of its bounds alone."""
    months = rows.withColumn("month", F.date_format("report_date", "yyyy-MM"))
    months.repartition("month").write.mode("overwrite").partitionBy("month").parquet(root)


def read_months(spark: SparkSession, root: str, since: DataFrame | None = None, through: DataFrame | None = None, schema: str | None = None) -> DataFrame:
    """IO2: the rows of ``write_by_month`` later than ``since`` and up to ``through``, each a table of one date that is known only when read.

    The bounds (one row each) come to the driver, so both the months and the days within them are filters
    of the scan. A table without a date gives no bound.
    """
    rows = spark.read.schema(f"{PRICE_SCHEMA}, month string" if schema is None else f"{schema}, month string").parquet(root)
    for bound, later in ((since, True), (through, False)):
        day = None if bound is None else bound.first()
        if day is None or day[0] is None:
            continue
        limit, month = F.lit(day[0]), F.lit(day[0].strftime("%Y-%m"))
        rows = rows.where((F.col("month") >= month) & (F.col("report_date") > limit)) if later else rows.where((F.col("month") <= month) & (F.col("report_date") <= limit))
    return rows


def save_model(spark: SparkSession, root: str, columns: list[str], model) -> int:
    """BT5: a fitted linear model under the next free version; of two writers each gets a version of its own."""
    text = json.dumps({"columns": columns, "coefficients": [float(c) for c in model.coefficients], "intercept": float(model.intercept)})
    version = len(entries(spark, root))
    while not create_once(spark, f"{root}/{numbered(version)}", text):
        version += 1
    return version


def read_model(spark: SparkSession, root: str, version: int) -> tuple[dict[str, float], float]:
    """BT5: the weights by column, and the intercept, of a saved version."""
    saved = json.loads(read_entry(spark, f"{root}/{numbered(version)}"))
    return dict(zip(saved["columns"], saved["coefficients"], strict=True)), saved["intercept"]
