"""Scans: message CSV, JSON lines, keyed caches, review sheets, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import present_id, strict_boolean
from ..schemas import JUDGEMENT, MANIFEST, MESSAGES


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the records of CSV files, header included, numbered from 1 in each file.

    Files are read in byte ranges. The parity of quotes tells for each line of a range, counted from the start of the range, whether
    it begins within quotes; sums over the ranges before it, one row each, tell for the range as a whole. So a file of any
    length takes as many tasks as it has ranges, and only lines of one record come together. Quotes have to be
    balanced and doubled inside of quoted fields; a file that ends within quotes fails.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value",
        (F.length("value") - F.length(F.translate("value", '"', ""))).alias("quotes"),
    )
    within = Window.partitionBy("file", "block").orderBy("line")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("odd", F.coalesce(F.sum("quotes").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2)
    blocks = lines.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("flips"), F.count_if(F.col("odd") == 0).alias("n_even"), F.count_if(F.col("odd") == 1).alias("n_odd"))
    blocks = blocks.withColumn("open", F.coalesce(F.sum("flips").over(earlier), F.lit(0)) % 2).withColumn("unclosed", F.sum("flips").over(Window.partitionBy("file")) % 2)
    begun = F.when(F.col("open") == 0, F.col("n_even")).otherwise(F.col("n_odd"))
    failed = F.raise_error(F.concat(F.lit("a quote is not closed in "), F.col("file"))).cast("long")
    blocks = blocks.select("file", "block", "open", F.when(F.col("unclosed") == 1, failed).otherwise(F.coalesce(F.sum(begun).over(earlier), F.lit(0))).alias("begun"))
    begins = F.when(F.col("odd") == F.col("open"), 1).otherwise(0)
    numbered = lines.join(blocks, ["file", "block"]).withColumn("record", F.col("begun") + F.sum(begins).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    text = F.array_join(F.transform(parts, lambda x: x["value"]), "\n")
    return numbered.groupBy("file", "record").agg(F.regexp_replace(text, "\r$", "").alias("text"))


def read_messages_csv(spark: SparkSession, path: str, schema: T.StructType = MESSAGES, by_ranges: bool = True) -> DataFrame:
    """All-text message table; quoted line breaks are kept, a malformed row or a missing column fails.

    Files are read in byte ranges (``csv_records``). For files with single quotes marks inside of unquoted fields take
    ``by_ranges=False``: Spark then parses each file as a whole, in one task.
    """
    options = {"multiLine": True, "escape": '"', "mode": "FAILFAST"}
    head = spark.read.options(header=True, **options).csv(path).columns
    missing = [c for c in schema.names if c not in head]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    own = T.StructType([T.StructField(c, T.StringType()) for c in head])
    if not by_ranges:
        return spark.read.schema(own).options(header=True, **options).csv(path).select(*schema.names)
    rows = csv_records(spark, path).where((F.col("record") > 1) & (F.trim("text") != ""))
    ddl = ", ".join(f"`{c.replace('`', '``')}` string" for c in head)
    return rows.select(F.from_csv("text", ddl, {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).alias("r")).select(*[F.col("r").getField(c).alias(c) for c in schema.names])


def typed_messages(raw: DataFrame) -> DataFrame:
    """Text columns with strict booleans and null for missing ids."""
    return raw.withColumn("inbound", strict_boolean(F.col("inbound"))).withColumn("in_response_to_tweet_id", present_id(F.col("in_response_to_tweet_id")))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Blank lines are skipped; any other that is no JSON object fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_cache(spark: SparkSession, path: str, schema: T.StructType = JUDGEMENT) -> DataFrame:
    """An append-only cache: malformed lines are dropped, the last entry of a key counts."""
    from ..operators.judging import last_entries

    return last_entries(spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of text in which blanks stay blanks."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.na.fill("")


def read_manifest(spark: SparkSession, path: str, brand: str | None = None) -> DataFrame:
    """One row per conversation of a JSON manifest."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path).select("sampling_seed", F.explode("conversations").alias("c")).select("sampling_seed", "c.*")
    return rows.where(F.col("brand") == brand) if brand else rows
