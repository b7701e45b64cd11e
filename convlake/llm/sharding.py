"""Rendezvous hashing of stable record keys over weighted shards; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, text_key

#: A 53-bit hash as a number in (0, 1).
_UNIT = float(1 << 53)


def rendezvous(key: Column, shards: int, weights: list[float] | None = None) -> Column:
    """The shard of a key: the one with the largest score, ``weight / -ln(u)`` for a uniform hash ``u`` of (key, shard).

    Only the key, the shards' numbers and their weights decide. With one more shard a key moves only
    if the new shard has the largest score, so rows go only into it. A shard of weight 0 gets nothing.
    Equal scores, which need equal 53-bit hashes, fall to the larger shard number. A null key is a key of its own.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    weights = weights or [1.0] * shards
    if len(weights) != shards or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("one weight of 0 or more for each shard, and one above 0, is needed")
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))

    def score(shard: int) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(text, F.lit(shard)), 11).cast("double") + 0.5) / _UNIT
        return F.struct((-F.lit(float(weights[shard])) / F.ln(unit)).alias("score"), F.lit(shard).alias("shard"))

    return F.array_max(F.array(*[score(s) for s in range(shards) if weights[s] > 0])).getField("shard")


def gapless(df: DataFrame, group: str, spread: list[str], order: list[str], out: str, buckets: int | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps, without bringing a group into one task.

    Rows go into ``buckets`` hash buckets of their ``spread`` columns, by default four for each shuffle partition and
    256 at least; each (group, bucket) is numbered by itself and shifted by the rows in the buckets before it. The shifts
    are groups x buckets rows. Rows equal in ``order`` are numbered arbitrarily among themselves.
    """
    buckets = buckets or max(256, 4 * partitions(df.sparkSession))
    return numbered(df.withColumn("_gap_hash", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int")), group, "_gap_hash", order, out).drop("_gap_hash")


def numbered(df: DataFrame, group: str, bucket: str, order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 0 by ``bucket``, then ``order``; only a bucket of a group has to fit one task."""
    df = df.withColumn("_gap_bucket", F.col(bucket)).withColumn("_gap_group", F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("null")))
    sizes = df.groupBy("_gap_group", "_gap_bucket").agg(F.count(F.lit(1)).alias("_gap_n"))
    before = W.partitionBy("_gap_group").orderBy("_gap_bucket").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select("_gap_group", "_gap_bucket", F.coalesce(F.sum("_gap_n").over(before), F.lit(0)).alias("_gap_before"))
    rank = F.row_number().over(W.partitionBy("_gap_group", "_gap_bucket").orderBy(*order))
    return df.withColumn("_gap_rank", rank).join(shifts, ["_gap_group", "_gap_bucket"]).withColumn(out, (F.col("_gap_before") + F.col("_gap_rank") - 1).cast("long")).drop("_gap_rank", "_gap_before", "_gap_bucket", "_gap_group")


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", weights: list[float] | None = None, buckets: int | None = None, keep: bool = False, order: DataFrame | None = None) -> DataFrame:
    """One row per document: its shard, its slot there, and its shard if there were one more of average weight.

    With ``keep`` all columns of ``docs`` go along, those whose names clash giving way to the new ones. With ``order``,
    (key, text_key, position), slots follow the positions, and those of one key and text are shared out among its rows.

    ``size`` is the UTF-8 bytes of the text plus 8; a null text counts as empty, its CRC is 0. Only the key, the
    size and digests of the text are shuffled, never the text (unless it is kept). Equal keys share a shard. An empty table gives no
    rows; without ``keep`` columns beyond the two named ones are ignored.
    """
    weights = weights or [1.0] * shards
    grown = [*weights, sum(weights) / len(weights)]
    new = ("doc_id", "size", "text_crc32", "law", "shard", "grown_shard")
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    kept = [c for c in docs.columns if keep and c not in (*new, "slot")]
    rows = docs.select(
        F.struct(*([F.col(c) for c in kept] or [F.lit(0).alias("none")])).alias("row"),
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), shards, weights).cast("int").alias("shard"),
        rendezvous(F.col(key), shards + 1, grown).cast("int").alias("grown_shard"),
        *([text_key(F.col(text)).alias("text_key")] if order is not None else []),
    )
    out = [*[f"row.{c}" for c in kept], *new, "slot"]
    if order is None:
        return gapless(rows, "shard", ["doc_id", "text_crc32", "size"], ["doc_id", "text_crc32", "size"], "slot", buckets).select(*out)
    buckets = buckets or max(256, 4 * partitions(docs.sparkSession))
    # Slots are found without the texts; these are shuffled once, to their slots.
    rows = nth(rows.withColumn("key", plain_key(F.col("doc_id"))), "shard")
    places = nth(order.select(plain_key(F.col("key")).alias("key"), "text_key", "position"), "position")
    narrow = nth_join(rows.select("key", "text_key", "nth", "shard"), places)
    # Rows without a position come last. Runs of positions are the buckets, so that no task has to order a whole shard.
    last = order.agg(F.max("position").alias("last"))
    run = F.coalesce(F.floor(F.col("position") * buckets / (F.col("last") + 1)), F.lit(buckets)).cast("int")
    slots = numbered(narrow.crossJoin(F.broadcast(last)).withColumn("run", run), "shard", "run", ["position", "key", "text_key", "nth"], "slot")
    return nth_join(rows, slots.select("key", "text_key", "nth", "slot")).select(*out)


def plain_key(key: Column) -> Column:
    """A key without nulls."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))


def nth(df: DataFrame, order: str) -> DataFrame:
    """Number the rows that agree in ``key`` and ``text_key``."""
    return df.withColumn("nth", F.row_number().over(W.partitionBy("key", "text_key").orderBy(order)))


def nth_join(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Left join of rows numbered by ``nth``, dealt as they were to be numbered: a difference is no equation to deal them anew by."""
    o = other.withColumnRenamed("nth", "_nth").withColumnRenamed("key", "_key").withColumnRenamed("text_key", "_text")
    return rows.join(o, (rows["key"] == o["_key"]) & (rows["text_key"] == o["_text"]) & (rows["nth"] - o["_nth"] == 0), "left").drop("_nth", "_key", "_text")
