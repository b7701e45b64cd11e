"""Set operations on ids: manifest differences, exclusion unions, overlaps of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_diff(old: DataFrame, new: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, status): shared, added or removed."""
    a = old.select(group, key).distinct().withColumn("_a", F.lit(1))
    b = new.select(group, key).distinct().withColumn("_b", F.lit(1))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("shared")
    return a.join(b, [group, key], "full_outer").select(group, key, status.alias("status"))


def union_sources(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, source) of all sources."""
    out = None
    for name, df in sources.items():
        part = df.select(F.col(key).cast("string").alias(key)).where(f"{key} is not null").distinct().withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def contributions(union: DataFrame, key: str) -> DataFrame:
    """Ids of each source, and those that it alone has."""
    count = union.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min("source").alias("_one"))
    return union.join(count, key).groupBy("source").agg(F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("_n") == 1).alias("n_alone"))


def overlaps(rows: DataFrame, key: str, partition: str) -> DataFrame:
    """Keys that stand in more than one partition."""
    return rows.groupBy(key).agg(F.countDistinct(partition).alias("n_partitions"), F.array_join(F.sort_array(F.collect_set(partition)), ",").alias("partitions")).where("n_partitions > 1")
