"""Joins with a contract: pairs, checked one-to-one joins, memberships, pending work, annotation merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reply_pairs(messages: DataFrame, brand: str) -> DataFrame:
    """Each reply of the brand with the customer's message that it answers."""
    m = messages.select("tweet_id", "author_id", "inbound", "created_at", "text", "in_response_to_tweet_id")
    reply = m.where(~F.col("inbound") & (F.col("author_id") == brand)).select(F.col("tweet_id").alias("reply_id"), F.col("text").alias("reply_text"), F.col("created_at").alias("reply_at"), F.col("in_response_to_tweet_id").alias("customer_id"))
    asked = m.where(F.col("inbound") & (F.col("author_id") != brand)).select(F.col("tweet_id").alias("customer_id"), F.col("author_id").alias("customer_author"), F.col("text").alias("customer_text"), F.col("created_at").alias("customer_at"))
    return reply.join(asked, "customer_id")


def lookup(rows: DataFrame, table: DataFrame, on: str, key: str, how: str = "inner") -> DataFrame:
    """Rows of ``table`` whose ``key`` equals ``on``: by id, or by parent for the replies to it."""
    return rows.join(table, rows[on] == table[key], how)


def join_violations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, problem) where the two sides are not one to one: duplicate or unmatched."""
    count = lambda d, n: d.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    both = count(left, "l").join(count(right, "r"), key, "full_outer")
    problem = F.when(F.col("l").isNull(), "missing_left").when(F.col("r").isNull(), "missing_right").when(F.col("l") > 1, "duplicate_left").when(F.col("r") > 1, "duplicate_right")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def unblind(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``mapping``; rows that it lacks stay, with nulls. A key that it has twice fails the job."""
    twice = F.raise_error(F.concat(F.lit("mapped twice: "), F.col(key).cast("string")))
    one = mapping.groupBy(key).agg(*[F.first(c).alias(c) for c in mapping.columns if c != key], F.count(F.lit(1)).alias("_n"))
    first = next(c for c in mapping.columns if c != key)
    checked = one.withColumn(first, F.when(F.col("_n") > 1, twice.cast(mapping.schema[first].dataType)).otherwise(F.col(first))).drop("_n")
    return rows.join(checked, key, "left")


def checked_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails with the number of violations if the sides are not one to one."""
    bad = join_violations(left, right, key).count()
    if bad:
        raise ValueError(f"{bad} keys are duplicated or unmatched")
    return left.join(right, key)


def membership(rows: DataFrame, restricted: DataFrame, on: str, key: str, name: str = "restricted") -> DataFrame:
    """``rows`` with a boolean: whether ``on`` is among the keys of ``restricted``."""
    keys = restricted.select(F.col(key).alias("_member")).where("_member is not null").distinct()
    return rows.join(keys, rows[on] == keys["_member"], "left").withColumn(name, F.col("_member").isNotNull()).drop("_member")


def pending(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def by_priority(rows: DataFrame, first: DataFrame, key: list[str], then: list[str | Column]) -> DataFrame:
    """Rows whose key is in ``first`` come before the others."""
    flag = first.select(*key).distinct().withColumn("_first", F.lit(1))
    return rows.join(flag, key, "left").orderBy(F.col("_first").desc_nulls_last(), *then).withColumn("prioritised", F.col("_first").isNotNull()).drop("_first")


def merge_annotations(rows: DataFrame, notes: DataFrame, stable: str, legacy: str, human: list[str], overwrite: bool = False) -> DataFrame:
    """``rows`` with human columns kept from ``notes``: by the stable key, else by the legacy one, else blank.

    Rows of ``notes`` without any entry are no annotations; of several for a key the smallest counts.
    """
    if overwrite:
        return rows.select("*", *[F.lit("").alias(h) for h in human])
    filled = notes.where(F.concat_ws("", *[F.trim(F.coalesce(F.col(h), F.lit(""))) for h in human]) != "")
    out = rows
    for k, tag in ((stable, "s"), (legacy, "l")):
        one = filled.where(F.col(k).isNotNull() & (F.col(k) != "")).groupBy(k).agg(F.min(F.struct(*human)).alias(f"_{tag}"))
        out = out.join(one, k, "left")
    return out.select(*rows.columns, *[F.coalesce(F.when(F.col("_s").isNotNull(), F.col("_s")[h]), F.col("_l")[h], F.lit("")).alias(h) for h in human])


def differing(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column) where two sources of the same rows disagree or one lacks the row."""
    a = left.select(key, F.struct(*columns).alias("_a"))
    b = right.select(key, F.struct(*columns).alias("_b"))
    both = a.join(b, key, "full_outer")
    wrong = F.array_compact(F.array(*[F.when(~F.col("_a")[c].eqNullSafe(F.col("_b")[c]), F.lit(c)) for c in columns]))
    row = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.array(F.lit("(row)"))).otherwise(wrong)
    return both.select(key, F.explode(row).alias("column"))


def evidence_text(rows: DataFrame, predictions: DataFrame, key: str, ids: str, name: str = "evidence") -> DataFrame:
    """``rows`` with the ids that their prediction cites, comma-joined, or "(none)"."""
    p = predictions.select(key, F.array_join(ids, ", ").alias(name))
    return rows.join(p, key, "left").withColumn(name, F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("(none)")))
