"""Integrity audits: each returns rows (check, key, detail) that break a rule; no rows: passed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import leaks_reply, turn_flags
from ..schemas import FLAGS


def violations(rows: DataFrame, check: str, key: str, wrong: Column, detail: Column | None = None) -> DataFrame:
    return rows.where(wrong).select(F.lit(check).alias("check"), F.col(key).cast("string").alias("key"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unique_key(rows: DataFrame, key: str, check: str = "unique_key") -> DataFrame:
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return union(violations(rows, "key_present", key, F.col(key).isNull()), violations(n, check, key, F.col(key).isNotNull() & (F.col("_n") > 1), F.col("_n")))


def uniform(rows: DataFrame, column: str, expected: str, key: str) -> DataFrame:
    return violations(rows, f"uniform_{column}", key, ~F.col(column).eqNullSafe(F.lit(expected)), F.col(column))


def same_rows(manifest: DataFrame, exported: DataFrame, key: str, partition: str) -> DataFrame:
    """Every exported row once in the manifest, with the same partition, and the other way round."""
    m = manifest.groupBy(key).agg(F.count(F.lit(1)).alias("_m"), F.min(partition).alias("_mp"))
    e = exported.groupBy(key).agg(F.count(F.lit(1)).alias("_e"), F.min(partition).alias("_ep"))
    both = m.join(e, key, "full_outer")
    what = F.when(F.col("_m").isNull(), "not in manifest").when(F.col("_e").isNull(), "not exported").when((F.col("_m") > 1) | (F.col("_e") > 1), "repeated").when(F.col("_mp") != F.col("_ep"), "other partition")
    return violations(both.withColumn("_w", what), "same_rows", key, F.col("_w").isNotNull(), F.col("_w"))


def recorded_clusters(manifest: DataFrame, members: DataFrame, key: str, cluster: str) -> DataFrame:
    m = members.select(F.col(key).alias("_k"), F.col("cluster_id").alias("_c"))
    both = manifest.join(m, manifest[key] == m["_k"], "left")
    return violations(both, "cluster_recorded", key, ~F.col(cluster).eqNullSafe(F.col("_c")), F.col("_c"))


def isolated(rows: DataFrame, group: str, partition: str) -> DataFrame:
    n = rows.groupBy(group).agg(F.countDistinct(partition).alias("_n"))
    return violations(n, f"isolated_{group}", group, F.col("_n") > 1, F.col("_n"))


def absent(rows: DataFrame, restricted: DataFrame, key: str, partition: str, forbidden: str) -> DataFrame:
    """Restricted keys that stand in a forbidden partition."""
    hit = rows.where(F.col(partition) == forbidden).join(restricted.select(key).distinct(), key, "left_semi")
    return violations(hit, "restricted_absent", key, F.lit(True))


def context_ends_in_target(rows: DataFrame, key: str, turns: str, target: str, reply_id: str, reply: str, model_input: str) -> DataFrame:
    """The last turn is the target customer's; neither the reply nor its id stands in the context."""
    last = F.try_element_at(F.col(turns), F.lit(-1))
    wrong_end = ~last["tweet_id"].eqNullSafe(F.col(target)) | (last["inbound"] != 1)
    has_reply = F.exists(turns, lambda t: t["tweet_id"] == F.col(reply_id))
    return union(violations(rows, "context_end", key, wrong_end), violations(rows, "reply_in_context", key, has_reply), violations(rows, "reply_leaks", key, leaks_reply(F.col(model_input), F.col(reply))))


def flags_reproduce(rows: DataFrame, key: str, turns: str, flags: str) -> DataFrame:
    again = turn_flags(F.col(turns))
    wrong = F.array_compact(F.array(*[F.when(~again[f].eqNullSafe(F.col(flags)[f]), F.lit(f)) for f in FLAGS]))
    return violations(rows.withColumn("_w", wrong), "flags_reproduce", key, F.size("_w") > 0, F.array_join("_w", ","))


def domains(rows: DataFrame, key: str, allowed: dict[str, Sequence], filled: Sequence[str] = (), prefix: str | None = None) -> DataFrame:
    """Values outside of their domain, blank fields, keys without the prefix; one scan."""
    tests = [F.when(F.col(c).isNull() | ~F.col(c).isin(*v), F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null")))) for c, v in allowed.items()]
    tests += [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"{c} is blank")) for c in filled]
    if prefix:
        tests.append(F.when(~F.col(key).cast("string").startswith(prefix), F.lit("prefix")))
    wrong = F.array_compact(F.array(*tests))
    return rows.select(F.lit("domain").alias("check"), F.col(key).cast("string").alias("key"), F.explode(wrong).alias("detail"))


def counts(rows: DataFrame, column: str, expected: dict[str, int]) -> DataFrame:
    want = rows.sparkSession.createDataFrame(list(expected.items()), f"{column} string, _want long")
    got = rows.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    both = want.join(got, column, "full_outer").select(column, F.coalesce("_want", F.lit(0)).alias("_want"), F.coalesce("_n", F.lit(0)).alias("_n"))
    return violations(both, "count", column, F.col("_want") != F.col("_n"), F.concat_ws("/", "_n", "_want"))


def contamination(rows: DataFrame, known: DataFrame, key: str, allowed: bool = False) -> DataFrame:
    """Keys that are in a list that they must not be in, or (``allowed``) are not in the list that they must be in."""
    hit = rows.join(known.select(key).distinct(), key, "left_anti" if allowed else "left_semi")
    return violations(hit, "not_listed" if allowed else "contaminated", key, F.lit(True))


def template_state(rows: DataFrame, key: str, human: dict[str, Sequence[str]]) -> DataFrame:
    """A review sheet is either blank throughout or complete with legal values."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    filled = F.lit(False)
    for c in human:
        filled = filled | ~blank(c)
    started = rows.agg(F.coalesce(F.bool_or(filled), F.lit(False)).alias("_started"))
    bad = F.array_compact(F.array(*[F.when(blank(c) | ~F.trim(F.col(c)).isin(*v), F.lit(c)) for c, v in human.items()]))
    both = rows.join(F.broadcast(started)).withColumn("_w", F.when(F.col("_started"), bad).otherwise(F.array().cast("array<string>")))  # one row
    return violations(both, "template_state", key, F.size("_w") > 0, F.array_join("_w", ","))
