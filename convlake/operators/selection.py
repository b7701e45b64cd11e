"""Ranking, caps, splits and samples; every order is total, so results never depend on the order of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def id_order(c: str | Column) -> list[Column]:
    """Numbers by value first, then text."""
    c = F.col(c) if isinstance(c, str) else c
    return [c.cast("string").try_cast("decimal(38,0)").asc_nulls_last(), c.cast("string").asc_nulls_last()]


def shuffle_key(c: str, seed: int = 42) -> Column:
    """Order of a seeded permutation: the same for the same ids, whatever order they come in."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")))


def first_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; Spark limits groups before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def first_eligible(rows: DataFrame, group: str, eligible: Column, order: Sequence[Column]) -> DataFrame:
    """The first eligible row of each group."""
    return first_per_group(rows.where(eligible), [group], order).drop("rank")


def last_failure(rows: DataFrame, group: str, reason: str, order: Column) -> DataFrame:
    """For groups without any eligible row (null reason), the reason of the last one."""
    per = rows.groupBy(group).agg(F.max_by(reason, order).alias(reason), F.bool_or(F.col(reason).isNull()).alias("_ok"))
    return per.where("not _ok").drop("_ok")


def first_write_wins(rows: DataFrame, key: str, order: Sequence[Column], compare: Sequence[str], reject: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, quarantined, counts): the first row of each id stays, equal repeats are counted, others are quarantined.

    ``order`` has to be total within an id. With ``reject`` a conflicting row fails the job where it is read.
    """
    w = W.partitionBy(key).orderBy(*order)
    body = F.struct(*compare)
    status = F.when(F.row_number().over(w) == 1, "kept").when(F.first(body).over(w) == body, "identical").otherwise("conflicting")
    marked = rows.withColumn("_status", status)
    if reject:
        marked = marked.withColumn("_status", F.when(F.col("_status") == "conflicting", F.raise_error(F.concat(F.lit("conflicting id "), F.col(key).cast("string"))).cast("string")).otherwise(F.col("_status")))
    bad = marked.where("_status = 'conflicting'").drop("_status").withColumn("reason", F.lit("CONFLICTING_DUPLICATE_ID"))
    return marked.where("_status = 'kept'").drop("_status"), bad, marked.groupBy(F.col("_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def allocate(rows: DataFrame, key: str, restricted: str, sizes: Sequence[tuple[str, int]], rest: tuple[str, int], seed: int = 42) -> DataFrame:
    """Split in a seeded order: unrestricted rows fill ``sizes`` one after the other, then ``rest`` takes others, restricted rows last.

    Rows beyond all sizes get no partition. The ranks come from counts in hash buckets, so no window holds all rows.
    """
    from ..storage import store

    ranked = store(global_rank(rows, shuffle_key(key, seed), key, restricted), "ranked")
    total = {bool(r[0]): r[1] for r in ranked.groupBy(restricted).agg(F.count(F.lit(1))).collect()}
    free, label, at = F.col("_rank"), None, 0
    for name, n in sizes:
        hit = ~F.col(restricted) & (free > at) & (free <= at + n)
        label = F.when(hit, name) if label is None else label.when(hit, name)
        at += n
    place = F.when(F.col(restricted), F.lit(max(0, total.get(False, 0) - at)) + free).otherwise(free - at)
    last = (place >= 1) & (place <= rest[1])
    label = F.when(last, rest[0]) if label is None else label.when(last, rest[0])
    return ranked.withColumn("partition", label).drop("_rank")


#: Rows that one window task holds, as far as order keys tell them apart.
MOST_IN_WINDOW = 1_000_000


def _leading(cut: DataFrame, keys: Sequence[str], sums: Sequence[Column], digits: int, most: int) -> tuple[DataFrame, DataFrame]:
    """``cut`` with ``_lead``, leading digits of ``_order``, and the ``sums`` of each group and ``_lead``, the number ``_n`` among them.

    A digit tree: where more than ``most`` rows agree in their leading digits, these alone are counted again by ``digits`` more,
    until keys end. No lead is the beginning of another, so leads are ordered as the keys are. Rows whose whole keys are equal stay together.
    """
    from ..storage import store

    cut, depth = cut.withColumn("_lead", F.substring("_order", 1, digits)), digits
    while True:
        longer = F.max(F.length("_order") > depth).alias("_longer")
        sizes = store(cut.groupBy(*keys, "_lead").agg(F.count(F.lit(1)).alias("_n"), *sums, longer), "leads")
        large = sizes.where((F.length("_lead") == depth) & (F.col("_n") > most) & F.col("_longer")).select(*keys, "_lead", F.lit(True).alias("_large"))
        if large.isEmpty():
            return cut, sizes.drop("_longer")
        more = F.when(F.col("_large"), F.substring("_order", 1, depth + digits)).otherwise(F.col("_lead"))
        cut = cut.join(large, [*keys, "_lead"], "left").withColumn("_lead", more).drop("_large")
        depth += digits


def global_rank(rows: DataFrame, order: Column, tie: str, group: str | None = None, digits: int = 2, most: int = MOST_IN_WINDOW) -> DataFrame:
    """``_rank`` from 1 by an order key of text: counts per leading digits shift ranks that are taken within them.

    A window holds at most ``most`` rows, but for rows with equal keys; rows whose group is null are left out.
    """
    keys = [group] if group else []
    cut, sizes = _leading(rows.withColumn("_order", order), keys, [], digits, most)
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_lead").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select(*keys, "_lead", before.alias("_before"))
    own = F.row_number().over(W.partitionBy(*keys, "_lead").orderBy("_order", tie))
    return cut.withColumn("_own", own).join(shift, [*keys, "_lead"]).withColumn("_rank", F.col("_before") + F.col("_own")).drop("_order", "_lead", "_own", "_before")


def until_quota(rows: DataFrame, group: str, flag: Column, order: Column, tie: str, least_flagged: int, least: int, digits: int = 2, most: int = MOST_IN_WINDOW) -> DataFrame:
    """Rows of each group in order until both quotas were met before them, with their ``sequence``.

    ``order`` is a key as for ``global_rank``: counts per leading digits shift sums that are taken within them, at most
    ``most`` rows each, so a group needs not fit one task; leading digits that begin after both quotas are left out before.
    """
    cut = rows.withColumn("_order", order).withColumn("_flag", F.coalesce(flag.cast("int"), F.lit(0)))
    cut, sizes = _leading(cut, [group], [F.sum("_flag").alias("_f")], digits, most)
    before = W.partitionBy(group).orderBy("_lead").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select(group, "_lead", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_f")])
    open_ = (F.col("_f_before") < least_flagged) | (F.col("_n_before") < least)
    own = W.partitionBy(group, "_lead").orderBy("_order", tie)
    seen = F.col("_f_before") + F.coalesce(F.sum("_flag").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    part = cut.join(shift.where(open_), [group, "_lead"]).withColumn("sequence", (F.col("_n_before") + F.row_number().over(own)).cast("int")).withColumn("_seen", seen)
    return part.where((F.col("_seen") < least_flagged) | (F.col("sequence") <= least)).select(*rows.columns, "sequence")


def feature_quota(rows: DataFrame, strata: Sequence[tuple[str, Column]], order: Sequence[Column], n: int = 10, name: str = "stratum") -> DataFrame:
    """``n`` rows of each stratum in order; a row belongs to the first stratum whose test it passes, without any to none."""
    label = F.lit(None).cast("string")
    for s, test in reversed(strata):
        label = F.when(test, s).otherwise(label)
    marked = rows.withColumn(name, label).where(F.col(name).isNotNull())
    return first_per_group(marked, [name], order, n)


def replay(rows: DataFrame, manifest: DataFrame, key: str, reply: str) -> DataFrame:
    """Rows that an earlier manifest names, with its reply id where it has one."""
    named = manifest.select(key, F.col(reply).alias("_named"))
    return rows.join(named, key).withColumn(reply, F.coalesce(F.nullif(F.col("_named"), F.lit("")), F.col(reply))).drop("_named")


def sequence_label(prefix: Column, number: Column, kind: str = "CONV") -> Column:
    return F.format_string(f"%s_{kind}_%03d", prefix, number.cast("int"))


def stratified(rows: DataFrame, label: str, key: str, share: float, seed: int = 42, names: tuple[str, str] = ("train", "validation")) -> DataFrame:
    """An exact share of each label in ``names[0]``, by a seeded order; rows without a label are left out. A label needs not fit one task."""
    cut = rows.groupBy(label).agg(F.round(F.lit(share) * F.count(F.lit(1))).alias("_cut")).withColumnRenamed(label, "_label")
    ranked = global_rank(rows, shuffle_key(key, seed), key, label)
    joined = ranked.join(cut, ranked[label] == cut["_label"])
    return joined.withColumn("split", F.when(F.col("_rank") <= F.col("_cut"), names[0]).otherwise(names[1])).select(*rows.columns, "split")


def drop_repeats(rows: DataFrame, text: str, order: Sequence[Column], fold_case: bool = True) -> DataFrame:
    """One row per text, the first by ``order``."""
    same = F.lower(F.col(text)) if fold_case else F.col(text)
    return first_per_group(rows.withColumn("_text", same), ["_text"], order).drop("_text", "rank")
