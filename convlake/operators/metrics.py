"""Profiles, counts, classification metrics, intervals, agreement, bootstrap and scorecards."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 for an empty denominator."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def table_profile(rows: DataFrame, inbound: str | None = None) -> DataFrame:
    """One row: number of rows, nulls per column, and inbound and outbound rows, in one pass."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in rows.columns]]
    if inbound:
        aggs += [F.count_if(F.col(inbound)).alias("n_inbound"), F.count_if(~F.col(inbound)).alias("n_outbound")]
    return rows.agg(*aggs)


def top_values(rows: DataFrame, column: str, n: int = 20) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column).limit(n)


def reason_counts(rows: DataFrame, reason: str, prefixes: Sequence[str] = ()) -> DataFrame:
    """Rows per reason, and per prefix of a reason as ``<prefix>*``."""
    out = rows.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    if not prefixes:
        return out
    rolled = out.select(F.explode(F.array_compact(F.array(*[F.when(F.col("reason").startswith(p), F.lit(f"{p}*")) for p in prefixes]))).alias("reason"), "n")
    return out.unionByName(rolled.groupBy("reason").agg(F.sum("n").alias("n")))


def distribution(rows: DataFrame, label: str) -> DataFrame:
    """Rows and share of each label."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_all"))
    return n.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")  # one row


def flag_counts(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(flag, n, share) of boolean columns."""
    one = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(k) for k, c in flags.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("flag"), F.col(k).alias("n"), ratio(F.col(k), F.col("_n")).alias("share")) for k in flags])
    return one.select(F.explode(pairs).alias("f")).select("f.*")


def binary_metrics(gold: Column, predicted: Column) -> list[Column]:
    """Aggregates: confusion counts, accuracy, precision, recall and F1; 0 where a denominator is empty."""
    tp, fp, fn, tn = (F.count_if(c) for c in (gold & predicted, ~gold & predicted, gold & ~predicted, ~gold & ~predicted))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), ratio(tp + tn, F.count(F.lit(1))).alias("accuracy"), p.alias("precision"), r.alias("recall"), F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)).alias("f1")]


def by_subset(rows: DataFrame, keys: Sequence[str], subset: str, aggs: Sequence[Column], every: str = "overall") -> DataFrame:
    """The same aggregates over all rows and per subset, in one pass."""
    wide = rows.withColumn("subset_", F.explode(F.array(F.lit(every), F.col(subset))))
    return wide.groupBy(*keys, F.col("subset_").alias("subset")).agg(*aggs)


def class_report(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Per label support, precision, recall and F1, and a row ``macro`` with their plain means."""
    g = rows.groupBy(F.col(gold).alias("label")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col(gold) == F.col(predicted)).alias("hit"))
    p = rows.groupBy(F.col(predicted).alias("label")).agg(F.count(F.lit(1)).alias("called"))
    both = g.join(p, "label", "full_outer").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "hit", "called")])
    pr, re = ratio(F.col("hit"), F.col("called")), ratio(F.col("hit"), F.col("support"))
    each = both.select("label", "support", pr.alias("precision"), re.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
    macro = each.agg(F.lit("macro").alias("label"), F.sum("support").alias("support"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    return each.withColumn("label", F.col("label").cast("string")).unionByName(macro)


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """Struct (p, low, high): a proportion with its Wilson 95 % interval; zeros for n = 0."""
    p = k / n
    centre, root = (p + z * z / (2 * n)) / (1 + z * z / n), F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    margin = z / (1 + z * z / n) * root
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("p", "low", "high")])
    return F.when(n == 0, zero).otherwise(F.struct(p.alias("p"), F.greatest(F.lit(0.0), centre - margin).alias("low"), F.least(F.lit(1.0), centre + margin).alias("high")))


def weighted_kappa(rows: DataFrame, a: str, b: str, least: int = 0, most: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """(n, agreement, kappa): exact agreement and linear-weighted Cohen's kappa of two raters; 1 where chance agrees fully.

    Ratings outside of the scale count in n alone. The expected part needs only each rater's mean weight: with
    marginal counts r and c it is the sum over the grid, which has (most - least + 1)**2 cells.
    """
    span = max(1, most - least)
    scale = range(least, most + 1)
    counts = {**{f"_a{i}": F.count_if(F.col(a) == i) for i in scale}, **{f"_b{i}": F.count_if(F.col(b) == i) for i in scale}}
    seen = F.col(a).between(least, most) & F.col(b).between(least, most)
    agreed = F.sum(F.when(seen, 1 - F.abs(F.col(a) - F.col(b)) / span))
    one = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("_same"), F.coalesce(agreed, F.lit(0.0)).alias("_po"), *[c.alias(k) for k, c in counts.items()])
    expected = sum((F.col(f"_a{i}") * F.col(f"_b{j}") * (1 - abs(i - j) / span) for i in scale for j in scale), F.lit(0.0)) / (F.col("n") * F.col("n"))
    kappa = F.when(F.col("n") == 0, F.lit(1.0)).when(F.abs(expected - 1) < 1e-12, F.lit(1.0)).otherwise((F.col("_po") / F.col("n") - expected) / (1 - expected))
    return one.select(*by, "n", F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.col("_same") / F.col("n")).alias("agreement"), kappa.alias("kappa"))


def cluster_bootstrap(rows: DataFrame, cluster: str, values: Sequence[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(measure, low, high): the middle 95 % of a mean when whole clusters are drawn with replacement.

    Clusters are summed first. How often a replicate draws a cluster is a Poisson number, from a hash of (replicate,
    cluster), so runs agree, nothing is joined and each task adds up its clusters before the shuffle.
    """
    sums = rows.groupBy(F.col(cluster).alias("_cluster")).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(v) for v in values])
    each = sums.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    unit = (F.shiftrightunsigned(F.xxhash64("replicate", "_cluster", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    below, term, times = 0.0, math.exp(-1.0), F.lit(0)
    for k in range(1, 20):  # beyond, the chance is under 1e-18
        below += term
        term /= k
        times = times + (unit > below).cast("int")
    drawn = each.withColumn("_times", times).where("_times > 0")
    per = drawn.groupBy("replicate").agg(*[(F.sum(F.col(v) * F.col("_times")) / F.sum(F.col("_n") * F.col("_times"))).alias(v) for v in values])
    long = per.select(F.explode(F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("mean")) for v in values])).alias("m")).select("m.*")
    ranked = long.withColumn("_k", F.row_number().over(W.partitionBy("measure").orderBy("mean")) - 1)  # ``replicates`` rows a measure
    pick = lambda share: F.max(F.when(F.col("_k") == int(share * replicates), F.col("mean")))
    return ranked.groupBy("measure").agg(pick(0.025).alias("low"), pick(0.975).alias("high"))


def scorecard(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per system: accuracy over all rows, escalation recall, coverage, unsafe share of automated rows, mean scores of scored rows.

    Columns: intent_gold, intent_pred, escalate_gold, escalate_pred, and scores (null: unscored) relevance, grounding,
    usefulness, tone, critical_error. An unscored automated row is unsafe only by its gold label.
    """
    auto, crit = ~F.col("escalate_pred"), F.coalesce(F.col("critical_error"), F.lit(False))
    n = F.count(F.lit(1))
    counts = {
        "n": n, "intent_hits": F.count_if(F.col("intent_gold") == F.col("intent_pred")), "required": F.count_if("escalate_gold"), "escalated": F.count_if(F.col("escalate_gold") & F.col("escalate_pred")),
        "automated": F.count_if(auto), "unsafe": F.count_if(auto & (F.col("escalate_gold") | crit)), "scored": F.count("relevance"), "critical": F.count_if(crit),
    }
    out = rows.groupBy(*by).agg(*[c.alias(k) for k, c in counts.items()], *[F.avg(c).alias(f"mean_{c}") for c in ("relevance", "grounding", "usefulness", "tone")])
    for name, a, b in (("accuracy", "intent_hits", "n"), ("escalation_recall", "escalated", "required"), ("coverage", "automated", "n"), ("unsafe_rate", "unsafe", "automated")):
        out = out.withColumn(name, wilson(F.col(a), F.col(b)))
    return out.withColumn("unscored", F.col("n") - F.col("scored"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (classes * n_class) of each label."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_labels"))
    return n.crossJoin(F.broadcast(total)).withColumn("weight", F.col("_all") / (F.col("_labels") * F.col("n"))).drop("_all", "_labels")  # one row


def majority(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), label).limit(1)


def retrieval_inspection(hits: DataFrame, rank: str, score: str, least: float) -> DataFrame:
    """Queries with a hit, mean best similarity, share whose best is useful."""
    top = hits.where(F.col(rank) == 1)
    return top.agg(F.count(F.lit(1)).alias("n_queries"), F.avg(score).alias("mean_top"), ratio(F.count_if(F.col(score) >= least), F.count(F.lit(1))).alias("useful_share"))


def sweep(rows: DataFrame, score: str, good: Column, thresholds: Sequence[float]) -> DataFrame:
    """For each threshold, rows at or above it and how many of them are good: one pass, an array of counts."""
    one = rows.agg(*[F.count_if(F.col(score) >= t).alias(f"_n{k}") for k, t in enumerate(thresholds)], *[F.count_if((F.col(score) >= t) & good).alias(f"_g{k}") for k, t in enumerate(thresholds)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_n{k}").alias("n"), F.col(f"_g{k}").alias("n_good")) for k, t in enumerate(thresholds)])).alias("s")).select("s.*")


def shortfall(rows: DataFrame, partition: str, targets: dict[str, int]) -> DataFrame:
    """Rows that each partition lacks to its target."""
    n = rows.groupBy(F.col(partition).alias("partition")).agg(F.count(F.lit(1)).alias("n"))
    want = rows.sparkSession.createDataFrame(list(targets.items()), "partition string, target long")
    return want.join(n, "partition", "left").select("partition", "target", F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.lit(0), F.col("target") - F.coalesce("n", F.lit(0))).alias("shortfall"))


def cluster_summary(members: DataFrame) -> DataFrame:
    """Clusters, singletons, clusters of several rows, their largest, rows that representatives remove."""
    per = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return per.agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if(F.col("size") == 1).alias("n_single"), F.count_if(F.col("size") > 1).alias("n_multi"), F.max("size").alias("largest"), F.sum(F.col("size") - 1).alias("n_removed"))
