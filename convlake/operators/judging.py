"""Judgements of replies: heuristic rubric, cache keys, parsing and validation of raw replies, replay, agreement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SCORES

MEASURES = ("relevance", "grounding", "usefulness", "tone")


@dataclass(frozen=True)
class Rubric:
    """Patterns and phrases of the heuristic judge, whose three patterns and the ladder of scores are fixed values; ``version`` 2 also calls bare acknowledgements unhelpful."""

    refund: str = r"\b(refund issued|guarantee.*refund|money back guaranteed|issued a refund)\b"
    outage: str = r"\b(server outage confirmed|confirmed.*outage|system is down globally)\b"
    account: str = r"\b(fixed your account|updated your password for you|deleted your account for you)\b"
    site: str = "example.com"
    name: str = "example"
    grounded: tuple[str, ...] = ("clean reinstall", "licensing agreements")
    useful: tuple[str, ...] = ("reinstall", "newsroom")
    polite: tuple[str, ...] = ("thanks", "thank you", "please", "help", "reaching out")
    default: str = "other"
    version: int = 2


def _any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def rubric_scores(message: Column, label: Column, escalated: Column, reply: Column, gold_escalate: Column, rubric: Rubric = Rubric()) -> Column:
    """Struct of four scores from 0 to 2, ``critical_error`` and its details."""
    r, m = F.lower(F.trim(F.coalesce(reply, F.lit("")))), F.lower(F.trim(F.coalesce(message, F.lit(""))))
    refund, outage, account = (r.rlike(p) for p in (rubric.refund, rubric.outage, rubric.account))
    unsafe = gold_escalate & ~escalated
    claim = refund | outage | account
    vague = (label == rubric.default) & ~r.contains(rubric.name)
    if rubric.version >= 2:
        vague = vague & (F.length(m) > 20)
    bare = (F.length(r) < 15) | (r.contains("thanks for reaching out") & ~r.contains(rubric.site) & ~r.contains("reinstall"))
    weak = F.when(bare, F.when(r.contains("thanks"), 1).otherwise(0)) if rubric.version >= 2 else F.when(F.length(r) < 15, 0)
    return F.struct(
        F.when((F.length(r) < 10) | vague, 1).otherwise(2).alias("relevance"),
        F.when(claim, 0).when(r.contains(rubric.site) | _any(r, rubric.grounded), 2).otherwise(1).alias("grounding"),
        weak.when(r.contains(f"{rubric.site}/") | _any(r, rubric.useful), 2).otherwise(1).alias("usefulness"),
        F.when(_any(r, rubric.polite), 2).otherwise(1).alias("tone"), (claim | unsafe).alias("critical_error"),
        F.struct(refund.alias("has_refund_claim"), outage.alias("has_outage_claim"), account.alias("has_account_edit"), unsafe.alias("is_unsafe_routing")).alias("critical_details"),
    )


def cache_key(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON in the order of their names; a null is written as null."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def json_block(raw: Column) -> Column:
    """The text itself if it is a JSON object, else its first { to its last }; null without any that parses."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    block = F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit(""))
    parses = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(t.startswith("{") & parses(t), t).when(parses(block), block)


def schema_error(block: Column) -> Column:
    """The first thing wrong with a parsed judgement, null if nothing; scores have to be whole numbers in the text itself."""
    out = F.when(block.isNull(), "unparsable")
    for m in MEASURES:
        value = F.get_json_object(block, f"$.{m}")
        out = out.when(value.isNull(), f"Missing field: {m}").when(~value.isin("0", "1", "2"), f"Field '{m}' must be integer 0/1/2")
    crit = F.get_json_object(block, "$.critical_error")
    details = F.get_json_object(block, "$.critical_error_details")
    return out.when(crit.isNull(), "Missing field: critical_error").when(~crit.isin("true", "false"), "Field 'critical_error' must be bool").when(details.isNull() | ~details.startswith("{"), "Missing or invalid 'critical_error_details'")


def parse_judgement(raw: Column) -> Column:
    """Struct (scores, error): scores are null where there is an error."""
    block = json_block(raw)
    error = schema_error(block)
    return F.struct(F.when(error.isNull(), F.from_json(block, SCORES)).alias("scores"), error.alias("error"))


def render_prompt(template: str, defaults: dict[str, str], **fields: Column) -> Column:
    """``template`` with {name} replaced; a null or empty field takes its default."""
    out = F.lit(template)
    for k, c in fields.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(F.nullif(c, F.lit("")), F.lit(defaults.get(k, ""))))
    return out


def last_entries(cache: DataFrame, key: str = "cache_key", order: str = "cached_at") -> DataFrame:
    """The last entry of each key of an append-only cache."""
    rest = [c for c in cache.columns if c != key]
    kept = cache.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.to_json(F.struct(*rest)))).alias("_e"))
    return kept.select(key, *[F.col(f"_e.{c}").alias(c) for c in rest])


def replay(wanted: DataFrame, cache: DataFrame, rubric_sha: str, prompt_sha: str) -> DataFrame:
    """``wanted`` (cache_key) with ``status`` hit, stale, missing or failed, and scores only for hits; failures are never made up for."""
    entry = last_entries(cache).select("cache_key", F.col("rubric_sha256").alias("_r"), F.col("prompt_sha256").alias("_p"), F.coalesce("llm_failure", F.lit(False)).alias("_f"), F.col("scores").alias("_s"), F.lit(True).alias("_known"))
    joined = wanted.join(entry, "cache_key", "left")
    stale = ~F.col("_r").eqNullSafe(F.lit(rubric_sha)) | ~F.col("_p").eqNullSafe(F.lit(prompt_sha))
    status = F.when(F.col("_known").isNull(), "missing").when(stale, "stale").when(F.col("_f") | F.col("_s").isNull(), "failed").otherwise("hit")
    return joined.withColumn("status", status).withColumn("scores", F.when(F.col("status") == "hit", F.col("_s"))).drop("_r", "_p", "_f", "_s", "_known")


def coverage(replayed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return replayed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ("hit", "stale", "missing", "failed")])


def score_systems(systems: dict[str, DataFrame], gold: DataFrame, key: str, rubric: Rubric = Rubric()) -> DataFrame:
    """One long table of all systems: a row per system and example of ``gold``, with the rubric's scores of its prediction.

    ``systems`` maps names to predictions (``key``, label, escalated, reply), ``gold`` has ``key``, message, gold_escalate. An
    example that a system lacks has no row.
    """
    every = None
    for name, p in systems.items():
        part = p.select(F.lit(name).alias("system_id"), key, "label", "escalated", "reply")
        every = part if every is None else every.unionByName(part)
    joined = every.join(gold.select(key, "message", "gold_escalate"), key)
    return joined.select("system_id", key, rubric_scores(F.col("message"), F.col("label"), F.col("escalated"), F.col("reply"), F.col("gold_escalate"), rubric).alias("s")).select("system_id", key, "s.*")


def critical_confusion(ratings: DataFrame, judged: DataFrame, key: tuple[str, ...], flag: str = "critical_error") -> DataFrame:
    """One row: how often a human's critical flag (text) and the judge's agree, and how they differ; unrated rows are left out."""
    from ..functions.text import strict_boolean
    from .metrics import binary_metrics

    rated = ratings.where(F.trim(F.coalesce(F.col(f"{flag}_human"), F.lit(""))) != "").select(*key, strict_boolean(F.col(f"{flag}_human")).alias("_gold"))
    joined = rated.join(judged.select(*key, F.col(flag).alias("_judge")).where("_judge is not null"), list(key))
    return joined.agg(F.count(F.lit(1)).alias("n"), *binary_metrics(F.col("_gold"), F.col("_judge"))[:4])


def human_agreement(ratings: DataFrame, judged: DataFrame, key: tuple[str, ...], expected: int) -> DataFrame:
    """(measure, status, n, agreement, kappa) of human ratings (text, blank: unrated) and the judge; not measured before all are rated."""
    from .metrics import weighted_kappa

    done = F.lit(True)
    for m in MEASURES:
        done = done & (F.trim(F.coalesce(F.col(f"{m}_human"), F.lit(""))) != "")
    complete = ratings.where(done)
    spark = ratings.sparkSession
    if complete.count() < expected:
        return spark.createDataFrame([(m, "Not yet measured", None, None, None) for m in MEASURES], "measure string, status string, n long, agreement double, kappa double")
    joined = complete.join(judged, list(key)).where(F.col("relevance").isNotNull())
    long = joined.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}_human").try_cast("int").alias("a"), F.col(m).cast("int").alias("b")) for m in MEASURES])).alias("r")).select("r.*")
    return weighted_kappa(long, "a", "b", by=("measure",)).select("measure", F.lit("Measured").alias("status"), "n", "agreement", "kappa")
