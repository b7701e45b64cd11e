"""Batch scoring: rules, prototypes, risk signals, drafts, validation, routing. Rules, templates and claims are data."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_reply
from ..schemas import PREDICTION


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    source: str = ""
    reply: str = ""


@dataclass(frozen=True)
class Claim:
    name: str
    pattern: str
    support: tuple[str, ...]
    contradiction: tuple[str, ...] = ()


@dataclass(frozen=True)
class Policy:
    """Everything that a scoring run is told about its domain."""

    rules: tuple[Rule, ...]
    signals: dict[str, str] = field(default_factory=dict)
    openers: dict[str, str] = field(default_factory=dict)
    closers: dict[str, str] = field(default_factory=dict)
    actions: dict[str, str] = field(default_factory=dict)
    claims: tuple[Claim, ...] = ()
    prohibited: str = "(?!)"
    default: str = "other"
    cautious: tuple[str, ...] = ()
    threshold: float = 0.25

    @property
    def labels(self) -> list[str]:
        return [*dict.fromkeys(r.label for r in self.rules), self.default]


def _found(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?iU){pattern}")  # word borders and case by Unicode


def _some(texts: Column, what: str, pattern: bool) -> Column:
    """Whether one of an array of texts matches a pattern, or holds a phrase."""
    return F.exists(texts, lambda t: _found(t, what) if pattern else t.contains(what))


def classify(text: Column, policy: Policy) -> Column:
    """The label of the first rule that matches, else the default."""
    out = F.lit(policy.default)
    for r in reversed(policy.rules):
        out = F.when(_found(text, r.pattern), F.lit(r.label)).otherwise(out)
    return out


def by_label(label: Column, values: dict[str, str], default: str) -> Column:
    out = F.lit(values.get(default, ""))
    for k, v in values.items():
        out = F.when(label == k, F.lit(v)).otherwise(out)
    return out


#: Added to bounds on distances between unit vectors, well above their rounding errors.
_SLACK = 1e-5


def _norm(v: Column) -> Column:
    """Length of a vector; null if it is zero or not finite, or a component is null."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    return F.when((n > 0) & (n < float("inf")), n)


def _cosine(own: Column, size: Column, other: Column, other_size: Column) -> Column:
    """-1 where a length is null; the shorter vector is filled with zeros."""
    dot = F.aggregate(F.zip_with(own, other, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0)))
    return F.coalesce(F.try_divide(dot, size * other_size), F.lit(-1.0))


def _apart(cosine: Column) -> Column:
    """Distance of two unit vectors."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cosine))


def _rings(named: DataFrame, groups: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Prototypes (label, v, norm) as lists (g, lo, hi, _known) of some ``most``, and the one row ``_centres`` of ``groups`` of them.

    A prototype belongs to the nearest centre; those of a centre are told apart by their distance to it, which is from lo to hi.
    """
    from ..storage import store

    chosen = named.orderBy(F.xxhash64("label"), "label").limit(groups).agg(F.collect_list(F.struct("label", "v", "norm")).alias("_c"))
    home = F.array_min(F.transform("_c", lambda c, i: F.struct(_apart(_cosine(F.col("v"), F.col("norm"), c["v"], c["norm"])).alias("dist"), i.alias("g"))))
    placed = named.crossJoin(F.broadcast(chosen)).select("label", "v", "norm", home.alias("_h")).select("label", "v", "norm", "_h.dist", "_h.g", F.floor(F.col("_h.dist") * 32).alias("ring"))
    placed = store(placed, "prototypes")
    parts = placed.groupBy("g", "ring").agg(F.ceil(F.count(F.lit(1)) / most).alias("n"))
    dealt = placed.join(parts, ["g", "ring"]).withColumn("part", F.pmod(F.xxhash64("label"), F.col("n")))
    known = F.collect_list(F.struct("label", "v", "norm", "dist")).alias("_known")
    rings = store(dealt.groupBy("g", "ring", "part").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), known).drop("ring", "part"), "rings")
    each = chosen.select(F.posexplode("_c").alias("g", "c")).select("g", "c.v", "c.norm")
    reach = rings.groupBy("g").agg(F.max("hi").alias("hi"))
    return rings, each.join(reach, "g").agg(F.collect_list(F.struct("g", "v", "norm", "hi")).alias("_centres"))


def _met(rows: DataFrame, rings: DataFrame) -> DataFrame:
    """(_row, _own, _norm, _known): for rows at distance ``d`` of centre ``g``, the prototypes that can lie within ``reach``."""
    most = F.col("reach") + _SLACK
    near = rows.join(rings, "g").where(F.greatest(F.col("d") - F.col("hi"), F.col("lo") - F.col("d")) <= most)
    return near.select("_row", "_own", "_norm", F.filter("_known", lambda p: F.abs(p["dist"] - F.col("d")) <= most).alias("_known"))


def _best(met: DataFrame) -> DataFrame:
    each = F.transform("_known", lambda p: F.struct(_cosine(F.col("_own"), F.col("_norm"), p["v"], p["norm"]).alias("cosine"), p["label"].alias("label")))
    return met.select("_row", F.array_max(each).alias("_best")).groupBy("_row").agg(F.max("_best").alias("_best"))


def _best_of_many(kept: DataFrame, named: DataFrame, groups: int, most: int) -> DataFrame:
    """(_row, _best) over many prototypes: the nearest centre's first, then of others those that the triangle inequality does not rule out."""
    from ..storage import store

    rings, centres = _rings(named, groups, most)
    centres = F.broadcast(store(centres, "centres"))
    far = F.transform("_centres", lambda c: F.struct(_apart(_cosine(F.col("_own"), F.col("_norm"), c["v"], c["norm"])).alias("d"), c["g"].alias("g"), c["hi"].alias("hi")))
    homes = kept.crossJoin(centres).select("_row", "_own", "_norm", F.array_min(far).alias("h")).select("_row", "_own", "_norm", F.col("h.g").alias("g"), F.col("h.d").alias("d"), F.col("h.d").alias("reach"))
    first = store(_best(_met(homes, rings)), "best")
    # A centre is a prototype of its own group, so that every row has a first best.
    again = kept.join(first, "_row").withColumn("reach", _apart(F.col("_best.cosine"))).crossJoin(centres).select("_row", "_own", "_norm", "reach", F.array_sort(far).alias("_far"))
    others = F.filter(F.slice("_far", 2, groups), lambda x: x["d"] - x["hi"] <= F.col("reach") + _SLACK)
    more = again.select("_row", "_own", "_norm", "reach", F.explode(others).alias("x")).select("_row", "_own", "_norm", "reach", "x.g", "x.d")
    return first.unionByName(_best(_met(more, rings))).groupBy("_row").agg(F.max("_best").alias("_best"))


def nearest_prototype(rows: DataFrame, vector: str, prototypes: DataFrame, label: str, least: float = 0.30, most_prototypes: int = 1000) -> DataFrame:
    """``rows`` with ``prototype`` and ``cosine``: the most similar prototype, null below ``least``; ties go to the larger label.

    Prototypes (label, vector) are one row a label. Vectors that are null, zero or not finite have the cosine -1 to all. Up to ``most_prototypes`` are
    literals of one projection. More are grouped around some of them, at most so many; a row is compared with those of the
    nearest and, of the others, with those that distances to the centres leave possible, so the result is the same.
    """
    named = prototypes.select(F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    known = named.orderBy("label").limit(most_prototypes + 1).collect()
    sized = rows.withColumn("_norm", _norm(F.col(vector)))
    if len(known) > most_prototypes:
        from ..storage import store

        usable = store(named.withColumn("norm", _norm(F.col("v"))).where("norm is not null"), "prototypes")
        groups = max(1, min(most_prototypes, math.isqrt(usable.count())))
        kept = store(sized.withColumn("_row", F.monotonically_increasing_id()), "rows")
        best = _best_of_many(kept.where("_norm is not null").select("_row", F.col(vector).alias("_own"), "_norm"), usable, groups, max(1, most_prototypes // 4))
        out = kept.join(best, "_row", "left").drop("_row")
    else:
        every = [F.struct(_cosine(F.col(vector), F.col("_norm"), v, _norm(v)).alias("cosine"), F.lit(p.label).alias("label")) for p in known for v in [F.array(*[F.lit(x).cast("double") for x in p.v or []]).cast("array<double>")]]
        out = sized.withColumn("_best", F.array_max(F.array(*every)) if known else F.lit(None).cast("struct<cosine:double,label:string>"))
    cosine = F.coalesce("_best.cosine", F.lit(-1.0)) if known else F.lit(None).cast("double")
    return out.withColumn("cosine", cosine).withColumn("prototype", F.when(F.col("cosine") >= least, F.col("_best.label"))).drop("_norm", "_best")


def risk_signals(text: Column, message: Column, label: Column, policy: Policy, short: int = 15) -> Column:
    """Struct of one boolean per signal, and ``unresolved_ambiguity``: the default label or a very short message."""
    named = [_found(text, p).alias(k) for k, p in policy.signals.items()]
    return F.struct(*named, ((label == policy.default) | (F.length(F.trim(message)) < short)).alias("unresolved_ambiguity"))


def constant_baseline(rows: DataFrame, key: str, label: str, reply: str, system: str = "baseline_majority") -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("example_id"), F.lit(system).alias("system_id"), F.lit(label).alias("predicted_intent"), F.lit(True).alias("predicted_must_escalate"), F.lit(reply).alias("predicted_reply"), F.lit("fixed_majority_class_always_escalate").alias("predicted_reason"), F.array().cast("array<string>").alias("retrieved_source_ids"), F.lit(0.0).alias("runtime_ms"))


def rule_baseline(rows: DataFrame, key: str, message: str, prior: str | None, policy: Policy, escalate: str, always: Sequence[str] = (), fallback: tuple[str, str] = ("GENERAL", ""), system: str = "baseline_rules") -> DataFrame:
    """Label, template and source of the first matching rule; escalates by pattern, or for the labels in ``always``."""
    text = F.concat_ws(" ", F.coalesce(F.col(prior), F.lit("")) if prior else F.lit(""), F.coalesce(F.col(message), F.lit("")))
    label = classify(text, policy)
    hit, sensitive, own = label != policy.default, _found(text, escalate), label.isin(*always) if always else F.lit(False)
    pick = lambda attr, default: by_label(label, {**{r.label: getattr(r, attr) for r in reversed(policy.rules)}, policy.default: default}, policy.default)
    reason = F.concat(F.when(hit, F.concat(F.lit("keyword_match_"), label)).otherwise(F.lit("fallback_keyword_unmatched")), F.when(sensitive, "_sensitive_escalation_rule").when(own, "_account_security_escalation").otherwise(F.lit("")))
    return rows.select(F.col(key).cast("string").alias("example_id"), F.lit(system).alias("system_id"), label.alias("predicted_intent"), (sensitive | own).alias("predicted_must_escalate"), pick("reply", fallback[1]).alias("predicted_reply"), reason.alias("predicted_reason"), F.array(pick("source", fallback[0])).alias("retrieved_source_ids"), F.lit(0.0).alias("runtime_ms"))


def draft(label: Column, evidence: Column, policy: Policy, least_text: int = 15, least_advice: int = 20) -> Column:
    """Struct (reply, cited): opener, action, closer; the action is the best evidence's reply if it is similar and long enough.

    ``evidence`` is an array of structs (id, reply, customer, score), best first.
    """
    top = F.try_element_at(evidence, F.lit(1))
    advice = F.when((top["score"] >= policy.threshold) & (F.length(clean_reply(top["reply"])) >= least_text), clean_reply(top["reply"]))
    said = F.trim(advice)
    ended = F.when(said.rlike(r"[.!?]$"), said).otherwise(F.concat(said, F.lit(".")))
    action = F.when(F.length(said) >= least_advice, ended).otherwise(by_label(label, policy.actions, policy.default))
    reply = F.concat_ws(" ", by_label(label, policy.openers, policy.default), action, by_label(label, policy.closers, policy.default))
    cited = F.when(advice.isNotNull(), F.array(top["id"].cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.struct(reply.alias("reply"), cited.alias("cited"))


def validate(label: Column, drafted: Column, evidence: Column, policy: Policy) -> Column:
    """Array of errors of a draft; empty: valid. Claims have to be supported, and not contradicted, by the cited evidence."""
    reply, cited = drafted["reply"], drafted["cited"]
    ids = F.transform(evidence, lambda e: e["id"].cast("string"))
    base = [
        F.when(F.length(F.trim(F.coalesce(reply, F.lit("")))) == 0, "empty_reply"), F.when(~label.isin(*policy.labels), "invalid_intent_label"),
        F.when(F.size(F.array_except(cited, ids)) > 0, "invalid_cited_id"), F.when(_found(reply, policy.prohibited), "prohibited_claim_in_draft"),
    ]
    errors = F.array_compact(F.array(*base))
    quoted = F.transform(F.filter(evidence, lambda e: F.array_contains(cited, e["id"].cast("string"))), lambda e: F.lower(F.concat_ws(" ", e["reply"], e["customer"])))
    for c in policy.claims:
        claimed = _found(reply, c.pattern)
        no, yes = F.lit(False), F.lit(False)
        for p in c.contradiction:
            no = no | _some(quoted, p, True)
        for w in c.support:
            yes = yes | _some(quoted, w.lower(), False)
        found = (
            F.when(claimed & (F.size(cited) == 0), f"unsupported_substantive_claim: {c.name} asserted without cited evidence")
            .when(claimed & no, f"contradictory_evidence_claim: {c.name}")
            .when(claimed & ~yes & (F.size(errors) == 0), f"unsupported_substantive_claim: {c.name} not supported by cited evidence")
        )
        errors = F.concat(errors, F.array_compact(F.array(found)))
    return errors


def route(label: Column, signals: Column, errors: Column, evidence: Column, policy: Policy, reasons: dict[str, str]) -> Column:
    """Struct (must_escalate, decision, reason): ``reasons`` maps signals to reason codes, in order."""
    top = F.coalesce(F.try_element_at(evidence, F.lit(1))["score"], F.lit(0.0))
    listed = [F.when(signals[s], r) for s, r in reasons.items()]
    listed += [F.when(F.size(errors) > 0, "validation_schema_failure"), F.when(label.isin(*policy.cautious) & (top < policy.threshold), "low_retrieval_evidence_confidence") if policy.cautious else F.lit(None).cast("string")]
    why = F.array_compact(F.array(*listed))
    return F.struct((F.size(why) > 0).alias("must_escalate"), F.when(F.size(why) > 0, "escalate").otherwise(F.lit("auto_handle")).alias("decision"), F.when(F.size(why) > 0, F.array_join(why, "; ")).otherwise(F.lit("safe_auto_handle_standard_troubleshooting")).alias("reason"))


def predict(rows: DataFrame, key: str, message: str, prior: str | None, evidence: str, policy: Policy, reasons: dict[str, str], system: str = "main") -> DataFrame:
    """End-to-end prediction of each row, with every stage's result in ``stages``.

    A row whose key or message is null becomes an escalation, never a failed job. Rows without a citation list the first
    two retrieved ids.
    """
    said = F.coalesce(F.col(message), F.lit(""))
    text = F.concat_ws(" ", F.coalesce(F.col(prior), F.lit("")) if prior else F.lit(""), said)
    ev = F.coalesce(F.col(evidence), F.array().cast("array<struct<id:string,reply:string,customer:string,score:double>>"))
    one = rows.withColumn("_label", classify(text, policy)).withColumn("_ev", ev)
    one = one.withColumn("_signals", risk_signals(text, said, F.col("_label"), policy)).withColumn("_draft", draft(F.col("_label"), F.col("_ev"), policy))
    one = one.withColumn("_errors", validate(F.col("_label"), F.col("_draft"), F.col("_ev"), policy))
    one = one.withColumn("_route", route(F.col("_label"), F.col("_signals"), F.col("_errors"), F.col("_ev"), policy, reasons))
    ids = F.when(F.size("_draft.cited") > 0, F.col("_draft.cited")).otherwise(F.transform(F.slice("_ev", 1, 2), lambda e: e["id"].cast("string")))
    bad = F.col(message).isNull()
    return one.select(
        F.col(key).cast("string").alias("example_id"), F.lit(system).alias("system_id"), F.when(bad, policy.default).otherwise(F.col("_label")).alias("predicted_intent"),
        (bad | F.col("_route.must_escalate")).alias("predicted_must_escalate"), F.col("_draft.reply").alias("predicted_reply"),
        F.when(bad, "pipeline_exception_escalation: no message").otherwise(F.col("_route.reason")).alias("predicted_reason"), ids.alias("retrieved_source_ids"), F.lit(0.0).alias("runtime_ms"),
        F.struct(F.col("_signals").alias("signals"), F.col("_errors").alias("errors"), F.col("_route.decision").alias("decision")).alias("stages"),
    )


def score_with(rows: DataFrame, scorer: Callable) -> DataFrame:
    """A pluggable scorer, pandas frame to pandas frame with the prediction columns, run on Arrow batches."""

    def run(frames):
        for frame in frames:
            yield scorer(frame)[[f.name for f in PREDICTION]]

    return rows.mapInPandas(run, PREDICTION)


def weak_labels(rows: DataFrame, text: str, policy: Policy, keep: Column, cap: int, source_rank: str, key: str) -> DataFrame:
    """Rule-labelled training rows: usable texts, one per text, at most ``cap`` a label by source then key."""
    from .selection import drop_repeats, first_per_group

    made = rows.where(keep).withColumn("label", classify(F.col(text), policy))
    return first_per_group(drop_repeats(made, text, [F.col(source_rank), F.col(key)]), ["label"], [F.col(source_rank), F.col(key)], cap)


def encode_labels(rows: DataFrame, label: str, numbers: dict[str, int]) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])
    return rows.withColumn("label_id", F.try_element_at(pairs, F.col(label)))
