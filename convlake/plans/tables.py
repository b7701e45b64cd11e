"""Queries over the relational tables: selection, splits, set operations, metrics, audits, ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import strict_boolean
from ..operators import audits, joins, metrics, selection, setops
from ..storage import table


def top_users(spark, sf_dir):
    return metrics.top_values(table(spark, sf_dir, "events"), "user_id", 20)


def event_distribution(spark, sf_dir):
    return metrics.distribution(table(spark, sf_dir, "events"), "event_type").select("event_type", "n", F.round("share", 6).alias("share"))


def event_weights(spark, sf_dir):
    return metrics.class_weights(table(spark, sf_dir, "events"), "event_type").select("event_type", "n", F.round("weight", 6).alias("weight"))


def stratified_events(spark, sf_dir):
    s = selection.stratified(table(spark, sf_dir, "events"), "event_type", "event_id", 0.8)
    return s.select("event_id", "event_type", "split")


def capped_events(spark, sf_dir):
    """At most 500 events of each type, the largest values first."""
    e = table(spark, sf_dir, "events")
    return selection.first_per_group(e, ["event_type"], [F.col("value").desc_nulls_last(), F.col("event_id").asc()], 500).select("event_id", "event_type", F.col("rank").cast("long").alias("rank"))


def first_writes(spark, sf_dir):
    """First-write-wins on the order key of lineitem: kept, identical and conflicting rows."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return selection.first_write_wins(li, "l_orderkey", [F.col("l_linenumber"), F.col("l_returnflag")], ["l_returnflag"])[2]


def quarantined(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    bad = selection.first_write_wins(li, "l_orderkey", [F.col("l_linenumber"), F.col("l_returnflag")], ["l_returnflag"])[1]
    return bad.groupBy("l_returnflag", "reason").agg(F.count(F.lit(1)).alias("n"))


def sampled_until_quota(spark, sf_dir):
    """Orders of each priority in a seeded order until 30 are finished and 40 taken."""
    o = table(spark, sf_dir, "orders")
    s = selection.until_quota(o, "o_orderpriority", F.col("o_orderstatus") == "F", selection.shuffle_key("o_orderkey"), "o_orderkey", 30, 40)
    return s.select("o_orderkey", "o_orderpriority", selection.sequence_label(F.substring("o_orderpriority", 1, 1), F.col("sequence")).alias("label"))


def replayed_orders(spark, sf_dir):
    """Orders that a manifest of customers names, the named order where it has one."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("chosen"))
    first = selection.first_per_group(o, ["o_custkey"], selection.id_order("chosen")).drop("rank")
    m = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_nationkey") == 1, F.concat(F.lit("named-"), F.col("c_custkey").cast("string"))).otherwise("").alias("chosen"))
    return selection.replay(first, m, "o_custkey", "chosen").select("o_custkey", "chosen")


def distinct_names(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("name", F.concat_ws("-", "o_orderpriority", "o_orderstatus"))
    return selection.drop_repeats(o, "name", [F.col("o_orderdate"), F.col("o_orderkey")]).select("name", "o_orderkey")


def numeric_text_order(spark, sf_dir):
    """Position of customers by numeric, then textual id."""
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string")).alias("id"))
    return c.withColumn("position", F.row_number().over(W.partitionBy("c_nationkey").orderBy(*selection.id_order("id"))).cast("long"))


def customer_diff(spark, sf_dir):
    """Customers with orders in two years: shared, added, removed."""
    o = table(spark, sf_dir, "orders")
    pick = lambda y: o.where(F.year("o_orderdate") == y).select("o_orderpriority", "o_custkey")
    return setops.manifest_diff(pick(1995), pick(1996), "o_orderpriority", "o_custkey").groupBy("o_orderpriority", "status").agg(F.count(F.lit(1)).alias("n"))


def exclusion_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    u = setops.union_sources({"toxic": lab.where("toxic = 1").select("doc_id"), "poor": lab.where("quality = 0").select("doc_id"), "short": d.where("n_chars < 300").select("doc_id")}, "doc_id")
    return setops.contributions(u, "doc_id")


def pending_documents(spark, sf_dir):
    return joins.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


def review_queue(spark, sf_dir):
    """The first 50 unlabelled documents, those whose source has toxic ones first."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    todo = joins.pending(d, table(spark, sf_dir, "labels"), "doc_id")
    first = d.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("source")
    return joins.by_priority(todo, first, ["source"], [F.col("doc_id")]).limit(50).select("doc_id", "source", "prioritised")


def label_join_problems(spark, sf_dir):
    """What keeps documents and labels from being one to one; the ids of poor and toxic ones are damaged."""
    damaged = table(spark, sf_dir, "labels").withColumn("doc_id", F.when((F.col("quality") == 0) & (F.col("toxic") == 1), -1 - F.col("doc_id")).otherwise(F.col("doc_id")))
    return joins.join_violations(table(spark, sf_dir, "documents"), damaged, "doc_id").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def restricted_flags(spark, sf_dir):
    m = joins.membership(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "doc_id")
    return m.groupBy("lang", "restricted").agg(F.count(F.lit(1)).alias("n"))


def merged_notes(spark, sf_dir):
    """Supplier notes carried over by key, else by an older key, else blank."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("old-"), F.col("s_suppkey").cast("string")).alias("old_id"))
    k = F.col("id").cast("long")
    n = s.select(F.when(k % 3 == 0, F.col("id")).otherwise("").alias("id"), F.when(k % 3 == 1, F.col("old_id")).otherwise("").alias("old_id"), F.when(k % 2 == 0, F.concat(F.lit("note "), F.col("id"))).otherwise(" ").alias("note"), F.when(k % 4 == 0, "yes").otherwise("").alias("useful"))
    return joins.merge_annotations(s, n, "id", "old_id", ["note", "useful"])


def differing_lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    changed = o.where("o_orderkey % 50 <> 3").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 40 == 1, "X").otherwise(F.col("o_orderstatus")))
    return joins.differing(o, changed, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


def toxicity_rule_metrics(spark, sf_dir):
    """Confusion counts of a word rule against the labels, overall and per language."""
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").withColumn("gold", F.col("toxic") == 1).withColumn("pred", F.lower("text").rlike("idiot|clown|moron|scum"))
    out = metrics.by_subset(t, [], "lang", metrics.binary_metrics(F.col("gold"), F.col("pred")))
    return out.select("subset", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def language_report(spark, sf_dir):
    """Per-class scores of a crude language guess."""
    guess = F.when(F.col("text").rlike("[äöüß]"), "de").when(F.col("text").rlike("[ñóí]"), "es").when(F.col("text").rlike("[éèêç]"), "fr").otherwise("en")
    r = metrics.class_report(table(spark, sf_dir, "documents").withColumn("guess", guess), "lang", "guess")
    return r.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _scored(spark, sf_dir):
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    rude = F.lower("text").rlike("idiot|clown|moron|scum")
    return t.select("doc_id", F.col("lang").alias("system_id"), F.col("quality").cast("string").alias("intent_gold"), F.when(F.col("n_chars") > 500, "1").otherwise("0").alias("intent_pred"), (F.col("toxic") == 1).alias("escalate_gold"), rude.alias("escalate_pred"),
                    *[F.when(F.col("doc_id") % 4 != 0, F.pmod(F.col("n_chars"), F.lit(m))).cast("int").alias(n) for n, m in (("relevance", 3), ("grounding", 2), ("usefulness", 3), ("tone", 2))],
                    F.when(F.col("doc_id") % 4 != 0, F.col("n_chars") % 11 == 0).alias("critical_error"))


def scorecard(spark, sf_dir):
    s = metrics.scorecard(_scored(spark, sf_dir), ["system_id"])
    parts = [F.round(F.col(f"{c}.{p}"), 6).alias(f"{c}_{p}") for c in ("accuracy", "escalation_recall", "coverage", "unsafe_rate") for p in ("p", "low", "high")]
    return s.select("system_id", "n", "automated", "unsafe", "scored", "unscored", "critical", *parts, *[F.round(f"mean_{c}", 6).alias(f"mean_{c}") for c in ("relevance", "grounding", "usefulness", "tone")])


def rater_agreement(spark, sf_dir):
    k = metrics.weighted_kappa(_scored(spark, sf_dir).where("relevance is not null"), "relevance", "usefulness", by=("system_id",))
    return k.select("system_id", "n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


def bootstrap_means(spark, sf_dir):
    """Cluster bootstrap of order values by customer; the draws have no SQL form."""
    o = table(spark, sf_dir, "orders")
    return metrics.cluster_bootstrap(o, "o_custkey", ["o_totalprice"], 200)


def price_sweep(spark, sf_dir):
    return metrics.sweep(table(spark, sf_dir, "orders"), "o_totalprice", F.col("o_orderstatus") == "F", [50_000, 100_000, 200_000, 400_000])


def domain_violations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("key", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))
    return audits.domains(o, "key", {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}, ["o_orderdate"], "o")


def count_violations(spark, sf_dir):
    return audits.counts(table(spark, sf_dir, "customer"), "c_mktsegment", {"BUILDING": 300, "MACHINERY": 300, "NONE": 1})


def contaminated_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels")
    return audits.union(audits.contamination(d, lab.where("toxic = 1"), "doc_id"), audits.contamination(d, lab, "doc_id", allowed=True))


def sheet_violations(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey"), F.when(F.col("s_suppkey") % 3 == 0, "yes").when(F.col("s_suppkey") % 3 == 1, "perhaps").otherwise("").alias("useful"))
    return audits.template_state(s, "s_suppkey", {"useful": ["yes", "no"]})


def unblinded_events(spark, sf_dir):
    """Events per blind code with the type that the code stands for; one code is not in the map."""
    e = table(spark, sf_dir, "events").select(F.md5(F.col("event_type")).alias("code"))
    names = table(spark, sf_dir, "events").select("event_type").distinct().select(F.md5(F.col("event_type")).alias("code"), "event_type").where("event_type <> 'click'")
    return joins.unblind(e, names, "code").groupBy("code", "event_type").agg(F.count(F.lit(1)).alias("n"))


def challenge_documents(spark, sf_dir):
    """Ten documents of each stratum of a challenge sample, by rules on their text."""
    d = table(spark, sf_dir, "documents")
    low = F.lower("text")
    strata = (("rare", low.rlike("[0-9]{3}")), ("ambiguous", F.length("text") < 200), ("mixed", low.contains("licensed") & low.contains("tion")), ("repeated", low.contains("again") | low.contains("still")), ("sensitive", low.contains("password") | low.contains("@")))
    return selection.feature_quota(d, strata, [selection.shuffle_key("doc_id"), F.col("doc_id")], 10).select("doc_id", "stratum", F.col("rank").cast("long").alias("rank"))


def parsed_booleans(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", strict_boolean(F.when(F.col("event_id") % 3 == 0, " TRUE ").when(F.col("event_id") % 3 == 1, "0.0")).alias("flag"))
    return e.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


_SCORED = """s AS (SELECT doc_id, lang AS system_id, CAST(quality AS VARCHAR) AS ig, CASE WHEN n_chars>500 THEN '1' ELSE '0' END AS ip, toxic=1 AS eg, regexp_matches(lower(text),'idiot|clown|moron|scum') AS ep,
 CASE WHEN doc_id%4<>0 THEN n_chars%3 END AS relevance, CASE WHEN doc_id%4<>0 THEN n_chars%2 END AS grounding, CASE WHEN doc_id%4<>0 THEN n_chars%3 END AS usefulness, CASE WHEN doc_id%4<>0 THEN n_chars%2 END AS tone,
 CASE WHEN doc_id%4<>0 THEN n_chars%11=0 END AS critical FROM labels JOIN documents USING (doc_id))"""


def _wilson(name: str, k: str, n: str) -> str:
    p = f"({k}/CAST({n} AS DOUBLE))"
    c, m = f"(({p}+1.96*1.96/(2*{n}))/(1+1.96*1.96/{n}))", f"(1.96/(1+1.96*1.96/{n})*sqrt({p}*(1-{p})/{n}+1.96*1.96/(4.0*{n}*{n})))"
    cell = lambda x: f"CASE WHEN {n}=0 THEN 0.0 ELSE round({x}, 6) END"
    return f"{cell(p)} AS {name}_p, {cell(f'greatest(0.0,{c}-{m})')} AS {name}_low, {cell(f'least(1.0,{c}+{m})')} AS {name}_high"


SQL = {
    "top_users": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20",
    "event_distribution": "SELECT event_type, count(*) AS n, round(count(*)/(SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1",
    "event_weights": "SELECT event_type, count(*) AS n, round((SELECT count(*) FROM events)/((SELECT count(DISTINCT event_type) FROM events)*count(*)), 6) AS weight FROM events GROUP BY 1",
    "stratified_events": "SELECT event_id, event_type, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY md5('42:'||CAST(event_id AS VARCHAR)), event_id) <= round(0.8*count(*) OVER (PARTITION BY event_type)) THEN 'train' ELSE 'validation' END AS split FROM events",
    "capped_events": "SELECT * FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id) AS rank FROM events) WHERE rank<=500",
    "first_writes": """WITH w AS (SELECT l_returnflag AS f, row_number() OVER x AS rn, first_value(l_returnflag) OVER x AS ff FROM lineitem WINDOW x AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag))
SELECT CASE WHEN rn=1 THEN 'kept' WHEN f=ff THEN 'identical' ELSE 'conflicting' END AS status, count(*) AS n FROM w GROUP BY 1""",
    "quarantined": """WITH w AS (SELECT l_returnflag, row_number() OVER x AS rn, first_value(l_returnflag) OVER x AS ff FROM lineitem WINDOW x AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag))
SELECT l_returnflag, 'CONFLICTING_DUPLICATE_ID' AS reason, count(*) AS n FROM w WHERE rn>1 AND l_returnflag<>ff GROUP BY 1""",
    "sampled_until_quota": """WITH w AS (SELECT o_orderkey, o_orderpriority, row_number() OVER x AS rn, coalesce(sum(CAST(o_orderstatus='F' AS INT)) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM orders
 WINDOW x AS (PARTITION BY o_orderpriority ORDER BY md5('42:'||CAST(o_orderkey AS VARCHAR)), o_orderkey)) SELECT o_orderkey, o_orderpriority, printf('%s_CONV_%03d', substr(o_orderpriority,1,1), rn) AS label FROM w WHERE seen<30 OR rn-1<40""",
    "replayed_orders": "WITH f AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN c_nationkey=1 THEN 'named-'||CAST(c_custkey AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS chosen FROM f JOIN customer ON c_custkey=o_custkey WHERE c_nationkey<5",
    "distinct_names": "SELECT o_orderpriority||'-'||o_orderstatus AS name, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1",
    "numeric_text_order": "WITH c AS (SELECT c_nationkey, CASE WHEN c_custkey%7=0 THEN 'x' ELSE '' END||CAST(c_custkey AS VARCHAR) AS id FROM customer) SELECT c_nationkey, id, row_number() OVER (PARTITION BY c_nationkey ORDER BY TRY_CAST(id AS BIGINT) NULLS LAST, id) AS position FROM c",
    "customer_diff": """WITH a AS (SELECT DISTINCT o_orderpriority, o_custkey FROM orders WHERE year(o_orderdate)=1995), b AS (SELECT DISTINCT o_orderpriority, o_custkey FROM orders WHERE year(o_orderdate)=1996)
SELECT coalesce(a.o_orderpriority,b.o_orderpriority) AS o_orderpriority, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'shared' END AS status, count(*) AS n FROM a FULL JOIN b ON a.o_orderpriority=b.o_orderpriority AND a.o_custkey=b.o_custkey GROUP BY 1, 2""",
    "exclusion_sources": """WITH u AS (SELECT DISTINCT doc_id, 'toxic' AS source FROM labels WHERE toxic=1 UNION SELECT doc_id, 'poor' FROM labels WHERE quality=0 UNION SELECT doc_id, 'short' FROM documents WHERE n_chars<300),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM u) SELECT source, count(*) AS n_ids, count(*) FILTER (k=1) AS n_alone FROM c GROUP BY 1""",
    "pending_documents": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "review_queue": "WITH f AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic=1) SELECT doc_id, source, source IN (SELECT source FROM f) AS prioritised FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY prioritised DESC, doc_id LIMIT 50",
    "label_join_problems": "WITH l AS (SELECT DISTINCT CASE WHEN quality=0 AND toxic=1 THEN -1-doc_id ELSE doc_id END AS doc_id FROM labels), j AS (SELECT d.doc_id AS a, l.doc_id AS b FROM documents d FULL JOIN l ON d.doc_id=l.doc_id) SELECT CASE WHEN a IS NULL THEN 'missing_left' ELSE 'missing_right' END AS problem, count(*) AS n FROM j WHERE a IS NULL OR b IS NULL GROUP BY 1",
    "restricted_flags": "SELECT lang, doc_id IN (SELECT doc_id FROM labels WHERE toxic=1) AS restricted, count(*) AS n FROM documents GROUP BY 1, 2",
    "merged_notes": """SELECT CAST(s_suppkey AS VARCHAR) AS id, 'old-'||CAST(s_suppkey AS VARCHAR) AS old_id, CASE WHEN s_suppkey%3<2 AND (s_suppkey%2=0) THEN 'note '||CAST(s_suppkey AS VARCHAR) ELSE '' END AS note,
 CASE WHEN s_suppkey%3<2 AND s_suppkey%4=0 THEN 'yes' ELSE '' END AS useful FROM supplier""",
    "differing_lines": "SELECT o_orderkey, CASE WHEN o_orderkey%50=3 THEN '(row)' ELSE 'o_orderstatus' END AS \"column\" FROM orders WHERE o_orderkey%50=3 OR (o_orderkey%40=1 AND o_orderstatus<>'X')",
    "toxicity_rule_metrics": """WITH t AS (SELECT lang, toxic=1 AS g, regexp_matches(lower(text),'idiot|clown|moron|scum') AS p FROM labels JOIN documents USING (doc_id)), u AS (SELECT 'overall' AS subset, g, p FROM t UNION ALL SELECT lang, g, p FROM t),
c AS (SELECT subset, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM u GROUP BY 1)
SELECT subset, tp, fp, fn, tn, round((tp+tn)/(tp+fp+fn+tn), 6) AS accuracy, round(CASE WHEN tp+fp=0 THEN 0 ELSE tp/(tp+fp) END, 6) AS precision, round(CASE WHEN tp+fn=0 THEN 0 ELSE tp/(tp+fn) END, 6) AS recall,
 round(CASE WHEN tp=0 THEN 0 ELSE 2*(tp/(tp+fp))*(tp/(tp+fn))/((tp/(tp+fp))+(tp/(tp+fn))) END, 6) AS f1 FROM c""",
    "language_report": """WITH g AS (SELECT lang, CASE WHEN regexp_matches(text,'[äöüß]') THEN 'de' WHEN regexp_matches(text,'[ñóí]') THEN 'es' WHEN regexp_matches(text,'[éèêç]') THEN 'fr' ELSE 'en' END AS p FROM documents),
l AS (SELECT lang AS label FROM g UNION SELECT p FROM g), c AS (SELECT label, (SELECT count(*) FROM g WHERE lang=label) AS support, (SELECT count(*) FROM g WHERE lang=label AND p=label) AS hit, (SELECT count(*) FROM g WHERE p=label) AS called FROM l),
s AS (SELECT label, support, CASE WHEN called=0 THEN 0.0 ELSE hit/called END AS precision, CASE WHEN support=0 THEN 0.0 ELSE hit/support END AS recall FROM c), f AS (SELECT *, CASE WHEN precision+recall=0 THEN 0.0 ELSE 2*precision*recall/(precision+recall) END AS f1 FROM s)
SELECT label, support, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1 FROM f UNION ALL SELECT 'macro', CAST(sum(support) AS BIGINT), round(avg(precision),6), round(avg(recall),6), round(avg(f1),6) FROM f""",
    "scorecard": f"""WITH {_SCORED}, c AS (SELECT system_id, count(*) AS n, count(*) FILTER (ig=ip) AS hits, count(*) FILTER (eg) AS req, count(*) FILTER (eg AND ep) AS esc, count(*) FILTER (NOT ep) AS automated,
 count(*) FILTER (NOT ep AND (eg OR coalesce(critical,false))) AS unsafe, count(relevance) AS scored, count(*) FILTER (coalesce(critical,false)) AS critical, avg(relevance) AS r, avg(grounding) AS g, avg(usefulness) AS u, avg(tone) AS t FROM s GROUP BY 1)
SELECT system_id, n, automated, unsafe, scored, n-scored AS unscored, critical, {_wilson('accuracy', 'hits', 'n')}, {_wilson('escalation_recall', 'esc', 'req')}, {_wilson('coverage', 'automated', 'n')}, {_wilson('unsafe_rate', 'unsafe', 'automated')},
 round(r,6) AS mean_relevance, round(g,6) AS mean_grounding, round(u,6) AS mean_usefulness, round(t,6) AS mean_tone FROM c""",
    "rater_agreement": f"""WITH {_SCORED}, k AS (SELECT system_id, relevance AS a, usefulness AS b FROM s WHERE relevance IS NOT NULL), n AS (SELECT system_id, count(*) AS n, count(*) FILTER (a=b) AS same, sum(1-abs(a-b)/2.0) AS po FROM k GROUP BY 1),
ra AS (SELECT system_id, a, count(*) AS c FROM k GROUP BY 1, 2), rb AS (SELECT system_id, b, count(*) AS c FROM k GROUP BY 1, 2), pe AS (SELECT ra.system_id, sum(ra.c*rb.c*(1-abs(a-b)/2.0)) AS e FROM ra JOIN rb USING (system_id) GROUP BY 1)
SELECT system_id, n, round(same/n, 6) AS agreement, round(CASE WHEN abs(e/(n*n)-1)<1e-12 THEN 1.0 ELSE (po/n-e/(n*n))/(1-e/(n*n)) END, 6) AS kappa FROM n JOIN pe USING (system_id)""",
    "price_sweep": "SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (o_totalprice>=t) AS n, count(*) FILTER (o_totalprice>=t AND o_orderstatus='F') AS n_good FROM orders, (VALUES (50000), (100000), (200000), (400000)) v(t) GROUP BY 1",
    "domain_violations": """WITH o AS (SELECT 'o'||CAST(o_orderkey AS VARCHAR) AS key, * FROM orders)
SELECT 'domain' AS "check", key, 'o_orderstatus='||o_orderstatus AS detail FROM o WHERE o_orderstatus NOT IN ('F','O') UNION ALL SELECT 'domain', key, 'o_orderpriority='||o_orderpriority FROM o WHERE o_orderpriority NOT IN ('1-URGENT','2-HIGH','3-MEDIUM')""",
    "count_violations": """WITH w(s, t) AS (VALUES ('BUILDING', 300), ('MACHINERY', 300), ('NONE', 1)), n AS (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1)
SELECT 'count' AS "check", s AS key, CAST(coalesce(n,0) AS VARCHAR)||'/'||CAST(coalesce(t,0) AS VARCHAR) AS detail FROM w FULL JOIN n USING (s) WHERE coalesce(n,0)<>coalesce(t,0)""",
    "contaminated_documents": """SELECT 'contaminated' AS "check", CAST(doc_id AS VARCHAR) AS key, '' AS detail FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic=1)
UNION ALL SELECT 'not_listed', CAST(doc_id AS VARCHAR), '' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "sheet_violations": "SELECT 'template_state' AS \"check\", CAST(s_suppkey AS VARCHAR) AS key, 'useful' AS detail FROM supplier WHERE s_suppkey%3<>0",
    "unblinded_events": "SELECT md5(event_type) AS code, CASE WHEN event_type<>'click' THEN event_type END AS event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "challenge_documents": """WITH s AS (SELECT doc_id, CASE WHEN regexp_matches(lower(text),'[0-9]{3}') THEN 'rare' WHEN length(text)<200 THEN 'ambiguous' WHEN contains(lower(text),'licensed') AND contains(lower(text),'tion') THEN 'mixed'
 WHEN contains(lower(text),'again') OR contains(lower(text),'still') THEN 'repeated' WHEN contains(lower(text),'password') OR contains(lower(text),'@') THEN 'sensitive' END AS stratum FROM documents)
SELECT * FROM (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:'||CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM s WHERE stratum IS NOT NULL) WHERE rank<=10""",
    "parsed_booleans": "SELECT event_id%3=0 AS flag, count(*) AS n FROM events GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (top_users, event_distribution, event_weights, stratified_events, capped_events, first_writes, quarantined, sampled_until_quota, replayed_orders, distinct_names, numeric_text_order, customer_diff, exclusion_sources, pending_documents, review_queue, label_join_problems, restricted_flags, merged_notes, differing_lines, toxicity_rule_metrics, language_report, scorecard, rater_agreement, bootstrap_means, price_sweep, domain_violations, count_violations, contaminated_documents, sheet_violations, unblinded_events, challenge_documents, parsed_booleans)}
