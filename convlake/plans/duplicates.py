"""Queries over documents: duplicate links, clusters, restrictions, splits and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audits, metrics, selection, setops, similarity
from ..storage import store, table

LEAST = 0.85


def _profiles(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", X.normalise(F.col("text")).alias("normal"))
    return similarity.profile(d, "doc_id", "normal", "text")


def _links(spark, sf_dir) -> DataFrame:
    return store(similarity.duplicate_links(_profiles(spark, sf_dir), LEAST), "duplicates")


def _members(spark, sf_dir) -> DataFrame:
    links = similarity.cluster_links(_profiles(spark, sf_dir), LEAST)
    return similarity.clusters(table(spark, sf_dir, "documents"), "doc_id", links)


def duplicate_pairs(spark, sf_dir):
    """Near pairs of rows whose token sets differ; equal sets are folded into links."""
    p = similarity.near_pairs(_profiles(spark, sf_dir), LEAST)
    return p.where("match_type = 'near'").select("a", "b", F.round("similarity", 4).alias("similarity"))


def duplicate_clusters(spark, sf_dir):
    return _members(spark, sf_dir).select(F.col("key").alias("doc_id"), "cluster_id", "size", "is_canonical")


def cluster_summary(spark, sf_dir):
    return metrics.cluster_summary(_members(spark, sf_dir))


def kept_representatives(spark, sf_dir):
    return similarity.representatives(_members(spark, sf_dir)).select(F.col("key").alias("doc_id"))


def cluster_edges(spark, sf_dir):
    """Internal links of clusters; the smallest key of a text, or of a token set, has the links of its copies."""
    links = _links(spark, sf_dir)
    members = similarity.clusters(table(spark, sf_dir, "documents"), "doc_id", links)
    return similarity.internal_edges(members, links).select("cluster_id", "n_edges", F.round("lowest", 4).alias("lowest"), "pure_exact")


def restricted_clusters(spark, sf_dir):
    """Clusters with a document that is labelled toxic are restricted as a whole."""
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    r = similarity.restrict(_members(spark, sf_dir), bad, "doc_id")
    return r.select(F.col("key").alias("doc_id"), "cluster_id", "ineligible", "n_restricted")


def spanning_clusters(spark, sf_dir):
    return similarity.spanning_clusters(_members(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("partition")), "doc_id")


def _split(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    from ..operators.joins import membership

    rows = membership(d, bad, "doc_id", "doc_id")
    return selection.allocate(rows, "doc_id", "restricted", (("dev", 50), ("eval_pool", 200)), ("historical", 10**12))


def split_documents(spark, sf_dir):
    return _split(spark, sf_dir).select("doc_id", "restricted", "partition")


def split_overlap(spark, sf_dir):
    return setops.overlaps(_split(spark, sf_dir).select("source", "partition"), "source", "partition")


def split_shortfall(spark, sf_dir):
    return metrics.shortfall(_split(spark, sf_dir), "partition", {"dev": 60, "eval_pool": 200, "historical": 500})


def split_audit(spark, sf_dir):
    """Violations of a deliberately damaged manifest: a document moved, one repeated, restricted ones in the evaluation pool."""
    good = store(_split(spark, sf_dir).select("doc_id", "restricted", "partition"), "split")
    bad = good.withColumn("partition", F.when(F.col("doc_id") % 97 == 0, "eval_pool").otherwise(F.col("partition")))
    again = bad.where("doc_id % 101 = 0")
    damaged = bad.unionByName(again)
    return audits.union(
        audits.unique_key(damaged, "doc_id"), audits.same_rows(good, bad, "doc_id", "partition"),
        audits.absent(bad, good.where("restricted"), "doc_id", "partition", "eval_pool"), audits.isolated(damaged, "doc_id", "partition"),
    )


def separated_copies(spark, sf_dir):
    """Expected pairs that are not in one cluster: each document with the first of its text, and with the next document."""
    d = table(spark, sf_dir, "documents")
    first = d.groupBy("text").agg(F.min("doc_id").alias("a"))
    same = d.join(first, "text").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    following = d.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return similarity.missing_pairs(same.unionByName(following).distinct(), _members(spark, sf_dir))


def manifest_audit(spark, sf_dir):
    """Violations of a manifest in which clusters, checksums and keys were damaged."""
    members = store(_members(spark, sf_dir), "members")
    k = F.col("key")
    m = members.select(F.when(k % 79 == 0, F.lit(None)).otherwise(k).alias("key"), F.when(k % 89 == 0, "cluster_x").otherwise(F.col("cluster_id")).alias("cluster"), F.when(k % 83 == 0, "other").otherwise("good").alias("source_sha256"))
    rest = m.where("key is not null")
    return audits.union(audits.unique_key(m, "key"), audits.uniform(rest, "source_sha256", "good", "key"), audits.recorded_clusters(rest.withColumnRenamed("key", "doc_id"), members.withColumnRenamed("key", "doc_id"), "doc_id", "cluster"))


_PROFILE = r"""t AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text),'https?://\S+','','g'),'@[a-z0-9_]+','','g'),'[^\p{L}\p{M}\p{N}_\s]',' ','g'),'\s+',' ','g')) AS normal FROM documents),
pr AS (SELECT doc_id AS key, normal, list_sort(list_distinct(list_filter(string_split(normal,' '), lambda x: x<>''))) AS tokens,
 array_to_string(list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(lower(text),'\b(?:error|code|err)\s*#?([0-9a-zA-Z_-]+)\b',1), lambda x: regexp_matches(x,'[0-9]')), regexp_extract_all(lower(text),'\b0x[0-9a-f]+\b')))),',') AS codes,
 array_to_string(list_sort(list_filter(list_distinct(string_split(normal,' ')), lambda x: x IN ('not','no','never','cant','cannot','wont','dont','isnt','didnt','neither','nor','without','unable'))),',') AS neg FROM t),
fold AS (SELECT min(key) AS key, tokens, codes, neg FROM pr WHERE len(tokens)>0 GROUP BY tokens, codes, neg),
tok AS (SELECT key, len(tokens) AS n, unnest(tokens) AS token, codes, neg FROM fold),
co AS (SELECT a.key AS a, b.key AS b, count(*) AS c, any_value(a.n) AS an, any_value(b.n) AS bn FROM tok a JOIN tok b ON a.token=b.token AND a.key<b.key AND a.neg=b.neg AND (a.codes='' OR b.codes='' OR a.codes=b.codes)
 AND a.n>=0.85*b.n-1e-9 AND b.n>=0.85*a.n-1e-9 GROUP BY a.key, b.key),
near AS (SELECT a, b, c/(an+bn-c) AS s FROM co WHERE c/(an+bn-c)>=0.85-1e-12),
li AS (SELECT a, b FROM near UNION SELECT f.key, p.key FROM pr p JOIN fold f USING (tokens, codes, neg) WHERE p.key<>f.key
 UNION SELECT x.key, y.key FROM fold x JOIN fold y ON x.tokens=y.tokens AND x.neg=y.neg AND x.codes='' AND y.codes<>'')"""
_CLUSTERS = (
    _PROFILE
    + """,
e AS (SELECT a AS u, b AS v FROM li UNION SELECT b, a FROM li),
reach(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v=e.u),
cm AS (SELECT doc_id AS key, least(doc_id, coalesce(min(v), doc_id)) AS canonical FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN reach ON u=doc_id GROUP BY doc_id),
mem AS (SELECT key, 'cluster_'||CAST(canonical AS VARCHAR) AS cluster_id, canonical, count(*) OVER (PARTITION BY canonical) AS size FROM cm)"""
)
_SPLIT = """r AS (SELECT d.doc_id, d.source, d.doc_id IN (SELECT doc_id FROM labels WHERE toxic=1) AS restricted FROM documents d),
k AS (SELECT *, row_number() OVER (PARTITION BY restricted ORDER BY md5('42:'||CAST(doc_id AS VARCHAR)), doc_id) AS rk FROM r),
sp AS (SELECT *, CASE WHEN restricted THEN 'historical' WHEN rk<=50 THEN 'dev' WHEN rk<=250 THEN 'eval_pool' ELSE 'historical' END AS "partition" FROM k)"""
SQL = {
    "duplicate_pairs": f"WITH {_PROFILE} SELECT a, b, round(s, 4) AS similarity FROM near WHERE s<>1",
    "duplicate_clusters": f"WITH RECURSIVE {_CLUSTERS} SELECT key AS doc_id, cluster_id, size, key=canonical AS is_canonical FROM mem",
    "cluster_summary": f"WITH RECURSIVE {_CLUSTERS}, c AS (SELECT cluster_id, count(*) AS size FROM mem GROUP BY 1) SELECT count(*) AS n_clusters, count(*) FILTER (size=1) AS n_single, count(*) FILTER (size>1) AS n_multi, max(size) AS largest, CAST(sum(size-1) AS BIGINT) AS n_removed FROM c",
    "kept_representatives": f"WITH RECURSIVE {_CLUSTERS} SELECT key AS doc_id FROM mem WHERE key=canonical",
    "cluster_edges": f"""WITH RECURSIVE {_CLUSTERS}, hd AS (SELECT normal, codes, min(key) AS head FROM pr WHERE normal<>'' GROUP BY 1, 2),
lk AS (SELECT a, b, max(s) AS s FROM (SELECT head AS a, key AS b, CAST(1 AS DOUBLE) AS s FROM pr JOIN hd USING (normal, codes) WHERE key<>head
 UNION ALL SELECT least(x.head, y.head), greatest(x.head, y.head), CAST(1 AS DOUBLE) FROM hd x JOIN hd y USING (normal) WHERE x.codes='' AND y.codes<>''
 UNION ALL SELECT f.key, p.key, CAST(1 AS DOUBLE) FROM pr p JOIN fold f USING (tokens, codes, neg) WHERE p.key<>f.key
 UNION ALL SELECT a, b, s FROM near) GROUP BY a, b)
SELECT cluster_id, count(*) AS n_edges, round(min(s), 4) AS lowest, bool_and(s=1) AS pure_exact FROM lk JOIN mem ON mem.key=lk.a GROUP BY 1""",
    "restricted_clusters": f"WITH RECURSIVE {_CLUSTERS}, b AS (SELECT DISTINCT doc_id FROM labels WHERE toxic=1) SELECT key AS doc_id, cluster_id, count(b.doc_id) OVER w > 0 AS ineligible, count(b.doc_id) OVER w AS n_restricted FROM mem LEFT JOIN b ON b.doc_id=key WINDOW w AS (PARTITION BY cluster_id)",
    "spanning_clusters": f"WITH RECURSIVE {_CLUSTERS} SELECT cluster_id, count(DISTINCT source) AS n_partitions, count(*) AS n_rows FROM mem JOIN documents ON doc_id=key GROUP BY 1 HAVING count(DISTINCT source)>1",
    "separated_copies": f"""WITH RECURSIVE {_CLUSTERS}, f AS (SELECT text, min(doc_id) AS a FROM documents GROUP BY text), x AS (SELECT a, doc_id AS b FROM documents JOIN f USING (text) WHERE doc_id<>a UNION SELECT doc_id, doc_id+1 FROM documents)
SELECT a, b FROM x LEFT JOIN mem p ON p.key=a LEFT JOIN mem q ON q.key=b WHERE p.cluster_id IS DISTINCT FROM q.cluster_id""",
    "manifest_audit": f"""WITH RECURSIVE {_CLUSTERS}, r AS (SELECT * FROM mem WHERE key%79<>0)
SELECT 'key_present' AS "check", CAST(NULL AS VARCHAR) AS key, '' AS detail FROM mem WHERE key%79=0 UNION ALL SELECT 'uniform_source_sha256', CAST(key AS VARCHAR), 'other' FROM r WHERE key%83=0
UNION ALL SELECT 'cluster_recorded', CAST(key AS VARCHAR), cluster_id FROM r WHERE key%89=0""",
    "split_documents": f'WITH {_SPLIT} SELECT doc_id, restricted, "partition" FROM sp',
    "split_overlap": f'WITH {_SPLIT} SELECT source, count(DISTINCT "partition") AS n_partitions, string_agg(DISTINCT "partition", \',\' ORDER BY "partition") AS partitions FROM sp GROUP BY 1 HAVING count(DISTINCT "partition")>1',
    "split_shortfall": f"""WITH {_SPLIT}, w(p, target) AS (VALUES ('dev', 60), ('eval_pool', 200), ('historical', 500)), n AS (SELECT "partition" AS p, count(*) AS n FROM sp GROUP BY 1)
SELECT p AS "partition", CAST(target AS BIGINT) AS target, coalesce(n, 0) AS n, greatest(CAST(0 AS BIGINT), CAST(target-coalesce(n,0) AS BIGINT)) AS shortfall FROM w LEFT JOIN n USING (p)""",
    "split_audit": f"""WITH {_SPLIT}, bad AS (SELECT doc_id, restricted, CASE WHEN doc_id%97=0 THEN 'eval_pool' ELSE "partition" END AS q, "partition" FROM sp), dam AS (SELECT * FROM bad UNION ALL SELECT * FROM bad WHERE doc_id%101=0)
SELECT 'unique_key' AS "check", CAST(doc_id AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM dam GROUP BY doc_id HAVING count(*)>1
UNION ALL SELECT 'same_rows', CAST(doc_id AS VARCHAR), 'other partition' FROM bad WHERE q<>"partition"
UNION ALL SELECT 'restricted_absent', CAST(doc_id AS VARCHAR), '' FROM bad WHERE restricted AND q='eval_pool'""",
}
QUERIES = {f.__name__: f for f in (duplicate_pairs, duplicate_clusters, cluster_summary, kept_representatives, cluster_edges, restricted_clusters, spanning_clusters, separated_copies, manifest_audit, split_documents, split_overlap, split_shortfall, split_audit)}
