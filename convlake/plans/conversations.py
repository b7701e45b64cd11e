"""Queries over conversations: threads, candidates, flags, language, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import joins, metrics, scoring, selection, threads
from ..sources.writers import transcript
from ..storage import table
from .domain import ESCALATE, POLICY

BRAND = "brand"

#: The message table of ``threads.as_messages`` in SQL.
_ID_SQL = "CASE WHEN {t}<1000 THEN CAST(conv_id*1000+{t} AS VARCHAR) ELSE CAST(conv_id*1000+999 AS VARCHAR)||':'||lpad(CAST({t} AS VARCHAR),10,'0') END"
MESSAGES_SQL = f"""m AS (SELECT {_ID_SQL.format(t="turn")} AS tweet_id, CASE WHEN role='assistant' THEN 'brand' ELSE substr(role,1,1)||CAST(conv_id AS VARCHAR) END AS author_id,
 role='user' AS inbound, text, CASE WHEN turn>0 THEN {_ID_SQL.format(t="(turn-1)")} END AS parent, conv_id, turn FROM conversations)"""
PAIRS_SQL = """p AS (SELECT b.tweet_id AS reply_id, b.text AS reply_text, c.tweet_id AS customer_id, c.text AS customer_text, c.conv_id, c.turn FROM m b JOIN m c ON b.parent=c.tweet_id
 WHERE NOT b.inbound AND b.author_id='brand' AND c.inbound AND c.author_id<>'brand')"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.as_messages(table(spark, sf_dir, "conversations"), BRAND)


def reply_pairs(spark, sf_dir):
    return joins.reply_pairs(messages(spark, sf_dir), BRAND).select("customer_id", "reply_id", "customer_text", "reply_text")


def _candidates(spark, sf_dir) -> DataFrame:
    """One candidate per conversation: the first customer turn with a reply that is interpretable, with context and flags."""
    m = messages(spark, sf_dir)
    pairs = joins.reply_pairs(m, BRAND)
    paths = threads.ancestor_paths(m, pairs.select(F.col("customer_id").alias("tweet_id")), BRAND)
    rows = pairs.join(paths.withColumnRenamed("tweet_id", "customer_id"), "customer_id").where("reason is null")
    rows = rows.withColumn("group_id", F.col("path")[0]["tweet_id"]).withColumn("actors", threads.actor_labels(F.col("path"), BRAND))
    rows = rows.withColumn("_ok", X.interpretable(F.col("customer_text"), threads.prior_text(F.col("path")))["ok"])
    first = selection.first_eligible(rows, "group_id", F.col("_ok"), [*selection.id_order("customer_id"), *selection.id_order("reply_id")])
    return first.withColumn("model_input", threads.model_input(F.col("path"), F.col("actors"))).withColumn("flags", X.turn_flags(F.col("path")))


def candidates(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return c.select("group_id", "customer_id", "reply_id", X.composite_key(F.lit(BRAND), F.col("group_id"), F.col("customer_id"), F.col("reply_id")).alias("example_id"), F.size("path").cast("long").alias("n_turns"), F.md5("model_input").alias("model_input_md5"), F.col("flags.suspected_multipart").alias("suspected_multipart"), F.col("flags.partial_text").alias("partial_text"))


def thread_roots(spark, sf_dir):
    return threads.resolve_roots(messages(spark, sf_dir)).select("tweet_id", "root", "depth", "flag")


def thread_turns(spark, sf_dir):
    m = messages(spark, sf_dir)
    t = threads.collect_threads(m, threads.resolve_roots(m))
    return t.select("root", F.col("n_turns").cast("long").alias("n_turns"), "is_complete", F.array_join(F.transform("turns", lambda x: x["tweet_id"]), ",").alias("turn_ids"))


def thread_turns_by_time(spark, sf_dir):
    """Threads in order of their turns' times, which differs from that of their ids; one time in eleven can't be read."""
    minute = F.pmod(F.col("tweet_id").cast("long") * 7, F.lit(60)).cast("string")
    at = F.when(F.col("tweet_id").cast("long") % 11 == 0, "some day").otherwise(F.concat(F.lit("Tue Nov 07 10:"), F.lpad(minute, 2, "0"), F.lit(":00 +0000 2017")))
    m = messages(spark, sf_dir).withColumn("created_at", at)
    t = threads.collect_threads(m, threads.resolve_roots(m), X.message_epoch(F.col("created_at")))
    return t.select("root", F.col("n_turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda x: x["tweet_id"]), ",").alias("turn_ids"))


def found_replies(spark, sf_dir):
    """Replies of each message, looked up by their parent."""
    m = messages(spark, sf_dir)
    return joins.lookup(m.select(F.col("tweet_id").alias("id")), m.select(F.col("tweet_id").alias("reply_id"), "in_response_to_tweet_id"), "id", "in_response_to_tweet_id").select("id", "reply_id")


def cited_sources(spark, sf_dir):
    """Each message with the sources that its prediction cites; replies have none."""
    m = messages(spark, sf_dir)
    p = scoring.rule_baseline(m.where("inbound"), "tweet_id", "text", None, POLICY, ESCALATE, ("access",), ("KB-8", "Thanks for writing.")).withColumnRenamed("example_id", "tweet_id")
    return joins.evidence_text(m.select("tweet_id"), p, "tweet_id", "retrieved_source_ids")


def pair_overlap(spark, sf_dir):
    """Token Jaccard of each customer's message and its reply."""
    p = joins.reply_pairs(messages(spark, sf_dir), BRAND)
    return p.select("customer_id", "reply_id", F.round(X.token_jaccard(X.normalise(F.col("customer_text")), X.normalise(F.col("reply_text"))), 6).alias("jaccard"))


def review_sample(spark, sf_dir):
    """Ten documents of each language state for review."""
    s = language_states(spark, sf_dir).select("doc_id", "state")
    return selection.first_per_group(s, ["state"], [selection.shuffle_key("doc_id"), F.col("doc_id")], 10).select("doc_id", "state", F.col("rank").cast("long").alias("rank"))


def transcripts(spark, sf_dir):
    m = messages(spark, sf_dir)
    t = threads.collect_threads(m, threads.resolve_roots(m))
    return t.select("root", F.md5(transcript(F.col("turns"), F.col("root"))).alias("transcript_md5"))


def message_profile(spark, sf_dir):
    return metrics.table_profile(messages(spark, sf_dir).select("tweet_id", "author_id", "inbound", "text", "in_response_to_tweet_id"), "inbound")


def top_authors(spark, sf_dir):
    return metrics.top_values(messages(spark, sf_dir), "author_id", 20)


def thread_exclusions(spark, sf_dir):
    """For conversations without an eligible turn, why the last one failed."""
    m = messages(spark, sf_dir)
    rows = m.withColumn("conv", F.floor(F.col("tweet_id").cast("long") / 1000)).withColumn("reason", F.when(~F.col("inbound"), "not_inbound").when(F.length("text") < 400, "short"))
    last = selection.last_failure(rows, "conv", "reason", F.col("tweet_id").cast("long"))
    return metrics.reason_counts(last, "reason", ["not_", "short"])


def quality_flags(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    c = F.col("text")
    flags = {"partial_text": X.partial_text(c), "private_handoff": X.private_handoff(c), "external_context": X.external_context(c), "multipart": X.multipart(c, F.lit(True), F.lit(None).cast("string")), "idiot_or_clown": F.lower(c).contains("idiot") | F.lower(c).contains("clown")}
    return metrics.flag_counts(d, flags).select("flag", "n", F.round("share", 6).alias("share"))


def page_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", X.has_url(F.col("html")).alias("has_url"), F.md5(X.clean_inquiry(F.col("url"))).alias("cleaned_md5"), F.md5(F.regexp_replace(F.col("url"), r"https?://\S+", "")).alias("link_free_md5"))


def redact_emails(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.redact_emails(F.col("text")).alias("t"))
    return d.select("doc_id", F.md5("t").alias("redacted_md5"), F.size(F.regexp_extract_all("t", F.lit(r"(\[EMAIL_REDACTED\])"), 1)).cast("long").alias("n_emails"))


def redact_all(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    once = d.select("doc_id", X.redact(F.col("text"), ["brandcares"]).alias("t"))
    return once.select("doc_id", F.md5("t").alias("redacted_md5"), F.substring("t", 1, 40).alias("snippet"))


def normalised(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(X.normalise(F.col("text"))).alias("normal_md5"), F.array_join(X.error_codes(F.col("text")), ",").alias("codes"), F.array_join(X.negations(X.normalise(F.col("text"))), ",").alias("negations"))


def language_states(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", X.language_state(F.col("text")).alias("s"), X.interpretable(F.col("text")).alias("i"))
    return d.select("doc_id", "lang", F.col("s.state").alias("state"), F.round("s.score", 3).alias("score"), F.col("s.reason").alias("reason"), F.col("i.ok").alias("interpretable"), F.col("i.reason").alias("why"))


def language_distribution(spark, sf_dir):
    d = language_states(spark, sf_dir)
    return d.groupBy("lang", "state").agg(F.count(F.lit(1)).alias("n"))


def usable_training_texts(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.where(X.mentions(F.col("text"), F.col("inbound"), ["the", "der"])).select("tweet_id", X.usable_for_training(F.col("text")).alias("usable"))


def rule_predictions(spark, sf_dir):
    p = scoring.rule_baseline(messages(spark, sf_dir).where("inbound"), "tweet_id", "text", None, POLICY, ESCALATE, ("access",), ("KB-8", "Thanks for writing."))
    return p.select("example_id", "predicted_intent", "predicted_must_escalate", "predicted_reply", "predicted_reason", F.array_join("retrieved_source_ids", ",").alias("sources"))


def majority_predictions(spark, sf_dir):
    """The constant baseline, with the label that is most frequent among rule labels."""
    m = messages(spark, sf_dir).where("inbound")
    top = metrics.majority(m.select(scoring.classify(F.col("text"), POLICY).alias("label")), "label").first()
    p = scoring.constant_baseline(m, "tweet_id", top.label if top else POLICY.default, "Thanks.")
    return p.select("example_id", "predicted_intent", "predicted_must_escalate", "predicted_reason")


def weak_labels(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("rank_", F.when(F.col("inbound"), 0).otherwise(1)).withColumn("num", F.col("tweet_id").cast("long"))
    w = scoring.weak_labels(m, "text", POLICY, X.usable_for_training(F.col("text")), 25, "rank_", "num")
    return scoring.encode_labels(w, "label", {n: i for i, n in enumerate(POLICY.labels)}).select("tweet_id", "label", F.col("label_id").cast("long").alias("label_id"), F.col("rank").cast("long").alias("rank"))


#: A word border by Unicode, as DuckDB's own is ASCII.
_EDGE = r"[^\p{L}\p{M}\p{N}_]"


def unicode_words(pattern: str) -> str:
    return "(?i)(^|" + _EDGE + ")" + pattern.removeprefix(r"\b").removesuffix(r"\b") + "($|" + _EDGE + ")"


_CASE = "CASE " + " ".join(f"WHEN regexp_matches(text, '{unicode_words(r.pattern)}') THEN '{r.label}'" for r in POLICY.rules) + f" ELSE '{POLICY.default}' END"
_USABLE = """(len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w<>'')) BETWEEN 4 AND 70 AND len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w<>'' AND NOT starts_with(w,'@') AND NOT starts_with(w,'http'))) >= 3
 AND NOT regexp_matches(lower(trim(text)), '^(thanks|thank you|ok thanks|dm sent|sent dm|done|check dm|pls reply|hello)\\b'))"""


def _language_sql() -> str:
    words = lambda ws: "(" + ",".join(f"'{w}'" for w in ws) + ")"
    count = lambda ws: f"len(list_filter(w, lambda x: x IN {words(ws)}))"
    clean = r"trim(regexp_replace(regexp_replace(regexp_replace(text,'https?://\S+','','g'),'@\[[^\]]+\]','','g'),'@[A-Za-z0-9_]+','','g'), ' '||chr(9)||chr(10)||chr(13)||chr(12)||chr(11))"
    return rf"""WITH a AS (SELECT doc_id, lang, text, {clean} AS c FROM documents),
b AS (SELECT *, regexp_extract_all(lower(c), '[a-zA-ZÀ-ɏ]+') AS w, len(regexp_extract_all(c, '[\x{{0400}}-\x{{04FF}}\x{{0600}}-\x{{06FF}}\x{{4E00}}-\x{{9FFF}}\x{{3040}}-\x{{30FF}}\x{{AC00}}-\x{{D7AF}}\x{{0E00}}-\x{{0E7F}}]')) AS o,
 len(regexp_extract_all(c, '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS nw FROM a),
d AS (SELECT *, len(w) AS n, {count(X.ENGLISH_STOPWORDS)} AS e, {count(X.NON_ENGLISH_STOPWORDS)} AS x, {count(X.COMMON_ENGLISH_WORDS)} AS k FROM b),
r AS (SELECT *, CASE WHEN length(c)=0 THEN 'empty_text' WHEN length(c)<2 THEN 'too_short' WHEN o>=3 THEN 'non_latin_script' WHEN n=0 THEN 'no_alphabetic_words' WHEN x>0 AND x>=e THEN 'non_english_stopwords'
 WHEN length(c)<4 OR n<2 THEN 'too_short' WHEN e>=2 THEN 'english_stopwords_match' WHEN e=1 AND x=0 AND (n<=5 OR k>=1) THEN 'single_english_stopword' WHEN e=1 AND x=0 THEN 'single_stopword_low_ratio'
 WHEN k>=1 AND x=0 THEN 'technical_terms_no_stopwords' ELSE 'unrecognized_tokens_insufficient_evidence' END AS reason FROM d)
SELECT doc_id, lang, CASE WHEN reason IN ('non_latin_script','non_english_stopwords') THEN 'non_english' WHEN reason IN ('english_stopwords_match','single_english_stopword') THEN 'english' ELSE 'uncertain' END AS state,
 CAST(round(CASE reason WHEN 'empty_text' THEN 0 WHEN 'no_alphabetic_words' THEN 0 WHEN 'non_latin_script' THEN 0.95 WHEN 'non_english_stopwords' THEN least(1.0, 0.5+0.15*x) WHEN 'too_short' THEN CASE WHEN length(c)<2 THEN 0 ELSE 0.4 END
 WHEN 'english_stopwords_match' THEN least(1.0, 0.60+0.08*e) WHEN 'single_english_stopword' THEN 0.75 WHEN 'single_stopword_low_ratio' THEN 0.45 WHEN 'technical_terms_no_stopwords' THEN 0.5 ELSE 0.15 END, 3) AS DOUBLE) AS score, reason,
 NOT (text='' OR length(c)<4 OR nw<2) AS interpretable, CASE WHEN text='' THEN 'empty_message' WHEN length(c)=0 THEN 'inquiry_too_short_or_empty' WHEN length(c)>=4 AND nw>=2 THEN 'valid' WHEN length(c)<4 THEN 'inquiry_too_short_or_empty' ELSE 'insufficient_content_words' END AS why FROM r"""


_NORMAL_TOKENS = r"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text),'https?://\S+','','g'),'@[a-z0-9_]+','','g'),'[^\p{L}\p{M}\p{N}_\s]',' ','g'),'\s+',' ','g')),' '), lambda x: x<>''))"
FIRST_SQL = """f AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn, CAST(reply_id AS BIGINT)) AS rn FROM p) WHERE rn=1)"""
SQL = {
    "reply_pairs": f"WITH {MESSAGES_SQL}, {PAIRS_SQL} SELECT customer_id, reply_id, customer_text, reply_text FROM p",
    "candidates": f"""WITH {MESSAGES_SQL}, {PAIRS_SQL}, {FIRST_SQL},
a AS (SELECT conv_id, author_id, min(turn) AS t FROM m WHERE author_id<>'brand' GROUP BY ALL),
l AS (SELECT conv_id, author_id, 'Customer_'||CAST(row_number() OVER (PARTITION BY conv_id ORDER BY t) AS VARCHAR) AS label FROM a),
x AS (SELECT f.conv_id, f.turn AS last, f.customer_id, f.reply_id, m.turn, m.inbound, m.parent, m.text, '['||coalesce(l.label,'Brand')||']'||CASE WHEN m.turn=f.turn THEN ' (TARGET CUSTOMER INQUIRY)' ELSE '' END||': '||m.text AS line
 FROM f JOIN m ON m.conv_id=f.conv_id AND m.turn<=f.turn LEFT JOIN l ON l.conv_id=m.conv_id AND l.author_id=m.author_id)
SELECT CAST(conv_id*1000 AS VARCHAR) AS group_id, customer_id, reply_id, 'brand:'||CAST(conv_id*1000 AS VARCHAR)||':'||customer_id||':'||reply_id AS example_id, count(*) AS n_turns, md5(string_agg(line, chr(10) ORDER BY turn)) AS model_input_md5,
 bool_or(inbound AND (regexp_matches(text,'\\b\\d/\\d\\b|\\b/\\d\\b|\\b1/\\b|\\b2/\\b') OR (parent IS NULL AND regexp_matches(trim(text),'^\\p{{Ll}}') AND NOT starts_with(trim(text),'http')))) AS suspected_multipart,
 bool_or(contains(trim(text),'...') OR ends_with(trim(text),' w')) AS partial_text FROM x GROUP BY conv_id, customer_id, reply_id""",
    "thread_roots": f"WITH {MESSAGES_SQL} SELECT tweet_id, CAST(conv_id*1000 AS VARCHAR) AS root, turn AS depth, CAST(NULL AS VARCHAR) AS flag FROM m",
    "thread_turns": f"WITH {MESSAGES_SQL} SELECT CAST(conv_id*1000 AS VARCHAR) AS root, count(*) AS n_turns, true AS is_complete, string_agg(tweet_id, ',' ORDER BY turn) AS turn_ids FROM m GROUP BY conv_id",
    "thread_turns_by_time": f"WITH {MESSAGES_SQL}, t AS (SELECT *, CASE WHEN CAST(tweet_id AS BIGINT)%11=0 THEN -1 ELSE (CAST(tweet_id AS BIGINT)*7)%60 END AS minute_ FROM m) SELECT CAST(conv_id*1000 AS VARCHAR) AS root, count(*) AS n_turns, string_agg(tweet_id, ',' ORDER BY minute_, turn) AS turn_ids FROM t GROUP BY conv_id",
    "found_replies": f"WITH {MESSAGES_SQL} SELECT parent AS id, tweet_id AS reply_id FROM m WHERE parent IS NOT NULL",
    "cited_sources": f"""WITH {MESSAGES_SQL}, c AS (SELECT tweet_id, inbound, {_CASE} AS label FROM (SELECT tweet_id, inbound, ' '||text AS text FROM m))
SELECT tweet_id, CASE WHEN NOT inbound THEN '(none)' ELSE CASE label {' '.join(f"WHEN '{r.label}' THEN '{r.source}'" for r in POLICY.rules)} ELSE 'KB-8' END END AS evidence FROM c""",
    "pair_overlap": f"""WITH {MESSAGES_SQL}, {PAIRS_SQL}, n AS (SELECT customer_id, reply_id, {_NORMAL_TOKENS.replace('text', 'customer_text')} AS a, {_NORMAL_TOKENS.replace('text', 'reply_text')} AS b FROM p)
SELECT customer_id, reply_id, round(CASE WHEN len(a)=0 OR len(b)=0 THEN 0.0 ELSE len(list_intersect(a,b))/len(list_distinct(list_concat(a,b))) END, 6) AS jaccard FROM n""",
    "review_sample": f"SELECT * FROM (SELECT doc_id, state, row_number() OVER (PARTITION BY state ORDER BY md5('42:'||CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM ({_language_sql()})) WHERE rank<=10",
    "transcripts": f"WITH {MESSAGES_SQL} SELECT CAST(conv_id*1000 AS VARCHAR) AS root, md5('## '||CAST(conv_id*1000 AS VARCHAR)||chr(10)||string_agg('- **'||author_id||'**: '||text, chr(10) ORDER BY turn)||chr(10)) AS transcript_md5 FROM m GROUP BY conv_id",
    "message_profile": f"""WITH {MESSAGES_SQL} SELECT count(*) AS n_rows, count(*)-count(tweet_id) AS nulls_tweet_id, count(*)-count(author_id) AS nulls_author_id, count(*)-count(inbound) AS nulls_inbound, count(*)-count(text) AS nulls_text,
 count(*)-count(parent) AS nulls_in_response_to_tweet_id, count(*) FILTER (inbound) AS n_inbound, count(*) FILTER (NOT inbound) AS n_outbound FROM m""",
    "top_authors": f"WITH {MESSAGES_SQL} SELECT author_id, count(*) AS n FROM m GROUP BY author_id ORDER BY n DESC, author_id LIMIT 20",
    "thread_exclusions": f"""WITH {MESSAGES_SQL}, r AS (SELECT conv_id, turn, CASE WHEN NOT inbound THEN 'not_inbound' WHEN length(text)<400 THEN 'short' END AS reason FROM m),
g AS (SELECT conv_id, arg_max(reason, turn) AS reason FROM r GROUP BY conv_id HAVING NOT bool_or(reason IS NULL)), c AS (SELECT reason, count(*) AS n FROM g GROUP BY reason)
SELECT reason, n FROM c UNION ALL SELECT CASE WHEN starts_with(reason,'not_') THEN 'not_*' ELSE 'short*' END, CAST(sum(n) AS BIGINT) FROM c GROUP BY 1""",
    "quality_flags": """WITH f AS (SELECT contains(trim(text),'...') OR ends_with(trim(text),' w') AS partial_text, contains(lower(text),'dm us') OR contains(lower(text),'dm me') OR contains(lower(text),'direct message') AS private_handoff,
 contains(lower(text),'screenshot') OR contains(lower(text),'screen shot') AS external_context, regexp_matches(trim(text),'\\b\\d/\\d\\b|\\b/\\d\\b|\\b1/\\b|\\b2/\\b') OR (regexp_matches(trim(text),'^\\p{Ll}') AND NOT starts_with(trim(text),'http')) AS multipart,
 contains(lower(text),'idiot') OR contains(lower(text),'clown') AS idiot_or_clown FROM documents),
u AS (UNPIVOT (SELECT count(*) FILTER (partial_text) AS partial_text, count(*) FILTER (private_handoff) AS private_handoff, count(*) FILTER (external_context) AS external_context, count(*) FILTER (multipart) AS multipart, count(*) FILTER (idiot_or_clown) AS idiot_or_clown FROM f) ON COLUMNS(*) INTO NAME flag VALUE n)
SELECT flag, n, round(n/(SELECT count(*) FROM documents), 6) AS share FROM u""",
    "page_links": r"""SELECT page_id, contains(html,'https://t.co/') OR contains(html,'http://t.co/') AS has_url, md5(trim(regexp_replace(regexp_replace(regexp_replace(url,'https?://\S+','','g'),'@\[[^\]]+\]','','g'),'@[A-Za-z0-9_]+','','g'))) AS cleaned_md5, md5(regexp_replace(url,'https?://\S+','','g')) AS link_free_md5 FROM pages""",
    "redact_emails": r"""WITH t AS (SELECT doc_id, regexp_replace(text,'\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b','[EMAIL_REDACTED]','g') AS t FROM documents) SELECT doc_id, md5(t) AS redacted_md5, len(regexp_extract_all(t,'\[EMAIL_REDACTED\]')) AS n_emails FROM t""",
    "normalised": r"""WITH t AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text),'https?://\S+','','g'),'@[a-z0-9_]+','','g'),'[^\p{L}\p{M}\p{N}_\s]',' ','g'),'\s+',' ','g')) AS n FROM documents)
SELECT doc_id, md5(n) AS normal_md5, array_to_string(list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(lower(text),'\b(?:error|code|err)\s*#?([0-9a-zA-Z_-]+)\b',1), lambda x: regexp_matches(x,'[0-9]')), regexp_extract_all(lower(text),'\b0x[0-9a-f]+\b')))),',') AS codes,
 array_to_string(list_sort(list_filter(list_distinct(string_split(lower(n),' ')), lambda x: x IN ('not','no','never','cant','cannot','wont','dont','isnt','didnt','neither','nor','without','unable'))),',') AS negations FROM t""",
    "language_states": _language_sql(),
    "language_distribution": f"SELECT lang, state, count(*) AS n FROM ({_language_sql()}) GROUP BY ALL",
    "usable_training_texts": f"WITH {MESSAGES_SQL} SELECT tweet_id, {_USABLE} AS usable FROM m WHERE inbound AND (contains(lower(text),'the') OR contains(lower(text),'der'))",
    "rule_predictions": f"""WITH {MESSAGES_SQL}, c AS (SELECT tweet_id, ' '||text AS text, {_CASE} AS label FROM m WHERE inbound),
e AS (SELECT *, regexp_matches(text, '{unicode_words(ESCALATE)}') AS s FROM c)
SELECT tweet_id AS example_id, label AS predicted_intent, s OR label='access' AS predicted_must_escalate, CASE label {' '.join(f"WHEN '{r.label}' THEN '{r.reply}'" for r in POLICY.rules)} ELSE 'Thanks for writing.' END AS predicted_reply,
 CASE WHEN label='other' THEN 'fallback_keyword_unmatched' ELSE 'keyword_match_'||label END||CASE WHEN s THEN '_sensitive_escalation_rule' WHEN label='access' THEN '_account_security_escalation' ELSE '' END AS predicted_reason,
 CASE label {' '.join(f"WHEN '{r.label}' THEN '{r.source}'" for r in POLICY.rules)} ELSE 'KB-8' END AS sources FROM e""",
    "majority_predictions": f"""WITH {MESSAGES_SQL}, c AS (SELECT {_CASE} AS label FROM m WHERE inbound), t AS (SELECT label FROM c GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT tweet_id AS example_id, t.label AS predicted_intent, true AS predicted_must_escalate, 'fixed_majority_class_always_escalate' AS predicted_reason FROM m, t WHERE inbound""",
    "weak_labels": f"""WITH {MESSAGES_SQL}, u AS (SELECT tweet_id, text, CASE WHEN inbound THEN 0 ELSE 1 END AS rk, CAST(tweet_id AS BIGINT) AS num, {_CASE} AS label FROM m WHERE {_USABLE}),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY rk, num) AS r FROM u) WHERE r=1), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rk, num) AS rank FROM d)
SELECT tweet_id, label, CAST(CASE label {' '.join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(POLICY.labels))} END AS BIGINT) AS label_id, rank FROM k WHERE rank<=25""",
}
QUERIES = {f.__name__: f for f in (reply_pairs, candidates, thread_roots, thread_turns, thread_turns_by_time, found_replies, cited_sources, pair_overlap, review_sample, transcripts, message_profile, top_authors, thread_exclusions, quality_flags, page_links, redact_emails, redact_all, normalised, language_states, language_distribution, usable_training_texts, rule_predictions, majority_predictions, weak_labels)}
