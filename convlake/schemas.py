"""Explicit schemas of every source; nothing is inferred."""

from pyspark.sql import types as T

MESSAGE_FIELDS = ("tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id")
#: Raw message table: all text, as ids are never numbers.
MESSAGES = T.StructType([T.StructField(n, T.StringType()) for n in MESSAGE_FIELDS])
TURN = T.StructType([T.StructField(n, T.IntegerType() if n == "inbound" else T.StringType()) for n in ("tweet_id", "author_id", "inbound", "created_at", "text", "in_response_to_tweet_id")])
FLAGS = ("suspected_multipart", "partial_text", "has_url", "private_handoff", "external_context_required")
PREDICTION = T.StructType([
    T.StructField("example_id", T.StringType()), T.StructField("system_id", T.StringType()), T.StructField("predicted_intent", T.StringType()),
    T.StructField("predicted_must_escalate", T.BooleanType()), T.StructField("predicted_reply", T.StringType()), T.StructField("predicted_reason", T.StringType()),
    T.StructField("retrieved_source_ids", T.ArrayType(T.StringType())), T.StructField("runtime_ms", T.DoubleType()),
])
SCORES = T.StructType([*[T.StructField(n, T.IntegerType()) for n in ("relevance", "grounding", "usefulness", "tone")], T.StructField("critical_error", T.BooleanType()), T.StructField("critical_error_details", T.MapType(T.StringType(), T.BooleanType()))])
JUDGEMENT = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("cache_key", "model_id", "prompt_version", "rubric_sha256", "prompt_sha256")],
    T.StructField("llm_failure", T.BooleanType()), T.StructField("failure_reason", T.StringType()), T.StructField("scores", SCORES), T.StructField("cached_at", T.StringType()), T.StructField("input_hash", T.StringType()),
])
MANIFEST = T.StructType([
    T.StructField("sampling_seed", T.IntegerType()), T.StructField("candidate_brands", T.ArrayType(T.StringType())),
    T.StructField("conversations", T.ArrayType(T.StructType([
        *[T.StructField(n, T.StringType()) for n in ("brand", "conversation_id", "root_tweet_id", "brand_reply_tweet_id")],
        T.StructField("tweet_count", T.IntegerType()), T.StructField("is_complete", T.BooleanType()), T.StructField("flags", T.ArrayType(T.StringType())),
    ]))),
])
