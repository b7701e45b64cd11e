import pytest
from pyspark.sql import functions as F

from convlake.functions import text as X

BRANDS = ("nimbus", "nimbushelp")
REDACTED = [
    ("Ring 212-555-0143 after lunch", "Ring [PHONE_REDACTED] after lunch"), ("Office (646) 555-0117, ask for me", "Office [PHONE_REDACTED], ask for me"), ("From abroad: +44 212-555-0166.", "From abroad: [PHONE_REDACTED]."),
    ("I think my username is teapot_77", "I think my username is [CUSTOMER_USERNAME]"), ("Username = teapot_77.", "Username = [CUSTOMER_USERNAME]."), ("Nimbus username is 'teapot_77'", "Nimbus username is '[CUSTOMER_USERNAME]'"),
    ("the user name is @teapot_77, see?", "the user name is [CUSTOMER_USERNAME], see?"), ("account name: tea.pot-77", "account name: [CUSTOMER_USERNAME]"), ("So my username is blocked", "So my username is blocked"),
    ("Dear Nimbus, nothing loads", "Dear Nimbus, nothing loads"), ("Hello Marisol, nothing loads", "Hello [CUSTOMER_NAME], nothing loads"), ("build v3.14.159.265 on 12.0.4 says 0x80070005 or error 503", "build v3.14.159.265 on 12.0.4 says 0x80070005 or error 503"),
    ("handle is called wren", "handle is called [CUSTOMER_USERNAME]"), ("write k.l@m.net, tag @passerby and @NimbusHelp", "write [EMAIL_REDACTED], tag @[CUSTOMER_HANDLE] and @NimbusHelp"), ("id::42__credit_card__: __phone__", "[CREDIT_CARD_REDACTED]: [PHONE_REDACTED]"), ("", ""), (None, None),
]


def test_redaction_and_idempotence(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REDACTED)], "i int, t string")
    once = X.redact(F.col("t"), BRANDS)
    rows = df.select("i", once.alias("a"), X.redact(once, BRANDS).alias("b")).orderBy("i").collect()
    assert [r.a for r in rows] == [e for _, e in REDACTED]
    assert [r.b for r in rows] == [r.a for r in rows]


LANGUAGE = [
    ("The update broke search and it will not load the map for me.", None, "english", "english_stopwords_match"), ("Gracias pero no consigo abrir la cuenta", None, "non_english", "non_english_stopwords"),
    ("Nope", None, "uncertain", "too_short"), ("Nope", "can you tell me if the update is out", "english", "contextual_english_short_answer"), ("Timeout refused", None, "uncertain", "technical_terms_no_stopwords"),
    ("Timeout refused", "can you tell me if the update is out", "english", "contextual_english_short_answer"), ("brmpf zwlnk grtzl", None, "uncertain", "unrecognized_tokens_insufficient_evidence"), ("", None, "uncertain", "empty_text"), (None, None, "uncertain", "empty_text"),
    ("Gracias cuenta", "can you tell me if the update is out", "non_english", "non_english_stopwords"), ("добрый вечер", None, "non_english", "non_latin_script"), ("x", None, "uncertain", "too_short"), ("404 503", None, "uncertain", "no_alphabetic_words"),
]


def test_language(spark):
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _, _) in enumerate(LANGUAGE)], "i int, t string, p string")
    rows = df.select("i", X.language_state(F.col("t"), F.col("p")).alias("s"), X.interpretable(F.col("t"), F.col("p")).alias("o")).orderBy("i").collect()
    assert [(r.s.state, r.s.reason) for r in rows] == [(s, w) for _, _, s, w in LANGUAGE]
    assert not rows[2].o.ok and rows[3].o.reason == "contextual_short_reply"


def test_flags(spark):
    turn = "struct<tweet_id:string,author_id:string,inbound:int,created_at:string,text:string,in_response_to_tweet_id:string>"
    one = lambda t, parent=None: [("1", "c", 1, None, t, parent)]
    rows = [one("see https://t.co/qq7 for more", "0"), one("Could you DM us the order number", "0"), one("A screen shot would help here", "0"), one("second half of it 2/2") + [("2", "b", 0, None, "One moment ...", "1")]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, turns array<{turn}>")
    got = [{k for k, v in r.f.asDict().items() if v} for r in df.select("i", X.turn_flags(F.col("turns")).alias("f")).orderBy("i").collect()]
    assert got == [{"has_url"}, {"private_handoff"}, {"external_context_required"}, {"suspected_multipart", "partial_text"}]


def test_parsers(spark):
    df = spark.createDataFrame([("True", "Sat Feb 03 04:05:06 +0000 2018", "12.0"), (None, "bad", "nan"), (" 0.0 ", None, None)], "b string, t string, p string")
    rows = df.select(X.strict_boolean(F.col("b")).alias("b"), X.message_epoch(F.col("t")).alias("t"), X.present_id(F.col("p")).alias("p")).collect()
    assert [tuple(r) for r in rows] == [(True, 1517630706.0, "12"), (False, 0.0, None), (False, 0.0, None)]
    with pytest.raises(Exception, match="unknown boolean"):
        spark.createDataFrame([("maybe",)], "b string").select(X.strict_boolean(F.col("b"))).collect()


def test_normalise(spark):
    df = spark.createDataFrame([("La canción, de @me: https://x.y/z  ERROR 404! err #e-5 0xFF can't not",)], "t string")
    r = df.select(X.normalise(F.col("t")).alias("n"), X.error_codes(F.col("t")).alias("c"), X.negations(X.normalise(F.col("t"))).alias("g")).first()
    assert r.n == "la canción de error 404 err e 5 0xff can t not" and r.c == ["0xff", "404", "e-5"] and r.g == ["not"]
