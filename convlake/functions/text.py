"""Scalar text operators: parsing, redaction, flags, normalisation, language. Brands and word lists are parameters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FLAGS

# Word lists of the language and duplicate rules, stated in natural order.
ENGLISH_STOPWORDS = tuple(dict.fromkeys(
    "the i to a and is in it you that of for on are with as at be this have from my me not can help please why does app play playlist account "
    "music listening offline update song songs working phone device when what how do so but just like all or an if get no we your was am im cant "
    "wont dont has had been there they their them any some more new now see know want think good bad fix tried trying issue problem still again "
    "after before premium hear sound tracks album artist download logged login pass password card payment charge billed subscription student "
    "family cancel reset error crashed yes yeah yep nope done ok okay sure hi hello hey thanks thank did didnt doesnt isnt arent cannot could "
    "would should same both mean every pauses seconds screen nothing everything fixed broken".split()))  # fmt: skip
COMMON_ENGLISH_WORDS = tuple(dict.fromkeys(
    "connection refused failed timeout server desktop android iphone ios windows mac linux wifi cellular cache browser web player sync synced "
    "syncing install installed reinstall reinstalled restarting restarted screen blank black pause pausing paused volume audio sound speaker "
    "bluetooth headphones stream streaming code link version support setting settings email address user username receipt closed connected "
    "uninstalled broken working stopped crash ipad ipod pc macbook laptop tablet samsung pixel galaxy device phone chrome safari firefox edge "
    "update updated latest offline".split()))  # fmt: skip
SHORT_FOLLOWUPS = tuple(dict.fromkeys(
    "yes no yeah yep nope done ok okay sure thanks thank thx hi hello hey android iphone ios windows mac macbook ipad ipod pc desktop mobile "
    "laptop web browser chrome safari firefox premium family student offline online both neither none all everything working fixed broken still "
    "not same reinstalled restarted updated latest tried nothing happening crashed blank black samsung pixel galaxy device phone tablet app".split()))  # fmt: skip
NON_ENGLISH_STOPWORDS = tuple(dict.fromkeys(
    "el la los las un una de del que en por para con es son estoy esta está mis cuenta cancion canción musica música ayuda como cómo mas más pero "
    "porque yo tu su nao não uma umas com minha meu voce você ja já pra dele dela obrigado obrigada gracias hola olá favor porfavor puedo consigo "
    "tem tenho quero ajuda problema musicas músicas tocando si sí funciona funcionando abrir abre cerrar cierra cuentas pago pagar cobro tarjeta "
    "buenas buenos dias días tardes noches reproducir le les du des une et dans sur pour avec je ce pas qui mon mes est suis ne merci bonjour "
    "compte oui non marche fonctionne musique chanson und der die das den dem ein eine nicht mit auf fur für ist ich sie kann mein meine bitte "
    "hilfe nein danke hallo geht funktioniert lied musik il che sono per della dello mio mia ciao grazie prego canzone".split()))  # fmt: skip
NEGATIONS = ("not", "no", "never", "cant", "cannot", "wont", "dont", "isnt", "didnt", "neither", "nor", "without", "unable")
GENERIC_PHRASES = ("still broken", "thank you", "thanks", "not working", "done", "yes", "no", "okay", "ok", "it works", "fixed", "tried that", "did that", "same problem", "help please")
#: Words after "username is" that say something about the name and are none.
STATUS_WORDS = (
    "not none unknown lost forgotten n/a null blank working broken fine ok okay good bad active locked disabled blocked banned hacked suspended changed new "
    "old same different invalid correct wrong missing private public already still apple google android iphone ios windows mac".split()
)
#: Names after a greeting that stay: fixed values, brands aside.
GREETED = ("apple", "amazon", "google", "playstation", "customer_name", "customer_username", "there", "team", "everyone", "guys")
TRUE_SPELLINGS, FALSE_SPELLINGS = ("true", "1", "1.0", "yes", "t", "y"), ("false", "0", "0.0", "no", "f", "n")
_TOKEN_END = r"(?![A-Za-z0-9_]|[.-][A-Za-z0-9_])"
_WORD = "[a-zA-ZÀ-ɏ]+"
_OTHER_SCRIPT = "[Ѐ-ӿ؀-ۿ一-鿿぀-ヿ가-힯฀-๿]"


def _any(words: Iterable[str]) -> str:
    return "|".join(words)


def _in(words: Column, known: Sequence[str]) -> Column:
    """How many words, with repetition, are in ``known``."""
    return F.size(F.filter(words, lambda w: w.isin(*known)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def strict_boolean(c: Column) -> Column:
    """True or false from the known spellings; null is false; any other spelling fails."""
    low = F.lower(F.trim(c.cast("string")))
    return F.when(c.isNull(), F.lit(False)).when(low.isin(*TRUE_SPELLINGS), F.lit(True)).when(low.isin(*FALSE_SPELLINGS), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("unknown boolean: "), c.cast("string"))).cast("boolean"))


def message_epoch(c: Column) -> Column:
    """Epoch seconds of "Tue Nov 07 10:00:00 +0000 2017"; 0 if it can't be read."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.substring(c, 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy"))), F.lit(0)).cast("double")


def present_id(c: Column) -> Column:
    """Null for the sentinels of a missing id."""
    return F.when(F.trim(c).isin("", "None", "nan", "NaN", "null"), F.lit(None)).otherwise(F.regexp_replace(F.trim(c), r"\.0$", ""))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


# The patterns of the redactions below, the phrases of the flags and the reasons of the language rules are fixed values.


def redact_placeholders(c: Column) -> Column:
    c = F.regexp_replace(c, r"id::\d+__credit_card__:", "[CREDIT_CARD_REDACTED]:")
    for name in ("credit_card", "email", "phone"):
        c = F.regexp_replace(c, rf"\b__{name}__\b", f"[{name.upper()}_REDACTED]")
    return c


def redact_usernames(c: Column, brands: Sequence[str] = ()) -> Column:
    """A bare name after "my username is" and its like, unless it is a status word, a brand or an error code."""
    excepted = rf"(?!@?(?:{_any([*STATUS_WORDS, *brands])}){_TOKEN_END}|(?:0x[0-9a-f]+|\d{{3,4}}){_TOKEN_END})"
    brand = rf"(?:(?:{_any(brands)})\s+)?" if brands else ""
    lead = rf"(\b(?:my\s+)?(?:official\s+)?{brand}(?:account\s+)?(?:user\s*name|screen\s*name|user\s*id|login(?:\s+name|\s+id)?|account(?:\s+name|\s+id)?|handle)\s*(?:is\s+called\b|is(?!\s+called\b)|:|=|-)\s*+['\"]?+)"
    return F.regexp_replace(c, rf"(?i){lead}{excepted}(@?[A-Za-z0-9_]+(?:[.-][A-Za-z0-9_]+)*)(['\"]?)", "$1[CUSTOMER_USERNAME]$3")


def redact_emails(c: Column) -> Column:
    return F.regexp_replace(c, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL_REDACTED]")


def redact_handles(c: Column, brands: Sequence[str] = ()) -> Column:
    keep = rf"(?!(?i:{_any(brands)})(?![A-Za-z0-9_]))" if brands else ""
    return F.regexp_replace(c, rf"@{keep}[A-Za-z0-9_]+", "@[CUSTOMER_HANDLE]")


def redact_phones(c: Column) -> Column:
    """Phone numbers; versions such as v8.4.22.857 stay."""
    return F.regexp_replace(c, r"(?<![vV\d.])(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?!\d)(?!\.\d)", "[PHONE_REDACTED]")


def redact_greetings(c: Column, brands: Sequence[str] = ()) -> Column:
    keep = rf"(?!(?i:{_any([*GREETED, *brands])})\b)"
    return F.regexp_replace(c, rf"\b(Hey|Hi|Hello|Dear)\s+{keep}([A-Z][a-z]{{2,15}})\b", "$1 [CUSTOMER_NAME]")


def redact(c: Column, brands: Sequence[str] = ()) -> Column:
    """All redactions in the order that keeps them idempotent: e-mails before handles."""
    c = redact_emails(redact_usernames(redact_placeholders(c), brands))
    return redact_greetings(redact_phones(redact_handles(c, brands)), brands)


def snippet(c: Column, size: int = 100, brands: Sequence[str] = ()) -> Column:
    """The beginning of the redacted text; cut before redaction it could leak half an address."""
    return F.substring(redact(c, brands), 1, size)


def has_url(c: Column) -> Column:
    return c.contains("https://t.co/") | c.contains("http://t.co/")


def private_handoff(c: Column) -> Column:
    low = F.lower(c)
    return low.contains("dm us") | low.contains("dm me") | low.contains("direct message")


def external_context(c: Column) -> Column:
    return F.lower(c).contains("screenshot") | F.lower(c).contains("screen shot")


def partial_text(c: Column) -> Column:
    t = F.trim(c)
    return t.contains("...") | t.endswith(" w")


def multipart(c: Column, inbound: Column, parent: Column) -> Column:
    t = F.trim(c)
    marker = t.rlike(r"\b\d/\d\b|\b/\d\b|\b1/\b|\b2/\b")
    return inbound.cast("boolean") & (marker | (parent.isNull() & t.rlike(r"^\p{Ll}") & ~t.startswith("http")))


def turn_flags(turns: Column) -> Column:
    """The five flags over an array of turns; a null text counts as empty."""
    text = lambda t: F.coalesce(t["text"], F.lit(""))
    tests = {
        "suspected_multipart": lambda t: multipart(text(t), F.coalesce(t["inbound"].cast("boolean"), F.lit(False)), t["in_response_to_tweet_id"]),
        "partial_text": lambda t: partial_text(text(t)), "has_url": lambda t: has_url(text(t)),
        "private_handoff": lambda t: private_handoff(text(t)), "external_context_required": lambda t: external_context(text(t)),
    }
    return F.struct(*[F.exists(turns, tests[n]).alias(n) for n in FLAGS])


def clean_inquiry(c: Column) -> Column:
    """Without links and handles."""
    for pattern in (r"https?://\S+", r"@\[[^\]]+\]", r"@[A-Za-z0-9_]+"):
        c = F.regexp_replace(c, pattern, "")
    return F.trim(c, F.lit(" \t\n\r\f\u000b"))


def normalise(c: Column, extended: bool = False) -> Column:
    """Lower case without links, handles and punctuation, single blanks; ``extended`` also drops rendering prefixes and redacted handles."""
    c = F.regexp_replace(F.lower(c), r"https?://\S+", "")
    if extended:
        c = F.regexp_replace(c, r"\[customer_\d+\]\s*(?:\(target customer inquiry\))?:?", "")
        c = F.regexp_replace(c, r"@\[[^\]]+\]", "")
    c = F.regexp_replace(c, r"@[a-z0-9_]+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))


def error_codes(c: Column) -> Column:
    low = F.lower(c)
    named = F.filter(F.regexp_extract_all(low, F.lit(r"\b(?:error|code|err)\s*#?([0-9a-zA-Z_-]+)\b"), 1), lambda x: x.rlike("[0-9]"))
    return F.array_sort(F.array_union(named, F.regexp_extract_all(low, F.lit(r"\b0x[0-9a-f]+\b"), 0)))


def negations(c: Column, words: Sequence[str] = NEGATIONS) -> Column:
    return F.array_sort(F.array_intersect(tokens(F.lower(c)), F.array(*[F.lit(w) for w in words])))


def effective_inquiry(normal: Column, turns: Column, brand: str | None = None, generic: Sequence[str] = GENERIC_PHRASES) -> Column:
    """A short or generic message with the customer's earlier turns before it, so that "still broken" is compared in context."""
    own = lambda t: (F.coalesce(t["inbound"].cast("int"), F.lit(0)) == 1) | (t["author_id"] != brand if brand else F.lit(False))
    earlier = F.transform(F.filter(F.slice(turns, 1, F.greatest(F.size(turns) - 1, F.lit(0))), own), lambda t: F.coalesce(t["text"], F.lit("")))
    prior = normalise(F.concat_ws(" ", earlier), True)
    short = (F.size(F.filter(F.split(normal, " "), lambda w: w != "")) <= 3) | normal.isin(*generic)
    return F.when(short & (F.size(turns) > 1) & (prior != ""), F.concat_ws(" ", prior, normal)).otherwise(normal)


def language_state(text: Column, prior: Column | None = None, english: Sequence[str] = ENGLISH_STOPWORDS, other: Sequence[str] = NON_ENGLISH_STOPWORDS, common: Sequence[str] = COMMON_ENGLISH_WORDS, followups: Sequence[str] = SHORT_FOLLOWUPS) -> Column:
    """Struct (state, score, reason): english, non_english or uncertain, from the message and ``prior``, the turns before it.

    ``prior`` is their text, null or missing if there are none. Words count with repetition.
    """
    prior = F.lit(None).cast("string") if prior is None else prior
    taken = lambda c: F.regexp_extract_all(F.lower(c), F.lit(_WORD), 0)
    tally = lambda w: F.struct(F.size(w).alias("n"), *[_in(w, ws).alias(k) for k, ws in (("eng", english), ("non", other), ("com", common), ("known", (*english, *common, *followups)))])
    return _let(F.coalesce(clean_inquiry(text), F.lit("")), lambda clean: _let(_let(taken(clean), tally), lambda c: _language_rules(clean, c, prior, english, other, taken)))


def _language_rules(clean: Column, counts: Column, prior: Column, english: Sequence[str], other: Sequence[str], taken) -> Column:
    n, eng, non, com = (counts[k] for k in ("n", "eng", "non", "com"))
    known = counts["known"] == n
    before = taken(clean_inquiry(prior))
    context = (n <= 3) & prior.isNotNull() & known & (_in(before, english) >= 2) & (_in(before, other) == 0)

    def out(state: str, score, reason: str) -> Column:
        return F.struct(F.lit(state).alias("state"), (score if isinstance(score, Column) else F.lit(float(score))).cast("double").alias("score"), F.lit(reason).alias("reason"))

    more = lambda base, step, count: F.round(F.least(F.lit(1.0), F.lit(base) + F.lit(step) * count), 3)
    return (
        F.when(F.length(clean) == 0, out("uncertain", 0.0, "empty_text"))
        .when(F.length(clean) < 2, out("uncertain", 0.0, "too_short"))
        .when(F.size(F.regexp_extract_all(clean, F.lit(_OTHER_SCRIPT), 0)) >= 3, out("non_english", 0.95, "non_latin_script"))
        .when(n == 0, out("uncertain", 0.0, "no_alphabetic_words"))
        .when((non > 0) & (non >= eng), out("non_english", more(0.5, 0.15, non), "non_english_stopwords"))
        .when(context, out("english", 0.85, "contextual_english_short_answer"))
        .when((F.length(clean) < 4) | (n < 2), out("uncertain", 0.40, "too_short"))
        .when(eng >= 2, out("english", more(0.60, 0.08, eng), "english_stopwords_match"))
        .when((eng == 1) & (non == 0) & ((n <= 5) | (com >= 1)), out("english", 0.75, "single_english_stopword"))
        .when((eng == 1) & (non == 0), out("uncertain", 0.45, "single_stopword_low_ratio"))
        .when((com >= 1) & (non == 0), out("uncertain", 0.50, "technical_terms_no_stopwords"))
        .otherwise(out("uncertain", 0.15, "unrecognized_tokens_insufficient_evidence"))
    )


def interpretable(text: Column, prior: Column | None = None) -> Column:
    """Struct (ok, reason): whether a message can be understood with the turns before it; a future reply is never looked at."""
    prior = F.lit(None).cast("string") if prior is None else prior
    count = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"(?U)\b\w+\b"), 0))
    clean = F.coalesce(clean_inquiry(text), F.lit(""))
    out = lambda ok, reason: F.struct(F.lit(ok).alias("ok"), F.lit(reason).alias("reason"))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", out(False, "empty_message"))
        .when(F.length(clean) == 0, out(False, "inquiry_too_short_or_empty"))
        .when((F.length(clean) >= 4) & (count(clean) >= 2), out(True, "valid"))
        .when(count(clean_inquiry(prior)) >= 3, out(True, "contextual_short_reply"))
        .when(F.length(clean) < 4, out(False, "inquiry_too_short_or_empty"))
        .otherwise(out(False, "insufficient_content_words"))
    )


def clean_reply(c: Column) -> Column:
    """The core of a past reply: without handles, signatures and short links."""
    for pattern, by in ((r"@?\[CUSTOMER_[A-Za-z0-9_]+\]", ""), (r"@[A-Za-z0-9_]+", ""), (r"\s+/[A-Z0-9]{2,4}\b", ""), (r"\s+\^[A-Z0-9]{2,4}\b", ""), (r"https?://t\.co/[A-Za-z0-9]+", ""), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, by)
    return F.regexp_replace(F.trim(c), r"^[,.\-\s]+", "")


def usable_for_training(c: Column, least: int = 4, most: int = 70, content: int = 3) -> Column:
    """Whether a message has enough words, not only mentions and links, and is no mere courtesy."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    own = F.filter(words, lambda w: ~w.startswith("@") & ~w.startswith("http"))
    trivial = F.lower(F.trim(c)).rlike(r"^(thanks|thank you|ok thanks|dm sent|sent dm|done|check dm|pls reply|hello)\b")
    return F.size(words).between(least, most) & (F.size(own) >= content) & ~trivial


def mentions(c: Column, inbound: Column, names: Sequence[str]) -> Column:
    """An inbound message that names one of ``names``."""
    found = F.lit(False)
    for n in names:
        found = found | F.lower(c).contains(n.lower())
    return inbound & found


def leaks_reply(model_input: Column, reply: Column, least: int = 10) -> Column:
    """Whether a reply of more than ``least`` characters stands in the model's input."""
    return (F.length(F.trim(reply)) > least) & F.contains(model_input, F.trim(reply))


def token_jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(tokens(a), tokens(b))), F.size(F.array_union(tokens(a), tokens(b)))
    return F.when((F.size(tokens(a)) == 0) | (F.size(tokens(b)) == 0), F.lit(0.0)).otherwise(both / either)
