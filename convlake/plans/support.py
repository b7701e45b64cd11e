"""The default scoring policy for customer support: rules, signals and claims; brand words and sites are parameters."""

from __future__ import annotations

from ..operators.scoring import Claim, Policy, Rule

# Labels with their patterns in order of precedence; {own} stands for the brand's own feature names.
RULES = (
    ("account_access", r"\b(hacked|compromised|password|login|log in|sign in|deleted.*facebook|facebook account|sso|stolen|access my account)\b"),
    ("billing_and_payments", r"\b(charge|charged|billing|payment|credit card|pay|student discount|hulu|grace period|refund|invoice|money|deduct|monthly)\b"),
    ("technical_support", r"\b(bug|glitch|crash|freez|shuffle|download|audio|sound|web app|chrome|app|update|timestamp|gui|offline|play|playing|no help|faqs)\b"),
    ("subscription_and_plans", r"\b(family|invite|duo|student|stream|cut off|cancel|delete my account|address|plan|premium|member)\b"),
    ("content_availability", r"\b(song|album|artist|track|unavailable|missing|removed|release|catalog|licens|not available|remove)\b"),
    ("platform_and_regional", r"\b(sonos|siri|apple watch|uwp|india|iraq|south africa|dubai|country|launch|roam|available in|supported in)\b"),
    ("product_feedback", r"\b({own}recommend|ad|ads|filter|most played|feature|listeners|meme|idea|suggest|dislike)\b"),
)
DEFAULT = "other_or_ambiguous"
# Signals with their patterns, and what drafts never claim.
SIGNALS = {
    "sensitive_security": r"\b(hacked|compromised|stolen|deleted.*facebook|facebook|sso|access my account)\b",
    "account_action": r"\b(password|reset|delete.*account|change address|grace period|email address|update my payment)\b",
    "financial_dispute": r"\b(charged|unauthorized|refund|dispute|double charge|deduct)\b",
    "previous_troubleshooting_failed": r"\b(faqs no help|nothing works|already tried|still not working|tried everything|faq|support no help)\b",
}
PROHIBITED = r"\b(guarantee refund|refund issued|account deleted|server outage confirmed|fixed your account)\b"
# Claims with their pattern, the words of which evidence has to hold one, and what contradicts them; {site} is the brand's site.
CLAIMS = (
    ("clean_reinstall", r"\b(?:clean\s+)?re-?install(?:ing|ed|ation)?\b", ("reinstall", "re-install", "clean install"), (r"\bdo(?:n't|\s+not)\s+re-?install\b", r"\bno\s+need\s+to\s+re-?install\b", r"\bavoid\s+re-?installing\b")),
    ("cache_clearing", r"\bclear(?:ing)?\s+(?:the\s+)?cache\b|\bcache\b", ("cache", "storage"), (r"\bdo(?:n't|\s+not)\s+clear\s+(?:the\s+)?cache\b", r"\bno\s+need\s+to\s+clear\s+cache\b")),
    ("router_reboot", r"\b(?:router|modem|wi-?fi|network|firewall)\b", ("router", "modem", "wi-fi", "wifi", "network", "connection"), (r"\bdo(?:n't|\s+not)\s+(?:restart|reboot)\s+(?:the\s+)?router\b",)),
    ("device_restart", r"\b(?:restart(?:ing)?|reboot(?:ing)?)\b", ("restart", "reboot", "turn off and on"), (r"\bdo(?:n't|\s+not)\s+(?:restart|reboot)\b",)),
    ("bluetooth", r"\bbluetooth\b", ("bluetooth",), ()),
    ("offline_mode", r"\boffline\s+mode\b", ("offline",), ()),
    ("logout_login", r"\b(?:log|sign)\s*(?:out|off)\b", ("log out", "sign out", "logout", "signout"), ()),
    ("app_update", r"\b(?:update|updating|latest\s+version)\b", ("update", "latest version"), ()),
    ("reset_url", r"\b{site}/reset\b", ("reset", "{site}/reset"), ()),
    ("account_url", r"\b{site}/account\b", ("account", "{site}/account"), ()),
    ("licensing", r"\blicensing(?:\s+agreements?)?\b|\brights\s+holders?\b", ("licensing", "rights holders", "labels", "catalog"), ()),
)
THRESHOLD = 0.25


def support_policy(site: str = "example.com", own: tuple[str, ...] = (), replies: dict[str, tuple[str, str]] | None = None, **texts) -> Policy:
    """The policy of a brand: its site, its own feature names, (source, reply) of each label, and openers, closers, actions."""
    known = replies or {}
    rules = tuple(Rule(label, p.replace("{own}", "".join(f"{w}|" for w in own)), *known.get(label, ("", ""))) for label, p in RULES)
    claims = tuple(Claim(n, p.replace("{site}", site.replace(".", r"\.")), tuple(w.replace("{site}", site) for w in support), against) for n, p, support, against in CLAIMS)
    return Policy(rules=rules, signals=SIGNALS, claims=claims, prohibited=PROHIBITED, default=DEFAULT, threshold=THRESHOLD, **texts)
