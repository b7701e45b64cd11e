"""A small scoring domain made of words that the given tables hold; real domains are passed in the same way."""

from ..operators.scoring import Claim, Policy, Rule

POLICY = Policy(
    rules=(
        Rule("access", r"\b(hea|thanedble|onthe|leure)\b", "KB-1", "Reset it at example.com/reset or write to us, please."),
        Rule("billing", r"\b(erre|reat|keit|paiement)\b", "KB-2", "See example.com/account for what you paid."),
        Rule("support", r"\b(ndor|tion|schen|ción)\b", "KB-3", "We recommend a clean reinstall; thanks for your patience."),
        Rule("catalogue", r"\b(with|und|dans|para)\b", "KB-4", "What is there depends on licensing agreements."),
    ),
    signals={"account_action": r"\b(onthe|hea|der)\b", "sensitive_security": r"\b(thanedble|leure)\b", "financial_dispute": r"\b(erre|keit)\b", "previous_troubleshooting_failed": r"\b(reat|schen)\b"},
    openers={"access": "We know how hard that is.", "billing": "Sorry about the bill.", "support": "Sorry that this fails.", "catalogue": "Sorry that it is missing.", "other": "Thanks for writing."},
    closers={"access": "Write to us if it goes on.", "other": "Let us know how we can help."},
    actions={"access": "Please visit example.com/reset to set a new password.", "billing": "You can review it at example.com/account whenever you like.", "support": "Please reinstall it and clear the cache.", "catalogue": "It depends on licensing agreements with rights holders.", "other": "Tell us more and we do our best."},
    claims=(Claim("reinstall", r"\breinstall\b", ("reinstall",), (r"\bdo not reinstall\b",)), Claim("cache", r"\bcache\b", ("cache",)), Claim("licensing", r"\blicensing\b", ("licensing",))),
    prohibited=r"\b(guarantee refund|refund issued)\b", default="other", cautious=("access", "billing"), threshold=0.25,
)
REASONS = {"sensitive_security": "sensitive_security_request", "account_action": "account_action_required", "financial_dispute": "financial_billing_dispute", "previous_troubleshooting_failed": "previous_troubleshooting_failed", "unresolved_ambiguity": "unresolved_ambiguity"}
ESCALATE = r"\b(thanedble|erre|schen)\b"
