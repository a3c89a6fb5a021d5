"""Response-log and secret-text expressions. Word lists and patterns are fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SENSITIVE_PARTS = ("authorization", "api-key", "key", "token", "cookie", "secret")
BEARER_PATTERN = r"(?i)(?:bearer\s+|sk[-_])[A-Za-z0-9._~+/=-]+"
LONG_TOKEN_PATTERN = r"[A-Za-z0-9._~+/=-]{24,}"
QUOTA_CODES = (
    "insufficient_quota", "quota_exceeded", "subscription_exhausted",
    "subscription_required", "usage_limit_exceeded",
)
BODY_MARKERS = (
    ("cloudflare", "cloudflare"), ("api.market", "api.market"),
    ("access denied", "access_denied"), ("forbidden", "forbidden"),
)
REDACTED = "[REDACTED]"
WHITESPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def looks_secret(text: Column) -> Column:
    """Token-like or key-like text anywhere in the whole value; null text is not secret."""
    lowered = F.lower(text)
    named = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(p)) for p in SENSITIVE_PARTS])
    flagged = named | text.rlike(BEARER_PATTERN) | text.rlike(LONG_TOKEN_PATTERN)
    return F.coalesce(flagged, F.lit(False))


def one_line(text: Column) -> Column:
    """Whitespace runs become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def safe_metadata(text: Column, limit: int = 200) -> Column:
    """Bounded log value, null when blank or secret-bearing anywhere in the whole text."""
    line = one_line(text)
    return F.when((line != "") & ~looks_secret(line), F.substring(line, 1, limit))


def safe_message(text: Column, limit: int = 160) -> Column:
    line = one_line(text)
    return F.when(looks_secret(line), REDACTED).otherwise(F.nullif(F.substring(line, 1, limit), F.lit("")))


def redact(text: Column, secrets: list[str]) -> Column:
    """Every listed secret replaced, literally."""
    for secret in secrets:
        if secret:
            text = F.replace(text, F.lit(secret), F.lit(REDACTED))
    return text


def parsed_json(text: Column) -> Column:
    """The text as VARIANT, null if it is no JSON; parse once and hand the column to the functions below."""
    return F.try_parse_json(text)


def body_kind(body: Column, content_type: Column, parsed: Column) -> Column:
    declared = F.lower(F.coalesce(content_type, F.lit("")))
    start = F.lower(F.ltrim(body))
    looks_json = F.contains(declared, F.lit("json")) | start.rlike(r"\A[{\[]")
    looks_html = F.contains(declared, F.lit("html")) | start.rlike(r"\A(<!doctype html|<html)")
    printable = F.startswith(declared, F.lit("text/")) | ~body.rlike(r"[\x00-\x08\x0e-\x1b\x7f]")
    return (
        F.when(body.isNull() | (body == ""), "empty")
        .when(looks_json, F.when(parsed.isNotNull(), "json").otherwise("text"))
        .when(looks_html, "html")
        .when(printable, "text")
        .otherwise("unknown")
    )


def body_marker(body: Column) -> Column:
    lowered = F.lower(body)
    chain = F.when(F.contains(lowered, F.lit(BODY_MARKERS[0][0])), BODY_MARKERS[0][1])
    for needle, label in BODY_MARKERS[1:]:
        chain = chain.when(F.contains(lowered, F.lit(needle)), label)
    return chain.otherwise("unknown")


_CODE_FIELDS = ("code", "error", "type")


def has_quota_code(parsed: Column) -> Column:
    hits = [F.lower(F.try_variant_get(parsed, f"$.{field}", "string")).isin(*QUOTA_CODES) for field in _CODE_FIELDS]
    return reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits])


def error_code(parsed: Column) -> Column:
    """First field holding a short, harmless machine code, as JSON text and nothing else."""
    picks = []
    for field in _CODE_FIELDS:
        is_text = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant")) == "STRING"
        value = F.when(is_text, F.try_variant_get(parsed, f"$.{field}", "string"))
        picks.append(F.when(value.rlike(r"\A[A-Za-z0-9_.:-]{1,80}\z") & ~looks_secret(value), value))
    return F.coalesce(*picks)


def classify_response(status: Column, parsed: Column) -> Column:
    """Outcome class of one logged response; 403 is quota only with a known code."""
    return (
        F.when(status == 204, "no_match")
        .when(status.between(200, 299), "ok")
        .when(status == 401, "authentication")
        .when((status == 402) | ((status == 403) & has_quota_code(parsed)), "quota")
        .when(status == 429, "rate_limit")
        .when(status.isin(408, 504), "timeout")
        .otherwise("other_error")
    )
