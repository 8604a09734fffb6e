"""Prompt-injection scan, untrusted-text wrapping and redaction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns, in catalogue order.
INJECTION_RULES = (
    ("override_instructions", r"\b(ignore|disregard|forget)\b.{0,40}\b(previous|prior|above|all)\b.{0,20}\b(instructions?|prompts?|rules?)"),
    ("reveal_system", r"\b(reveal|print|show|output|repeat)\b.{0,40}\b(system prompt|hidden instructions?|developer message)"),
    ("role_hijack", r"\byou are now\b|\bact as (an? )?(unrestricted|jailbroken)|\bnew instructions?:"),
    ("tool_abuse", r"\b(call|invoke|execute|run)\b.{0,30}\b(tool|function|command|shell)\b"),
    ("exfiltration", r"\b(send|post|upload|exfiltrate)\b.{0,40}\b(https?://|api key|credentials?|password)"),
    ("delimiter_forgery", r"</?\s*(system|untrusted_document|instructions?)\b"),
)
#: Unicode case and classes; only a newline ends ".".
FLAGS = "(?iuUd)"
# Fixed values.
LOOKALIKE = r"</?\s*untrusted_document[^>]*>"
SECRET_KEYS = ("password", "secret", "token", "api_key", "authorization", "access_key")


def injection_rules(text: Column) -> Column:
    """Names of the matching rules, in catalogue order; empty for null."""
    names = [F.when(text.rlike(FLAGS + pattern), F.lit(name)) for name, pattern in INJECTION_RULES]
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def wrap_untrusted(cite: Column, text: Column, nonce: str) -> Column:
    """A text between delimiters that hold ``nonce``; look-alikes in it are neutralised."""
    tag = f"untrusted_document_{nonce}"
    safe = F.regexp_replace(F.coalesce(text, F.lit("")), FLAGS + LOOKALIKE, "[removed-delimiter]")
    return F.concat(F.lit(f"<{tag} cite=\""), cite.cast("string"), F.lit('">\n'), safe, F.lit(f"\n</{tag}>"))


def untrusted_context(blocks: Column, nonce: str) -> Column:
    """An array of struct(cite, text) as wrapped blocks in order, a blank line between them."""
    return F.array_join(F.transform(blocks, lambda b: wrap_untrusted(b["cite"], b["text"], nonce)), "\n\n")


def redact(fields: Column) -> Column:
    """A map with the values of secret keys masked."""
    secret = "|".join(SECRET_KEYS)
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).rlike(secret), F.lit("***REDACTED***")).otherwise(v))
