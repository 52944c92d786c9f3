"""Content safety flags and exact span checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What must not leave in a public text.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ip_address": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "secret": r"(?i)(token|secret|password|api_key) *= *\"?[A-Za-z0-9]{16,}",
    "private_path": r"/(home|Users|root)/[A-Za-z0-9._-]+",
    "locator": r"https?://[^ \n]+",
}


def flags(text: Column) -> Column:
    """Names of the patterns that occur, comma-separated, in their fixed order."""
    return F.array_join(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in PATTERNS.items()])), ",")


def span_ladder(content: Column, excerpt: Column, start: Column, end: Column) -> Column:
    """verified at the span, unique or ambiguous elsewhere, or unavailable."""
    at = F.substring(content, start + 1, end - start) == excerpt
    once = F.position(excerpt, content)
    more = F.position(excerpt, content, once + 1)
    return F.when(at, "verified").when(once == 0, "unavailable").when(more > 0, "ambiguous").otherwise("unique")


def https(url: Column) -> Column:
    """https only, a host of DNS labels, no address literal."""
    return url.rlike(r"^https://([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}(/[^ ]*)?$")
