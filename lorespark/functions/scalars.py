"""Column functions shared by the knowledge-base operators; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at either end (line breaks and tabs too)."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def slugify(c: Column) -> Column:
    """Lower case, letters, digits and single hyphens; at most 50, then one hyphen off either end."""
    x = strip(F.regexp_replace(F.lower(c), r"[^a-z0-9\s-]", ""))
    x = F.regexp_replace(F.regexp_replace(x, r"\s+", "-"), "-+", "-")
    return F.regexp_replace(F.substring(x, 1, 50), "^-|-$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def chunk_id(source: Column, topic: Column, slug: Column | None = None) -> Column:
    """Slug and the first 8 hex digits of sha256(file name + topic)."""
    name = topic if slug is None else F.coalesce(slug, topic)
    return F.concat(slugify(name), F.lit("-"), F.substring(F.sha2(F.concat(base_name(source), topic), 256), 1, 8))


def segment_id(heading_path: Column, content: Column) -> Column:
    """Heading path as a slug of at most 60, and 8 hex digits of the content's sha256."""
    base = F.regexp_replace(F.lower(F.array_join(heading_path, "-")), "[^a-z0-9]+", "-")
    base = F.substring(F.regexp_replace(base, "^-+|-+$", ""), 1, 60)
    digest = F.substring(F.sha2(strip(content), 256), 1, 8)
    return F.regexp_replace(F.when(base != "", F.concat(base, F.lit("-"), digest)).otherwise(digest), "-{2,}", "-")


def root_title(title: Column) -> Column:
    """A document's title as a slug of at most 40 without ``.pdf``, else ``document``."""
    x = F.regexp_replace(F.lower(F.regexp_replace(title, r"(?i)\.pdf$", "")), "[^a-z0-9]+", "-")
    x = F.substring(F.regexp_replace(x, "^-+|-+$", ""), 1, 40)
    return F.when(x != "", x).otherwise("document")


def normalize_related(ids: Column) -> Column:
    """Links trimmed and without a ``chunk_id:`` prefix in any case."""
    return F.transform(ids, lambda x: F.regexp_replace(strip(x), "(?i)^chunk_id:", ""))


def preview(c: Column, n: int) -> Column:
    """The first n characters, marked where more follow."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("... [truncated]"))).otherwise(c)


#: Fixed value: lines that are structure, not text.
NOISE = r"(?i)^(--|--\s*\d+\s*(of|/)\s*\d+\s*--|contents|important links|frequently asked questions|\s*)$"


def is_noise(line: Column) -> Column:
    return strip(line).rlike(NOISE)


#: What a failing call's message or status says, in the order in which it counts.
ERRORS = {
    "auth": ((401, 403), ("api key", "unauthorized", "forbidden")),
    "rate_limit": ((429,), ("rate limit", "too many requests", "quota")),
    "token_limit": ((413,), ("token", "context length", "maximum context", "content too large")),
}


def error_class(message: Column, status: Column) -> Column:
    """auth, rate_limit, token_limit, transient or unknown; the first that fits."""
    m = F.lower(F.coalesce(message, F.lit("")))
    s = F.coalesce(status, F.lit(0))
    out = None
    for name, (statuses, words) in ERRORS.items():
        test = s.isin(*statuses) | F.array_max(F.array(*[F.contains(m, F.lit(w)) for w in words]))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.when(s >= 500, "transient").otherwise("unknown")


def tokens(c: Column) -> Column:
    """Distinct lower-cased words of two letters or digits or more."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 2))
