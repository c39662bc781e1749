"""Scalar column functions: identities, URLs, tokens, sets and numbers. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def interaction_category(event_type: Column, categories: Mapping[str, str]) -> Column:
    """The category of an event type, ``unknown`` for others."""
    out = F.lit("unknown")
    for name, category in categories.items():
        out = F.when(event_type == name, category).otherwise(out)
    return out


def host(url: Column) -> Column:
    """Lower-case host without port; null for what is no URL."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def netloc(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def port(url: Column) -> Column:
    return F.regexp_extract(netloc(url), r":(\d+)$", 1).try_cast("int")


def url_route(url: Column) -> Column:
    """``#fragment``; null without one."""
    return F.concat(F.lit("#"), F.nullif(F.try_parse_url(url, F.lit("REF")), F.lit("")))


def system_identity(application: Column, title: Column, domain: Column, noise_apps: Sequence[str], markers: Sequence[str], noise_titles: Sequence[str]) -> Column:
    """The system that an event is in. First match wins: no or noise application (null), a marker inside the title,
    a browser's own window (null), the domain, the application. Null means no evidence."""
    out = F.when(application.isNull() | application.isin(*noise_apps), F.lit(None).cast("string"))
    for marker in markers:
        out = out.when(title.contains(marker), f"system:{marker}")
    out = out.when(title.isin(*noise_titles) | title.startswith("Untitled"), None)
    return out.when(domain != "", F.concat(F.lit("browser:"), domain)).otherwise(F.concat(F.lit("app:"), application))


def system_changed(before: Column, after: Column) -> Column:
    """Both sides known and different; missing evidence is never a change."""
    return F.coalesce(before != after, F.lit(False))


def document_key(application: Column, title: Column, suffixes: Mapping[str, str], transient: Sequence[str]) -> Column:
    """Name of the open document: the title without the application's suffix and the unsaved mark; null if none."""
    name = F.lit(None).cast("string")
    for app, pattern in suffixes.items():
        name = F.when(application == app, F.trim(F.ltrim(F.regexp_replace(title, pattern, ""), F.lit("*")))).otherwise(name)
    return F.when(~title.isin(*transient) & (name != "") & ~name.isin(*transient), name)


def tokens(text: Column) -> Column:
    """Distinct lower-case Unicode words, in order of first place."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"((?U)\w+)"), F.lit(1)), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: null if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def content_drift(a: Column, b: Column) -> Column:
    """struct(drift, available): 1 - Jaccard, and (0, false) if either set is empty."""
    known = (F.size(a) > 0) & (F.size(b) > 0)
    return F.struct(F.when(known, 1 - jaccard(a, b)).otherwise(0.0).alias("drift"), known.alias("available"))


def log1p_gap(gap_ms: Column) -> Column:
    return F.log1p(F.greatest(gap_ms, F.lit(0)))


def iso_utc(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def candidate_source(first: Column, second: Column) -> Column:
    return F.when(first & second, "both").when(first, "v1_only").when(second, "v2_only").otherwise("neither")


def excluded(process: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | process.startswith(prefix)
    return out


def redacted(fields: Column, secret: str, text: str) -> Column:
    """A map without its secret-like keys; of text-like values only the length stays, as ``<key>_length``."""
    kept = F.map_filter(fields, lambda k, v: ~k.rlike(secret) & ~k.rlike(text))
    texts = F.map_filter(fields, lambda k, v: ~k.rlike(secret) & k.rlike(text))
    lengths = F.transform_values(F.transform_keys(texts, lambda k, v: F.concat(k, F.lit("_length"))), lambda k, v: F.length(v).cast("string"))
    return F.map_concat(kept, lengths)
