"""Scalar expressions: tolerant equality, formatting, recoding, URLs, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_close(a: Column, b: Column, rtol: float = 1e-9, atol: float = 1e-12) -> Column:
    """Equal within tolerance; null equals null only."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), F.lit(False))


def span_text(seconds: Column) -> Column:
    """A length of time in its largest whole unit."""
    unit = lambda n, one: F.concat(F.floor(seconds / n).cast("string"), F.lit(" " + one), F.when(F.floor(seconds / n) == 1, "").otherwise("s"))
    return F.when(seconds >= 86400, unit(86400, "day")).when(seconds >= 3600, unit(3600, "hour")).otherwise(unit(60, "minute"))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def recode(value: Column, table: dict[str, str], otherwise: Column) -> Column:
    """Lookup in a fixed map."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.element_at(pairs, value), otherwise)
