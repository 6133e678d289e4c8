"""Text column expressions: relevance, keywords, domains."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.rules import TWO_PART_TLDS

_WORD = r"[\p{L}\p{N}_]"
_BREAK = "\x01"  # a character no keyword holds


def _quoted(term: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", term)


def any_term(text: Column, terms: Sequence[str]) -> Column:
    """True where any term is a substring of the lowered text: one pass, one pattern."""
    return F.coalesce(F.lower(text).rlike("|".join(_quoted(t) for t in terms)), F.lit(False))


def has_keyword(lowered: Column, keyword: str) -> Column:
    """Single words need token edges; phrases match as substrings.

    A plain substring test comes first and settles most texts. The pattern starts with
    the literal, so the edges are looked at only where it occurs. They are spelled out
    because `\\b` treats accented letters differently between regex engines.
    """
    kw = keyword.lower().strip()
    inside = F.contains(lowered, F.lit(kw))
    if " " in kw:
        return inside
    literal = _quoted(kw)
    return inside & lowered.rlike(f"{literal}(?<!{_WORD}{literal})(?!{_WORD})")


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """Which keywords occur, each once, in list order.

    Built from functions that take part in code generation, so that the text is
    lowered once for all keywords.
    """
    lowered = F.lower(text)
    names = list(dict.fromkeys(k.lower().strip() for k in keywords if k.strip()))
    joined = F.concat_ws(_BREAK, *[F.when(has_keyword(lowered, k), F.lit(k)) for k in names])
    return F.array_remove(F.split(joined, _BREAK), "")


def domain_of(url: Column) -> Column:
    """Last two host labels, three under a two-part suffix; empty for garbage."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    labels = F.split(host, r"\.")
    tail2 = F.concat_ws(".", F.slice(labels, -2, 2))
    return (
        F.when(host.isNull() | (host == ""), F.lit(""))
        .when(F.size(labels) < 2, host)
        .when(
            (F.size(labels) >= 3) & tail2.isin(*TWO_PART_TLDS),
            F.concat_ws(".", F.slice(labels, -3, 3)),
        )
        .otherwise(tail2)
    )


def word_count(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"\s+")))


def strip_tags(html: Column) -> Column:
    """Visible text of a fragment: tags become spaces, runs of space collapse."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " "))
