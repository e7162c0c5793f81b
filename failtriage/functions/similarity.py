"""Word sets, Jaccard similarity and the weighted score, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from failtriage.rules import MIN_TERM_CHARS, STOP_WORDS, WEIGHTS, Weights

WORD = r"[\p{L}\p{N}_]+"
HYPHENATED = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"


def word_set(text: Column) -> Column:
    """Distinct lower-cased words without stop words; null counts as empty text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS]))


def present(values: str | Column) -> Column:
    """A list of texts; an absent one is empty."""
    return F.coalesce(values, F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 when either is empty.

    Both arguments are arrays without duplicates.
    """
    shared = F.size(F.array_intersect(a, b)).cast("double")
    total = F.size(a).cast("double") + F.size(b).cast("double") - shared
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / total)


def text_jaccard(a: Column, b: Column) -> Column:
    return jaccard(word_set(a), word_set(b))


def list_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two lists, case kept, no stop words."""
    return jaccard(F.array_distinct(a), F.array_distinct(b))


def risk_present(level: Column, title: Column, body: Column) -> Column:
    """Whether the other issue names the risk level in title or body."""
    needle = F.lower(level)
    found = F.contains(F.lower(title), needle) | F.contains(F.lower(F.coalesce(body, F.lit(""))), needle)
    return F.coalesce(found, F.lit(False))


def type_present(types: Column, body: Column) -> Column:
    """Whether the other issue names one of the failure types in its body."""
    text = F.lower(F.coalesce(body, F.lit("")))
    return F.coalesce(F.exists(types, lambda t: F.contains(text, F.lower(t))), F.lit(False))


def weighted_score(
    title: Column, labels: Column, risk: Column, body: Column, ftype: Column, weights: Weights = WEIGHTS
) -> Column:
    """Sum of the weighted parts in this order, at most 1; ``risk`` and ``ftype`` are booleans."""

    def flag(condition: Column, weight: float) -> Column:
        return F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))

    total = title * F.lit(weights.title) + labels * F.lit(weights.labels)
    total = total + flag(risk, weights.risk)
    total = total + body * F.lit(weights.body)
    total = total + flag(ftype, weights.failure_type)
    return F.least(total, F.lit(1.0))


def clean_words(text: Column) -> Column:
    """Words worth searching for: no short words, no plain numbers; hyphens join."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(HYPHENATED), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= MIN_TERM_CHARS) & ~w.rlike(r"^\p{Nd}+\z"))


def search_terms(text: Column, n: int | None = None) -> Column:
    """The words worth searching for, or the first ``n`` of them, as one phrase."""
    words = clean_words(text)
    return F.array_join(words if n is None else F.slice(words, 1, n), " ")
