"""Column functions over log text and rule tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from failtriage.rules import ExtractRule

# i: any case, u: also for non-ASCII letters, d: only \n ends a line
ANY_CASE = "(?iud)"
EXACT_CASE = "(?d)"


def matches(text: Column, rule: ExtractRule, *, any_case: bool) -> Column:
    """All matches of one rule, in order of position.

    Rules with two or more groups give the text of a tuple, ``('a', 'b')``.
    """
    pattern = F.lit((ANY_CASE if any_case else EXACT_CASE) + rule.pattern)
    if rule.groups <= 1:
        return F.regexp_extract_all(text, pattern, F.lit(rule.groups))
    parts = [F.regexp_extract_all(text, pattern, F.lit(g + 1)) for g in range(rule.groups)]

    def as_tuple(row: Column) -> Column:
        quoted = F.concat_ws("', '", *[row[str(g)] for g in range(rule.groups)])
        return F.concat(F.lit("('"), quoted, F.lit("')"))

    zipped = F.arrays_zip(*[p.alias(str(g)) for g, p in enumerate(parts)])
    return F.transform(zipped, as_tuple)


def all_matches(text: Column, rules: Sequence[ExtractRule], *, any_case: bool) -> Column:
    """Distinct matches of all rules: rule order, then position, first one kept."""
    return F.array_distinct(F.concat(*[matches(text, r, any_case=any_case) for r in rules]))


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases], F.lit(False))


def alternation(patterns: Iterable[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def rlike_any(text: Column, patterns: Iterable[str], *, any_case: bool = True) -> Column:
    joined = alternation(patterns)
    if not joined:
        return F.lit(False)
    return text.rlike((ANY_CASE if any_case else EXACT_CASE) + joined)


def found_phrases(text: Column, phrases: Sequence[str], patterns: Sequence[str] = ()) -> Column:
    """The phrases that ``text`` contains and the patterns that match it, any number of them."""
    found = [F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases]
    found += [F.when(text.rlike(EXACT_CASE + p), F.lit(p)) for p in patterns]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def glob_to_regex(glob: str) -> str:
    """Unanchored regular expression: a star is any text, all else is literal."""
    return ".*".join(_quote(part) for part in glob.split("*"))


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_/ -" else "\\" + c for c in text)


def first_override(path: Column, globs: Sequence[str]) -> Column:
    """Position of the first glob that matches ``path``, else null."""
    if not globs:
        return F.lit(None).cast("int")
    tests = [F.when(path.rlike("(?iuds)" + glob_to_regex(g)), F.lit(i)) for i, g in enumerate(globs)]
    return F.coalesce(*tests)


def strip(text: Column) -> Column:
    """Trim white space of any kind, as ``trim`` only removes blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def two_decimals(value: Column) -> Column:
    """A non-negative number with two decimals, halves rounded up."""
    cents = F.floor(value * F.lit(100.0) + F.lit(0.5)).cast("bigint")
    whole = ((cents - cents % 100) / 100).cast("bigint").cast("string")
    return F.concat(whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
