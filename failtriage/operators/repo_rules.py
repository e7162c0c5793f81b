"""Path rules that every repository has of its own: risk overrides and team routing.

Rules are a table, as many as there are repositories, so they cannot be one
expression. A star of a glob is any text, all else is literal, and a glob may
match anywhere in a path. So a path that matches holds each literal piece of the
glob, and each run of ``GRAM`` characters of it. The run that fewest rules have
becomes the key of a rule; distinct paths meet rules on their own runs, and the
whole glob is tried on those that meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failtriage.operators.groups import KEY
from failtriage.session import materialize

#: Characters of a key; shorter pieces are keys as a whole.
GRAM = 4
#: Characters that are special in a regular expression.
_SPECIAL = r"([^\p{L}\p{N}_/ -])"


def _folded(text: Column) -> Column:
    """The same text for all spellings that differ in case only."""
    return F.lower(F.upper(F.translate(text, "İı", "ii")))


def _runs(text: Column, size: int) -> Column:
    """All distinct runs of ``size`` characters."""
    last = F.length(text) - F.lit(size - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def glob_pattern(glob: Column, *, any_case: bool) -> Column:
    """The regular expression of a glob that may match anywhere."""
    quoted = F.regexp_replace(glob, _SPECIAL, r"\\$1")
    return F.concat(F.lit("(?iuds)" if any_case else "(?ds)"), F.replace(quoted, F.lit("\\*"), F.lit(".*")))


def _keyed(rules: DataFrame) -> DataFrame:
    """Each rule with its key: of the runs of its longest literal piece the one that fewest rules of the repository have.

    A rule of stars only has an empty key, which all paths have.
    """
    pieces = F.split(_folded(F.col("pattern")), r"\*")
    longest = F.element_at(F.array_sort(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("piece")))), -1)["piece"]
    runs = F.when(F.length(longest) >= GRAM, _runs(longest, GRAM)).otherwise(F.array(longest))
    numbered = materialize(rules.withColumn("_rule", F.monotonically_increasing_id()), "rules")
    spread = numbered.select("repo", "_rule", F.explode(runs).alias("key"))
    holders = spread.groupBy("repo", "key").agg(F.count("*").alias("holders"))
    chosen = spread.join(holders, ["repo", "key"]).groupBy("_rule").agg(F.min(F.struct("holders", "key")).alias("least"))
    return numbered.join(chosen.select("_rule", F.col("least.key").alias("key")), "_rule").drop("_rule")


def matching_rules(values: DataFrame, rules: DataFrame, *, any_case: bool) -> DataFrame:
    """``repo, value`` of each distinct file with the columns of each rule of its repository that matches it.

    ``rules`` holds ``repo`` and ``pattern``, a glob, among others.
    """
    keyed = materialize(_keyed(rules.where("repo IS NOT NULL AND pattern IS NOT NULL")), "keyed-rules")
    paths = values.where(F.col("kind") == "file").select("repo", "value").distinct()
    folded = _folded(F.col("value"))
    keys = F.concat(F.array(F.lit("")), *[_runs(folded, size) for size in range(1, GRAM + 1)])
    known = keyed.select("repo", "key").distinct()
    # Few of the runs of a path are keys; the others are dropped before rules come in.
    met = materialize(paths.withColumn("key", F.explode(keys)).join(known, ["repo", "key"], "left_semi"), "path-keys")
    pattern = glob_pattern(F.col("pattern"), any_case=any_case)
    return met.join(keyed.withColumn("_regex", pattern), ["repo", "key"]).where("value RLIKE _regex").drop("key", "_regex")


def override_levels(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Groups with a file that a rule of their repository matches; the rule with the lowest ``pos`` wins.

    ``rules`` holds ``repo, pos, pattern, risk_level``; of equal places the least level counts.
    """
    hits = matching_rules(values, rules, any_case=True).groupBy("repo", "value").agg(F.min(F.struct("pos", "risk_level")).alias("rule"))
    files = values.where(F.col("kind") == "file").select(*KEY, "value")
    first = files.join(hits, ["repo", "value"]).groupBy(*KEY).agg(F.min("rule").alias("rule"))
    return first.select(*KEY, F.col("rule.pos").alias("override_pos"), F.col("rule.risk_level").alias("risk_level"))


def route_teams(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Teams responsible for a file of a group by the rules of its repository, ``repo, team, pattern``; letter case counts."""
    hits = matching_rules(values, rules, any_case=False).select("repo", "value", "team").distinct()
    files = values.where(F.col("kind") == "file").select(*KEY, "value")
    return files.join(hits, ["repo", "value"]).select(*KEY, "team").distinct()
