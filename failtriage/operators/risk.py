"""Risk scoring of failure groups.

Hits are counted over the distinct values of a group with partial aggregation,
so a group with very many patterns or files needs no array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failtriage.functions.text import (
    contains_any, first_override, glob_to_regex, rlike_any, two_decimals,
)
from failtriage.operators.groups import KEY
from failtriage.rules import (
    DEFAULT_BLAST, DEFAULT_RULES, NAMED_FAMILIES, RAISED_SCORE, RuleSet,
)


def value_hits(values: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Per group, how many distinct values match each rule family, and which file families it touches."""
    value = F.col("value")
    is_pattern, is_file = F.col("kind") == "pattern", F.col("kind") == "file"

    def hits(name: str, family) -> Column:
        hit = (is_pattern & rlike_any(value, family.error_patterns)) | (
            is_file & rlike_any(value, family.file_patterns)
        )
        return F.count_if(hit).alias(name)

    families = [F.coalesce(F.bool_or(is_file & rlike_any(value, [p])), F.lit(False)) for _, p in rules.blast]
    override = F.when(is_file, first_override(value, [o.pattern for o in rules.overrides]))
    return values.groupBy(*KEY).agg(
        F.count_if(is_pattern).alias("pattern_count"),
        F.count_if(is_file).alias("file_count"),
        hits("safe_hits", rules.safe),
        hits("strategic_hits", rules.strategic),
        hits("tactical_hits", rules.tactical),
        F.coalesce(F.bool_or(is_pattern & contains_any(F.lower(value), rules.autofix)), F.lit(False)).alias("autofix"),
        F.count_if(is_file & rlike_any(value, rules.strategic.file_patterns, any_case=False)).alias("critical_files"),
        F.array(*families).cast("array<boolean>").alias("families"),
        F.count_if(F.col("kind") == "command").alias("command_count"),
        F.count_if(F.col("kind") == "phrase").alias("phrase_count"),
        F.count_if(is_file & rlike_any(value, [rules.document_files])).alias("document_files"),
        F.min(override).alias("override_pos"),
    )


def safe_score() -> Column:
    """Hits over checks: one check per pattern and file, one for the commands of the log."""
    command = F.when(F.col("command_count") > 0, F.lit(1)).otherwise(F.lit(0))
    checks = F.col("pattern_count") + F.col("file_count") + F.lit(1)
    return (F.col("safe_hits") + command).cast("double") / checks.cast("double")


def strategic_score() -> Column:
    """Two points per hit and half a point per phrase, over two per item and one."""
    phrases = F.col("phrase_count").cast("double") * F.lit(0.5)
    points = F.col("strategic_hits").cast("double") * F.lit(2.0) + phrases
    most = (F.col("pattern_count") + F.col("file_count")).cast("double") * F.lit(2.0) + F.lit(1.0)
    return points / most


def risk_scores(values: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    return value_hits(values, rules).withColumns({"safe_score": safe_score(), "strategic_score": strategic_score()})


def _blast_radius(rules: RuleSet) -> Column:
    """All file families that a strategic group touches; of others, what their level means."""
    names = [F.when(_touches(rules, name), F.lit(name)) for name, _ in rules.blast]
    found = F.array_compact(F.array(*names)).cast("array<string>")
    strategic = F.when(F.size(found) == 0, F.lit(DEFAULT_BLAST)).otherwise(F.array_join(found, "; "))
    chain = F
    for level, text in rules.level_blast.items():
        chain = chain.when(F.col("risk_level") == level, F.lit(text))
    return strategic if chain is F else chain.otherwise(strategic)


def _touches(rules: RuleSet, family: str) -> Column:
    known = [name for name, _ in rules.blast]
    return F.get("families", F.lit(known.index(family))) if family in known else F.lit(False)


def _effort() -> Column:
    score = F.col("strategic_score")
    strategic = (
        F.when(score > F.lit(0.8), F.lit("1 to 2 weeks"))
        .when(score > F.lit(0.5), F.lit("3 to 5 days"))
        .otherwise(F.lit("1 to 3 days"))
    )
    safe = F.when(F.col("autofix"), F.lit("under 30 minutes")).otherwise(F.lit("1 to 2 hours"))
    return (
        F.when(F.col("risk_level") == "strategic", strategic)
        .when(F.col("risk_level") == "safe", safe)
        .otherwise(F.lit("4 to 8 hours"))
    )


def _reasoning(rules: RuleSet) -> Column:
    level = F.col("risk_level")
    critical = F.when(
        F.col("critical_files") > 0,
        F.concat(F.lit("critical files: "), F.col("critical_files").cast("string")),
    )
    strategic = F.concat_ws(
        "; ",
        F.concat(F.lit("strategic score "), two_decimals(F.col("strategic_score"))),
        critical,
        *[F.when(_touches(rules, name), F.lit(f"touches {name}")) for name in NAMED_FAMILIES],
        F.when(F.col("phrase_count") > 0, F.lit("the log names sensitive areas")),
    )
    safe = F.concat_ws(
        "; ",
        F.concat(F.lit("safe score "), two_decimals(F.col("safe_score"))),
        F.when(F.col("autofix"), F.lit("a tool can fix it")),
        F.when(
            (F.col("file_count") > 0) & (F.col("document_files") == F.col("file_count")),
            F.lit("only documentation is affected"),
        ),
    )
    tactical = F.concat_ws(
        "; ",
        F.lit("neither clearly safe nor strategic"),
        F.when(
            F.col("tactical_hits") > 0,
            F.concat(F.lit("tactical hits: "), F.col("tactical_hits").cast("string")),
        ),
        F.when(
            F.col("strategic_score") > F.lit(RAISED_SCORE),
            F.concat(F.lit("raised strategic score "), two_decimals(F.col("strategic_score"))),
        ),
    )
    return F.when(level == "strategic", strategic).when(level == "safe", safe).otherwise(tactical)


def assess_risk(scores: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Risk level, blast radius, expertise, effort, confidence and reasoning per group.

    A configured override comes first, with full confidence; then the strategic
    and the safe threshold, both strict; all else is tactical.
    """
    strategic = F.col("strategic_score") > F.lit(rules.strategic_threshold)
    safe = F.col("safe_score") > F.lit(rules.safe_threshold)
    configured = F.col("override_pos").isNotNull()
    scored_level = F.when(strategic, "strategic").when(safe, "safe").otherwise("tactical")
    override = F
    for pos, rule in enumerate(rules.overrides):
        override = override.when(F.col("override_pos") == pos, F.lit(rule.risk_level))
    override_level = F.lit(None).cast("string") if override is F else override

    scored = scores.withColumn("risk_level", scored_level).withColumns(
        {
            "confidence": F.when(strategic, F.least(F.col("strategic_score"), F.lit(0.9)))
            .when(safe, F.col("safe_score"))
            .otherwise(F.lit(0.6)),
            "required_expertise": F.when(strategic, "senior").when(safe, "junior").otherwise("mid"),
            "blast_radius": _blast_radius(rules),
            "estimated_effort": _effort(),
            "reasoning": _reasoning(rules),
        }
    )
    texts = ["required_expertise", "blast_radius", "estimated_effort"]
    return scored.select(
        *KEY,
        F.coalesce(override_level, F.col("risk_level")).alias("risk_level"),
        *[F.when(configured, F.lit("configured")).otherwise(F.col(c)).alias(c) for c in texts],
        F.when(configured, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(configured, F.lit("configured override")).otherwise(F.col("reasoning")).alias("reasoning"),
        "safe_score", "strategic_score", "tactical_hits",
    )


def override_levels(values: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Groups with a file that a configured override matches; the first rule wins."""
    position = first_override(F.col("value"), [o.pattern for o in rules.overrides])
    first = values.where(F.col("kind") == "file").groupBy(*KEY).agg(F.min(position).alias("override_pos"))
    levels = F.array(*[F.lit(o.risk_level) for o in rules.overrides])
    return first.where("override_pos IS NOT NULL").select(
        *KEY, "override_pos", F.get(levels, F.col("override_pos")).alias("risk_level")
    )


def route_teams(values: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Teams responsible for a file of the group, one row per group and team."""
    path = F.col("value")
    hits = [
        F.when(
            rlike_any(path, [glob_to_regex(g) for g in team.patterns], any_case=False), F.lit(team.team)
        )
        for team in rules.teams
    ]
    return (
        values.where(F.col("kind") == "file")
        .select(*KEY, F.explode(F.array_compact(F.array(*hits))).alias("team"))
        .distinct()
    )
