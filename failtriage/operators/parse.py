"""Log parsing: error patterns, affected files, failure type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failtriage.functions.text import all_matches, contains_any, found_phrases
from failtriage.rules import DEFAULT_RULES, UNKNOWN, RuleSet

_ADDRESS = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"


def error_patterns(text: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """All distinct error patterns of a whole log, any case."""
    return all_matches(text, rules.errors, any_case=True)


def affected_files(text: Column, rules: RuleSet = DEFAULT_RULES, *, drop_addresses: bool = True) -> Column:
    """All distinct files of a whole log but noise."""
    found = all_matches(text, rules.files, any_case=False)

    def wanted(path: Column) -> Column:
        keep = ~contains_any(path, rules.noise)
        return keep & ~path.rlike(_ADDRESS) if drop_addresses else keep

    return F.filter(found, wanted)


def failure_type(lowered: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """First class with a phrase in the lower-cased log."""
    chain = F
    for rule in rules.types:
        chain = chain.when(contains_any(lowered, rule.phrases), F.lit(rule.failure_type))
    return chain.otherwise(F.lit(UNKNOWN)) if chain is not F else F.lit(UNKNOWN)


def group_key(ftype: Column, patterns: Column, files: Column) -> Column:
    """Type, first pattern, first file; absent parts are skipped."""
    return F.concat_ws("|", ftype, F.get(patterns, 0), F.get(files, 0))


def parse_logs(logs: DataFrame, rules: RuleSet = DEFAULT_RULES, *, drop_addresses: bool = True) -> DataFrame:
    """Replace ``logs`` by what later steps need of it.

    The text is read once, where it is stored; afterwards a row holds patterns,
    files and the safe commands and sensitive phrases that the log names.
    """
    text = F.coalesce(F.col("logs"), F.lit(""))
    parsed = logs.withColumn("_lower", F.lower(text)).withColumns(
        {
            "error_patterns": error_patterns(text, rules),
            "affected_files": affected_files(text, rules, drop_addresses=drop_addresses),
            "failure_type": failure_type(F.col("_lower"), rules),
            "commands": found_phrases(F.col("_lower"), rules.safe.log_phrases, rules.safe.log_patterns),
            "phrases": found_phrases(F.col("_lower"), rules.strategic.log_phrases, rules.strategic.log_patterns),
        }
    )
    key = group_key(F.col("failure_type"), F.col("error_patterns"), F.col("affected_files"))
    return parsed.withColumn("group_key", key).drop("logs", "_lower")
