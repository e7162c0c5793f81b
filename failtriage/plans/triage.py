"""The whole analysis as one plan: failures, groups, risk, issues, verdicts, actions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failtriage.operators import bulk, dedup, groups, ingest, issues, parse, risk
from failtriage.operators.bulk import KNOWN_TYPES
from failtriage.operators.groups import KEY
from failtriage.rules import DEFAULT_RULES, DUPLICATE_THRESHOLD, RuleSet
from failtriage.session import materialize


#: The bitmap of failed jobs: few bits for a key, as a log too many is parsed and then not joined.
JOB_BITS, JOB_WORDS = 16, 1 << 18


def parsed_failures(runs: DataFrame, jobs: DataFrame, logs: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Failed jobs of the given runs with what was parsed from their logs.

    Logs are parsed before the join, so raw text is never shuffled. The failed jobs
    are written first: a bitmap of their keys drops the logs of most other jobs
    where they are read, and the join drops the rest.
    """
    job = ["repo", "job_id"]
    failed = materialize(ingest.run_jobs(runs, ingest.failed_jobs(jobs)), "failed-jobs")
    bitmap, words = groups.key_bitmap(failed.select(*job), job, JOB_BITS, JOB_WORDS)
    return ingest.attach_logs(failed, parse.parse_logs(groups.in_bitmap(logs, bitmap, words, job), rules))


def build_issues(
    failures: DataFrame, values: DataFrame, responses: DataFrame | None = None, rules: RuleSet = DEFAULT_RULES
) -> DataFrame:
    """One issue per failure group, with configured risk levels; ``values`` are the group values of ``failures``."""
    fields = issues.fallback_fields(groups.group_failures(values), rules)
    fields = issues.without_answers(fields) if responses is None else issues.response_issues(fields, responses)
    fields = issues.apply_overrides(fields, risk.override_levels(values, rules))
    return issues.assemble_issues(fields, groups.shown_values(values), groups.recent_links(failures))


@dataclass
class Triage:
    """Results of one analysis; all are lazy but the written tables they read."""

    failures: DataFrame
    risks: DataFrame
    issues: DataFrame
    verdicts: DataFrame
    to_create: DataFrame
    to_comment: DataFrame
    stats: DataFrame


def run_stats(failures: DataFrame, all_issues: DataFrame, left: DataFrame, runs_requested: int | None) -> DataFrame:
    """Per repository: runs asked for and seen, failures, groups, issues left."""
    seen = failures.groupBy("repo").agg(
        F.count_distinct("run_id").alias("runs_seen"), F.count("*").alias("total_failures")
    )
    grouped = all_issues.groupBy("repo").agg(F.count("*").alias("failure_groups"))
    kept = left.groupBy("repo").agg(F.count("*").alias("issues_left"))
    joined = seen.join(grouped, "repo", "left").join(kept, "repo", "left")
    return joined.select(
        "repo",
        F.lit(runs_requested).cast("bigint").alias("runs_requested"),
        "runs_seen", "total_failures",
        F.coalesce("failure_groups", F.lit(0)).cast("bigint").alias("failure_groups"),
        F.coalesce("issues_left", F.lit(0)).cast("bigint").alias("issues_left"),
    )


def no_matches(new: DataFrame) -> DataFrame:
    """An empty table of matches, for when duplicates are not looked for."""
    return new.where(F.lit(False)).select(
        *dedup.ISSUE, F.lit(None).cast("bigint").alias("matched_number"), F.lit(None).cast("double").alias("similarity"),
        F.lit(None).cast("bigint").alias("oldest_number"),
    )


def judged(new: DataFrame, existing: DataFrame, threshold: float = DUPLICATE_THRESHOLD, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """The verdict on each new issue by the search over all open issues; written, as several tables are made of it."""
    types = tuple(dict.fromkeys([*(t.failure_type for t in rules.types), *KNOWN_TYPES]))
    found = bulk.near_duplicates(new, ingest.open_issues(existing), threshold=threshold, failure_types=types, best=True)
    return materialize(dedup.verdicts(new, found), "verdicts")


def triage(
    runs: DataFrame, jobs: DataFrame, logs: DataFrame, existing: DataFrame, *,
    responses: DataFrame | None = None,
    n_runs: int | None = None,
    level: str = "all",
    min_priority: int = 1,
    threshold: float = DUPLICATE_THRESHOLD,
    check_duplicates: bool = True,
    comment: bool = True,
    rules: RuleSet = DEFAULT_RULES,
) -> Triage:
    """Analyse all repositories at once. Nothing is written but intermediate tables.

    Failures, group values and issues have several consumers each, so they are
    written once in the shared folder and read back.
    """
    recent = ingest.recent_failed_runs(runs, n_runs)
    failures = materialize(parsed_failures(recent, jobs, logs, rules), "failures")
    values = materialize(groups.group_values(failures), "values")
    risks = risk.assess_risk(risk.risk_scores(values, rules), rules)
    all_issues = materialize(build_issues(failures, values, responses, rules), "issues")
    wanted = issues.at_least(issues.focus(all_issues, level), min_priority)
    verdict = judged(wanted, existing, threshold, rules) if check_duplicates else dedup.verdicts(wanted, no_matches(wanted))
    to_create = dedup.only_new(wanted, verdict, check_duplicates)
    notes = dedup.recurrence_notes(wanted, verdict, comment and check_duplicates)
    return Triage(
        failures=failures,
        risks=risks,
        issues=wanted.join(risks.select(*KEY, "blast_radius", "confidence", "reasoning"), KEY, "left"),
        verdicts=verdict,
        to_create=to_create,
        to_comment=notes,
        stats=run_stats(failures, all_issues, to_create, n_runs),
    )
