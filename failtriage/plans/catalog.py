"""Every operator as a named query over the test tables.

Results hold plain columns only: lists are joined with a bar and timestamps are
text, so any engine can compare them.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failtriage.functions import similarity as sim
from failtriage.operators import bulk, dedup, exact, groups, ingest, issues, parse, phrases, repo_rules, risk
from failtriage.operators.groups import KEY
from failtriage.plans.triage import build_issues, judged, parsed_failures, run_stats, triage
from failtriage.rules import LIST_KEYS, TEXT_RULES
from failtriage.session import configure, materialize, work_dir
from failtriage.sources import derived, ledger, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @functools.wraps(fn)
    def configured(spark: SparkSession, d: str) -> DataFrame:
        return fn(configure(spark), d)

    QUERIES[fn.__name__] = configured
    return fn


def joined(column: str | Column) -> Column:
    return F.array_join(column, "|")


def stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def failures(spark: SparkSession, d: str) -> DataFrame:
    return parsed_failures(derived.runs(spark, d), derived.jobs(spark, d), derived.logs(spark, d))


def values(spark: SparkSession, d: str) -> DataFrame:
    return groups.group_values(failures(spark, d))


def written_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failures for queries that read them more than once: logs are parsed one time."""
    return materialize(failures(spark, d), "failures")


def written_values(spark: SparkSession, d: str) -> DataFrame:
    return materialize(values(spark, d), "values")


def _cutoff() -> Column:
    return F.lit(derived.CUTOFF).cast("timestamp_ntz")


def _issues(failed: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
    """Issues of the given failures; ``distinct`` are their group values, where these are written already."""
    if distinct is None:
        distinct = materialize(groups.group_values(failed), "values")
    return build_issues(failed, distinct, derived.responses(groups.group_failures(distinct)))


def new_and_filed(spark: SparkSession, d: str, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Issues of the later half of the jobs, and those of the earlier half as found on file."""
    if failed is None:
        failed = written_failures(spark, d)
    new = _issues(failed.where(F.col("created_at") >= _cutoff()))
    filed = derived.on_file(_issues(failed.where(F.col("created_at") < _cutoff())))
    return materialize(new, "new"), materialize(filed, "filed")


def all_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues of all failures."""
    return _issues(written_failures(spark, d))


# --- sources ------------------------------------------------------------------


@query
def recent_failed_runs(spark: SparkSession, d: str) -> DataFrame:
    kept = ingest.recent_failed_runs(derived.runs(spark, d), 5)
    return kept.select("repo", "run_id", "workflow_name", stamp("created_at").alias("created_at"), "run_url")


@query
def failed_jobs(spark: SparkSession, d: str) -> DataFrame:
    kept = ingest.run_jobs(
        ingest.recent_failed_runs(derived.runs(spark, d), None), ingest.failed_jobs(derived.jobs(spark, d))
    )
    return kept.select("repo", "run_id", "job_id", "job_name", "workflow_name")


@query
def jobs_with_logs(spark: SparkSession, d: str) -> DataFrame:
    jobs = ingest.failed_jobs(derived.jobs(spark, d))
    measured = derived.logs(spark, d).select(
        "repo", "job_id", F.length("logs").cast("bigint").alias("log_chars"), F.md5("logs").alias("log_md5")
    )
    return ingest.attach_logs(jobs, measured).select("repo", "job_id", "log_chars", "log_md5")


@query
def jobs_without_logs(spark: SparkSession, d: str) -> DataFrame:
    jobs = ingest.failed_jobs(derived.jobs(spark, d))
    return ingest.missing_logs(jobs, derived.logs(spark, d)).select("repo", "job_id", "run_id")


@query
def repo_identity(spark: SparkSession, d: str) -> DataFrame:
    return ingest.with_repo(derived.addresses(spark, d), "url").select("run_id", "owner", "repo_name")


@query
def repo_identity_rejects(spark: SparkSession, d: str) -> DataFrame:
    return ingest.repo_rejects(derived.addresses(spark, d), "url").select("run_id", "url")


@query
def open_issues(spark: SparkSession, d: str) -> DataFrame:
    filed = derived.on_file(all_issues(spark, d))
    return ingest.open_issues(filed).select("repo", "number", "title", joined("labels").alias("labels"))


# --- parsing ------------------------------------------------------------------


@query
def error_patterns(spark: SparkSession, d: str) -> DataFrame:
    logs = derived.logs(spark, d)
    return logs.select("repo", "job_id", joined(parse.error_patterns(F.col("logs"))).alias("patterns"))


@query
def affected_files(spark: SparkSession, d: str) -> DataFrame:
    logs = derived.logs(spark, d)
    return logs.select("repo", "job_id", joined(parse.affected_files(F.col("logs"))).alias("files"))


@query
def failure_types(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_logs(derived.logs(spark, d)).select("repo", "job_id", "failure_type", "group_key")


def _text_patterns(table: DataFrame, key: str, text: str) -> DataFrame:
    """Every pattern and path of every whole text, as rows, and the class of the text."""
    parsed = table.select(
        key,
        parse.error_patterns(F.col(text), TEXT_RULES).alias("patterns"),
        parse.affected_files(F.col(text), TEXT_RULES).alias("paths"),
        parse.failure_type(F.lower(text), TEXT_RULES).alias("class"),
    )

    def tagged(kind: str, column: str) -> Column:
        return F.transform(column, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return parsed.select(key, "class", F.inline(F.concat(tagged("pattern", "patterns"), tagged("path", "paths"))))


@query
def document_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _text_patterns(derived.table(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text")


@query
def page_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _text_patterns(derived.table(spark, d, "pages").where("html IS NOT NULL"), "page_id", "html")


# --- groups -------------------------------------------------------------------


@query
def failure_type_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = groups.type_counts(failures(spark, d))
    return counts.select("repo", "failure_type", "failure_count", stamp("last_seen").alias("last_seen"))


@query
def failure_groups(spark: SparkSession, d: str) -> DataFrame:
    found = groups.group_failures(values(spark, d))
    return found.select(
        *KEY, "failure_count", "failure_type", stamp("first_seen").alias("first_seen"),
        stamp("last_seen").alias("last_seen"), "first_job_id",
    )


@query
def group_values(spark: SparkSession, d: str) -> DataFrame:
    return values(spark, d).select(*KEY, "kind", "value", "occurrences")


@query
def group_context(spark: SparkSession, d: str) -> DataFrame:
    distinct = written_values(spark, d)
    shown = groups.shown_values(distinct)
    return groups.value_counts(distinct).join(shown, KEY, "left").select(
        *KEY, "type_count", "pattern_count", "file_count",
        joined("top_patterns").alias("top_patterns"), joined("top_files").alias("top_files"),
    )


@query
def group_recent_links(spark: SparkSession, d: str) -> DataFrame:
    summary = groups.occurrence_summary(written_failures(spark, d))
    return summary.select(
        *KEY, "failure_count", stamp("first_seen").alias("first_seen"), stamp("last_seen").alias("last_seen"),
        joined("links").alias("links"), "more_links",
    )


@query
def analysis_context(spark: SparkSession, d: str) -> DataFrame:
    failed = written_failures(spark, d)
    distinct = groups.group_values(failed)
    samples = groups.sample_logs(failed, derived.logs(spark, d))
    return groups.analysis_context(groups.group_failures(distinct), groups.shown_values(distinct), samples)


@query
def pattern_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = groups.pattern_runs(failures(spark, d))
    return rows.select("repo", "failure_type", "signature", "run_id", "occurrences")


@query
def pattern_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = groups.pattern_rollup(failures(spark, d))
    return rows.withColumns({"first_seen": stamp("first_seen"), "last_seen": stamp("last_seen")})


# --- signatures and similarity --------------------------------------------------


@query
def text_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each conversation turn to the next one."""
    turns = derived.table(spark, d, "conversations").select("conv_id", "turn", sim.word_set(F.col("text")).alias("a"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    pairs = turns.join(following, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", sim.jaccard(F.col("a"), F.col("b")).alias("similarity"))


@query
def label_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of the status and priority lists of neighbouring orders."""
    orders = derived.table(spark, d, "orders").select(
        "o_orderkey", F.array("o_orderstatus", "o_orderpriority", F.substring("o_orderpriority", 1, 1)).alias("a")
    )
    following = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("a").alias("b"))
    return orders.join(following, "o_orderkey").select(
        "o_orderkey", sim.list_jaccard(F.col("a"), F.col("b")).alias("similarity")
    )


@query
def normalized_patterns(spark: SparkSession, d: str) -> DataFrame:
    logs = derived.logs(spark, d).select("repo", "job_id", "logs")
    lines = logs.select(
        "repo", "job_id", F.posexplode(F.split("logs", "\n")).alias("line_no", "line")
    )
    return lines.select(
        "repo", "job_id", F.col("line_no").cast("bigint").alias("line_no"),
        groups.normalize_pattern(F.col("line")).alias("normalized"),
    )


@query
def issue_signatures(spark: SparkSession, d: str) -> DataFrame:
    signed = exact.with_signature(failures(spark, d).withColumn("failure_types", F.array("failure_type")))
    return signed.select("repo", "job_id", "error_hash", "file_hash", "type_hash", "signature", "short_signature")


@query
def group_signatures(spark: SparkSession, d: str) -> DataFrame:
    return exact.group_signatures(written_values(spark, d))


@query
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    """Words worth searching for of every whole text."""
    docs = derived.table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("number"), sim.search_terms(F.col("text")).alias("terms"))


@query
def exact_signature_dups(spark: SparkSession, d: str) -> DataFrame:
    failed = written_failures(spark, d)

    def signed(part: DataFrame) -> DataFrame:
        distinct = groups.group_values(part)
        numbers = groups.group_failures(distinct).select(*KEY, F.col("first_job_id").alias("number"))
        signed_groups = exact.group_signatures(distinct).join(numbers, KEY)
        return materialize(signed_groups.select("repo", "number", "signature"), "signed")

    later = signed(failed.where(F.col("created_at") >= _cutoff()))
    earlier = signed(failed.where(F.col("created_at") < _cutoff()))
    return exact.exact_duplicates(later, earlier)


# --- risk -----------------------------------------------------------------------


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return risk.risk_scores(values(spark, d))


@query
def risk_overrides(spark: SparkSession, d: str) -> DataFrame:
    found = risk.override_levels(values(spark, d))
    return found.withColumn("override_pos", F.col("override_pos").cast("bigint"))


@query
def safe_score(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select(*KEY, "safe_hits", "pattern_count", "file_count", "safe_score")


@query
def strategic_score(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select(*KEY, "strategic_hits", "phrase_count", "strategic_score")


@query
def tactical_hits(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select(*KEY, "tactical_hits")


@query
def risk_levels(spark: SparkSession, d: str) -> DataFrame:
    return risk.assess_risk(_scores(spark, d)).select(*KEY, "risk_level", "required_expertise", "confidence")


@query
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    return risk.assess_risk(_scores(spark, d)).select(*KEY, "blast_radius")


@query
def effort(spark: SparkSession, d: str) -> DataFrame:
    return risk.assess_risk(_scores(spark, d)).select(*KEY, "risk_level", "estimated_effort")


@query
def reasoning(spark: SparkSession, d: str) -> DataFrame:
    return risk.assess_risk(_scores(spark, d)).select(*KEY, "reasoning")


@query
def team_routing(spark: SparkSession, d: str) -> DataFrame:
    return risk.route_teams(values(spark, d))


@query
def repo_risk_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Risk levels that the rules of each repository give to groups."""
    found = repo_rules.override_levels(written_values(spark, d), derived.repo_rules(spark, d))
    return found.withColumn("override_pos", F.col("override_pos").cast("bigint"))


@query
def repo_team_routing(spark: SparkSession, d: str) -> DataFrame:
    """Teams by the rules of each repository."""
    return repo_rules.route_teams(written_values(spark, d), derived.repo_rules(spark, d))


# --- issues ---------------------------------------------------------------------


@query
def fallback_issues(spark: SparkSession, d: str) -> DataFrame:
    rows = issues.fallback_fields(groups.group_failures(values(spark, d)))
    return rows.select(
        *KEY, "title", "risk_level", F.col("priority").cast("bigint").alias("priority"),
        "estimated_effort", "required_expertise", joined("labels").alias("labels"),
    )


@query
def parsed_responses(spark: SparkSession, d: str) -> DataFrame:
    answers = issues.accepted_responses(derived.responses(groups.group_failures(values(spark, d))))
    return answers.withColumns(
        {"priority": F.col("priority").cast("bigint"), **{k: joined(k) for k in LIST_KEYS}}
    )


@query
def rejected_responses(spark: SparkSession, d: str) -> DataFrame:
    return issues.rejected_responses(derived.responses(groups.group_failures(values(spark, d))))


@query
def unused_responses(spark: SparkSession, d: str) -> DataFrame:
    """Accepted answers that no issue is made of, as their group has another one."""
    answers = issues.unused_answers(derived.responses(groups.group_failures(values(spark, d))))
    return answers.select(*KEY, "title", F.col("priority").cast("bigint").alias("priority"), "estimated_effort")


@query
def response_issues(spark: SparkSession, d: str) -> DataFrame:
    new = all_issues(spark, d)
    return new.select(
        *KEY, "number", "title", "risk_level", F.col("priority").cast("bigint").alias("priority"),
        "estimated_effort", "required_expertise",
    )


@query
def issue_files(spark: SparkSession, d: str) -> DataFrame:
    return issues.answer_files(derived.responses(groups.group_failures(values(spark, d))))


@query
def issue_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Issues whose risk level is configured, as they read."""
    configured = risk.override_levels(values(spark, d)).select(*KEY, F.col("override_pos").cast("bigint").alias("override_pos"))
    found = all_issues(spark, d).join(configured, KEY)
    return found.select(
        *KEY, "override_pos", "risk_level", "title", joined("labels").alias("labels"), joined("assignees").alias("assignees")
    )


@query
def issue_bodies(spark: SparkSession, d: str) -> DataFrame:
    new = all_issues(spark, d)
    return new.select(*KEY, "body")


@query
def issue_labels(spark: SparkSession, d: str) -> DataFrame:
    new = all_issues(spark, d)
    return new.select(*KEY, joined("labels").alias("labels"))


@query
def issue_assignees(spark: SparkSession, d: str) -> DataFrame:
    new = all_issues(spark, d)
    return new.select(*KEY, joined("assignees").alias("assignees"))


@query
def focus_filter(spark: SparkSession, d: str) -> DataFrame:
    new = all_issues(spark, d)
    return issues.focus(new, "strategic").select("repo", "number", "title")


@query
def priority_filter(spark: SparkSession, d: str) -> DataFrame:
    new = all_issues(spark, d)
    kept = issues.at_least(new, 60)
    return kept.select("repo", "number", F.col("priority").cast("bigint").alias("priority"))


@query
def risk_summary(spark: SparkSession, d: str) -> DataFrame:
    new = all_issues(spark, d)
    return issues.risk_summary(new)


@query
def json_export(spark: SparkSession, d: str) -> DataFrame:
    new = all_issues(spark, d)
    return sinks.export_json(new)


@query
def json_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of a whole analysis per repository, as they are exported."""
    failed = written_failures(spark, d)
    new, verdict = _verdicts(spark, d, failed)
    later = failed.where(F.col("created_at") >= _cutoff())
    return sinks.export_stats(run_stats(later, new, dedup.only_new(new, verdict), 5))


# --- duplicates -----------------------------------------------------------------


def _verdicts(spark: SparkSession, d: str, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New issues and the verdict on each."""
    new, filed = new_and_filed(spark, d, failed)
    return new, judged(new, filed)


@query
def candidates(spark: SparkSession, d: str) -> DataFrame:
    new, filed = new_and_filed(spark, d)
    found = dedup.candidates(new, ingest.open_issues(filed))
    return found.select(
        "repo", "number", "candidate", F.col("search_rank").cast("bigint").alias("search_rank"),
        F.col("place").cast("bigint").alias("place"),
    )


@query
def phrase_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Open issues that hold the first error pattern of new issues, once for each pattern."""
    new, filed = new_and_filed(spark, d)
    return phrases.phrase_matches(phrases.issue_phrases(new), ingest.open_issues(filed))


@query
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    new, filed = new_and_filed(spark, d)
    on_file = ingest.open_issues(filed)
    return dedup.score_pairs(dedup.candidates(new, on_file), new, on_file).drop("search_rank", "place")


@query
def best_match(spark: SparkSession, d: str) -> DataFrame:
    """The issue on file with the greatest score, of equal ones the newest, and the oldest that reaches the threshold."""
    _, verdict = _verdicts(spark, d)
    return verdict.where("is_duplicate").select("repo", "number", "matched_number", "similarity", "oldest_number")


@query
def duplicate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d)[1]


@query
def new_issues(spark: SparkSession, d: str) -> DataFrame:
    new, verdict = _verdicts(spark, d)
    return dedup.only_new(new, verdict).select("repo", "number", "title")


@query
def recurrence_notes(spark: SparkSession, d: str) -> DataFrame:
    new, verdict = _verdicts(spark, d)
    return dedup.recurrence_notes(new, verdict)


@query
def create_actions(spark: SparkSession, d: str) -> DataFrame:
    new, verdict = _verdicts(spark, d)
    rows = sinks.create_actions(dedup.only_new(new, verdict))
    return rows.withColumns({"labels": joined("labels"), "assignees": joined("assignees")})


@query
def comment_actions(spark: SparkSession, d: str) -> DataFrame:
    new, verdict = _verdicts(spark, d)
    return sinks.comment_actions(dedup.recurrence_notes(new, verdict))


@query
def emitted_actions(spark: SparkSession, d: str) -> DataFrame:
    """Actions and the batch that emitted them: notes first, then all, then all once more, which adds none."""
    new, verdict = _verdicts(spark, d)
    every = materialize(ledger.actions(dedup.only_new(new, verdict), dedup.recurrence_notes(new, verdict)), "actions")
    path = f"{work_dir(spark)}/failtriage-{spark.sparkContext.applicationId}/actions-{uuid.uuid4().hex}"
    ledger.emit(every.where("kind = 'comment'"), path, "notes")
    ledger.emit(every, path, "all")
    ledger.emit(every, path, "again")
    return ledger.emitted(spark, path).drop("text")


@query
def triage_stats(spark: SparkSession, d: str) -> DataFrame:
    failed = written_failures(spark, d)
    new, verdict = _verdicts(spark, d, failed)
    later = failed.where(F.col("created_at") >= _cutoff())
    return run_stats(later, new, dedup.only_new(new, verdict), None)


@query
def dry_run(spark: SparkSession, d: str) -> DataFrame:
    """What a whole analysis would open, nothing being sent anywhere."""
    failed_runs = derived.runs(spark, d).withColumn("status", F.lit("failure"))
    failed = written_failures(spark, d)
    distinct = materialize(groups.group_values(failed), "values")
    answers = derived.responses(groups.group_failures(distinct))
    filed = materialize(derived.on_file(_issues(failed, distinct)), "filed")
    done = triage(
        failed_runs, derived.jobs(spark, d), derived.logs(spark, d), filed,
        responses=answers, min_priority=60,
    )
    return done.to_create.select("repo", "number", "title")


@query
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    new, filed = new_and_filed(spark, d)
    return bulk.near_duplicates(new, ingest.open_issues(filed))


@query
def near_duplicates_half(spark: SparkSession, d: str) -> DataFrame:
    """At a threshold that labels, risk and types can reach without any title."""
    new, filed = new_and_filed(spark, d)
    return bulk.near_duplicates(new, ingest.open_issues(filed), threshold=0.5)


@query
def near_duplicate_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = derived.doc_issues(spark, d)
    types = ["docs_en", "docs_de", "docs_es", "docs_fr"]
    return bulk.near_duplicates(docs, docs, failure_types=types, earlier_only=True)
