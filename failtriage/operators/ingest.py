"""Selecting failed runs and jobs and attaching their logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recent_failed_runs(runs: DataFrame, n: int | None = None) -> DataFrame:
    """The ``n`` newest failed runs of each repository, or all of them for ``None``.

    The rank filter becomes a group limit before the shuffle, so a repository
    with very many runs sends at most ``n`` rows per task.
    """
    failed = runs.where(F.col("status") == "failure")
    if n is None:
        return failed
    newest = Window.partitionBy("repo").orderBy(F.desc("created_at"), F.desc("run_id"))
    return failed.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")


def run_jobs(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs of the given runs, with the workflow name and link of the run."""
    keep = runs.select("repo", "run_id", "workflow_name", "run_url")
    return jobs.join(keep, ["repo", "run_id"])


def failed_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("conclusion") == "failure")


def attach_logs(jobs: DataFrame, logs: DataFrame) -> DataFrame:
    """Jobs with their log; jobs without one are left out, see ``missing_logs``.

    ``logs`` may be raw or already parsed. Parsing first keeps raw text out of
    the shuffle: only the few extracted values travel.
    """
    return jobs.join(logs, ["repo", "job_id"])


def missing_logs(jobs: DataFrame, logs: DataFrame) -> DataFrame:
    """Jobs that ``attach_logs`` leaves out."""
    return jobs.join(logs.select("repo", "job_id"), ["repo", "job_id"], "left_anti")


def open_issues(issues: DataFrame, state: str | None = "open") -> DataFrame:
    return issues if state is None else issues.where(F.col("state") == state)


def flatten_labels(issues: DataFrame) -> DataFrame:
    """Labels given as ``array<struct<name>>`` become an array of names."""
    return issues.withColumn("labels", F.transform("labels", lambda x: x["name"]))


_HTTPS = r"^https?://[^/]+/(?:.*/)?([^/]+)/([^/]+)$"
_SSH = r"^[^@/:]+@[^:/]+:(?:.*/)?([^/]+)/([^/]+)$"


def _with_identity(df: DataFrame, url_col: str) -> DataFrame:
    url = F.regexp_replace(F.col(url_col), r"/+$", "")
    either = f"(?:{_HTTPS})|(?:{_SSH})"
    parsed = df.withColumn("_url", url)
    owner = F.concat(F.regexp_extract("_url", either, 1), F.regexp_extract("_url", either, 3))
    name = F.concat(F.regexp_extract("_url", either, 2), F.regexp_extract("_url", either, 4))
    name = F.regexp_replace(name, r"\.git$", "")
    return parsed.withColumn("owner", F.nullif(owner, F.lit(""))).withColumn(
        "repo_name", F.nullif(name, F.lit(""))
    ).drop("_url")


def with_repo(df: DataFrame, url_col: str) -> DataFrame:
    """Owner and repository name from an https or ssh address."""
    return _with_identity(df, url_col).where("owner IS NOT NULL AND repo_name IS NOT NULL")


def repo_rejects(df: DataFrame, url_col: str) -> DataFrame:
    """Rows whose address is of neither form."""
    return _with_identity(df, url_col).where("owner IS NULL OR repo_name IS NULL").drop("owner", "repo_name")
