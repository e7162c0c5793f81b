from pyspark.sql import functions as F

from failtriage.operators import groups, ingest
from failtriage.plans import catalog
from failtriage.plans import triage as triage_plan
from failtriage.plans.triage import triage
from failtriage.session import materialize, work_dir
from failtriage.sources import derived

FOLDER = "/root/testdata/sf0.001"


def inputs(spark):
    return derived.runs(spark, FOLDER), derived.jobs(spark, FOLDER), derived.logs(spark, FOLDER)


def test_whole_analysis(spark):
    runs, jobs, logs = inputs(spark)
    _, filed = catalog.new_and_filed(spark, FOLDER)
    got = triage(runs, jobs, logs, filed, n_runs=None, min_priority=40)
    found = got.issues.count()
    assert found == got.verdicts.count() > 0
    duplicates = got.verdicts.where("is_duplicate").count()
    assert got.to_create.count() == found - duplicates
    assert got.to_comment.count() == duplicates
    assert got.issues.where("blast_radius IS NULL").count() == 0
    assert got.stats.agg(F.sum("issues_left")).first()[0] == found - duplicates
    assert got.stats.where("runs_seen > total_failures").count() == 0


def test_duplicate_check_can_be_switched_off(spark):
    runs, jobs, logs = inputs(spark)
    _, filed = catalog.new_and_filed(spark, FOLDER)
    got = triage(runs, jobs, logs, filed, n_runs=200, check_duplicates=False)
    assert got.to_create.count() == got.issues.count()
    assert got.to_comment.count() == 0
    assert {r.runs_requested for r in got.stats.collect()} == {200}


def test_no_failures(spark):
    runs, jobs, logs = inputs(spark)
    _, filed = catalog.new_and_filed(spark, FOLDER)
    got = triage(runs.where("false"), jobs, logs, filed)
    assert got.issues.count() == got.to_create.count() == got.stats.count() == 0


def test_result_does_not_depend_on_partitions(spark):
    def keys(parts):
        failed = catalog.failures(spark, FOLDER).repartition(parts)
        shown = groups.shown_values(groups.group_values(failed))
        return sorted(map(repr, shown.collect()))

    assert keys(1) == keys(7)


def test_raw_logs_are_not_shuffled(spark):
    runs, jobs, logs = inputs(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        failed = catalog.parsed_failures(ingest.recent_failed_runs(runs, None), jobs, materialize(logs, "logs"))
        plan = failed._jdf.queryExecution().explainString(
            failed.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [b for b in plan.split("\n\n") if ") Exchange" in b]
    assert exchanges and not any(" logs#" in b or "[logs#" in b for b in exchanges)


def test_only_sampled_logs_are_shuffled(spark):
    logs = materialize(derived.logs(spark, FOLDER), "logs")
    failed = materialize(catalog.failures(spark, FOLDER), "failures")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        samples = groups.sample_logs(failed, logs)
        wanted = materialize(samples, "samples")
        newest = wanted.select("repo", "job_id")
        bitmap, words = groups.key_bitmap(newest, ["repo", "job_id"])
        left = groups.in_bitmap(logs, bitmap, words, ["repo", "job_id"])
        plan = left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Rows are dropped where they are read: no shuffle below the join with the bitmap.
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert wanted.count() == failed.select("repo", "group_key").distinct().count()
    assert left.join(newest, ["repo", "job_id"], "left_semi").count() == newest.count() <= left.count() <= 1.05 * newest.count() + 2
    assert left.count() < logs.count() / 2


def test_only_logs_of_failed_jobs_are_parsed(spark, monkeypatch):
    rows = spark.range(2_000).selectExpr("'a/b' AS repo", "id AS job_id", "id DIV 2 AS run_id", "id % 100 = 7 AS fails")
    jobs = rows.selectExpr(
        "*", "'unit' AS job_name", "if(fails, 'failure', 'success') AS conclusion", "timestamp_ntz'2024-01-01 00:00:00' AS created_at"
    ).drop("fails")
    runs = rows.where("run_id < 900").selectExpr("repo", "run_id", "'w' AS workflow_name", "'u' AS run_url").distinct()
    logs = rows.selectExpr("repo", "job_id", "concat('error: broken ', job_id) AS logs").where("job_id != 107")
    parsed = []
    plain = triage_plan.parse.parse_logs
    monkeypatch.setattr(triage_plan.parse, "parse_logs", lambda few, rules: parsed.append(few.count()) or plain(few, rules))
    got = triage_plan.parsed_failures(runs, jobs, logs).collect()
    assert {r.job_id: r.error_patterns for r in got} == {i: [f"broken {i}"] for i in range(7, 1_800, 100) if i != 107}
    assert 17 <= parsed[0] < 100


def test_bitmap_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(groups, "BITMAP_WORDS", 4)
    rows = spark.range(2_000).selectExpr("id", "id AS repo")
    bitmap, words = groups.key_bitmap(rows.where("id % 100 = 7"), ["repo"])
    assert words == 4 and bitmap.count() <= 4
    left = groups.in_bitmap(rows, bitmap, words, ["repo"])
    assert left.where("id % 100 = 7").count() == 20


def test_materialized_tables_go_to_the_configured_folder(spark):
    df = materialize(spark.range(3), "numbers")
    assert work_dir(spark) in df.inputFiles()[0]
