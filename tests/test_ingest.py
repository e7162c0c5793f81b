from failtriage.operators import ingest

RUNS = "repo string, run_id long, workflow_name string, status string, created_at string, run_url string"


def test_newest_failed_runs_per_repository(spark):
    rows = [("a", i, "w", "failure" if i % 2 else "success", f"2024-01-{i:02d}", "u") for i in range(1, 20)]
    rows += [("b", 1, "w", "failure", "2024-01-01", "u"), ("b", 2, "w", "failure", "2024-01-01", "u")]
    runs = spark.createDataFrame(rows, RUNS)
    got = {(r.repo, r.run_id) for r in ingest.recent_failed_runs(runs, 2).collect()}
    assert got == {("a", 19), ("a", 17), ("b", 1), ("b", 2)}
    assert ingest.recent_failed_runs(runs, None).count() == 12


def test_rank_limit_is_applied_before_the_shuffle(spark):
    runs = spark.createDataFrame([("a", 1, "w", "failure", "2024", "u")], RUNS)
    plan = ingest.recent_failed_runs(runs, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_jobs_without_log_are_left_out_and_listed(spark):
    jobs = spark.createDataFrame([("a", 1, 10), ("a", 1, 11)], "repo string, run_id long, job_id long")
    logs = spark.createDataFrame([("a", 10, "text"), ("b", 11, "text")], "repo string, job_id long, logs string")
    assert [r.job_id for r in ingest.attach_logs(jobs, logs).collect()] == [10]
    assert [r.job_id for r in ingest.missing_logs(jobs, logs).collect()] == [11]


def test_repository_identity(spark):
    urls = {
        "https://git.example/team/svc": ("team", "svc"),
        "https://git.example/team/svc.git": ("team", "svc"),
        "https://git.example/team/svc/": ("team", "svc"),
        "git@git.example:team/svc.git": ("team", "svc"),
        "https://git.example/team/my.github.io": ("team", "my.github.io"),
        "https://git.example/group/team/svc": ("team", "svc"),
    }
    bad = ["svc", "team/svc", "https://git.example/svc", ""]
    df = spark.createDataFrame([(u,) for u in [*urls, *bad]], "url string")
    got = {r.url: (r.owner, r.repo_name) for r in ingest.with_repo(df, "url").collect()}
    assert got == urls
    assert {r.url for r in ingest.repo_rejects(df, "url").collect()} == set(bad)


def test_labels_of_structs(spark):
    df = spark.sql("SELECT array(named_struct('name', 'x'), named_struct('name', 'y')) AS labels, 'open' AS state")
    assert ingest.flatten_labels(df).first().labels == ["x", "y"]
    assert ingest.open_issues(df, "closed").count() == 0
