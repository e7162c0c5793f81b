"""Views shaped like CI data, derived from the star-schema test tables.

The test tables hold no CI logs, so runs, jobs and logs are computed from
``orders`` and ``events``, row for row. The SQL text is shared with the oracle:
``{events}``, ``{orders}``, ``{documents}`` are replaced by table references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

JOBS_SQL = """
SELECT concat('acme/repo-', CAST(run_id % 10 AS STRING)) AS repo,
       run_id, event_id AS job_id,
       CASE event_id % 4 WHEN 0 THEN 'lint' WHEN 1 THEN 'unit' WHEN 2 THEN 'build' ELSE 'scan' END AS job_name,
       CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS conclusion,
       ts AS created_at
FROM (SELECT event_id, event_type, ts,
             CAST((event_id - event_id % 3) / 3 AS BIGINT) AS run_id
      FROM {events}) e
"""

RUNS_SQL = """
SELECT concat('acme/repo-', CAST(o_orderkey % 10 AS STRING)) AS repo,
       o_orderkey AS run_id,
       concat('workflow-', CAST(o_custkey % 4 AS STRING)) AS workflow_name,
       CASE o_orderstatus WHEN 'F' THEN 'failure' WHEN 'O' THEN 'success' ELSE 'in_progress' END AS status,
       o_orderdate AS created_at,
       concat('https://ci.example/acme/repo-', CAST(o_orderkey % 10 AS STRING),
              '/runs/', CAST(o_orderkey AS STRING)) AS run_url
FROM {orders}
"""

# One template per failure family, one with nothing to parse (6), one with CRLF
# line ends (2), one with an address and port (3), one with an absolute
# temporary path (5), one non-ASCII (7). Every 50th job has no log.
LOGS_SQL = """
SELECT concat('acme/repo-', CAST(run_id % 10 AS STRING)) AS repo,
       event_id AS job_id,
       CASE event_id % 8
       WHEN 0 THEN concat('Run style checks', chr(10),
            'src/app/module_', CAST(user_id % 20 AS STRING), '.py:', CAST(event_id % 90 + 1 AS STRING),
            ':80: E501 line too long', chr(10),
            'docs/helpers.md:12:1: W291 trailing whitespace', chr(10),
            'lint error: found 2 style problems, try black .', chr(10),
            'would reformat', chr(10), 'src/app/module_', CAST(user_id % 20 AS STRING), '.py', chr(10))
       WHEN 1 THEN concat('FAILED tests/test_mod_', CAST(user_id % 15 AS STRING), '.py::test_case_',
            CAST(event_id % 7 AS STRING), chr(10),
            'Traceback (most recent call last):', chr(10),
            '  File "tests/test_mod_', CAST(user_id % 15 AS STRING), '.py", line ',
            CAST(event_id % 300 AS STRING), ', in test_case', chr(10),
            'AssertionError: expected ', CAST(event_id % 5 AS STRING), ' got ', CAST(user_id % 3 AS STRING), chr(10))
       WHEN 2 THEN concat('Installing packages', chr(13), chr(10),
            'ERROR: could not resolve libfoo==', CAST(user_id % 9 AS STRING), '.1', chr(13), chr(10),
            'ModuleNotFoundError: No module named ''libfoo_', CAST(user_id % 9 AS STRING), '''', chr(13), chr(10),
            'see "build/requirements_', CAST(user_id % 4 AS STRING), '.txt"', chr(13), chr(10))
       WHEN 3 THEN concat('connect 10.0.0.', CAST(user_id % 250 AS STRING), ':8080 timed out', chr(10),
            'error: no space left on device sd', CAST(user_id % 3 AS STRING), chr(10),
            'bad value in file deploy/k8s/service_', CAST(user_id % 6 AS STRING), '.yaml', chr(10),
            'production outage suspected, exit code ', CAST(event_id % 3 AS STRING), chr(10))
       WHEN 4 THEN concat('CVE-2023-', CAST(10000 + user_id AS STRING), ' affects src/auth/session.py:',
            CAST(event_id % 40 AS STRING), chr(10),
            CAST(event_id % 4 + 1 AS STRING), ' vulnerabilities found in the credential store', chr(10))
       WHEN 5 THEN concat('psycopg.OperationalError: deadlock detected', chr(10),
            'db/migrations/000', CAST(user_id % 12 AS STRING), '_init.sql:', CAST(event_id % 20 AS STRING), chr(10),
            '/tmp/build-', CAST(event_id AS STRING), '/schema.sql:3', chr(10),
            '/srv/app/store/engine.py:', CAST(event_id % 60 AS STRING), chr(10),
            'rollback of migration failed, exit code 1', chr(10))
       WHEN 6 THEN concat('job ', CAST(event_id AS STRING), ' ended without a summary', chr(10))
       ELSE concat('Größenprüfung für Knoten ', CAST(user_id AS STRING), chr(10),
            'FAILED tests/größe/test_maß.py::prüfung_', CAST(event_id % 3 AS STRING), chr(10),
            'src/naïve/módulo_', CAST(user_id % 5 AS STRING), '.py:', CAST(event_id % 10 + 1 AS STRING), chr(10),
            CAST(event_id % 6 + 1 AS STRING), ' tests failed', chr(10))
       END AS logs
FROM (SELECT event_id, user_id, CAST((event_id - event_id % 3) / 3 AS BIGINT) AS run_id
      FROM {events} WHERE event_id % 50 <> 0) e
"""

# The title is the first sentence of a text, up to a stop or the end of its line, whatever its length.
DOC_ISSUES_SQL = """
SELECT 'acme/docs' AS repo, doc_id AS number,
       concat('[', risk_level, '] ', regexp_extract(text, '^[^.!?\n]*', 0)) AS title,
       concat(text, chr(10), 'kind: docs_', lang) AS body,
       lang, source, risk_level, concat('docs_', lang) AS failure_type
FROM (SELECT doc_id, text, lang, source,
             CASE lang WHEN 'en' THEN 'tactical' WHEN 'fr' THEN 'strategic' ELSE 'safe' END AS risk_level
      FROM {documents}) d
"""

CUTOFF = "2024-01-16 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(JOBS_SQL, events=table(spark, sf_dir, "events"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RUNS_SQL, orders=table(spark, sf_dir, "orders"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of all jobs but some.

    A test table is one file with one row group, which a scan cannot split. Its
    narrow rows are spread over the cores before they become texts. The number of
    parts is given: by their bytes, narrow rows would be put into too few.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id").repartition(parts, "event_id")
    return spark.sql(LOGS_SQL, events=events)


def doc_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues made of documents: title from the first sentence, labels from language and source."""
    df = spark.sql(DOC_ISSUES_SQL, documents=table(spark, sf_dir, "documents"))
    return df.selectExpr(
        "repo", "number", "title", "body", "risk_level",
        "array(lang, source) AS labels", "array(failure_type) AS failure_types",
    )

# Answers of an analyst per failure group: some without an object, with broken
# JSON or with a missing key; priorities as numbers and as texts, single commands
# and lists of them, braces in the prose. Some groups have two answers.
RESPONSES_SQL = """
SELECT repo, group_key,
       CASE first_job_id % 7
       WHEN 0 THEN 'I could not tell what went wrong.'
       WHEN 1 THEN concat('Result: {"title": "', failure_type, ' broken')
       WHEN 2 THEN concat('{"title": "Look at ', failure_type, '", "risk_level": "safe", "priority": 10}')
       WHEN 3 THEN concat('Unsure. {"title": "x", "risk_level": "safe", "priority": "high", "estimated_effort": "a", "required_expertise": "b", "n": ',
            CAST(first_job_id AS STRING), '}')
       ELSE concat('Here is my view', CASE WHEN first_job_id % 6 = 0 THEN ' of {group} and {"a": 1}' ELSE '' END, ':', chr(10),
            '{"title": "', replace(group_key, '|', ' in '),
            '", "risk_level": "',
            CASE first_job_id % 3 WHEN 0 THEN 'safe' WHEN 1 THEN 'tactical' ELSE 'strategic' END,
            '", "priority": ',
            CASE first_job_id % 4 WHEN 0 THEN concat('"', CAST(first_job_id % 100 + 1 AS STRING), '"')
                WHEN 1 THEN concat(CAST(first_job_id % 100 + 1 AS STRING), '.0') ELSE CAST(first_job_id % 100 + 1 AS STRING) END,
            CASE first_job_id % 5 WHEN 0 THEN concat(', "commands": ["make ', failure_type, '", "make check"], "related_files": ["src/a-',
                CAST(first_job_id % 9 AS STRING), '.py", "Makefile"]')
                WHEN 1 THEN concat(', "commands": "make {', failure_type, '}"') ELSE '' END,
            ', "estimated_effort": "', CAST(first_job_id % 8 + 1 AS STRING), ' hours"',
            CASE WHEN first_job_id % 2 = 0 THEN concat(', "risk_reason": "seen in ', repo, '"') ELSE '' END,
            ', "required_expertise": "',
            CASE first_job_id % 2 WHEN 0 THEN 'junior' ELSE 'senior' END,
            '", "root_cause": "Cause of ', failure_type,
            '", "suggested_fix": "Check the last change"}', chr(10), 'Hope this helps.')
       END AS response
FROM {groups}
UNION ALL
SELECT repo, group_key,
       concat('Second view: {"title": "', failure_type, ' again", "risk_level": "tactical", "priority": ',
            CAST(first_job_id % 50 + 1 AS STRING), ', "estimated_effort": 2, "required_expertise": "mid"}') AS response
FROM {groups} WHERE first_job_id % 4 = 1
"""

# Repository addresses in all accepted forms and one that is not.
ADDRESSES_SQL = """
SELECT o_orderkey AS run_id,
       CASE o_orderkey % 6
       WHEN 0 THEN concat('https://git.example/team-', CAST(o_custkey % 30 AS STRING), '/svc-', CAST(o_orderkey % 50 AS STRING))
       WHEN 1 THEN concat('https://git.example/team-', CAST(o_custkey % 30 AS STRING), '/svc-', CAST(o_orderkey % 50 AS STRING), '.git')
       WHEN 2 THEN concat('git@git.example:team-', CAST(o_custkey % 30 AS STRING), '/svc-', CAST(o_orderkey % 50 AS STRING), '.git')
       WHEN 3 THEN concat('http://git.example/team-', CAST(o_custkey % 30 AS STRING), '/my.github.io/')
       WHEN 4 THEN concat('git@git.example:team-', CAST(o_custkey % 30 AS STRING), '/svc/')
       ELSE concat('team-', CAST(o_custkey % 30 AS STRING))
       END AS url
FROM {orders}
"""


# Path rules of each repository, from the customers: globs with one star, with two, without any, and of a star only.
RULES_SQL = """
SELECT concat('acme/repo-', CAST(c_custkey % 10 AS STRING)) AS repo, c_custkey AS pos,
       CASE c_custkey % 11
       WHEN 0 THEN concat('APP/module_', CAST(c_nationkey AS STRING), '.*')
       WHEN 1 THEN concat('tests/test_mod_', CAST(c_custkey % 40 AS STRING), '.py')
       WHEN 2 THEN concat('deploy/*/service_', CAST(c_custkey % 9 AS STRING), '.')
       WHEN 3 THEN concat('store*engine.p', CAST(c_custkey % 2 AS STRING))
       WHEN 4 THEN concat('/größe/*_', CAST(c_nationkey AS STRING))
       WHEN 5 THEN concat('000', CAST(c_nationkey AS STRING), '_init.s?l')
       WHEN 6 THEN concat('requirements_', CAST(c_custkey % 50 AS STRING), '*')
       WHEN 7 THEN CASE WHEN c_custkey % 1000 = 7 THEN '*' ELSE concat('vendor-', CAST(c_custkey AS STRING), '/*') END
       WHEN 8 THEN concat('*', CAST(c_custkey % 30 AS STRING), '.py')
       ELSE concat('src/pkg-', CAST(c_custkey AS STRING), '/*.py') END AS pattern,
       CASE c_custkey % 3 WHEN 0 THEN 'safe' WHEN 1 THEN 'tactical' ELSE 'strategic' END AS risk_level,
       concat('team-', lower(c_mktsegment)) AS team
FROM {customer}
"""


def repo_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RULES_SQL, customer=table(spark, sf_dir, "customer"))


def responses(groups: DataFrame) -> DataFrame:
    sql = RESPONSES_SQL.replace("{", "{{").replace("}", "}}").replace("{{groups}}", "{groups}")
    return groups.sparkSession.sql(sql, groups=groups)


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ADDRESSES_SQL, orders=table(spark, sf_dir, "orders"))


def on_file(issues: DataFrame) -> DataFrame:
    """Issues as they look on file: some have no body, some are closed."""
    return issues.selectExpr(
        "repo", "number", "title",
        "CASE WHEN number % 7 = 0 THEN NULL ELSE body END AS body",
        "CASE WHEN number % 5 = 0 THEN 'closed' ELSE 'open' END AS state",
        "labels",
    )
