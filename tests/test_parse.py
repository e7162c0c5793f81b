import re
import time

import pytest
from pyspark.sql import functions as F

from failtriage.functions.text import glob_to_regex, two_decimals
from failtriage.operators import parse
from failtriage.rules import ExtractRule, RiskRules, RuleSet


def run(spark, text, column, **kw):
    df = spark.createDataFrame([(text,)], "logs string")
    return df.select(column(F.col("logs"), **kw)).first()[0]


def test_two_groups_become_the_text_of_a_tuple(spark):
    got = run(spark, "FAILED a/b.py::test_x\nfailed c.py::test_y\n", parse.error_patterns)
    assert got == [str(("a/b.py", "test_x")), str(("c.py", "test_y"))]


def test_order_is_rule_then_position_and_repeats_go(spark):
    rules = RuleSet(errors=(ExtractRule("x", "b[0-9]"), ExtractRule("y", "(a)[0-9]", 1)))
    assert run(spark, "a1 b2 a3 B1 b2", parse.error_patterns, rules=rules) == ["b2", "B1", "a"]


def test_all_patterns_are_kept(spark):
    text = "".join(f"CVE-2024-{10000 + i}\n" for i in range(300))
    got = run(spark, text, parse.error_patterns)
    assert got == [f"CVE-2024-{10000 + i}" for i in range(300)]


def test_seventy_phrases(spark):
    many = tuple(f"phrase{i:02}." for i in range(70))
    rules = RuleSet(strategic=RiskRules((), (), many, (r"code [0-9]+",)))
    logs = spark.createDataFrame([("r", 1, " ".join(many) + " code 7"), ("r", 2, None)], "repo string, job_id long, logs string")
    got = {r.job_id: r.phrases for r in parse.parse_logs(logs, rules).collect()}
    assert got == {1: [*many, r"code [0-9]+"], 2: []}


def test_match_across_lines_and_crlf(spark):
    assert run(spark, "would reformat\r\nsrc/a.py\r\n", parse.error_patterns) == ["src/a.py"]
    assert run(spark, "No module named 'x y'\r\n", parse.error_patterns) == ["x y"]
    assert run(spark, "AssertionError: one two\r\n", parse.error_patterns) == ["one two"]


def test_files(spark):
    text = (
        'src/a.py:10 File "b.py", line 3\n\'lib/c.js\' in file conf/d.yaml, 10.0.0.1:80\n'
        "/tmp/x/e.py:1 /srv/node_modules/f.js:2 /opt/g.py:3 src/a.py:99\n"
    )
    assert run(spark, text, parse.affected_files) == ["src/a.py", "/opt/g.py", "b.py", "lib/c.js", "conf/d.yaml,"]
    assert "10.0.0.1" in run(spark, text, parse.affected_files, drop_addresses=False)


def test_all_files_but_noise(spark):
    text = "".join(f"/tmp/n{i}.py:1\n" for i in range(30)) + "".join(f"s{i}.py:1\n" for i in range(30))
    assert run(spark, text, parse.affected_files) == [f"s{i}.py" for i in range(30)]


def test_adjacent_paths(spark):
    assert run(spark, "a.py:1b/c.py:2", parse.affected_files) == ["a.py", "b/c.py"]


def test_long_runs_stay_linear(spark):
    text = "abc/def." * 40_000 + " x.py:1"
    start = time.time()
    assert run(spark, text, parse.affected_files) == ["x.py"]
    assert time.time() - start < 20


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("LINT ERROR and a CVE-1", "linting"),
        ("CVE-1 timed out", "infrastructure"),
        ("No Module Named x", "dependency"),
        ("deadlock detected", "database"),
        ("nothing here", "unknown"),
        ("", "unknown"),
    ],
)
def test_first_class_wins(spark, text, expected):
    df = spark.createDataFrame([("r", 1, text)], "repo string, job_id long, logs string")
    assert parse.parse_logs(df).first().failure_type == expected


def test_group_key_skips_absent_parts(spark):
    rows = [("r", 1, "nothing"), ("r", 2, "src/a.py:1"), ("r", 3, "CVE-2024-12345"), ("r", 4, None)]
    df = spark.createDataFrame(rows, "repo string, job_id long, logs string")
    got = {r.job_id: r.group_key for r in parse.parse_logs(df).collect()}
    assert got == {1: "unknown", 2: "unknown|src/a.py", 3: "security|CVE-2024-12345", 4: "unknown"}


def test_key_has_the_whole_first_pattern(spark):
    df = spark.createDataFrame([("r", 1, "error: " + "é" * 80)], "repo string, job_id long, logs string")
    assert parse.parse_logs(df).first().group_key == "unknown|" + "é" * 80


def test_globs_are_literal_but_for_stars():
    assert re.search(glob_to_regex("a.b/*.py"), "x/a.b/c.py")
    assert not re.search(glob_to_regex("a.b/*.py"), "axb/c.py")


def test_two_decimals(spark):
    df = spark.createDataFrame([(0.0,), (0.125,), (1.5,), (0.994,), (0.999,)], "v double")
    assert [r[0] for r in df.select(two_decimals(F.col("v"))).collect()] == ["0.00", "0.13", "1.50", "0.99", "1.00"]


def test_logs_are_parsed_in_all_parts_however_narrow_their_rows(spark, tmp_path):
    from failtriage.sources import derived

    spark.range(2000).selectExpr("id AS event_id", "id % 9 AS user_id").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    logs = derived.logs(spark, str(tmp_path))
    assert logs.count() == 1960
    assert logs.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
