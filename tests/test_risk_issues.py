import json

import pytest

from failtriage.operators import groups, issues, risk
from failtriage.rules import Override, RiskRules, RuleSet
from failtriage.sources import sinks

VALUES = (
    "repo string, group_key string, kind string, value string, occurrences long"
)


def assess(spark, patterns=(), files=(), commands=0, phrases=0, rules=None):
    rules = rules or RuleSet(overrides=())
    values = [("type", "linting"), *(("pattern", p) for p in patterns), *(("file", f) for f in files)]
    values += [("command", f"c{i}") for i in range(commands)] + [("phrase", f"p{i}") for i in range(phrases)]
    rows = [("r", "g", kind, value, 1) for kind, value in values]
    return risk.assess_risk(risk.risk_scores(spark.createDataFrame(rows, VALUES), rules), rules).first()


@pytest.mark.parametrize(
    ("n", "mask", "score", "level"),
    [(1, 0, 1 / 2, "tactical"), (2, 0, 2 / 3, "tactical"), (3, 0, 3 / 4, "safe"), (1, 1, 1.0, "safe")],
)
def test_safe_threshold(spark, n, mask, score, level):
    row = assess(spark, [f"line too long {i}" for i in range(n)], commands=mask)
    assert (row.safe_score, row.risk_level) == (score, level)


def test_strategic_threshold_is_strict_and_score_may_exceed_one(spark):
    # 5 * 0.5 / (2 * n + 1)
    row = assess(spark, [f"x{i}" for i in range(4)], phrases=5)
    assert row.strategic_score == 2.5 / 9 and row.risk_level == "tactical"
    row = assess(spark, ["x"], phrases=1)
    assert row.strategic_score == 0.5 / 3
    row = assess(spark, phrases=3)
    assert (row.strategic_score, row.confidence, row.risk_level) == (1.5, 0.9, "strategic")
    assert (row.required_expertise, row.estimated_effort) == ("senior", "1 to 2 weeks")


def test_blast_radius_by_level(spark):
    row = assess(spark, files=["tests/a.py", "x.sql", "deploy/b", "src/auth/x"])
    assert row.risk_level == "strategic"
    assert row.blast_radius == "data store; deployment; sign-in; test suite"
    assert "touches data store; touches sign-in" in row.reasoning
    assert assess(spark, phrases=3).blast_radius == "contained"
    assert assess(spark, files=["zzz"]).blast_radius == "one component"
    safe = assess(spark, files=["a.md", "docs/b.rst", "docs/c.md", "d.md"])
    assert (safe.blast_radius, safe.risk_level) == ("no running code", "safe")
    assert safe.reasoning.endswith("only documentation is affected")


def test_raised_score_is_named(spark):
    row = assess(spark, ["x", "y"], phrases=2)
    assert row.risk_level == "tactical" and row.reasoning.endswith("raised strategic score 0.20")


def test_seventy_phrases_count(spark):
    row = assess(spark, ["x"] * 1, phrases=70)
    assert row.strategic_score == 35 / 3


def test_first_override_wins(spark):
    rules = RuleSet(overrides=(Override("a.b*", "strategic"), Override("*", "safe")))
    row = assess(spark, files=["zz", "x/A.B/c"], rules=rules)
    assert (row.risk_level, row.confidence, row.estimated_effort) == ("strategic", 1.0, "configured")
    assert assess(spark, files=["axb"], rules=rules).risk_level == "safe"


def test_empty_rule_families(spark):
    none = RiskRules((), ())
    row = assess(spark, ["line too long"], rules=RuleSet(safe=none, strategic=none, tactical=none, autofix=(), blast=(), overrides=()))
    assert (row.safe_score, row.strategic_score, row.risk_level) == (0.0, 0.0, "tactical")


def test_responses_and_fallback(spark):
    good = {"title": "T", "risk_level": "safe", "priority": 85, "estimated_effort": "1h", "required_expertise": "junior"}
    missing = {k: v for k, v in good.items() if k != "priority"}
    rows = [
        ("r", "ok", "text " + json.dumps(good) + " end"),
        ("r", "ok", json.dumps(good | {"title": "U"})),
        ("r", "nobrace", "nothing"),
        ("r", "bad", "{oops"),
        ("r", "broken", "{oops}"),
        ("r", "missing", json.dumps(missing)),
        ("r", "null", None),
    ]
    answers = spark.createDataFrame(rows, "repo string, group_key string, response string")
    assert [r.group_key for r in issues.accepted_responses(answers).collect()] == ["ok", "ok"]
    assert issues.rejected_responses(answers).count() == 5
    found = spark.createDataFrame([("r", k, "security") for k in ("ok", "bad")], "repo string, group_key string, failure_type string")
    rows = issues.response_issues(issues.fallback_fields(found), answers).collect()
    got = {r.group_key: r for r in rows}
    assert len(rows) == 2
    assert got["ok"].title == "[SAFE] T" and got["ok"].labels == [
        "ci-failure", "risk:safe", "type:security", "priority:high", "good first issue",
    ]
    assert got["bad"].title.startswith("[STRATEGIC]") and got["bad"].required_expertise == "mid"


def test_answers_are_read_leniently(spark):
    fields = {"title": "T", "risk_level": "safe", "priority": 85, "estimated_effort": "1h", "required_expertise": "junior"}
    said = json.dumps(fields)
    nested = json.dumps(fields | {"root_cause": 'a } in "quotes" {', "commands": "make x", "related_files": ["a", None, 3]})
    rows = [
        ("text", json.dumps(fields | {"priority": "85"})), ("float", json.dumps(fields | {"priority": 84.6})),
        ("prose", f"As {{x}} shows, {said}"), ("first", f'{{"a": 1}} {said} {json.dumps(fields | {"priority": 1})}'),
        ("nested", f'He said "no". {nested}.'), ("open", f"Mind the {{ here: {said}"[:-1]),
        ("greedy", said.replace('"T"', '"T\\""')), ("number", json.dumps(fields | {"estimated_effort": 4})),
        ("none", "nothing"), ("empty", ""), ("null", None), ("broken", "{oops}"), ("list", "[1, 2]"), ("unclosed", "{" + said[1:-1]),
        ("word", json.dumps(fields | {"priority": "high"})), ("gone", json.dumps({k: v for k, v in fields.items() if k != "title"})),
        ("void", json.dumps(fields | {"required_expertise": None})), ("long", "x{" * 3_000 + "y}" * 3_000 + said),
    ]
    answers = spark.createDataFrame([("r", k, t) for k, t in rows], "repo string, group_key string, response string")
    got = {r.group_key: r for r in issues.accepted_responses(answers).collect()}
    assert set(got) == {"text", "float", "prose", "first", "nested", "greedy", "number", "long"}
    assert {k: r.priority for k, r in got.items()} == dict.fromkeys(got, 85)
    assert got["nested"].commands == ["make x"] and got["nested"].related_files == ["a", "3"]
    assert got["nested"].root_cause == 'a } in "quotes" {' and got["number"].estimated_effort == "4"
    reasons = {r.group_key: r.reason for r in issues.rejected_responses(answers).collect()}
    assert reasons == {
        "open": "no object", "none": "no object", "empty": "no object", "null": "no object", "broken": "no readable object",
        "list": "no object", "unclosed": "no object", "word": "no usable priority", "gone": "no usable title", "void": "no usable required_expertise",
    }


def test_answers_that_are_not_used_are_listed(spark):
    fields = {"title": "T", "risk_level": "safe", "priority": 85, "estimated_effort": "1h", "required_expertise": "junior"}
    rows = [("r", "g", json.dumps(fields | {"title": t})) for t in ("B", "A", "A", "C")] + [("r", "h", json.dumps(fields))]
    answers = spark.createDataFrame(rows, "repo string, group_key string, response string")
    assert sorted(r.title for r in issues.unused_answers(answers).collect()) == ["B", "C"]
    assert {(r.group_key, r.answer.title) for r in issues.used_answers(answers).collect()} == {("g", "A"), ("h", "T")}


def test_filters_and_summary(spark):
    df = spark.createDataFrame([("r", "safe", 10), ("r", "strategic", 60), ("q", "safe", 61)], "repo string, risk_level string, priority int")
    assert issues.focus(df, "safe").count() == 2 and issues.focus(df).count() == 3
    assert issues.at_least(df, 60).count() == 2
    got = {r.repo: (r.safe, r.tactical, r.strategic) for r in issues.risk_summary(df).collect()}
    assert got == {"r": (1, 0, 1), "q": (1, 0, 0)}
    with pytest.raises(ValueError):
        issues.focus(df, "none")


def test_shown_values_and_links_are_bounded(spark):
    values = [("r", "g", "pattern", f"p{i:02d}", 1 + i % 3) for i in range(30)] + [("r", "g", "file", f"f{i:02d}", 1) for i in range(30)]
    row = groups.shown_values(spark.createDataFrame(values, VALUES)).first()
    assert row.top_patterns == ["p02", "p05", "p08", "p11", "p14"] and row.top_files == [f"f{i:02d}" for i in range(10)]
    assert (row.more_patterns, row.more_files) == (25, 20)
    rows = [("r", "g", i, i, f"2024-01-{i:02d} 00:00:00", f"u{i}", "w", None if i == 7 else "j") for i in range(1, 9)]
    schema = "repo string, group_key string, run_id long, job_id long, created_at string, run_url string, workflow_name string, job_name string"
    failures = spark.createDataFrame(rows, schema)
    got = groups.occurrence_summary(failures).first()
    assert got.named_links == ["w / j: u8", "w: u7", "w / j: u6"]
    assert got.links == ["u8", "u7", "u6"] and got.more_links == 5 and got.failure_count == 8


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [("r", "g", 1, "T", "B", "safe", 10, "1h", "mid", ["x"], [], 3)],
        "repo string, group_key string, number long, title string, body string, risk_level string, priority int,"
        " estimated_effort string, required_expertise string, labels array<string>, assignees array<string>, failure_count long",
    )
    sinks.write_actions(sinks.create_actions(df), str(tmp_path / "create"))
    assert spark.read.parquet(str(tmp_path / "create")).first().title == "T"
    sinks.write_json_export(df, str(tmp_path / "json"))
    row = json.loads(spark.read.text(str(tmp_path / "json")).first().value)
    assert row["title"] == "T" and row["repository"] == "r" and "body" not in row and "number" not in row
    stats = spark.createDataFrame([("r", 5, 2, 3, 1, 1)], "repo string, runs_requested long, runs_seen long, total_failures long, failure_groups long, issues_left long")
    sinks.write_json_export(df, str(tmp_path / "both"), stats=stats)
    assert json.loads(spark.read.text(str(tmp_path / "both" / "issues")).first().value)["title"] == "T"
    written = json.loads(spark.read.text(str(tmp_path / "both" / "stats")).first().value)
    assert written == {"repository": "r", "stats": {"runs_requested": 5, "runs_seen": 2, "total_failures": 3, "failure_groups": 1, "issues_left": 1}}
