"""Path rules of repositories against every glob tried on every path."""

import random
import re

from failtriage.operators import repo_rules

VALUES = "repo string, group_key string, kind string, value string"
RULES = "repo string, pos long, pattern string, risk_level string, team string"


def matches(glob, path, any_case):
    regex = ".*".join(re.escape(part) for part in glob.split("*"))
    return re.search(regex, path, re.DOTALL | (re.IGNORECASE if any_case else 0)) is not None


def test_equals_trying_every_rule(spark):
    rnd = random.Random(3)
    pieces = ["src/", "Tests/", "a", "b.py", "größe", "ÄÖ", "_x", ".", "[1]", "(2)+", "$", "\\", "long_module_name", " ", "é", "1", "|"]
    globs = ["".join(rnd.choices([*pieces, "*"], k=rnd.randint(1, 4))) for _ in range(300)] + ["*", "**", "", "src/*.py"]
    paths = ["".join(rnd.choices(pieces, k=rnd.randint(1, 7))) for _ in range(150)] + ["", "SRC/A.PY", "a\nb", "zz"]
    rules = [(rnd.choice(["r", "q", None]), i, g, rnd.choice(["safe", "strategic"]), f"t{i % 9}") for i, g in enumerate(globs)]
    rules += [("r", 1_000, None, "safe", "t"), ("r", 5, "b.py", "safe", "tie"), ("r", 5, "b.py", "strategic", "tie")]
    values = [(rnd.choice(["r", "q", "s"]), f"g{i % 40}", "file", p) for i, p in enumerate(paths)] + [("r", "g1", "pattern", "src/a")]
    v, r = spark.createDataFrame(values, VALUES), spark.createDataFrame(rules, RULES)
    groups = {}
    teams = set()
    for repo, group, kind, path in values:
        for rule_repo, pos, glob, level, team in rules:
            if kind != "file" or repo != rule_repo or glob is None:
                continue
            if matches(glob, path, True):
                groups[repo, group] = min(groups.get((repo, group), (10**9, "")), (pos, level))
            if matches(glob, path, False):
                teams.add((repo, group, team))
    got = repo_rules.override_levels(v, r).collect()
    assert {(x.repo, x.group_key): (x.override_pos, x.risk_level) for x in got} == groups and len(got) == len(groups) > 20
    routed = [tuple(x) for x in repo_rules.route_teams(v, r).collect()]
    assert set(routed) == teams and len(routed) == len(teams) > 50


def test_many_rules_need_no_nested_loop(spark):
    rules = spark.range(20_000).selectExpr("concat('r', id % 4) AS repo", "id AS pos", "concat('src/module_', id, '/*.py') AS pattern", "'safe' AS risk_level")
    values = spark.range(2_000).selectExpr(
        "concat('r', id % 4) AS repo", "concat('g', id) AS group_key", "'file' AS kind", "concat('lib/SRC/module_', id * 8, '/x/a.py') AS value"
    )
    found = repo_rules.override_levels(values, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = {r.group_key: r.override_pos for r in found.collect()}
    assert rows == {f"g{i}": i * 8 for i in range(2_000) if i * 8 % 4 == i % 4}
    assert repo_rules.override_levels(values, rules.limit(0)).count() == 0
