import random
import re

from failtriage.operators import dedup, phrases
from failtriage.plans.triage import judged as judge
from failtriage.rules import BASE_LABEL, TITLE_PHRASE

NEW = (
    "repo string, number long, title string, body string, risk_level string,"
    " labels array<string>, failure_types array<string>, failure_count long, first_pattern string"
)
OLD = "repo string, number long, title string, body string, labels array<string>"


def issue(number, title, level="tactical", types=("linting",), labels=(), body="b", pattern=None):
    return ("r", number, title, body, level, list(labels), list(types), 2, pattern)


def judged(new, old):
    return judge(new, old.selectExpr("*", "'open' AS state"))


def test_no_issue_on_file(spark):
    new = spark.createDataFrame([issue(1, "queue worker stalls")], NEW)
    old = spark.createDataFrame([], OLD)
    row = judged(new, old).first()
    assert (row.is_duplicate, row.matched_number, row.similarity) == (False, None, 0.0)
    assert row.reason == "no issue on file is similar enough"


def test_verdict_depends_on_the_threshold(spark):
    new = spark.createDataFrame([issue(1, "[TACTICAL] queue worker stalls", labels=[BASE_LABEL], body="one two")], NEW)
    old = spark.createDataFrame([("r", 7, "[TACTICAL] queue worker hangs", None, [BASE_LABEL])], OLD)
    scored = dedup.score_pairs(dedup.candidates(new, old), new, old)
    best = dedup.best_candidate(scored)
    # title 3/5, labels 1, risk found in the title, no body
    assert abs(best.first().similarity - (0.18 + 0.25 + 0.2)) < 1e-12
    assert not judged(new, old).first().is_duplicate
    verdict = dedup.verdicts(new, best.where("similarity >= 0.5").withColumn("oldest_number", best["matched_number"]))
    assert (verdict.first().is_duplicate, verdict.first().matched_number) == (True, 7)
    assert dedup.only_new(new, verdict).count() == 0
    assert dedup.only_new(new, verdict, enabled=False).count() == 1
    assert dedup.recurrence_notes(new, verdict).first().matched_number == 7
    assert dedup.recurrence_notes(new, verdict, enabled=False).count() == 0


def test_ties_go_to_the_first_candidate(spark):
    new = spark.createDataFrame([issue(1, "queue worker tactical", labels=[BASE_LABEL])], NEW)
    old = spark.createDataFrame([("r", n, "queue worker tactical", "b", [BASE_LABEL]) for n in (3, 9, 4)], OLD)
    scored = dedup.score_pairs(dedup.candidates(new, old), new, old)
    assert dedup.best_candidate(scored).first().matched_number == 9
    row = judged(new, old).first()
    assert (row.matched_number, row.oldest_number) == (9, 3)


def test_other_repositories_are_not_searched(spark):
    new = spark.createDataFrame([issue(1, "queue worker")], NEW)
    old = spark.createDataFrame([("q", 2, "queue worker", "b", [BASE_LABEL])], OLD)
    assert dedup.candidates(new, old).count() == 0


def expected_candidates(new, old, cap):
    out = set()
    for n in new:
        words = [w for w in (n[8] or "").lower().split() if len(w) > 2]
        found = {}
        searches = [f"risk:{n[4]}", BASE_LABEL, None, "PHRASE", *[f"type:{t}" for t in n[6]]]
        for e in old:
            texts = [" ".join(w for w in text.lower().split() if len(w) > 2) for text in e[2:4]]
            ranks = [i for i, s in enumerate(searches) if s in e[4]]
            if TITLE_PHRASE.lower() in e[2].lower():
                ranks.append(2)
            phrase = " ".join(words)
            if len(phrase) > 3 and any(f" {phrase} " in f" {text} " for text in texts):
                ranks.append(3)
            if ranks:
                found[e[1]] = min(ranks)
        best = sorted(found.items(), key=lambda x: (x[1], -x[0]))[:cap]
        out |= {(n[1], number) for number, _ in best}
    return out


def test_cutting_the_lists_first_loses_nothing(spark):
    rnd = random.Random(5)
    vocabulary = ["queue", "worker", "login", "cache", "CI", "failure", "disk"]

    def title():
        return " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 7)))

    def labels():
        return rnd.sample([BASE_LABEL, "risk:safe", "risk:tactical", "type:linting", "type:database"], rnd.randint(0, 3))

    old = [("r", i, title(), title(), labels()) for i in range(300)]
    new = [
        issue(1000 + i, title(), rnd.choice(["safe", "tactical", "strategic"]), rnd.sample(["linting", "database", "security"], 2),
              pattern=rnd.choice([None, title(), title()]))
        for i in range(40)
    ]
    got = dedup.candidates(spark.createDataFrame(new, NEW), spark.createDataFrame(old, OLD), cap=7)
    assert {(r.number, r.candidate) for r in got.collect()} == expected_candidates(new, old, 7)


def test_absent_labels_and_texts(spark):
    new = spark.createDataFrame([issue(1, "queue worker stalls", pattern="worker stalls")], NEW)
    old = spark.createDataFrame([("r", 7, "queue worker stalls", None, None), ("r", 8, None, None, None)], OLD)
    scored = dedup.score_pairs(dedup.candidates(new, old), new, old)
    assert [(r.candidate, r.similarity) for r in scored.collect()] == [(7, 0.3)]


def test_phrases_equal_a_search_in_the_texts(spark):
    """Whole phrases of any length, in titles and bodies, with words that nearly all issues hold at the start."""
    rnd = random.Random(9)
    vocabulary = ["the"] * 8 + ["queue", "worker", "login", "cache", "disk", "a1", "42", "in-flight", "Größe"]

    def text(longest):
        return " ".join(rnd.choices(vocabulary, k=rnd.randint(0, longest)))

    old = [("r" if i % 3 else "q", i, text(9), text(40), []) for i in range(200)] + [("r", 900, None, None, None)]
    new = [issue(1000 + i, "t", pattern=text(6)) for i in range(60)]
    new += [issue(2000, "t", pattern="the the: the, (the)"), issue(2001, "t", pattern="nowhere the"), issue(2002, "t"), issue(2003, "t", pattern="abc")]
    new += [issue(2004, "t", pattern=" ".join(old[1][3].split()[:30])), issue(2005, "t", pattern="THE")]

    def words(value):
        found = re.findall(r"[\w]+(?:-[\w]+)*", value or "")
        return [w.lower() for w in found if len(w) >= 3 and not w.isdecimal()]

    expected = set()
    for n in new:
        phrase = " ".join(words(n[8]))
        if len(phrase) > 3:
            expected |= {(phrase, e[1]) for e in old if e[0] == "r" and any(f" {phrase} " in f" {' '.join(words(t))} " for t in e[2:4])}
    asked = phrases.issue_phrases(spark.createDataFrame(new, NEW))
    got = [(r.phrase, r.candidate) for r in phrases.phrase_matches(asked, spark.createDataFrame(old, OLD)).collect()]
    assert set(got) == expected and len(got) == len(expected) > 100
    assert any(len(p.split()) > 5 for p, _ in got)
