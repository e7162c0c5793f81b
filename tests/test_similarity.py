import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from failtriage.functions import similarity as sim
from failtriage.functions import signatures
from failtriage.functions.signatures import list_hash
from failtriage.operators import exact


def pair(spark, fn, a, b, kind="string"):
    df = spark.createDataFrame([(a, b)], f"a {kind}, b {kind}")
    return df.select(fn(F.col("a"), F.col("b"))).first()[0]


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [
        ("Queue worker stalls", "queue WORKER stalls", 1.0),
        ("queue worker stalls", "login page broken", 0.0),
        ("queue worker stalls daily", "queue worker stalls", 0.75),
        ("one two three four", "one two three five", 0.6),
        ("the of and", "the of and", 0.0),
        ("", "word", 0.0),
        (None, "word", 0.0),
        ("größe maß", "GRÖSSE maß größe", 2 / 3),
    ],
)
def test_text_jaccard(spark, a, b, expected):
    assert pair(spark, sim.text_jaccard, a, b) == expected


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [(["x", "y"], ["y", "z", "y"], 1 / 3), ([], ["x"], 0.0), (["X"], ["x"], 0.0), (["x", "x"], ["x"], 1.0)],
)
def test_list_jaccard(spark, a, b, expected):
    assert pair(spark, sim.list_jaccard, a, b, "array<string>") == expected


def test_worked_score(spark):
    """Title 3/8, labels and risk full, body 2/6, no type: 0.6125."""
    df = spark.range(1).select(
        sim.weighted_score(F.lit(3 / 8), F.lit(1.0), F.lit(True), F.lit(2 / 6), F.lit(False)).alias("s"),
        sim.weighted_score(F.lit(1.0), F.lit(1.0), F.lit(True), F.lit(1.0), F.lit(True)).alias("full"),
    )
    row = df.first()
    assert row.s == pytest.approx(0.6125) and row.full == 1.0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.text(max_size=30), st.text(max_size=30)), min_size=1, max_size=20))
def test_jaccard_is_symmetric_and_bounded(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(sim.text_jaccard(F.col("a"), F.col("b")).alias("x"), sim.text_jaccard(F.col("b"), F.col("a")).alias("y"))
    assert all(r.x == r.y and 0.0 <= r.x <= 1.0 for r in got.collect())


def test_search_terms(spark):
    df = spark.createDataFrame([("[SAFE] a 12 fix: the 2024 log_in of ALL users, soon, please",)], "t string")
    assert df.select(sim.search_terms(F.col("t"))).first()[0] == "SAFE fix the log_in ALL users soon please"
    assert df.select(sim.search_terms(F.col("t"), 3)).first()[0] == "SAFE fix the"


def test_list_hash_ignores_order_case_blanks_and_repeats(spark):
    df = spark.createDataFrame([([" A", "b"], ["B", "a\t", "b"], ["c"], [])], "a array<string>, b array<string>, c array<string>, d array<string>")
    row = df.select(*[list_hash(F.col(c)).alias(c) for c in "abcd"]).first()
    assert row.a == row.b != row.c and len(row.a) == 32 and row.d == "empty"


def test_signature_masks_what_varies(spark):
    rows = [
        (["boom at src/x/y.py:12 on 2024-01-02"], ["a/B.py"], ["linting"]),
        (["boom at src/z/y.py:99 on 2025-03-04"], ["c/d/b.py"], ["linting"]),
        (["boom elsewhere"], ["b.py"], ["linting"]),
    ]
    df = spark.createDataFrame(rows, "error_patterns array<string>, affected_files array<string>, failure_types array<string>")
    rows = exact.with_signature(df).collect()
    a, b, c = [r.signature for r in rows]
    assert a == b != c and len(a) == 64 and [r.short_signature for r in rows] == [a[:16], b[:16], c[:16]]


@pytest.mark.parametrize("n", [0, 1, 10, 256, 257, 1000])
def test_rows_and_arrays_hash_alike_at_every_size(spark, n):
    patterns = [f"error {i % 997} in x" for i in range(n)] * 2
    rows = [("r", "g", "pattern", p) for p in patterns] + [("r", "g", "file", "A/b.py"), ("r", "g", "type", "linting"), ("r", "g", "phrase", "x")]
    values = spark.createDataFrame(rows, "repo string, group_key string, kind string, value string")
    schema = "error_patterns array<string>, affected_files array<string>, failure_types array<string>"
    arrays = spark.createDataFrame([(patterns[::-1], ["b.py"], ["linting"])], schema)
    assert exact.group_signatures(values).first().signature == exact.with_signature(arrays).first().signature


def test_signatures_tell_groups_apart(spark):
    """Equal signatures for equal content only."""
    rows = []
    for group, extra in (("g1", 0), ("g2", 0), ("g3", 1)):
        rows += [("r", group, "pattern", f"p{(i * 7) % 20}") for i in range(20 + extra)]
        rows += [("r", group, "pattern", "other")] * extra
    values = spark.createDataFrame(rows, "repo string, group_key string, kind string, value string")
    got = {r.group_key: r.signature for r in exact.group_signatures(values).collect()}
    assert got["g1"] == got["g2"] != got["g3"]


def test_exact_duplicates_prior_and_batch(spark):
    schema = "repo string, number long, signature string"
    prior = spark.createDataFrame([("r", 5, "s1"), ("r", 3, "s1"), ("q", 1, "s2")], schema)
    new = spark.createDataFrame([("r", 10, "s1"), ("r", 11, "s2"), ("r", 12, "s2"), ("r", 13, "s3")], schema)
    got = {(r.number, r.matched_number, r.scope) for r in exact.exact_duplicates(new, prior).collect()}
    assert got == {(10, 3, "prior"), (12, 11, "batch")}


def test_no_two_of_many_lists_have_one_signature(spark):
    """Different lists of one value and of two."""
    lists = spark.range(400_000).select(F.array(F.concat(F.lit("error "), F.col("id"))).alias("l"))
    pairs = spark.range(50_000).select(F.array(F.concat(F.lit("error "), F.col("id")), F.concat(F.lit("error "), F.col("id") + 1)).alias("l"))
    signed = lists.unionByName(pairs).select(signatures.list_hash(F.col("l")).alias("h"))
    assert signed.distinct().count() == 450_000
