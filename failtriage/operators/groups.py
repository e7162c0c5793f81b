"""Grouping failures and aggregating each group.

A group may hold a third of all failures, so no step gathers the members of a
group. Distinct values are rows of ``group_values``, counted with partial
aggregation; only the few values that are shown become arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failtriage.functions.text import strip
from failtriage.rules import DEFAULT_RULES, RuleSet
from failtriage.session import materialize

KEY = ["repo", "group_key"]
SHOWN_PATTERNS = 5
SHOWN_FILES = 10
SHOWN_LINKS = 3


def type_counts(failures: DataFrame) -> DataFrame:
    """Failing jobs per repository and failure type, and when each was last seen."""
    return failures.groupBy("repo", "failure_type").agg(
        F.count("*").alias("failure_count"), F.max("created_at").alias("last_seen")
    )


def group_values(failures: DataFrame) -> DataFrame:
    """Distinct types, patterns, files, safe commands and sensitive phrases of each group, one row per value.

    A failure has one type, so the type row of a group also holds the facts of
    the group as a whole: see ``group_failures``. One pass over the failures
    serves counts, extremes and values.
    """

    def tagged(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    values = F.concat(
        F.array(F.struct(F.lit("type").alias("kind"), F.col("failure_type").alias("value"))),
        tagged("pattern", F.col("error_patterns")),
        tagged("file", F.col("affected_files")),
        tagged("command", F.col("commands")),
        tagged("phrase", F.col("phrases")),
    )
    return (
        failures.select(*KEY, "created_at", "job_id", F.inline(values))
        .groupBy(*KEY, "kind", "value")
        .agg(
            F.count("*").alias("occurrences"),
            F.min("created_at").alias("first_seen"),
            F.max("created_at").alias("last_seen"),
            F.min("job_id").alias("first_job_id"),
        )
    )


def group_failures(values: DataFrame) -> DataFrame:
    """One row per group with counts and extremes."""
    return values.where(F.col("kind") == "type").groupBy(*KEY).agg(
        F.sum("occurrences").alias("failure_count"),
        F.min("value").alias("failure_type"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min("first_job_id").alias("first_job_id"),
    )


def value_counts(values: DataFrame) -> DataFrame:
    """Number of distinct types, patterns and files per group."""
    kinds = {"type": "type_count", "pattern": "pattern_count", "file": "file_count"}
    return values.groupBy(*KEY).agg(
        *[F.count_if(F.col("kind") == k).alias(name) for k, name in kinds.items()]
    )


def shown_values(values: DataFrame, n_patterns: int = SHOWN_PATTERNS, n_files: int = SHOWN_FILES) -> DataFrame:
    """The most frequent patterns and files of each group as short arrays, and how many more there are."""
    best = Window.partitionBy(*KEY, "kind").orderBy(F.desc("occurrences"), "value")
    ranked = values.where(F.col("kind").isin("pattern", "file")).withColumn("rank", F.row_number().over(best))
    kept = ranked.where(F.col("rank") <= max(n_patterns, n_files)).where(
        F.when(F.col("kind") == "pattern", F.col("rank") <= n_patterns).otherwise(F.col("rank") <= n_files)
    )

    def ordered(kind: str) -> Column:
        rows = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "value"))))
        return F.transform(rows, lambda r: r["value"])

    shown = kept.groupBy(*KEY).agg(ordered("pattern").alias("top_patterns"), ordered("file").alias("top_files"))
    return shown.join(value_counts(values), KEY).select(
        *KEY, "top_patterns", "top_files",
        (F.col("pattern_count") - F.size("top_patterns")).alias("more_patterns"),
        (F.col("file_count") - F.size("top_files")).alias("more_files"),
    )


def and_more(text: Column, more: str, glue: str) -> Column:
    """A list as text, and how many entries it leaves out, if any."""
    rest = F.when(F.col(more) > 0, F.concat(F.lit("and "), F.col(more).cast("string"), F.lit(" more")))
    return F.concat_ws(glue, text, rest)


def recent_links(failures: DataFrame, n: int = SHOWN_LINKS) -> DataFrame:
    """Links of the newest failures of each group, newest first; ``named_links`` say which workflow and job they show."""
    newest = Window.partitionBy(*KEY).orderBy(F.desc("created_at"), F.desc("run_id"), "job_id")
    name = F.concat_ws(" / ", "workflow_name", "job_name")
    kept = (
        failures.select(*KEY, "created_at", "run_id", "job_id", "run_url", F.concat_ws(": ", name, "run_url").alias("named"))
        .withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= n)
    )
    rows = F.sort_array(F.collect_list(F.struct("rank", "run_url", "named")))
    return kept.groupBy(*KEY).agg(rows.alias("rows")).select(
        *KEY, F.col("rows.run_url").alias("links"), F.col("rows.named").alias("named_links")
    )


def occurrence_summary(failures: DataFrame, n: int = SHOWN_LINKS) -> DataFrame:
    """First and most recent occurrence, total, a few links and how many more there are."""
    totals = failures.groupBy(*KEY).agg(
        F.count("*").alias("failure_count"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
    )
    more = F.greatest(F.col("failure_count") - n, F.lit(0)).cast("bigint").alias("more_links")
    return totals.join(recent_links(failures, n), KEY).select("*", more)


#: Words of 64 bits that a bitmap of keys has at most, so what is broadcast stays below some tens of megabytes.
BITMAP_WORDS = 1 << 20
#: Bits of the bitmap for each key, where that fits, and places that a key sets.
BITS_PER_KEY, PLACES = 32, 3


def _places(key: list[str], words: int) -> list[Column]:
    """Where a key is in a bitmap of 64-bit words."""
    return [F.pmod(F.xxhash64(*key, F.lit(k)), F.lit(words * 64)) for k in range(PLACES)]


def key_bitmap(
    keys: DataFrame, key: list[str], bits_per_key: int = BITS_PER_KEY, most: int | None = None
) -> tuple[DataFrame, int]:
    """A bitmap of the keys as rows ``word, bits``, and its number of words, at most ``most`` or ``BITMAP_WORDS``."""
    wanted = max(1, keys.count() * bits_per_key // 64)
    words = min(most or BITMAP_WORDS, 1 << (wanted - 1).bit_length())
    placed = keys.select(F.explode(F.array(*_places(key, words))).alias("place"))
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))")
    words_set = placed.groupBy(F.expr("place DIV 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return materialize(words_set, "key-bitmap"), words


def in_bitmap(rows: DataFrame, bitmap: DataFrame, words: int, key: list[str]) -> DataFrame:
    """The rows whose key may be among those of the bitmap; none of them is lost, and few others are left.

    The bitmap is broadcast, its size is bounded, so rows that are left out are
    dropped where they are read.
    """
    for place in _places(key, words):
        held = F.broadcast(bitmap.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
        bit = F.col("_bits").bitwiseAND(F.expr("shiftleft(1L, CAST(_place % 64 AS INT))"))
        rows = (
            rows.withColumn("_place", place).withColumn("_word", F.expr("_place DIV 64"))
            .join(held, "_word").where(bit != 0).drop("_word", "_place", "_bits")
        )
    return rows


def sample_logs(failures: DataFrame, logs: DataFrame) -> DataFrame:
    """Whole log of the newest failure of each group: found by its key, one log for each group.

    The logs are read once more; a bitmap of the keys found drops all others
    before the join, so about one log per group is shuffled and not all of them.
    """
    newest = failures.groupBy(*KEY).agg(F.max(F.struct("created_at", "run_id", "job_id")).alias("newest"))
    found = materialize(newest.select(*KEY, F.col("newest.job_id").alias("job_id")), "newest-failures")
    job = ["repo", "job_id"]
    bitmap, words = key_bitmap(found, job)
    few = in_bitmap(logs.select(*job, F.col("logs").alias("log_sample")), bitmap, words, job)
    return found.join(few, job)


def analysis_context(groups: DataFrame, shown: DataFrame, samples: DataFrame) -> DataFrame:
    """The facts of a group as one text, for whoever analyses it."""
    joined = groups.join(shown, KEY, "left").join(samples, KEY, "left")
    patterns = and_more(F.array_join("top_patterns", "; "), "more_patterns", "; ")
    files = and_more(F.array_join("top_files", ", "), "more_files", ", ")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Repository: "), F.col("repo")),
        F.concat(F.lit("Failures: "), F.col("failure_count").cast("string")),
        F.concat(F.lit("Kind: "), F.col("failure_type")),
        F.when(F.size("top_patterns") > 0, F.concat(F.lit("Errors: "), patterns)),
        F.when(F.size("top_files") > 0, F.concat(F.lit("Files: "), files)),
        F.concat(F.lit("Sample log:\n"), F.col("log_sample")),
    )
    return joined.select(*KEY, text.alias("context"))


def normalize_pattern(pattern: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Mask what varies between occurrences of one error, as the rules say."""
    for part, mask in rules.variable_parts:
        pattern = F.regexp_replace(pattern, part, mask)
    return pattern


def _signed(failures: DataFrame) -> DataFrame:
    exploded = failures.select(
        "repo", "failure_type", "run_id", "created_at", F.explode("error_patterns").alias("pattern")
    )
    return exploded.withColumn("signature", F.lower(strip(normalize_pattern(F.col("pattern"))))).drop("pattern")


def pattern_runs(failures: DataFrame) -> DataFrame:
    """Runs in which each normalised error pattern occurred, one row per run."""
    return (
        _signed(failures)
        .groupBy("repo", "failure_type", "signature", "run_id")
        .agg(
            F.count("*").alias("occurrences"),
            F.min("created_at").alias("first_seen"),
            F.max("created_at").alias("last_seen"),
        )
    )


def pattern_rollup(failures: DataFrame) -> DataFrame:
    """Occurrences, affected runs, first and last sighting of each error pattern.

    The run lists stay rows of ``pattern_runs``: one pattern may be in every run.
    """
    return (
        pattern_runs(failures)
        .groupBy("repo", "failure_type", "signature")
        .agg(
            F.sum("occurrences").alias("occurrences"),
            F.count("*").alias("affected_runs"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
        )
    )
