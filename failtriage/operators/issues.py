"""Assembling issues from failure groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from failtriage.functions.answers import first_missing, list_of, number_of, object_spans, readable, text_of
from failtriage.operators.groups import KEY, SHOWN_LINKS, and_more
from failtriage.rules import (
    BASE_LABEL, DEFAULT_RULES, DEFAULT_TAG, LIST_KEYS, NEWCOMER_LABEL, OPTIONAL_KEYS, REQUIRED_KEYS,
    RISK_LEVELS, RISK_TAGS, SENIOR_ASSIGNEE, RuleSet,
)

RESPONSE_SCHEMA = T.StructType(
    [
        T.StructField(k, T.IntegerType() if k == "priority" else T.StringType())
        for k in REQUIRED_KEYS + OPTIONAL_KEYS
    ]
    + [T.StructField(k, T.ArrayType(T.StringType())) for k in LIST_KEYS]
)


#: Why an issue has a configured risk level.
CONFIGURED_REASON = "configured for its files"


def risk_tag(level: Column) -> Column:
    chain = F
    for name, tag in RISK_TAGS.items():
        chain = chain.when(level == name, F.lit(tag))
    return chain.otherwise(F.lit(DEFAULT_TAG))


def tagged_title(level: Column, title: Column) -> Column:
    return F.concat_ws(" ", risk_tag(level), title)


def assignees(level: Column) -> Column:
    """Strategic issues go to a senior engineer."""
    senior = F.array(F.lit(SENIOR_ASSIGNEE))
    return F.when(level == "strategic", senior).otherwise(F.array().cast("array<string>"))


def labels(level: Column, ftype: Column, priority: Column) -> Column:
    """Base, risk, type, priority bucket, and a newcomer label when safe."""
    bucket = F.when(priority >= 80, "high").when(priority >= 50, "medium").otherwise("low")
    return F.array_compact(
        F.array(
            F.lit(BASE_LABEL),
            F.concat(F.lit("risk:"), level),
            F.concat(F.lit("type:"), ftype),
            F.concat(F.lit("priority:"), bucket),
            F.when(level == "safe", F.lit(NEWCOMER_LABEL)),
        )
    )


def fallback_fields(groups: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Issue fields from the template of the failure type; a few fixed rows, so a chain, no join."""

    def pick(attribute: str) -> Column:
        chain = F
        for name, template in rules.templates.items():
            chain = chain.when(F.col("failure_type") == name, F.lit(getattr(template, attribute)))
        default = F.lit(getattr(rules.default_template, attribute))
        return default if chain is F else chain.otherwise(default)

    level = F.col("risk_level")
    return groups.withColumns(
        {
            "raw_title": pick("title"),
            "risk_level": pick("risk_level"),
            "priority": pick("priority").cast("int"),
            "estimated_effort": pick("estimated_effort"),
            "required_expertise": F.lit("mid"),
        }
    ).withColumns(
        {
            "title": tagged_title(level, F.col("raw_title")),
            "labels": F.array(
                F.lit(BASE_LABEL),
                F.concat(F.lit("risk:"), level),
                F.concat(F.lit("type:"), F.col("failure_type")),
            ),
        }
    ).drop("raw_title")


_ANSWER_KEYS = (*REQUIRED_KEYS, *OPTIONAL_KEYS, *LIST_KEYS)


def _answer_fields(value: Column) -> Column:
    """The fields of an answer, each read as what it should be."""

    def field(key: str) -> Column:
        read = number_of if key == "priority" else list_of if key in LIST_KEYS else text_of
        return read(value, key).alias(key)

    return F.struct(*map(field, _ANSWER_KEYS))


def parse_responses(responses: DataFrame) -> DataFrame:
    """Read the JSON object inside each response text.

    Of the objects in a text the first one that has all required keys is the
    answer; ``valid`` says whether there is one and ``reason`` why not. Numbers
    may be given as texts, lists of one as a single value.
    """
    spans = object_spans(F.coalesce("response", F.lit("")))
    objects = F.filter(F.transform(spans, readable), lambda v: v.isNotNull())
    read = responses.withColumn("_spans", F.size(spans)).withColumn("_read", F.transform(objects, _answer_fields))
    whole = F.get(F.filter("_read", lambda a: first_missing(a, REQUIRED_KEYS).isNull()), F.lit(0))
    reason = (
        F.when(F.col("_spans") == 0, "no object")
        .when(F.size("_read") == 0, "no readable object")
        .otherwise(F.concat(F.lit("no usable "), first_missing(F.get("_read", F.lit(0)), REQUIRED_KEYS)))
    )
    parsed = read.withColumn("answer", whole).withColumn("valid", F.col("answer").isNotNull())
    return parsed.withColumn("reason", F.when(~F.col("valid"), reason)).drop("_spans", "_read")


def accepted_responses(responses: DataFrame) -> DataFrame:
    return parse_responses(responses).where("valid").select(*KEY, "answer.*")


def answer_files(responses: DataFrame) -> DataFrame:
    """Files that accepted responses relate a group to, one row per file."""
    return accepted_responses(responses).select(*KEY, F.explode("related_files").alias("file")).distinct()


def rejected_responses(responses: DataFrame) -> DataFrame:
    """Responses without a readable, complete object, and why; their groups get the fallback."""
    return parse_responses(responses).where("NOT valid").select(*KEY, "response", "reason")


def used_answers(responses: DataFrame) -> DataFrame:
    """Of the accepted responses of each group the one that its issue is made of: always the same, the least."""
    return accepted_responses(responses).groupBy(*KEY).agg(F.min(F.struct(*_ANSWER_KEYS)).alias("answer"))


def unused_answers(responses: DataFrame) -> DataFrame:
    """Accepted responses of groups whose issue is made of another one; equal ones count as one."""
    every = accepted_responses(responses).select(*KEY, F.struct(*_ANSWER_KEYS).alias("other")).distinct()
    joined = every.join(used_answers(responses), KEY).where("other != answer")
    return joined.select(*KEY, "other.*")


def response_issues(fallback: DataFrame, responses: DataFrame) -> DataFrame:
    """Replace fallback fields by those of an accepted response of the same group.

    A group has one issue; ``unused_answers`` lists what it is not made of.
    """
    joined = fallback.join(used_answers(responses), KEY, "left")
    has = F.col("answer").isNotNull()
    level = F.col("answer.risk_level")
    fields = ["risk_level", "priority", "estimated_effort", "required_expertise"]
    replaced = {c: F.when(has, F.col(f"answer.{c}")).otherwise(F.col(c)) for c in fields}
    replaced["title"] = F.when(has, tagged_title(level, F.col("answer.title"))).otherwise(F.col("title"))
    replaced["labels"] = F.when(
        has, labels(level, F.col("failure_type"), F.col("answer.priority"))
    ).otherwise(F.col("labels"))
    return joined.withColumns(replaced)


def apply_overrides(fields: DataFrame, overrides: DataFrame) -> DataFrame:
    """Give groups with a configured risk level that level in title, labels and, later, assignees.

    ``overrides`` holds repo, group_key and risk_level, one row for a group at most.
    """
    joined = fields.join(overrides.select(*KEY, F.col("risk_level").alias("_level")), KEY, "left")
    level, known = F.col("_level"), F.col("_level").isNotNull()
    bare = F.regexp_replace("title", r"^\[[A-Z]+\] ", "")
    kept = F.filter("labels", lambda x: (x != NEWCOMER_LABEL) | (level == "safe"))
    relabelled = F.transform(
        kept, lambda x: F.when(x.startswith("risk:"), F.concat(F.lit("risk:"), level)).otherwise(x)
    )
    return joined.withColumns(
        {
            "title": F.when(known, tagged_title(level, bare)).otherwise(F.col("title")),
            "labels": F.when(known, relabelled).otherwise(F.col("labels")),
            "risk_level": F.coalesce("_level", "risk_level"),
            "risk_reason": F.when(known, F.lit(CONFIGURED_REASON)).otherwise(F.col("answer.risk_reason")),
        }
    ).drop("_level")


def without_answers(fallback: DataFrame) -> DataFrame:
    """The same columns as ``response_issues`` when there are no responses."""
    return fallback.withColumn("answer", F.lit(None).cast(RESPONSE_SCHEMA))


def issue_body(n_links: int = SHOWN_LINKS) -> Column:
    """Body text; a section appears only when there is something to say."""

    def stamp(column: str) -> Column:
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss")

    def bullets(column: str) -> Column:
        return F.array_join(F.transform(column, lambda x: F.concat(F.lit("- "), x)), "\n")

    def section(heading: str, text: Column) -> Column:
        return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"\n## {heading}\n"), text))

    more = F.greatest(F.col("failure_count") - n_links, F.lit(0))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Repository: "), F.col("repo")),
        F.concat(F.lit("Risk: "), F.concat_ws(" - ", "risk_level", "risk_reason")),
        F.concat(F.lit("Type: "), F.col("failure_type")),
        F.concat(F.lit("Priority: "), F.col("priority").cast("string")),
        F.concat(F.lit("Effort: "), F.col("estimated_effort")),
        F.concat(F.lit("Expertise: "), F.col("required_expertise")),
        F.when(
            F.col("risk_level") == "strategic",
            F.lit("\n## Plan first\nThis change needs a senior review before any work starts."),
        ),
        section("Root cause", F.col("answer.root_cause")),
        section("Impact", F.col("answer.impact")),
        section("Suggested fix", F.col("answer.suggested_fix")),
        F.when(
            F.size("answer.commands") > 0,
            F.concat(F.lit("\n## Commands\n```\n"), F.array_join("answer.commands", "\n"), F.lit("\n```")),
        ),
        section("Related files", bullets("answer.related_files")),
        section("How to verify", F.col("answer.verification")),
        section("How to prevent", F.col("answer.prevention")),
        section("Errors", and_more(bullets("top_patterns"), "more_patterns", "\n")),
        section("Files", and_more(bullets("top_files"), "more_files", "\n")),
        F.lit("\n## Occurrences"),
        F.concat(F.lit("Most recent: "), stamp("last_seen")),
        F.concat(F.lit("First: "), stamp("first_seen")),
        F.concat(F.lit("Total: "), F.col("failure_count").cast("string")),
        bullets("named_links"),
        F.when(more > 0, F.concat(F.lit("and "), more.cast("string"), F.lit(" more"))),
        F.lit("\nOpened by failure triage."),
    )


def assemble_issues(fields: DataFrame, shown: DataFrame, links: DataFrame) -> DataFrame:
    """Add body and assignees; ``number`` is the first job of the group, ``first_pattern`` its most frequent error."""
    joined = fields.join(shown, KEY, "left").join(links, KEY, "left")
    return joined.withColumns({"body": issue_body(), "assignees": assignees(F.col("risk_level"))}).select(
        *KEY,
        F.col("first_job_id").alias("number"),
        "title", "body", "risk_level", "priority", "estimated_effort", "required_expertise",
        "labels", "assignees", "failure_count",
        F.array("failure_type").alias("failure_types"), F.get("top_patterns", F.lit(0)).alias("first_pattern"),
    )


def focus(issues: DataFrame, level: str = "all") -> DataFrame:
    """Issues of one risk level, or all."""
    if level == "all":
        return issues
    if level not in RISK_LEVELS:
        raise ValueError(f"unknown risk level {level!r}")
    return issues.where(F.col("risk_level") == level)


def at_least(issues: DataFrame, min_priority: int) -> DataFrame:
    return issues.where(F.col("priority") >= min_priority)


def risk_summary(issues: DataFrame) -> DataFrame:
    """Issues per repository and risk level; levels without any count as zero."""
    return issues.groupBy("repo").agg(
        *[F.count_if(F.col("risk_level") == level).alias(level) for level in RISK_LEVELS]
    )
