"""Parsing logs as they arrive, with the same operators as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from failtriage.operators.parse import parse_logs
from failtriage.rules import DEFAULT_RULES, RuleSet

LOG_SCHEMA = "repo string, job_id bigint, logs string"


def arriving_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Log rows of Parquet files that are added to ``folder``."""
    return spark.readStream.schema(LOG_SCHEMA).parquet(folder)


def append_parsed(logs: DataFrame, table: str, checkpoint: str, rules: RuleSet = DEFAULT_RULES) -> None:
    """Parse all logs that have arrived since the last call and append them to ``table``.

    The checkpoint folder remembers which files are done, so each log is parsed
    once, also when a run fails half-way.
    """
    run = (
        parse_logs(logs, rules)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(table)
    )
    run.awaitTermination()
