"""Signatures of issues and failures, and duplicates with the same signature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failtriage.functions.signatures import combined_hash, hash_of_sums, lanes, list_hash, normalized, shown
from failtriage.operators.groups import KEY
from failtriage.session import materialize


def with_signature(
    df: DataFrame,
    errors: str = "error_patterns", files: str = "affected_files", types: str = "failure_types",
) -> DataFrame:
    """Signature columns for rows that carry their context as arrays."""
    return df.withColumns(
        {
            "error_hash": list_hash(F.col(errors), "pattern"),
            "file_hash": list_hash(F.col(files), "file"),
            "type_hash": list_hash(F.col(types)),
        }
    ).withColumn("signature", combined_hash(F.col("error_hash"), F.col("file_hash"), F.col("type_hash"))).withColumn("short_signature", shown(F.col("signature")))


def group_signatures(values: DataFrame) -> DataFrame:
    """Signature of each failure group, from its distinct values as rows.

    Equal to that of ``with_signature`` for the same values. Only counts and
    digests are combined, so no list is gathered.
    """
    names = {"pattern": "error_hash", "file": "file_hash", "type": "type_hash"}
    value, kind = F.col("value"), F.col("kind")
    clean = F.when(kind == "pattern", normalized("pattern", value)).when(
        kind == "file", normalized("file", value)
    ).otherwise(normalized("type", value))
    distinct = values.where(kind.isin(*names)).select(*KEY, "kind", clean.alias("value")).distinct()
    numbers = lanes(F.md5(value))

    def part(name: str) -> Column:
        own = kind == name
        sums = [F.coalesce(F.sum(F.when(own, n)), F.lit(0)) for n in numbers]
        return hash_of_sums(F.count_if(own), sums)

    parts = distinct.groupBy(*KEY).agg(*[part(k).alias(name) for k, name in names.items()])
    signed = parts.withColumn("signature", combined_hash(F.col("error_hash"), F.col("file_hash"), F.col("type_hash")))
    return signed.withColumn("short_signature", shown(F.col("signature")))


def exact_duplicates(new: DataFrame, prior: DataFrame) -> DataFrame:
    """New issues whose signature occurs in ``prior`` or earlier in the same batch.

    Both inputs hold ``repo, number, signature``. Each signature is first reduced
    to its lowest number, so copies never form pairs. That small table is written,
    so the join is between two plain shuffles and a hot signature can be split.
    """
    both = prior.select("repo", "signature", F.col("number").alias("prior"), F.lit(None).cast("bigint").alias("batch")).unionByName(
        new.select("repo", "signature", F.lit(None).cast("bigint").alias("prior"), F.col("number").alias("batch"))
    )
    first = materialize(
        both.groupBy("repo", "signature").agg(
            F.min("prior").alias("first_prior"), F.min("batch").alias("first_batch")
        ),
        "signatures",
    )
    joined = new.select("repo", "number", "signature").join(first, ["repo", "signature"])
    in_batch = F.when(F.col("first_batch") < F.col("number"), F.col("first_batch"))
    return joined.select(
        "repo", "number", "signature",
        F.coalesce("first_prior", in_batch).alias("matched_number"),
        F.when(F.col("first_prior").isNotNull(), "prior").otherwise("batch").alias("scope"),
    ).where("matched_number IS NOT NULL")
