"""Short hashes that identify the content of an issue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from failtriage.functions.text import strip
from failtriage.operators.groups import normalize_pattern

EMPTY = "empty"
#: Parts of a digest that are summed one by one: 4 of 32 bits.
LANES, LANE_CHARS = 4, 8
#: Characters of a signature that people see.
SHOWN_CHARS = 16


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def normalized(kind: str, value: Column) -> Column:
    """The form of a value that enters the hash of its kind."""
    if kind == "pattern":
        value = normalize_pattern(value)
    elif kind == "file":
        value = base_name(value)
    return F.lower(strip(value))


def lanes(digest: Column) -> list[Column]:
    """A hexadecimal digest of 128 bits as four numbers."""

    def number(k: int) -> Column:
        return F.conv(F.substring(digest, LANE_CHARS * k + 1, LANE_CHARS), 16, 10).cast("bigint")

    return [number(k) for k in range(LANES)]


def hash_of_sums(count: Column, sums: Sequence[Column]) -> Column:
    """Hash of a set from its size and the sums of the lanes of its values, whatever its size and order.

    Sums merge, so a set is hashed by partial aggregation. They are not cut:
    sets of equal size with equal sums in all lanes are taken for one set.
    """
    text = F.concat_ws(":", count.cast("string"), *[s.cast("string") for s in sums])
    return F.when(count == 0, F.lit(EMPTY)).otherwise(F.md5(text))


def list_hash(values: Column, kind: str = "type") -> Column:
    """Hash of a list that ignores order, case, outer blanks and repetition."""
    clean = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: normalized(kind, v))
    digests = F.transform(F.array_distinct(clean), F.md5)

    def total(k: int) -> Column:
        return F.aggregate(digests, F.lit(0).cast("bigint"), lambda sum_, d: sum_ + lanes(d)[k])

    return hash_of_sums(F.size(digests), [total(k) for k in range(LANES)])


def combined_hash(errors: Column, files: Column, types: Column) -> Column:
    return F.sha2(F.concat_ws("|", errors, files, types), 256)


def shown(signature: Column) -> Column:
    """The first characters of a signature, for people; nothing is joined on them."""
    return F.substring(signature, 1, SHOWN_CHARS)
