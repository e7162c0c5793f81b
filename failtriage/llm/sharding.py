"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``VNODES`` points of the ring; a row goes to the shard of the
first point at or after its hash. A shard takes no more than its share of the
rows; rows that overflow go on clockwise to the next point whose shard has room.
Shares differ by one row at most, so the law ``rows`` holds.

Only the number of rows of each arc is needed to see where they go: arcs are
bounded by shards times ``VNODES``, so the flow of the overflow is worked out on
the driver, and a row finds its shard by its rank within its arc.

Defined results: a null text has no bytes; a null doc_id hashes as an empty
text; repeated rows are dealt out one by one; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failtriage.llm.common import ranked, store

SHARDS = 24
VNODES = 64
#: Bytes that a row takes besides its text.
OVERHEAD = 8


def ring(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """Points of the ring in order and the shard of each; more shards only add points."""
    points = sorted(
        (int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "big") >> 4, s)
        for s in range(shards)
        for v in range(vnodes)
    )
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def shares(total: int, shards: int) -> list[int]:
    """Rows that each shard takes at most; they sum up to ``total``."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def flow(counts: list[int], owners: list[int], limits: list[int]) -> list[tuple[int, int, int, int]]:
    """Rows (arc, first rank, shard, first slot): where runs of an arc's rows go.

    In each turn, every arc offers what it still holds to a point, its own at
    first and one further clockwise each turn; arcs come in ring order.
    """
    room, slots = list(limits), [0] * len(limits)
    held = {arc: 0 for arc, n in enumerate(counts) if n}
    out = []
    for turn in range(len(counts)):
        for arc in list(held):
            shard = owners[(arc + turn) % len(owners)]
            take = min(room[shard], counts[arc] - held[arc])
            if take:
                out.append((arc, held[arc], shard, slots[shard]))
                room[shard] -= take
                slots[shard] += take
                held[arc] += take
            if held[arc] == counts[arc]:
                del held[arc]
        if not held:
            break
    return out


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot); slots of a shard run from 0 without gaps."""
    points, owners = ring(shards, vnodes)
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("at"),
    )

    @F.pandas_udf("long")
    def arc_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, at.to_numpy(), "left") % len(points))

    table = store(rows.withColumn("arc", arc_of("at")).drop("at"), "arcs")
    found = {r["arc"]: r["n"] for r in table.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    counts = [found.get(a, 0) for a in range(len(points))]
    runs = defaultdict(list)
    for arc, first, owner, slot in flow(counts, owners.tolist(), shares(sum(counts), shards)):
        runs[arc].append((first, owner, slot))
    table_of = np.array([(a, *r) for a in sorted(runs) for r in sorted(runs[a])], np.int64).reshape(-1, 4)
    wide = np.int64(1 << 46)

    @F.pandas_udf("shard int, slot long")
    def place(arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys = table_of[:, 0] * wide + table_of[:, 1]
        at = np.searchsorted(keys, arc.to_numpy() * wide + rank.to_numpy(), "right") - 1
        return pd.DataFrame(
            {"shard": table_of[at, 2].astype(np.int32), "slot": table_of[at, 3] + rank.to_numpy() - table_of[at, 1]}
        )

    placed = ranked(table, "arc").withColumn("p", place("arc", "rank"))
    return placed.select("doc_id", "size", "text_crc32", "p.shard", "p.slot")
