"""Hard negatives by integer scores from Strassen products of tiles.

Vectors become integers and are written once, in tiles of some thousand rows.
Anchors are numbered and taken in blocks of bounded size; a block goes to all
tasks, and each task multiplies it with its tiles: int64 matrices, multiplied by
Strassen's recursion with zero padding, with integer additions only. So scores
are exact and ties are real ones. A first pass keeps a heap of the best
positives of each anchor, a second one a heap for the window of each positive.
Heaps merge: within a task from tile to tile, and between tasks by rank.

An anchor block meets every row, which is what a search for a stated set of
anchors means; nothing but heap entries is shuffled.

Defined results: rows with a null id, a null label, or a vector that is null or
holds null or non-finite entries take no part, nor do empty vectors or those of
another length than most; repeated rows are rows of their own (a copy of an
anchor is another row); ties go to the smaller id; without anchors or partners
there are no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failtriage.llm.common import discard, ranked, store
from failtriage.llm.vectors import commonest, rows_of, scaled

SCALE = 256.0
#: Rows of a tile; anchors multiplied at a time; bytes of a block of anchors, as 64-bit numbers.
TILE, ANCHORS, BLOCK_BYTES = 4096, 1024, 16 << 20
#: Tiles with a side of at most this are multiplied directly.
LEAF = 32
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these hundredths of the positive's.
LEAST, MOST = 50, 95
EXACT_FLOAT = 1 << 53
#: No score; its negative is a number too.
NONE = np.iinfo(np.int64).min + 1


def strassen(a: np.ndarray, b: np.ndarray, bound: tuple[int, int] | None = None) -> np.ndarray:
    """Exact product of two int64 matrices whose product fits into int64.

    ``bound`` are the greatest absolute entries. A leaf is multiplied by floats
    where all its partial sums are exact in them, else by integers; integer sums
    that overflow on the way are undone by the additions, as they wrap around.
    """
    m, k = a.shape
    n = b.shape[1]
    if bound is None:
        bound = int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0))
    if min(m, k, n) <= LEAF:
        if k * bound[0] * bound[1] < EXACT_FLOAT:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    (i, j), l = (a.shape[0] // 2, a.shape[1] // 2), b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    wider = 2 * bound[0], 2 * bound[1]
    p1 = strassen(a11 + a22, b11 + b22, wider)
    p2 = strassen(a21 + a22, b11, wider)
    p3 = strassen(a11, b12 - b22, wider)
    p4 = strassen(a22, b21 - b11, wider)
    p5 = strassen(a11 + a12, b22, wider)
    p6 = strassen(a21 - a11, b11 + b12, wider)
    p7 = strassen(a12 - a22, b21 + b22, wider)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


TILES = "size int, n int, ids binary, labels binary, x binary"


def tiles(table: DataFrame, key: str = "vec_id", label: str | Column = "label", vector: str = "embedding") -> DataFrame:
    """Usable rows as tiles of ids, labels and integer vectors of one length, written once; ``tile`` is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def tile(size: int) -> pa.RecordBatch:
            ids, labels, x = (np.concatenate(part) for part in zip(*held.pop(size)))
            order = np.argsort(ids, kind="stable")
            fields = [size, len(ids), ids[order].tobytes(), labels[order].tobytes(), x[order].tobytes()]
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([f], t) for f, t in zip(fields, types)], ["size", "n", "ids", "labels", "x"]
            )

        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for size, (at, values) in rows_of(batch.column(2)).items():
                x = scaled(values, SCALE)
                if np.abs(x).max() >= 1 << 31:
                    raise ValueError("a component is too large for exact scores")
                held.setdefault(size, []).append((ids[at].astype(np.int64), labels[at].astype(np.int64), x.astype(np.int32)))
                if sum(len(part[0]) for part in held[size]) >= TILE:
                    yield tile(size)
        for size in list(held):
            yield tile(size)

    label = F.col(label) if isinstance(label, str) else label
    rows = table.select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")
    ).where("id IS NOT NULL AND label IS NOT NULL")
    written = store(rows.mapInArrow(run, TILES).withColumn("tile", F.monotonically_increasing_id()), "tiles")
    sizes = {r["size"]: r["n"] for r in written.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    return written.where(F.col("size") == F.lit(commonest(sizes)))


def _anchors(cut: DataFrame, every: int) -> DataFrame:
    """Rows whose id is divisible by ``every``: where they are, and a number from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, x, tile in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
                at = np.flatnonzero(ids % every == 0)
                rows = np.frombuffer(x, np.int32).reshape(len(ids), -1)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tile] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(ids[at]), pa.array(labels[at]),
                     pa.array([r.tobytes() for r in rows], pa.binary())],
                    ["tile", "place", "id", "label", "x"],
                )

    schema = "tile long, place int, id long, label long, x binary"
    found = store(cut.select("ids", "labels", "x", "tile").mapInArrow(run, schema).withColumn("one", F.lit(0)), "anchors")
    return store(ranked(found, "one", "anchor").drop("one"), "numbered-anchors")


@dataclass
class Block:
    """A block of anchors: their numbers from ``first``, places, labels and vectors."""

    first: int
    tile: np.ndarray
    place: np.ndarray
    labels: np.ndarray
    x: np.ndarray


def _block(anchors: DataFrame, first: int, size: int) -> Block:
    """At most ``size`` anchors; the only rows that come to the driver."""
    rows = anchors.where((F.col("anchor") >= first) & (F.col("anchor") < first + size)).orderBy("anchor").collect()
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.int32).reshape(len(rows), -1).astype(np.int64)
    tile, place, labels = (np.array([r[c] for r in rows], np.int64) for c in ("tile", "place", "label"))
    return Block(first, tile, place, labels, x)


class Heaps:
    """The best ``k`` entries of each of many keys, by falling score and rising id."""

    def __init__(self, keys: int, k: int) -> None:
        self.k = k
        self.score = np.full((keys, k), NONE)
        self.id = np.zeros((keys, k), np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge single entries in."""
        if not len(key):
            return
        touched = np.unique(key)
        keys = np.concatenate([np.repeat(touched, self.k), key])
        scores = np.concatenate([self.score[touched].ravel(), score])
        every = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((every, -scores, keys))
        keys, scores, every = keys[order], scores[order], every[order]
        start = np.searchsorted(keys, touched)
        at = start[:, None] + np.arange(self.k)
        self.score[touched], self.id[touched] = scores[at], every[at]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, at = np.nonzero(self.score > NONE)
        return key, self.score[key, at], self.id[key, at]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Where the ``k`` greatest entries of each row and all that equal the least of them are."""
    if scores.shape[1] <= k:
        return scores > NONE
    least = np.partition(scores, -k, axis=1)[:, [-k]]
    return (scores >= least) & (scores > NONE)


def _tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, labels, x, tile in zip(*(batch.column(i).to_pylist() for i in range(4))):
            ids = np.frombuffer(ids, np.int64)
            yield tile, ids, np.frombuffer(labels, np.int64), np.frombuffer(x, np.int32).reshape(len(ids), -1).astype(np.int64)


def _positives(cut: DataFrame, block: Block, k: int) -> DataFrame:
    """Best rows of the anchor's label, of each task: anchor, id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(block.labels), k)
        order = np.argsort(block.labels, kind="stable")
        known, starts = np.unique(block.labels[order], return_index=True)
        of_label = dict(zip(known.tolist(), np.split(order, starts[1:])))
        for tile, ids, labels, x in _tiles_of(batches):
            for label in np.intersect1d(known, labels).tolist():
                own, others = of_label[label], np.flatnonzero(labels == label)
                for some in np.split(own, range(ANCHORS, len(own), ANCHORS)):
                    scores = strassen(block.x[some], x[others].T)
                    here = np.flatnonzero(block.tile[some] == tile)
                    scores[here, np.searchsorted(others, block.place[some][here])] = NONE
                    a, c = np.nonzero(_best(scores, k))
                    heaps.add(some[a], scores[a, c], ids[others[c]])
        key, score, ids = heaps.rows()
        yield pa.RecordBatch.from_arrays([pa.array(key + block.first), pa.array(ids), pa.array(score)], ["anchor", "id", "score"])

    return cut.select("ids", "labels", "x", "tile").mapInArrow(run, "anchor long, id long, score long")


def _negatives(cut: DataFrame, block: Block, score: np.ndarray, k: int) -> DataFrame:
    """Best rows of other labels in the window of each positive, of each task: anchor, positive, id, score.

    ``score`` holds the scores of the positives of each anchor, least numbers where it has fewer.
    """
    wanted = score.shape[1]
    missing = score == NONE
    low = np.where(missing, np.iinfo(np.int64).max, -((-LEAST * np.where(missing, 0, score)) // 100))
    high = np.where(missing, NONE, (MOST * np.where(missing, 0, score)) // 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(score) * wanted, k)
        for _, ids, labels, x in _tiles_of(batches):
            for first in range(0, len(score), ANCHORS):
                part = slice(first, first + ANCHORS)
                # A full heap takes nothing below its least entry.
                full = heaps.score.reshape(len(score), wanted, k)[part, :, -1]
                least = np.maximum(low[part], full)
                scores = strassen(block.x[part], x.T)
                near = (scores >= least.min(axis=1)[:, None]) & (scores <= high[part].max(axis=1)[:, None])
                a, c = np.nonzero(near)
                other = block.labels[part][a] != labels[c]
                a, c = a[other], c[other]
                found = scores[a, c]
                for j in range(wanted):
                    fits = (found >= least[a, j]) & (found <= high[part][a, j])
                    heaps.add((a[fits] + first) * wanted + j, found[fits], ids[c[fits]])
        key, found, ids = heaps.rows()
        yield pa.RecordBatch.from_arrays(
            [pa.array(key // wanted + block.first), pa.array((key % wanted).astype(np.int32) + 1), pa.array(ids), pa.array(found)],
            ["anchor", "place", "id", "score"],
        )

    return cut.select("ids", "labels", "x", "tile").mapInArrow(run, "anchor long, place int, id long, score long")


def _first(entries: DataFrame, key: list[str], k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "id")
    return entries.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine(
    table: DataFrame, key: str = "vec_id", label: str | Column = "label", vector: str = "embedding", *,
    every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of all anchors.

    Anchors are the rows whose ``key`` is divisible by ``every``.
    """
    cut = tiles(table, key, label, vector)
    anchors = _anchors(cut, every)
    first = anchors.agg(F.count("*").alias("n"), F.max(F.length("x")).alias("bytes")).first()
    size = max(1, BLOCK_BYTES // (2 * first["bytes"])) if first["n"] else 1
    blocks = []
    for start in range(0, first["n"], size):
        block = _block(anchors, start, size)
        best = store(_first(_positives(cut, block, positives), ["anchor"], positives, "place"), "positives")
        score = np.full((len(block.labels), positives), NONE)
        frame = best.select("anchor", "place", "score").toPandas()
        score[frame["anchor"].to_numpy(np.int64) - start, frame["place"].to_numpy(np.int64) - 1] = frame["score"].to_numpy(np.int64)
        near = _first(_negatives(cut, block, score, negatives), ["anchor", "place"], negatives, "rank")
        pairs = near.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        known = best.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        blocks.append(store(pairs.join(known, ["anchor", "place"]), "negatives"))
        discard(best)
    names = anchors.select("anchor", F.col("id").alias("anchor_id"))
    if not blocks:
        empty = "anchor long, place int, rank int, negative_id long, negative_score long, positive_id long, positive_score long"
        found = table.sparkSession.createDataFrame([], empty)
    else:
        found = blocks[0]
        for more in blocks[1:]:
            found = found.unionByName(more)
    return found.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
