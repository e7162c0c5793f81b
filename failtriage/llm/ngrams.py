"""Similarity join of shingle sets by PartEnum signatures.

Sets of one size band whose Jaccard similarity reaches the threshold differ in
at most k elements, k growing with the size. The element domain is dealt into
n > k partitions, so such sets agree on at least n - k partitions, and a
signature is the part of a set in one partition. Sets emit the signatures of
their own band and of the next, so neighbours in size meet as well.

An empty part says nothing and is no signature. A set with n - k or more empty
parts also emits the signatures of another dealing: of two similar sets, either
one has fewer and they share a part that is not empty, or both emit the other
dealing too.

Similar sets share not one but many signatures when they are large; a set keeps
only those it needs to meet them, and sets with too few shared ones drop out.
Within a group of one signature no pairs are enumerated: all members are
compared with the smallest one. Members that are then in one component need no
more comparison. A group that still holds several components is compared
further if few of its members stand apart, and else split by joining its
signature with those of another dealing, of which similar sets share one again.
Bit sketches, whose distance never exceeds that of the sets, drop unlike pairs
before texts are read.

Defined results: copies (equal word sequences) collapse first and need no
signatures; a text without words has an empty set and is linked with nothing;
rows that share a doc_id are one document with several texts; a row without
doc_id is linked with nothing and has no component; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from failtriage.llm.common import discard, mix, store, texts, window_hashes
from failtriage.llm.graph import components
from failtriage.llm.wordhash import word_hashes

WIDTH = 5
THRESHOLD = Fraction(4, 5)
_HALF = np.uint64(32)
_START = np.zeros(1, np.int64)
#: Longs of a sketch.
SKETCH = 16
#: Dealings tried for sets with many empty parts.
DEALINGS = 8
#: A group is compared pair by pair if no more members than this stand apart, else it is split.
APART = 2000
#: Splits of a group; after the last one, it is compared pair by pair.
SPLITS = 5


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted without repeats; numpy sorts integers much faster than it finds distinct ones by hashing."""
    out = np.sort(hashes)
    keep = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out[keep]


def shingles(batch: pa.RecordBatch, name: str = "text", width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text, the distinct hashes of its word windows; a shorter text is one window."""
    for words in word_hashes(batch, name, lower=True):
        windows = window_hashes(words.hashes, width)
        for start, n in zip(words.starts.tolist(), words.counts.tolist()):
            if n >= width:
                yield _distinct(windows[start : start + n - width + 1])
            else:
                yield window_hashes(words.hashes[start : start + n], n, seed=n) if n else np.empty(0, np.uint64)


def bands(threshold: Fraction, largest: int = 1 << 40) -> list[int]:
    """Upper sizes of the bands: sizes of one band are within the threshold of each other."""
    out, low = [], 1
    while low <= largest:
        out.append(int(low / threshold))
        low = out[-1] + 1
    return out


@lru_cache(1024)
def most_apart(sizes: int, threshold: Fraction) -> int:
    """Elements in which two sets of so many elements together may differ."""
    return int((1 - threshold) / (1 + threshold) * sizes)


def signatures(
    elements: np.ndarray, uppers: list[int], threshold: Fraction = THRESHOLD, first: int = 0, only: int | None = None
) -> list[tuple[np.ndarray, int, int]]:
    """Signatures of a set by band, as (signed 64-bit numbers, band, need).

    A similar set shares ``need`` of them at least. Their lowest bit is that of
    the band. ``first`` is the first dealing, ``only`` restricts them to the band
    with that lowest bit.
    """
    if not len(elements):
        return []
    band = bisect_left(uppers, len(elements))
    out = []
    for instance in (band, band + 1):
        if only is not None and instance & 1 != only:
            continue
        k = most_apart(2 * uppers[instance], threshold)
        n = k + 2 + k // 4 if k else 1
        for dealing in range(first, first + DEALINGS + 1):
            salt = np.uint64((instance * 1_000_003 + dealing) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            if dealing == first + DEALINGS:
                out.append((_banded(np.array([salt], np.uint64), instance), instance, 1))
                break
            mixed = mix(elements ^ salt)
            mixed.sort()
            part = ((mixed >> _HALF) * np.uint64(n)) >> _HALF
            starts = np.flatnonzero(part[1:] != part[:-1])
            starts = np.concatenate((_START, starts + 1))
            held = part[starts]
            sums = np.add.reduceat(mixed, starts) + held * np.uint64(0xD6E8FEB86659FD93) + salt
            empty = n - len(held)
            need = n - k - empty if dealing == first else 1
            out.append((_banded(sums, instance), instance, max(1, need)))
            if empty < n - k:
                break
    return out


def _banded(sums: np.ndarray, band: int) -> np.ndarray:
    return (mix(sums) & ~np.uint64(1) | np.uint64(band & 1)).view(np.int64)


def sketch(elements: np.ndarray) -> list[int]:
    """Parity of the elements in each of 64 * SKETCH cells."""
    cells = (mix(elements ^ np.uint64(0xA5A5A5A5)) % np.uint64(64 * SKETCH)).astype(np.int64)
    odd = (np.bincount(cells, minlength=64 * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def features(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, n_shingles, copy, sketch): ``copy`` is equal for equal word sequences only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, copy, sketches = [], [], []
            for text, s in zip(texts(batch), shingles(batch, width=width)):
                copy.append(hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest())
                size.append(len(s))
                sketches.append(sketch(s))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size, pa.int64()),
                    pa.array(copy, pa.binary()),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "copy", "sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_shingles long, copy binary, sketch array<long>")


SIGNED = "sig long, doc_id long, need int"


def _signed(docs: DataFrame, width: int, threshold: Fraction, first: int = 0, bare: bool = False) -> DataFrame:
    """Rows (sig, doc_id, need), or sig alone if ``bare``.

    Columns ``group`` and ``only``: joined into the signature, and the sole band.
    """
    uppers = bands(threshold)
    grouped = "group" in docs.columns
    schema = "sig long" if bare else SIGNED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            group, only = (batch.column(i).to_pylist() for i in (2, 3)) if grouped else (None, [None] * len(ids))
            sigs, rows = [np.empty(0, np.int64)], []
            for i, elements in enumerate(shingles(batch, width=width)):
                for own, _, need in signatures(elements, uppers, threshold, first, only[i]):
                    if grouped:
                        mixed = mix(own.view(np.uint64) + mix(np.array([group[i]], np.int64).view(np.uint64)))
                        own = (mixed & ~np.uint64(1)).view(np.int64) | only[i]
                    sigs.append(own)
                    rows.append((len(own), ids[i], need))
            columns = [pa.array(np.concatenate(sigs))]
            if not bare:
                count, *rest = np.array(rows, np.int64).reshape(-1, 3).T
                doc_id, need = (np.repeat(x, count) for x in rest)
                columns += [pa.array(doc_id), pa.array(need.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [p.split()[0] for p in schema.split(", ")])

    return docs.select("doc_id", "text", *(["group", "only"] if grouped else [])).mapInArrow(run, schema)


def _shared(signed: DataFrame) -> DataFrame:
    """Signatures that occur twice at least, and how often."""
    return signed.groupBy("sig").agg(F.count("*").alias("held")).where("held > 1")


def _needed(members: DataFrame) -> DataFrame:
    """Members whose signatures can still lead to a similar set, with the smallest document of each group.

    A similar set shares ``need`` signatures of a document's band, so it shares
    one that is left without the ``need`` - 1 signatures that most documents
    hold; documents with fewer shared signatures drop out.
    """
    order = Window.partitionBy("doc_id", F.col("sig").bitwiseAND(1)).orderBy(F.desc("held"), "sig")
    kept = members.withColumn("_n", F.row_number().over(order)).where("_n >= need").select("sig", "doc_id")
    kept = store(kept, "needed")
    found = kept.groupBy("sig").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("_last")).where("pivot < _last")
    out = store(kept.join(found.drop("_last"), "sig"), "members")
    discard(kept)
    return out


def _alike(a: str, b: str, threshold: Fraction) -> F.Column:
    """No proof against similarity in the sketches and sizes of two sets."""
    apart = sum(
        (F.bit_count(F.get(f"{a}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{b}.sketch", F.lit(i)))) for i in range(SKETCH)),
        start=F.lit(0),
    )
    ratio = (1 - threshold) / (1 + threshold)
    return apart * ratio.denominator <= (F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles")) * ratio.numerator


def _verified(pairs: DataFrame, docs: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for kept, other in zip(shingles(batch, "first", width), shingles(batch, "second", width)):
                both = len(np.intersect1d(kept, other, assume_unique=True))
                union = len(kept) + len(other) - both
                good.append(both > 0 and both * threshold.denominator >= union * threshold.numerator)
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(mask)

    second = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("second"))
    first = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("first"))
    joined = pairs.join(second, "b").join(first, "a").select("a", "b", "first", "second")
    return joined.mapInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, width: int = WIDTH, threshold: Fraction = THRESHOLD) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    facts = store(features(docs, width), "facts")
    full = facts.where("n_shingles > 0 and doc_id is not null")
    copies = store(full.groupBy("copy").agg(F.min("doc_id").alias("first")), "copies")
    firsts = copies.select(F.col("first").alias("doc_id")).distinct()
    looks = full.join(firsts, "doc_id", "left_semi").select("doc_id", "n_shingles", "sketch")

    known = docs.where("doc_id is not null and text is not null")
    shared = store(_shared(_signed(known, width, threshold, bare=True)), "shared")
    found = store(_signed(known, width, threshold).join(shared, "sig"), "found")
    members = _needed(found.join(firsts, "doc_id", "left_semi"))
    discard(shared, found)
    links = component = None
    for split in range(SPLITS + 1):
        found = _linked(members.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")), looks, docs, width, threshold)
        links = found if links is None else links.union(found)
        component = components(links)
        rest = store(_unresolved(members, component), "unresolved")
        last = split == SPLITS
        few = rest if last else rest.where(F.col("apart") <= APART)
        found = _linked(_cross(few, looks, threshold), looks, docs, width, threshold, checked=True)
        many = rest.limit(0) if last else rest.where(F.col("apart") > APART)
        more = not many.isEmpty()
        if more or not found.isEmpty():
            links = links.union(found)
        if not more:
            break
        hot = many.select("doc_id", F.col("sig").alias("group"), F.col("sig").bitwiseAND(1).alias("only"))
        hot = hot.join(docs, "doc_id").select("doc_id", "text", "group", "only")
        signed = store(_signed(hot, width, threshold, first=(split + 1) * 100), "signed")
        members = _needed(signed.join(_shared(signed), "sig"))
        discard(signed)
    component = components(links)
    found = copies.join(component, F.col("first") == F.col("id"), "left")
    found = found.select("copy", F.coalesce("component", "first").alias("component_id"))
    linked = F.when(F.col("n_shingles") > 0, F.col("copy"))
    return (
        facts.select("doc_id", "n_shingles", linked.alias("copy"))
        .join(found, "copy", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
    )


def _linked(pairs: DataFrame, looks: DataFrame, docs: DataFrame, width: int, threshold: Fraction, checked: bool = False) -> DataFrame:
    """Verified ones of the candidate pairs, written; ``checked`` if sketches have been compared."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if not checked:
        x = looks.select(F.col("doc_id").alias("a"), F.struct("n_shingles", "sketch").alias("x"))
        y = looks.select(F.col("doc_id").alias("b"), F.struct("n_shingles", "sketch").alias("y"))
        pairs = pairs.join(y, "b").join(x, "a").where(_alike("x", "y", threshold)).select("a", "b")
    return store(_verified(pairs, docs, width, threshold), "links")


def _unresolved(members: DataFrame, component: DataFrame) -> DataFrame:
    """Members, without the pivot, of groups that span several components.

    Adds the member's component, that of the group's pivot, and how many members
    stand apart from the pivot's component.
    """
    own = component.select(F.col("id").alias("doc_id"), F.col("component").alias("c"))
    lead = component.select(F.col("id").alias("pivot"), F.col("component").alias("pc"))
    rows = members.where("doc_id <> pivot").join(own, "doc_id", "left").join(lead, "pivot", "left")
    rows = rows.select("sig", "doc_id", F.coalesce("c", "doc_id").alias("c"), F.coalesce("pc", "pivot").alias("pc"))
    stand = rows.groupBy("sig").agg(
        F.count_if(F.col("c") != F.col("pc")).alias("apart"), F.min("c").alias("_low"), F.max("c").alias("_high")
    )
    return rows.join(stand.where("_low <> _high").drop("_low", "_high"), "sig")


def _cross(rest: DataFrame, looks: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs of different components within a group, one of them apart from the pivot's."""
    seen = rest.join(looks, "doc_id")
    x = seen.where("c <> pc").alias("x")
    y = seen.alias("y")
    other = (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.pc")) | (F.col("x.doc_id") < F.col("y.doc_id")))
    joined = x.join(y, (F.col("x.sig") == F.col("y.sig")) & other & _alike("x", "y", threshold))
    return joined.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))


def one_of_each(docs: DataFrame, width: int = WIDTH, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The document with the smallest id of each component, once; rows without doc_id stay. Columns as in ``docs``."""
    found = classes(docs, width, threshold).where("doc_id = component_id").groupBy("doc_id").count()
    found = store(found, "kept")
    kept = docs.join(found.drop("count"), "doc_id", "left_semi")
    if not found.where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)
