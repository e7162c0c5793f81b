"""Substring deduplication with difference-cover anchors.

A word is removed if it lies in a window of ``WINDOW`` words that also starts in
a document with a smaller id. Anchors are runs of ``PERIOD`` words that start at
positions which, modulo ``PERIOD``, are in the difference cover ``COVER``. For
any two positions some shift below ``PERIOD`` takes both to cover positions, so
two equal windows share an anchor at the same place within them; ``PERIOD`` is
chosen so that it lies wholly inside.

Only 3 of 7 windows are hashed and grouped. Anchors seen in a single text drop
out; around the others the match is extended to whole windows, and the first
document of each of these windows decides. Groups are only counted or reduced
to their smallest document, and joined back, so no pairs are made and hot
passages collapse before the shuffle. Positions travel as bits of 64-word blocks.

Defined results: a null text has no words and keeps the empty text; texts
shorter than a window lose nothing; rows that share a doc_id are judged by their
own texts, and are no source for each other; rows without doc_id lose nothing
and are no source; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failtriage.llm.common import mix, store, texts, window_hashes
from failtriage.llm.wordhash import Words, word_hashes

WINDOW = 13
#: {0, 1, 3} has every difference modulo 7.
PERIOD, COVER = 7, (0, 1, 3)


_AT_COVER = np.isin(np.arange(PERIOD), COVER)


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in it and hash of every anchor of texts that hold a window."""
    found = window_hashes(words.hashes, WINDOW - PERIOD + 1)
    owner, (place, left) = words.owner[: len(found)], (x[: len(found)] for x in words.places())
    at = np.flatnonzero(_AT_COVER[place % PERIOD] & (left > WINDOW - PERIOD) & (place + left >= WINDOW))
    return owner[at], place[at], found[at]


def marked(words: Words, marks: pa.ListArray) -> np.ndarray:
    """Which words stand at the places that are set in the lists of 64-bit blocks, one list for each text."""
    out = np.zeros(len(words.hashes), bool)
    flat = marks.flatten()
    if len(flat):
        text = np.repeat(np.arange(len(marks)), pa.compute.fill_null(pa.compute.list_value_length(marks), 0).to_numpy(False))
        block, bits = (np.asarray(flat.field(k), np.int64) for k in ("block", "bits"))
        row, bit = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        out[words.starts[text[row]] + 64 * block[row] + bit] = True
    return out


def extended(words: Words, seen: np.ndarray) -> np.ndarray:
    """Where windows start that hold a marked anchor at a place where two equal windows may share one."""
    total = np.concatenate(([0], np.cumsum(seen)))
    starts = np.flatnonzero(words.places()[1] >= WINDOW)
    return starts[total[starts + PERIOD] > total[starts]]


def _both(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the windows that start at ``at``, 96 bits together."""
    first, second = window_hashes(words.hashes, WINDOW), window_hashes(words.hashes, WINDOW, seed=1)
    return first[at].view(np.int64), (second[at] >> np.uint64(33)).astype(np.int32)


def _once(owner: np.ndarray, found: np.ndarray) -> np.ndarray:
    """One index for each text and hash."""
    return np.unique(mix(found.view(np.uint64) + mix(owner.astype(np.uint64))), return_index=True)[1]


Emit = Callable[[Words, np.ndarray], tuple[np.ndarray, ...]]


def _spread(rows: DataFrame, emit: Emit, schema: str, keys: tuple[str, ...]) -> DataFrame:
    """Rows of the arrays that ``emit`` gives for some texts, the first with the text's number, with its ``keys``."""
    names = [part.split()[0] for part in schema.split(", ")]
    has_marks = "marks" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {k: np.asarray(batch.column(batch.schema.get_field_index(k)), np.int64) for k in keys}
            marks = batch.column(batch.schema.get_field_index("marks")) if has_marks else None
            for words in word_hashes(batch):
                n = len(words.counts)
                seen = marked(words, marks.slice(words.first, n)) if has_marks else np.empty(0, bool)
                owner, *columns = emit(words, seen)
                columns += [own[k][words.first : words.first + n][owner] for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*names, *keys])

    return rows.mapInArrow(run, ", ".join([schema, *(f"{k} long" for k in keys)]))


def _unique_anchors(words: Words, _: np.ndarray) -> tuple[np.ndarray, ...]:
    owner, _, found = anchors(words)
    at = _once(owner, found)
    return owner[at], found[at].view(np.int64)


def _placed_anchors(words: Words, _: np.ndarray) -> tuple[np.ndarray, ...]:
    owner, place, found = anchors(words)
    return owner, found.view(np.int64), place


def _windows(words: Words, seen: np.ndarray) -> tuple[np.ndarray, ...]:
    starts = extended(words, seen)
    owner, (first, second) = words.owner[starts], _both(words, starts)
    at = _once(owner, first)
    return owner[at], first[at], second[at]


def _placed_windows(words: Words, seen: np.ndarray) -> tuple[np.ndarray, ...]:
    starts = extended(words, seen)
    return words.owner[starts], *_both(words, starts), words.places()[0][starts]


def _marks(places: DataFrame) -> DataFrame:
    """Places (doc_id, tag, pos) as one list of 64-bit blocks for each text."""
    bit = F.expr("shiftleft(1L, cast(pos & 63 AS int))")
    blocks = places.groupBy("doc_id", "tag", F.shiftright("pos", 6).alias("block")).agg(F.bit_or(bit).alias("bits"))
    return blocks.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("block", "bits")).alias("marks"))


def covered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that may lose words (doc_id, tag, text), and where windows to be removed start (doc_id, tag, marks).

    ``tag`` tells texts of one doc_id apart, and is 0 if no doc_id is repeated.
    """
    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    twins = not known.groupBy("doc_id").count().where("count > 1").isEmpty()
    rows = known.withColumn("tag", (F.crc32("text") if twins else F.lit(0)).cast("long"))
    keys = ("doc_id", "tag")

    found = _spread(rows, _unique_anchors, "hash long", ())
    shared = store(found.groupBy("hash").count().where("count > 1").select("hash"), "anchors")
    placed = _spread(rows, _placed_anchors, "hash long, pos long", keys).join(shared, "hash")
    suspects = store(rows.join(store(_marks(placed), "marks"), [*keys]), "suspects")

    found = _spread(suspects, _windows, "first long, second int", ("doc_id",))
    owners = found.groupBy("first", "second").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("_last"))
    owners = store(owners.where("owner < _last").drop("_last"), "owners")
    placed = _spread(suspects, _placed_windows, "first long, second int, pos long", keys)
    places = placed.join(owners, ["first", "second"]).where("owner < doc_id")
    return suspects, store(_marks(places), "removed")


def removed_words(marks: list[dict], n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at a marked position."""
    edges = np.zeros(n + 1, np.int64)
    bits = np.array([m["bits"] for m in marks], np.int64).view(np.uint8).reshape(-1, 8)
    row, bit = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
    starts = 64 * np.array([m["block"] for m in marks])[row] + bit
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + WINDOW, n), -1)
    return np.cumsum(edges)[:n] > 0


KEPT = "doc_id long, tag long, n_words long, n_removed long, kept string"


def _kept(rows: DataFrame, digest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("marks")
            marks = batch.column(at).to_pylist() if at >= 0 else [None] * batch.num_rows
            total, gone, kept = [], [], []
            for text, m in zip(texts(batch), marks):
                words = text.split()
                if m:
                    out = removed_words(m, len(words))
                    left = [w for w, lost in zip(words, out.tolist()) if not lost]
                else:
                    left = words
                total.append(len(words))
                gone.append(len(words) - len(left))
                joined = b" ".join(left)
                kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                [p.split()[0] for p in KEPT.split(", ")],
            )

    return rows.mapInArrow(run, KEPT)


def dedup(docs: DataFrame, digest: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): the words left, or the SHA-256 of them if ``digest``."""
    suspects, removed = covered(docs)
    cut = _kept(suspects.drop("marks").join(removed, ["doc_id", "tag"]).select("doc_id", "tag", "text", "marks"), digest)
    tag = F.coalesce(F.crc32("text"), F.lit(-1))
    whole = _kept(docs.select(F.col("doc_id").cast("long"), tag.alias("tag"), "text"), digest)
    # Without repeated ids the tags of cut texts are 0, and the id alone finds them.
    cut = cut.select("doc_id", F.col("tag").alias("_tag"), F.col("n_removed").alias("_gone"), F.col("kept").alias("_kept")).dropDuplicates(["doc_id", "_tag"])
    same = (whole["doc_id"] == cut["doc_id"]) & ((cut["_tag"] == 0) | (cut["_tag"] == whole["tag"]))
    return whole.join(cut, same, "left").select(
        whole["doc_id"], "n_words", F.coalesce("_gone", "n_removed").alias("n_removed"), F.coalesce("_kept", "kept").alias("kept")
    )
