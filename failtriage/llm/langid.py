"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text is built for each language. A text is parsed
into phrases, each the longest match of the rest of the text in the language's
automaton; the language that needs the fewest phrases for the text wins. More
phrases per letter mean a higher cross entropy.

Texts are lower-cased, runs of anything but letters count as one space, and
parsing starts anew every ``BLOCK`` characters, so long texts are parsed as many
blocks side by side: the walk is a table look-up for all blocks at once, and a
step of the automaton either goes on or, marked in the table, starts a phrase.
All letters of the training text are told apart, in any script; each language has
one code for the letters that it never saw.

The training text of a language is at most ``SAMPLE_CHARS`` characters, taken
from at most ``SAMPLE_DOCS`` labelled documents in the order of a hash of their
id, ``DOC_CHARS`` of each; all languages share ``TOTAL_CHARS``. This is the only
sample; every text is predicted whole.

Defined results: a null text and one without a letter is ``und`` with score 0,
as is any text if nothing was learned; ties go to the first language in order;
repeated rows are predicted alike; an empty table gives no row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from failtriage.llm.common import claim, texts

UNKNOWN = "und"
SAMPLE_CHARS = 24_000
SAMPLE_DOCS = 60
DOC_CHARS = 1_000
TOTAL_CHARS = 1_200_000
BLOCK = 1_024
#: Letters of a language up to which its automaton is a full table; beyond, only its transitions are held.
LETTERS = 94


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame) -> dict[str, str]:
    """Training text by language, of rows that are not held out; bounded as said above."""
    rows = docs.where("text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    rows = rows.where(F.col("text").rlike(r"\p{L}")).select(
        "lang", F.xxhash64("doc_id").alias("h"), "doc_id", F.substring("text", 1, DOC_CHARS).alias("text")
    )
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE_DOCS)
    found: dict[str, list[str]] = {}
    for r in rows.orderBy("lang", "_n").collect():
        found.setdefault(r["lang"], []).append(r["text"])
    most = min(SAMPLE_CHARS, TOTAL_CHARS // max(1, len(found)))
    return {lang: " ".join(parts)[:most] for lang, parts in sorted(found.items())}


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    follow: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return follow


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point, and whether it is a letter."""
    lower = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, bool)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            letter[c] = True
            y = x.lower()
            if len(y) == 1:
                lower[c] = ord(y)
    return lower, letter


def _points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)


def letters(points: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Letter codes of a text, runs of anything else as one 0; empty without a letter."""
    lower, letter = _classes()
    is_letter = letter[points]
    if not is_letter.any():
        return np.empty(0, np.int32)
    keep = is_letter | np.concatenate(([False], is_letter[:-1]))
    return np.where(is_letter, code[lower[points]], 0)[keep].astype(np.int32)


class Table:
    """All steps of an automaton; ``own`` gives its code of each letter code, if these differ."""

    kind = np.int32

    def __init__(self, follow: list[dict[int, int]], size: int, own: np.ndarray | None) -> None:
        # Entry (state, letter): twice the offset of the next state, odd if a phrase starts there.
        self.own = own
        start = np.array([follow[0].get(c, 0) for c in range(size)])
        table = np.tile(2 * size * start + 1, (len(follow), 1)).astype(np.int32)
        for state, to in enumerate(follow):
            if to:
                table[state, list(to)] = [2 * size * t for t in to.values()]
        table[0] = 2 * size * start + 1
        self.table = table.ravel()

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        return self.table.take((state >> 1) + letter)


class Sparse:
    """The same for large alphabets: transitions by sorted (state, letter), a phrase starts where there is none."""

    kind = np.int64

    def __init__(self, follow: list[dict[int, int]], size: int, own: np.ndarray) -> None:
        self.own = own
        self.start = np.array([2 * size * follow[0].get(c, 0) + 1 for c in range(size)], np.int64)
        pairs = sorted((size * state + c, 2 * size * t) for state, to in enumerate(follow) if state for c, t in to.items())
        self.keys = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.to = np.array([t for _, t in pairs] + [0], np.int64)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = (state >> 1) + letter
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], self.start[letter])


class Model:
    """Look-up tables of the automata of the languages in ``samples``."""

    def __init__(self, samples: tuple[tuple[str, str], ...]) -> None:
        self.langs = [lang for lang, _ in samples]
        lower, letter = _classes()
        raw = [_points(text.encode()) for _, text in samples]
        seen = [lower[p[letter[p]]] for p in raw]
        known = np.unique(np.concatenate([*seen, np.empty(0, np.uint32)]))
        self.code = np.full(0x110000, len(known) + 1, np.int32)
        self.code[known] = np.arange(1, len(known) + 1)
        self.size = len(known) + 2
        self.tables = [self._table(letters(p, self.code)) for p in raw]

    def _table(self, text: np.ndarray) -> Table | Sparse:
        if self.size <= LETTERS + 2:
            return Table(automaton(text), self.size, None)
        used = np.unique(np.append(text, 0))
        own = np.full(self.size, len(used), np.int32)
        own[used] = np.arange(len(used))
        kind = Table if len(used) <= LETTERS + 1 else Sparse
        return kind(automaton(own[text]), len(used) + 1, own)

    def phrases(self, blocks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each block and language; ``blocks`` holds a step in each row, longest blocks first."""
        out = np.zeros((len(self.langs), len(lengths)), np.int32)
        active = np.searchsorted(-lengths, -np.arange(len(blocks)), "left")
        for table, count in zip(self.tables, out):
            state = np.zeros(len(lengths), table.kind)
            for step, n in zip(blocks, active.tolist()):
                state = table.step(state[:n], step[:n] if table.own is None else table.own[step[:n]])
                count[:n] += (state & 1).astype(np.int32)
        return out


@functools.lru_cache(maxsize=2)
def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(samples)


def _forget() -> None:
    _model.cache_clear()
    _classes.cache_clear()


def _predict(model: Model, rows: list[bytes]) -> tuple[list[str], list[float]]:
    parts, owner = [], []
    for i, text in enumerate(rows):
        coded = letters(_points(text), model.code)
        for at in range(0, len(coded), BLOCK):
            parts.append(coded[at : at + BLOCK])
            owner.append(i)
    best, score = [UNKNOWN] * len(rows), [0.0] * len(rows)
    if not parts or not model.langs:
        return best, score
    lengths = np.array([len(p) for p in parts])
    order = np.argsort(-lengths, kind="stable")
    blocks = np.zeros((lengths.max(), len(parts)), np.int32)
    for lane, k in enumerate(order.tolist()):
        blocks[: lengths[k], lane] = parts[k]
    found = model.phrases(blocks, lengths[order])
    total = np.zeros((len(model.langs), len(rows)))
    for row, count in zip(total, found):
        np.add.at(row, np.array(owner)[order], count)
    first = total.argmin(axis=0)
    ranked = np.sort(total, axis=0)
    for i in set(owner):
        best[i] = model.langs[first[i]]
        score[i] = float(ranked[1, i] / (ranked[0, i] + ranked[1, i])) if len(model.langs) > 1 else 1.0
    return best, score


#: Characters of text parsed side by side in a worker.
STEP_BYTES = 3_000_000


def predict(docs: DataFrame, samples: dict[str, str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two more columns: the language, and the share of the second best one in the phrases of both."""
    fixed = tuple(samples.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid", _forget)
        model = _model(fixed)
        for batch in batches:
            best, score, held, size = [], [], [], 0
            for text in texts(batch):
                held.append(text)
                size += len(text)
                if size >= STEP_BYTES:
                    some = _predict(model, held)
                    best, score, held, size = best + some[0], score + some[1], [], 0
            some = _predict(model, held)
            columns = [*batch.columns, pa.array(best + some[0], pa.string()), pa.array(score + some[1], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{names[0]}` string, `{names[1]}` double")


def identify(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) of all documents, learned from ``labelled`` or themselves."""
    samples = sample(docs if labelled is None else labelled)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return predict(rows, samples).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """Documents whose language is known, with their own columns; the rest is rejected."""
    mark = "_" * (1 + max(map(len, docs.columns)))  # longer than any name there is
    found = predict(docs, samples, (f"{mark}lang", f"{mark}score"))
    return found.where(F.col(f"{mark}lang") != UNKNOWN).select(*docs.columns)
