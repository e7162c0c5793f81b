"""Best-two-fit packing of tokenised documents into sequences of bounded length.

The plan is made from the histogram of piece lengths, which has at most
``capacity`` entries whatever the size of the corpus. A bin is filled greedily
with the largest piece that fits; then its smallest piece is replaced by two
unpacked pieces as long as they fill the widened gap more tightly. A bin's
pattern stays the same until a length runs out, so it is repeated as often as
the counts allow. Pieces find their place by their rank within their length.

Defined results: a null or empty text is the closing token alone; repeated rows
are packed once each; an empty table gives no row; other columns are ignored. Any
vocabulary file of the tokenizers library gives the ids that the library gives.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failtriage.llm.common import claim, ranked, store, texts

CAPACITY = 2048
END_ID = 0
#: Words whose ids a worker keeps at most.
CACHED_WORDS = 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Code points that byte-level vocabularies use for bytes: their own if printable, else from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


#: What a vocabulary does to a text before its merges, where the ids of a text are those of its words.
WORD_BY_WORD = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def word_by_word(path: str) -> bool:
    """Whether a vocabulary is of the kind whose texts can be tokenised word by word."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    tokens = spec.get("added_tokens") or []
    special = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in tokens)
    return plain and special and model.get("end_of_word_suffix") == "</w>" and all(spec.get(k) == v for k, v in WORD_BY_WORD.items())


class _Whole:
    """Ids of whole texts, for vocabularies whose texts have to be tokenised as a whole."""

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)

    def flush(self, rows: list[bytes]) -> Iterator[bytes]:
        texts_ = [row.decode("utf-8", "replace") for row in rows]
        for found in self.tokenizer.encode_batch_fast(texts_, add_special_tokens=False):
            yield np.array(found.ids, "<u4").tobytes()


class _Ids(dict):
    """Ids of words as little-endian 32-bit numbers.

    No token of such a vocabulary spans white space, so the ids of a text are
    those of its words one after the other. A stop or comma after a letter is a
    token of its own, and the case of ASCII letters does not matter. Unknown
    words are tokenised together, with a control character in between, whose id
    tells them apart. Two generations of words are kept, so common ones stay.
    """

    CLOSING = re.compile(rb"(?<=[a-z])([.,])(?=\s|\Z)")
    SPECIAL = b"<|"
    BETWEEN = "\x01"

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # words are kept here
        self.old: dict[bytes, bytes] = {}
        (self.between,) = self._encode(self.BETWEEN)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    @classmethod
    def words(cls, text: bytes) -> list[bytes]:
        """Parts of a text that can be tokenised one by one; texts that may hold special tokens stay as they are."""
        if cls.SPECIAL not in text:
            text = cls.CLOSING.sub(rb" \1", text.lower())
        return text.split()

    @staticmethod
    def _letters(word: bytes) -> str | None:
        """A word of lower-case letters as the model takes it: one code point for each byte."""
        if word.isalpha():
            return word.decode("ascii") if word.islower() else None
        if word.isascii():
            return None
        text = word.decode("utf-8", "replace")
        if text.isalpha() and text.lower() == text and unicodedata.is_normalized("NFC", text):
            return word.decode("latin-1").translate(BYTES)
        return None

    def learn(self, words: set[bytes]) -> None:
        """Add the ids of the words."""
        missing = words.difference(self)
        if len(self) + len(missing) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()
            missing = words
        if self.old:
            known = self.old.keys() & missing
            self.update((w, self.old[w]) for w in known)
            missing = missing - known
        rest = []
        for w in missing:
            letters = self._letters(w)
            if letters is None:
                rest.append(w)
            else:
                self[w] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])
        if any(b"\x01" in w for w in rest):
            for w in [w for w in rest if b"\x01" in w]:
                self[w] = np.array(self._encode(w.decode("utf-8", "replace")), "<u4").tobytes()
            rest = [w for w in rest if b"\x01" not in w]
        for at in range(0, len(rest), 500):
            some = rest[at : at + 500]
            ids = np.array(self._encode(b" \x01 ".join(some).decode("utf-8", "replace")), "<u4")
            data, start = ids.tobytes(), 0
            ends = (4 * np.flatnonzero(ids == self.between)).tolist()
            for w, end in zip(some, [*ends, len(data)]):
                self[w] = data[start:end]
                start = end + 4


    def flush(self, rows: list[bytes]) -> Iterator[bytes]:
        held = [self.words(row) for row in rows]
        self.learn(set().union(*held))
        for some in held:
            yield b"".join(map(self.__getitem__, some))


@functools.lru_cache(maxsize=1)
def _ids(path: str) -> _Ids | _Whole:
    return _Ids(path) if word_by_word(path) else _Whole(path)


#: Bytes of text whose words are looked up together.
TOGETHER = 4_000_000


def token_bytes(rows: Iterable[bytes], path: str) -> Iterator[bytes]:
    """Ids of each text and the closing id, 4 bytes each."""
    claim("packing", _ids.cache_clear)
    known = _ids(path)
    end = END_ID.to_bytes(4, "little")
    held, size = [], 0
    for text in rows:
        held.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield from (ids + end for ids in known.flush(held))
            held, size = [], 0
    yield from (ids + end for ids in known.flush(held))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens; only a longer document is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 4 * capacity
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            ids = batch.column(0).to_pylist()
            for doc_id, data in zip(ids, token_bytes(texts(batch), path)):
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32())]
                + [pa.array(x, pa.int64()) for x in (start, length, crc)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def fill(lengths: list[int], left: Counter, capacity: int) -> Counter:
    """One bin: greedy, then two for the smallest while that is tighter. ``left`` is not changed."""
    taken: Counter = Counter()
    gap = capacity
    while gap:
        at = bisect_right(lengths, gap) - 1
        while at >= 0 and left[lengths[at]] == taken[lengths[at]]:
            at -= 1
        if at < 0:
            break
        size = lengths[at]
        k = min(left[size] - taken[size], gap // size)
        taken[size] += k
        gap -= k * size
    while gap:
        smallest = min(taken)
        room = gap + smallest
        free = Counter({x: left[x] - taken[x] for x in lengths[: bisect_right(lengths, room - 1)] if left[x] > taken[x]})
        pair = _pair(free, room)
        if not pair or sum(pair) <= smallest:
            break
        taken[smallest] -= 1
        taken = +taken
        taken.update(pair)
        gap = room - sum(pair)
    return taken


def _pair(free: Counter, room: int) -> tuple[int, int] | None:
    """The two free lengths with the greatest sum that fits in ``room``."""
    sizes, best = sorted(free), None
    for a in reversed(sizes):
        if best and 2 * a <= sum(best):
            break
        at = bisect_right(sizes, min(a, room - a)) - 1
        if at >= 0 and sizes[at] == a and free[a] < 2:
            at -= 1
        if at >= 0 and (best is None or a + sizes[at] > sum(best)):
            best = (a, sizes[at])
            if sum(best) == room:
                break
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bin patterns (pieces by length) and how often each is used, from the counts of the lengths."""
    left = Counter({size: n for size, n in counts.items() if n})
    lengths: list[int] = []
    for size in left:
        insort(lengths, size)
    out = []
    while lengths:
        pattern = fill(lengths, left, capacity)
        times = min(left[size] // k for size, k in pattern.items())
        out.append((dict(pattern), times))
        for size, k in pattern.items():
            left[size] -= k * times
            if not left[size]:
                del lengths[bisect_left(lengths, size)]
    return out


def _places(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each (length, first rank): pieces of that length in a bin, first bin, first offset."""
    used: Counter = Counter()
    first, rows = 0, []
    for pattern, times in patterns:
        offset = 0
        for size, k in sorted(pattern.items(), reverse=True):
            rows.append((size, used[size], k, first, offset))
            used[size] += k * times
            offset += k * size
        first += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "bin", "offset"), table.T.copy()))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Place every piece of every document: PIECES and sequence_id, offset.

    Only the histogram of lengths, at most ``capacity`` rows, comes to the
    driver, and the plan made of it goes to the tasks.
    """
    cut = store(pieces(docs, path or vocabulary_path(), capacity), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(plan(counts, capacity))
    wide = np.int64(1 << 48)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = places["length"] * wide + places["rank"]
        for f in frames:
            rank, length = f.pop("rank").to_numpy(), f["length"].to_numpy()
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            inner = rank - places["rank"][at]
            f["sequence_id"] = places["bin"][at] + inner // places["each"][at]
            f["offset"] = places["offset"][at] + inner % places["each"][at] * length
            yield f

    return ranked(cut, "length").select(*cut.columns, "rank").mapInPandas(run, f"{PIECES}, sequence_id long, offset long")


def sequences(docs: DataFrame, placed: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the doc_ids and starts of their pieces.

    ``doc_id`` must be unique here. A sequence has at most ``capacity`` pieces.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 4 * capacity
        for batch in batches:
            doc, piece, ids = [], [], []
            for doc_id, data in zip(batch.column(0).to_pylist(), token_bytes(texts(batch), path)):
                for k, at in enumerate(range(0, len(data), step)):
                    doc.append(doc_id)
                    piece.append(k)
                    ids.append(np.frombuffer(data[at : at + step], "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(ids, pa.list_(pa.int32()))],
                ["doc_id", "piece", "ids"],
            )

    tokens = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, ids array<int>")
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (
        placed.select("doc_id", "piece", "sequence_id", "offset")
        .join(tokens, ["doc_id", "piece"])
        .groupBy("sequence_id")
        .agg(parts.alias("p"))
        .select(
            "sequence_id",
            F.flatten("p.ids").alias("ids"),
            F.col("p.doc_id").alias("doc_ids"),
            F.col("p.offset").alias("offsets"),
        )
    )
