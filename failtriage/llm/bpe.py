"""Byte-level BPE by a trie of distinct words.

The encoding of a word by ranked merges has a property that makes one pass over
a trie enough: cutting the last token off an encoding leaves the encoding of
what is left. So the whole encoding of every prefix is known from its *last
token* alone. A token that ends a prefix is its last one exactly when it can
follow the last token of the part before it, that is when the merges would not
have joined anything across the border. The distinct words of a batch are put
in a trie; a depth-first walk sets the last token of each node, once for all
words that share it; and the ids of a word are read back from its node.

The walk goes over the sorted words, which is the order of the trie, and holds
the nodes between the root and the current word only.

Defined results: a null or empty text has no ids and decodes to an empty text;
repeated rows are encoded each; an empty table gives no row; other columns are
ignored; strings of special tokens in a text give their ids. A vocabulary of
another kind is refused with an error, not encoded wrongly.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from failtriage.llm.common import claim, texts

#: Words whose ids a worker keeps; as many older ones are kept beside them.
CACHED_WORDS = 250_000
#: Bytes of text whose words are looked up together.
TOGETHER = 4_000_000
#: How byte-level vocabularies cut a text into words.
SPLIT = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters whose class has been the same in all recent versions of Unicode; texts with others are split by the library.
SETTLED = re.compile("[\x00-ԯ‐-‧‰-⁞₠-₹、-ゖァ-ヺ一-龥가-힣]*")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The characters that stand for bytes: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special strings of a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                               "byte_fallback", "ignore_merges")) and not spec.get("normalizer")
        if model.get("type", "BPE") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get(
            "use_regex", True
        ) or (spec.get("decoder") or {}).get("type") != "ByteLevel" or not plain:
            raise ValueError("not a plain byte-level BPE vocabulary")
        letters = _byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in model["vocab"].items()}
        self.id_of = {data: i for i, data in self.bytes_of.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = (model["vocab"][t] for t in (a, b, a + b))
            if whole in self.parts or any(len(self.bytes_of[t]) > 1 and t not in self.parts for t in (left, right)):
                raise ValueError("merges are not in order, or a token is made twice")
            self.merged[left, right] = self.rank[whole] = rank
            self.parts[whole] = left, right
        for i, data in self.bytes_of.items():
            if len(data) == 1:
                self.rank[i] = -1
            elif i not in self.parts:
                raise ValueError("a token is made by no merge")
        if len({d for d in self.bytes_of.values() if len(d) == 1}) < 256:
            raise ValueError("a byte has no token")
        self.special: dict[str, int] = {}
        for token in spec.get("added_tokens") or []:
            if token["lstrip"] or token["rstrip"] or token["single_word"] or token["normalized"]:
                raise ValueError("a special token with rules of its own")
            self.special[token["content"]] = token["id"]
            self.bytes_of[token["id"]] = token["content"].encode()
        found = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None
        # Longest token with the same last two bytes.
        self.reach: dict[bytes, int] = {}
        for data in self.id_of:
            end = data[-2:]
            self.reach[end] = max(len(data), self.reach.get(end, 1))
        self.follows: dict[tuple[int, int], bool] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.library = Tokenizer.from_file(path).pre_tokenizer

    def can_follow(self, a: int, b: int) -> bool:
        """Whether ``b`` after ``a`` stays two tokens.

        Merges are taken back, the later one first: at each step the border lies
        between a right end of ``a`` and a left end of ``b``. Had these two been
        joined before the next merge of either, ``a`` and ``b`` would not exist.
        Of equal merges the left one is done first.
        """
        known = self.follows.get((a, b))
        if known is not None:
            return known
        never = len(self.rank) + 1
        left, right, left_until, right_until = a, b, never, never
        out = True
        while True:
            joined = self.merged.get((left, right), never)
            if joined < left_until and joined <= right_until and joined != never:
                out = False
                break
            if self.rank[left] > self.rank[right]:
                left_until, left = self.rank[left], self.parts[left][1]
            elif self.rank[right] >= 0:
                right_until, right = self.rank[right], self.parts[right][0]
            else:
                break
        if len(self.follows) > 2_000_000:
            self.follows.clear()
        self.follows[a, b] = out
        return out

    def walk(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of sorted distinct words: a depth-first walk of their trie."""
        id_of, reach, can_follow, length = self.id_of, self.reach, self.can_follow, {i: len(d) for i, d in self.bytes_of.items()}
        last = [-1]  # last token of each prefix on the path from the root
        before = b""
        for word in words:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                first = end - reach.get(word[max(end - 2, 0) : end], 1)
                for start in range(first if first > 0 else 0, end):
                    token = id_of.get(word[start:end])
                    if token is not None and (not start or can_follow(last[start], token)):
                        break
                last.append(token)
            before = word
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= length[last[end]]
            ids.reverse()
            yield ids

    def learn(self, words: set[str]) -> None:
        """Keep the ids of the words, 4 bytes each."""
        missing = words.difference(self.new)
        if len(self.new) + len(missing) > CACHED_WORDS:
            self.old, self.new = self.new, {}
            missing = words
        if self.old:
            known = self.old.keys() & missing
            self.new.update((w, self.old[w]) for w in known)
            missing = missing - known
        ordered = sorted((w.encode(), w) for w in missing)
        for (_, word), ids in zip(ordered, self.walk(w for w, _ in ordered)):
            self.new[word] = np.array(ids, "<u4").tobytes()

    def words(self, text: str) -> list[str]:
        """Words of a text without special strings, which joined give the text."""
        if SETTLED.fullmatch(text):
            return SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def segments(self, text: str) -> list[list[str] | int]:
        """Lists of words and ids of special tokens in between."""
        if self.cut is None or not self.cut.search(text):
            return [self.words(text)]
        return [self.special[s] if s in self.special else self.words(s) for s in self.cut.split(text) if s]


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def token_bytes(rows: Iterable[bytes], path: str) -> Iterator[bytes]:
    """Ids of each text as little-endian 32-bit numbers."""
    claim("bpe", vocabulary.cache_clear)
    known = vocabulary(path)

    def flush(held: list[list[list[str] | int]]) -> Iterator[bytes]:
        known.learn({w for text in held for part in text if not isinstance(part, int) for w in part})
        for text in held:
            yield b"".join(
                part.to_bytes(4, "little") if isinstance(part, int) else b"".join(map(known.new.__getitem__, part)) for part in text
            )

    held, size = [], 0
    for data in rows:
        held.append(known.segments(data.decode("utf-8", "replace")))
        size += len(data)
        if size >= TOGETHER:
            yield from flush(held)
            held, size = [], 0
    yield from flush(held)


def encode(table: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the ids of each whole text, packed as little-endian 32-bit numbers in ``ids``."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(token_bytes(texts(batch), path), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])

    schema = T.StructType([T.StructField("key", table.schema[key].dataType), T.StructField("ids", T.BinaryType())])
    rows = table.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the text of its packed ids; bytes that are no text become replacement characters."""
    path = path or vocabulary_path()
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", vocabulary.cache_clear)
        bytes_of = vocabulary(path).bytes_of
        for batch in batches:
            out = []
            for packed in batch.column(at).to_pylist():
                numbers = np.frombuffer(packed or b"", "<u4").tolist()
                out.append(b"".join(map(bytes_of.__getitem__, numbers)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, text])

    schema = T.StructType([*encoded.schema.fields, T.StructField(text, T.StringType())])
    return encoded.mapInArrow(run, schema)
