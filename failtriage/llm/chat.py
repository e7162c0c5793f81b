"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a text. Each prefix of a conversation
is rendered, and two consecutive outputs are compared: what the longer one adds
is the span of its last turn. If the longer one does not begin with the shorter
one, the template has rewritten history from their first difference on; the
conversation is marked, and turns whose span reaches beyond that point lose it.
Where a turn's text stands in its span is found with a stand-in text, and the
text itself, escaped by the template, must stand between what surrounds the
stand-in. Text of assistant turns is under the loss mask.

Defined results: null texts and roles count as empty; turns are ordered by turn
(null first), then role and text, repeated ones all count; a row without conv_id
is a conversation of its own without id; an empty table gives no row. Turns come
to a worker sorted, one after the other, and are never gathered in a row; a
conversation is one output text and so has to fit into one, and rendering all
prefixes takes time with the square of its turns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Control strings of the template below.
BEGIN, ROLE_END, END = "[INST ", "]", "[/INST]"
CONTROL = ("<s>", "</s>", "[INST", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("|".join(f"{re.escape(c[0])}(?=\\\\*{re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile("|".join(f"{re.escape(c[0])}\\\\(?=\\\\*{re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    """A backslash goes after the first character of a control string, also where there are backslashes already."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0], text)


def inst_template(turns: list[Turn]) -> str:
    """``<s>`` and for each turn ``[INST role] text [/INST]``, assistant turns end with ``</s>`` instead."""
    out = ["<s>"]
    for role, text in turns:
        name = escape(role).replace("&", "&amp;").replace("]", "&#93;")
        out.append(f"{BEGIN}{name}{ROLE_END} {escape(text)} {'</s>' if role == 'assistant' else END}")
    return "".join(out)


_TURN = re.compile(r"\[INST ([^\]]*)\] (.*?) (?:</s>|\[/INST\])", re.DOTALL)


def read_back(text: str) -> list[Turn]:
    """The turns of a text made by ``inst_template``."""
    out = []
    for m in _TURN.finditer(text):
        role = unescape(m[1].replace("&#93;", "]").replace("&amp;", "&"))
        out.append((role, unescape(m[2])))
    return out


@dataclass
class Rendered:
    """A formatted conversation: spans of turns and of their texts in it, None where history was rewritten."""

    text: str
    turns: list[tuple[int, int] | None]
    texts: list[tuple[int, int] | None]
    rewritten_from: int | None


def _common(a: str, b: str) -> int:
    """Length of the common start of two texts, by bisection."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


#: Stand-ins for a text; two, so that what they have in common with the template does not mislead.
STAND_INS = ("\ue000\ue001", "\ue002\ue003")


def _surroundings(template: Template, before: list[Turn], role: str) -> tuple[str, str] | None:
    """What the template puts at the start of the output up to the text of a next turn, and after it."""
    found = []
    for stand in STAND_INS:
        head, middle, tail = template([*before, (role, stand)]).rpartition(stand)
        if not middle:
            return None
        found.append((head, tail))
    return found[0] if found[0] == found[1] else None


def render(turns: list[Turn], template: Template, loss_role: str = "assistant") -> Rendered:
    """Render prefix after prefix and locate every turn."""
    last = template([])
    spans: list[tuple[int, int] | None] = []
    inner: list[tuple[int, int] | None] = []
    rewritten: int | None = None
    for i, (role, _) in enumerate(turns):
        now = template(turns[: i + 1])
        start = len(last)
        if not now.startswith(last):
            start = _common(last, now)
            rewritten = start if rewritten is None else min(rewritten, start)
            for k, span in enumerate(spans):
                if span and span[1] > start:
                    spans[k] = inner[k] = None
        spans.append((start, len(now)))
        own = None
        if role == loss_role and (around := _surroundings(template, turns[:i], role)):
            head, tail = around
            if now.startswith(head) and now.endswith(tail) and len(head) + len(tail) <= len(now):
                own = (len(head), len(now) - len(tail))
        inner.append(own)
        last = now
    return Rendered(last, spans, inner, rewritten)


SPAN = "array<struct<start:int,end:int>>"
FORMATTED = f"conv_id long, formatted string, turns {SPAN}, loss {SPAN}, rewritten_from int"


#: Characters of output that are sent back together.
TOGETHER = 4_000_000


def format_conversations(rows: DataFrame, template: Template = inst_template, loss_role: str = "assistant") -> DataFrame:
    """Rows FORMATTED, one for each conversation; ``loss`` has the text spans under the loss mask."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def listed(spans: list[tuple[int, int] | None]) -> list[dict | None]:
        return [None if s is None else {"start": s[0], "end": s[1]} for s in spans]

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
        """Neighbouring rows with one id; each row without an id."""
        now: int | None = None
        turns: list[Turn] = []
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if turns and (conv_id != now or conv_id is None):
                    yield now, turns
                    turns = []
                now = conv_id
                turns.append((role, text))
        if turns:
            yield now, turns

    def batch_of(out: list[tuple[int | None, Rendered]]) -> pa.RecordBatch:
        columns = [
            pa.array([i for i, _ in out], pa.int64()), pa.array([r.text for _, r in out], pa.string()),
            pa.array([listed(r.turns) for _, r in out], span), pa.array([listed([s for s in r.texts if s]) for _, r in out], span),
            pa.array([r.rewritten_from for _, r in out], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "formatted", "turns", "loss", "rewritten_from"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv_id, turns in conversations(batches):
            out.append((conv_id, render(turns, template, loss_role)))
            size += len(out[-1][1].text)
            if size >= TOGETHER:
                yield batch_of(out)
                out, size = [], 0
        if out:
            yield batch_of(out)

    order = ["turn", "role", "text"]
    plain = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # Rows without an id need not meet.
    placed = plain.repartition(F.coalesce("conv_id", F.xxhash64(*order))).sortWithinPartitions("conv_id", *order)
    return placed.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: DIGESTS. ``loss_chars`` counts the unescaped text."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts, losses = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("formatted", "loss"))
            for text, loss in zip(texts, losses):
                turns = read_back(text)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "replace")).hexdigest()
                masked = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                out.append((len(turns), whole, len(masked), hashlib.sha256(masked.encode("utf-8", "replace")).hexdigest(), len(text)))
            columns = list(zip(*out)) if out else [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], [p.split()[0] for p in DIGESTS.split(", ")]
            )

    return formatted.mapInArrow(run, DIGESTS)
