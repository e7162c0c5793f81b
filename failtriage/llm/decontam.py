"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units after a number and names inside a sentence become typed
placeholders. Windows of template tokens are hashed; within a window a
placeholder also carries where its value stands first, so windows only meet if
the same slots hold equal values. Documents meet benchmark templates on window
hashes. Windows on one diagonal (same shift between document and template) are
one instance of the question; a template slot must hold a single document value
there, else the diagonal counts for nothing.

A document counts by the item tokens that its windows cover: ``SHARE`` of them
with ``LITERALS`` literal ones, or ``RUN`` neighbouring ones on one diagonal.
Short items have narrower windows, so that one changed, added or dropped word
leaves enough of them; those count together only where they stand near each other.

Items with one template (re-parameterised questions) are one entry, named by the
smallest item_id, so families of questions do not multiply the hits.

A window that more than ``COMMON`` items share (the same opening words of many
questions) meets a document once, not once for each item. It counts for an item
in a document that also has a window which few items share; for documents
without such a window, items with the same common windows are judged together
and the least of those that count is reported. So the pairs do not multiply, and
a document is found by what it holds as before.

Beside a template window its tokens with values kept can be hashed too
(``literal``, as the queries do): then copies in other letter case are found, and
exact ones of items with too few literal tokens for a template.

Defined results: null and empty texts, and without ``literal`` items of fewer than
``LITERALS`` literal tokens, match nothing; items shorter than a window are matched whole;
rows that share a doc_id are one document; rows without doc_id are left out;
an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failtriage.llm.common import store

#: Items with fewer tokens are matched whole.
WINDOW = 8
#: Tokens of a window, by the least tokens of an item; the first that fits holds.
WIDTHS = ((15, 6), (9, 4), (8, 3))
#: Windows narrower than this count together only where they stand near each other.
WIDE = 6
#: Tokens of an item found in a document, or of an item matched whole, that must not be placeholders.
LITERALS = 5
#: Share of a template's tokens that makes a document contaminated.
SHARE = 0.5
#: Neighbouring tokens of a template that make a document contaminated, whatever their share.
RUN = 13
#: Items that may share a window before it counts as a common one.
COMMON = 16
#: Bytes of benchmark windows up to which they are sent to all tasks; beyond, both sides are shuffled.
SENT_BYTES = 32 << 20
#: Bytes that a window takes at least.
WINDOW_BYTES = 48
UNITS = (
    "mm cm m km mg g kg t ml l s ms min h kb mb gb tb w kw v a hz khz mhz ghz mph kmh"
    " inch inches feet foot miles mile yards pounds pound ounces dollars dollar euros euro cents percent"
    " seconds minutes hours days weeks months years degrees meters metres liters litres grams"
).split()
MARK, UNIT_MARK, NAME_MARK = "\ue000", "\ue001", "\ue002"
SLOT = (
    r"(?<![\p{L}\p{N}])([0-9]+)(?!\p{L})"
    r"|(?<=[0-9] ?)(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"
    r"|(?<=[\p{Ll},;] )(\p{Lu}\p{Ll}+)"
)


def tokens(text: Column) -> Column:
    """Lower-cased words without punctuation; a slot is the three marks with its value after its own."""
    clean = F.when(text.rlike(f"[{MARK}-{NAME_MARK}]"), F.regexp_replace(text, f"[{MARK}-{NAME_MARK}]", " ")).otherwise(text)
    marked = F.regexp_replace(clean, SLOT, f" {MARK}$1{UNIT_MARK}$2{NAME_MARK}$3 ")
    plain = F.regexp_replace(F.lower(marked), rf"[^\p{{L}}\p{{N}}{MARK}-{NAME_MARK}]+", " ")
    return F.filter(F.split(plain, " "), lambda x: x != "")


def _slot(token: Column) -> Column:
    return token.startswith(MARK)


def _kind(token: Column) -> Column:
    return (
        F.when(token.startswith(MARK + UNIT_MARK + NAME_MARK), F.lit(NAME_MARK))
        .when(token.startswith(MARK + UNIT_MARK), F.lit(UNIT_MARK))
        .otherwise(F.lit(MARK))
    )


def template(toks: Column) -> Column:
    """Tokens with each slot replaced by its type and the place of its value's first use."""
    return F.transform(toks, lambda x: F.when(_slot(x), F.concat(_kind(x), F.array_position(toks, x).cast("string"))).otherwise(x))


def _width(size: Column, whole: int) -> Column:
    """Tokens of a window of items with ``size`` tokens."""
    out = F.when(size < whole, size)
    for least, width in WIDTHS:
        out = out.when(size >= least, F.lit(width))
    return out.otherwise(size)


def _needed(width: Column) -> Column:
    """Tokens of a window that must not be placeholders: no more than an eight with five such tokens leaves to each."""
    return F.when(width < WIDE, F.lit(1)).otherwise(F.lit(3))


def _plain(token: Column) -> Column:
    return F.translate(token, MARK + UNIT_MARK + NAME_MARK, "")


def windows(toks: Column, width: Column, literal: bool = False) -> Column:
    """Structs (pos, hash, slots) of all token runs of ``width`` with enough literals.

    With ``literal`` also those of runs with slots, their values kept; these have null for slots.
    """
    starts = F.when(F.size(toks) >= width, F.sequence(F.lit(1), F.size(toks) - width + 1))
    none = F.lit(None).cast("array<string>")

    def window(at: Column, part: Column, slots: Column) -> Column:
        return F.struct((at - 1).alias("pos"), F.xxhash64(part).alias("hash"), slots.alias("slots"))

    def slotted(at: Column) -> Column:
        part = F.slice(toks, at, width)
        slots = F.filter(part, _slot)
        enough = width - F.size(slots) >= _needed(width)
        out = [F.when(enough, window(at, template(part), slots))]
        if literal:
            out.append(F.when(F.size(slots) > 0, window(at, F.transform(part, _plain), none)))
        return F.array(*out)

    def unslotted(at: Column) -> Column:
        return window(at, F.slice(toks, at, width), none)

    with_slots = F.filter(F.flatten(F.transform(starts, slotted)), lambda w: w.isNotNull())
    return F.when(F.exists(toks, _slot), with_slots).otherwise(F.transform(starts, unslotted))


def _exploded(rows: DataFrame, key: str, literal: bool = False) -> DataFrame:
    """Rows (key, width, pos, hash, slots) of a table with key, toks and width."""
    spread = rows.select(key, "width", F.explode(windows(F.col("toks"), F.col("width"), literal)).alias("w"))
    return spread.select(key, "width", "w.pos", "w.hash", "w.slots")


@dataclass
class Benchmark:
    """What the documents are held against.

    ``windows``: item_id, width, item_pos, hash, item_slots, common. ``items``: item_id, n_tokens, n_windows and
    slot_at, the places of its placeholders. ``leaders``: the item_ids that stand for all with the same common windows.
    """

    windows: DataFrame
    items: DataFrame
    leaders: DataFrame


def benchmark(items: DataFrame, width: int = WINDOW, literal: bool = False) -> Benchmark:
    """The distinct templates of a benchmark and their windows.

    With ``literal`` the windows with values kept are those of all items of a template.
    """
    rows = items.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long"), tokens(F.col("text")).alias("toks")
    )
    rows = rows.withColumn("_template", template(F.col("toks")))
    entries = rows.groupBy("_template").agg(F.min_by("toks", "item_id").alias("toks"), F.min("item_id").alias("item_id"))
    places = F.transform("toks", lambda x, i: F.when(_slot(x), i))
    entries = entries.select("_template", "item_id", "toks", F.size("toks").alias("n_tokens"), F.filter(places, lambda i: i.isNotNull()).alias("slot_at"))
    templates = F.col("n_tokens") - F.size("slot_at") >= LITERALS
    entries = entries.where(F.col("n_tokens") > 0 if literal else templates)
    entries = store(entries.withColumn("width", _width(F.col("n_tokens"), width)), "items")
    spread = _exploded(entries.where(templates | (F.size("slot_at") == 0)).select("item_id", "toks", "width"), "item_id")
    if literal:
        own = rows.where(F.exists("toks", _slot)).select("_template", "toks").join(entries.select("_template", "item_id", "width"), "_template")
        spread = spread.unionByName(_exploded(own.select("item_id", "toks", "width"), "item_id", True).where("slots is null").distinct())
    spread = store(spread.select("item_id", "width", F.col("pos").alias("item_pos"), "hash", F.col("slots").alias("item_slots")), "spread")
    shared = spread.groupBy("hash", "width").agg((F.count_distinct("item_id") > COMMON).alias("common"))
    windows = store(spread.join(shared, ["hash", "width"]), "benchmark")
    total = spread.groupBy("item_id").agg(F.count_distinct("item_pos").alias("n_windows"))
    about = store(entries.select("item_id", "n_tokens", "slot_at").join(total, "item_id"), "about")
    alike = windows.where("common").groupBy("item_id").agg(
        F.sha2(F.to_json(F.array_sort(F.collect_set(F.struct("width", "item_pos", "hash")))), 256).alias("alike")
    )
    # The shortest has the greatest share of its tokens covered; a run counts for those of some length only.
    ends = alike.join(about, "item_id").groupBy("alike").agg(
        F.min(F.struct("n_tokens", "item_id")).alias("short"), F.min(F.when(F.col("n_tokens") > 2 * RUN, F.col("item_id"))).alias("long")
    )
    leaders = ends.select(F.explode(F.array("short.item_id", "long")).alias("item_id")).where("item_id is not null").distinct()
    return Benchmark(windows, about, store(leaders, "leaders"))


def hits(docs: DataFrame, bench: Benchmark, literal: bool = False) -> DataFrame:
    """Rows of equal windows: doc_id, doc_pos, slots and item_id, width, item_pos, item_slots."""
    widths = sorted(r[0] for r in bench.windows.select("width").distinct().collect())
    # A common window is met once: what it is in the items that have it is added afterwards.
    rare = bench.windows.where("not common").drop("common")
    place = [F.lit(None).cast(t).alias(c) for c, t in rare.dtypes if c not in ("hash", "width")]
    common = bench.windows.where("common").select("hash", "width").distinct().select("hash", "width", *place)
    sent = rare.unionByName(common)
    taken = F.lit(WINDOW_BYTES) + F.coalesce(F.length(F.concat_ws("", "item_slots")), F.lit(0))
    if (sent.agg(F.sum(taken)).first()[0] or 0) <= SENT_BYTES:
        sent = F.broadcast(sent)
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), tokens(F.col("text")).alias("toks"))
    rows = rows.withColumn("width", F.explode(F.array(*map(F.lit, widths or [WINDOW]))))
    met = store(_exploded(rows, "doc_id", literal).withColumnRenamed("pos", "doc_pos").join(sent, ["hash", "width"]), "met")
    own = met.where("item_id is not null")
    shared = met.where("item_id is null").drop("item_id", "item_pos", "item_slots")
    of_items = bench.windows.where("common").drop("common")
    # Items of which the document has a window of their own, and those that stand for the rest.
    pairs = own.select("doc_id", "item_id").distinct().join(of_items, "item_id")
    by_pair = shared.join(pairs, ["doc_id", "hash", "width"])
    by_leader = shared.join(of_items.join(bench.leaders, "item_id", "left_semi"), ["hash", "width"])
    return own.unionByName(by_pair).unionByName(by_leader)


def _longest(places: Column, width: Column) -> Column:
    """Most neighbouring tokens that windows at sorted ``places`` cover."""

    def step(acc: Column, at: Column) -> Column:
        start = F.when(at > acc["end"], at).otherwise(acc["start"])
        return F.struct(start.alias("start"), (at + width).alias("end"), F.greatest(acc["most"], at + width - start).alias("most"))

    none = F.struct(F.lit(0).alias("start"), F.lit(-1).alias("end"), F.lit(0).alias("most"))
    return F.aggregate(places, none, step, lambda acc: acc["most"])


def contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW, share: float = SHARE, literal: bool = False) -> DataFrame:
    """Rows (doc_id, item_id, n_found, n_windows, share, n_slots, first_word) of contaminated documents.

    ``n_found`` counts the template's windows seen in consistent diagonals,
    ``share`` is that of its tokens that they cover and ``n_slots`` the slots
    checked; ``first_word`` is where the first of the windows is.
    With ``literal`` copies in any case, and those of items with few or no literal
    tokens, are found as well.
    """
    bench = benchmark(items, width, literal)
    found = store(hits(docs, bench, literal).withColumn("diagonal", F.col("doc_pos") - F.col("item_pos")), "hits")
    line = ["doc_id", "item_id", "diagonal"]
    values = found.where(F.size("slots") > 0).select(*line, F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).distinct()
    values = values.groupBy(*line, "s.item_slots").agg(F.count("*").alias("n"))
    values = values.groupBy(*line).agg(F.count("*").alias("n_slots"), F.max("n").alias("_most"))
    checked = found.join(values, line, "left").where("coalesce(_most, 1) = 1")
    lines = checked.groupBy(*line).agg(
        F.array_sort(F.collect_set("item_pos")).alias("places"),
        F.array_sort(F.collect_set(F.when(F.col("slots").isNull(), F.col("item_pos")))).alias("kept"),
        F.max("width").alias("width"), F.max("n_slots").alias("n_slots"), F.min("doc_pos").alias("first_word"),
    )
    lines = lines.join(bench.items.select("item_id", "n_tokens", "n_windows"), "item_id")
    lines = store(lines.withColumn("run", _longest(F.col("places"), F.col("width"))), "lines")
    stretch = F.col("diagonal") / (2 * F.col("n_tokens"))
    near = F.array(2 * F.floor(stretch), 2 * F.floor(stretch + 0.5) + 1)
    near = F.when(F.col("width") < WIDE, near).otherwise(F.array(F.lit(0).cast("long")))
    pair = ["doc_id", "item_id"]
    placed = lines.select(*pair, "width", "n_tokens", F.explode(near).alias("near"), "places", "kept")
    placed = placed.withColumn("at", F.explode("places")).withColumn("kept", F.array_contains("kept", F.col("at"))).drop("places").distinct()
    covered = placed.select(*pair, "near", "n_tokens", "kept", F.explode(F.sequence("at", F.col("at") + F.col("width") - 1)).alias("token"))
    covered = covered.groupBy(*pair, "near", "token").agg(F.max("n_tokens").alias("n_tokens"), F.max("kept").alias("kept"))
    slots = bench.items.select("item_id", F.explode("slot_at").alias("token"), F.lit(True).alias("slot"))
    covered = covered.join(slots, ["item_id", "token"], "left").groupBy(*pair, "near").agg(
        F.max("n_tokens").alias("n_tokens"), (F.count("*") / F.max("n_tokens")).alias("share"),
        F.count_if(F.col("kept") | F.col("slot").isNull()).alias("literals"),
    )
    enough = F.max((F.col("share") >= share) & (F.col("literals") >= F.least(F.lit(LITERALS), "n_tokens"))).alias("enough")
    covered = covered.groupBy(*pair).agg(F.max("share").alias("share"), enough)
    seen = lines.groupBy(*pair).agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_found"),
        F.max("n_windows").alias("n_windows"),
        F.coalesce(F.max("n_slots"), F.lit(0)).cast("long").alias("n_slots"),
        F.min("first_word").cast("long").alias("first_word"),
        F.max(F.when(F.col("n_tokens") > 2 * RUN, F.col("run"))).alias("run"),
    )
    seen = seen.join(covered, pair).where(F.col("enough") | F.coalesce(F.col("run") >= RUN, F.lit(False)))
    return seen.select("doc_id", "item_id", "n_found", "n_windows", "share", "n_slots", "first_word")


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """Documents of ``docs`` that are not in ``bad``; rows without doc_id stay."""
    return docs.join(bad.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
