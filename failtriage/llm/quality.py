"""Quality rules: statistics of a text and a learned decision list, in DataFrame functions only.

Labelled documents are counted in cells of binned features. The number of cells
is bounded by the number of bins to the power of the features, whatever the
number of documents, and only these counts come to the driver. Sequential
covering then grows a conjunction of thresholds on one part of the labelled
documents that pass the base rule, condition by condition with the best information gain, prunes it on
the other part from its end, keeps it if it is precise there, takes what it
covers out, and goes on. The list becomes one ordered conditional expression.

Defined results: a null or empty text has zero statistics and fails the base
rule; labels that are null are left out, a document labelled both ways counts
once for each; without labels the list is empty and the base rule decides;
repeated rows are judged alike; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failtriage.llm.common import WORD, store, text_words

#: Base rule: fewest words, and the greatest share in percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW = 3
#: Where features are cut, as shares of the labelled documents.
CUTS = (0.02, 0.05, 0.1, 0.3, 0.7, 0.9, 0.95, 0.98)
MOST_RULES, MOST_CONDITIONS = 12, 4
#: What a pruned rule must reach on the part it was not grown on.
PRECISION, LEAST_COVERED = 0.9, 5


def statistics(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        text_words(F.col("text")).alias("words"),
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        lines.alias("lines"),
    )
    n = F.size("words")
    hashes = F.transform(
        F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))), lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW)))
    )
    kept = ["doc_id", "word_chars", "n_symbols", "n_upper"]
    rows = rows.select(
        *kept,
        n.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("h"),
    )
    kept += ["n_words", "n_dup_lines"]
    # Windows with their places, by hash: equal ones are neighbours. Most texts have none and are not sorted.
    placed = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.select(*kept, F.when(F.size(F.array_distinct("h")) < F.size("h"), placed).alias("s"))
    size = F.size("s")
    again = F.zip_with(F.slice("s", 1, size - 1), F.slice("s", 2, size - 1), lambda a, b: a["x"] == b["x"])
    rows = rows.select(*kept, F.col("s.i").alias("i"), F.when(F.col("s").isNotNull(), again).alias("again"))
    no = F.array(F.lit(False))
    repeated = F.zip_with(F.concat("again", no), F.concat(no, "again"), lambda a, b: a | b)
    starts = F.filter(F.zip_with("i", repeated, lambda i, r: F.when(r, i)), lambda i: i.isNotNull())
    rows = rows.select(*kept, F.sort_array(starts).alias("p"))
    size = F.size("p")
    steps = F.zip_with(F.slice("p", 1, size - 1), F.slice("p", 2, size - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(size > 0, F.aggregate(steps, F.lit(WINDOW), lambda total, x: total + x)).otherwise(0)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_upper"
    )


def _per(part: str, whole: str, scale: int) -> Column:
    return F.when(F.col(whole) > 0, F.floor(F.col(part) * scale / F.col(whole))).otherwise(0).cast("long")


#: What rules are made of: whole numbers, so thresholds are exact.
FEATURES: dict[str, Column | str] = {
    "words": "n_words",
    "chars_per_100_words": ("word_chars", "n_words", 100),
    "symbols_per_1000_chars": ("n_symbols", "word_chars", 1000),
    "dup_lines_per_1000_words": ("n_dup_lines", "n_words", 1000),
    "repeats_per_1000_words": ("n_repeat_words", "n_words", 1000),
    "upper_per_1000_chars": ("n_upper", "word_chars", 1000),
}


def feature(name: str) -> Column:
    made = FEATURES[name]
    return F.col(made) if isinstance(made, str) else _per(*made)


@dataclass(frozen=True)
class Condition:
    """``feature > cut`` if ``above``, else ``feature <= cut``."""

    feature: str
    cut: int
    above: bool

    def column(self) -> Column:
        return feature(self.feature) > self.cut if self.above else feature(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut}"


Rule = tuple[Condition, ...]
#: A cell: bin of each feature, whether it is of the growing part, bad and good documents.
Cell = tuple[tuple[int, ...], bool, int, int]


def cells(stats: DataFrame, labels: DataFrame, good: str = "quality") -> tuple[list[list[int]], list[Cell]]:
    """Cuts of each feature, and the labelled documents counted by cell."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(good).isNotNull())
    known = known.select(F.col("doc_id").cast("long"), (F.col(good) == 0).alias("bad")).distinct()
    rows = stats.select("doc_id", *[feature(f).alias(f) for f in FEATURES]).join(known, "doc_id")
    found = rows.agg(*[F.percentile_approx(f, list(CUTS), 1000).alias(f) for f in FEATURES]).first()
    cuts = [sorted(set(found[f] or [])) for f in FEATURES]
    bins = [sum((F.col(f) > c).cast("int") for c in cut) if cut else F.lit(0) for f, cut in zip(FEATURES, cuts)]
    counted = rows.select(
        F.array(*bins).alias("bins"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"), "bad"
    )
    counted = counted.groupBy("bins", "grow").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g"))
    return cuts, sorted((tuple(r["bins"]), r["grow"], r["b"], r["g"]) for r in counted.collect())


def _holds(bins: tuple[int, ...], test: tuple[int, int, bool]) -> bool:
    """A test is (feature, cut number, above): bins above number k lie above cut k."""
    at, cut, above = test
    return (bins[at] > cut) == above


def _grown(rows: list[Cell], n_cuts: list[int]) -> list[tuple[int, int, bool]]:
    """Conditions added by greatest information gain (bad documents kept times bits gained)."""
    rule: list[tuple[int, int, bool]] = []
    while len(rule) < MOST_CONDITIONS:
        bad, good = sum(r[2] for r in rows), sum(r[3] for r in rows)
        if not bad or not good:
            break
        before, best = math.log2(bad / (bad + good)), (0.0, None)
        for at, n in enumerate(n_cuts):
            per: dict[int, list[int]] = defaultdict(lambda: [0, 0])
            for bins, _, b, g in rows:
                per[bins[at]][0] += b
                per[bins[at]][1] += g
            low_b = low_g = 0
            for cut in range(n):
                low_b += per[cut][0] if cut in per else 0
                low_g += per[cut][1] if cut in per else 0
                for above, b, g in ((False, low_b, low_g), (True, bad - low_b, good - low_g)):
                    gain = b * (math.log2(b / (b + g)) - before) if b else 0.0
                    if gain > best[0] + 1e-9:
                        best = (gain, (at, cut, above))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if _holds(r[0], best[1])]
    return rule


def _covered(rows: list[Cell], rule: list[tuple[int, int, bool]]) -> tuple[int, int]:
    some = [r for r in rows if all(_holds(r[0], t) for t in rule)]
    return sum(r[2] for r in some), sum(r[3] for r in some)


def cover(cuts: list[list[int]], rows: list[Cell]) -> list[Rule]:
    """Rules for bad documents, in order."""
    names, out = list(FEATURES), []
    while len(out) < MOST_RULES:
        grow, check = [r for r in rows if r[1]], [r for r in rows if not r[1]]
        rule = _grown(grow, [len(c) for c in cuts])
        if not rule:
            break

        def worth(k: int) -> tuple[float, int]:
            b, g = _covered(check, rule[:k])
            return ((b - g) / (b + g) if b + g else -1.0, -k)

        rule = rule[: max(range(1, len(rule) + 1), key=worth)]
        bad, good = _covered(check, rule)
        if bad < LEAST_COVERED or bad / (bad + good) < PRECISION:
            break
        out.append(tuple(Condition(names[at], cuts[at][cut], above) for at, cut, above in rule))
        rows = [r for r in rows if not all(_holds(r[0], t) for t in rule)]
    return out


def verdict(rules: list[Rule]) -> Column:
    """Whether the list keeps a document: the first rule that holds rejects it."""
    out = F.lit(True)
    for rule in reversed(rules):
        holds = F.lit(True)
        for condition in rule:
            holds = holds & condition.column()
        out = F.when(holds, F.lit(False)).otherwise(out)
    return out


def fired(rules: list[Rule]) -> Column:
    """The rule that rejects a document, as text; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        holds = F.lit(True)
        for condition in rule:
            holds = holds & condition.column()
        out = F.when(holds, F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every document, base_failed, kept and the rule that rejected it."""
    stats = store(statistics(docs), "statistics")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rules = cover(*cells(stats.where(~failed), labels))
    return stats.select(
        "*", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"), fired(rules).alias("rule")
    )
