"""Searching issues on file for the words of an error pattern, one after the other.

A positional index holds every word worth searching for of titles and bodies. A
phrase is looked up by the word of it that fewest places hold; each such place
says where the phrase would begin, and the other words have to be at their
distance from there. Issues with the same pattern share one phrase, so their
matches are found, and returned, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failtriage.functions.similarity import clean_words
from failtriage.rules import MIN_TERM_CHARS
from failtriage.session import materialize


def _words(text: str) -> Column:
    return F.transform(clean_words(F.col(text)), F.lower)


def issue_phrases(new: DataFrame) -> DataFrame:
    """``repo, number, phrase`` of the issues whose first error pattern has something to search for."""
    phrase = F.array_join(_words("first_pattern"), " ")
    return new.select("repo", "number", phrase.alias("phrase")).where(F.length("phrase") > MIN_TERM_CHARS)


def positions(existing: DataFrame) -> DataFrame:
    """The positional index: ``repo, candidate, field, place, word``; title and body are fields of their own."""
    fields = F.array(
        *[F.struct(F.lit(name).alias("field"), _words(name).alias("words")) for name in ("title", "body")]
    )
    rows = existing.select("repo", F.col("number").alias("candidate"), F.inline(fields))
    return rows.select("repo", "candidate", "field", F.posexplode("words").alias("place", "word"))


def phrase_matches(phrases: DataFrame, existing: DataFrame) -> DataFrame:
    """``repo, phrase, candidate``: the issues on file that hold a phrase, for each distinct ``repo, phrase``."""
    place = ["repo", "candidate", "field"]
    split = F.split("phrase", " ")
    wanted = phrases.select("repo", "phrase").distinct().withColumn("n_words", F.size(split))
    words = materialize(wanted.select("repo", "phrase", "n_words", F.posexplode(split).alias("offset", "word")), "phrase-words")
    index = materialize(positions(existing).join(words.select("repo", "word").distinct(), ["repo", "word"], "left_semi"), "positions")
    holders = materialize(index.groupBy("repo", "word").agg(F.count("*").alias("holders")), "word-holders")
    # A phrase with a word that is nowhere on file has no match.
    rarest = words.join(holders, ["repo", "word"]).groupBy("repo", "phrase", "n_words").agg(
        F.count("*").alias("known"), F.min(F.struct("holders", "offset", "word")).alias("rarest")
    ).where("known = n_words")
    rarest = materialize(
        rarest.select("repo", "phrase", "n_words", F.col("rarest.offset").alias("anchor"), F.col("rarest.word").alias("word")), "rarest-words"
    )
    begun = materialize(
        rarest.join(index, ["repo", "word"]).withColumn("start", F.col("place") - F.col("anchor"))
        .where("start >= 0").select(*place, "phrase", "n_words", "anchor", "start"),
        "phrase-starts",
    )
    rest = begun.join(words.drop("n_words"), ["repo", "phrase"]).where("offset != anchor")
    met = rest.withColumn("place", F.col("start") + F.col("offset")).join(index, [*place, "place", "word"])
    found = begun.select(*place, "phrase", "n_words", "start").unionByName(met.select(*place, "phrase", "n_words", "start"))
    whole = found.groupBy(*place, "phrase", "n_words", "start").agg(F.count("*").alias("met")).where("met = n_words")
    return whole.select("repo", "phrase", "candidate").distinct()
