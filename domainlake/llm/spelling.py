"""Spelling variants of the corpus' words, joined on asymmetric q-chunks.

Of two words that may be one edit apart, the longer one (of equal lengths the smaller one) gives two
disjoint chunks of half its length, its head and its tail; the other gives all its grams of that length
with their positions. One edit leaves one of the chunks whole and shifts it by one place at most, so an
equality join on chunk and gram within that shift finds every pair, and the edit distance verifies it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domainlake.session import written

RUN = "[A-Za-zÀ-ÿ]+"


def spelled(doc_id: Column, run: Column, every: int) -> Column:
    """The run, without one code point where its checksum with the document's id is divisible by `every`."""
    place = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run)
    checksum = F.crc32(place.cast("binary"))
    at = (checksum % F.char_length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(checksum % every == 0, without).otherwise(run)


def word_counts(docs: DataFrame, shortest: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """(word, n): how often each word of at least `shortest` code points occurs, if `least` times or more."""
    lowered = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    # Shorter runs can't become words; they go before anything is computed of them.
    words = runs.where(F.char_length("run") >= shortest).select(spelled(F.col("doc_id"), F.col("run"), every).alias("word"))
    counted = words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every pair of `words(word, n)` that one edit turns into each other, once.

    Keys carry the length of the longer word and which chunk it is, so that only grams within one place
    of the chunk's own position meet it. Adaptive execution splits chunks that many words share.
    """
    size = F.col("size")
    half = F.floor(size / 2).cast("int")
    chunks = (
        words.withColumn("size", F.char_length("word"))
        .withColumn("start", F.explode(F.array(F.lit(0), size - half)))
        .select(
            "size",
            (F.col("start") > 0).alias("tail"),
            F.substring("word", F.col("start") + 1, half).alias("gram"),
            F.col("word").alias("a"),
            F.col("n").alias("n_a"),
        )
    )
    own = F.char_length("word")
    grams = (
        words.withColumn("size", F.explode(F.array(own, own + 1)))
        .withColumn("position", F.explode(F.sequence(F.lit(0), own - half)))
        .withColumn("tail", F.explode(F.array(F.lit(False), F.lit(True))))
        .where(F.abs(F.col("position") - F.when(F.col("tail"), size - half).otherwise(0)) <= 1)
        .select(
            "size",
            "tail",
            F.substring("word", F.col("position") + 1, half).alias("gram"),
            F.col("word").alias("b"),
            F.col("n").alias("n_b"),
        )
    )
    met = chunks.hint("merge").join(grams, ["size", "tail", "gram"])
    first = (F.col("size") > F.char_length("b")) | (F.col("a") < F.col("b"))
    return (
        met.where(first & (F.levenshtein("a", "b", 1) == 1))
        .select("a", "n_a", "b", "n_b")
        .distinct()
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of `forms(word, form)`: the last word that following forms leads to.

    Forms grow in number at each step, so there is no cycle; each round doubles the length of the paths
    followed and writes its result.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(
            now.join(further, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "roots",
        )
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(docs: DataFrame, shortest: int = 6, least: int = 5, every: int = 199, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of `docs(doc_id, text)`.

    Words are maximal runs of letters, A-Z in lower case; where the checksum of document and run is
    divisible by `every` one letter is left out. Words of fewer than `shortest` code points or `least`
    occurrences are left out. n_near counts the words one inserted, deleted or replaced code point away;
    form is the most frequent of them (ties: the smallest) if it occurs `times` as often as the word, else
    null; root is the last form of forms, the word itself without one. A null or empty text has no words;
    a null doc_id counts as an empty one; rows with equal doc_id count each. An empty table gives an empty
    table; other columns are ignored.
    """
    words = written(word_counts(docs.select("doc_id", "text"), shortest, least, every), "words")
    pairs = written(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    has_form = -F.col("best.col1") >= times * F.col("n")
    found = written(
        words.join(best.hint("merge"), "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(has_form, F.col("best.near")).alias("form"),
            F.when(has_form, -F.col("best.col1")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(found.where("form is not null"))
    return found.join(ends.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))
