"""Spelling variants: near words found by walking a trie, and the frequent word that each belongs to.

The trie is a table of edges (node, letter): a node is a prefix of a word. States (word, position, node, edits) start
at the root, one per word, and are joined with the edges of one depth at a time. A state without an edit follows its letter,
every greater letter (a replaced code point) and may skip one of its own letters (an inserted one); a state with one edit
follows its letter only. So each pair is found once: from the word with the smaller letter, or from the longer one. A state
without an edit ends where no other word shares its prefix. A state with one edit whose letters are used up
on a node that is a word has found a near word.

Edges of the first ``SHORT`` depths are bounded by the alphabet and are broadcast; below, states and edges meet by node.
Words longer than ``LONG`` code points, for which there would be as many levels, meet by the hashes of what is left when
one of their code points is taken out; these pairs are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

RUN = "[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = 26 + 64
SHORT = 2  # depths 0 and 1: at most LETTERS + LETTERS ** 2 edges
LONG = 40


def left_out(word: Column, at: Column) -> Column:
    """``word`` without its code point ``at`` (from 0)."""
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))


def letter(word: Column, at: Column) -> Column:
    return F.substr(word, at + 1, F.lit(1))


def occurring_words(docs: DataFrame, min_chars: int, min_count: int, every: int | None) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of ``min_chars`` code points and ``min_count`` occurrences.

    With ``every``, occurrences whose crc32 of ``<doc_id>:<run>`` it divides lose the code point at crc32 % length.
    """
    runs = F.filter(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)), lambda x: F.length(x) >= min_chars)
    words = docs.select("doc_id", F.explode(runs).alias("word")).withColumn("word", F.translate("word", CAPITALS, SMALL))
    if every:
        word = F.col("word")
        h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), word))
        short = left_out(word, (h % F.length(word)).cast("int"))
        words = words.withColumn("word", F.when(h % every == 0, short).otherwise(word)).where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def trie_edges(words: DataFrame) -> DataFrame:
    """(depth, node, letter, is_word, below): the edges of all words; ``below`` counts the words under the edge."""
    depth = F.explode(F.sequence(F.lit(0), F.length("word") - 1))
    steps = words.select("word", depth.alias("depth"))
    word, at = F.col("word"), F.col("depth")
    steps = steps.select("depth", F.substr(word, F.lit(1), at).alias("node"), letter(word, at).alias("letter"),
                         (F.length(word) == at + 1).alias("is_word"))
    return steps.groupBy("depth", "node", "letter").agg(
        F.max("is_word").alias("is_word"), F.count("*").alias("below"))


def next_level(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States one edge further down; ``states`` are all those whose node has the depth of ``edges``."""
    skipped = states.where("edits = 0").withColumns({"position": F.col("position") + 1, "edits": F.lit(1)})
    states = states.unionByName(skipped).where(F.col("position") < F.length("word"))
    own = letter(F.col("word"), F.col("position"))
    met = states.drop("is_word").join(edges, "node").where(
        (F.col("letter") == own) | ((F.col("edits") == 0) & (F.col("letter") > own)))
    edits = F.when(F.col("letter") == own, F.col("edits")).otherwise(1)
    met = met.select("word", (F.col("position") + 1).alias("position"), F.concat("node", "letter").alias("node"),
                     edits.alias("edits"), "is_word", "below")
    return met.where("edits = 1 OR below > 1").drop("below")


def ended(states: DataFrame) -> DataFrame:
    """Pairs (word, near) of this level: all letters used with one edit, the last one perhaps skipped, on a word."""
    used = F.length("word") - F.col("position") == 1 - F.col("edits")
    return states.where("is_word").where(used).select("word", F.col("node").alias("near"))


def near_by_trie(words: DataFrame, long: int = LONG) -> DataFrame:
    """Pairs (word, near) at one edit, each once, among words of up to ``long`` code points."""
    words = words.select("word").where(F.length("word") <= long)
    edges = materialize(trie_edges(words), "edges")
    states = words.select("word", F.lit(0).alias("position"), F.lit("").alias("node"), F.lit(0).alias("edits"),
                          F.lit(False).alias("is_word"))
    found, depth = [], 0
    for depth in range(long):
        here = edges.where(F.col("depth") == depth).drop("depth")
        states = next_level(states, F.broadcast(here) if depth < SHORT else here)
        if depth + 1 < SHORT:
            continue  # a pair needs longer words than that
        states = materialize(states, "frontier")
        found.append(ended(states))
        if states.isEmpty():
            break
    pairs = found[0]
    for part in found[1:]:
        pairs = pairs.unionByName(part)
    return pairs.distinct()


def near_by_rest(words: DataFrame, least: int = LONG) -> DataFrame:
    """Pairs (word, near) at one edit, each once, among words of at least ``least`` code points."""
    words = words.select("word").where(F.length("word") >= least)
    rests = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("at"))
    rests = materialize(rests.withColumn("rest", F.xxhash64(left_out(F.col("word"), F.col("at")))), "rests")
    own = words.select(F.col("word").alias("near"), F.xxhash64("word").alias("rest"))
    shorter = rests.join(own, "rest").where(left_out(F.col("word"), F.col("at")) == F.col("near"))
    other = rests.withColumnRenamed("word", "near")
    replaced = rests.join(other, ["at", "rest"]).where(
        (F.col("word") < F.col("near")) & (left_out(F.col("word"), F.col("at")) == left_out(F.col("near"), F.col("at"))))
    return shorter.select("word", "near").unionByName(replaced.select("word", "near")).distinct()


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): from every word, forms up to the last. Each round doubles the way."""
    up = forms.select("word", F.col("form").alias("root"))
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = materialize(up.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if up.where("moved").isEmpty():
            return up.drop("moved")
        up = up.drop("moved")


def variants(docs: DataFrame, min_chars: int = 6, min_count: int = 5, ratio: int = 5, every: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs`` (doc_id, text).

    Words are maximal runs of Latin letters (A-Z lower-cased) of at least ``min_chars`` code points that occur ``min_count``
    times. Two are near if one inserted, deleted or replaced code point makes them equal. ``form`` is the near word with
    the greatest n (ties: smallest by code points), if that is at least ``ratio`` times the word's, else null; ``root`` is where forms lead
    to, the word itself if it has none. ``every`` damages some occurrences, see ``occurring_words``; those without a
    doc_id stay as they are. Null and empty texts have no words; long texts and runs are read whole;
    rows that repeat count each time. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    words = materialize(occurring_words(docs, min_chars, min_count, every), "words")
    pairs = materialize(near_by_trie(words).unionByName(near_by_rest(words)).distinct(), "pairs")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))
    sized = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = sized.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    known = words.join(best, "word", "left")
    enough = -F.col("best.rank") >= ratio * F.col("n")
    known = materialize(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.rank")).alias("form_n")), "forms")
    roots = follow(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
