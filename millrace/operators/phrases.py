"""Names of several words, learned from the texts, and edges between names that meet more often than chance lets them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import few, written

#: Words of a run and of a phrase at most; places of words that make a passage.
RUN, LONGEST, PASSAGE = 8, 4, 20
#: Occurrences that a name needs, passages that an edge needs, and its strength (0.1% of chance pairs reach it).
SUPPORT, MET, STRENGTH = 3, 3, 10.83
_NAME = r"\p{Lu}\p{Ll}++(?!\p{L})"
#: A run of names with single spaces between them, or another word. Possessive repeats: time and stack stay small on long texts.
_TOKEN = rf"{_NAME}(?: {_NAME}){{0,{RUN - 1}}}+|\p{{L}}++"
_LOWER = r"^\p{Ll}+$"


def runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """row, passage, run: runs of up to RUN names (a capital and small letters) that only single spaces part; a longer
    one goes on in the next run. row numbers the rows of docs, passage the PASSAGE places of runs and other words they
    lie in. Null texts have none. The table is written, so that rows stay numbered as they are."""
    tokens = F.posexplode(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))).alias("at", "run")
    all_ = docs.select(F.monotonically_increasing_id().alias("row"), text).select("row", tokens).filter(F.col("run").rlike(r"^\p{Lu}\p{Ll}+( |$)"))
    return written(all_.select("row", F.floor(F.col("at") / PASSAGE).alias("passage"), "run"), "runs")


def lower_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, lower: how often each word that is written in small letters occurs."""
    words = F.filter(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), lambda w: w.rlike(_LOWER))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("lower"))


def _grams(words: Column) -> Column:
    """All phrases of 1 to LONGEST words of an array of at most RUN words: at, size, phrase."""

    def sized(n: int) -> Column:
        of = lambda i: F.struct(i.alias("at"), F.lit(n).alias("size"), F.array_join(F.slice(words, i + 1, n), " ").alias("phrase"))
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), of))

    return F.flatten(F.array_compact(F.array(*map(sized, range(1, LONGEST + 1)))))


def _counted(found: DataFrame) -> DataFrame:
    return found.groupBy("run").agg(F.count("*").alias("n"))


def gazetteer(found: DataFrame, lower: DataFrame, support: int = SUPPORT) -> DataFrame:
    """phrase, words, n: what counts as a name, learned from runs() and lower_counts(). n are its occurrences in runs.

    A phrase of several words needs ``support`` occurrences, no word twice in a row, and half of the occurrences of what is
    left without its last, and without its first word, taken together, are in it. A single word needs ``support``
    occurrences with a capital, and more than without: words that only begin sentences are no names.
    """
    grams = _counted(found).select("n", F.inline(_grams(F.split("run", " ")))).groupBy("phrase", "size").agg(F.sum("n").alias("n"))
    grams = written(grams, "grams")
    often = grams.filter(F.col("n") >= support)
    single = often.filter("size = 1").join(lower.withColumnRenamed("word", "_w"), F.lower("phrase") == F.col("_w"), "left").filter("n > coalesce(lower, 0)")
    w = F.split("phrase", " ")
    twice = F.exists(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.get(w, i) == F.get(w, i - 1))
    several = often.filter("size > 1").filter(~twice).withColumns({"_a": F.array_join(F.slice(w, 1, F.col("size") - 1), " "), "_b": F.array_join(F.slice(w, 2, F.col("size") - 1), " ")})
    several = several.join(grams.select(F.col("phrase").alias("_a"), F.col("n").alias("_na")), "_a").join(grams.select(F.col("phrase").alias("_b"), F.col("n").alias("_nb")), "_b")
    several = several.filter("4 * n >= _na + _nb")
    return single.select("phrase", F.col("size").alias("words"), "n").unionByName(several.select("phrase", F.col("size").alias("words"), "n"))


def names(found: DataFrame, known: DataFrame) -> DataFrame:
    """row, passage, name: runs() read from left to right, at each place the longest phrase of ``known`` that stands there;
    a word that begins none is skipped. Each distinct run is read once, as what is in it depends on nothing else."""
    grams = _counted(found).select("run", F.inline(_grams(F.split("run", " "))))
    met = grams.join(few(known.select("phrase"), "phrases"), "phrase")
    places = met.groupBy("run").agg(F.collect_list(F.struct("at", "size", "phrase")).alias("met"))  # at most RUN * LONGEST
    state = "cast(struct(0, array()) as struct<free: int, out: array<string>>)"
    step = "(s, x) -> if(x.at < s.free, s, named_struct('free', x.at + x.size, 'out', concat(s.out, array(x.phrase))))"
    read = F.expr(f"aggregate(array_sort(transform(met, x -> named_struct('at', x.at, 'less', -x.size, 'size', x.size, 'phrase', x.phrase))), {state}, {step}).out")
    read = few(places.select("run", read.alias("names")), "read-runs")
    return found.join(read, "run").select("row", "passage", F.explode("names").alias("name"))


def significant(named: DataFrame, met: int = MET, strength: float = STRENGTH) -> DataFrame:
    """src, dst, passages, strength: pairs of names (src < dst) that share at least ``met`` passages, more than chance would
    have it, with a log-likelihood ratio of at least ``strength``.

    The ratio compares the passages with both, one, the other and neither with what their margins expect, over all
    passages with a name. A passage is bounded, so its pairs are; they are counted before they are shuffled.
    """
    held = written(named.groupBy("row", "passage").agg(F.array_sort(F.collect_set("name")).alias("names")), "passages")
    margin = written(held.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= met), "margins")
    after = F.transform("names", lambda a, i: F.transform(F.slice("names", i + 2, F.size("names")), lambda b: F.struct(a.alias("src"), b.alias("dst"))))
    pairs = held.filter(F.size("names") > 1).select(F.inline(F.flatten(after))).groupBy("src", "dst").agg(F.count("*").alias("passages")).filter(F.col("passages") >= met)
    total = held.agg(F.count("*")).scalar()
    pairs = pairs.join(margin.select(F.col("name").alias("src"), F.col("n").alias("a")), "src").join(margin.select(F.col("name").alias("dst"), F.col("n").alias("b")), "dst").withColumn("t", total)
    k, a, b, t = (F.col(c).cast("double") for c in ("passages", "a", "b", "t"))
    term = lambda o, row, column: F.when(o > 0, o * F.ln(o * t / (row * column))).otherwise(0.0)
    cells = [term(k, a, b), term(a - k, a, t - b), term(b - k, t - a, b), term(t - a - b + k, t - a, t - b)]
    pairs = pairs.withColumn("strength", 2 * reduce(Column.__add__, cells))
    return pairs.filter((k * t > a * b) & (F.col("strength") >= strength)).select("src", "dst", "passages", "strength")
