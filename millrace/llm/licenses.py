"""License scans by diagonal voting, in DataFrame functions only.

All rolling word k-grams of all texts are joined with the positions of template k-grams. A k-gram at word d of a text and
word t of a template votes for the diagonal d - t. Votes are counted by diagonal, neighbouring diagonals (a word more or
less) merge into spans, and a span stands if the words it covers are enough of the template. The template table has one
row for each template word; it is broadcast after its rows are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, text_of, written

K = 2
#: Fixed phrases: label and words. A place is where all words stand in sequence.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
#: Notices: label and words. A span needs the given share of them, possibly with a word added or left out.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
#: Least share of a notice's words, and the furthest that diagonals of one span lie apart.
COVERED, DRIFT = 0.8, 1


def words(text: str = "text") -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text in lower case; none for a null.

    Letters beyond ASCII are lower-cased as well; no word of ASCII letters of the templates comes about by that, except
    from the Kelvin sign, which is kept as it is.
    """
    kept = F.split(F.col(text), "K")
    lowered = F.array_join(F.transform(kept, F.lower), "K")
    plain = F.when(F.contains(F.col(text), F.lit("K")), lowered).otherwise(F.lower(text))
    return F.coalesce(F.filter(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != ""), F.array().cast("array<string>"))


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES, k: int = K) -> DataFrame:
    """template, label, exact, n_words, t, gram: the k-grams of all templates."""
    rows = [(i, label, exact, text) for i, (label, text, exact) in enumerate([*((*p, True) for p in phrases), *((*n, False) for n in notices)])]
    df = spark.createDataFrame(rows, "template int, label string, exact boolean, text string").withColumn("w", F.split("text", " "))
    if any(len(r[3].split(" ")) < k for r in rows):
        raise ValueError(f"templates need at least {k} words")
    grams = F.expr(f"transform(sequence(0, size(w) - {k}), t -> named_struct('t', t, 'gram', array_join(slice(w, t + 1, {k}), ' ')))")
    df = df.select("template", "label", "exact", F.size("w").alias("n_words"), F.explode(grams).alias("x")).select("template", "label", "exact", "n_words", "x.*")
    return df.withColumn("h", F.xxhash64("gram"))


def votes(docs: DataFrame, grams: DataFrame, k: int = K) -> DataFrame:
    """text_key, template, label, exact, n_words, diagonal, ts (template words with a vote): for distinct texts."""
    w = docs.filter("text is not null").select(F.md5("text").alias("text_key"), words().alias("w"))
    step = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    rolling = w.select("text_key", F.expr(f"posexplode(if(size(w) >= {k}, transform(sequence(0, size(w) - {k}), i -> {step}), array()))").alias("d", "gram"))
    rolling = rolling.withColumn("h", F.xxhash64("gram"))
    met = rolling.join(grams, ["h", "gram"])
    return met.groupBy("text_key", "template", "label", "exact", "n_words", (F.col("d") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"))


def spans(found: DataFrame, k: int = K, covered: float = COVERED, drift: int = DRIFT) -> DataFrame:
    """text_key, label, exact, first, last (words of the text), score: verified spans from votes()."""
    exact = found.filter(F.col("exact") & (F.size("ts") == F.col("n_words") - k + 1))
    exact = exact.select("text_key", "label", "exact", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("n_words") - 1).alias("last"), F.lit(1.0).alias("score"))
    near = found.filter(~F.col("exact"))
    order = Window.partitionBy("text_key", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > drift).cast("int"), F.lit(1))
    near = near.withColumn("new", new).withColumn("island", F.sum("new").over(order))
    places = F.expr(f"flatten(transform(ts, t -> transform(sequence(0, {k - 1}), j -> t + j)))")
    near = near.withColumns({"covers": places, "first": F.col("diagonal") + F.array_min("ts"), "last": F.col("diagonal") + F.array_max("ts") + k - 1})
    alone = near.withColumn("n", F.size(F.array_distinct("covers")))
    merged = near.groupBy("text_key", "template", "island").agg(F.first("label").alias("label"), F.first("n_words").alias("n_words"), F.min("first").alias("first"), F.max("last").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("covers")))).alias("n"), F.count("*").alias("diagonals"))
    both = alone.unionByName(merged.filter("diagonals > 1"), allowMissingColumns=True).filter("last >= first")
    score = F.least(F.col("n") / F.col("n_words"), F.col("n") / (F.col("last") - F.col("first") + 1))
    both = both.select("text_key", "label", F.lit(False).alias("exact"), "first", "last", score.alias("score")).filter(F.col("score") >= covered).distinct()
    # Of notices that overlap, directly or through others, the best stands: the one with most of its words, then the longest.
    place = Window.partitionBy("text_key").orderBy("first", "last")
    apart = F.coalesce((F.col("first") > F.max("last").over(place.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    both = both.withColumn("_apart", apart).withColumn("_group", F.sum("_apart").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy("text_key", "_group").orderBy(F.desc("score"), F.desc(F.col("last") - F.col("first")))
    both = both.withColumn("_rank", F.rank().over(best)).filter("_rank = 1").drop("_apart", "_group", "_rank")
    return exact.unionByName(both)


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, k: int = K, **params) -> DataFrame:
    """docs with n_words, places (array of (first, label), by first word) of the phrases, labels (sorted, distinct) and score.

    score is the best of all spans, 0 without any. Of notices that overlap only the best counts. Null and empty texts have no words and no spans; equal texts get equal
    values. Other columns are kept; columns of these names and text_key are replaced.
    """
    grams = small(templates(docs.sparkSession, phrases, notices, k))
    found = spans(written(votes(text_of(docs, "text"), grams, k), "votes"), k, **params)
    place = F.when(F.col("exact"), F.struct(F.col("first").cast("long").alias("first"), "label"))
    found = found.groupBy("text_key").agg(F.array_sort(F.collect_list(place)).alias("places"), F.array_sort(F.collect_set("label")).alias("labels"), F.max("score").alias("score"))
    found = small(found, 1_000_000)
    docs = docs.drop("n_words", "places", "labels", "score", "text_key")
    out = docs.withColumns({"n_words": F.size(words()).cast("long"), "text_key": F.md5("text")}).join(found, "text_key", "left").drop("text_key")
    return out.withColumns({"places": F.coalesce("places", F.array().cast("array<struct<first:bigint,label:string>>")), "labels": F.coalesce("labels", F.array().cast("array<string>")), "score": F.coalesce("score", F.lit(0.0))})


def digest(found: DataFrame) -> DataFrame:
    """The columns of op8 from scan()'s rows."""
    base = F.array_join(F.array_sort(F.array_distinct("places.label")), ",")
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.first").alias("first_word"), F.array_max("places.first").alias("last_word"), base.alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
