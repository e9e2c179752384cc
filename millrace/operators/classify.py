"""Labels learned from texts: naive Bayes over words that are significantly tied to labels, scored by a join on words."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import written

#: Words; labels at most; by how much the logarithm of the best label's odds must exceed the second's.
WORD, LABELS, MARGIN = r"\p{L}{2,}", 200, 0.5
#: Least log-likelihood ratio of a word and the labels: by chance one word in a thousand has it (of two labels).
SIGNIFICANT = 10.83
ABSTAIN = "abstain"


def words(text: Column) -> Column:
    """The different words of a text, in small letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def likelihood_ratio(having: list[Column], sizes: list[int]) -> Column:
    """2 * sum of O * ln(O / E) over groups of the given sizes and whether a word is there, having: in how many of each it is."""
    total, n = sum(sizes), reduce(add, having)

    def term(o: Column, e: Column) -> Column:
        return F.when(o > 0, o * F.ln(o / e)).otherwise(0.0)

    cells = [c for o, size in zip(having, sizes, strict=True) for c in (term(o, n * size / total), term(size - o, (total - n) * size / total))]
    return 2 * reduce(add, cells)


@dataclass
class Bayes:
    """words: word and a column of ln(texts + 1) for each label. base and each: a label's ln(share of texts) and ln(texts' words + vocabulary)."""

    words: DataFrame
    labels: list[str]
    base: list[float]
    each: list[float]


def fit(rows: DataFrame, text: str = "text", label: str = "label", least: float = SIGNIFICANT) -> Bayes:
    """From all rows with text and label. A word counts once a text, and only if its log-likelihood ratio with the labels is at
    least ``least``; each label has every such word once more than seen. The vocabulary stays a table; of labels, at most
    LABELS, the driver holds sums."""
    rows = rows.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), text)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).limit(LABELS + 1).collect()}
    if not sizes:
        raise ValueError("there is nothing to learn from")
    if len(sizes) > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    labels = sorted(sizes)
    counts = rows.select("label", F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(*(F.count_if(F.col("label") == k).alias(f"c{i}") for i, k in enumerate(labels)))
    if len(labels) > 1:
        counts = counts.filter(likelihood_ratio([F.col(f"c{i}") for i in range(len(labels))], [sizes[k] for k in labels]) >= least)
    counts = written(counts, "word-counts")
    told = counts.agg(F.count("*").alias("v"), *(F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(labels)))).first()
    table = counts.select("word", *(F.log1p(f"c{i}").alias(f"l{i}") for i in range(len(labels))))
    total = sum(sizes.values())
    return Bayes(table, labels, [log(sizes[k] / total) for k in labels], [log(max(told[f"c{i}"] + told["v"], 1)) for i in range(len(labels))])


def labelled(docs: DataFrame, model: Bayes, id: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """id, label_pred, margin for every row of docs: the label of the greatest score, or 'abstain' where it leads the second by
    less than ``margin``. A text without words that tell gets the most frequent label, by its lead (null for a single label).

    Rows of one id with different texts are told apart; repeated rows give repeated rows, null texts count as empty. Ties go
    to the first label. Columns but id and text aren't read.
    """
    docs = docs.select(F.col(id), F.col(text).alias("_t"), F.xxhash64(id, text).alias("_row"))
    found = docs.select("_row", F.explode(words(F.col("_t"))).alias("word")).distinct().join(model.words, "word")
    k = range(len(model.labels))
    sums = found.groupBy("_row").agg(F.count("*").alias("_n"), *(F.sum(f"l{i}").alias(f"s{i}") for i in k))
    out = docs.drop("_t").join(sums, "_row", "left")
    none = F.lit(0.0)
    scores = [F.lit(model.base[i]) + F.coalesce(f"s{i}", none) - F.coalesce("_n", F.lit(0)) * model.each[i] for i in k]
    order = F.array_sort(F.array(*(F.struct((-s).alias("s"), F.lit(i).alias("i")) for i, s in enumerate(scores))))
    out = out.select(id, order.alias("_order"))
    name, lead = F.element_at(F.array(*map(F.lit, model.labels)), F.col("_order")[0]["i"] + 1), F.get("_order", F.lit(1))["s"] - F.col("_order")[0]["s"]
    return out.select(id, F.when(F.coalesce(lead, F.lit(margin)) >= margin, name).otherwise(ABSTAIN).alias("label_pred"), lead.alias("margin"))
