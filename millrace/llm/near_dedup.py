"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct word shingles. Its sketch holds the k smallest hashes, k = n - ceil(t n) + 1 for a set of
n and similarity t: two sets of similarity t or more always share a retained value, so no link is lost. Values that very
many sketches hold (a common line, a shared passage) go to the end of the order that "smallest" means; the guarantee holds
for any one order. Inverted lists of retained values give candidate pairs with their overlaps, what the union of two
sketches holds of one set only bounds the similarity, and the full sets of both texts decide.

Lists are never expanded into all pairs first: each list's members meet its representative, links found so merge
classes, and only pairs that lie in different classes of a list remain for the last, complete round. There, two sets meet
in a value only if it is among the first that their own two sizes call for: sets of sizes a and b need an intersection of
at least i = ceil(t (a + b) / (1 + t)), so that the first a - i + 1 values of one and b - i + 1 of the other share one. A
member whose own changes fill these places meets nobody. Beside the values stands a short signature of each whole set, whether
its values in each part of the hash range are odd in number: where two signatures differ, so do the sets, which bounds the
intersection before a pair is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, pieces, small, space_words, text_of, word_hashes, written

#: A value in more sketches than this counts as frequent and is ordered last.
FREQUENT = 12
#: At most so many frequent values of each part of the hash range are shipped to the tasks (9 bytes each): those above the
#: lowest count that keeps within it. This decides only in which order "smallest" is meant, never which links are found.
MAX_FREQUENT = 500_000
#: Values in this lower part of the hash range are counted over all texts; sketches seldom reach further. Of the rest, those
#: of the documents that do reach further, or into frequent values, are counted.
COUNTED = np.uint64(3 << 61)
#: Ids up to which a table of them is broadcast.
MANY = 1_000_000
#: A representative's pair is verified in the first turn if it shares one of so many retained values; others wait.
STRONG = 4
#: Turns of representatives at most. In the second, a member meets one only, however few values they share, and only lists whose largest class has more than FREQUENT members take part.
TURNS = 2
#: Pairs with one representative are verified in blocks of about so many.
BLOCK = 64


def shingle_sets(texts: list[str | None], width: int) -> tuple[list[np.ndarray], list[bytes | None]]:
    """For each text, sorted distinct 64-bit hashes of the word shingles (of the whole sequence where it is shorter; none
    without words), and a digest of the words themselves (None without words)."""
    words, ends, keys = word_hashes(texts)

    def joined(h: np.ndarray, n: int) -> np.ndarray:
        out = mixed(h[: len(h) - n + 1] + np.uint64(n))
        for i in range(1, n):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
        return out

    every = joined(words, width) if len(words) >= width else words[:0]
    sets = []
    for start, end in zip(ends[:-1], ends[1:], strict=True):
        n = end - start
        sets.append(np.unique(every[start : end - width + 1]) if n >= width else joined(words[start:end], n) if n else words[:0])
    return sets, keys


#: 64-bit words of a signature.
SIGNS = 8


def signature(values: np.ndarray) -> np.ndarray:
    """Whether the number of values is odd, for each of 64 * SIGNS equal parts of the hash range, as SIGNS int64."""
    cells = (values >> np.uint64(64 - (64 * SIGNS).bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=64 * SIGNS) & 1).astype(np.uint8)).view(np.int64)


def retained(n: int, percent: int) -> int:
    """Size of the sketch of a set of n."""
    return n + percent * n // -100 + 1 if n else 0


def _sketches(width: int, percent: int, frequent):
    """key, n, sketch, signs and far (whether the sketch's last value is frequent or wasn't among those counted first) beside other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = frequent.value
        for batch in pieces(batches, "text"):
            sets, keys = shingle_sets(batch["text"].to_pylist(), width)
            sketches, far, signs = [], [], []
            for s in sets:
                signs.append(signature(s))
                k, reaches = retained(len(s), percent), False
                if len(last) and k:
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    late = np.where(last[at] == s, rank[at], 0)
                    if late.any():
                        order = np.argsort(late, kind="stable")
                        s, reaches = s[order], bool(late[order[k - 1]])
                sketches.append(s[:k].view(np.int64))
                far.append(reaches or bool(k and s[k - 1] >= COUNTED))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sketches])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sketches)))
            others = [c for c in batch.schema.names if c != "text"]
            columns = [*(batch[c] for c in others), pa.array(keys, pa.binary()), pa.array(map(len, sets), pa.int32()), lists, pa.array(signs, pa.list_(pa.int64())), pa.array(far, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*others, "key", "n", "sketch", "signs", "far"])

    return run


def _values(width: int, low: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", rows=1000):
            sets = shingle_sets(batch["text"].to_pylist(), width)[0]
            every = np.concatenate(sets)
            value, count = np.unique(every[(every < COUNTED) == low], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count.astype(np.int32))], ["value", "n"])

    return run


def _frequent(docs: DataFrame, width: int, low: bool) -> DataFrame:
    """Values of the lower or the upper part of the range that more than FREQUENT sets hold: value, level (a logarithm of how many)."""
    counts = docs.select("text").mapInArrow(_values(width, low), "value long, n int").groupBy("value").agg(F.sum("n").alias("n"))
    return written(counts.filter(F.col("n") > FREQUENT).select("value", F.floor(F.log2("n") * 4).cast("int").alias("level")), "frequent")


def _ranked(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values of counts, and their levels: MAX_FREQUENT at most."""
    least, room = 0, MAX_FREQUENT
    for row in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # a few dozen levels
        room -= row["count"]
        if room < 0:
            least = row["level"] + 1
            break
    found = counts.filter(F.col("level") >= least).toPandas()
    values = found["value"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], found["level"].to_numpy(np.uint8)[order]


def _verified(width: int, percent: int):
    def exact(text: str) -> set:
        w = space_words(text)
        return {tuple(w)} if len(w) < width else set(zip(*(w[i:] for i in range(width)), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, near_set = None, set()
        for batch in pieces(batches, "text_a", "text_b", rows=100):
            hit = []
            for a, b in zip(batch["text_a"].to_pylist(), batch["text_b"].to_pylist(), strict=True):
                if a != near:
                    near, near_set = a, exact(a)
                other = exact(b)
                common = len(near_set & other)
                hit.append(100 * common >= percent * (len(near_set) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return run


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b), a table, whose full sets are similar enough. A node a with many pairs is dealt out over several tasks."""
    ids = pairs.select(F.col("a").alias("node")).distinct().union(pairs.select(F.col("b").alias("node")).distinct()).distinct()
    ids = small(nodes.join(small(ids, MANY), "node").select("node", F.col("doc_id").alias("_dedup_of"), "same"), MANY)
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_dedup_of")) & (F.xxhash64("text") == F.col("same")))
    texts = written(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")).drop("blocks")
    left = blocks.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
    left = left.select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    both = dealt.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b").join(left, ["a", "block"])
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verified(width, percent), "a long, b long").distinct()


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b), a table, which the union of both sketches leaves possible.

    Of two sketches, the one whose last value comes first lies whole within the reach of the other: its values that aren't
    common, and those of the other up to the last common one, are outside the intersection.
    """
    ids = small(pairs.select(F.col("a").alias("node")).distinct().union(pairs.select(F.col("b").alias("node")).distinct()).distinct(), MANY)
    sketches = written(sketches.join(ids, "node", "left_semi"), "asked")
    x, y = (sketches.toDF(c, f"n{c}", f"s{c}") for c in "ab")
    both = pairs.join(x, "a").join(y, "b").withColumn("common", F.array_intersect("sa", "sb")).withColumn("c", F.size("common")).filter("c > 0")
    at = {x: F.expr(f"cast(array_position(s{x}, element_at(common, -1)) as int)") for x in "ab"}  # from 1
    first = F.least(F.expr("na - size(sa)"), F.col("nb") - at["b"])
    second = F.least(F.col("na") - at["a"], F.expr("nb - size(sb)"))
    most = F.greatest(first, second) + F.col("c")
    return both.filter(most * (100 + percent) >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): node, root (the smallest node of its component), for nodes with links.

    Rounds of large-star and small-star on edge tables, until nothing changes; each round is one written table, and hot
    nodes are only ever aggregated to their smallest neighbour.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        new = written(small.select("x.*").filter("u <> v").distinct(), "stars")
        sums = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (edges, new)]
        edges = new
        if sums[0] == sums[1]:
            break
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, and same and stays, see below.

    component_id is the smallest doc_id that links (100 * intersection >= percent * union of the shingle sets) reach,
    itself included. Null and empty texts have an empty set and stand alone. Rows are told apart by their text as well as
    their doc_id: where a doc_id repeats with other texts, each is placed by its own text; rows without a doc_id belong to
    groups as any other and get a null component_id if no row of the group has an id. ``same`` is a hash of the text;
    ``stays`` marks the one (doc_id, text) of each group that remains of it, the smallest. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    docs = text_of(docs, "doc_id", "text")
    given, sketched = docs.select("doc_id", F.xxhash64("text").alias("same"), "text"), "doc_id long, same long, key binary, n int, sketch array<long>, signs array<long>, far boolean"
    ranks = spark.sparkContext.broadcast(_ranked(_frequent(docs, width, True)))
    rows = given.mapInArrow(_sketches(width, percent, ranks), sketched)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "sketches")

    # Equal sequences of words, by the digest of their bytes, are one node; the row with the smallest doc_id stands for it.
    own = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "same", "row")).alias("x")
    nodes = written(rows.filter("n > 0").groupBy("key").agg(own, F.count("*").alias("copies")).select("key", F.col("x.row").alias("node"), "x.no_id", "x.doc_id", "x.same", "copies"), "nodes")
    copied = small(nodes.filter("copies > 1").select("key", "node"), MANY)
    single = rows.filter("n > 0").join(copied, "key", "left").filter("node is null or node = row").select(F.col("row").alias("node"), "doc_id", "same", "n", "sketch", "signs", "far")
    # Sketches that reach far take up values not counted yet: those are counted now and, where frequent, ordered last too.
    # Other sketches stay as they are, since they end before all values that move.
    far = small(single.filter("far").select("node", "doc_id", "same"), MANY)
    again = given.alias("d").join(far.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.same") == F.col("f.same")))
    again = again.select("node", "d.doc_id", "d.same", "text")
    parts = _ranked(_frequent(again, width, False)), ranks.value  # of different parts of the range
    values, levels = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(values)
    ranks = spark.sparkContext.broadcast((values[order], levels[order]))
    again = written(again.mapInArrow(_sketches(width, percent, ranks), f"node long, {sketched}").select("node", "n", "sketch"), "far")
    sketches = single.filter("not far").select("node", "n", "sketch").union(again)
    entries = sketches.select("node", "n", F.posexplode("sketch").alias("pos", "value"))
    beside = Window.partitionBy("value").orderBy("node")
    entries = entries.withColumns({"before": F.lag("node").over(beside), "after": F.lead("node").over(beside)})
    entries = written(entries.filter("before <> node or after <> node").drop("before", "after"), "lists")  # retained values that two sketches share at least

    # share: how much of a sketch other sketches hold; in a group of near copies, the member with the fewest changes has most.
    active = written(entries.groupBy("node").agg((F.count("*") / F.first("n")).alias("share")), "active")
    # In each list, the member of the largest class with the most shared sketch meets those outside the class; pairs found
    # similar merge classes, so groups of near copies become one class without meeting pair by pair.
    root, links, total = active.withColumn("root", F.col("node")), None, active.count()
    for turn in range(TURNS):
        here = entries.join(root, "node")
        rep = here.groupBy("value", "root").agg(F.count("*").alias("c"), F.min(F.struct((-F.col("share")).alias("order"), F.xxhash64("node").alias("h"), "node", "n")).alias("rep"))
        rep = rep.groupBy("value").agg(F.max(F.struct("c", (-F.col("rep.order")).alias("share"), F.xxhash64("root").alias("h"), "rep", "root")).alias("m"), F.count("*").alias("k"))
        rep = rep.filter(f"k > 1 and ({turn} = 0 or m.c > {FREQUENT})").select("value", "m.rep.node", "m.rep.n", "m.root").toDF("value", "a", "na", "ra")
        pairs = here.join(rep, "value").filter(f"root <> ra and 100 * least(n, na) >= {percent} * greatest(n, na)")
        pairs = pairs.groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("c"), F.min(F.least("n", "na")).alias("n"))
        if turn:  # one representative for each member: the one it shares most with
            pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a"))
        else:
            pairs = pairs.filter(f"{STRONG} * c * 100 >= (100 - {percent}) * n")
        found = written(_links(written(pairs.select("a", "b"), "pairs"), nodes, docs, width, percent), "found")
        links = found if links is None else links.union(found)
        left, right = (root.select(F.col("node").alias(n), F.col("root").alias(f"r{n}")) for n in "ab")
        merged = components(found.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))).toDF("root", "least")
        root = written(root.join(merged, "root", "left").select("node", "share", F.coalesce("least", "root").alias("root")), "roots")
        if found.count() * 1000 <= total:
            break

    # The rest: in each list, those outside its largest class against all, in different classes.
    here = entries.join(root.drop("share"), "node")
    sizes = here.groupBy("value", "root").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("value").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("k")).filter("k > 1").select("value", F.col("m.root").alias("top"))
    here = written(here.join(largest, "value").join(single.select("node", "signs"), "node"), "open")
    few = here.filter("root <> top").select("value", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("pos").alias("pa"), F.col("signs").alias("sa"))
    meets = few.join(here, "value").filter(f"ra <> root and a <> node and (root = top or a < node) and 100 * least(n, na) >= {percent} * greatest(n, na)")
    # The value must be among the first that these two sizes call for.
    beyond = f"(({percent} * (n + na) + {99 + percent}) div {100 + percent})"
    meets = meets.filter(f"pa <= na - {beyond} and pos <= n - {beyond}")
    # Half of what the sizes have over the differing signs is the most that the intersection can be.
    differ = " + ".join(f"bit_count(sa[{i}] ^ signs[{i}])" for i in range(SIGNS))
    meets = meets.filter(f"n + na - ({differ}) >= 2 * {beyond}")
    # What precedes a common value in both, and what follows it, bounds the intersection.
    meets = meets.filter(f"(least(pa, pos) + least(na - pa, n - pos)) * {100 + percent} >= {percent} * (n + na)")
    pairs = meets.groupBy(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).agg(F.first("n").alias("n"), F.first("na").alias("na"), F.count("*").alias("c"), F.max(F.least("pa", "pos")).alias("at"))
    # Of the two beginnings, the one whose last value comes first lies whole within the reach of the other: what it holds up
    # to the last common value isn't common but for these.
    pairs = written(pairs.filter(f"greatest(n, na) - at - 1 + c >= {beyond}").select("a", "b"), "met")
    near = _near(pairs, sketches, percent)
    found = _links(written(near, "rest"), nodes, docs, width, percent)
    known = components(written(links.union(found), "all-links"))

    # One row for each text first, so that copies of a text meet only what stands for them; texts without links or copies need nothing.
    placed = nodes.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = F.min(F.struct("no_id", "doc_id", "same")).alias("least")
    least = placed.groupBy("root").agg(least, F.sum("copies").alias("rows")).filter("rows > 1")
    placed = small(placed.select("key", "root").join(least, "root").select("key", "least"), MANY)
    out = rows.select("doc_id", "same", "key", F.col("n").cast("long").alias("n_shingles")).join(placed, "key", "left")
    stays = F.col("least").isNull() | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("same") == F.col("least.same")))
    return out.select("doc_id", "n_shingles", F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), "same", stays.alias("stays"))


def kept(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """classes() with ``kept``: true for the document that stays of each component (null ids: where no row has one)."""
    return classes(docs, width, percent).drop("same", "stays").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component, that with the smallest doc_id; rows without words all stay."""
    told = written(classes(docs, width, percent), "classes")
    said = [F.col("doc_id").alias("_dedup_of"), F.col("same").alias("_dedup_same")]
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("_dedup_of")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_dedup_same"))
    gone = told.filter("not stays").select(*said).distinct()
    repeated = written(told.filter("stays and n_shingles > 0").groupBy("doc_id", "same").count().filter("count > 1").select(*said), "repeated")
    left = docs.join(small(gone, MANY), here, "left_anti")
    if repeated.isEmpty():
        return left.select(docs.columns)
    once = left.join(repeated, here, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeated, here, "left_anti").select(docs.columns).unionByName(once.select(docs.columns))
