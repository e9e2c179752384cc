"""Vectors of texts and an inverted-file index over vectors: cells, search of the nearest cells, exact scores."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import unit_vector
from ..store import written

#: Width of a text's vector, at most WIDEST; words are runs of letters.
DIMS, WIDEST, _WORD = 256, 65_536, regex.compile(r"\p{L}+")
#: Vectors that cells are fitted on, at most; rounds of fitting; cells at most, and their number by default as a power of the rows.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 10, 4096
#: Texts that are taken at once, and words whose features a task keeps.
TEXTS, KNOWN = 256, 100_000
#: Rows of an index and queries that are scored in one go.
ROWS, QUERIES = 4096, 1024


def _hashed(word: str, dims: int) -> tuple[int, int]:
    h = hashlib.md5(word.encode("utf-8", "replace")).hexdigest()
    return int(h[:8], 16) % dims, 1 if int(h[8], 16) % 2 == 0 else -1


def _words(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            yield batch.slice(at, TEXTS)


def text_vectors(docs: DataFrame, dims: int = DIMS, text: str = "text", drop: bool = False) -> DataFrame:
    """docs with vector, array<float> of length 1: signed feature hashing of the words, weighed by how rare their features are.

    A word's MD5 gives its feature and sign; a feature's entry is the signed count of its words, times
    1 + ln((1 + texts) / (1 + texts that have it)). Texts without letters, empty and null ones have a null vector, as have
    those whose signed counts all cancel. A task holds TEXTS texts and KNOWN words beside its batch. What is gathered is a count for each feature, at most WIDEST. A column ``vector`` is replaced. Texts are
    split once; their features are written beside docs' columns, with drop=True without the text's.
    """
    if not 0 < dims <= WIDEST:
        raise ValueError(f"dims must be in 1 .. {WIDEST}")
    docs = docs.drop("vector")
    kept = [f for f in docs.schema.fields if not (drop and f.name == text)]
    sparse = T.StructType([*kept, T.StructField("_features", T.ArrayType(T.IntegerType())), T.StructField("_counts", T.ArrayType(T.LongType()))])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        for batch in _sliced(batches):
            features, counts = [], []
            for t in batch[text].to_pylist():
                v: dict[int, int] = {}
                if len(known) > KNOWN:
                    known.clear()
                for w, n in _words(t).items():
                    feature, sign = known.get(w) or known.setdefault(w, _hashed(w, dims))
                    v[feature] = v.get(feature, 0) + sign * n
                features.append(list(v))
                counts.append(list(v.values()))
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in kept), pa.array(features, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], sparse.names)

    stored = written(docs.mapInArrow(counted, sparse), "features")  # texts are read once, and features whose words cancel are there too

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(dims, np.int64), 0
        for batch in batches:
            features = batch["_features"]
            n += np.bincount(features.flatten().to_numpy(zero_copy_only=False), minlength=dims)
            total += int((features.value_lengths().to_numpy(zero_copy_only=False) > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), pa.array(np.append(n, total))], ["feature", "n"])

    rows = stored.select("_features").mapInArrow(having, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(dims + 1)
    for r in rows:
        count[r["feature"]] = r["n"]
    weight = np.log((1 + count[dims]) / (1 + count[:dims])) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            out, features, counts = [], batch["_features"], batch["_counts"]
            for i in range(len(batch)):
                v = np.zeros(dims)
                v[features[i].values.to_numpy(zero_copy_only=False)] = counts[i].values.to_numpy(zero_copy_only=False)
                v *= weight
                length = np.sqrt((v * v).sum())
                out.append((v / length).astype(np.float32) if length else None)
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in kept), pa.array(out, pa.list_(pa.float32()))], [*(f.name for f in kept), "vector"])

    return stored.mapInArrow(run, T.StructType([*kept, T.StructField("vector", T.ArrayType(T.FloatType()))]))


def _units(vectors: DataFrame, vector: str) -> DataFrame:
    return vectors.select("vec_id", unit_vector(vector).alias("u")).filter("vec_id is not null and u is not null")


def _stacked(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def fitted_cells(units: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Centres of cells, of length 1, by k-means of directions over at most ``sample`` vectors that a hash of the id draws.

    By default about the square root of the rows. Copies count once, so that a hot vector takes one cell.
    """
    n = units.count()
    cells = cells or max(1, min(MOST_CELLS, round(n**0.5)))
    draw = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30))
    some = units.withColumn("_draw", draw).filter(F.col("_draw") < (1 << 30) * min(1.0, 1.2 * sample / max(n, 1)))
    got = some.orderBy("_draw", "vec_id").limit(sample).select("u").toArrow()["u"].combine_chunks()
    if not len(got):
        return np.zeros((1, 1))
    x = np.unique(_stacked(got), axis=0)
    centres = x[np.sort(np.random.default_rng(seed).permutation(len(x))[:cells])]
    for _ in range(rounds):
        cell = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def _nearest(df: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """df (with u) once for each of its n nearest cells."""
    held = df.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CELLS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            for at in range(0, len(batch), 2048):
                some = batch.slice(at, 2048)
                near = -(_stacked(some["u"]) @ c.T)
                cells = np.argsort(near, 1, kind="stable")[:, :n] if n > 1 else near.argmin(1)[:, None]
                again = pa.array(np.repeat(np.arange(len(some)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([*(x.take(again) for x in some.columns), pa.array(cells.ravel().astype(np.int32))], [*some.schema.names, "cell"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())]))


class Index:
    """Vectors by cell: every row of vectors (vec_id, ..) with a length is in the cell of its nearest centre, in a stored table.

    Rows with a null id or vector, or a vector without length, are in no cell. centres: see fitted_cells().
    """

    def __init__(self, vectors: DataFrame, vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE):
        units = written(_units(vectors, vector), "units")
        self.centres = fitted_cells(units, cells, sample)
        self.rows = written(_nearest(units, self.centres, 1), "index")
        self.sizes = {r["cell"]: r["n"] for r in self.rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most MOST_CELLS

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None, vector: str = "embedding", floor: float = -1.0) -> DataFrame:
        """query_id, vec_id, score, rank: the k best of the vectors in each query's ``probes`` nearest cells (a quarter of the
        cells by default), by exact cosine, without the query itself; ties go to the smaller vec_id.

        With as many probes as cells the search is exhaustive and exact. A cell is scored in slices of about ROWS vectors and
        QUERIES queries, so that neither a hot cell nor a cell that all queries ask for meets in one task.
        """
        probes = min(len(self.centres), probes or max(1, -(-len(self.centres) // 4)))
        asked = written(_nearest(_units(queries, vector), self.centres, probes).withColumnRenamed("vec_id", "query_id"), "asked")
        wanted = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        table = [(c, -(-self.sizes[c] // ROWS), -(-wanted[c] // QUERIES)) for c in sorted(set(self.sizes) & set(wanted))]
        spark = queries.sparkSession
        told = F.broadcast(spark.createDataFrame(table, "cell int, _slices int, _blocks int"))  # at most MOST_CELLS rows
        deal = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        v = self.rows.join(told, "cell").withColumn("slice", deal("_slices")).withColumn("block", every("_blocks")).drop("_slices", "_blocks")
        q = asked.join(told, "cell").withColumn("block", deal("_blocks")).withColumn("slice", every("_slices")).drop("_slices", "_blocks")

        def scored(some: pa.Table, rows: pa.Table) -> pa.Table:
            out = []
            if len(some) and len(rows):
                ids, them = rows["vec_id"].to_numpy(), _stacked(rows["u"].combine_chunks())
                order = np.argsort(ids, kind="stable")
                ids, score = ids[order], np.round(_stacked(some["u"].combine_chunks()) @ them[order].T, 4)
                for i, query in enumerate(some["query_id"].to_pylist()):
                    usable = np.flatnonzero((ids != query) & (score[i] >= floor))
                    best = usable[np.argsort(-score[i, usable], kind="stable")[:k]]
                    out += [(query, int(ids[j]), float(score[i, j])) for j in best]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

        keys = ("cell", "slice", "block")
        found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(scored, "query_id long, vec_id long, score double")
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def probes_for(self, queries: DataFrame, recall: float = 0.95, k: int = 5, sample: int = 256, vector: str = "embedding") -> int:
        """The least number of probes by which a bounded sample of the queries finds that share of its true k best.

        The sample (drawn by a hash of the id) is searched exhaustively once; the place of each true neighbour's cell in its
        query's order of cells tells from how many probes on it is found.
        """
        draw = F.xxhash64("vec_id", F.lit(17))
        some = _units(queries, vector).withColumn("_draw", draw).orderBy("_draw", "vec_id").limit(sample).drop("_draw")
        got = some.toArrow()
        if not len(got):
            return len(self.centres)
        true = self.search(some, k, len(self.centres), "u")
        cells = true.join(self.rows.select("vec_id", "cell"), "vec_id").select("query_id", "vec_id", "cell").distinct().collect()
        place = (-(_stacked(got["u"].combine_chunks()) @ self.centres.T)).argsort(1, kind="stable").argsort(1)
        row = {v: i for i, v in enumerate(got["vec_id"].to_pylist())}
        needed = np.sort([place[row[r["query_id"]], r["cell"]] + 1 for r in cells])
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else len(self.centres)

    def pairs(self, queries: DataFrame, probes: int, vector: str = "embedding") -> int:
        """Pairs that search() scores."""
        asked = _nearest(_units(queries, vector), self.centres, min(probes, len(self.centres))).groupBy("cell").agg(F.count("*").alias("n")).collect()
        return sum(r["n"] * self.sizes.get(r["cell"], 0) for r in asked)
