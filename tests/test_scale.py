"""What keeps memory and calls of a task from growing with the input."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from millrace.operators import knowledge, retrieval
from millrace.plans.live import SERVICE
from millrace.plans.product import SplitWords
from millrace.streaming import timers

H = 3_600_000_000


class Kept:
    """A value or a list in the state that counts its calls."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def _call(self, rows=None):
        self.calls += 1
        self.rows = self.rows if rows is None else rows

    def get(self):
        self._call()
        return self.now()

    def update(self, row):
        self._call([row])

    def put(self, rows):
        self._call(list(rows))

    def appendValue(self, row):
        self._call([*self.rows, row])

    def clear(self):
        self._call([])


def test_a_key_takes_few_calls_of_the_state_store():
    rng, kept, at = random.Random(3), {}, []
    rows = [(rng.randrange(20 * H), i, rng.choice(["view", "click", "purchase", "error", "other"])) for i in range(2000)]

    def state(name, schema, single):
        kept[name] = k = Kept()
        k.now = lambda: (k.rows[0] if k.rows else None) if single else iter(k.rows)
        return k

    handle = SimpleNamespace(getValueState=lambda n, s: state(n, s, True), getListState=lambda n, s: state(n, s, False), registerTimer=at.append, deleteTimer=at.remove)
    p, out, clock = timers._Processor(SERVICE), [], lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    p.init(handle)
    for i in range(4):
        out += p.handleInputRows((1,), iter([{"at": a, "id": n, "said": s} for a, n, s in rows[i::4]]), clock(0))
    assert sum(k.calls for k in kept.values()) <= 16 and len(at) == 1
    for ms in (10 * H // 1000, 30 * H // 1000):
        fired = [at.pop()]
        out += p.handleExpiredTimer((1,), clock(ms), fired)
    assert sum(k.calls for k in kept.values()) <= 24
    status, since, want = "new", None, []
    for when, _, said in [*sorted(rows), (30 * H, -1, None)]:
        while since is not None and status in SERVICE.limits and since + SERVICE.limits[status][0] <= when:
            since, status = since + SERVICE.limits[status][0], SERVICE.limits[status][1]
            want.append((since, status, "timer"))
        if SERVICE.moves.get((status, said), status) != status:
            status, since = SERVICE.moves[status, said], when
            want.append((when, status, said))
    assert [(r["at"], r["status"], r["cause"]) for r in out] == want


def test_a_row_of_a_table_function_makes_no_batch():
    assert SplitWords.evalType == PythonEvalType.SQL_TABLE_UDF  # not SQL_ARROW_TABLE_UDF


def test_top_vectors_of_many_queries_in_little_memory():
    rng, k = np.random.default_rng(1), 5
    ids, q, v = np.arange(4096), rng.integers(-2, 3, (4096, 8)) / 4.0, rng.integers(-2, 3, (3000, 8)) / 4.0  # many ties
    batches = [pa.record_batch([pa.array(np.arange(at, at + 1500)), pa.array(list(v[at : at + 1500]))], ["vec_id", "u"]) for at in (1500, 0)]
    tracemalloc.start()
    (got,) = knowledge._best(iter(batches), SimpleNamespace(value=(ids, q)), k, 0.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    found = {}
    for i, j, score in zip(*(c.to_pylist() for c in got.columns), strict=True):
        found.setdefault(i, []).append((-score, j))
    for i in range(0, 4096, 41):
        score = np.round(q[i] @ v.T, 4)
        assert sorted(found.get(i, [])) == sorted((-s, j) for j, s in enumerate(score) if j != i and s >= 0)[:k]
    few = [b.slice(0, 3) for b in batches]
    (got,) = knowledge._best(iter(few), SimpleNamespace(value=(ids[:2], q[:2])), 7, -9.0)  # fewer vectors than k
    assert got.num_rows == 2 * 6 - 2
    (none,) = knowledge._best(iter([]), SimpleNamespace(value=(ids[:2], q[:2])), 7, -9.0)
    assert none.num_rows == 0


def test_texts_are_taken_in_slices():
    batch = pa.record_batch([pa.array([f"w{i}" for i in range(1000)])], ["text"])
    slices = list(retrieval._sliced(iter([batch])))
    assert max(s.num_rows for s in slices) <= retrieval.TEXTS and pa.Table.from_batches(slices).equals(pa.Table.from_batches([batch]))


def test_texts_are_split_once(spark):
    """Each text's words are counted in one pass; a feature whose words cancel still counts as had."""
    n = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(t):
        n.add(1)
        return t

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "", None, "b b", "1 2"])], "doc_id int, t string").select("doc_id", said("t").alias("text"))
    v = retrieval.text_vectors(docs, drop=True)
    got = {r.doc_id: r.vector for r in v.collect()}
    assert n.value == 5 and v.columns == ["doc_id", "vector"]
    assert [i for i in range(5) if got[i] is None] == [1, 2, 4] and abs(sum(e * e for e in got[0]) - 1) < 1e-5
