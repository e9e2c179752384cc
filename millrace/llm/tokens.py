"""Token counts kept up to date by signed changes.

A commit turns a batch of changes into signed rows (a retraction of what was counted, an insertion of what counts now),
sums them by source, language and tokenizer version, and publishes both by one small file with the batch's name. Totals are
the sum of all published deltas. A batch that is already there is left alone, so that a retry changes nothing.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, pieces, text_of, written

#: The pre-tokenizer of the byte-level vocabularies, a fixed pattern of theirs; largest vocabulary file, in bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_FILE = 32_000_000
GROUP = ["source", "lang", "tokenizer"]
_ROW = "doc_id long, source string, lang string, tokenizer string, n_tokens long, sign int"


def counted(docs: DataFrame, ranks: str, version: str | None = None, text: str = "text") -> DataFrame:
    """docs with n_tokens, the byte-level BPE tokens of the whole text (null: 0), and tokenizer, the version's name.

    ranks: URI of a file of ranks (base64 token, rank, one to a line); the version's default is the start of its digest.
    Strings of special tokens count as ordinary text. Columns of these names are replaced.
    """
    spark = docs.sparkSession
    row = spark.read.format("binaryFile").load(ranks).select("length", "content").first()
    if row["length"] > MAX_FILE:
        raise ValueError(f"{ranks} has over {MAX_FILE} bytes")
    data = bytes(row["content"])
    held, version = spark.sparkContext.broadcast(data), version or hashlib.sha256(data).hexdigest()[:12]
    docs = docs.drop("n_tokens", "tokenizer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        lines = (x.split() for x in held.value.splitlines() if x.strip())
        coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})
        for batch in pieces(batches, text):
            n = [len(coder.encode_ordinary(t)) if t else 0 for t in batch[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array([version] * len(n), pa.string())], [*batch.schema.names, "n_tokens", "tokenizer"])

    return docs.mapInArrow(run, extended(docs, n_tokens="long", tokenizer="string"))


class Rollup:
    """Totals by source, language and tokenizer version below a folder that driver and executors share.

    ``data/<unique name>`` holds a batch's signed rows, from which the current count of a document is told, and their sums.
    ``commits/<batch>.json`` names these folders; it is written last, as a whole, and commits. Nothing is moved, so that any
    store with whole-file writes will do; data without a commit is of no account. compact() commits the net rows of all
    batches so far in place of theirs. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs, self.path = pafs.FileSystem.from_uri(self.folder)
        self.fs.create_dir(f"{self.path}/commits", recursive=True)

    def _commits(self) -> list[dict]:
        out = []
        for x in self.fs.get_file_info(pafs.FileSelector(f"{self.path}/commits")):
            if x.base_name.endswith(".json"):
                with self.fs.open_input_stream(x.path) as f:
                    out.append(json.loads(f.read()))
        return out

    def batches(self) -> list[str]:
        """Names of the committed batches, compacted ones included."""
        return sorted({b for c in self._commits() for b in c["batches"]})

    def _all(self, part: str, schema: str) -> DataFrame:
        commits = self._commits()
        whole = max((c for c in commits if c.get("compacted")), key=lambda c: len(c["batches"]), default={"batches": []})
        live = ([whole] if whole["batches"] else []) + [c for c in commits if not c.get("compacted") and not set(c["batches"]) & set(whole["batches"])]
        paths = [f"{self.folder}/{c[part]}" for c in live]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _publish(self, name: str, commit: dict) -> None:
        with self.fs.open_output_stream(f"{self.path}/{name}.tmp") as f:
            f.write(json.dumps(commit).encode())
        self.fs.move(f"{self.path}/{name}.tmp", f"{self.path}/commits/{name}.json")  # one small file

    def _put(self, rows: DataFrame) -> dict:
        """Writes signed rows and their sums; returns the names of both."""
        at = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{at}/rows")
        rows = self.spark.read.schema(_ROW).parquet(f"{self.folder}/{at}/rows")
        delta = rows.groupBy(*GROUP).agg(F.sum(F.col("sign").cast("long")).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("sign")).alias("n_tokens"))
        delta.write.parquet(f"{self.folder}/{at}/delta")
        return {"rows": f"{at}/rows", "delta": f"{at}/delta"}

    def compact(self) -> None:
        """From now on the net rows of what is committed are read in place of all the batches' rows; batches stay known."""
        known = self.batches()
        net = self.current().select("doc_id", *GROUP, "n_tokens", F.col("copies").cast("int").alias("sign"))
        self._publish(f"compacted-{uuid.uuid4().hex}", {"batches": known, "compacted": True} | self._put(net))

    def current(self) -> DataFrame:
        """doc_id, source, lang, tokenizer, n_tokens, copies of what counts now: signed rows that aren't retracted."""
        keys = ["doc_id", *GROUP, "n_tokens"]
        return self._all("rows", _ROW).groupBy(*keys).agg(F.sum("sign").alias("copies")).filter("copies <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; nulls are values of their own, groups without documents are left out."""
        sums = self._all("delta", "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        return sums.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies changes: rows of op (insert, delete, revise), doc_id, source, lang, tokenizer, n_tokens. False if batch is there.

        insert adds a row, repeated rows count each. delete retracts all that counts for the doc_id under that tokenizer;
        revise does so and adds the row given. Deletes and revisions of unknown documents retract nothing. Rows without a
        doc_id can be inserted only. Of several deletes or revisions of one document in a batch, one with the greatest values stands.
        """
        if batch in self.batches():
            return False
        kinds = {"op": "string", "doc_id": "long", "source": "string", "lang": "string", "tokenizer": "string", "n_tokens": "long"}
        changes = changes.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()))
        added = changes.filter("op = 'insert'").select("doc_id", *GROUP, "n_tokens", F.lit(1).alias("sign"))
        others = changes.filter("op in ('delete', 'revise') and doc_id is not null").groupBy("doc_id", "tokenizer").agg(F.max(F.struct("op", "source", "lang", "n_tokens")).alias("x"))
        others = written(others, "changes")  # read twice below, counted once
        revised = others.filter("x.op = 'revise'").select("doc_id", "x.source", "x.lang", "tokenizer", "x.n_tokens", F.lit(1).alias("sign"))
        old = self.current().alias("c").join(others.select("doc_id", "tokenizer").alias("o"), (F.col("c.doc_id") == F.col("o.doc_id")) & F.col("c.tokenizer").eqNullSafe(F.col("o.tokenizer")), "left_semi")
        retracted = old.select("doc_id", *GROUP, "n_tokens", (-F.col("copies")).cast("int").alias("sign"))
        rows = added.unionByName(revised).unionByName(retracted)
        self._publish(f"batch-{hashlib.sha256(batch.encode()).hexdigest()}", {"batches": [batch]} | self._put(rows))
        return True


def inserts(docs: DataFrame, ranks: str, version: str | None = None) -> DataFrame:
    """Changes that insert each row of docs (doc_id, source, lang, text) with its count."""
    rows = counted(text_of(docs, "doc_id", "source", "lang", "text"), ranks, version)
    return rows.select(F.lit("insert").alias("op"), "doc_id", *GROUP, "n_tokens")
