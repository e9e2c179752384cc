"""WARC archives from a table of pages: a deterministic sharded writer, and a reader.

A first pass compresses each record to learn its size only. A range sort of the keys with these sizes, not of the pages,
gives running totals, and these the first key of each file, so that the files don't depend on the partitioning. A second
pass compresses again, sends each record to its file, and writes: what is stored beside the archives is one shuffle of
compressed records, not a table of them as well. Each task writes files under temporary names and reports them; the manifest
of what succeeded is a table of its own, by which tasks rename the files, idempotently. Equal payloads become revisit
records of the one with the smallest key.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import ranked
from .common import pieces, running_totals, scratch, small, text_of, written

#: Payloads below this many bytes are never revisits; compressed bytes after which a file ends; the date records bear.
LEAST, ROLL, DATE = 100, 64_000_000, "2024-01-01T00:00:00Z"
#: Order of the records; files up to which their first keys go to the tasks, beyond which keys are joined.
ORDER, MANY_FILES = ["page_id", "digest", "url"], 100_000
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace of URLs, RFC 4122


def _id(page_id: int | None, url: str | None, digest: str, number: int = 0) -> str:
    said = json.dumps([page_id, url, digest, number])
    return f"<urn:uuid:{uuid.uuid5(_SPACE, said)}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, n: int, digest: str, refers_to: int | None, refers_url: str | None = None, number: int = 0, date: str = DATE) -> bytes:
    """One WARC/1.1 record, compressed as a gzip member of its own. payload None: a revisit, which keeps the HTTP head only.

    number tells apart records that have all else in common.
    """
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = head + (payload or b"")
    lines = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _id(page_id, url, digest, number),
        "WARC-Date": date,
        "WARC-Target-URI": "".join((url or f"urn:sha256:{digest}").split()),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
    }
    if page_id is not None:
        lines["X-Page-Id"] = str(page_id)
    if refers_to is not None:
        lines |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _id(refers_to, refers_url, digest), "X-Refers-To-Page-Id": str(refers_to)}
    lines["Content-Length"] = str(len(block))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of a decompressed record, those of its HTTP head, and its payload; the block digest is verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if version != "WARC/1.1" or "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != headers["WARC-Block-Digest"]:
        raise ValueError(f"record {headers.get('WARC-Record-ID')} is damaged")
    said, _, payload = block.partition(b"\r\n\r\n")
    return headers, dict(x.split(": ", 1) for x in said.decode().split("\r\n")[1:]), payload


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def described(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, n (bytes), digest, refers_to (null: a response), refers_url, number for each row of pages.

    Null html counts as empty, and an empty page is a record as any other. Rows without a page_id have records that no
    other refers to; rows that repeat a page_id have a record each, and with equal payloads as well none refers to the
    other. Rows that are equal in page_id, url and payload are numbered from 0.
    """
    rows = text_of(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumns({"n": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("to")
    seen = written(rows.groupBy("digest", "n").agg(first, F.count("*").alias("copies"), F.count_distinct("page_id", F.coalesce("url", F.lit(""))).alias("kinds")).filter("copies > 1"), "warc-seen")
    repeated = small(seen.filter(f"n >= {least} and to is not null").select("digest", F.col("to.page_id").alias("to"), F.col("to.url").alias("to_url")))
    other = F.col("to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("to"))
    rows = rows.join(repeated, "digest", "left").select("page_id", "url", "html", "n", "digest", F.when(other, F.col("to")).alias("refers_to"), F.when(other, F.col("to_url")).alias("refers_url"))
    twins = seen.filter("kinds < copies").select("digest")  # digests that may have rows equal in all
    if twins.isEmpty():
        return rows.withColumn("number", F.lit(0).cast("long"))
    twins = small(twins)
    some = rows.join(twins, "digest", "left_semi").withColumns({"_draw": F.rand(5), "_same": F.md5(F.to_json(F.struct("page_id", "url", "digest")))})
    some = ranked(some, "_same", ["_draw"], "number", "_n", "warc-twins")
    return rows.join(twins, "digest", "left_anti").withColumn("number", F.lit(0).cast("long")).unionByName(some.select(*rows.columns, F.col("number").cast("long")))


def _place(r) -> tuple:
    """A key of ORDER that compares as Spark orders it."""
    return r["page_id"] is not None, r["page_id"] or 0, r["digest"], r["url"] is not None, r["url"] or ""


def _records(rows: DataFrame, starts=None) -> DataFrame:
    """The compressed records of described() rows. starts, a broadcast list of the files' first keys and their names: ORDER,
    number, record, bytes, file; else without record and file."""
    names = [*ORDER, "number", "bytes"] + ([] if starts is None else ["record", "file"])
    kinds = "page_id long, digest string, url string, number long, bytes long" + ("" if starts is None else ", record binary, file long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, files = starts.value if starts is not None else ((), ())
        for batch in pieces(batches, "html"):
            rows = batch.to_pylist()
            out = [record(r["page_id"], r["url"], None if r["refers_to"] is not None else r["html"].encode("utf-8", "replace"), r["n"], r["digest"], r["refers_to"], r["refers_url"], r["number"]) for r in rows]
            columns = [*(batch[c] for c in [*ORDER, "number"]), pa.array([len(x) for x in out], pa.int64())]
            if starts is not None:
                file = batch["file"] if "file" in batch.schema.names else pa.array([files[bisect.bisect_right(keys, _place(r)) - 1] for r in rows], pa.int64())
                columns += [pa.array(out, pa.binary()), file]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, kinds)


def _dealt(rows: DataFrame, roll: int) -> tuple[DataFrame, int]:
    """Records of described() rows with their file, and the number of files: rows of one key stay in one file."""
    sizes = _records(rows).groupBy(*ORDER).agg(F.sum("bytes").alias("bytes"))
    placed = running_totals(written(sizes, "warc-sizes"), [F.col(c) for c in ORDER], "bytes", "before", "warc-keys")
    placed = placed.select(*ORDER, F.floor(F.col("before") / roll).cast("long").alias("file"))
    first = F.min(F.struct(*ORDER)).alias("x")
    starts = written(placed.groupBy("file").agg(first).select("file", "x.*"), "warc-starts")
    n = starts.count()
    if n <= MANY_FILES:
        found = starts.orderBy("file").collect()
        return _records(rows, rows.sparkSession.sparkContext.broadcast(([_place(r) for r in found], [r["file"] for r in found]))), n
    placed = placed.withColumnsRenamed({c: f"_{c}" for c in ORDER})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ORDER]
    return _records(rows.join(placed, same[0] & same[1] & same[2]).drop(*(f"_{c}" for c in ORDER)), rows.sparkSession.sparkContext.broadcast(((), ()))), n


def write(pages: DataFrame, folder: str, roll: int = ROLL, least: int = LEAST) -> DataFrame:
    """Writes pages (page_id, url, html) as archives below folder and returns the committed manifest.

    Manifest: file, records, first and last page_id, bytes, sha256. Folder gets ``MANIFEST.json`` last (a line for the whole,
    then one for each file); a reader that finds it finds every file. Files are the same for any partitioning of pages, and
    a repeated run replaces them by equal ones. A file ends with the first record from which on it has ``roll`` bytes or more.
    """
    records, n = _dealt(described(pages, least), roll)
    files = records.repartition(max(1, n), "file").sortWithinPartitions("file", *ORDER, "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        fs.create_dir(f"{path}/_temporary", recursive=True)
        now, out, done = None, None, []

        def close() -> None:
            out.close()
            done.append({**now, "sha256": now["sha256"].hexdigest()})

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now["file"] != r["file"]:
                    if now:
                        close()
                    now = {"file": r["file"], "temporary": f"{uuid.uuid4().hex}.warc.gz", "records": 0, "first": r["page_id"], "last": 0, "bytes": 0, "sha256": hashlib.sha256()}
                    out = fs.open_output_stream(f"{path}/_temporary/{now['temporary']}", compression=None)
                out.write(r["record"])
                now["sha256"].update(r["record"])
                now |= {"records": now["records"] + 1, "bytes": now["bytes"] + r["bytes"], "last": r["page_id"]}
        if now:
            close()
            yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.int64()), ("temporary", pa.string()), ("records", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    said = "file long, temporary string, records long, first long, last long, bytes long, sha256 string"
    # Attempts that fail or run twice leave other temporary names; only what this table lists is renamed.
    manifest = written(files.select("page_id", "record", "bytes", "file").mapInArrow(run, said), "warc-manifest")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        for batch in batches:
            for r in batch.to_pylist():
                source, target = f"{path}/_temporary/{r['temporary']}", f"{path}/{name(r['file'])}"
                if fs.get_file_info(source).type != pafs.FileType.NotFound:  # else an earlier attempt has renamed it
                    fs.move(source, target)
                if fs.get_file_info(target).size != r["bytes"]:
                    raise OSError(f"{target} is not what was written")
            yield pa.RecordBatch.from_arrays([pa.array([name(f) for f in batch["file"].to_pylist()], pa.string()), *(batch[c] for c in ("records", "first", "last", "bytes", "sha256"))], ["file", "records", "first", "last", "bytes", "sha256"])

    done = written(manifest.mapInArrow(rename, "file string, records long, first long, last long, bytes long, sha256 string"), "warc-committed")
    total = done.agg(F.count("*").alias("files"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/MANIFEST.json.tmp") as f:
        f.write(json.dumps(total.asDict() | {"roll": roll}).encode() + b"\n")
        for r in done.orderBy("file").toLocalIterator():  # a line at a time
            f.write(json.dumps(r.asDict()).encode() + b"\n")
    fs.move(f"{path}/MANIFEST.json.tmp", f"{path}/MANIFEST.json")
    return done


def name(file: int) -> str:
    return f"part-{file:08d}.warc.gz"


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """A row for each record of the manifest's files: page_id, record_type, n, digest, refers_to, payload (null for revisits).

    n is the payload's size as the HTTP head states it, for revisits that of the page they refer to. A file's bytes are compared with the manifest's digest, a record's block and a response's payload with its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        for batch in batches:
            for file in batch.to_pylist():
                digest, rest, z, got, out = hashlib.sha256(), b"", zlib.decompressobj(31), [], []
                with fs.open_input_stream(f"{path}/{file['file']}", compression=None) as f:
                    while data := rest or f.read(1 << 20):
                        if not rest:
                            digest.update(data)
                        out.append(z.decompress(data))
                        rest = z.unused_data
                        if z.eof:
                            headers, http, payload = parse(b"".join(out))
                            z, out = zlib.decompressobj(31), []
                            kind, said = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                            n = int(http["Content-Length"])
                            if kind == "response" and (n != len(payload) or hashlib.sha256(payload).hexdigest() != said):
                                raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
                            key, to = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                            got.append({"page_id": key and int(key), "record_type": kind, "n": n, "digest": said, "refers_to": to and int(to), "payload": payload if kind == "response" else None})
                            if len(got) >= 500:
                                yield pa.RecordBatch.from_pylist(got, schema)
                                got = []
                if out and any(out) or digest.hexdigest() != file["sha256"]:
                    raise ValueError(f"{file['file']} is damaged")
                yield pa.RecordBatch.from_pylist(got, schema)

    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("n", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    return manifest.repartitionByRange(max(1, manifest.count()), "file").mapInArrow(run, "page_id long, record_type string, n long, digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame, **params) -> DataFrame:
    """The columns of op10: archives are written below the shared folder and read back."""
    folder = scratch(pages.sparkSession, "warc")
    got = read(pages.sparkSession, folder, write(pages, folder, **params))
    return got.select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
