"""What several corpus operators share: word hashing, schemas, small tables; scratch tables are those of millrace.store."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import running_totals, scratch, written

__all__ = ["alnum_words", "extended", "mixed", "pieces", "running_totals", "scratch", "small", "space_words", "text_of", "word_hashes", "written"]

#: Byte classes of the two word definitions, for bytes.translate: lower-cased A-Z, separators become spaces.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SEPARATORS = {*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
_ALNUM = bytes(0x20 if b in _SEPARATORS else _LOWER[b] for b in range(256))


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, as UTF-8; a null has none."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased, as UTF-8; a null has none."""
    return text.encode("utf-8", "replace").translate(_ALNUM).split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: The lowest 0 to 8 bytes of a 64-bit value; words longer than LONG bytes are hashed one by one.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
LONG = 64


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """64-bit hashes of all the texts' space_words(), one after the other; the n + 1 places where the texts' words begin and
    end; and for each text a 128-bit digest of its words joined by spaces (None without words).

    The texts' bytes are hashed together, eight bytes of every word at a time, each step a bijection of these bytes.
    """
    parts = [t.encode("utf-8", "replace").lower() if t else b"" for t in texts]
    first = np.cumsum([0] + [len(x) + 1 for x in parts])
    joined = b" ".join([*parts, b" " * 8])
    data = np.frombuffer(joined, np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    size = ends - starts
    out = mixed(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    eights, at = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,)), np.arange(len(starts))
    for j in range(0, LONG, 8):
        at = at[size[at] > j]
        if not len(at):
            break
        piece = eights[starts[at] + j] & _LOW[np.minimum(size[at] - j, 8)]
        out[at] = mixed((out[at] ^ piece) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j + 1))
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : ends[i]])
    bounds = np.searchsorted(starts, first)
    keep = ~space
    keep[1:] |= ~space[:-1]  # every word and one space after it
    plain, place = np.where(space, np.uint8(32), data)[keep].tobytes(), np.cumsum(np.concatenate([[0], size + 1]))[bounds]
    keys = [hashlib.blake2b(plain[a:b], digest_size=16).digest() if b > a else None for a, b in zip(place[:-1], place[1:], strict=True)]
    return out, bounds, keys


def pieces(batches: Iterator[pa.RecordBatch], *texts: str, rows: int = 500, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, of at most ``rows`` rows and ``size`` bytes in the columns ``texts`` (a longer row is alone)."""
    for batch in batches:
        ends, at = np.zeros(len(batch), np.int64), 0
        for c in texts:
            ends += pc.fill_null(pc.binary_length(batch[c]), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(ends)
        while at < len(batch):
            to = int(np.searchsorted(ends, size + (ends[at - 1] if at else 0), "right"))
            to = min(max(to, at + 1), at + rows)
            yield batch.slice(at, to - at)
            at = to


def extended(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of df with further columns of the given types."""
    return T.StructType([*df.schema.fields, *(T.StructField(c, T.DataType.fromDDL(kind)) for c, kind in kinds.items())])


def small(df: DataFrame, limit: int = 100_000, most: int = 64 << 20) -> DataFrame:
    """df, written, with a broadcast hint if it has at most ``limit`` rows and about ``most`` bytes; a larger one is joined by shuffle."""
    df = written(df, "small")
    fields = [(f.name, f.dataType) for f in df.schema.fields]
    width = sum((F.coalesce(F.octet_length(n), F.lit(0)) if isinstance(t, (T.StringType, T.BinaryType)) else F.lit(32 if isinstance(t, T.StructType) else 8) for n, t in fields), F.lit(16))
    told = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if told["n"] <= limit and told["bytes"] <= most else df


def text_of(docs: DataFrame, *names: str) -> DataFrame:
    """Only those columns of docs; a column that is missing is null."""
    kinds = {"doc_id": "long", "page_id": "long", "item_id": "long"}
    return docs.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) if c in docs.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in names))
