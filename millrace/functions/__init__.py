"""Column functions shared by operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"^[^@ ]+@[^@ ]+[.][^@ ]+$"

#: Ordinal, HTTP code, code of the known exceptions.
EXCEPTIONS = [(1, 500, "990"), (2, 500, "991"), (3, 500, "992")]


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of the products of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit_vector(a: Column | str) -> Column:
    """The array divided by its length; null if it has none."""
    a = F.col(a) if isinstance(a, str) else a
    length = F.sqrt(dot(a, a))
    return F.when(length > 0, F.zip_with(a, F.array_repeat(length, F.size(a)), lambda x, n: x.cast("double") / n))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; null if either has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def errors_message(errors: Column | str) -> Column:
    """An array of (loc, msg) as one text: '<last of loc>': msg, joined by commas; no loc is 'unknown'; none is ''."""
    say = lambda e: F.concat(F.lit("'"), F.coalesce(F.try_element_at(e["loc"], F.lit(-1)), F.lit("unknown")), F.lit("': "), e["msg"])
    return F.coalesce(F.array_join(F.transform(errors, say), ", "), F.lit(""))


def envelope(code: Column, message: Column, data: Column) -> Column:
    """The response envelope as JSON; a null code or message is an empty text."""
    return F.to_json(F.struct(F.coalesce(code, F.lit("")).alias("code"), F.coalesce(message, F.lit("")).alias("message"), data.alias("data")), {"ignoreNullFields": "false"})


def http_defaults(http_code: Column, code: Column) -> tuple[Column, Column]:
    """HTTP code (500 where missing or 0) and code (the HTTP code as text where missing or empty)."""
    http = F.when(http_code.isNull() | (http_code == 0), F.lit(500)).otherwise(http_code)
    return http, F.when(code.isNull() | (code == ""), http.cast("string")).otherwise(code)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Hexadecimal HMAC-SHA256 of a text in UTF-8."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def time_id(prefix: str, ts: Column) -> Column:
    """An id of a prefix and a time's milliseconds since 1970."""
    return F.concat(F.lit(f"{prefix}-"), F.unix_millis(ts.cast("timestamp")).cast("string"))


def stem(filename: Column) -> Column:
    """A file name without its last three characters."""
    return F.left(filename, F.greatest(F.length(filename) - 3, F.lit(0)))


def intent(text: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The label of the first rule (label, pattern) that a text matches."""
    out = F.lit(None).cast("string")
    for label, pattern in reversed(rules):
        out = F.when(F.lower(text).rlike(pattern), F.lit(label)).otherwise(out)
    return F.coalesce(out, F.lit(other))


def includes(text: Column, must: Column, must_not: Column) -> Column:
    """All phrases of must and none of must_not occur in the text."""
    text = F.coalesce(text, F.lit(""))
    return F.forall(must, lambda x: F.contains(text, x)) & ~F.exists(must_not, lambda x: F.contains(text, x))


def strip_tags(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags become spaces, runs of white space one space."""
    text = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
