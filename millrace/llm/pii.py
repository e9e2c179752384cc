"""Personal data: base formats by pattern, and further identifiers by bootstrapped contextual extraction.

Everything is DataFrame and SQL functions. Four formats (email, ip, card, phone) give the seeds, and a fifth, of keys and
digests, seeds secrets. Each identifier-like token is an instance with several lexical patterns, from narrow to wide: the
words on its left, the last of them with the token's shape or with what follows, the words on its right, and the
punctuation about it. Patterns and instances form a graph of distinct edges. Pattern confidence (share of trusted instances)
and instance confidence (noisy-or over patterns) are computed in turn; tokens of confident patterns that no base format covers are reported as well, under
the kind of the pattern. A secret is reported only where a confident pattern holds it, be it a seed or not. Tokens that a
base format matches and rejects (a number that fails its check digit) are no instances.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

KINDS = ("email", "ip", "card", "phone")

#: Kind of what the method alone reports beside these, and its seeds: digests, and keys by their prefixes.
SECRET = "secret"
SECRETS = r"(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})|AKIA[0-9A-Z]{16}|gh[ps]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}"

#: Leftmost non-overlapping matches of the four formats. Possessive repeats and the guard at the left (a match begins a
#: run of its characters or follows a match) change no match but keep the search linear on long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A quick test that a text can hold a match of the kind at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}

#: Identifier-like tokens: phone numbers, spaced cards, or runs without spaces and quotes that hold a digit or an at sign.
TOKEN = r"\+[0-9][ ().0-9-]+[0-9]|(?<![0-9])[0-9]{4}(?:[ -][0-9]{3,6}){2,4}(?![0-9])|(?<![A-Za-z0-9._%+@-])(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9._%+@-]{6,}+"

#: Code points of a block of text that redact() looks pieces up in.
BLOCK = 1024


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    doubled = f"cast(substring({d}, -k, 1) as int) * (2 - k % 2)"
    return f"aggregate(sequence(1, length({d})), 0, (a, k) -> a + {doubled} - if({doubled} > 9, 9, 0)) % 10 = 0"


def _valid(kind: str, m: str) -> str:
    """SQL condition: match m of a kind counts."""
    if kind == "ip":
        return f"forall(split({m}, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)"
    if kind == "card":
        return f"(length({_digits(m)}) between 14 and 19 and {_luhn(_digits(m))})"
    if kind == "phone":
        return f"length({_digits(m)}) between 10 and 15"
    return "true"


def _let(value: str, body: str, name: str) -> str:
    """SQL: body with ``name`` bound to value, which is computed once for a row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(values: str, zero: str, op: Callable[[str, str], str]) -> str:
    """SQL: running results of op over an int array, in blocks of 128, so that long arrays cost little more than short ones."""
    within = f"aggregate(slice(y, k * 128 + 1, 128), array({zero}), (a, v) -> array_append(a, {op('element_at(a, -1)', 'v')}))"
    runs = f"transform(sequence(0, (size(y) - 1) div 128), k -> slice({within}, 2, 128))"
    offsets = f"aggregate(r, array({zero}), (a, b) -> array_append(a, {op('element_at(a, -1)', 'element_at(b, -1)')}))"
    whole = _let(offsets, f"flatten(transform(r, (b, k) -> transform(b, v -> {op('o[k]', 'v')})))", "o")
    return _let(values, _let(runs, whole, "r"), "y")


def _sum(a: str, b: str) -> str:
    return f"{a} + {b}"


def _most(a: str, b: str) -> str:
    return f"greatest({a}, {b})"


def _free(spans: str, taken: str) -> str:
    """SQL: those of spans that overlap none of taken, both arrays of (s, e, ...); each may overlap its own.

    By place, with what ends latest of the taken ones up to a span, and what of them begins next after it.
    """
    both = f"array_sort(concat(transform({taken}, x -> named_struct('s', x.s, 'i', -1, 'e', x.e)), transform({spans}, (x, i) -> named_struct('s', x.s, 'i', i, 'e', x.e))))"
    latest = _running("transform(z, x -> if(x.i < 0, x.e, 0))", "0", _most)
    following = _running("transform(reverse(z), x -> if(x.i < 0, -x.s, -2147483647))", "-2147483647", _most)
    clear = "filter(transform(z, (x, j) -> if(x.i >= 0 and t[j] <= x.s and -n[size(z) - 1 - j] >= x.e, x.i, -1)), i -> i >= 0)"
    return _let(both, _let(latest, _let(following, f"transform({clear}, i -> {spans}[i])", "n"), "t"), "z")


def _located(df: DataFrame, text: str, pattern: str, needs: str, out: str) -> DataFrame:
    """Adds array ``out`` of (s, e, m, left, right): matches with code point offsets and up to 40 characters of text on either side."""
    rx, test = pattern.replace("'", "\\'"), needs
    item = "named_struct('s', e[i] - char_length(m), 'e', e[i], 'm', m, 'left', right(g[i], 40), 'right', left(g[i + 1], 40))"
    ends = _running("transform(l, (m, i) -> char_length(m) + char_length(g[i]))", "0", _sum)
    found = _let(f"regexp_extract_all({text}, r'{rx}', 0)", _let(f"split({text}, r'{rx}', -1)", _let(ends, f"transform(l, (m, i) -> {item})", "e"), "g"), "l")
    none = "cast(array() as array<struct<s:int,e:int,m:string,left:string,right:string>>)"
    return df.withColumn(out, F.expr(f"if({text} rlike r'{test}' and {text} rlike r'{rx}', {found}, {none})"))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column ``base``: array of (s, e, kind, m), by start and then kind; null texts count as empty."""
    df = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    for kind in KINDS:
        df = _located(df, "_t", PATTERNS[kind], NEEDS[kind], f"_{kind}")
    parts = [
        f"transform(filter(_{kind}, x -> {_valid(kind, 'x.m')}), x -> named_struct('s', x.s, 'k', {i}, 'e', x.e, 'kind', '{kind}', 'm', x.m))"
        for i, kind in enumerate(KINDS)
    ]
    df = df.withColumn("base", F.expr(f"transform(array_sort(concat({', '.join(parts)})), x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind, 'm', x.m))"))
    return df.drop("_t", *(f"_{kind}" for kind in KINDS))


def occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """Identifier-like tokens of all distinct texts: text_key, s, e, instance, and patterns, an array."""
    df = docs.filter(F.col(text).rlike("[0-9@]")).select(F.col(text).alias("_t"), F.md5(text).alias("text_key"))
    df = _located(df, "_t", TOKEN, "[0-9@]", "_x").select("text_key", F.explode("_x").alias("x"))
    df = df.select("text_key", "x.s", "x.e", F.col("x.m").alias("instance"), *(F.regexp_replace(F.lower(F.col(f"x.{c}")), "[0-9]+", "9").alias(c) for c in ("left", "right")))
    word = F.regexp_extract("left", r"([\p{L}\p{N}_]+[^\p{L}\p{N}_]*+)$", 1)
    signs = F.concat(F.regexp_extract("left", r"([^\p{L}\p{N}_]*+)$", 1), F.lit("*"), F.regexp_extract("right", r"^([^\p{L}\p{N}_]*+)", 1))
    shape = F.left(F.regexp_replace(F.regexp_replace("instance", "[0-9]+", "9"), "[A-Za-z]+", "a"), F.lit(24))
    near = F.when(word != "", word)
    every = F.array_compact(F.array(
        F.concat(F.lit("words:"), F.regexp_extract("left", r"(\S++\s+\S+\s*)$", 1)),
        F.concat(F.lit("word:"), near),
        F.concat(F.lit("shape:"), near, shape),
        F.concat(F.lit("follows:"), near, F.lit("*"), F.regexp_extract("right", r"^\s*+(\S+)", 1)),
        F.concat(F.lit("after:*"), F.nullif(F.regexp_extract("right", r"^(\s++\S++\s++\S++)\s", 1), F.lit(""))),
        F.when(F.length(F.regexp_replace(signs, r"\s", "")) > 2, F.concat(F.lit("signs:"), signs)),
    ))
    return df.select("text_key", "s", "e", "instance", F.filter(every, lambda p: p != "words:").alias("patterns")).distinct()


def known(instance: str = "instance") -> Column:
    """The kind of a token that is a whole match of a base format, or a secret by its form; null for others."""
    base = [F.when(F.expr(f"regexp_like({instance}, r'^(?:{PATTERNS[k]})$') and {_valid(k, instance)}"), F.lit(k)) for k in KINDS]
    return F.coalesce(*base, F.when(F.expr(f"regexp_like({instance}, r'^(?:{SECRETS})$')"), F.lit(SECRET)))


def discover(found: DataFrame, rounds: int = 3, min_support: int = 3, min_pattern: float = 0.7, min_instance: float = 0.8, hidden: Column | None = None) -> DataFrame:
    """Instances that confident patterns give a kind: instance, kind, score. Seeds of the base kinds are left out.

    found: occurrences(). A pattern needs min_support distinct instances. Each round's scores are aggregates over
    distinct (pattern, instance) edges, so that neither copies of a text nor a frequent pattern weigh more. Instances for
    which ``hidden`` holds are no seeds, whatever their form; see found_again().
    """
    refused = F.expr(" or ".join(f"regexp_like(instance, r'^(?:{PATTERNS[k]})$')" for k in KINDS)) & F.col("kind").isNull()
    edges = found.select(F.explode("patterns").alias("pattern"), "instance").distinct().withColumn("kind", known()).filter(~refused)
    if hidden is not None:
        edges = edges.withColumn("kind", F.when(~hidden, F.col("kind")))
    edges = written(edges, "pii-edges")
    seeds = written(edges.filter("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(1.0)), "pii-seeds")
    support = written(edges.groupBy("pattern").agg(F.count("*").alias("support")).filter(F.col("support") >= min_support), "pii-support")
    edges, scores = edges.select("pattern", "instance").join(support.select("pattern"), "pattern", "left_semi"), seeds
    for _ in range(rounds):
        sums = edges.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("trusted"))
        patterns = sums.join(support, "pattern").withColumn("confidence", F.col("trusted") / F.col("support"))
        patterns = patterns.filter(F.col("confidence") >= min_pattern)
        told = edges.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1.0001 - F.col("confidence"))))).alias("score"))
        told = written(told.filter(F.col("score") >= min_instance), "pii-told")
        scores = written(seeds.unionByName(told.join(seeds.select("instance"), "instance", "left_anti")), "pii-scores")
    return told.join(seeds.filter(F.col("kind") != SECRET).select("instance"), "instance", "left_anti")


def found_again(docs: DataFrame, text: str = "text", share: int = 10, **params) -> DataFrame:
    """kind, hidden, told, right: how well contexts alone find identifiers. A share-th of the known distinct identifiers, by
    hash, are kept from the seeds; told are those of them that confident patterns give any kind, right those given theirs. What is
    hidden counts against the patterns that hold it, as any token of unknown kind; a large share lowers all confidences."""
    found, apart = written(occurrences(docs, text), "pii-tokens"), F.pmod(F.xxhash64("instance"), F.lit(share)) == 0
    held = found.filter(apart).select("instance").distinct().withColumn("kind", known()).filter("kind is not null")
    best = discover(found, hidden=apart, **params).groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("given"))
    both = held.join(best, "instance", "left")
    return both.groupBy("kind").agg(F.count("*").alias("hidden"), F.count("given").alias("told"), F.count_if(F.col("given") == F.col("kind")).alias("right"))


def find(docs: DataFrame, text: str = "text", **params) -> DataFrame:
    """docs with columns ``base`` and ``spans``, arrays of (s, e, kind, m) with code point offsets, end exclusive.

    spans holds the base spans and those that the method adds; added ones overlap no base span. Null and empty texts have
    none; equal texts get equal spans, whatever their ids; other columns of docs are kept (names that begin with "_",
    and base, spans, text_key are reserved).
    """
    found = written(occurrences(docs, text), "pii-tokens")
    extra = found.select("text_key", "s", "e", "instance").join(discover(found, **params), "instance")
    extra = extra.groupBy("text_key").agg(F.collect_set(F.struct("s", "e", "kind", F.col("instance").alias("m"))).alias("_extra"))
    extra = small(extra, 1_000_000)
    df = base_spans(docs.drop("base", "spans", "text_key"), text).withColumn("text_key", F.md5(text)).join(extra, "text_key", "left")
    free = _free("_extra", "base")
    rank = " ".join(f"when '{k}' then {i}" for i, k in enumerate((*KINDS, SECRET)))
    every = f"transform(concat(base, {free}), x -> named_struct('s', x.s, 'k', case x.kind {rank} end, 'e', x.e, 'kind', x.kind, 'm', x.m))"
    spans = F.expr(f"if(_extra is null, base, transform(array_sort({every}), x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind, 'm', x.m)))")
    return df.withColumn("spans", spans).drop("_extra", "text_key")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """find()'s rows with each span of the text, overlapping ones together, replaced by its kind in brackets."""
    first = "filter(sequence(0, size(spans) - 1), i -> i = 0 or m[i - 1] <= spans[i].s)"  # where what overlaps begins
    merged = "transform(f, (i, j) -> named_struct('s', spans[i].s, 'e', m[if(j + 1 < size(f), f[j + 1], size(m)) - 1], 'kind', spans[i].kind))"
    merge = _let(_running("transform(spans, x -> x.e)", "0", _most), _let(first, merged, "f"), "m")
    df = found.withColumn("_r", F.expr(f"if(size(spans) > 0, {merge}, null)"))

    def piece(start: str, end: str) -> str:
        """From blocks x of the text, so that no piece costs a way through all that is before it."""
        one = f"substring(x[p.a div {BLOCK}], p.a % {BLOCK} + 1, p.b - p.a)"
        between = f"array_join(slice(x, p.a div {BLOCK} + 2, (p.b - 1) div {BLOCK} - p.a div {BLOCK} - 1), '')"
        more = f"concat(substring(x[p.a div {BLOCK}], p.a % {BLOCK} + 1), {between}, substring(x[(p.b - 1) div {BLOCK}], 1, (p.b - 1) % {BLOCK} + 1))"
        return _let(f"named_struct('a', {start}, 'b', {end})", f"if(p.b <= p.a, '', if(p.a div {BLOCK} = (p.b - 1) div {BLOCK}, {one}, {more}))", "p")

    pieces = f"transform(_r, (y, i) -> concat({piece('if(i = 0, 0, _r[i - 1].e)', 'y.s')}, '[', upper(y.kind), ']'))"
    rest = piece("element_at(_r, -1).e", f"char_length({text})")
    whole = _let(f"regexp_extract_all({text}, r'(?s).{{1,{BLOCK}}}+', 0)", f"concat(array_join({pieces}, ''), {rest})", "x")
    return df.withColumn(text, F.expr(f"if(_r is null, {text}, {whole})")).drop("_r")


def digest(found: DataFrame) -> DataFrame:
    """The columns of op1 from find()'s rows."""
    said = "array_join(transform({0}, x -> concat_ws(':', x.kind, x.s, x.e)), ',')"
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.expr(said.format("base")), 256).alias("base_sha256"), F.expr(said.format("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.expr("cast(size(spans) - size(base) as long)").alias("n_added"))
