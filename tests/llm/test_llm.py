"""Operators against brute force, round trips, and the cases every operator must bear."""

import base64
import gzip
import hashlib
import json
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, decontaminate, flac, language, licenses, mixing, near_dedup, pii, quality, queries, tokens, warc
from millrace.llm.queries import RANKS

random.seed(5)
WORDS = [f"w{i}" for i in range(60)]
say = lambda n: " ".join(random.choice(WORDS) for _ in range(n))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, base string, copies int"


def docs_of(spark, texts):
    """Documents with columns that clash with operators' own."""
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}" if i % 5 else None, 0, "x", "y", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


ODD = [None, "", " ", "\n\t", "é", "a", "A b", "x" * 50_000, "1 " * 5_000]


def links(sets, percent):
    n, root = len(sets), list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_near_dedup_brute_force(spark):
    passage, texts = say(70), list(ODD)
    for _ in range(12):
        words = say(random.choice([4, 30, 120])).split()
        texts += [" ".join(words)] * random.choice([1, 2, 9])
        for _ in range(6):
            other = list(words)
            for _ in range(random.choice([0, 1, 3])):
                other[random.randrange(len(other))] = random.choice(WORDS)
            texts.append(" ".join(other))
    texts += [passage + " " + say(random.choice([5, 10, 40])) for _ in range(40)]
    got = {r.doc_id: r for r in near_dedup.kept(docs_of(spark, texts), 3, 85).collect()}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set())
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == links(sets, 85)
    assert all(r.kept == (r.component_id == r.doc_id) for r in got.values())


def test_near_dedup_odd_rows(spark):
    t = say(30)
    rows = spark.createDataFrame([(None, t), (5, t), (5, t), (7, None), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in near_dedup.classes(rows).collect())
    assert got == [(-1, -1), (-1, 5), (5, 5), (5, 5), (7, 7)], got
    assert near_dedup.classes(rows.limit(0)).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    out = []
    for k, (kind, rx) in enumerate(BASE.items()):
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out)]


def test_pii_brute_force(spark):
    bits = ["4539 1488 0343 6467", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "a.b@c.d-e.co", "@x", "a@b", "x@y.z@u.v", "+1 (555) 010-9999", "+1 2", "é😀", "12345678901234", "..", "call", "-", "\n", "0000.1.1.1", "%a@b.c%d@e.f", "+44 20 7946 0958 1234 5678"]
    texts = ODD + ["".join(random.choice(bits) + random.choice(["", " ", ","]) for _ in range(random.choice([1, 5, 400]))) for _ in range(60)]
    got = {r.doc_id: r for r in pii.digest(pii.find(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = base(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(filter(None, got[i].spans.split(",")))
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]
    assert pii.find(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_pii_discovers_and_redacts(spark):
    # Patterns that hold addresses elsewhere give the broken ones a kind.
    texts = [f"please write to user{i}@mail.example for help" for i in range(9)] + ["please write to user77@localhost for help", "nothing at all 12"]
    out = {r.doc_id: r for r in pii.redact(pii.find(docs_of(spark, texts))).collect()}
    assert out[0].text == "please write to [EMAIL] for help"
    assert out[9].text == "please write to [EMAIL] for help" and out[9].base == []
    assert out[10].text == texts[10]


def test_language(spark):
    texts = ODD + [random.choice(["der die das und nicht", "the and of that with"]) + " " + str(i) for i in range(80)]
    rows = [(i, t, None if i % 7 == 0 else "de" if t and t.startswith("der") else "en") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predict(docs, language.fit(docs, ~language.held_out())).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 8)] == ["und"] * 5 and got[0].score == 0
    assert all(got[i].lang_pred == ("de" if t.startswith("der") else "en") for i, t in enumerate(texts) if i >= len(ODD))
    assert language.fit(docs.limit(0)) is None and {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
    code = language.codewords(12)
    assert min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i]) >= 10


def test_quality(spark):
    good = lambda: " ".join(random.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(40))
    texts = ODD + [good() if i % 3 else "$$$ !!! " * 30 + "\n" + good() for i in range(150)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int((i - len(ODD)) % 3 > 0), 0) for i in range(len(ODD), len(texts))] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.predict(docs, quality.fit(docs, labels, ~quality.held_out())).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].predicted == int((i - len(ODD)) % 3 > 0) for i in range(len(ODD), len(texts))]) > 0.95
    assert quality.fit(docs, labels.limit(0)) is None


def test_quality_sample_bears_long_documents(spark, monkeypatch):
    draws = spark.range(40).select("id", F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1_000_000)).alias("d")).orderBy("d").collect()
    first, seen = draws[0].id, []
    docs = spark.createDataFrame([(i, "x\n" * 70_000 if i == first else say(9)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "train", lambda bags, y, prior: seen.append((sorted(map(len, bags)), sorted(y))) or "model")
    assert quality.fit(docs, labels) == "model"
    assert seen == [([1] * 39 + [64], [0] * 20 + [1] * 20)]


def test_attention_gradient():
    """The fit's derivatives agree with differences: loss falls on separable bags."""
    rng = np.random.default_rng(1)
    bags = [np.concatenate([rng.normal(0, 1, (4, 6)), rng.normal(3 * y, 0.2, (1, 6))]).astype(np.float32) for y in (0, 1) * 40]
    p, attention = quality.train(bags, np.array((0, 1) * 40, np.float32), 0.5, epochs=60).score(bags)
    assert ((p > 0.5) == np.array((0, 1) * 40)).mean() > 0.9 and all(abs(a.sum() - 1) < 1e-4 for a in attention)


def test_mixing_targets(spark):
    for case in ([("a", 10), ("b", 1000), (None, 5), ("c", 0)], [("x", 7)], [(f"s{i}", random.randrange(1, 999)) for i in range(11)]):
        got = {r.source: r for r in mixing.targets(spark.createDataFrame(case, "source string, size long")).collect()}
        names = sorted((k for k, _ in case if k is not None)) + [None] * any(k is None for k, _ in case)
        w, size = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}, dict(case)
        want, total = dict.fromkeys(names, 0.0), 1.5 * sum(size.values())
        open_ = set(names)
        while True:
            rest = total - sum(2 * size[k] for k in names if k not in open_)
            share = {k: rest * w[k] / sum(w[j] for j in open_) for k in open_}
            above = {k for k in open_ if share[k] > 2 * size[k]}
            if not above:
                break
            open_ -= above
        want = {k: share[k] if k in open_ else 2 * size[k] for k in names}
        assert {k: got[k].target for k in names} == pytest.approx(want, abs=1e-5)


def test_mixing_rows(spark):
    docs = docs_of(spark, ODD + [say(20) for _ in range(300)])
    plan = mixing.planned(docs)
    assert plan.count() == docs.count()
    for r in plan.groupBy("source").agg({"target": "max"}).collect():
        taken = sum(x.size * x.copies for x in plan.filter(plan.source.eqNullSafe(r[0])).collect())
        assert abs(taken - r[1]) < 0.25 * r[1] + 3
    assert mixing.mixed(docs).count() == plan.selectExpr("sum(copies)").first()[0]
    assert mixing.planned(docs.limit(0)).count() == 0


def test_decontaminate_brute_force(spark):
    items = [say(13), say(30), say(5), "W1", None, "", say(14)]
    texts = ODD + [say(40), say(3) + " " + items[0] + "! " + say(4), items[1][40:90], items[2].upper(), "x" + items[0], items[6] + " " + items[6]]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, say(4))], "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for set_bytes in (2_000_000, 200):
        got = {r.doc_id: r for r in decontaminate.scan(docs_of(spark, texts), bench, set_bytes=set_bytes).collect()}
        for i, t in enumerate(texts):
            w, hit, found = words(t), set(), set()
            for k, item in enumerate(items):
                v = words(item)
                n = min(13, len(v))
                grams = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if v else set()
                for a in range(len(w) - n + 1):
                    if tuple(w[a : a + n]) in grams:
                        hit |= set(range(a, a + n))
                        found.add(k)
            assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(w), len(hit), sorted(found)), t
            assert got[i].contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_licenses_brute_force(spark):
    texts = ODD + ["CC-BY cc by cc by", "All rights reserved. GNU General Public License!", "all rights all rights reserved", "Licensed under CC BY-NC 4.0.", "Released under MIT License", "released under the the mit license", "general public", "the Kelvin K cc by"]
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = sorted((a, label) for label, p in licenses.PHRASES for a in range(len(w)) if w[a : a + len(p.split())] == p.split())
        assert (got[i].n_words, got[i].n_base) == (len(w), len(at)), t
        assert got[i].base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(","))
        assert (got[i].first_word, got[i].last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
    assert "cc-by-nc-4.0" in got[len(ODD) + 3].labels and "mit" in got[len(ODD) + 4].labels and "mit" in got[len(ODD) + 5].labels


@pytest.mark.parametrize("n", [192, 384, 4608, 9999])
def test_flac_round_trip(n):
    for lpc in (0, 3):
        for payload in (bytes(random.choice(b"abc  \xc3\xa9") for _ in range(n)), b" " * n, random.randbytes(n)):
            stream = flac.encode(payload, 1000, lpc)
            blocks = flac.decode([stream])[0]
            assert b"".join((x[0] + 128).astype(np.uint8).tobytes() for _, x in blocks) == payload
            assert flac.decode([stream], n - 1)[0][-1][0] == (n - 1) // 1000 * 1000
    broken = bytearray(stream)
    broken[-20] ^= 1
    with pytest.raises(flac.BadStream):
        flac.decode([bytes(broken)])


def test_flac_column(spark):
    texts = ODD + [say(3000)]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in flac.digest(docs).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b.ljust(max(1, -(-len(b) // 192)) * 192)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(b), len(p), hashlib.sha256(p).hexdigest())
    rows = flac.pcm(flac.stored(docs.filter("doc_id = 9").select("doc_id", "text")), 5000).orderBy("sample_offset").collect()
    assert rows[0].sample_offset == 4608 and rows[0].n_samples == 4608


def test_flac_media_is_stored_and_read_back(spark, monkeypatch):
    wrote = []
    monkeypatch.setattr(flac, "written", lambda df, name, **options: wrote.append(common.written(df, name, **options)) or wrote[-1], raising=False)
    docs = docs_of(spark, [*ODD, say(3000), say(3000)])
    docs = docs.unionByName(docs.filter("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    out = flac.digest(docs)
    assert len(wrote) == 1 and set(out.inputFiles()) == set(wrote[0].inputFiles())
    kept = [(r.doc_id, hashlib.sha256(r.media).hexdigest()) for r in wrote[0].collect()]
    assert sorted(kept, key=str) == sorted(((r.doc_id, r.media_sha256) for r in out.collect()), key=str) and len(kept) == len(ODD) + 3
    lost = flac.measured(wrote[0].withColumn("media", F.when(F.col("doc_id") != 1, F.col("media")))).filter("payload_bytes is null")
    assert sorted(str(r.doc_id) for r in lost.collect()) == ["1", "None"]


def test_flac_fitted_predictors(spark):
    text = "".join(chr(64 + int(50 * np.sin(i * 1.2) + random.random())) for i in range(4608))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    fixed, fitted = (flac.digest(docs, lpc=lpc).first() for lpc in (0, 8))
    assert fitted.media_bytes < fixed.media_bytes and fitted.payload_sha256 == fixed.payload_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_warc_round_trip(spark):
    html = [None, "", "short", "short", "x" * 100, "x" * 100, "é" * 60, "é" * 60, "y" * 40_000]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h, 1) for i, h in enumerate(html)] + [(None, None, "x" * 100, 1), (20, None, "z" * 200, 1), (20, None, "z" * 200, 1)], "page_id long, url string, html string, digest int")
    got = sorted(((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages, roll=300).collect()), key=str)
    want = [(0, 0, "response", None), (1, 0, "response", None), (2, 5, "response", None), (3, 5, "response", None), (4, 100, "response", None), (5, 100, "revisit", 4), (6, 120, "response", None), (7, 120, "revisit", 6), (8, 40_000, "response", None), (-1, 100, "revisit", 4), (20, 200, "response", None), (20, 200, "response", None)]
    assert got == sorted(want, key=str)


def test_warc_ids_and_rolling(spark, monkeypatch):
    rows = [(1, "http://a", "x" * 150), (1, "http://a", "x" * 150), (1, "http://b", "x" * 150), (2, None, "x" * 150), (None, None, "")] * 2 + [(i, f"http://h/{i}", say(60)) for i in range(10, 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for many in (warc.MANY_FILES, 1):  # first keys in the tasks, and keys joined
        monkeypatch.setattr(warc, "MANY_FILES", many)
        folder = common.scratch(spark, "t")
        done = {r.file: r for r in warc.write(pages, folder, roll=1500).collect()}
        ids, said = [], (Path(folder.removeprefix("file://")) / "MANIFEST.json").read_text().splitlines()
        for name, r in done.items():
            data = (Path(folder.removeprefix("file://")) / name).read_bytes()
            assert len(data) == r.bytes and hashlib.sha256(data).hexdigest() == r.sha256
            ids += re.findall(rb"WARC-Record-ID: (\S+)", gzip.decompress(data))
        assert len(ids) == len(set(ids)) == len(rows) and len(done) > 3
        assert [json.loads(x)["file"] for x in said[1:]] == sorted(done) and json.loads(said[0])["records"] == len(rows)
        assert not list((Path(folder.removeprefix("file://")) / "_temporary").iterdir())


def test_warc_files_do_not_depend_on_partitions(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", say(50)) for i in range(60)], "page_id long, url string, html string")
    sums = []
    for parts in (1, 5):
        folder = common.scratch(spark, "t")
        sums.append(sorted((r.file, r.sha256) for r in warc.write(pages.repartition(parts), folder, roll=2000).collect()))
    assert sums[0] == sums[1] and len(sums[0]) > 3
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_token_rollup(spark):
    docs = docs_of(spark, ODD + ["hello world <|endoftext|>", "hello world"])
    store = tokens.Rollup(spark, common.scratch(spark, "rollup"))
    changes = tokens.inserts(docs, RANKS, "v1")
    assert store.commit("a", changes) and not store.commit("a", changes)
    total = lambda: sum(r.n_tokens for r in store.totals().collect())
    want = {r.doc_id: r.n_tokens for r in changes.collect()}
    assert want[0] == want[1] == 0 and total() == sum(want.values())
    more = spark.createDataFrame([("revise", 10, "s1", "fr", "v1", 50), ("delete", 9, None, None, "v1", None), ("delete", 99, None, None, "v1", None)], "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long")
    store.commit("b", more)
    assert total() == sum(want.values()) - want[9] - want[10] + 50
    assert {r.doc_id: r.n_tokens for r in store.current().collect()} == {**{k: v for k, v in want.items() if k != 9}, 10: 50}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    bench = say(20)
    texts = ["", None, "12 34"] + [say(60) + f" mail a{i}@b.example now" for i in range(30)] + [bench + " " + say(10), "keep " + say(40)]
    texts += [texts[5]] * 3
    docs_of(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = common.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in docs.collect()) == [*range(3, 33), 34]
    assert all("[EMAIL]" in r.text and r.n_chars == len(r.text) for r in docs.collect() if r.doc_id < 33)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {*range(3, 33), 34}


def test_near_dedup_words_of_equal_polynomials(spark):
    """The Thue-Morse word over a and b and its complement have equal polynomial hashes modulo 2**64, and nothing in common."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(512))
    other = word.translate(str.maketrans("ab", "ba"))
    got = {r.doc_id: r for r in near_dedup.kept(spark.createDataFrame([(1, word), (2, other), (3, word.upper())], "doc_id long, text string"), 3, 85).collect()}
    assert [got[i].component_id for i in (1, 2, 3)] == [1, 2, 1]


def test_components_of_a_long_chain(spark):
    links = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = near_dedup.components(links)
    assert got.count() == 1000 and got.filter("root <> 0").count() == 0  # all but the root itself


def test_near_dedup_group_about_the_threshold(spark):
    """A large group whose members' changes leave some just above and some just below the threshold to all others."""
    text, rng, texts = say(160).split(), random.Random(2), []
    for _ in range(150):
        w = list(text)
        for i in rng.sample(range(len(w)), rng.choice([0, 1, 3, 5, 7])):
            w[i] = f"c{rng.random()}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(158)} for t in texts]
    want = links(sets, 85)
    got = {r.doc_id: r.component_id for r in near_dedup.kept(docs_of(spark, texts), 3, 85).collect()}
    assert [got[i] for i in range(len(texts))] == want and 1 < len(set(want)) < 150


def test_deduplicated_keeps_one_row_of_each_group(spark):
    t, other = say(30), say(40)
    rows = [(None, t, 1), (None, t, 1), (3, t, 2), (3, t, 2), (3, other, 3), (None, "solo words here", 4), (None, "solo words here", 4), (8, None, 5), (8, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted(((r.doc_id, r.text, r.node) for r in near_dedup.deduplicated(docs).collect()), key=str)
    assert got == sorted([(3, t, 2), (3, other, 3), (None, "solo words here", 4), (8, None, 5), (8, "", 5)], key=str)


def test_letters_are_letters(spark):
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(["the and of", "der die das", "½ ²", "Ⅷ 12", "_", "ß"] * 9)], "doc_id long, text string, lang string")
    got = {r.text: (r.lang_pred, r.score) for r in language.predict(docs, language.fit(docs)).collect()}
    assert [got[t] for t in ("½ ²", "Ⅷ 12", "_")] == [("und", 0.0)] * 3 and got["ß"][0] != "und"


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = queries.op4_language(spark, sf).filter("held_out and lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null")
    assert got.count() > 150 and got.filter("lang_pred = lang").count() / got.count() > 0.97
    got = queries.op5_quality(spark, sf).filter("held_out").join(labels.select("doc_id", "quality"), "doc_id")
    assert got.count() > 50 and got.filter("predicted = quality").count() / got.count() > 0.95


def test_one_label_for_one_licence(spark):
    texts = ["This page is licensed under CC BY 4.0.", "This page is licensed under CC BY-NC 4.0.", "This page is licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0. And so on. Licensed under CC BY-SA 4.0.", "a\nb"]
    got = {r.doc_id: r.labels for r in licenses.digest(licenses.scan(docs_of(spark, texts))).collect()}
    assert [got[i] for i in range(5)] == ["cc-by,cc-by-4.0", "cc-by,cc-by-nc-4.0", "cc-by,cc-by-sa-4.0", "cc-by,cc-by-4.0,cc-by-sa-4.0", ""]
    assert licenses.scan(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_pii_secrets_by_their_context(spark):
    rng = random.Random(4)
    digest = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(39)) + "a1"[rng.random() < 0.5]
    texts = [f'{say(3)} token = "{digest()}" {say(2)}' for _ in range(8)] + ['then token = "Zm9vYmFyLTEyMzQ1" end', f"commit {digest()} went in", "card 4539 1488 0343 6468 no"]
    found = pii.find(docs_of(spark, texts))
    got = {r.doc_id: r for r in found.collect()}
    assert [[x.kind for x in got[i].spans] for i in range(11)] == [["secret"]] * 9 + [[], []] and not any(r.base for r in got.values())
    assert got[8].spans[0].m == "Zm9vYmFyLTEyMzQ1"
    told = {r.doc_id: r for r in pii.digest(found).collect()}
    assert told[8].n_spans == told[8].n_added == 1 and told[8].spans == "secret:14:30"


def test_pii_scores_brute_force(spark):
    """The graph's scores on a small corpus, beside a direct count in Python."""
    texts = [f"mail {say(1)} a{i}@b.example x" for i in range(6)] + [f"see {say(1)} v{i}.7 y" for i in range(3)] + ["mail w1 bob9 x", "see w2 +1 555 010 9999 y"]
    found = pii.occurrences(docs_of(spark, texts)).collect()
    edges = {(p, r.instance) for r in found for p in r.patterns if p}
    is_email = lambda m: re.fullmatch(BASE["email"], m)
    kinds = {m: "email" if is_email(m) else "phone" if m.startswith("+") else None for _, m in edges}
    held = {}
    for p, m in edges:
        held.setdefault(p, set()).add(m)
    held = {p: ms for p, ms in held.items() if len(ms) >= 3}
    scores = {m: (k, 1.0) for m, k in kinds.items() if k}
    for _ in range(3):
        sure = {(p, k): sum(s for m in ms for kk, s in [scores.get(m, (None, 0))] if kk == k) / len(ms) for p, ms in held.items() for k in ("email", "phone")}
        new = {}
        for m in kinds:
            for k in ("email", "phone"):
                miss = np.prod([1.0001 - sure[p, k] for p, ms in held.items() if m in ms and sure[p, k] >= 0.7])
                if not kinds[m] and 1 - miss >= 0.8:
                    new[m] = (k, 1 - miss)
        scores = {m: (k, 1.0) for m, k in kinds.items() if k} | new
    got = {r.instance: (r.kind, pytest.approx(r.score, abs=1e-6)) for r in pii.discover(pii.occurrences(docs_of(spark, texts))).collect()}
    assert got == {m: v for m, v in scores.items() if not kinds[m]}


def test_flac_columns_brute_force(spark):
    texts = ODD + [say(5000), "ab" * 4000]
    docs = docs_of(spark, texts)
    docs = docs.unionByName(docs)
    rows = flac.digest(docs).collect()
    assert len(rows) == 2 * len(texts) and flac.digest(docs.limit(0)).count() == 0
    for r in rows:
        p = (texts[r.doc_id] or "").encode()
        p = p.ljust(max(1, -(-len(p) // 192)) * 192)
        x, stream = np.frombuffer(p, np.uint8).astype(int) - 128, flac.encode(p)
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(p[-16:]), len(stream), hashlib.sha256(stream).hexdigest())
        blocks, mean, steps, turns = r.feature.split(":")
        assert int(blocks) == -(-len(p) // flac.BLOCK) and float(mean) == pytest.approx(x.mean(), abs=1e-4) and float(steps) == pytest.approx(np.abs(np.diff(x)).sum() / len(x), abs=1e-4)
        assert float(turns) == pytest.approx(np.count_nonzero(np.diff(x < -32)) / len(x), abs=1e-4)


def test_flac_foreign_streams():
    """Frames that the encoder doesn't write: side and mid channels, escaped and several partitions, wasted bits, 5-bit parameters."""
    b, n = flac._bits, 192
    rng = np.random.default_rng(3)
    left, right = rng.integers(-90, 90, n), rng.integers(-90, 90, n)

    def verbatim(x, depth, wasted=0):
        head = [b(0, 1), b(1, 6), b(1, 1), *([b(0, 1)] * (wasted - 1)), b(1, 1)] if wasted else [b(0, 1), b(1, 6), b(0, 1)]
        return np.concatenate(head + [b(int(v) >> wasted & (1 << depth - wasted) - 1, depth - wasted) for v in x])

    def parted(x, method, escaped):
        """Order 0 predictor, two partitions; the second escaped if so."""
        out, width = [b(0, 1), b(8, 6), b(0, 1), b(method, 2), b(1, 4)], 4 + method
        for i, part in enumerate((x[: n // 2], x[n // 2 :])):
            if escaped and i:
                out += [b((1 << width) - 1, width), b(9, 5), *(b(int(v) & 511, 9) for v in part)]
            else:
                out.append(b(4, width))
                for v in (int(v) for v in part):
                    u = (v << 1) ^ (v >> 63)
                    out += [b(1, (u >> 4) + 1), b(u & 15, 4)]
        return np.concatenate(out)

    def stream(channels, code, subframes):
        head = bytes([0xFF, 0xF8, 1 << 4, code << 4 | 1 << 1, 0])
        body = head + bytes([flac.crc8(head)]) + np.packbits(np.concatenate(subframes)).tobytes()
        info = n.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | channels - 1 << 41 | 7 << 36 | n).to_bytes(8, "big") + bytes(16)
        return b"fLaC" + bytes([0x80, 0, 0, 34]) + info + body + flac.crc16(body).to_bytes(2, "big")

    read = lambda s: flac.decode([s])[0][0][1].tolist()
    side, mid = left - right, (left + right) >> 1
    both = [left.tolist(), right.tolist()]
    assert read(stream(2, 1, [verbatim(left, 8), verbatim(right, 8)])) == both
    assert read(stream(2, 8, [verbatim(left, 8), parted(side, 0, False)])) == both
    assert read(stream(2, 9, [parted(side, 1, True), verbatim(right, 8)])) == both
    assert read(stream(2, 10, [parted(mid, 1, False), parted(side, 0, True)])) == both
    assert read(stream(1, 0, [verbatim(left // 4 * 4, 8, 2)])) == [(left // 4 * 4).tolist()]


def test_rollup_counts_and_compaction(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(c) for a, c in (x.split() for x in Path(RANKS.removeprefix("file://")).read_bytes().splitlines() if x.strip())}
    coder = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ODD + [f" {say(9)} " for _ in range(20)]
    docs, want = docs_of(spark, texts), {}
    docs = docs.unionByName(docs.filter("doc_id = 12"))
    count = lambda t: len(coder.encode_ordinary(t or ""))
    store = tokens.Rollup(spark, common.scratch(spark, "rollup"))
    store.commit("a", tokens.inserts(docs, RANKS, "v"))
    store.commit("b", tokens.inserts(docs.filter("doc_id in (10, 11)").withColumn("text", F.trim("text")), RANKS, "v").withColumn("op", F.lit("revise")))
    for round_ in range(2):
        want = {}
        for r in docs.collect():
            n, m = want.get((r.source, r.lang), (0, 0))
            want[r.source, r.lang] = (n + 1, m + count(r.text.strip(" ") if r.doc_id in (10, 11) else r.text))
        assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in store.totals().collect()} == want
        store.compact()
        assert store.batches() == ["a", "b"] and not store.commit("a", tokens.inserts(docs, RANKS, "v"))
    assert len(store._all("rows", tokens._ROW).inputFiles()) and tokens.Rollup(spark, store.folder).totals().count() == len(want)
    store.commit("c", docs.select(F.lit("delete").alias("op"), "doc_id", "source", "lang", F.lit("v").alias("tokenizer"), F.lit(0).alias("n_tokens")))
    assert store.totals().count() == 0
    empty = tokens.Rollup(spark, common.scratch(spark, "rollup"))
    assert empty.commit("none", tokens.inserts(docs.limit(0), RANKS, "v")) and empty.totals().count() == 0
