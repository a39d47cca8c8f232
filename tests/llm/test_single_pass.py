"""Sharding, URL rules, quality rules and language identification."""

import random
import re
import zlib
from collections import Counter
from functools import cache

import duckdb
import pytest
import zstandard

from sqlcurio.llm import langid, quality, queries, sharding, urlrules

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, size int, _cell string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "x") for i, t, lang, s in rows], SCHEMA)


EDGES = [(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "word " * 30_000, "en", "b"), (4, "12 34 !!", "de", "a"), (5, "É", "fr", "c")]


# sharding


def test_hilbert_is_a_curve(spark):
    from pyspark.sql import functions as F

    for dims, bits in ((2, 3), (3, 2), (3, 3)):
        cells = spark.range(1 << dims * bits).select(*[(F.shiftright("id", k * bits) % (1 << bits)).cast("int").alias(f"a{k}") for k in range(dims)])
        axes = [F.col(f"a{k}") for k in range(dims)]
        walk = [r[:-1] for r in cells.select(*axes, sharding.hilbert_index(axes, bits).alias("at")).orderBy("at").collect()]
        assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in zip(walk, walk[1:], strict=False))


def check_shards(rows, shards):
    counts = Counter(r["shard"] for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert set(counts) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


@pytest.mark.parametrize("bucket_rows", [3, 192])
def test_shards(spark, bucket_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.assign_shards(docs, bucket_rows=bucket_rows).collect()
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    check_shards(rows, 16)
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in rows)
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve_index"] for r in order] == sorted(r["curve_index"] for r in rows)
    assert sorted(map(tuple, sharding.assign_shards(docs.repartition(5), bucket_rows=bucket_rows).collect())) == sorted(map(tuple, rows))


def test_shards_with_many_cells(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.assign_shards(docs, shards=5, bits=6, bucket_rows=7).collect()
    assert len(rows) == docs.count()
    check_shards(rows, 5)


def test_shard_edges(spark):
    rows = sharding.assign_shards(frame(spark, EDGES)).collect()
    assert len(rows) == len(EDGES)
    check_shards(rows, 16)
    assert sharding.assign_shards(frame(spark, [])).count() == 0


# URL rules


URLS = [
    None, "", "no scheme", "http://", "http://NET", "http://net/", "http://a.net/x", "http://anet/", "http://Example.NET/en/1", "http://x.example.net/en/?q", "http://x.example.net/en",
    "https://w.example.com/de/#t", "https://w.example.com/DE/", "http://b.org/fr/x?u=http://c.net/", "http://b.org?x/fr/", "ftp://net#/", "a://b://net/", "http://example.net.evil.com/en/", "http://.net/", "http://net./\nx",
]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.name), [-ord(c) for c in r.name], r.verdict)) if fits else None
    return host, path, best and best.name, best.verdict if best else "allow"


def test_url_rules(spark, monkeypatch):
    rules = [*queries.URL_RULES, urlrules.Rule("com", "/", "block"), urlrules.Rule("w.example.com", "/", "allow"), urlrules.Rule("example.com", "/", "block"), urlrules.Rule("example.com", "/de/", "allow"), urlrules.Rule("net", "/en", "block"), urlrules.Rule("com", "/d", "allow")]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)] + [(3, "http://", "x", "y")], "page_id long, url string, host string, path string")
    for most in (100, 3, 1):  # rules in one block, in three, each by itself
        monkeypatch.setattr(urlrules, "RULES_AT_ONCE", most)
        rows = urlrules.judge(pages.repartition(2), rules).collect()
        assert len(rows) == len(URLS) + 1
        for r in rows:
            assert tuple(r)[1:] == brute(URLS[r["page_id"]], rules), URLS[r["page_id"]]
    assert urlrules.judge(pages.limit(0), rules).count() == 0 and {r["verdict"] for r in urlrules.judge(pages, []).collect()} == {"allow"}


def test_more_rules_than_travel_at_once(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "RULES_AT_ONCE", 500)
    rules = [urlrules.Rule(f"h{k % 400}.example.com", f"/{k % 7}/", "block" if k % 3 else "allow") for k in range(2000)] + [urlrules.Rule("com", "/", "block")]
    urls = [f"http://x.h{k}.example.com/{k % 9}/y" for k in range(0, 450, 3)] + ["http://org/", None]
    got = {r["page_id"]: tuple(r)[1:] for r in urlrules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert got == {k: brute(u, rules) for k, u in enumerate(urls)}


def test_url_oracle(spark, tmp_path):
    spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op9_urlrules"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(map(tuple, got)) == sorted(db.execute(queries.ORACLES["op9_urlrules"]).fetchall())


# quality


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def test_quality_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | {-1: None, -2: "", -3: " \n\t", -4: "a b c a b c a b", -5: "x\x1cy\u00a0z \x0b q\n q\nq\n q", -6: "é a é a é a"}
    got = quality.quality(frame(spark, [(i, t, "en", "s") for i, t in texts.items()])).collect()
    for r in got:
        n, chars, symbols, dup, rep = slow_counts(texts[r["doc_id"]])
        assert tuple(r)[1:6] == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n) and not (r["base_failed"] and r["kept"])


def test_quality_bands(spark):
    import random

    rnd = random.Random(1)
    prose = " ".join("".join(rnd.choice(("th", "er", "on", "an", "re", "ed")) for _ in range(rnd.randint(1, 4))) for _ in range(3000))
    noise = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(9)) for _ in range(2000))
    loops = " ".join(f"{w} {k % 5} filler {k % 7} words here" for k, w in enumerate(prose.split()[:40] * 60))
    got = {r["doc_id"]: r for r in quality.quality(frame(spark, [(1, prose, "en", "s"), (2, noise, "en", "s"), (3, loops, "en", "s")])).collect()}
    assert got[1]["kept"] and not got[2]["kept"] and not got[3]["kept"]
    assert got[2]["ratio"] < 1.4 < got[1]["ratio"] < got[3]["ratio"]


def test_every_chunk_counts():
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    loop = b"the same again and " * 500
    import random

    rnd = random.Random(3)
    prose = " ".join("".join(rnd.choice(("th", "er", "on", "an", "re")) for _ in range(rnd.randint(1, 4))) for _ in range(4000)).encode()
    size = quality.CHUNK
    assert quality.compression(prose[:size], packer).n_chunks == 1 and quality.compression(prose[: size + 1], packer).n_chunks == 2
    tail = quality.compression(prose[: size + 200] + loop[: size - 400], packer)
    assert (tail.n_chunks, tail.n_bad_chunks) == (2, 1) and 0 < tail.bad_bytes < size
    assert quality.in_band(3 * size, quality.compression(prose[: 3 * size], packer))
    assert not quality.in_band(3 * size, quality.compression(prose[:size] + loop[: 2 * size], packer))


def test_quality_keeps_clean_documents(spark):
    got = quality.quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("not base_failed").toPandas()
    assert got["kept"].mean() > 0.98


def slow_quality(text):
    """Counts and verdict by the rules as written, word by word, with the bands spelled out."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 2 * len(covered) > len(words)
    limits = lambda n: (0, 9e99) if n < 128 else (0.85, 2.5) if n < 512 else (1.1, 3.5) if n < 2048 else (1.3, 4.5) if n < 16384 else (1.4, 6.0)
    raw = text.encode()
    ratio = lambda part: len(part) / len(zstandard.compress(part, 3))
    bad = 0
    for k in range(0, len(raw), 4096):
        part = raw[k : k + 4096]
        low, high = (1.3, 8.0) if len(part) == 4096 else limits(len(part))
        bad += 0 if low <= ratio(part) <= high else len(part)
    whole = not raw or limits(len(raw))[0] <= ratio(raw) <= limits(len(raw))[1]
    counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(n - 1 for n in Counter(lines).values()), len(covered))
    return *counts, failed, not failed and whole and 2 * bad <= len(raw)


def test_quality_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    draw = random.Random(6)
    more = [(10**6 + k, "".join(draw.choices("abcdefghijklmnopqrstuvwxyz    \n#$é", k=draw.choice([0, 40, 600, 5000, 20000])))) for k in range(40)] + [(10**6 + 50 + k, f"same words again {k % 3} " * n) for k, n in enumerate([1, 9, 60, 900, 4000])]
    both = docs.unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in quality.quality(both).collect()}
    assert got == {i: slow_quality(t) for i, t in texts.items()}
    assert len({v[-1] for v in got.values()}) == 2


def test_quality_edges(spark):
    assert quality.quality(frame(spark, EDGES)).count() == len(EDGES) and quality.quality(frame(spark, [])).count() == 0


# language


def test_language_of_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got["held_out"] & (got["text"].str.len() > 30)]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_ignores_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(langid.is_held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert sorted(map(tuple, langid.identify(other).collect())) == sorted(map(tuple, langid.identify(docs).collect()))


@cache
def bucket(gram):
    """One of 2^15 buckets of an n-gram, a character at a time."""
    h = len(gram)
    for c in gram:
        h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
        h ^= h >> 32
    return h >> 49


def slow_language(docs, texts):
    """Naive Bayes by plain counting over n-grams of 1 to 4 characters cut from strings; docs are (id, text, lang)."""
    import math

    def grams(text):
        line = " " + re.sub(r"[\x00-\x60\x7b-\x7f]+", " ", text.lower()) + " "
        return [bucket(line[k : k + n]) for n in range(1, 5) for k in range(len(line) - n + 1)] if text else []

    rows = {}
    for i, t, lang in docs:
        if i is not None and zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None and t is not None:
            rows.setdefault(lang, []).append(t)
    counts = {lang: Counter(g for t in ts for g in grams(t)) for lang, ts in rows.items()}
    every = sum(map(len, rows.values()))
    out = []
    for t in texts:
        if not t or not re.search(r"[^\W\d_]", t):
            out.append("und")
            continue
        score = {}
        for lang, c in counts.items():
            mass = sum(c.values()) + langid.ALPHA * 2**15
            score[lang] = math.log(len(rows[lang]) / every) + sum(n * math.log((c[g] + langid.ALPHA) / mass) for g, n in Counter(grams(t)).items())
        out.append(min(score, key=lambda x: (-score[x], x)))
    return out


def test_language_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert [got[i] for i, _, _ in rows] == slow_language(rows, [t for _, t, _ in rows])


def test_more_languages_than_a_block(spark, monkeypatch):
    import random

    rnd = random.Random(5)
    alphabets = ["".join(chr(0x100 + 9 * k + j) for j in range(9)) for k in range(23)]
    word = lambda a: "".join(rnd.choice(a) for _ in range(6))
    rows = [(20 * k + j, " ".join(word(a) for _ in range(12)), f"l{k:02d}", "s") for k, a in enumerate(alphabets) for j in range(20)]
    docs = frame(spark, rows)
    whole = sorted(map(tuple, langid.identify(docs).collect()))
    assert all(lang == f"l{i // 20:02d}" for i, _, lang, _ in whole)
    monkeypatch.setattr(langid, "LANGS_AT_ONCE", 4)
    cut = sorted(map(tuple, langid.identify(docs).collect()))
    assert [r[:3] for r in cut] == [r[:3] for r in whole] and [r[3] for r in cut] == pytest.approx([r[3] for r in whole], abs=1e-5)
    assert langid.keep_known(docs).count() == len(rows) and langid.keep_known(docs).columns == docs.columns


def test_language_edges(spark, monkeypatch):
    monkeypatch.setattr(langid, "SCORES_AT_ONCE", 1000)
    got = {r["doc_id"]: r for r in langid.identify(frame(spark, [*EDGES, (6, "the cat " * 900, "en", "a"), (7, "chat noir", None, "a")])).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 4)] == ["und"] * 3 and got[6]["lang_pred"] == "en" and got[1]["score"] == 0
    assert langid.identify(frame(spark, [])).count() == 0
    assert {r["lang_pred"] for r in langid.identify(frame(spark, [(1, "abc", None, "a")])).collect()} == {"und"}
    assert langid.keep_known(frame(spark, EDGES)).columns == frame(spark, EDGES).columns


def test_pieces_give_the_same_scores(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (model,) = langid.train(docs.select("doc_id", "text", "lang"))
    texts = [r["text"] * 3 for r in docs.limit(40).collect()]
    whole = langid.score_texts(texts, model)
    monkeypatch.setattr(langid, "SCORES_AT_ONCE", 97)
    cut = langid.score_texts(texts, model)
    assert list(whole.lang) == list(cut.lang) and all(list(a) == pytest.approx(list(b), abs=1e-4) for a, b in zip(whole[1:], cut[1:], strict=True))
