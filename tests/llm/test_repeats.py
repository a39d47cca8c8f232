import hashlib
import random

import pytest
import xxhash

from sqlcurio.llm import repeats

SCHEMA = "key long, doc_id long, text string, raw string"


def frame(spark, rows):
    return spark.createDataFrame([(0, i, t, "x") for i, t in rows], SCHEMA)


def in_order(rows):
    """Distinct documents: by doc_id with null last, then by the operator's own tie."""
    hashes = {(i, t or ""): xxhash.xxh64_intdigest((t or "").encode(), 42) for i, t in rows}
    tie = lambda d: hashes[d] - (hashes[d] >> 63 << 64) if d[0] is None else hashes[d] >> 32
    return sorted(hashes, key=lambda d: (d[0] is None, d[0] or 0, tie(d)))


def slow(rows, least=100):
    """Each document's removed runs by looking every string up in all earlier ones."""
    seen, out = {}, {}
    for doc in in_order(rows):
        raw = doc[1].encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - least + 1):
            if seen.setdefault(raw[s : s + least], (doc, s)) != (doc, s):
                gone[s : s + least] = b"\x01" * least
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[doc] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return sorted(((i, *out[i, t or ""]) for i, t in rows), key=repr)


def got(spark, rows):
    found = repeats.remove_repeats(frame(spark, rows)).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found), key=repr)


def planted():
    rnd = random.Random(4)
    text = lambda n, alphabet="abcdefgh éñ\n": "".join(rnd.choice(alphabet) for _ in range(n))
    passages = [text(rnd.randint(90, 700)) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [text(rnd.randint(0, 400))]
        for _ in range(rnd.randint(0, 4)):
            p = list(rnd.choice(passages))
            if rnd.random() < 0.4:
                p[rnd.randrange(len(p))] = "Q"
            parts += ["".join(p), text(rnd.randint(0, 60))]
        rows.append((i * 3, "".join(parts)))
    rows += [(1000 + k, rows[k][1]) for k in range(10)]
    rows += [(2, None), (4, ""), (5, "a" * 99), (7, "a" * 1000), (8, "ab" * 300), (2000, "\x00" * 350 + "z"), (2001, "\x00" * 120)]
    return rows


def test_every_byte_against_brute_force(spark):
    rows = planted()
    assert got(spark, rows) == slow(rows)


def test_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got(spark, rows) == slow(rows)


def test_segments_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 777)
    rows = planted()[:40]
    raw = "".join(t for _, t in rows).encode()
    h, first, count = repeats.anchors(raw)
    assert count.sum() == len(raw) - 99 and (first[1:] == first[:-1] + count[:-1]).all()


def test_edges(spark):
    assert got(spark, []) == []
    twice = repeats.remove_repeats(frame(spark, [(1, "x" * 50 + "y" * 90), (1, "x" * 50 + "y" * 90)])).collect()
    assert [r["n_removed"] for r in twice] == [0, 0]


def test_interval_tree_lists_maximal_repeats():
    text = "xabcdyabcdzabce"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    lcp = [0, *(common(text[a:], text[b:]) for a, b in zip(order, order[1:], strict=False))]
    left = [ord(text[i - 1]) if i else -9 for i in order]
    trees = repeats.interval_tree(lcp, order, left, 2)

    def members(k):
        return sorted([order[x] for x in trees[k].leaves] + [m for c in trees[k].children for m in members(c)])

    groups = {(text[order[t.best] :][: t.length], tuple(members(k))) for k, t in enumerate(trees) if t.maximal}
    assert groups == {("abcd", (1, 6)), ("abc", (1, 6, 11))}


@pytest.mark.parametrize("size", [0, 50, 99])
def test_short_texts_have_no_anchor(size):
    assert len(repeats.anchors(b"a" * size)[0]) == 0


def test_null_and_repeated_ids_lose_no_unique_text(spark):
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared, one, two = text(300), text(419), text(419)
    rows = [(1, shared), (None, shared), (None, one), (2, shared), (2, two), (2, two), (None, None), (None, one[:200] + two[-200:]), (3, one)]
    found = got(spark, rows)
    assert found == slow(rows)


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError):
        repeats.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_strings_of_hot_anchors_are_dealt_by_name(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_ROWS", 3)
    rows = planted() + [(None, t) for _, t in planted()[:9]]
    assert got(spark, rows) == slow(rows)
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    passage = text(260)
    rows = [(i, text(80) + passage + text(80)) for i in range(60)]
    assert got(spark, rows) == slow(rows)


def test_sized_runs():
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(7)
    keys = sorted(rnd.choice([1, 1, 1, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(200))
    batches, at = [], 0
    while at < len(keys):
        n = rnd.randint(0, 9)
        batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + n], pa.int64()), pa.array(range(at, min(len(keys), at + n)), pa.int64())], names=["k", "n"]))
        at += n
    out = list(repeats.sized_runs(iter(batches), 12))
    assert np.concatenate([c[1] for c, _ in out]).tolist() == list(range(len(keys)))
    assert np.concatenate([z for _, z in out]).tolist() == [min(12, keys.count(k)) for k in keys]
