import pandas as pd
import pytest
import xxhash

from sqlcurio.llm import mixing, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, _lot string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "y") for i, t, s in rows], SCHEMA)


def water(sizes, weights, share, most):
    left, target, pool = share * sum(sizes.values()), {}, dict(sizes)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    while pool:
        total = sum(w[s] for s in pool)
        over = [s for s in pool if left * w[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * w[s] / total for s in pool}
        for s in over:
            target[s] = most * sizes[s]
            pool.pop(s)
        left = share * sum(sizes.values()) - sum(target.values())
    return target


def test_targets_and_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    want = water(got.groupby("source")["size"].sum().to_dict(), [3, 1, 2], 1.5, 2)
    for source, part in got.groupby("source"):
        assert part["target"].iloc[0] == pytest.approx(want[source])
        assert part["taken"].sum() == pytest.approx(want[source], rel=0.01, abs=16)
    assert (got["taken"] <= 2 * got["size"]).all() and len(got) == docs.count()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert again.sort_values("doc_id")["taken"].tolist() == got.sort_values("doc_id")["taken"].tolist()


def test_mix_edges(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "x y z", None), (3, "x y z", None), (None, "w " * 5000, "b"), (5, " \t", "c")]
    got = mixing.mix(frame(spark, rows)).toPandas()
    assert len(got) == 6 and got["taken"].ge(0).all() and (got["taken"] <= 2 * got["size"]).all()
    assert mixing.mix(frame(spark, [])).count() == 0


def test_block_quotas_are_exact(spark):
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(500)]
    got = mixing.mix(frame(spark, rows), block_words=4, shard_rows=50).toPandas()
    assert got["taken"].sum() == pytest.approx(1.5 * got["size"].sum(), rel=0.02)


def slow_fingerprint(text):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for k in range(len(ids)):
        groups.setdefault(find(k), []).append(ids[k])
    return {i: min(g) for g in groups.values() for i in g}


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    near = docs.toPandas()
    texts = dict(zip(near["doc_id"], near["text"], strict=True))
    for k in range(60):  # a dense group of near copies
        w = texts[1].split()
        w[k % len(w)] = f"edit{k}"
        texts[10_000 + k] = " ".join(w)
    texts |= {20_000: "", 20_001: None, 20_002: "One", 20_003: "one", 20_004: "Élan b c d e"}
    got = simhash.near_duplicates(frame(spark, [(int(i), t, "s") for i, t in texts.items()])).toPandas()
    fps = {i: slow_fingerprint(t) for i, t in texts.items()}
    assert dict(zip(got["doc_id"], got["fingerprint"], strict=True)) == {i: f"{f:016x}" for i, f in fps.items()}
    assert dict(zip(got["doc_id"], got["component_id"], strict=True)) == slow_components(list(fps), list(fps.values()))


def test_simhash_edges(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    got = simhash.near_duplicates(frame(spark, [(7, "a b", "s"), (7, "a b", "s"), (9, "w " * 70_000, None)])).toPandas()
    assert sorted(got["component_id"]) == [7, 7, 9]


def test_forest_connects_like_all_links():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = np.unique(np.array([int(base[rng.integers(4)]) ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(300)], np.uint64))
    edges = simhash.forest(fps, 4)
    want = slow_components(list(range(len(fps))), [int(f) for f in fps])
    label = {k: k for k in range(len(fps))}
    for a, b in edges:
        x, y = label[a], label[b]
        label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    assert label == want and len(edges) == len(fps) - pd.Series(want).nunique()


def test_parted_forest_connects_like_all_links(monkeypatch):
    import numpy as np

    monkeypatch.setattr(simhash, "BIG_RUN", 12)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**43, 40, dtype=np.uint64) << np.uint64(21)  # one variant: the lowest segment is equal
    flip = lambda n: sum(1 << int(b) for b in 21 + rng.choice(43, n, replace=False))
    fps = np.unique(np.array([int(base[rng.integers(40)]) ^ flip(int(rng.integers(0, 4))) for _ in range(400)], np.uint64))
    edges = simhash.parted_forest(fps, np.arange(21, 64), 4)
    want = slow_components(list(range(len(fps))), [int(f) for f in fps])
    label = {k: k for k in range(len(fps))}
    for a, b in edges:
        x, y = label[a], label[b]
        label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    assert label == want and all((int(fps[a]) ^ int(fps[b])).bit_count() <= 4 for a, b in edges)


def test_keep_first_keeps_one_row_of_each_group(spark):
    long = " ".join(f"word{k}" for k in range(60))
    other = " ".join(f"other{k}" for k in range(60))
    rows = [(None, long, "s"), (None, long, "t"), (None, other, "s"), (None, other, "s"), (5, other, "s"), (7, "a b c d e", "s"), (7, "a b c d e", "t"), (7, "q r s t u", "s"), (None, None, "s"), (None, "", "s")]
    got = sorted((r["doc_id"], r["text"]) for r in simhash.keep_first(frame(spark, rows)).collect() if r["doc_id"] is not None)
    assert got == [(5, other), (7, "a b c d e"), (7, "q r s t u")]
    rest = [r["text"] for r in simhash.keep_first(frame(spark, rows)).collect() if r["doc_id"] is None]
    assert len(rest) == 2 and long in rest and simhash.keep_first(frame(spark, rows)).columns == frame(spark, rows).columns
    assert simhash.keep_first(frame(spark, [])).count() == 0


def test_components_of_awkward_graphs(spark):
    import random

    from sqlcurio.llm.common import connected_components

    rnd = random.Random(3)
    path = [(k, k + 1) for k in range(100, 400)]
    star = [(1000, 1001 + k) for k in range(300)]
    high_star = [(5000, 4000 + k) for k in range(300)]
    loose = [(6000 + rnd.randrange(400), 6000 + rnd.randrange(400)) for _ in range(260)]
    edges = path + star + high_star + loose
    rnd.shuffle(edges)
    edges = [e if rnd.random() < 0.5 else e[::-1] for e in edges] + edges[:50]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {x: find(x) for x in root if x not in alone}
