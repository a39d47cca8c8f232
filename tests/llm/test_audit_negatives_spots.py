"""Hard negatives, filter audits and SpotSigs on awkward rows, against plain Python."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlcurio.llm import audit, negatives, spotsigs

VECTORS = "id long, label int, vector array<float>, name string, score int"


def mined(rows, n_positives=5, n_negatives=3):
    """Every anchor against every row, one by one."""
    rows = sorted(set((i, label, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in v)) for i, label, v in rows))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for a in rows:
        if a[0] % 50 == 0:
            near = sorted((-score(a[2], r[2]), r[0]) for r in rows if r[1] == a[1] and r[0] != a[0])[:n_positives]
            for s, positive in near:
                window = sorted((-score(a[2], r[2]), r[0]) for r in rows if r[1] != a[1] and -50 * s <= 100 * score(a[2], r[2]) <= -95 * s)
                out.update((a[0], positive, k + 1, i, -s, -n) for k, (n, i) in enumerate(window[:n_negatives]))
    return out


@pytest.mark.parametrize("cells", [2, 16, 256])
def test_negatives_by_cells_equal_brute_force(spark, cells, monkeypatch):
    draw = random.Random(cells)
    rows = [(i, draw.randrange(3), [draw.gauss(0, 0.3) for _ in range(12)]) for i in range(900)]
    rows += [(1000 + i, 1, [0.25] * 12) for i in range(60)] + [(2000, 0, [0.25] * 12), (2050, 2, [0.25] * 5), (2100, 2, []), (2150, 1, [1e4] * 12)]
    rows += rows[50:52] + rows[900:930]  # repeated rows are one
    monkeypatch.setattr(negatives, "ANCHORS_AT_ONCE", 7)
    monkeypatch.setattr(negatives, "SLICE", 100)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(5)
    found = negatives.mine(df, lambda i: i % 50 == 0, cells=cells)
    assert Counter(map(tuple, found.collect())) == mined(rows)


def test_negatives_of_rows_that_take_no_part(spark):
    whole = [(i, i % 2, [0.1 * i, 0.2, -0.1 * i]) for i in range(101)]
    nan, inf = float("nan"), float("inf")
    broken = [(None, 1, [1.0] * 3), (150, None, [1.0] * 3), (200, 1, None), (250, 1, [nan, 1.0, 1.0]), (300, 1, [inf, 1.0, 1.0]), (350, 1, [None, 1.0, 1.0])]
    df = lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    run = lambda rows: negatives.mine(df(rows), lambda i: i % 50 == 0).collect()
    assert Counter(map(tuple, run(whole + broken))) == mined(whole) and run(whole)
    assert run([]) == [] and run(broken) == [] and run(whole[1:40]) == [] and run([(i, 1, [1.0]) for i in range(60)]) == []
    huge = [(0, 1, [3e38, 1.0]), (1, 1, [3e38, 0.0]), (2, 0, [2e6, 0.0]), (50, 0, [-3e38, 0.0])]
    assert all(abs(r["positive_score"]) <= 2 * negatives.LARGEST**2 for r in run(huge))


def test_bounds_hold_every_score():
    draw = np.random.default_rng(1)
    for size in (100, 1 << 20, 1 << 27):
        rows, asked = draw.integers(-size, size, (300, 9)), draw.integers(-size, size, (20, 9))
        inner = np.sort(draw.integers(-size, size, (9, 7)), axis=1)
        below = np.concatenate([rows.min(0)[:, None], np.clip(inner, rows.min(0)[:, None], rows.max(0)[:, None])], axis=1)
        above = np.maximum(np.concatenate([below[:, 1:] - 1, rows.max(0)[:, None]], axis=1), below)
        code = np.stack([np.searchsorted(below[d, 1:], rows[:, d], "right") for d in range(9)], axis=1).astype(np.uint8)
        bounds = negatives.Bounds(asked, below, above)
        low, high = bounds.between(slice(None), bounds.edges(code), slice(None))
        exact = asked @ rows.T
        assert (low <= exact).all() and (exact <= high).all()


def audited(rows, names):
    """Every order is applied to the rows themselves."""
    out, shapley = {}, Counter()
    for order in permutations(names):
        for part in {r["part"] for r in rows}:
            left, all_of = [r for r in rows if r["part"] == part], [r for r in rows if r["part"] == part]
            for k, f in enumerate(order):
                gone = [r for r in left if r[f]]
                left = [r for r in left if not r[f]]
                fails = [r for r in all_of if r[f]]
                shapley[part, f] += len(gone)
                only = sum(not any(r[g] for g in names if g != f) for r in fails)
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(fails) - len(gone), only, sum(r["good"] for r in gone), sum(r["toxic"] for r in gone)]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("names", ["A", "XY", "ABCD"])
def test_audit_equals_filters_applied_in_every_order(spark, names):
    draw = random.Random(len(names))
    rows = [{"part": draw.choice(["", "a", "b"]), "good": draw.random() < 0.5, "toxic": draw.random() < 0.2} | {f: draw.random() < 0.4 for f in names} for _ in range(300)]
    rows += [{"part": "gone", "good": True, "toxic": False} | dict.fromkeys(names, True)] * 2
    df = spark.createDataFrame(rows, "part string, good boolean, toxic boolean, " + ", ".join(f"{f} boolean" for f in names))
    assert set(map(tuple, audit.audit(df, list(names)).collect())) == audited(rows, names)


def test_audit_counts_each_state_once(spark, monkeypatch):
    written = []
    keep = audit.materialise
    monkeypatch.setattr(audit, "materialise", lambda df, label: written.append(label) or keep(df, label))
    df = spark.createDataFrame([("a", True, False, *[k == n for k in range(4)]) for n in range(5)], "part string, good boolean, toxic boolean, A boolean, B boolean, C boolean, D boolean")
    audit.edges(df, list("ABCD"))
    assert written.count("audit-edges") == 15
    with pytest.raises(ValueError):
        audit.audit(df, ["A", "A"])
    assert audit.audit(df.limit(0), list("ABCD")).collect() == []


def test_audited_documents_with_nulls_copies_and_clashing_columns(spark):
    docs = [(1, None, "a"), (2, "", "a"), (None, "", "a"), (None, "", None), (3, "Ä# x", None), (3, "Ä# x", None), (4, "Ä# x", "b"), (5, "w " * 300, "b"), (6, " ".join(f"w{k}" for k in range(300)), "b"), (7, "HE WAS " * 200, "b")]
    df = spark.createDataFrame([(*d, True, "k", 1) for d in docs], "doc_id long, text string, source string, good boolean, key string, A int")
    labels = spark.createDataFrame([(1, 1, None), (1, None, 1), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    rows = {(r["part"], r["E"], r["good"], r["toxic"], r["A"], r["B"], r["C"], r["D"]): 0 for r in audit.judged(df, labels).collect()}
    assert set(rows) == {
        ("a", False, True, True, True, False, False, False), ("a", True, False, False, True, False, False, False), ("", True, False, False, True, False, False, False),
        ("", False, False, False, True, False, False, True), ("b", True, False, False, True, False, False, True), ("b", False, False, False, False, True, False, False),
        ("b", False, False, False, False, False, False, False), ("b", False, False, False, False, True, True, False),
    }
    assert audit.audit_documents(df, labels).count() == 3 * 120 * 5


def edited(docs):
    """(doc_id, edited text, next text) by sorting the distinct documents."""
    order = sorted(set(docs), key=lambda d: -d[0])
    out = {}
    for k, (i, text) in enumerate(order):
        then = order[(k + 1) % len(order)][1]
        out[i] = (text, text[: len(text) - len(text) // 2] + then[: len(text) // 2], then)
    return out


def test_spotsigs_edits_and_likeness(spark):
    draw = random.Random(4)
    word = lambda: draw.choice(spotsigs.ANCHORS[:40]) if draw.random() < 0.4 else "".join(draw.choices("abcdefgh", k=5))
    docs = [(k, " ".join(word() for _ in range(draw.choice([0, 1, 3, 30, 400])))) for k in range(80)]
    docs += [(100, "𝄞é" * 501), (99, "𝄞é" * 501), (200, "漢字かな交じり文" * 30), (300, "the of and"), (301, "#!?"), (302, ""), (-5, "x" * 3000)]
    df = spark.createDataFrame([(i, t, "k", 3) for i, t in docs] + [(5, dict(docs)[5], "k", 3)], "doc_id long, text string, key string, n long").repartition(7)
    rows = spotsigs.with_edits(df).collect()
    want = edited(docs)
    assert len(rows) == len(docs) + 1
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    cut = lambda f: {f[k : k + 8] for k in range(0, len(f), 8)}
    for r in rows:
        text, changed, then = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        a, b = r["fingerprint"], r["edited_fingerprint"]
        few = ":" in a and ":" in b
        x, y = (cut(f.replace(":", "") if few else f.split(":")[0]) for f in (a, b))
        j = 1.0 if x == y else len(x & y) / len(x | y)
        assert r["near_edited"] == pytest.approx(j if j >= spotsigs.LEAST else 0.0)
        assert (text == changed) <= (a == b)
    assert prints[100] == prints[99] and next(r for r in rows if r["doc_id"] == 100)["near_next"] == 1.0
    assert prints[302] == ":" and len({prints[k] for k in (300, 301, 302)}) == 3
    assert all(r["near_edited"] > 0.1 for r in rows if r["n_chars"] > 1500)


def test_spotsigs_signatures_are_chains_behind_common_words(spark):
    text = "The Quick brown fox is on the lazy dog, and runs."
    sign = lambda a, b: hashlib.md5(f"{a} {b}".encode()).hexdigest()[:8]
    spots, rest = {sign("quick", "brown"), sign("lazy", "dog")}, {sign("brown", "fox"), sign("fox", "lazy"), sign("dog", "runs")}
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").select(spotsigs.fingerprint(F.col("text")).alias("f"))
    assert df.first()["f"] == "".join(sorted(spots)) + ":" + "".join(sorted(rest))


def test_spotsigs_of_awkward_tables(spark):
    schema = "doc_id long, text string"
    assert spotsigs.with_edits(spark.createDataFrame([], schema)).collect() == []
    one = spotsigs.with_edits(spark.createDataFrame([(1, "ab cd")], schema)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest() and one["near_next"] == 1.0
    nulls = spotsigs.with_edits(spark.createDataFrame([(None, None), (None, "same"), (None, "same"), (1, None)], schema)).collect()
    assert len(nulls) == 4 and Counter(r["n_chars"] for r in nulls) == {0: 2, 4: 2}
    with pytest.raises(TypeError):
        spotsigs.with_edits(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    # by size partitions: neighbours may be alike, others never are
    sizes = spark.range(1, 400).select(spotsigs.length_partition(F.col("id"), 0.5).alias("p"), "id").collect()
    assert all(abs(a["p"] - b["p"]) <= 1 for a in sizes[::7] for b in sizes if min(a["id"], b["id"]) >= 0.5 * max(a["id"], b["id"]))
