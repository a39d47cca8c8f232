import random

import pytest

from sqlcurio.llm import maximal

LEAST = 100


def slow(rows, least=LEAST):
    """(string, occurrences) of maximal repeats, by following every repeated string a byte at a time."""
    texts = {i: (t or "").encode() for i, t in rows}
    windows = {}
    for i, raw in texts.items():
        for s in range(len(raw) - least + 1):
            windows.setdefault(raw[s : s + least], []).append((i, s))
    found, todo = set(), [(spots, least) for spots in windows.values()]
    while todo:
        spots, n = todo.pop()
        before = {texts[i][s - 1] if s else (i, s) for i, s in spots}
        if len(spots) < 2 or len(before) < 2:
            continue
        behind = {}
        for i, s in spots:
            behind.setdefault(texts[i][s + n] if s + n < len(texts[i]) else -1 - i, []).append((i, s))
        if len(behind) > 1:
            i, s = spots[0]
            found.add((texts[i][s : s + n], frozenset(spots)))
        todo += [(x, n + 1) for x in behind.values()]
    return found


def got(spark, rows, least=LEAST):
    texts = {i: (t or "").encode() for i, t in rows}
    frame = spark.createDataFrame([(0, i, t, "x") for i, t in rows], "node long, doc_id int, text string, ahead string")
    listed = maximal.maximal_repeats(frame, least).collect()
    groups = {r["repeat"]: r for r in listed if r["start"] is None}
    assert len(groups) == sum(r["start"] is None for r in listed)
    spots = {name: [] for name in groups}
    for r in listed:
        if r["start"] is not None:
            assert (r["length"], r["parent"]) == (groups[r["repeat"]]["length"], groups[r["repeat"]]["parent"])
            name = r["repeat"]
            while name is not None:
                spots[name].append((r["doc_id"], r["start"]))
                name = groups[name]["parent"]
    strings = {name: {texts[i][s : s + groups[name]["length"]] for i, s in spots[name]} for name in groups}
    assert all(len(x) == 1 for x in strings.values()) and all(len(set(x)) == len(x) for x in spots.values())
    out = {(strings[name].pop(), frozenset(spots[name])) for name in groups}
    assert len(out) == len(groups)
    return out


def planted(copies=60):
    rnd = random.Random(4)
    text = lambda n, alphabet="abcdefgh éñ\n": "".join(rnd.choice(alphabet) for _ in range(n))
    passages = [text(rnd.randint(90, 900)) for _ in range(8)] + [text(3000)]
    rows = []
    for i in range(copies):
        parts = [text(rnd.randint(0, 300))]
        for _ in range(rnd.randint(0, 4)):
            p = list(rnd.choice(passages))
            for _ in range(rnd.randint(0, 2)):
                p[rnd.randrange(len(p))] = "Q"
            parts += ["".join(p), text(rnd.randint(0, 60))]
        rows.append((i * 3, "".join(parts)))
    rows += [(1000 + k, rows[k][1]) for k in range(8)]
    return rows + [(2, None), (4, ""), (5, "a" * 99), (7, "a" * 600), (8, "ab" * 200), (2000, "\x00" * 350 + "z"), (2001, "\x00" * 120)]


def test_repeats_of_any_length_against_brute_force(spark):
    rows = planted()
    expected = slow(rows)
    assert max(len(s) for s, _ in expected) > 3000
    assert got(spark, rows) == expected


@pytest.mark.parametrize("most", [0, 4000])
def test_large_groups_are_split_by_spark(spark, monkeypatch, most):
    monkeypatch.setattr(maximal, "MOST_BYTES", most)
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    passage = text(700)
    rows = [(i, text(rnd.randint(0, 3)) + passage[: rnd.choice([250, 400, 700])] + text(rnd.randint(0, 4))) for i in range(25)]
    assert got(spark, rows) == slow(rows)


def test_a_long_passage_is_one_group(spark):
    rnd = random.Random(2)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = text(20_000)
    found = got(spark, [(1, "1" + passage + "2"), (2, "3" + passage + "4"), (3, passage)])
    assert found == {(passage.encode(), frozenset([(1, 1), (2, 1), (3, 0)]))}


def test_edges(spark):
    assert got(spark, []) == set()
    frame = spark.createDataFrame([(None, "a" * 50 + "b" * 60), (None, "a" * 50 + "b" * 60), (1, "x" + "a" * 50 + "b" * 60), (1, "y")], "doc_id long, text string")
    found = maximal.maximal_repeats(frame).collect()
    assert {(r["length"], r["doc_id"], r["start"]) for r in found} == {(110, None, None), (110, None, 0), (110, 1, 1)} and len(found) == 3
    with pytest.raises(TypeError):
        maximal.maximal_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
