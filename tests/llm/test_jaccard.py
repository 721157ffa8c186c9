"""Near duplicates against brute force."""

import random

import pytest

from gleanery.llm import jaccard_join, postings
from gleanery.llm.components import components
from gleanery.llm.queries import op2_near_duplicates


def shingles(text, size=5):
    words = (text or "").encode().lower().split()  # bytes: only A-Z
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if sets[i] and r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(
        ((r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=repr
    )


def compare(df, rows):
    assert sorted((tuple(r)[:3] for r in df.collect()), key=repr) == brute(rows)


def corpus(seed, n=250):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    line = " ".join(r.choice(vocabulary) for _ in range(25))
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.5:
            words = r.choice(rows)[1].split()
            for _ in range(r.randint(0, 4)):
                if words:
                    at = r.randrange(len(words))
                    words[at : at + r.randint(0, 2)] = [r.choice(vocabulary)] * r.randint(0, 2)
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 4, 5, 6, 8, 12, 20, 40, 90]))]
            if kind > 0.8:
                words = line.split() + words
        rows.append((i, r.choice([" ", "\n"]).join(words).replace("w1", r.choice(["w1", "W1"])), "x"))
    return rows


@pytest.mark.parametrize("seed", [1])
def test_random(spark, seed):
    rows = corpus(seed)
    rows += [(900, None, "x"), (901, "", "x"), (902, " \n ", "x"), (None, rows[5][1], "x"), (None, "only null id here", "x"), (6, rows[6][1], "x")]
    rows += [(950, " ".join(f"v{i}" for i in range(30_000)), "x"), (951, " ".join(f"v{i}" for i in range(29_000)), "x")]
    compare(jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, key string")), rows)


@pytest.mark.parametrize("boundary", [1, 40])
def test_any_boundary(spark, monkeypatch, boundary):
    rows = corpus(7, 150)
    monkeypatch.setattr(jaccard_join, "choose_boundary", lambda *a: boundary)
    compare(jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, key string")), rows)


def test_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "OFTEN_DOCS", 3)
    rows = corpus(9, 200)
    compare(jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, key string")), rows)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    compare(op2_near_duplicates(spark, sf), rows)


def test_empty(spark):
    assert jaccard_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(50)]
    root = {x: x for ab in links for x in ab}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    loops = {x for x in root if all(a == b for a, b in links if x in (a, b))}
    got = {n: m for n, m in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: m for x, m in root.items() if x not in loops}


def test_ranges_grow():
    assert postings.part_bits(0) == 6 and postings.part_bits(10**12) == 19
