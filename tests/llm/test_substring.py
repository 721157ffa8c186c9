"""Repeated passages against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from gleanery.llm import jaccard_join, postings, substring
from gleanery.llm.queries import op7_substring_dedup
from gleanery.llm.words import Words


def brute(texts, window=35):
    docs = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def compare(df, rows):
    want = sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows]))), key=repr)
    got = sorted((tuple(r)[:4] for r in df.collect()), key=repr)
    assert got == want


def test_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_runs_and_whole():
    texts = ["a b c a b c", None, "", "a b c", " a\tb\x0bc d ", "x"]
    w = Words(texts, lower=False)
    assert w.count.tolist() == [6, 0, 0, 3, 3, 1]
    hashes, at = w.runs(3)
    assert at.tolist() == [0, 1, 2, 3, 6, 9]
    assert hashes[0] == hashes[3] == hashes[4] != hashes[5]
    assert len(set(hashes.tolist())) == 4
    whole = Words(["a b", "a  b\n", "b a", "", None, "a"], lower=False).whole(1)
    assert whole[0] == whole[1] and whole[3] == whole[4] and len(set(whole.tolist())) == 4


@pytest.mark.parametrize("seed", [1])
def test_random(spark, seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("abcdefghijklmnopqrstuvwxyz")
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 200)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(r.randint(0, 4)):
            text += [word() for _ in range(r.randint(0, 60))]
            if r.random() < 0.6:
                p = r.choice(passages)
                a = r.randint(0, 5)
                text += p[a : len(p) - r.randint(0, 3)]
        rows.append((i, r.choice([" ", "\n", "  "]).join(text), "x"))
    rows += [(200, " ".join(["same"] * 80), "x"), (201, None, "x"), (202, "", "x"), (None, rows[3][1], "x"), (7, rows[7][1], "x")]
    rows += [(300 + i, "a copy of few words", "x") for i in range(3)]
    rows += [(400, " ".join(passages[4]) + " ÄÖ " + "long " * 20_000, "x")]
    compare(substring.kept_words(spark.createDataFrame(rows, "doc_id long, text string, key string")), rows)


def test_hot_text(spark, monkeypatch):
    from gleanery.llm import common

    monkeypatch.setattr(common, "HEAVY_ROWS", 10)
    hot = " ".join(f"w{i}" for i in range(50))
    rows = [(i, hot) for i in range(60)] + [(100, "new " + hot + " end"), (101, "short"), (102, " ".join(f"v{i}" for i in range(90)))]
    rows += [(200 + i, "few words") for i in range(30)]
    compare(substring.kept_words(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    compare(op7_substring_dedup(spark, sf), rows)


def test_empty(spark):
    assert substring.kept_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def thue_morse(a, b, n=2048):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_words_that_cancel():
    """A polynomial modulo a power of two takes these two for the same, whatever its base."""
    one, two = thue_morse("a", "b"), thue_morse("b", "a")
    assert len(set(Words([one, two, one], lower=False).hash.tolist())) == 2
    sequences = [" ".join(t) for t in (one, two)]
    assert len(set(Words(sequences, lower=False).whole(1).tolist())) == 2


def test_long_words_are_told_apart(spark):
    one, two = thue_morse("a", "b"), thue_morse("b", "a")
    rows = [(i, " ".join([w] + [f"x{j}" for j in range(34)])) for i, w in enumerate((one, two))]
    compare(substring.kept_words(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    sets = jaccard_join.shingle_sets([one, two, f"{one} {two}", f"{two} {one}"])
    assert len(set(sets[3].tolist())) == 4


def test_many_ranges_cost_what_their_postings_cost():
    """The rows that a chunk sends grow with its postings, not with the ranges there are."""
    hashes = np.random.default_rng(3).integers(0, 2**64, 5000, dtype=np.uint64)
    docs, keys = np.arange(5000) % 10, np.arange(10, dtype=np.uint64) << np.uint64(60)
    for bits in (6, 10, 20, 30):
        batch = postings._pack(hashes, docs, np.arange(5000), keys, 31, bits, False)
        assert batch.num_rows <= min(5000, 1 << bits)
        back = np.concatenate([postings._unplanes(b, "<u8") for b in batch.column(1).to_pylist()])
        assert sorted(back.tolist()) == sorted(hashes.tolist())
        parts = [p for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for _ in range(len(b) // 8)]
        assert (back >> np.uint64(64 - bits)).tolist() == parts
