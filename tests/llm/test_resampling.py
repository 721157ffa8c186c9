"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

import pyarrow as pa

from gleanery.llm import resampling
from gleanery.llm.queries import op11_resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def grams(text, max_run):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, max_run + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, max_run=1, buckets=10_000, min_words=20, percent=10):
    """Rows without the rank's ties: docs are (doc_id, text)."""

    def bucket(g):
        return zlib.crc32(g.encode()) % buckets

    s = Counter(bucket(g) for _, t in docs for g in grams(t, max_run)[1])
    t = Counter(bucket(g) for text in target for g in grams(text, max_run)[1])
    S, T = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))

    rows = []
    for doc_id, text in docs:
        words, found = grams(text, max_run)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(able) // 100
    ranks = {id(r): i + 1 for i, r in enumerate(able[:drawn])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=repr)


def got(spark, docs, target, **options):
    df = resampling.resample(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), **options
    )
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


ODD = [
    (1, None),
    (2, ""),
    (3, " .,;-"),
    (4, "A-Z a_z 0:9 É é ß İ \U0001f600x\x00y\x7fz"),
    (5, "one two one two ONE"),
    (5, "one two one two ONE"),
    (-6, "same words " * 20),
    (None, "same words " * 20),
    (None, "other words " * 20),
    (7, "x" * 100_000 + " " + "word " * 30_000),
    (8, "...leading and trailing..."),
] + [(100 + i, f"word{i % 7} and some text number {i} " * 5) for i in range(40)]
TARGET = ["some words of the target", None, "", "ONE one é", "word " * 50]


@pytest.mark.parametrize("max_run", [1, 2, 3])
def test_odd_texts(spark, max_run):
    assert got(spark, ODD, TARGET, max_run=max_run, percent=30) == plain(ODD, TARGET, max_run, percent=30)


def test_empty_tables(spark):
    assert got(spark, [], TARGET) == []
    assert got(spark, ODD, [], percent=100) == plain(ODD, [], percent=100)
    assert got(spark, [], []) == []


def test_repeated_rows_have_ranks_of_their_own(spark):
    rows = [(1, "a b c " * 10)] * 30 + [(2, "d e f " * 10)] * 10
    ranks = [r[4] for r in got(spark, rows, ["a b"], percent=100)]
    assert sorted(ranks) == list(range(1, 41))


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x", 1.0)], "doc_id long, text string, rank long, part string, weight double")
    target = spark.createDataFrame([(1, "a", 2)], "bucket long, text string, n long")
    out = resampling.resample(docs, target, min_words=1, percent=100)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert [r["rank"] for r in out.collect()] == [1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é.\x00 9\n", max_size=30)), max_size=6), st.integers(1, 4))
def test_features(texts, max_run):
    n_words, found = resampling.features(pa.array(texts, pa.string()), max_run)
    assert n_words.tolist() == [len(grams(t, 1)[0]) for t in texts]
    have = sorted((d, c) for doc, number, crc in found for d, c in zip(doc.tolist(), crc[number].tolist()))
    assert have == sorted((d, zlib.crc32(g.encode())) for d, t in enumerate(texts) for g in grams(t, max_run)[1])


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (0, 5, 30, 1, 1)] + [None, ""]})
    for size in (1, 6, 100):
        parts = list(resampling.slices(batch, 0, size))
        assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
        assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= size for p in parts)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = op11_resampling(spark, sf).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, rows), key=repr) == plain(docs, target)
