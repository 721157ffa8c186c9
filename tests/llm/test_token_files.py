"""Files of directly addressable codes: exact round trips, random access, and the whole operator."""

import glob
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from gleanery.llm import token_files
from gleanery.llm.queries import op13_token_files, tokenizer_path

ids = st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**32 - 1)), min_size=1, max_size=700)


def file_of(values, ends=None, doc_ids=None):
    values = np.array(values, np.uint32)
    ends = [len(values)] if ends is None else ends
    raw = token_files.encode_file(doc_ids or list(range(len(ends))), np.array(ends), values)
    reads = []

    def read(at, size):
        reads.append(size)
        return raw[at : at + size]

    file = token_files.TokenFile(read)
    assert file.size == len(raw)
    file.reads = reads
    return file


@settings(max_examples=100, deadline=None)
@given(ids, st.data())
def test_any_stretch(values, data):
    file = file_of(values)
    a = data.draw(st.integers(0, len(values)))
    b = data.draw(st.integers(a, len(values)))
    assert file.get(a, b).tolist() == values[a:b]
    i = data.draw(st.integers(0, len(values) - 1))
    assert file.token(i) == values[i]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), ids), min_size=1, max_size=5))
def test_documents(docs):
    file = file_of(sum((d for _, d in docs), []), np.cumsum([len(d) for _, d in docs]), [i for i, _ in docs])
    assert file.doc_ids() == [i for i, _ in docs]
    assert [file.document(i).tolist() for i in range(len(docs))] == [d for _, d in docs]
    assert file.crcs() == [zlib.crc32(np.array(d, "<u4").tobytes()) for _, d in docs]


def test_crcs_over_stretches(monkeypatch):
    monkeypatch.setattr(token_files, "STRETCH", 16)
    docs = [[5] * 40, [70_000], [1] * 16, [2] * 7]
    file = file_of(sum(docs, []), np.cumsum([len(d) for d in docs]))
    assert file.crcs() == [zlib.crc32(np.array(d, "<u4").tobytes()) for d in docs]


def test_one_token_needs_few_bytes():
    values = np.random.default_rng(1).integers(0, 50_257, 200_000)
    file = file_of(values)
    file.reads.clear()
    assert file.token(123_456) == values[123_456]
    assert sum(file.reads) < 400


def test_widths_are_the_cheapest():
    values = np.random.default_rng(2).zipf(1.3, 3000).clip(0, 5000).astype(np.uint32)
    top = int(values.max()).bit_length()

    def bits(widths):
        total, k = 0, 0
        for i, w in enumerate(widths):
            n = len(values) if i == 0 else int(np.count_nonzero(values >> np.uint32(k)))
            total, k = total + n * (w + (i + 1 < len(widths))), k + w
        return total

    def ways(n):
        return [[]] if n == 0 else [[w, *rest] for w in range(1, n + 1) for rest in ways(n - w)]

    assert bits(token_files.widths_for(values)) == min(map(bits, ways(top)))


def test_not_a_file():
    with pytest.raises(ValueError):
        token_files.TokenFile(lambda at, size: b"12345678"[:size])


ODD = [(i, t) for i, t in enumerate(["a", None, "", " ", "two  blanks\n", "<|endoftext|> x", "é\U0001f600", "word " * 50_000, "don't"])]
ODD += [(None, "null id"), (None, ""), (None, ""), (4, "again"), (4, "again"), (-7, "negative"), (2**62, "large")]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def expected(library, docs):
    """(doc_id, n_tokens, crc) by the tokenizers library, ids ended by 0."""
    out = []
    for doc_id, text in docs:
        found = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
    return out


def check(rows, want):
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows], key=repr) == sorted(want, key=repr)
    # In ascending order of doc_id, null last, without gaps.
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    by_start = [(r.doc_id is None, r.doc_id or 0) for r in sorted(rows, key=lambda r: r.start)]
    assert by_start == sorted(by_start)


@pytest.mark.parametrize("file_tokens", [1, 40, 1 << 23])
def test_files(spark, tmp_path, library, file_tokens):
    docs = spark.createDataFrame([(*r, 1, "p") for r in ODD], "doc_id long, text string, start long, path string")
    manifest = token_files.write_token_files(docs, str(tmp_path / "ids"), tokenizer_path(), file_tokens=file_tokens)
    check(token_files.read_token_files(manifest).collect(), expected(library, ODD))
    listed = {r.path for r in manifest.collect()}
    assert listed == set(glob.glob(f"{tmp_path}/ids/*.ids"))
    # Any token of all files by its place.
    every = np.concatenate([token_files.TokenFile.open(r.path).get(0, r.n_tokens) for r in sorted(manifest.collect(), key=lambda r: r.before)])
    places = [0, 1, 5, len(every) - 1, 5, 7, None, -1, len(every), 10**15]
    asked = spark.createDataFrame([(p, "x") for p in places], "place long, id string")
    found = token_files.tokens_at(manifest, asked).collect()
    want = [(p, int(every[p]) if p is not None and 0 <= p < len(every) else None) for p in places]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_left_over_files_are_not_read(spark, tmp_path, library):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    folder = str(tmp_path / "ids")
    token_files.write_token_files(docs, folder, tokenizer_path())
    manifest = token_files.write_token_files(docs, folder, tokenizer_path())
    check(token_files.read_token_files(manifest).collect(), expected(library, [(1, "a"), (2, "b")]))


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.token_round_trip(spark, docs, tokenizer_path()).collect() == []


def test_hot_null_id_lies_in_several_ranges(spark, tmp_path, library):
    rows = [(None, f"row {i % 3}") for i in range(3000)] + [(i, "x") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = token_files.write_token_files(docs, str(tmp_path / "ids"), tokenizer_path())
    check(token_files.read_token_files(manifest).collect(), expected(library, rows))
    assert manifest.filter("n_docs > 1000").count() == 0


def test_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(op13_token_files(spark, sf).collect(), expected(library, docs))
