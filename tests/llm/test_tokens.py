"""Packing and token counts against plain versions."""

import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from gleanery.llm import packing, sharding, token_count
from gleanery.llm.queries import SHARDS, tokenizer_path

ODD = [
    None,
    "",
    " ",
    "\n",
    "a",
    "  two  blanks ",
    "tab\tand\x0bvt \n\n new\r\nline  ",
    "don't we'll nbsp 　wide x 12 345",
    "<|endoftext|> as text",
    "a " * 3000,
    "x" * 20_000,
    "\U0001f600 \U0001f468‍\U0001f469‍\U0001f467 é",
    "   x \x85 y \x1c z ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", i) for i, t in enumerate(ODD)] + [(None, "null id", None, 0), (4, "a", "s", 1), (4, "a", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, piece int")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def plain_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def check_packing(tokenizer, texts, rows, capacity=1024):
    """texts: (doc_id, text); rows: what the operator gave."""
    want = []
    for doc_id, text in texts:
        ids = plain_ids(tokenizer, text)
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(want, key=repr) == sorted((tuple(r)[:5] for r in rows), key=repr)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(r.length for r in rows)


def test_packing_odd_texts(docs, tokenizer):
    rows = packing.pack(docs, tokenizer_path()).collect()
    check_packing(tokenizer, [(r.doc_id, r.text) for r in docs.collect()], rows)


def test_packing_whole_table(spark, tokenizer):
    from gleanery.llm.queries import op3_packing

    sf = "/root/testdata/sf0.001"
    rows = op3_packing(spark, sf).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sequences, tokens = check_packing(tokenizer, texts, rows)
    assert sequences <= -(-tokens // 1024) * 1.01 + 1


def test_packing_empty(docs):
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


@given(st.lists(st.integers(1, 64), max_size=300), st.integers(1, 9))
def test_best_fit(lengths, most):
    fit = packing.BestFit(64, most)
    free = {}
    for n in lengths:
        at, offset = fit.place(n)
        assert offset == 64 - free.get(at, 64)
        free[at] = 64 - offset - n
        assert free[at] >= 0
        held = [b for bins in fit.bins for b in bins]
        assert len(held) == fit.n_open <= most
        assert {i for i, bins in enumerate(fit.bins) if bins} == {i for i in range(65) if fit.mask >> i & 1}


ENCODE = packing.ids_of(tokenizer_path())


@given(st.one_of(st.text(max_size=60), st.text(alphabet=st.sampled_from("ab'sd \n\t .1\u3000\xe9\xa0"), max_size=60)))
@settings(deadline=None, max_examples=300)
def test_ids_are_those_of_the_library(tokenizer, text):
    assert np.frombuffer(ENCODE(text), "<u4").tolist() == plain_ids(tokenizer, text)[:-1]


@pytest.mark.parametrize(
    "text",
    [
        "a" + " " * 2_000_000 + "b",
        "a" + "\n" * 2_000_000 + "b",
        "\n" * 1_200_000 + "b  c",
        "a " + "\u3000\t \x85" * 300_000,
        "a\x1c" + " " * 1_100_000 + "\n's" + "\n " * 600_000 + "\x1d 1" + " " * (packing.LONG_RUN - 1) + "!",
    ],
    ids=["blanks", "newlines", "start", "end", "several"],
)
def test_long_white_space(tokenizer, text):
    assert np.frombuffer(ENCODE(text), "<u4").tolist() == plain_ids(tokenizer, text)[:-1]


@given(st.text(alphabet=st.sampled_from("a1'!s \n\t\u3000\xa0\x85\x1c"), max_size=40))
@settings(deadline=None, max_examples=200)
def test_white_space_cut_short(tokenizer, text):
    runs, length = packing._LONG_RUNS, packing.LONG_RUN
    packing._LONG_RUNS, packing.LONG_RUN = re.compile(runs.pattern.replace(str(length), "2")), 2
    try:
        assert np.frombuffer(ENCODE(text), "<u4").tolist() == plain_ids(tokenizer, text)[:-1]
    finally:
        packing._LONG_RUNS, packing.LONG_RUN = runs, length


def test_special_tokens_as_the_library_does(spark, tmp_path):
    """The queries' own calls, against the library with nothing set on it."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from gleanery.llm.queries import op3_packing

    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}x  {end}  y", f"{end[:-1]} {end[1:]}", f"a\n\n{end}\n", " " * 1_200_000 + end + "\n" * 1_200_000, (f"w {end}" * 900), None]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    plain = Tokenizer.from_file(tokenizer_path())
    assert plain.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    docs = spark.read.parquet(path)
    for packed in (op3_packing(spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))):
        check_packing(plain, list(enumerate(texts)), packed.collect())


def plain_count(vocabulary, word, longest=5):
    n, at = 0, 0
    while at < len(word):
        size = next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary)
        at += size
        n += 1
    return n


def test_token_counts(docs, spark):
    vocabulary = set(token_count.byte_vocabulary(tokenizer_path()))
    assert len(vocabulary) == 50_256
    longest = max(map(len, vocabulary))
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for table in (docs, more):
        want = []
        for r in table.collect():
            words = (r.text or "").encode().split()
            want.append((r.doc_id, len(words), sum(plain_count(vocabulary, b" " + w, longest) for w in words)))
        got = [tuple(r) for r in token_count.token_counts(table, tokenizer_path()).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert token_count.token_counts(docs.limit(0), tokenizer_path()).count() == 0


@given(
    st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(c % 3 + 97 for c in b)), max_size=12),
    st.lists(st.text(alphabet="abc", max_size=12), max_size=6),
)
@settings(deadline=None, max_examples=60)
def test_automaton(pieces, words):
    vocabulary = pieces | {bytes([c]) for c in range(256)}
    automaton = token_count.Automaton(list(vocabulary))
    text = " ".join(words)
    n, tokens = token_count._count_texts(automaton, [text, None])
    found = text.encode().split()
    assert (n.tolist(), tokens.tolist()) == ([len(found), 0], [sum(plain_count(vocabulary, b" " + w) for w in found), 0])


def test_lookup_table():
    table = sharding.lookup_table(SHARDS, 65_537)
    counts = np.bincount(table, minlength=len(SHARDS))
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(SHARDS[:-1], 65_537)
    moved = (table != fewer) & (table != len(SHARDS) - 1)
    assert moved.mean() < 0.05
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 10)


def test_shard(docs, spark, tmp_path):
    got = sharding.shard(docs.withColumn("shard", docs.text), "doc_id", ["x", "y", "z"], 101)
    assert got.columns == ["doc_id", "text", "sequence_id", "piece", "slot", "shard"]
    rows = got.collect()
    assert len(rows) == docs.count()
    by_key = {}
    for r in rows:
        assert r.shard in ("x", "y", "z") and 0 <= r.slot < 101
        assert by_key.setdefault(r.doc_id, r.slot) == r.slot
    assert sharding.shard(docs.limit(0), "doc_id", ["x"], 7).count() == 0
    path = str(tmp_path / "out")
    sharding.write_shards(docs, path, "doc_id", ["x", "y"], 11)
    assert spark.read.parquet(path).count() == docs.count()
    sf = "/root/testdata/sf0.01/documents.parquet"
    sizes = [r[1] for r in sharding.shard(spark.read.parquet(sf), "doc_id", SHARDS[:8]).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)
