"""Each stage of the pipeline against plain versions, on the smallest tables and on odd rows."""

import math
import zlib

import numpy as np
import pytest
from test_jaccard import brute as near
from test_tokens import check_packing

import corpus_pipeline
from gleanery.llm import exact_dedup, mixing, toxicity
from gleanery.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def norm(text):
    return b"".join((text or "").encode().split())


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs[-1], SF).write.parquet(path)
        docs.append(spark.read.parquet(path))
    return [d.collect() for d in docs], docs


def test_stages(outputs, spark):
    (start, clean, once, apart, mixed, packed), frames = outputs
    assert all(f.schema.names == frames[0].schema.names for f in frames[:5])
    scores = {r.doc_id: r.predicted for r in toxicity.score(frames[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert sorted(r for r in start if not scores[r.doc_id]) == sorted(clean)
    groups = {}
    for r in clean:
        groups.setdefault(norm(r.text), []).append(r)
    assert sorted(min(g, key=lambda r: (-len(r.text), r.doc_id)) for g in groups.values()) == sorted(once)
    component = {r[0]: r[2] for r in near([(r.doc_id, r.text) for r in once])}
    assert sorted(r for r in once if component[r.doc_id] == r.doc_id) == sorted(apart)
    plan = {r.doc_id: r for r in mixing.mix(frames[3]).collect()}
    want = [r for r in apart for _ in range(math.ceil(plan[r.doc_id].taken / plan[r.doc_id].size))]
    assert sorted(want) == sorted(mixed)

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    check_packing(t, [(r.doc_id, r.text) for r in mixed], packed)


def test_run(outputs, spark):
    assert corpus_pipeline.run(spark, SF).count() == len(outputs[0][-1])


def test_odd_rows(spark):
    rows = [
        (1, None, "en", "a", 0),
        (2, "", None, None, None),
        (3, " \n", "en", "a", 2),
        (4, "one two three four five six seven", "en", "a", 1),
        (4, "one two three four five six seven", "en", "a", 1),
        (4, "another text of the same id with words", "en", "b", 1),
        (None, "one two  three four five six seven", "en", None, 1),
        (None, "ONE two three four five six seven", "en", "c", 1),
        (9, "word " * 30_000, "en", "c", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for data in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = data.count()
            data = stage(spark, data, SF)
            assert data.columns == docs.columns
            assert data.count() <= (before if "mixing" not in name else 2 * before)
    kept = exact_dedup.without_copies(docs).collect()
    assert sorted((r.doc_id or -1, norm(r.text)) for r in kept) == sorted(
        [(-1, norm(rows[7][1])), (-1, norm(rows[6][1])), (3, b""), (4, norm(rows[5][1])), (9, norm(rows[8][1]))]
    )


def test_mixing(spark):
    rows = [(i, "w " * (i * i % 13), "s", f"s{i % 5}" if i % 11 else None) for i in range(400)] + [(None, None, "x", "s0"), (3, "a b", "y", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    total = {}
    for r in got:
        total.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(sum(t) == math.floor(target) <= 2 * size for (size, target), t in total.items())
    assert abs(sum(t for _, t in total) - 1.5 * sum(s for s, _ in total)) < 1e-6
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_rows_of_one_id(spark):
    """Null and repeated ids in every source: each source still gets its own target."""
    rows = [(None if i % 3 else i % 7, f"s{i % 5}", "w " * (i % 4 + i % 5 * 3), i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n int")
    target = {}
    for r in mixing.mix(docs).select("source_size", "target").distinct().collect():
        target[r.source_size] = math.floor(r.target)
    size, got = {}, {}
    for _, source, text, _ in rows:
        size[source] = size.get(source, 0) + len(text.split())
    for r in mixing.mixed_documents(docs).collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert len(set(size.values())) == len(size) == len(target)
    longest = max(len(r[2].split()) for r in rows)
    for source, n in size.items():
        assert target[n] <= got.get(source, 0) < target[n] + longest


def test_naming_is_exact(spark):
    """Blocks of one byte: every level of names is used."""
    texts = ["", None, "a", "aa", "aaa", "aaaa", "aaaaa", "ab", "ba", "abab", "baba", "a b\ta\x0bb", "abc" * 40, "abc" * 40 + "d", "é", "é"]
    rows = [(i, t, "x") for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    want = sorted((i, min(g)[1], len(g), (n, i) == min(g)) for g in groups.values() for n, i in g)
    got = sorted(tuple(r)[:4] for r in exact_dedup.exact_dedup(docs, 1).collect())
    assert got == want


def test_heavy_names(spark, monkeypatch):
    from gleanery.llm import common

    monkeypatch.setattr(common, "HEAVY_ROWS", 5)
    rows = [(i, "copy of one text" if i % 2 else f"text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, 2).collect()}
    assert got == {i: (1, 100) if i % 2 else (i, 1) for i in range(200)}


def test_toxicity(spark):
    bad = ["vile", "foul"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        rows.append((i, f"some {'words ' * (i % 9)} {chr(97 + i // 26)}{chr(97 + i % 26)}x {bad[i // 5 % 2] if toxic else 'kind'} end", "x"))
        labels.append((i, 1, int(toxic), "s"))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "a vile one", "x"), (1002, "a vile one", "x"), (1002, "a vile one", "x"), (1003, "word " * 50_000, "x")]
    labels += [(None, 1, 1, "s"), (1000, 1, None, "s"), (5, 1, 1, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = toxicity.score(docs, given).collect()
    assert len(got) == len(rows)
    import zlib

    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        want = r.doc_id in (None, 1002) or (r.doc_id < 600 and r.doc_id % 5 == 0)
        assert r.predicted == int(want), r
    none = toxicity.score(docs, given.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    assert toxicity.score(docs.limit(0), given).count() == 0


def plain_label_model(fired, start, rounds):
    """The same estimate, one row and one pair of voters at a time."""
    n, voters = len(fired), range(len(fired[0]))
    q = [float(y) for y in start]
    share = min(max(sum(q) / n, 1e-3), 1 - 1e-3)

    def rates(q):
        return [(sum(q[i] for i in range(n) if fired[i][j]) + 0.5) / (sum(q) + 1) for j in voters]

    def mixed(q, first, worth):
        return [(r * (sum(q) + 1) + worth * f) / (sum(q) + 1 + worth) for r, f in zip(rates(q), first)]

    others = [1 - x for x in q]
    first1, first0 = rates(q), rates(others)
    for _ in range(rounds):
        others = [1 - x for x in q]
        r1 = mixed(q, first1, toxicity.PRIOR_WEIGHT * n * share)
        r0 = mixed(others, first0, toxicity.PRIOR_WEIGHT * n * (1 - share))
        rest = [[fired[i][j] - q[i] * r1[j] - others[i] * r0[j] for j in voters] for i in range(n)]
        cov = [[sum(r[a] * r[b] for r in rest) / n for b in voters] for a in voters]
        say = []
        for a in voters:
            total = 1.0
            for b in voters:
                c = cov[a][b] / ((cov[a][a] ** 0.5 + 1e-9) * (cov[b][b] ** 0.5 + 1e-9))
                if a != b and abs(c) >= 0.1:
                    total += c * c
            say.append(1 / total)
        for i in range(n):
            odds = math.log(share / (1 - share))
            for j in voters:
                odds += say[j] * (math.log(r1[j] / r0[j]) if fired[i][j] else math.log((1 - r1[j]) / (1 - r0[j])))
            q[i] = 1 / (1 + math.exp(-min(max(odds, -30), 30)))
    return q


def random_votes(seed):
    """Voters of different accuracy, one of which repeats another."""
    rng = np.random.default_rng(seed)
    truth = rng.random(300) < 0.3
    speaks = np.array([(0.8, 0.05), (0.6, 0.1), (0.5, 0.02), (0.3, 0.25), (0.1, 0.6)])
    fired = rng.random((300, 5)) < np.where(truth[:, None], speaks[:, 0], speaks[:, 1])
    return truth, np.column_stack((fired, fired[:, 0] | (rng.random(300) < 0.02)))


def test_label_model():
    for seed in range(3):
        truth, fired = random_votes(seed)
        want = plain_label_model(fired.tolist(), truth.tolist(), 5)
        assert np.allclose(toxicity.label_model(fired, truth, 5), want, atol=1e-9)


def test_posteriors_come_from_votes():
    truth, fired = random_votes(9)
    wrong = truth ^ (np.random.default_rng(1).random(300) < 0.1)
    q = toxicity.label_model(fired, wrong)
    by_votes = {}
    for votes, x in zip(fired.tolist(), q.tolist()):
        by_votes.setdefault(tuple(votes), set()).add(round(x, 12))
    assert all(len(x) == 1 for x in by_votes.values())
    # Wrong labels do not come back out of the model.
    assert ((q >= 0.5) == truth).mean() > (wrong == truth).mean()


def test_training_rows_are_bounded(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    rows = [(ids[0], f"copy {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(300)] + [(i, f"text {chr(97 + i % 26)}") for i in ids[1:]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    assert len(toxicity.training_rows(docs, labels)) == len(ids)
    assert len(toxicity.training_rows(docs, labels, 5)) == 5
    found = toxicity.training_rows(docs.repartition(7), labels)
    assert [x.tolist() for _, x in found] == [x.tolist() for _, x in toxicity.training_rows(docs, labels)]


def plain_train(found):
    """The model from (label, features) of documents by doc_id, all of them on the driver."""
    found = list({x.tobytes(): (label, x) for label, x in reversed(found)}.values())
    y = np.array([label for label, _ in found], float)
    size = toxicity.N_PATTERNS + (1 << toxicity.HASH_BITS)
    rows = np.repeat(np.arange(len(found)), [len(x) for _, x in found])
    ids = np.concatenate([x for _, x in found])
    df1, df0 = (np.bincount(ids[y[rows] == label], minlength=size).astype(float) for label in (1, 0))
    votes = toxicity.Votes(df1, df0, y.sum(), len(y) - y.sum())
    q = toxicity.label_model(votes.of(rows, ids, len(y)), y)
    place = np.full(size, -1)
    place[votes.chosen] = np.arange(len(votes.chosen))
    used = place[ids] >= 0
    w, bias = toxicity.linear_classifier(rows[used], place[ids[used]], len(y), len(votes.chosen), q)
    weights = np.zeros(size, np.float32)
    weights[votes.chosen] = w
    return weights, bias


def test_training_sends_the_driver_lexicon_entries_alone(spark, monkeypatch):
    rows, labels = [], []
    for i in range(1, 500):
        toxic = i % 4 == 0
        odd = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for k in range(200 if i % 50 else 0))
        rows.append((i, f"{odd} {('vile', 'foul', 'rotten')[i % 3] if toxic or i % 90 == 1 else 'kind'}{'!!' if i % 7 == 0 else ''}"))
        rows += [(1000 + i, rows[-1][1])] * (i % 20 == 0)
        labels += [(i, int(toxic)), (1000 + i, int(i % 40 == 0))]
    docs = spark.createDataFrame([*rows, (5000, None)], "doc_id long, text string").repartition(5)
    table = toxicity.training_table(docs, spark.createDataFrame([*labels, (5000, 0)], "doc_id long, toxic int"))
    found = toxicity.training_rows(docs, spark.createDataFrame([*labels, (5000, 0)], "doc_id long, toxic int"))
    sent, to_arrow = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: sent.append(to_arrow(self)) or sent[-1])
    weights, bias = toxicity.train(table)
    assert 0 < sum(t.nbytes for t in sent) < sum(x.nbytes for _, x in found) / 10
    want, want_bias = plain_train(found)
    assert np.count_nonzero(want) > 3 and np.array_equal(weights, want) and bias == want_bias


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.97 * len(rows)
    assert sum(r.predicted > r.toxic for r in rows) <= 0.005 * len(rows)
