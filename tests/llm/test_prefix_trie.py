"""The trie of conversations against a plain version."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from gleanery.llm import prefix_trie
from gleanery.llm.queries import op12_prefix_trie

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def order(turn, role, text):
    raw = f"{len(role.encode())}:{role}{text}".encode()
    return (turn is not None, turn or 0, role.encode(), hashlib.sha256(raw).hexdigest())


def sequences(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts, key=lambda t: order(*t))] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + ts[h:]
    return out


def trie(paths):
    """paths: conv -> tuple of (role, text)."""
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[tuple(p[:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        own = (len(nodes[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        saved[p] = own + sum(saved[k] for k in kids[p])
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(p))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, path string")
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df, **options).select(*COLUMNS).collect()), key=repr)


def made_up(seed, convs=120, most=6):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-50, 2 * convs), convs):
        for t in range(rng.randint(1, most)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "", None])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_rows, merged_blocks", [(1 << 15, 128), (3, 2), (1, 3)])
def test_random_conversations(spark, block_rows, merged_blocks):
    rows = made_up(block_rows)
    assert got(spark, rows, block_rows=block_rows, merged_blocks=merged_blocks) == trie(sequences(rows))


def test_odd_conversations(spark):
    rows = [(20, 0, "u", "x y"), (20, 1, "a", "z"), (20, 1, "a", "z"), (None, 0, "u", "lost"), (20, None, None, None)]
    rows += [(21 + i, t, "u", "x y" if t == 0 else f"{i % 3}") for i in range(15) for t in range(1 + i % 4)]
    # No first conversation in their group; role and text that meet only without a boundary.
    rows += [(60 + i, 0, "ab" if i % 2 else "a", "c" if i % 2 else "bc") for i in range(1, 9)]
    rows += [(-3, 0, "u", "x y"), (-20, 0, "u", "w"), (2**62, 0, "", ""), (100, 0, "u", "long " * 20_000)]
    rows += [(200, t, "u", f"turn {t % 5}") for t in range(500)]
    assert got(spark, rows) == trie(sequences(rows))


def test_many_copies_lie_in_several_blocks(spark):
    rows = [(20 * i, t, "u", "same" if t < 2 else "t") for i in range(200) for t in range(3 if i % 10 == 0 else 2)]
    want = trie(sequences(rows))
    assert got(spark, rows, block_rows=7, merged_blocks=4) == want
    assert max(r[3] for r in want if r[1] == 2) == 200


def test_no_conversations(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "u", "t")]) == []


def test_turnless_alone(spark):
    # Of group 0 without its first one: h is at least 1, so its one turn goes.
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    assert got(spark, [(c, 0, "u", "t")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=5), min_size=1, max_size=14), st.data())
def test_blocks_and_merges(paths, data):
    """Blocks of any sizes merged in any order give the plain trie, without Spark."""
    convs = sorted((bytes(k for t in p for k in [t] * prefix_trie.KEY), c) for c, p in enumerate(paths))
    depths = {c: len(p) for c, p in enumerate(paths)}
    blocks, closed, became, ends = [], [], [], []
    at = 0
    while at < len(convs):
        n = data.draw(st.integers(1, len(convs) - at))
        some = convs[at : at + n]
        words = [[1 + p[i] for i in range(0, len(p), prefix_trie.KEY)] for p, _ in some]
        block, inner, listed = prefix_trie.forest([c for _, c in some], [p for p, _ in some], words, at)
        blocks.append(block)
        closed += inner
        ends += [((at, slot), ids) for slot, ids in listed]
        at += n
    while len(blocks) > 1:
        i = data.draw(st.integers(0, len(blocks) - 2))
        blocks[i : i + 2] = [prefix_trie.merge(blocks[i], blocks[i + 1], closed, became)]
    prefix_trie.finish(blocks[0], closed)
    final = {(r[0], r[1]): (r[4], r[5]) for r in closed if r[0] is not None}
    for block, slot, to_block, to_slot in reversed(became):
        final[block, slot] = final[to_block, to_slot]
    rows = {}
    for r in closed:
        parent = final[r[2], r[3]][0] if r[2] is not None else r[6]
        rows[r[4], r[5]] = [r[4], r[5], parent, *r[7:11], r[11]]
    listed = defaultdict(list)
    for number, ids in ends:
        listed[final[number]] += ids
    for key, row in rows.items():
        if row[7] is None:
            row[7] = hashlib.sha256(",".join(map(str, listed.get(key, []))).encode()).hexdigest()
    want = trie({c: [("u", " ".join(["w"] * (1 + t))) for t in p] for c, p in enumerate(paths)})
    assert len(closed) == len(want) and depths
    assert sorted(map(tuple, rows.values()), key=repr) == want


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in op12_prefix_trie(spark, sf).select(*COLUMNS).collect()), key=repr) == trie(sequences(rows))
