"""The trie of the prefixes of conversations.

Sorted by their turns, conversations that share a prefix are neighbours, and what two neighbours share is
an edge between them. Within a block of neighbours the edges are taken in descending depth, and a
union-find joins what they connect: each join makes a branching node, or widens one of the same depth. That
leaves a forest in which all is known but the nodes on the paths to the block's first and last
conversation, which the neighbouring blocks may share. A block is contracted to these two paths. Blocks
are then merged, many at a time and over and over: on both sides of a boundary the nodes of the shared prefix become
one, and those that now lie inside are closed. Nodes go by number, and a table of which became which
leads from a block's nodes to the final ones.
"""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, partitions
from .mixing import n_words

# A group of conversations, the first of which the others borrow from, and how many turns at most.
GROUP = 20
BORROWED = 4
# A turn is known by so many bytes of the SHA-256 of its role and text.
KEY = 16
BLOCK_ROWS = 1 << 15
BLOCK_TURNS = 1 << 19
MERGED_BLOCKS = 128

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
# A node's number is that of its block, and one within the block. `up_` is the number of the parent.
_CLOSED = "block long, slot int, up_block long, up_slot int, " + _NODE
_OPEN = "block long, slot int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long"
_SUMMARY = f"pos long, first binary, last binary, shared int, left array<struct<{_OPEN}>>, right array<struct<{_OPEN}>>"
_RESULT = f"kind string, closed struct<{_CLOSED}>, summary struct<{_SUMMARY}>, became struct<block:long,slot:int,to_block:long,to_slot:int>, ends struct<block:long,slot:int,pos:long,ids:binary>"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, group: int = GROUP, borrowed: int = BORROWED) -> DataFrame:
    """conv_id, path, words: each conversation's turns after its first few were replaced by those of its group's first.

    `path` is the turns' keys one after another, `words` how many words each turn has. A conversation is one row: 16
    bytes and a number a turn, texts stay where they are, so it may have as many turns as fit a cell (100 million).
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"),
        F.struct(
            F.col("turn"),
            role.alias("role"),
            # The role's length goes ahead, so that no other role and text give the same bytes.
            F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY).alias("key"),
            n_words(text).alias("words"),
        ).alias("t"),
    )
    # Sent by group, so that a conversation and its group's first one meet without a further shuffle.
    own = (
        turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
        .repartition("base")
        .groupBy("base", "conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("own"))
    )
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, borrowed - 1))).over(Window.partitionBy("base"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(borrowed)).cast("int")
    taken = F.slice(F.coalesce("head", F.expr("slice(own, 1, 0)")), F.lit(1), F.col("h"))
    rest = F.slice("own", F.col("h") + 1, F.size("own"))
    turns_now = F.when(F.col("conv_id") == F.col("base"), F.col("own")).otherwise(F.concat(taken, rest))
    return (
        own.withColumn("head", head)
        .withColumn("h", h)
        .select("conv_id", turns_now.alias("turns"))
        .select("conv_id", F.unhex(F.array_join("turns.key", "")).alias("path"), F.col("turns.words").alias("words"))
    )


@dataclass
class Open:
    """A node that neighbouring blocks may share: what is known of it so far. `kids`, `leaves` and `saved` are those of
    its closed children."""

    block: int
    slot: int
    conv: int
    n: int
    kids: int
    leaves: int
    saved: int
    words: int


@dataclass
class Block:
    """Neighbouring conversations, contracted. `left` are the nodes on the path to the first one by depth, `right` those on
    the path to the last one that are not on the other, from depth shared + 1 on."""

    first: bytes
    last: bytes
    shared: int
    left: list[Open]
    right: list[Open]

    def to_last(self, depth: int) -> Open:
        return self.left[depth] if depth <= self.shared else self.right[depth - self.shared - 1]


def common_depth(a: bytes, b: bytes) -> int:
    """How many keys two paths share from the start."""
    low, high = 0, min(len(a), len(b)) // KEY
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * KEY] == b[: middle * KEY]:
            low = middle
        else:
            high = middle - 1
    return low


def _close(node: Open, depth: int, parent: Open | None, closed: list) -> None:
    """Settles a node whose children are all closed, and adds it to its parent."""
    leaves = node.leaves if node.kids else 1
    saved = node.saved + (node.n - 1) * node.words
    up = (parent.block, parent.slot) if parent else (None, None)
    closed.append((node.block, node.slot, *up, node.conv, depth, None, node.n, node.kids, leaves, saved, None))
    if parent:
        parent.kids, parent.leaves, parent.saved = parent.kids + 1, parent.leaves + leaves, parent.saved + saved


def merge(a: Block, b: Block, closed: list, became: list) -> Block:
    """Two blocks, `b` right after `a`, as one. Adds the nodes that are inside now to `closed`."""
    depth = common_depth(a.last, b.first)
    for d in range(depth + 1):
        x, y = a.to_last(d), b.left[d]
        became.append((y.block, y.slot, x.block, x.slot))
        x.n, x.conv = x.n + y.n, min(x.conv, y.conv)
        x.kids, x.leaves, x.saved = x.kids + y.kids, x.leaves + y.leaves, x.saved + y.saved
        b.left[d] = x
    # What ended with the last of `a`, what began with the first of `b`, and what spans the boundary but reaches
    # neither end. The deepest first, so that children come before parents.
    for d in range(len(a.last) // KEY, max(a.shared, depth), -1):
        _close(a.to_last(d), d, a.to_last(d - 1), closed)
    for d in range(len(b.first) // KEY, max(b.shared, depth), -1):
        _close(b.left[d], d, b.left[d - 1], closed)
    for d in range(depth, max(a.shared, b.shared), -1):
        _close(a.to_last(d), d, a.to_last(d - 1), closed)
    shared = min(a.shared, depth, b.shared)
    right = [*b.left[shared + 1 : b.shared + 1], *b.right]
    return Block(a.first, b.last, shared, a.left, right)


def finish(block: Block, closed: list) -> None:
    """Closes what is open when no block is left on either side."""
    for d in range(len(block.last) // KEY, block.shared, -1):
        _close(block.to_last(d), d, block.to_last(d - 1), closed)
    for d in range(len(block.first) // KEY, -1, -1):
        _close(block.left[d], d, block.left[d - 1] if d else None, closed)


def forest(convs: list[int], paths: list[bytes], words: list[list[int]], number: int) -> tuple[Block, list, list]:
    """A block of sorted conversations contracted, its closed nodes, and the conversations that end at open ones: (slot, ids)."""
    n = len(convs)
    shares = [common_depth(paths[i], paths[i + 1]) for i in range(n - 1)]
    # Nodes: to begin with one per conversation. A node's rows are those from `row` on.
    depth = [len(p) // KEY for p in paths]
    row, count, least = list(range(n)), [1] * n, list(convs)
    kids: list[list[int]] = [[] for _ in range(n)]
    ends = [[c] for c in convs]
    over, top = list(range(n)), list(range(n))

    def find(i):
        while over[i] != i:
            over[i] = i = over[over[i]]
        return i

    for i in sorted(range(n - 1), key=lambda i: -shares[i]):
        a, b, d = find(i), find(i + 1), shares[i]
        x, y = top[a], top[b]
        if depth[x] == d and depth[y] == d:
            kids[x] += kids[y]
            ends[x] += ends[y]
            new = x
        elif depth[x] == d:
            kids[x].append(y)
            new = x
        elif depth[y] == d:
            kids[y].insert(0, x)
            new = y
            row[y] = row[x]
        else:
            new = len(depth)
            depth.append(d)
            row.append(row[x])
            kids.append([x, y])
            ends.append([])
            count.append(0)
            least.append(0)
        total, smallest = count[x] + count[y], min(least[x], least[y])
        count[new], least[new] = total, smallest
        over[b], top[a] = a, new

    # Each node stands for the depths below its parent's, which have the same members. Parents come before their
    # children in `order`.
    root = top[find(0)]
    order, above = [root], {root: -1}
    for x in order:
        for y in kids[x]:
            above[y] = depth[x]
            order.append(y)
    closed: list = []
    open_ends: list = []
    left: list[Open] = []
    right: list[Open] = []
    tops, leaves, saved = {}, {}, {}
    for x in reversed(order):
        low, last_words, spread = above[x], words[row[x]], count[x] - 1
        at_left, at_right = row[x] == 0, row[x] + count[x] == n
        shut = [y for y in kids[x] if y in tops]
        n_leaves, n_saved = sum(leaves[y] for y in shut), sum(saved[y] for y in shut)
        if at_left or at_right:
            side = int(not at_left)
            for d in range(depth[x], low, -1):
                sums = (len(shut), n_leaves, n_saved) if d == depth[x] else (0, 0, 0)
                node = Open(number, 2 * d + side, least[x], count[x], *sums, last_words[d - 1] if d else 0)
                (right if side else left).append(node)
            if ends[x]:
                open_ends.append((2 * depth[x] + side, ends[x]))
            for y in shut:
                tops[y][2:4] = number, 2 * depth[x] + side
            continue
        leaves[x] = n_leaves if kids[x] else 1
        for y in shut:
            tops[y][6] = least[x]
        sha = hashlib.sha256(",".join(map(str, ends[x])).encode()).hexdigest()
        n_kids = len(kids[x])
        for d in range(depth[x], low, -1):
            n_saved += spread * (last_words[d - 1] if d else 0)
            closed.append([None, None, None, None, least[x], d, least[x], count[x], n_kids, leaves[x], n_saved, sha])
            sha, n_kids = NO_ENDS, 1
        tops[x], saved[x] = closed[-1], n_saved
    left.sort(key=lambda o: o.slot)
    right.sort(key=lambda o: o.slot)
    return Block(paths[0], paths[-1], min(shares, default=depth[0]), left, right), closed, open_ends


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def _batches(schema: pa.Schema, closed: list, summaries: list, became: list, ends: list, size: int = 20_000):
    """Rows of _RESULT, one kind after the other."""
    for kind, rows in (("closed", closed), ("summary", summaries), ("became", became), ("ends", ends)):
        for at in range(0, len(rows), size):
            some = rows[at : at + size]
            names = [f.name for f in schema.field(kind).type]
            values = pa.array([dict(zip(names, r)) for r in some], schema.field(kind).type)
            columns = [
                pa.array([kind] * len(some)) if f.name == "kind" else values if f.name == kind else pa.nulls(len(some), f.type)
                for f in schema
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _summary(pos: int, block: Block) -> tuple:
    names = _names(_OPEN)
    return (pos, block.first, block.last, block.shared, *([dict(zip(names, astuple(o))) for o in side] for side in (block.left, block.right)))


def _read_summary(row: dict) -> Block:
    left, right = ([Open(*o.values()) for o in row[side]] for side in ("left", "right"))
    return Block(row["first"], row["last"], row["shared"], left, right)


def _forests(block_rows: int, block_turns: int, schema: pa.Schema):
    def task(batches):
        part, local = TaskContext.get().partitionId(), 0
        held: tuple[list, list, list] = ([], [], [])
        n_turns = 0

        def contract():
            nonlocal local, held, n_turns
            number = (part << 32) + local
            block, closed, ends = forest(*held, number)
            held, n_turns, local = ([], [], []), 0, local + 1
            listed = [(number, slot, number, ",".join(map(str, ids)).encode()) for slot, ids in ends]
            return _batches(schema, closed, [_summary(number, block)], [], listed)

        for batch in batches:
            for conv, path, words in zip(*(c.to_pylist() for c in batch.columns)):
                for column, value in zip(held, (conv, path, words)):
                    column.append(value)
                n_turns += len(words)
                if len(held[0]) >= block_rows or n_turns >= block_turns:
                    yield from contract()
        if held[0]:
            yield from contract()

    return task


def _merges(last: bool, schema: pa.Schema):
    def task(key, table):
        closed, became = [], []
        whole = None
        for row in sorted(table.select(_names("pos x, first x, last x, shared x, left x, right x")).to_pylist(), key=lambda r: r["pos"]):
            block = _read_summary(row)
            whole = merge(whole, block, closed, became) if whole else block
        if last:
            finish(whole, closed)
        kept = [] if last else [_summary(key[0].as_py(), whole)]
        return pa.Table.from_batches(list(_batches(schema, closed, kept, became, [])), schema)

    return task


def _sha_of_ends(batches):
    """One row per node out of its lists of ids, which come in order. Only the state of the hash is held."""
    node, sha, found = None, None, []

    def rows():
        return pa.RecordBatch.from_pylist(found, pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("sha", pa.string())]))

    for batch in batches:
        for conv, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (conv, depth) != node:
                if sha:
                    found.append({"conv_id": node[0], "depth": node[1], "sha": sha.hexdigest()})
                node, sha = (conv, depth), hashlib.sha256(ids)
            else:
                sha.update(b",")
                sha.update(ids)
        yield rows()
        found = []
    if sha:
        found.append({"conv_id": node[0], "depth": node[1], "sha": sha.hexdigest()})
        yield rows()


def prefix_trie(
    conversations: DataFrame,
    group: int = GROUP,
    borrowed: int = BORROWED,
    block_rows: int = BLOCK_ROWS,
    block_turns: int = BLOCK_TURNS,
    merged_blocks: int = MERGED_BLOCKS,
) -> DataFrame:
    """One row per node of the trie of the rebuilt `conversations` (conv_id, turn, role, text): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty, a null turn comes first; turns of the same number go by role, then by the SHA-256 of
    role and text, and repeated rows are turns of their own. Rows without conv_id belong to no conversation
    and take no part. Turns are the same when the first 128 bits of the SHA-256 of role and text are. No
    conversations, no nodes, not even the root.

    Texts are hashed before the first shuffle. A task holds a block of neighbouring conversations, or the paths to both
    ends of `merged_blocks` blocks; rounds of merging are as many as the logarithm of the blocks. The ids that
    end at one node pass through one task as a stream, in lists of a block each, since SHA-256 has to read them in turn.
    """
    spark = conversations.sparkSession
    sequences = cut(rebuilt(conversations, group, borrowed), "sequences")
    # Copies of one conversation are told apart by their ids, so they may lie in several ranges.
    ordered = sequences.repartitionByRange(partitions(spark), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    schema = _arrow(spark)
    forests = cut(ordered.mapInArrow(_forests(block_rows, block_turns, schema), _RESULT), "forests")

    def kind(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.col("kind") == name).select(f"{name}.*")

    # Blocks are numbered through: one number per range of the sort reaches the driver.
    summaries = kind(forests, "summary")
    n_blocks, rows = 0, []
    for part, n in sorted(map(tuple, summaries.groupBy(F.shiftright("pos", 32)).count().collect())):
        rows.append((part, n_blocks))
        n_blocks += n
    if not n_blocks:
        return spark.createDataFrame([], _NODE)
    offsets = F.broadcast(spark.createDataFrame(rows, "part long, before long"))
    summaries = (
        summaries.withColumn("part", F.shiftright("pos", 32))
        .join(offsets, "part")
        .withColumn("pos", F.col("before") + F.col("pos").bitwiseAND((1 << 32) - 1))
        .drop("part", "before")
    )
    rounds = []
    while not rounds or n_blocks > 1:
        n_blocks = -(-n_blocks // merged_blocks)
        grouped = summaries.withColumn("__g", F.floor(F.col("pos") / merged_blocks)).groupBy("__g")
        rounds.append(cut(grouped.applyInArrow(_merges(n_blocks == 1, schema), _RESULT), "merged"))
        summaries = kind(rounds[-1], "summary")

    # What each numbered node has become in the end, from the last round back to the first.
    final = None
    for merged in reversed(rounds):
        here = kind(merged, "closed").select("block", "slot", "conv_id")
        final = here if final is None else final.unionByName(here)
        to = final.select(F.col("block").alias("to_block"), F.col("slot").alias("to_slot"), "conv_id")
        final = cut(final.unionByName(kind(merged, "became").join(to, ["to_block", "to_slot"]).select("block", "slot", "conv_id")), "final")
    parents = final.select(F.col("block").alias("up_block"), F.col("slot").alias("up_slot"), F.col("conv_id").alias("up_conv"))

    listed = (
        kind(forests, "ends")
        .join(final, ["block", "slot"])
        .select("conv_id", F.floor(F.col("slot") / 2).alias("depth"), "pos", "ids")
        .repartition(partitions(spark), "conv_id", "depth")
        .sortWithinPartitions("conv_id", "depth", "pos")
    )
    ends = listed.mapInArrow(_sha_of_ends, "conv_id long, depth long, sha string")
    names = _names(_NODE)
    inner = kind(forests, "closed")
    settled = inner.filter("up_block is null").select(*names)
    below_open = (
        inner.filter("up_block is not null")
        .join(parents, ["up_block", "up_slot"])
        .withColumn("parent_conv_id", F.col("up_conv"))
        .select(*names)
    )
    opened = kind(rounds[0], "closed")
    for merged in rounds[1:]:
        opened = opened.unionByName(kind(merged, "closed"))
    opened = (
        opened.join(parents, ["up_block", "up_slot"], "left")
        .join(ends, ["conv_id", "depth"], "left")
        .withColumn("parent_conv_id", F.col("up_conv"))
        .withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_ENDS)))
        .select(*names)
    )
    return settled.unionByName(below_open).unionByName(opened)


def _arrow(spark: SparkSession) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(_RESULT))
