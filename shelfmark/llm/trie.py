"""The trie of conversations' prefixes, over padded matrices of turn ids.

A node is a distinct sequence of first turns. Conversations are cut into blocks
of ``WIDTH`` turns; a block knows a digest of all turns before it, so blocks are
small rows however long their conversation. The blocks are dealt by ranges of
that digest and of their turn ids, which brings those with common prefixes
together. Each shard pads its blocks to a matrix of turn ids and sorts its rows
with ``lexsort``; a column's change mask, accumulated by OR over the columns
before it, marks the rows where a node of that depth starts, and ``reduceat``
over the starts aggregates every depth.

A node that another shard or another block of its conversations may share is
open: those of a shard's first and last rows, and those on the way to a next
block. All nodes above an open one are open. Their parts are put together by
digest, and what hangs below them is added up along the open nodes' parents, in
rounds that double the distance. Everything else is finished in its shard.

Turns are numbered within conversations by their place in ranges of conversation
and turn, so that a conversation that holds a third of all turns is numbered by
many tasks. A digest of the conversations that end in a node has to see all of
them in order: shards hand on chunks of joined ids, and one task runs over them.

Defined results: a null role or text is empty, a null turn comes first, and of
equal turns the order is that of role and then of a hash of the text; repeated
rows are turns of their own; a null conversation id is one conversation, which
counts as a member and is no smallest member or id at an end (so ``conv_id`` is
null where it is alone), and takes nothing from others; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfmark.functions.names import null_safe
from shelfmark.llm.staging import staged

WIDTH = 64  # turns of a block
SHARD = 1 << 19  # cells of a shard's matrix, about
SUPER = 1024  # blocks whose digests are run over together
CHUNK = 512  # ids that a shard joins at once

# fixed values of the contract
FAMILY = 5
TAKEN = 9

_NONE = np.iinfo(np.int64).max
_EMPTY = hashlib.sha256(b"").hexdigest()


# --- turns in order ------------------------------------------------------------


def numbered_turns(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``conv``, the turn's number ``k`` in it, 128 bits ``t1``, ``t2`` that tell
    its role and text from any other, and its text's UTF-8 ``bytes``."""
    said, words = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    order = ["conv", "turn", "role", "t1", "t2"]
    rows = turns.select(
        F.col(conversation).cast("bigint").alias("conv"),
        F.col(turn).alias("turn"),
        said.alias("role"),
        F.xxhash64(said, words).alias("t1"),
        F.xxhash64(F.lit(1), said, words).alias("t2"),
        F.octet_length(words).cast("bigint").alias("bytes"),
    )
    schema = T.StructType([rows.schema["conv"]])
    for name in ("t1", "t2", "bytes", "part", "place"):
        schema = schema.add(name, "long")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            conv = batch.column(0).fill_null(0).to_numpy()
            new = np.concatenate(
                [[True], (conv[1:] != conv[:-1]) | (known[1:] != known[:-1])]
            )
            new[0] = last != (bool(known[0]), int(conv[0]))
            starts = np.flatnonzero(new)
            at = np.arange(len(conv))
            origin = np.full(len(conv), -count, np.int64)
            origin[starts] = starts
            place = at - np.maximum.accumulate(origin)
            last, count = (bool(known[-1]), int(conv[-1])), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in range(4)),
                    pa.array(np.full(len(conv), part, np.int64)),
                    pa.array(place),
                ],
                names=schema.names,
            )

    dealt = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv", "t1", "t2", "bytes")
        .mapInArrow(placed, schema)
    )
    dealt = staged(dealt, "turns")
    # a conversation that goes on in another range: a row per conversation and range
    by_range = Window.partitionBy("of").orderBy("in")
    offsets = (
        dealt.groupBy(F.col("conv").alias("of"), F.col("part").alias("in"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(by_range.rowsBetween(Window.unboundedPreceding, -1)))
        .where("before > 0")
        .select("of", "in", "before")
    )
    # at most one conversation goes on into a range: no more rows than ranges
    same = dealt["conv"].eqNullSafe(offsets["of"]) & (dealt["part"] == offsets["in"])
    return dealt.join(F.broadcast(offsets), same, "left").select(
        "conv", (F.col("place") + F.coalesce("before", F.lit(0))).alias("k"), "t1", "t2", "bytes"
    )


def rebuilt_turns(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: turns (``conv``, ``pos``, ``t1``, ``t2``,
    ``bytes``), and all ``conv``, also those without a turn.

    Conversation c begins with the first h turns of conversation c - c % 5 and
    goes on with its own after the first h.
    """
    numbered = staged(numbered, "numbered")

    def own_share(conv: Column) -> Column:
        crc = F.crc32(conv.cast("string").cast("binary")) % TAKEN
        return F.coalesce(crc, F.lit(0)).cast("bigint")

    heads = (
        numbered.where((F.col("conv") % FAMILY == 0) & (F.col("k") < TAKEN - 1))
        .groupBy(F.col("conv").alias("head"))
        .agg(F.array_sort(F.collect_list(F.struct("k", "t1", "t2", "bytes"))).alias("turns"))
    )
    convs = numbered.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.withColumn("h", own_share(F.col("conv"))).withColumn(
        "from", F.col("conv") - F.col("conv") % FAMILY
    )
    none = F.array().cast(heads.schema["turns"].dataType)
    convs = staged(
        convs.join(heads, null_safe(convs, heads, [("from", "head")]), "left").select(
            "conv", "h", F.slice(F.coalesce("turns", none), F.lit(1), F.col("h").cast("int")).alias("taken")
        ),
        "taken",
    )
    taken = convs.select("conv", F.inline("taken")).withColumnRenamed("k", "pos")
    lengths = convs.select(F.col("conv").alias("of"), "h", F.size("taken").alias("before"))
    own = numbered.where(F.col("k") >= own_share(F.col("conv")))
    own = own.join(lengths, null_safe(own, lengths, [("conv", "of")])).select(
        "conv", (F.col("k") - F.col("h") + F.col("before")).alias("pos"), "t1", "t2", "bytes"
    )
    return taken.unionByName(own), convs.select("conv")


# --- blocks --------------------------------------------------------------------


def turn_blocks(turns: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """Conversations as blocks: ``conv``, number ``b``, digest ``p1``, ``p2`` of
    the turns before, ``ids`` (two numbers a turn), ``bytes``, and whether there
    is ``more`` of the conversation.

    A turn's ids are those of its place and content, so XOR over a sequence
    digests it, and digests of parts combine in any order.
    """
    placed = turns.select(
        "conv",
        F.expr(f"pos div {width}").alias("b"),
        F.struct(
            F.col("pos").cast("bigint").alias("pos"),
            F.xxhash64(F.col("pos").cast("bigint"), "t1", "t2").alias("g1"),
            F.xxhash64(F.lit(1), F.col("pos").cast("bigint"), "t1", "t2").alias("g2"),
            "bytes",
        ).alias("cell"),
    )
    blocks = placed.groupBy("conv", "b").agg(
        F.bit_xor("cell.g1").alias("x1"),
        F.bit_xor("cell.g2").alias("x2"),
        F.array_sort(F.collect_list("cell")).alias("cells"),
    )
    blocks = staged(
        blocks.select(
            "conv", "b", "x1", "x2",
            F.flatten(F.transform("cells", lambda c: F.array(c["g1"], c["g2"]))).alias("ids"),
            F.transform("cells", lambda c: c["bytes"]).alias("bytes"),
        ),
        "blocks",
    )

    # digests before each block of the conversations that have several
    several = blocks.where("b > 0").select(F.col("conv").alias("of")).distinct()
    parts = blocks.join(several, null_safe(blocks, several, [("conv", "of")]), "left_semi").select(
        F.col("conv").alias("of"), F.expr(f"b div {SUPER}").alias("super"), F.col("b").alias("at"), "x1", "x2"
    )
    sums = parts.groupBy("of", "super").agg(
        F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.max("at").alias("last")
    )

    def before(window: Window, column: str) -> Column:
        rows = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.bit_xor(column).over(rows), F.lit(0).cast("bigint"))

    by_super = Window.partitionBy("of").orderBy("super")
    sums = sums.select(
        F.col("of").alias("sum_of"),
        F.col("super").alias("sum_super"),
        before(by_super, "x1").alias("s1"),
        before(by_super, "x2").alias("s2"),
        F.max("last").over(Window.partitionBy("of")).alias("last"),
    )
    inside = Window.partitionBy("of", "super").orderBy("at")
    parts = parts.select(
        "of", "super", "at", before(inside, "x1").alias("i1"), before(inside, "x2").alias("i2")
    )
    digests = parts.join(sums, null_safe(parts, sums, [("of", "sum_of"), ("super", "sum_super")])).select(
        "of",
        "at",
        F.col("i1").bitwiseXOR(F.col("s1")).alias("p1"),
        F.col("i2").bitwiseXOR(F.col("s2")).alias("p2"),
        (F.col("at") < F.col("last")).alias("more"),
    )
    zero = F.lit(0).cast("bigint")
    known = blocks.join(digests, null_safe(blocks, digests, [("conv", "of"), ("b", "at")]), "left").select(
        "conv",
        "b",
        F.coalesce("p1", zero).alias("p1"),
        F.coalesce("p2", zero).alias("p2"),
        "ids",
        "bytes",
        F.coalesce("more", F.lit(False)).alias("more"),
    )
    first = blocks.where("b = 0").select(F.col("conv").alias("of"))
    none = F.array().cast("array<bigint>")
    without = convs.join(first, null_safe(convs, first, [("conv", "of")]), "left_anti").select(
        "conv", zero.alias("b"), zero.alias("p1"), zero.alias("p2"),
        none.alias("ids"), none.alias("bytes"), F.lit(False).alias("more"),
    )
    return known.union(without)


# --- a shard's matrix ----------------------------------------------------------

# ``open`` parts of nodes are to be put together; rows with ``ends`` hold a chunk of
# the conversations that end in an open node, ``conv`` being the first of them
_PARTS = T.StructType()
for _name, _kind in (
    [("open", "boolean"), ("parent_open", "boolean")]
    + [(c, "long") for c in ("depth", "d1", "d2", "u1", "u2", "conv", "parent_conv")]
    + [(c, "long") for c in ("n_convs", "n_children", "n_leaves", "saved", "bytes")]
    + [("ends", "string")]
):
    _PARTS = _PARTS.add(_name, _kind)


def padded(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of the given lengths as a matrix, zeros after their ends."""
    matrix = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = values
    return matrix


def _names(conv: np.ndarray) -> pa.Array:
    return pa.array(conv, mask=conv == _NONE)


def shard_nodes(
    b: np.ndarray,
    p: tuple[np.ndarray, np.ndarray],
    ids: np.ndarray,
    sizes: np.ndarray,
    lengths: np.ndarray,
    conv: np.ndarray,
    more: np.ndarray,
    width: int,
) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard's blocks, depth by depth. ``conv`` has ``_NONE`` for null."""
    n = len(b)
    g = [padded(ids[k::2], lengths) for k in (0, 1)]
    size = padded(sizes, lengths)
    deep = size.shape[1]
    there = np.arange(deep) < lengths[:, None]
    keys = [conv]
    for j in range(deep - 1, -1, -1):
        keys += [g[1][:, j], g[0][:, j], there[:, j]]
    order = np.lexsort([*keys, p[1], p[0], b])
    b, lengths, conv, more = b[order], lengths[order], conv[order], more[order]
    p, g = [x[order] for x in p], [x[order] for x in g]
    size, there = size[order], there[order]

    # starts[r, e]: at row r another sequence of e turns begins
    starts = np.ones((n, deep + 1), bool)
    starts[1:, 0] = (b[1:] != b[:-1]) | (p[0][1:] != p[0][:-1]) | (p[1][1:] != p[1][:-1])
    starts[1:, 1:] = (g[0][1:] != g[0][:-1]) | (g[1][1:] != g[1][:-1]) | (there[1:] != there[:-1])
    np.logical_or.accumulate(starts, axis=1, out=starts)
    digest = [
        np.bitwise_xor.accumulate(np.concatenate([x[:, None], y], axis=1), axis=1)
        for x, y in zip(p, g)
    ]

    firsts, inner = [], []  # per depth: first rows of all segments, and which of them are open
    for e in range(deep + 1):
        at = np.flatnonzero(starts[:, e])
        stop = np.append(at[1:], n)
        open_at = np.logical_or.reduceat(more, at) | (at == 0) | (stop == n) | (e == 0)
        firsts.append(at)
        inner.append(open_at)

    # what finished nodes weigh, at the row and depth where they start
    n_convs = [np.diff(np.append(at, n)) for at in firsts]
    children, leaf, saved = [], np.zeros((n, deep + 2), np.int64), np.zeros((n, deep + 2), np.int64)
    for e in range(deep, -1, -1):
        at = firsts[e]
        begun = np.zeros(n, np.int64)
        if e < deep:
            own = there[firsts[e + 1], e] & ~inner[e + 1]
            begun[firsts[e + 1][own]] = 1
        children.insert(0, np.add.reduceat(begun, at))
        if e:
            done = there[at, e - 1] & ~inner[e]
            leaf[at[done], e] = children[0][done] == 0
            saved[at[done], e] = (n_convs[e][done] - 1) * size[at[done], e - 1]
    below = [np.cumsum(x[:, ::-1], axis=1)[:, ::-1] for x in (leaf, saved)]

    totals = [[np.add.reduceat(x[:, e], at) for x in below] for e, at in enumerate(firsts)]
    ups = [np.zeros(len(firsts[0]), np.int64)]
    for e in range(deep):
        # open nodes are added up later: here each has what hangs below no other open one
        ups.append(np.searchsorted(firsts[e], firsts[e + 1], "right") - 1)
        for own, lower in zip(totals[e], totals[e + 1]):
            np.subtract.at(own, ups[-1][inner[e + 1]], lower[inner[e + 1]])

    smallest = [np.minimum.reduceat(conv, at) for at in firsts]
    for e in range(deep + 1):
        at, opened = firsts[e], inner[e]
        real = there[at, e - 1] if e else np.ones(len(at), bool)
        head = (e == 0) & (b[at] > 0)  # counted as the last node of the block before
        depth = b[at] * width + e
        up = ups[e]
        parent_open = inner[e - 1][up] if e else np.ones(len(at), bool)
        orphan = np.full(len(at), e == 0)

        ended = np.flatnonzero((lengths == e) & ~more)  # rows of conversations that end here
        low, high = (np.searchsorted(ended, x) for x in (at, np.append(at[1:], n)))
        own_ends: list[str | None] = [None] * len(at)
        chunks: list[tuple[int, str]] = []
        for s in np.flatnonzero(real & (low < high)).tolist():
            rows = conv[ended[low[s] : high[s]]]
            rows = rows[rows != _NONE]
            if not opened[s]:
                own_ends[s] = hashlib.sha256(",".join(map(str, rows.tolist())).encode()).hexdigest()
                continue
            for k in range(0, len(rows), CHUNK):
                chunks.append((s, ",".join(map(str, rows[k : k + CHUNK].tolist()))))

        def batch(pick: np.ndarray, ends: list, first: pa.Array) -> pa.RecordBatch:
            none = np.zeros(len(pick), np.int64)
            whole = first is None
            columns = [
                pa.array(opened[pick]),
                pa.array(parent_open[pick]),
                *(pa.array(x) for x in (depth[pick], digest[0][at[pick], e], digest[1][at[pick], e])),
                *(pa.array(x[at[pick], max(e - 1, 0)], mask=orphan[pick]) for x in digest),
                _names(np.where(head[pick], _NONE, smallest[e][pick])) if whole else first,
                _names(np.where(parent_open[pick], _NONE, smallest[e - 1][up[pick]] if e else none)),
                pa.array(np.where(head[pick], 0, n_convs[e][pick]) if whole else none),
                *(pa.array(x[pick] if whole else none) for x in (children[e], *totals[e])),
                pa.array(size[at[pick], e - 1] if e and whole else none),
                pa.array(ends, pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=_PARTS.names)

        pick = np.flatnonzero(real)
        yield batch(
            pick,
            [None if opened[s] else own_ends[s] or _EMPTY for s in pick.tolist()],
            None,
        )
        if chunks:
            pick = np.array([s for s, _ in chunks])
            first = pa.array([int(ends.partition(",")[0]) for _, ends in chunks], pa.int64())
            yield batch(pick, [ends for _, ends in chunks], first)


def _sharded(width: int):
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        flat = {c: pa.compute.list_flatten(table[c]).to_numpy() for c in ("ids", "bytes")}
        lengths = pa.compute.list_value_length(table["bytes"]).to_numpy().astype(np.int64)
        yield from shard_nodes(
            table["b"].to_numpy(),
            (table["p1"].to_numpy(), table["p2"].to_numpy()),
            flat["ids"],
            flat["bytes"],
            lengths,
            pa.compute.fill_null(table["conv"], _NONE).to_numpy(),
            table["more"].to_numpy(zero_copy_only=False),
            width,
        )

    return nodes


# --- nodes of several shards ---------------------------------------------------

_KEY = ["depth", "d1", "d2"]


def _joined(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str) -> DataFrame:
    return left.join(right, null_safe(left, right, on), how)


def ends_digests(chunks: DataFrame) -> DataFrame:
    """``e_depth``, ``e1``, ``e2`` and the digest of all ids that end there, chunk
    by chunk in order."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def row(rows):
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["e_depth", "e1", "e2", "ends_sha256"],
            )

        for batch in batches:
            done = []
            for *own, ends in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if own != key:
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ends.encode())
            yield row(done)
        if key:
            yield row([(*key, digest.hexdigest())])

    return (
        chunks.select(*_KEY, "conv", "ends")
        .repartition(*_KEY)
        .sortWithinPartitions(*_KEY, "conv")
        .mapInArrow(digests, "e_depth bigint, e1 bigint, e2 bigint, ends_sha256 string")
    )


def open_nodes(parts: DataFrame) -> DataFrame:
    """The open nodes, put together of their parts, with what hangs below them."""
    parts = parts.where("open")
    whole = parts.where("ends is null")
    nodes = whole.groupBy(*_KEY).agg(
        *[F.max(c).alias(c) for c in ("u1", "u2", "bytes")],
        F.min("conv").alias("conv"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
    )
    nodes = staged(nodes, "open")
    up = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("c_depth"), F.col("u1").alias("c1"), F.col("u2").alias("c2")
    )
    up = up.agg(F.count(F.lit(1)).alias("more_children"))
    children = F.col("n_children") + F.coalesce("more_children", F.lit(0))
    nodes = _joined(nodes, up, [("depth", "c_depth"), ("d1", "c1"), ("d2", "c2")], "left").select(
        *_KEY, "u1", "u2", "conv", "n_convs",
        children.alias("n_children"),
        (F.col("n_leaves") + (children == 0).cast("bigint")).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
        F.col("u1").alias("a1"),
        F.col("u2").alias("a2"),
    )
    nodes = staged(nodes, "open")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    step = 1  # a1, a2 are the node so many turns above
    while step <= deepest:
        reach = nodes.where(F.col("depth") >= step)
        above = [(F.col("depth") - step).alias("s_depth"), F.col("a1").alias("s1"), F.col("a2").alias("s2")]
        sums = reach.groupBy(*above).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        further = nodes.select(
            F.col("depth").alias("f_depth"), F.col("d1").alias("f1"), F.col("d2").alias("f2"),
            F.col("a1").alias("b1"), F.col("a2").alias("b2"),
        )
        nodes = _joined(nodes, sums, [("depth", "s_depth"), ("d1", "s1"), ("d2", "s2")], "left")
        nodes = nodes.withColumn("to", F.col("depth") - step)
        nodes = _joined(nodes, further, [("to", "f_depth"), ("a1", "f1"), ("a2", "f2")], "left")
        nodes = staged(
            nodes.select(
                *_KEY, "u1", "u2", "conv", "n_convs", "n_children",
                (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
                F.col("b1").alias("a1"),
                F.col("b2").alias("a2"),
            ),
            "open",
        )
        step *= 2
    ends = ends_digests(parts.where("ends is not null"))
    return staged(
        _joined(nodes, ends, [("depth", "e_depth"), ("d1", "e1"), ("d2", "e2")], "left").select(
            *_KEY, "u1", "u2", "conv", "n_convs", "n_children", "n_leaves", "saved",
            F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends"),
        ),
        "open",
    )


def prefix_trie(
    turns: DataFrame, convs: DataFrame, width: int = WIDTH, shard: int = SHARD
) -> DataFrame:
    """Per node of the trie of ``turns`` (``conv``, ``pos``, ``t1``, ``t2``, ``bytes``;
    ``convs`` has every ``conv`` once): ``conv_id``, the smallest member, ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    and ``ends_sha256``.
    """
    blocks = staged(turn_blocks(turns, convs, width), "blocks")
    cells = blocks.agg(F.sum(F.size("bytes") + 1)).first()[0] or 0
    wanted = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartitionByRange(
        max(wanted, -(-cells // shard)), "b", "p1", "p2", "ids", "conv"
    )
    parts = staged(dealt.mapInArrow(_sharded(width), _PARTS), "parts")
    opened = open_nodes(parts)
    above = opened.select(
        F.col("depth").alias("o_depth"), F.col("d1").alias("o1"), F.col("d2").alias("o2"),
        F.col("conv").alias("o_conv"),
    )

    def named(nodes: DataFrame, parent: str) -> DataFrame:
        return nodes.select(
            F.col("conv").alias("conv_id"),
            "depth",
            F.col(parent).alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            F.col("saved").alias("saved_tokens"),
            F.col("ends").alias("ends_sha256"),
        )

    def below(nodes: DataFrame) -> DataFrame:
        nodes = nodes.withColumn("to", F.col("depth") - 1)
        return named(_joined(nodes, above, [("to", "o_depth"), ("u1", "o1"), ("u2", "o2")], "left"), "o_conv")

    done = parts.where("not open")
    return (
        named(done.where("not parent_open"), "parent_conv")
        .union(below(done.where("parent_open")))
        .union(below(opened))
    )


def conversation_trie(turns: DataFrame, width: int = WIDTH, shard: int = SHARD) -> DataFrame:
    """The trie of the contract's rebuilt conversations."""
    return prefix_trie(*rebuilt_turns(numbered_turns(turns)), width, shard)
