"""Prefix tree of conversations, measured with the Euler-tour technique.

Every distinct prefix of turns is a node. A node is named by its smallest member and its depth, so names
are exact and the nodes of one conversation lie together. An enter and an exit arc of each node make one
tour, which is list-ranked: tasks contract the stretches of the tour that they hold, and pointer jumping
ranks what is left. A subtree's sums are the difference of the prefix sums at its node's two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domainlake.operators.joins import lookup
from domainlake.session import written

#: Odd multipliers of the two prefix hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
#: Nodes that a task contracts together, and bytes of ids it joins to one piece.
BLOCK, PIECE = 1 << 19, 1 << 20


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _sorted_parts(rows: DataFrame, *order: Column | str) -> DataFrame:
    """`rows` range-partitioned and sorted, with `part`, the place of the partition in that order."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def _runs(conv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of every stretch of equal values, and the number of its stretch for each row."""
    new = np.concatenate([[True], conv[1:] != conv[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1


def along(rows: DataFrame, *order: Column | str) -> DataFrame:
    """`rows(conv_id, h1, h2, ...)` with i, a row's place in its conversation in the given order (from 0),
    and p1, p2, the hashes of the conversation from its first row to this one: sums of h times base**i.

    The order starts with conv_id. Partitions number their own rows; a conversation that goes on from
    earlier partitions is shifted by what those hold of it. Only one row for each partition reaches the
    driver, so one conversation may hold any share of the rows.
    """
    sorted_rows = _sorted_parts(rows, *order)

    def local(batches):
        held, count, sums = None, 0, (0, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            first, run = _runs(conv)
            i = np.arange(len(conv)) - first[run]
            goes_on, same = conv[0] == held, run == 0
            prefixes = []
            for k, (name, base) in enumerate(zip(("h1", "h2"), BASES)):
                terms = batch.column(name).to_numpy().view(np.uint64) * _powers(len(i), base)[i]
                total = np.cumsum(terms)
                prefix = total - np.concatenate([np.zeros(1, dtype=np.uint64), total])[first][run]
                if goes_on:
                    prefix[same] = prefix[same] * np.uint64(pow(base, count, 1 << 64)) + np.uint64(sums[k])
                prefixes.append(prefix)
            if goes_on:
                i[same] += count
            held, count, sums = conv[-1], int(i[-1]) + 1, tuple(int(p[-1]) for p in prefixes)
            columns = [*batch.columns, pa.array(i), *[pa.array(p.view(np.int64)) for p in prefixes]]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "i", "p1", "p2"])

    fields = ", ".join(f"{n} {t}" for n, t in sorted_rows.dtypes)
    placed = written(sorted_rows.mapInArrow(local, f"{fields}, i long, p1 long, p2 long"), "numbered")
    last = F.max(F.struct("conv_id", "i", "p1", "p2"))
    heads = placed.groupBy("part").agg(F.min("conv_id").alias("first"), last.alias("last")).orderBy("part").collect()
    # What earlier partitions hold of each partition's first conversation.
    shifts: dict[int, tuple[int, int, int, int]] = {}
    held, count, sums = None, 0, [0, 0]
    for r in heads:
        if r["first"] == held:
            shifts[r["part"]] = (held, count, *sums)
        goes_on = r["last"]["conv_id"] == held
        before, earlier = (count, sums) if goes_on else (0, [0, 0])
        held, count = r["last"]["conv_id"], before + r["last"]["i"] + 1
        sums = [
            (s + r["last"][p] * pow(b, before, 1 << 64)) % (1 << 64) for s, p, b in zip(earlier, ("p1", "p2"), BASES)
        ]
    if not shifts:
        return placed.drop("part")

    def shifted(batches):
        for batch in batches:
            part, conv = batch.column("part").to_numpy(), batch.column("conv_id").to_numpy()
            i, p1, p2 = (batch.column(c).to_numpy().copy() for c in ("i", "p1", "p2"))
            for k in np.unique(part).tolist():
                if k in shifts:
                    first, count, *sums = shifts[k]
                    own = (part == k) & (conv == first)
                    i[own] += count
                    for p, s, b in zip((p1, p2), sums, BASES):
                        at = p.view(np.uint64)
                        at[own] = at[own] * np.uint64(pow(b, count, 1 << 64)) + np.uint64(s)
            new = {"i": pa.array(i), "p1": pa.array(p1), "p2": pa.array(p2)}
            names = [n for n in batch.schema.names if n != "part"]
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names=names)

    return placed.mapInArrow(shifted, placed.drop("part").schema)


def _power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base**exponent modulo 2**64, for exponents of either sign."""
    values, where = np.unique(exponents, return_inverse=True)
    return np.array([pow(base, int(k), 1 << 64) for k in values], dtype=np.uint64)[where]


def _rebased(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, size): hashes of the rebuilt prefix up to the row, and without the row.

    `rows` has the row's own prefix (i, p1, p2), that of the conversation's first h turns (h, s1, s2) and that of
    the `given` opening turns which take their place (g1, g2).
    """

    def work(batches):
        for batch in batches:
            i, h, given = (batch.column(c).to_numpy() for c in ("i", "h", "given"))
            position = i - h + given
            prefixes, without = [], []
            for k, base in zip("12", BASES):
                p, s, g, term = (batch.column(f"{c}{k}").to_numpy().view(np.uint64) for c in "psgh")
                prefix = g + (p - s) * _power(base, given - h)
                prefixes.append(pa.array(prefix.view(np.int64)))
                without.append(pa.array((prefix - term * _power(base, position)).view(np.int64)))
            columns = [batch.column("conv_id"), pa.array(position + 1), *prefixes, *without, batch.column("size")]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "depth", "p1", "p2", "q1", "q2", "size"])

    return rows.mapInArrow(work, "conv_id long, depth long, p1 long, p2 long, q1 long, q2 long, size long")


def rebuilt(conversations: DataFrame, most: int = 6, family: int = 100) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): prefixes of rebuilt conversations (see `_rebased`), and (conv_id, size).

    A conversation starts with the first h turns of the one that opens its family and goes on with its own
    after its first h; h is the checksum of its id modulo `most`.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(1), text, role).alias("h2"),
        F.char_length(text).cast("long").alias("size"),
    )
    # Equal rows of one conversation would fall into one partition without the last column.
    turns = turns.withColumn("row", F.monotonically_increasing_id())
    own = along(turns, "conv_id", F.col("turn").asc_nulls_first(), "h1", "h2", "row").drop("turn", "row")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    none = F.lit(0).cast("long")
    # The last of a conversation's first h turns has the prefix of all of them.
    start = F.max(F.when(F.col("i") == F.col("h") - 1, F.struct("p1", "p2")))
    convs = own.withColumn("h", h).groupBy("conv_id", "h").agg(F.count("*").alias("n"), start.alias("s"))
    convs = convs.withColumn("opener", F.col("conv_id") - F.col("conv_id") % family)
    heads = own.where((F.col("conv_id") % family == 0) & (F.col("i") < most - 1))
    opening = heads.groupBy(F.col("conv_id").alias("opener")).agg(
        F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("i", "p1", "p2"))).alias("prefixes")
    )  # less than `most` of each
    convs = convs.join(opening, "opener", "left").withColumn("given", F.least(F.coalesce("count", none), "h"))
    last = F.when(F.col("given") > 0, F.element_at("prefixes", F.greatest(F.col("given"), F.lit(1)).cast("int")))
    convs = written(
        convs.select(
            "conv_id", "opener", "h", "n", "given",
            *[F.coalesce(F.col(f"s.p{k}"), none).alias(f"s{k}") for k in "12"],
            *[F.coalesce(last[f"p{k}"], none).alias(f"g{k}") for k in "12"],
        ),
        "conversations",
    )
    # Where all turns are replaced, no prefix of the first h is needed.
    rest = lookup(own, convs.drop("opener", "n"), "conv_id").where("i >= h")
    columns = ["conv_id", "i", "h", "given", "p1", "p2", "s1", "s2", "g1", "g2", "h1", "h2", "size"]
    # A family has at most `family` members; an opening turn keeps its own prefix.
    first = convs.select("conv_id", "opener", "h").join(heads.withColumnRenamed("conv_id", "opener"), "opener").where("i < h")
    kept = {"h": none, "given": none, "s1": none, "s2": none, "g1": none, "g2": none}
    turns = _rebased(rest.select(columns).union(first.withColumns(kept).select(columns)))
    size = F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return turns, convs.select("conv_id", size.alias("size"))


def _next_siblings(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, sibling): the next conv_id below the same parent, where there is one."""
    rows = _sorted_parts(nodes.where("depth > 0").select("parent", "depth", "conv_id"), "parent", "depth", "conv_id")

    def work(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            parent, depth, conv, part = (batch.column(c).to_numpy() for c in ("parent", "depth", "conv_id", "part"))
            if held is not None:
                parent, depth, conv, part = (np.append(h, x) for h, x in zip(held, (parent, depth, conv, part)))
            held = parent[-1:], depth[-1:], conv[-1:], part[-1:]
            same = (parent[1:] == parent[:-1]) & (depth[1:] == depth[:-1])
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(x[:-1]) for x in (parent, depth, conv, part)], pa.array(conv[1:], mask=~same), pa.array(np.zeros(len(same), dtype=bool))],
                names=["parent", "depth", "conv_id", "part", "sibling", "last"],
            )
        if held is not None:
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(x) for x in held], pa.array([None], pa.int64()), pa.array([True])],
                names=["parent", "depth", "conv_id", "part", "sibling", "last"],
            )

    placed = written(rows.mapInArrow(work, "parent long, depth long, conv_id long, part int, sibling long, last boolean"), "siblings")
    # The first row of each partition is the next one of the last row of the partition before it.
    heads = placed.groupBy("part").agg(F.min(F.struct("parent", "depth", "conv_id")).alias("head"))
    heads = heads.select(F.lead("head").over(Window.orderBy("part")).alias("head"), "part")
    ends = placed.where("last").join(heads, "part").where("head.parent = parent and head.depth = depth")
    return (
        placed.where("sibling is not null")
        .select("conv_id", "depth", "sibling")
        .union(ends.select("conv_id", "depth", F.col("head.conv_id").alias("sibling")))
    )


def trie_nodes(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): a row for each node with its links, and (conv_id, depth, member) of where members end."""
    sums = written(turns, "prefixes")
    nodes = sums.groupBy("depth", "p1", "p2").agg(
        F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("conv_id", "q1", "q2", "size")]
    )
    nodes = written(nodes, "nodes")
    total = conversations.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    spark = turns.sparkSession
    top = spark.createDataFrame([(total["least"], total["n"])], "conv_id long, n_convs long")
    root = top.where("n_convs > 0").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("size")
    )
    names = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent"))
    deeper = nodes.where("depth > 1").join(names, ["depth", "q1", "q2"])
    columns = ["conv_id", "depth", "parent", "n_convs", "size"]
    linked = nodes.where("depth = 1").withColumn("parent", F.lit(total["least"]).cast("long"))
    linked = written(root.union(deeper.select(columns)).union(linked.select(columns)), "linked")
    children = linked.where("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    children = children.agg(F.count("*").alias("n_children"), F.min("conv_id").alias("child"))
    found = (
        linked.join(children, ["conv_id", "depth"], "left")
        .join(_next_siblings(linked), ["conv_id", "depth"], "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    )
    last = sums.join(conversations.withColumnRenamed("size", "turns"), "conv_id").where("depth = turns")
    at = nodes.select("depth", "p1", "p2", "conv_id")
    last = last.select("depth", "p1", "p2", F.col("conv_id").alias("member")).join(at, ["depth", "p1", "p2"])
    turnless = conversations.where("size = 0").select(
        F.lit(total["least"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.col("conv_id").alias("member")
    )
    return written(found, "trie"), last.select("conv_id", "depth", "member").union(turnless)


def _pieces(batches: Iterator[pa.RecordBatch]):
    """Comma-joined members of each stretch of one node, at most PIECE bytes in each piece."""
    node, ids, first, size = None, [], 0, 0

    def piece():
        return pa.RecordBatch.from_pylist([{"conv_id": node[0], "depth": node[1], "first": first, "ids": ",".join(ids)}])

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "depth", "member"))
        for conv, depth, member in zip(*columns):
            if node != (conv, depth) or size > PIECE:
                if ids:
                    yield piece()
                node, ids, first, size = (conv, depth), [], member, 0
            ids.append(str(member))
            size += len(ids[-1]) + 1
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]):
    """SHA-256 of every node's pieces in their order."""
    node, digest = None, None
    for batch in batches:
        for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids"))):
            if node != (conv, depth):
                if node:
                    yield pa.RecordBatch.from_pylist([{"conv_id": node[0], "depth": node[1], "sha": digest.hexdigest()}])
                node, digest = (conv, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if node:
        yield pa.RecordBatch.from_pylist([{"conv_id": node[0], "depth": node[1], "sha": digest.hexdigest()}])


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, sha): SHA-256 of the comma-joined members that end at a node, ascending.

    Range partitions join the ids of their stretch of a node, so that a node where very many members end is
    joined by many tasks; the one that hashes it reads pieces, one after another.
    """
    order = ["conv_id", "depth", "member"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = pieces.mapInArrow(_pieces, "conv_id long, depth long, first long, ids string")
    together = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return together.mapInArrow(_digests, "conv_id long, depth long, sha string")


ARC = ["conv_id", "depth", "exit", "to_conv", "to_depth", "to_exit", "arcs", "leaves", "saved", "started"]
ARCS = "conv_id long, depth long, exit boolean, to_conv long, to_depth long, to_exit boolean, arcs long, leaves long, saved long, started boolean"


def _arcs(nodes: pa.Table) -> pa.Table:
    """The enter and the exit arc of every node: where the tour goes on (null: nowhere), and what it counts."""
    n = nodes.num_rows
    column = {c: nodes.column(c).combine_chunks() for c in nodes.schema.names}
    c, d, leaf, save = (column[x].to_numpy() for x in ("conv_id", "depth", "leaf", "save"))
    no_child, no_sibling = (column[x].is_null().to_numpy(zero_copy_only=False) for x in ("child", "sibling"))
    child, sibling, parent = (column[x].fill_null(0).to_numpy() for x in ("child", "sibling", "parent"))
    end = np.concatenate([np.zeros(n, dtype=bool), no_sibling & (d == 0)])
    none = np.zeros(n, dtype=np.int64)
    return pa.table(
        {
            "conv_id": np.tile(c, 2),
            "depth": np.tile(d, 2),
            "exit": np.repeat([False, True], n),
            "to_conv": pa.array(np.concatenate([np.where(no_child, c, child), np.where(no_sibling, parent, sibling)]), mask=end),
            "to_depth": pa.array(np.concatenate([np.where(no_child, d, d + 1), np.where(no_sibling, d - 1, d)]), mask=end),
            "to_exit": pa.array(np.concatenate([no_child, no_sibling]), mask=end),
            "arcs": np.ones(2 * n, dtype=np.int64),
            "leaves": np.append(leaf, none),
            "saved": np.append(save, none),
        }
    )


def _contract(arcs: pa.Table) -> pa.Table:
    """`arcs` with the stretches contracted that these arcs make: each goes on where its stretch does, has the
    sums from itself to the stretch's end, and is marked if a stretch starts with it."""
    column = {c: arcs.column(c).combine_chunks() for c in arcs.schema.names}
    end = column["to_conv"].is_null().to_numpy(zero_copy_only=False)
    own, to = (
        [column[c].fill_null(0 if c[-4:] != "exit" else False).to_numpy(zero_copy_only=False) for c in names]
        for names in (("conv_id", "depth", "exit"), ("to_conv", "to_depth", "to_exit"))
    )
    convs = np.unique(own[0])
    deepest = int(own[1].max()) + 1

    def code(conv, depth, exit_):
        """One number for every arc of these conversations, -1 for others."""
        at = np.minimum(np.searchsorted(convs, conv), len(convs) - 1)
        here = (convs[at] == conv) & (depth < deepest)
        return np.where(here, (at * deepest + depth) * 2 + exit_, -1)

    codes = code(*own)
    order = np.argsort(codes, kind="stable")
    wanted = np.where(end, -1, code(*to))
    at = np.minimum(np.searchsorted(codes[order], wanted), len(codes) - 1)
    on = np.where((wanted >= 0) & (codes[order][at] == wanted), order[at], -1)
    started = np.ones(len(codes), dtype=bool)
    started[on[on >= 0]] = False
    sums = np.stack([column[c].to_numpy() for c in ("arcs", "leaves", "saved")])
    last = np.arange(len(codes))
    while (on >= 0).any():
        rows = np.flatnonzero(on >= 0)
        ahead = on[rows]
        more, tails, further = sums[:, ahead], last[ahead], on[ahead]
        sums[:, rows] += more
        last[rows], on[rows] = tails, further
    tails = pa.array(last)
    out = {c: column[c] for c in ("conv_id", "depth", "exit")}
    out |= {c: column[c].take(tails) for c in ("to_conv", "to_depth", "to_exit")}
    out |= {c: pa.array(x) for c, x in zip(("arcs", "leaves", "saved"), sums)}
    return pa.table(out | {"started": pa.array(started)})


def _in_blocks(rows: DataFrame, work) -> DataFrame:
    """Apply `work` to at most BLOCK rows of a partition at a time."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= BLOCK:
                yield from work(pa.Table.from_batches(held)).to_batches(1 << 14)
                held, n = [], 0
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches(1 << 14)

    return rows.mapInArrow(run, ARCS)


def contracted(trie: DataFrame) -> DataFrame:
    """(ARCS): the arcs of all nodes, with the stretches of the tour contracted that tasks hold."""
    rows = trie.select(
        "conv_id", "depth", "parent", "child", "sibling",
        (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("save"),
    )
    rows = rows.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    return _in_blocks(rows, lambda nodes: _contract(_arcs(nodes)))


def jumped(arcs: DataFrame) -> DataFrame:
    """`arcs` with the sums to the tour's end, by pointer jumping.

    In each round an arc adds the sums of the one it goes on with and takes over its continuation, so the
    number of rounds is the logarithm of the number of arcs.
    """
    now = written(arcs.select(ARC[:-1]), "jumps")
    while not now.where("to_conv is not null").isEmpty():
        ahead = now.toDF("to_conv", "to_depth", "to_exit", "next_conv", "next_depth", "next_exit", "a", "l", "s")
        moved = now.where("to_conv is not null").join(ahead, ["to_conv", "to_depth", "to_exit"])
        moved = moved.select(
            "conv_id", "depth", "exit", "next_conv", "next_depth", "next_exit",
            F.col("arcs") + F.col("a"), F.col("leaves") + F.col("l"), F.col("saved") + F.col("s"),
        )
        now = written(now.where("to_conv is null").union(moved), "jumps")
    return now


def ranked(arcs: DataFrame) -> DataFrame:
    """(conv_id, depth, exit, arcs, leaves, saved): sums from each of the contracted `arcs` to the tour's end.

    The arcs that start a stretch make a shorter list, which is contracted again: in ranges of conversations
    while it has more than BLOCK arcs, in one task then. A list that ranges don't shorten by half is ranked
    by pointer jumping. Going back, an arc adds the sums of the stretch that it goes on with.
    """
    starts = arcs.where("started").select(ARC[:-1])
    n = starts.count()
    parts = -(-n // BLOCK)
    if parts <= 1:
        again = written(_in_blocks(starts.coalesce(1), _contract), "ranks")  # no more than BLOCK arcs
    else:
        shorter = written(_in_blocks(starts.repartitionByRange(parts, "conv_id", "depth"), _contract), "stretches")
        again = ranked(shorter) if 2 * shorter.where("started").count() < n else jumped(starts)
    further = again.select("conv_id", "depth", "exit", "arcs", "leaves", "saved").toDF("to_conv", "to_depth", "to_exit", "a", "l", "s")
    found = arcs.select(ARC[:-1]).join(further, ["to_conv", "to_depth", "to_exit"], "left")
    none = F.lit(0).cast("long")
    sums = [(F.col(c) + F.coalesce(x, none)).alias(c) for c, x in (("arcs", "a"), ("leaves", "l"), ("saved", "s"))]
    return found.select("conv_id", "depth", "exit", *sums)


def conversation_trie(conversations: DataFrame, most: int = 6, family: int = 100) -> DataFrame:
    """A row for each node of the prefix tree of `conversations(conv_id, turn, role, text)`.

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 and position, the place of its enter arc in the tour (from 0). Turns are
    ordered by turn, null first, and equal ones by their hash; a null role or text is an empty one. Each
    conversation is rebuilt from the first turns of the one that opens its family, see `rebuilt`. Rows with
    a null conv_id take no part; repeated rows are turns of their own; a conversation left without turns
    ends at the root. An empty table has no nodes; other columns are ignored.
    """
    turns, convs = rebuilt(conversations.select("conv_id", "turn", "role", "text"), most, family)
    trie, ends = trie_nodes(turns, convs)
    ranks = ranked(written(contracted(trie), "tour"))

    def at(exit_, name):
        return F.max(F.when(F.col("exit") == exit_, F.col(name)))

    sums = ranks.groupBy("conv_id", "depth").agg(
        at(False, "arcs").alias("left"),
        (at(False, "leaves") - at(True, "leaves")).alias("n_leaves"),
        (at(False, "saved") - at(True, "saved")).alias("saved_tokens"),
    )
    key = ["conv_id", "depth"]
    whole = trie.join(sums, key).join(end_digests(ends), key, "left")
    arcs = 2 * trie.count()
    return whole.select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("sha", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
        (F.lit(arcs) - F.col("left")).alias("position"),
    )
