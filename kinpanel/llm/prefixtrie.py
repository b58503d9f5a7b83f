"""Prefix trie of conversations: ROLLUP over positional columns of turn ids gives all prefixes of a block at once.

A turn is named by 24 bytes, a 128-bit digest of role and text and the length of the text; texts are not moved. The turns
of a conversation stand in blocks of eight columns t0 to t7. ``GROUP BY block, node before it, ROLLUP (t0, ..., t7)``
counts every prefix, and ``grouping_id`` says how many columns a row keeps. A long conversation continues in further
blocks. Each is keyed by the node that the block before ends in: two 64-bit sums (xor) over digests of (turn, place), so
that the key of every block follows from the turns alone and all blocks are grouped in one job, whatever the longest
conversation is.

Sums over a subtree need no walk either. Each node belongs to its smallest member; the nodes of one conversation are then
the tail of its path. A second ROLLUP sums, over the members of a node, what their own nodes hold, and the part that the
node's own conversation holds above the node is taken off again.

No step holds a conversation: turns are placed by a range sort of all turns, running totals of one conversation go over
stretches of bounded length first. A node's hash of member ids is fed from joined stretches of ids.

Defined cases: turns are ordered by ``turn`` (null first), ties by their digest; a null role or text is empty; equal rows
are turns of their own. Rows with a null conv_id belong to no conversation. Negative ids are cut towards zero:
conversations -4 to 4 begin with turns of conversation 0. An empty table has no nodes. Only conv_id, turn, role and text
are read, whatever else the table holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinpanel.operators.scale import HOT_ROWS, salted_join
from kinpanel.session import checkpointed

#: columns of a block; also the most turns that a conversation may take from its base
BLOCK = 8
#: a base conversation is shared by this many consecutive ids, and lends crc32(id) % LENT turns
FAMILY, LENT = 5, 9
#: blocks (or nodes) of one conversation that a window orders at once
STRETCH = 4096
#: member ids that are joined to one string before they are hashed
JOINED = 512

_T = [f"t{i}" for i in range(BLOCK)]
_KEY = ["depth", "k1", "k2"]


def turn_id(role: Column, text: Column) -> Column:
    """24 bytes: half of the SHA-256 of role and text, then the UTF-8 length of the text."""
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    size = F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")
    return F.unhex(F.concat(F.substring(F.sha2(told.cast("binary"), 256), 1, 32), size))


def turn_bytes(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 17, 8)), 16, 10).cast("long")


def _marks(turn: Column, place: Column) -> tuple[Column, Column]:
    """Two digests of a turn at its place; a prefix is named by their xor over its turns."""
    return F.xxhash64(turn, place.cast("long")), F.xxhash64(place.cast("long"), turn, F.lit(1))


def ordered_turns(rows: DataFrame) -> DataFrame:
    """conv, part, at, id: ``at`` counts the turns of a part in order, a conversation may go on in the next part."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = checkpointed(rows.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn"), turn_id(role, text).alias("id"),
        F.monotonically_increasing_id().alias("row")))
    order = ["conv", "turn", "id", "row"]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = checkpointed(dealt.select("conv", "id", F.monotonically_increasing_id().alias("at")))
    return dealt.withColumn("part", F.shiftright("at", 33))


def rebuilt_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, place, id, length) of the turns of the rebuilt conversations, and (conv, length) of all of them.

    A conversation begins with the first turns of its base, crc32(conv) % LENT of them or all if there are fewer, and goes
    on with its own turns after as many of its first.
    """
    ordered = ordered_turns(rows)
    runs = checkpointed(ordered.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    own = runs.groupBy("conv").agg(F.sum("n").alias("own"))
    bases = own.select(F.col("conv").alias("base"), F.col("own").alias("lends"))
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % LENT
    convs = own.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).withColumn("cut", taken)
    convs = convs.join(bases, "base", "left").withColumn("shared", F.least("cut", F.coalesce("lends", F.lit(0))))
    convs = checkpointed(convs.select("conv", "base", "cut", "shared", (
        F.col("shared") + F.greatest(F.col("own") - F.col("cut"), F.lit(0))).alias("length")))
    # a conversation has a row here for each part it stands in
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(convs, "conv")
    starts = starts.select("conv", "part", (F.col("before") - F.col("first")).alias("shift"), "cut", "shared", "length")
    placed = checkpointed(ordered.join(starts, ["conv", "part"]).withColumn("place", F.col("at") + F.col("shift")))
    own_turns = placed.filter("place >= cut").select("conv", (F.col("place") - F.col("cut") + F.col("shared")).alias("place"), "id", "length")
    heads = placed.filter((F.col("conv") % FAMILY == 0) & (F.col("place") < LENT - 1)).select(F.col("conv").alias("base"), "place", "id")
    lent = heads.join(convs, "base").filter("place < shared").select("conv", "place", "id", "length")
    return own_turns.unionByName(lent), convs.select("conv", "length")


def blocks(rows: DataFrame) -> DataFrame:
    """conv, block, p1, p2 (the node before the block), t0 to t7, e1, e2 (the node it ends in), length."""
    turns, convs = rebuilt_turns(rows)
    one, two = _marks(F.col("id"), F.col("place"))
    whole = turns.withColumn("block", F.floor(F.col("place") / BLOCK)).groupBy("conv", "block").agg(
        *[F.max(F.when(F.col("place") % BLOCK == i, F.col("id"))).alias(t) for i, t in enumerate(_T)],
        F.max("length").alias("length"), F.bit_xor(one).alias("x1"), F.bit_xor(two).alias("x2"))
    none = convs.filter("length = 0").select(
        "conv", F.lit(0).cast("long").alias("block"), *[F.lit(None).cast("binary").alias(t) for t in _T], "length",
        F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"))
    whole = checkpointed(whole.unionByName(none).withColumn("stretch", F.floor(F.col("block") / STRETCH)))
    # what stands before a stretch: only conversations of over STRETCH blocks have such rows
    long = whole.filter(F.col("length") > STRETCH * BLOCK).groupBy("conv", "stretch").agg(
        F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    past = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    long = checkpointed(long.select("conv", "stretch", F.bit_xor("x1").over(past).alias("c1"), F.bit_xor("x2").over(past).alias("c2")))
    near = Window.partitionBy("conv", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = whole.withColumns({f"p{k}": F.coalesce(F.bit_xor(f"x{k}").over(near), F.lit(0)) for k in (1, 2)})
    found = found.join(long, ["conv", "stretch"], "left").withColumns({
        f"p{k}": F.col(f"p{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0))) for k in (1, 2)})
    return checkpointed(found.select("conv", "block", "p1", "p2", *_T, "length", *[
        F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"e{k}") for k in (1, 2)]))


def _prefixes(df: DataFrame, sums: str) -> DataFrame:
    """Key, parent's key (q1, q2), last turn and the sums of every prefix of every block of ``df``."""
    told = " + ".join(f"if({t} IS NULL, 0, 1)" for t in _T)
    found = df.sparkSession.sql(
        f"""SELECT block, p1, p2, {', '.join(_T)}, {BLOCK} - bit_count(grouping_id()) AS kept, {sums}
            FROM {{df}} GROUP BY block, p1, p2, ROLLUP ({', '.join(_T)})
            HAVING {BLOCK} - bit_count(grouping_id()) = {told} AND (block = 0 OR t0 IS NOT NULL)""", df=df)
    last = F.coalesce(*[F.col(t) for t in reversed(_T)])
    depth = F.col("block") * BLOCK + F.col("kept")
    marks = [_marks(F.col(t), F.col("block") * BLOCK + i) for i, t in enumerate(_T)]
    key = {}
    for k in (0, 1):
        value = F.col(f"p{k + 1}")
        for t, both in zip(_T, marks):
            value = value.bitwiseXOR(F.when(F.col(t).isNotNull(), both[k]).otherwise(F.lit(0)))
        key[f"k{k + 1}"] = value
    found = found.withColumns({"depth": depth, "last": last, **key})
    above = _marks(F.col("last"), F.col("depth") - 1)
    return found.withColumns({f"q{k + 1}": F.when(F.col("depth") > 0, F.col(f"k{k + 1}").bitwiseXOR(above[k])) for k in (0, 1)}).drop(
        "block", "p1", "p2", "kept", *_T)


def nodes(found: DataFrame) -> DataFrame:
    """Nodes of the trie: key, q1, q2, conv (smallest member), n_convs, leaf, own (saved by this node alone)."""
    all_nodes = _prefixes(found, "count(*) AS n_convs, min(conv) AS conv, max(length) AS longest")
    own = (F.col("n_convs") - 1) * F.coalesce(turn_bytes(F.col("last")), F.lit(0))
    return all_nodes.withColumns({"leaf": F.col("longest") == F.col("depth"), "own": own}).drop("last", "longest")


def _above(tree: DataFrame) -> DataFrame:
    """Adds ``above``, the sum of ``own`` over the shallower nodes of the same conversation, and ``top``, if there are none."""
    tree = tree.withColumn("stretch", F.floor(F.col("depth") / STRETCH))
    past = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    # conversations that fill only one stretch need nothing carried in
    per = tree.filter(F.col("stretch") > 0).select("conv").distinct()
    per = tree.join(per, "conv", "left_semi").groupBy("conv", "stretch").agg(F.sum("own").alias("own"))
    carried = checkpointed(per.select("conv", "stretch", F.sum("own").over(past).alias("carry")).filter("carry IS NOT NULL"))
    near = Window.partitionBy("conv", "stretch").orderBy("depth")
    before = near.rowsBetween(Window.unboundedPreceding, -1)
    tree = tree.withColumns({"above": F.coalesce(F.sum("own").over(before), F.lit(0)), "place": F.row_number().over(near)})
    tree = tree.join(carried, ["conv", "stretch"], "left")
    return tree.withColumns({"top": (F.col("place") == 1) & F.col("carry").isNull(),
                             "above": F.col("above") + F.coalesce("carry", F.lit(0))}).drop("stretch", "place", "carry")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of member ids of one node, joined by commas, with the first id of the run."""
    names = [*_KEY, "first", "ids"]
    key, held, out = None, [], []
    for batch in batches:
        for *now, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if now != key or len(held) == JOINED:
                if held:
                    out.append((*key, held[0], ",".join(map(str, held))))
                key, held = now, []
            held.append(conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])], names)
            out = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, held[0], ",".join(map(str, held))),
                                                                           [pa.int64()] * 4 + [pa.string()])], names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per node; its runs come in order, one after the other, and are not held."""
    names = [*_KEY, "ends_sha256"]
    key, state, out = None, None, []
    for batch in batches:
        for *now, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if now != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.string()])], names)
            out = []
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, state.hexdigest()), [pa.int64()] * 3 + [pa.string()])], names)


def end_hashes(found: DataFrame) -> DataFrame:
    """Key and ends_sha256 of the nodes in which conversations end."""
    last = (F.col("length") == 0) | (F.col("block") == F.floor((F.col("length") - 1) / BLOCK))
    ends = found.filter(last).select(F.col("length").alias("depth"), F.col("e1").alias("k1"), F.col("e2").alias("k2"), "conv")
    order = [*_KEY, "conv"]
    runs = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _joined, "depth long, k1 long, k2 long, first long, ids string")
    return runs.repartition(*[F.col(k) for k in _KEY]).sortWithinPartitions(*_KEY, "first").mapInArrow(
        _hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``rows`` has conv_id, turn, role and text. A node is named by its smallest member and its depth.
    """
    found = blocks(rows)
    tree = checkpointed(_above(nodes(found)))
    # what the nodes of a conversation hold, summed over the members of each node
    owners = tree.groupBy("conv").agg(F.sum("own").alias("held"), F.max(F.col("leaf").cast("long")).alias("leaves"))
    held = found.join(owners, "conv", "left")
    below = _prefixes(held, "sum(coalesce(held, 0)) AS held, sum(coalesce(leaves, 0)) AS n_leaves").select(*_KEY, "held", "n_leaves")
    children = checkpointed(tree.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(
        F.count("*").alias("n_children")))
    # only the top node of a conversation has a parent that belongs to another one; a parent may have very many such
    tops = tree.filter("top AND depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2"), "conv")
    hot = checkpointed(children.filter(F.col("n_children") > hot_rows).select(
        *_KEY, F.ceil(F.col("n_children") / F.lit(hot_rows)).cast("int").alias("__salts")))
    parents = tree.select(*_KEY, F.col("conv").alias("parent"))
    hot = None if hot.isEmpty() else hot
    parent = salted_join(tops, parents, _KEY, "inner", check=False, hot=hot).select("conv", "parent")
    out = tree.join(below, _KEY).join(children, _KEY, "left").join(end_hashes(found), _KEY, "left")
    upper = F.when(F.col("depth") > 0, F.when(F.col("top"), F.col("parent")).otherwise(F.col("conv")))
    out = out.join(parent.withColumn("top", F.lit(True)), ["conv", "top"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", upper.alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", (F.col("held") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
