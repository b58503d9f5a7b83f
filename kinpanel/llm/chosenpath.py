"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

Equal shingle sets are one class from the start. Each class has a sketch of ``COORDINATES`` minwise tokens. In each of
``TREES`` independent trees a class follows a path: the node it is in chooses a coordinate, the token there leads to
the next node. Small nodes are compared exhaustively by sketch; large ones branch on, and what is still large at the
last level is cut into blocks, each compared with itself and with a few members that all blocks of the node share, and
afterwards every member that is not yet connected with the node's largest group with every block. Two sets of similarity
s meet at the first level of a tree with probability s, so ``TREES`` trees miss fewer than one pair in a million there.
Comparisons by sketch only say which classes may be connected.

Links are then confirmed on full sets inside each set of possibly connected classes: all pairs of a small one; of a
large one, blocks with themselves and with shared members, and afterwards everything that is not yet connected with the
largest group against every block. Only spanning links are kept, as pairs inside a group add nothing to it.

Defined cases: a text of fewer words than a shingle is one shingle; without words (or null) it has no shingles, is
linked with nothing and is its own component. Rows that repeat a doc_id are documents like others. A null doc_id never
names a component; where a component has no doc_id its name is null. Very long texts are read whole. An empty table
gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from kinpanel.llm.common import (MULTIPLIERS, WordHashes, connected_components, document_sets, map_groups, mixed, per_key, text_bytes,
                                 union_find, word_arrays)
from kinpanel.session import checkpointed

COORDINATES = 48
TREES = 12
LEVELS = 6
#: members of a node, or of a set of connected classes, that one task compares with each other
LIMIT = 200
#: members that all blocks of a large node share
SHARED = 8
#: sketches of two sets agree this much less than the sets, at most (four standard errors)
SLACK = 0.21
_SKETCH = "doc_id long, stamp long, n_shingles long, digest binary, sketch binary"


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, stamp (hash of the text), n_shingles, digest of the set, sketch per row of ``docs``."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("stamp"), text_bytes().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            sizes, digests, rows = [], [], []
            for _, _, words, counts in word_arrays(batch.column("text").to_pylist(), memo):
                sets = document_sets(words, counts, width)
                sizes += [len(s) for s in sets]
                digests += [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
                rows += sketched(sets)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("stamp"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                pa.array(rows, pa.binary())], ["doc_id", "stamp", "n_shingles", "digest", "sketch"])

    return source.mapInArrow(run, _SKETCH)


def sketched(sets: list[np.ndarray]) -> list[bytes | None]:
    """Smallest hash of each set under each of the coordinates' hash functions."""
    filled = [s for s in sets if len(s)]
    out = np.empty((len(filled), COORDINATES), dtype=np.uint32)
    if filled:
        flat = np.concatenate(filled)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in filled])[:-1]])
        for k in range(COORDINATES):
            out[:, k] = np.minimum.reduceat((flat * MULTIPLIERS[k]) >> np.uint64(32), starts)
    rows = iter(out)
    return [next(rows).tobytes() if len(s) else None for s in sets]


def paths(classes: DataFrame, trees: int = TREES) -> DataFrame:
    """digest and, per tree, the nodes p1 .. pLEVELS on its path."""
    names = [f"p{k + 1}" for k in range(LEVELS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
            for tree in range(trees):
                node = mixed(np.full(len(tokens), tree + 1, dtype=np.uint64) * np.uint64(0x51ED27))
                found = []
                for _ in range(LEVELS):
                    chosen = (node >> np.uint64(7)) % np.uint64(COORDINATES)
                    node = mixed(node + MULTIPLIERS[64] * tokens[np.arange(len(tokens)), chosen.astype(np.int64)].astype(np.uint64))
                    found.append(pa.array(node.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("digest"), *found], ["digest", *names])

    return classes.select("digest", "sketch").mapInArrow(run, "digest binary, " + ", ".join(f"{n} long" for n in names))


def nodes(classes: DataFrame, trees: int = TREES) -> tuple[DataFrame, DataFrame | None]:
    """node, part, digest: groups of at most about ``LIMIT`` classes to compare; nodes of one class are left out.

    And node, parts, digest of the nodes that are cut into blocks (None without such): there, a group is one of the blocks
    with the members that they share, and classes of two blocks are still to be compared.
    """
    every = paths(classes, trees)
    small, now = [], None
    for level in range(1, LEVELS + 1):
        name = f"p{level}"
        source = every if now is None else now
        counts = source.groupBy(name).agg(F.count("*").alias("n")).filter("n > 1")
        # written, so that few nodes are broadcast; from the second level on all classes are in a large node
        met = checkpointed(source.join(checkpointed(counts), name) if now is None else per_key(source, counts, name))
        small.append(met.filter(F.col("n") <= LIMIT).select(F.col(name).alias("node"), F.lit(0).alias("part"), "digest"))
        now = met.filter(F.col("n") > LIMIT)
        if now.isEmpty():
            return _union(small), None
        if level < LEVELS:
            now = now.drop("n")
    parts = F.ceil(F.col("n") / LIMIT).cast("int")
    large = now.select(F.col(f"p{LEVELS}").alias("node"), parts.alias("parts"), "digest")
    own = large.select("node", _block().alias("part"), "digest")
    return _union([*small, own, _shared(large, ["node"]).select("node", "part", "digest")]).distinct(), large


def _block():
    return F.pmod(F.xxhash64("digest", "node"), F.col("parts")).cast("int")


def _shared(large: DataFrame, keys: list[str]) -> DataFrame:
    """A few members of each group, repeated for each of its ``parts``; picking them is limited inside each task first."""
    first = Window.partitionBy(*keys).orderBy(F.xxhash64("digest", F.lit(1)), "digest")
    picked = large.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= SHARED).drop("__n")
    return picked.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def maybe_connected(classes: DataFrame, percent: int) -> DataFrame:
    """digest, root: classes that the trees find alike enough to be looked at, by connected set."""
    met, large = nodes(classes)
    sketched_classes = classes.select("digest", "sketch", "n_shingles")
    least = percent / 100 - SLACK

    def alike(rows: pd.DataFrame, asked: np.ndarray | None = None) -> pd.DataFrame | None:
        """Links among the rows, or only those of rows that are asked for."""
        tokens = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint32).reshape(-1, COORDINATES)
        sizes = rows["n_shingles"].to_numpy()
        left, right = [], []
        for i in range(len(rows) - 1) if asked is None else np.flatnonzero(asked).tolist():
            first = i + 1 if asked is None else 0
            agree = (tokens[first:] == tokens[i]).mean(1) >= least
            near = np.minimum(sizes[first:], sizes[i]) * 100 >= np.maximum(sizes[first:], sizes[i]) * percent
            found = np.flatnonzero(agree & near) + first
            left += [i] * len(found)
            right += found.tolist()
        return spanning(rows["digest"], left, right)

    members = met.join(sketched_classes, "digest").select("node", "part", "digest", "sketch", "n_shingles")
    edges = map_groups(members, ["node", "part"], alike, "a binary, b binary")
    known = connected_components(edges)
    if large is not None:
        asked = _outside(large, known, ["node"])
        if asked is not None:
            dealt = _against_blocks(large.join(sketched_classes, "digest"), asked, ["node"], _block())
            more = map_groups(dealt, ["node", "part", "other"], lambda rows: alike(rows, rows["kind"].to_numpy() == 1), "a binary, b binary")
            known = connected_components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    return checkpointed(known.select(F.col("node").alias("digest"), "root"))


def _outside(large: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame | None:
    """keys, digest of the members of each set that are not connected (``known``) with its largest group; None without such."""
    inside = large.select(*keys, "digest").join(
        known.select(F.col("node").alias("digest"), F.col("root").alias("__g")), "digest", "left").withColumn("group", F.coalesce("__g", "digest"))
    counted = inside.groupBy(*keys, "group").agg(F.count("*").alias("c"))
    # written, so that few sets are broadcast
    main = checkpointed(counted.groupBy(*keys).agg(F.max(F.struct("c", "group")).alias("m")).select(*keys, F.col("m.group").alias("main")))
    out = checkpointed(inside.join(main, keys).filter("group <> main").select(*keys, "digest"))
    return None if out.isEmpty() else out


def _against_blocks(large: DataFrame, out: DataFrame, keys: list[str], block) -> DataFrame:
    """keys, part, other, kind, and the columns of ``large``: members ``out`` (kind 1) of a set with each of its blocks (0).

    Both sides are dealt in portions of about ``LIMIT``, so a group is bounded however many there are.
    """
    number = checkpointed(out.groupBy(*keys).agg(F.ceil(F.count("*") / LIMIT).cast("int").alias("others")))
    with_number = large.join(number, keys)
    asked = with_number.join(out, [*keys, "digest"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn(
        "other", F.pmod(F.xxhash64("digest", F.lit(2)), F.col("others")).cast("int"))
    base = with_number.withColumn("part", block).withColumn("other", F.explode(F.expr("sequence(0, others - 1)")))
    return asked.withColumn("kind", F.lit(1)).unionByName(base.withColumn("kind", F.lit(0))).drop("parts", "others")


def spanning(digest: pd.Series, left: list[int], right: list[int]) -> pd.DataFrame | None:
    """A link from every member of a group to its first member."""
    top = union_find(len(digest), left, right)
    below = np.flatnonzero(top != np.arange(len(digest)))
    if not len(below):
        return None
    return pd.DataFrame({"a": digest.iloc[below].tolist(), "b": digest.iloc[top[below]].tolist()})


def links(sets: list[np.ndarray], percent: int, pairs: np.ndarray | None = None, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j with 100 * intersection >= percent * union, from full sets.

    ``pairs`` [n, n] restricts what is looked at. Intersections are products of 0/1 columns of the shared shingles.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    column = (np.cumsum(counts > 1) - 1)[inverse][shared]
    owner = owner[shared]
    common = np.zeros((n, n), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, block):
        begin, end = np.searchsorted(column, [low, low + block])
        hot = np.zeros((n, block), dtype=np.float32)
        hot[owner[begin:end], column[begin:end] - low] = 1
        common += hot @ hot.T
    good = 100 * common >= percent * (sizes[:, None] + sizes[None] - common)
    if pairs is not None:
        good &= pairs
    return np.nonzero(np.triu(good, 1))


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    memo = WordHashes()
    return [s for _, _, words, counts in word_arrays(texts, memo) for s in document_sets(words, counts, width)]


def confirmed(docs: DataFrame, classes: DataFrame, roots: DataFrame, width: int, percent: int) -> DataFrame:
    """digest, root: connected classes by links confirmed on full sets."""
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    wanted = classes.join(roots, "digest").join(sizes, "root").select("root", "digest", "n", F.col("first.doc_id").alias("__id"), F.col("first.stamp").alias("__stamp"))
    wanted = checkpointed(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("stamp"), text_bytes().alias("text"))
    found = texts.join(wanted, (F.col("stamp") == F.col("__stamp")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    # rows that repeat a class's first document give the same text again
    found = checkpointed(found.groupBy("root", "digest", "n").agg(F.first("text").alias("text")))

    def compare(rows: pd.DataFrame) -> pd.DataFrame | None:
        sets = _sets(rows["text"].tolist(), width)
        return spanning(rows["digest"], *links(sets, percent))

    small = found.filter(F.col("n") <= LIMIT).select("root", F.lit(0).alias("part"), "digest", "text")
    large = found.filter(F.col("n") > LIMIT).withColumn("parts", F.ceil(F.col("n") / LIMIT).cast("int"))
    own = large.select("root", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("part"), "digest", "text")
    shared = _shared(large, ["root"]).select("root", "part", "digest", "text")
    dealt = small.union(own).union(shared).dropDuplicates(["root", "part", "digest"])
    edges = checkpointed(map_groups(dealt, ["root", "part"], compare, "a binary, b binary"))
    known = connected_components(edges)
    if large.isEmpty():
        return known
    # what is not in the largest group of its set meets every block of the set
    out = _outside(large, known, ["root"])
    if out is None:
        return known
    dealt = _against_blocks(large.select("root", "parts", "digest", "text"), out, ["root"], F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))

    def outside(rows: pd.DataFrame) -> pd.DataFrame | None:
        kind = rows["kind"].to_numpy()
        sets = _sets(rows["text"].tolist(), width)
        return spanning(rows["digest"], *links(sets, percent, (kind[:, None] | kind[None]) == 1))

    more = map_groups(dealt, ["root", "part", "other"], outside, "a binary, b binary")
    return connected_components(edges.union(more))


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, stamp, n_shingles, component_id, kept, chosen for every row of ``docs`` (doc_id, text).

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct ``width``-word shingles.
    ``chosen`` marks one document per component, also where doc_ids are null or repeat: the one with the smallest
    doc_id (null last) and, among those, text hash; rows that agree in both are chosen together.
    """
    rows = checkpointed(sketches(docs, width))
    classes = checkpointed(rows.filter("n_shingles > 0").groupBy("digest", "n_shingles").agg(
        F.min("doc_id").alias("id"), F.min(F.struct("doc_id", "stamp")).alias("first"), F.min(_place()).alias("place"), F.first("sketch").alias("sketch")))
    groups = checkpointed(confirmed(docs, classes, maybe_connected(classes, percent), width, percent))
    named = classes.select("digest", "id", "place").join(groups.withColumnRenamed("node", "digest"), "digest", "left")
    named = checkpointed(named.withColumn("root", F.coalesce("root", "digest")))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"), F.min("place").alias("place"))
    of_class = named.drop("place").join(least, "root").select("digest", "component_id", "place")
    out = rows.join(of_class, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "stamp", "n_shingles", component.alias("component_id"), (
        F.col("place").isNull() | (F.col("place") == _place())).alias("chosen")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _place():
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("stamp").alias("stamp"))
