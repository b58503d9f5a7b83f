"""Substring dedup: MinHash banding over paragraphs, exact Jaccard, and removal by connected components.

Repeated passages stand inside lines and across them, so a paragraph here is cut by content: ``SPAN`` words around an
anchor, the last of the smallest word pairs (by hash) of some ``WINDOW`` consecutive pairs. The same passage has the
same paragraphs wherever it stands; any run of ``WINDOW`` pairs has an anchor, so a passage of over 50 words holds a
whole paragraph. With ``whole``, a paragraph that goes takes along the words beside it that equal those beside the one
that stays, so an exact copy goes from its first to its last word.

Every paragraph has a key per band; the number of bands and of minwise hashes in each are chosen for ``RECALL`` with the
fewest rows at the least similarity above the threshold that two paragraphs can have: of 17 shingles each, similar ones
share at least 16. (Those that repeat a shingle have fewer, and may be linked with less in common, down to the threshold;
such a pair is found with at least 0.95.) Rows go once by key, and a key that one paragraph has alone ends there. Paragraphs that
share a key and whose one-bit sketches agree as those of similar ones do are compared by their full sets of 5-word
shingles. Those under a key that too many different paragraphs share (a line that stands in many contexts) are linked
exactly, too: compared under the rarest of their shingles, of which similar ones must have one in common. A key that is
frequent in a task is dealt out in runs, so no key fills a task. Of each connected group of paragraphs the first occurrence, by
doc_id and place, stays; the words of all others go, except words of a paragraph that stays.

Defined cases: texts of fewer words than a paragraph, empty or null texts have none and stay as they are. A null
doc_id comes first. Rows that repeat doc_id and text are one document: they lose the same words. Very long texts are
cut whole. An empty table gives no rows. Extra columns pass through ``without_repeats``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinpanel.llm import chosenpath
from kinpanel.llm.common import MULTIPLIERS, WordHashes, connected_components, map_runs, mixed, per_key, shingle_hashes, text_bytes, union_find, word_arrays
from kinpanel.session import checkpointed

SPAN = 21
#: pairs on either side of which an anchor is the smallest, and pairs of which there always is one
REACH, WINDOW = 2, 30
WIDTH = 5
PERCENT = 80
RECALL = 0.99
#: different paragraphs under one key that one task compares with each other
LIMIT = chosenpath.LIMIT
#: rows of one key in a task that stay in one run
RUN = 64
#: words on either side of a paragraph that are compared with those beside the one that stays; a longer run has a further
#: paragraph of its own
BESIDE = 40
#: bits of 64 in which the sketches of similar paragraphs may differ; 0.9986 of the pairs at a similarity of 0.8 (6.4 bits on
#: average, 2.4 the deviation) and all but one in a million at 16 / 18 stay within it
DIFFER = 14
#: paragraphs whose sketches are made at once, so that their shingles stay in the processor's cache
BLOCK = 2048
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tuned(threshold: float, recall: float = RECALL, most: int = 30) -> tuple[int, int]:
    """(bands, hashes per band) with the fewest bands that find a pair at the threshold with ``recall``."""
    for bands in range(1, most + 1):
        if 1 - (1 - threshold) ** bands >= recall:
            rows = max(r for r in range(1, 9) if 1 - (1 - threshold**r) ** bands >= recall)
            return bands, rows
    return most, 1


def least_similarity(size: int, percent: int) -> float:
    """The smallest Jaccard similarity of ``percent`` or more that two sets of ``size`` elements can have."""
    common = -(-2 * size * percent // (100 + percent))
    return common / (2 * size - common)


def anchors(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, word number of the anchor) of every paragraph that lies in its document."""
    n = len(words)
    starts = np.concatenate([[0], np.cumsum(counts)])
    if n < SPAN:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    pair = np.append(shingle_hashes(words, 2), np.uint64(2**64 - 1))
    # not above the pairs before it and strictly below those after it, so two are never side by side
    low = np.ones(n, dtype=bool)
    for k in range(1, REACH + 1):
        low[k:] &= pair[k:] <= pair[:-k]
        low[:-k] &= pair[:-k] < pair[k:]
    at = np.flatnonzero(low)
    row = np.searchsorted(starts, at, side="right") - 1
    # judged inside their document alone; near its ends the neighbours are another one's words
    near = (at - REACH >= starts[row]) & (at + REACH + 2 <= starts[row + 1])
    at, row = at[near], row[near]
    value, before, after = pair[at], starts[row] - 1, starts[row + 1] - 1
    for k in range(1, min(len(at), WINDOW // (REACH + 1) + 2)):
        same = row[k:] == row[:-k]
        before[k:] = np.maximum(before[k:], np.where(same & (value[:-k] < value[k:]), at[:-k], -1))
        after[:-k] = np.minimum(after[:-k], np.where(same & (value[k:] <= value[:-k]), at[k:], n))
    # rightmost smallest of a whole window; a shorter document is one window
    chosen = at[after - before - 1 >= np.minimum(WINDOW, counts[row] - 1)]
    # one or two words over and over have no smallest pair: every place in such a run is as good as another
    bounds = np.unique(np.concatenate([at, starts - 1]))
    half = SPAN // 2
    more = [np.arange(bounds[i] + WINDOW // 2, bounds[i + 1] - WINDOW // 2 + 1, half)
            for i in np.flatnonzero(np.diff(bounds) > WINDOW).tolist()]
    at = np.sort(np.concatenate([chosen, *more])) if more else chosen
    row = np.searchsorted(starts, at, side="right") - 1
    inside = (at - half >= starts[row]) & (at - half + SPAN <= starts[row + 1])
    return row[inside], at[inside] - starts[row[inside]]


def _sketched(shingles: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the whole, sketch, and a key per band (bands x paragraphs) of the paragraphs that begin at ``begin``."""
    own = shingles[np.arange(SPAN - WIDTH + 1)[:, None] + begin]
    content = mixed((own * MULTIPLIERS[100:100 + len(own), None]).sum(axis=0, dtype=np.uint64))
    bits = np.zeros(len(begin), dtype=np.uint64)
    for k in range(64):
        bits |= (mixed((own * MULTIPLIERS[300 + k]).min(axis=0)) & np.uint64(1)) << np.uint64(k)
    keys = np.empty((bands, len(begin)), dtype=np.uint64)
    for band in range(bands):
        value = np.full(len(begin), band + 1, dtype=np.uint64)
        for k in range(rows):
            value = mixed(value + mixed(own * MULTIPLIERS[200 + band * rows + k]).min(axis=0))
        keys[band] = value
    return content, bits, keys


def keyed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """key, run, doc_id, stamp, start, content, bits: a row per paragraph and band; the keys of the first band are odd.

    A bit of the sketch is one of the smallest hash of the paragraph's shingles under one of 64 hash functions.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("stamp"), text_bytes().alias("text"))
    names = ["key", "run", "doc_id", "stamp", "start", "content", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        seen: dict[int, int] = {}
        for batch in batches:
            ids, stamps = batch.column("doc_id"), batch.column("stamp")
            for first, end, words, counts in word_arrays(batch.column("text").to_pylist(), memo):
                row, at = anchors(words, counts)
                if not len(row):
                    continue
                starts = np.concatenate([[0], np.cumsum(counts)])
                begin = starts[row] + at - SPAN // 2
                shingles = shingle_hashes(words, WIDTH)
                content, bits, key = (np.concatenate(c, axis=-1) for c in zip(*(
                    _sketched(shingles, begin[i:i + BLOCK], bands, rows) for i in range(0, len(begin), BLOCK))))
                key &= ~np.uint64(1)
                key[0] |= np.uint64(1)
                key = key.ravel().view(np.int64)
                # number of the row among the task's rows of its key, only for keys that are frequent here
                values, place, number = np.unique(key, return_inverse=True, return_counts=True)
                runs = np.zeros(len(key), dtype=np.int32)
                often = number > 8
                if often.any() or seen:
                    for v in np.flatnonzero(often | np.isin(values, np.fromiter(seen, np.int64, len(seen)))):
                        before = seen.get(int(values[v]), 0)
                        mine = np.flatnonzero(place == v)
                        runs[mine] = (before + np.arange(len(mine))) // RUN
                        seen[int(values[v])] = before + len(mine)
                index = pa.array(np.tile(first + row, bands))
                yield pa.RecordBatch.from_arrays([
                    pa.array(key), pa.array(runs), ids.take(index), stamps.take(index),
                    pa.array(np.tile(at - SPAN // 2, bands).astype(np.int32)), pa.array(np.tile(content.view(np.int64), bands)),
                    pa.array(np.tile(bits.view(np.int64), bands))], names)

    return source.mapInArrow(run, "key long, run int, doc_id long, stamp long, start int, content long, bits long")


def _judged(key: np.ndarray, runs: np.ndarray, content: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of whole runs go on from ``shared_keys``, and which of them are near."""
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (runs[1:] != runs[:-1])]))
    size = np.diff(np.append(start, len(key)))
    frequent = (runs[start] > 0) | (size >= RUN)
    alike = np.logical_and.reduceat(content == np.repeat(content[start], size), start)
    first_band = (key[start] & 1).astype(bool)
    # most runs are frequent, of one paragraph alone, or of two rows
    two = np.flatnonzero(~frequent & ~alike & (size == 2))
    close = two[np.bitwise_count(bits[start[two]] ^ bits[start[two] + 1]) <= DIFFER]
    whole = frequent.copy()
    whole[close] = True
    near = np.repeat(whole, size)
    kept = near | np.repeat(alike & first_band & (size > 1), size)
    for i in np.flatnonzero(~frequent & ~alike & (size > 2)).tolist():
        here = slice(start[i], start[i] + size[i])
        names = content[here].tolist()
        different = list(dict(zip(names, bits[here].tolist())).items())
        found = set()
        for k, (a, x) in enumerate(different):
            for b, y in different[:k]:
                if (x ^ y).bit_count() <= DIFFER:
                    found.update((a, b))
        near[here] = [n in found for n in names]
        kept[here] = near[here]
        if first_band[i] and len(different) < len(names):
            number: dict[int, int] = {}
            for n in names:
                number[n] = number.get(n, 0) + 1
            kept[here] = [n in found or number[n] > 1 for n in names]
    return kept, near


def shared_keys(rows: DataFrame) -> DataFrame:
    """key, doc_id, stamp, start, content, near of the rows of ``keyed`` that another row of their key may repeat.

    ``near`` marks rows with a different paragraph beside them whose sketch is close; the others stand there for an
    equal one. Equal paragraphs meet under the key of every band, so those of the first stand for the others. Of a
    frequent key (its first run is full) every row goes on.
    """
    names = ["key", "doc_id", "stamp", "start", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.RecordBatch | None = None

        def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
            key, runs, content, bits = (batch.column(n).to_numpy() for n in ("key", "run", "content", "bits"))
            kept, near = _judged(key, runs, content, bits.view(np.uint64))
            out = batch.select(names).filter(pa.array(kept))
            return pa.RecordBatch.from_arrays([*out.columns, pa.array(near[kept])], [*names, "near"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if left is not None:
                batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
            key, runs = batch.column("key").to_numpy(), batch.column("run").to_numpy()
            # the last run may go on in the next batch
            cut = int(np.argmax((key == key[-1]) & (runs == runs[-1])))
            left = batch.slice(cut)
            if cut:
                yield judge(batch.slice(0, cut))
        if left is not None:
            yield judge(left)

    return rows.repartition("key", "run").sortWithinPartitions("key", "run").mapInArrow(
        run, "key long, doc_id long, stamp long, start int, content long, near boolean")


def _flat(lists: pa.ListArray) -> tuple[pa.StructArray, np.ndarray]:
    """All items of the lists, and the first item of each list with the end of the last one."""
    at = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), at - at[0]


def _binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """``values`` in runs of ``counts`` as bytes."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """content, shingles (sorted set) of the paragraphs ``wanted`` (doc_id, stamp, start, content)."""
    lists = wanted.groupBy("doc_id", "stamp").agg(F.collect_list(F.struct("start", "content")).alias("own"))
    lists = checkpointed(lists.withColumnsRenamed({"doc_id": "__id", "stamp": "__stamp"}))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("stamp"), text_bytes().alias("text"))
    met = texts.join(lists, (F.col("stamp") == F.col("__stamp")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    # rows that repeat a document are one
    met = met.groupBy("stamp", "doc_id").agg(F.first("text").alias("text"), F.first("own").alias("own")).select("text", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            item, at = _flat(batch.column("own"))
            content, start = item.field("content"), item.field("start").to_numpy()
            for first, end, words, counts in word_arrays(batch.column("text").to_pylist(), memo):
                starts = np.concatenate([[0], np.cumsum(counts)])
                here = slice(at[first], at[end])
                begin = np.repeat(starts[:-1], np.diff(at[first:end + 1])) + start[here]
                sets = np.sort(shingle_hashes(words, WIDTH)[begin[:, None] + np.arange(SPAN - WIDTH + 1)], axis=1)
                new = np.ones(sets.shape, dtype=bool)
                new[:, 1:] = sets[:, 1:] != sets[:, :-1]
                yield pa.RecordBatch.from_arrays([content[here], _binaries(sets[new], new.sum(axis=1))], ["content", "shingles"])

    return met.mapInArrow(run, "content long, shingles binary")


def deletions(size: int, low: int, high: int, percent: int) -> int:
    """Elements that a set of ``size`` may have beyond those of a similar set of ``low`` to ``high`` elements."""
    most = 0
    for other in range(low, high + 1):
        common = -(-percent * (size + other) // (100 + percent))
        if common <= min(size, other):
            most = max(most, size - common)
    return most


def _subsets(described: DataFrame, asked: DataFrame, percent: int) -> DataFrame:
    """part (hash of a subset), content, size, common (size of the subset) of the contents ``asked`` (content, low, high).

    Two similar sets have a subset in common that is large enough to make them so, and few of either's elements are not
    in it. So each set has few subsets, and sets that share one of them are linked or not by their sizes alone.
    """
    names = ["part", "content", "size", "common"]
    left_out: dict[tuple[int, int], np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, data, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                own = mixed(np.frombuffer(data, dtype=np.uint64) * MULTIPLIERS[400])
                total = own.sum(dtype=np.uint64)
                for r in range(deletions(len(own), low, high, percent) + 1):
                    if (len(own), r) not in left_out:
                        left_out[len(own), r] = np.array(list(combinations(range(len(own)), r)), dtype=np.int64)
                    part = mixed(total - own[left_out[len(own), r]].sum(axis=1, dtype=np.uint64)).view(np.int64)
                    out.append((part, np.full(len(part), content), np.full(len(part), len(own)), np.full(len(part), len(own) - r)))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names)

    return described.join(asked, "content").select("content", "shingles", "low", "high").mapInArrow(
        run, "part long, content long, size int, common int")


def crowded_links(pairs: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """a, b: contents under crowded keys (``pairs``) linked so that all similar ones are connected; rows grow with the contents.

    Two similar sets share one of the few rarest shingles of either (its size less the least common part, and one more), so
    contents are compared under these alone. Only a shingle that is among the rarest of too many is left to ``subset_links``.
    """
    own = described.join(pairs.select("content").distinct(), "content", "left_semi")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(data, dtype=np.int64) for data in batch.column("shingles").to_pylist()]
            names = np.repeat(batch.column("content").to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else [], pa.int64()), pa.array(names, pa.int64())],
                                             ["item", "content"])

    items = checkpointed(own.select("content", "shingles").mapInArrow(listed, "item long, content long"))
    counted = per_key(items, items.groupBy("item").agg(F.count("*").alias("n")), "item")
    # a paragraph has at most SPAN - WIDTH + 1 shingles
    ranked = counted.groupBy("content").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("all"))
    size = F.size("all")
    ranked = ranked.select("content", F.explode(F.slice("all", F.lit(1), size - F.ceil(size * percent / 100).cast("int") + 1)).alias("r"))
    rare = checkpointed(ranked.select(F.col("r.item").alias("key"), "content"))
    sizes = rare.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rare = checkpointed(per_key(rare, sizes, "key"))
    small = rare.filter(F.col("n") <= LIMIT).select(F.col("key").alias("node"), F.lit(0).alias("part"), "content")
    edges = map_runs(small.join(described, "content").select("node", "part", "content", "shingles"), 2, _compared(percent), "a long, b long")
    large = rare.filter(F.col("n") > LIMIT).select("key", "content")
    return edges if large.isEmpty() else edges.union(subset_links(large, described, percent))


def subset_links(pairs: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """a, b: contents of very large groups (``pairs``) linked through the subsets that similar ones must have in common."""
    sizes = described.select("content", (F.length("shingles") / 8).cast("int").alias("size"))
    own = pairs.select("key", "content").join(sizes, "content")
    own = checkpointed(own)
    among = own.groupBy("key").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.count("*").alias("n"))
    asked = per_key(own, among, "key").groupBy("content").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rows = checkpointed(_subsets(described, asked, percent))
    # the smallest set with a subset is linked with whichever other is linked with any
    first = rows.groupBy("part").agg(F.min(F.struct("size", "content")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    near = (100 + percent) * F.col("common") >= percent * (F.col("size") + F.col("f.size"))
    return per_key(rows, first, "part").filter(near & (F.col("content") != F.col("f.content"))).select(
        F.col("content").alias("a"), F.col("f.content").alias("b")).distinct()


def _compared(percent: int):
    """Links from each member of a connected group to its first; rows are (node, part, content, shingles)."""
    def compare(rows: list[tuple]) -> list[tuple]:
        rows = list({row[2]: row for row in rows}.values())
        if len(rows) > 12:
            sets = [np.frombuffer(row[3], dtype=np.uint64) for row in rows]
            left, right = chosenpath.links(sets, percent)
        else:
            small = [{row[3][i:i + 8] for i in range(0, len(row[3]), 8)} for row in rows]
            found = [(i, j) for j, b in enumerate(small) for i, a in enumerate(small[:j])
                     if 100 * (common := len(a & b)) >= percent * (len(a) + len(b) - common)]
            left, right = zip(*found) if found else ((), ())
        top = union_find(len(rows), left, right)
        return [(rows[i][2], rows[t][2]) for i, t in enumerate(top.tolist()) if i != t]

    return compare


def clusters(docs: DataFrame, shared: DataFrame, percent: int = PERCENT) -> DataFrame:
    """content, root: different paragraphs connected by exact Jaccard similarity; those alone are left out."""
    pairs = shared.filter("near").select("key", "content").distinct()
    pairs = checkpointed(pairs)
    pairs = checkpointed(per_key(pairs, pairs.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key"))
    # counted before they are joined, so that a paragraph of many copies is one row
    first = shared.groupBy("content").agg(F.min(F.struct("doc_id", "stamp", "start")).alias("f"))
    first = first.join(pairs.select("content").distinct(), "content", "left_semi").select("content", "f.*")
    described = checkpointed(contents(docs, first))
    small = pairs.filter(F.col("n") <= LIMIT).select(F.col("key").alias("node"), F.lit(0).alias("part"), "content")
    edges = map_runs(small.join(described, "content").select("node", "part", "content", "shingles"), 2, _compared(percent), "a long, b long")
    large = pairs.filter(F.col("n") > LIMIT)
    if not large.isEmpty():
        edges = edges.union(crowded_links(large, described, percent))
    return connected_components(edges).select(F.col("node").alias("content"), "root")


def repeats(docs: DataFrame, percent: int = PERCENT, whole: bool = False) -> DataFrame:
    """doc_id, stamp, cuts, stays (arrays of first words of paragraphs), more per document that has a repeated paragraph.

    ``more`` has the runs (first, end) of words that equal those in and beside the paragraph that stays; it is empty
    without ``whole``.
    """
    bands, rows = tuned(least_similarity(SPAN - WIDTH + 1, percent))
    shared = checkpointed(shared_keys(keyed(docs, bands, rows)))
    roots = checkpointed(clusters(docs, shared, percent))
    # groups are made of different paragraphs with their numbers of copies; then each copy meets its group once
    every = checkpointed(shared.select("doc_id", "stamp", "start", "content").distinct())
    counted = every.groupBy("content").agg(F.min(F.struct("doc_id", "stamp", "start")).alias("f"), F.count("*").alias("n"))
    counted = checkpointed(counted.join(roots, "content", "left").filter("n > 1 OR root IS NOT NULL").withColumn(
        "root", F.coalesce("root", "content")))
    kept = counted.groupBy("root").agg(F.min(F.struct("f.*", "content")).alias("kept"), F.sum("n").alias("all")).filter("all > 1")
    groups = per_key(counted.select("content", "n", "root"), kept, "root", "all").drop("all")
    marked = per_key(every, groups, "content").drop("n").withColumn(
        "stays", F.struct("doc_id", "stamp", "start", "content") == F.col("kept"))
    if whole:
        marked = widened(docs, checkpointed(marked))
    else:
        marked = marked.withColumn("wide", F.lit(None).cast("array<struct<first: int, end: int>>"))
    return marked.groupBy("doc_id", "stamp").agg(
        F.collect_list(F.when(~F.col("stays"), F.col("start"))).alias("cuts"),
        F.collect_list(F.when(F.col("stays"), F.col("start"))).alias("stays"), F.flatten(F.collect_list("wide")).alias("more"))


def widened(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """doc_id, stamp, start, stays, wide (runs of first and end word) of the paragraphs ``marked``.

    The words beside a paragraph go on to the paragraph that stays as 32-bit hashes, from the paragraph outwards. None are
    needed towards a neighbour that follows on from the same document at the same distance and touches.
    """
    item = F.struct("start", "root", "stays", "kept", (F.col("content") == F.col("kept.content")).alias("equal"))
    lists = checkpointed(marked.groupBy("doc_id", "stamp").agg(F.sort_array(F.collect_list(item)).alias("own")).withColumnsRenamed(
        {"doc_id": "__id", "stamp": "__stamp"}))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("stamp"), text_bytes().alias("text"))
    met = texts.join(lists, (F.col("stamp") == F.col("__stamp")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    # rows that repeat a document are one
    met = met.groupBy("stamp", "doc_id").agg(F.first("text").alias("text"), F.first("own").alias("own")).select("doc_id", "stamp", "text", "own")
    names = ["root", "stays", "equal", "doc_id", "stamp", "start", "left", "right"]

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            item, at = _flat(batch.column("own"))
            start, stays = item.field("start").to_numpy().astype(np.int64), item.field("stays").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            gap = _gaps(row, start, stays, item.field("kept"))
            n_left = np.where(stays | (gap[:-1] == BESIDE), BESIDE, 0)
            n_right = np.where(stays, BESIDE, gap[1:])
            for first, end, words, counts in word_arrays(batch.column("text").to_pylist(), memo):
                starts = np.concatenate([[0], np.cumsum(counts)])
                short = (mixed(words) >> np.uint64(32)).astype(np.uint32)
                here = slice(at[first], at[end])
                low, high = starts[row[here] - first], starts[row[here] - first + 1]
                begin = low + start[here]
                left = np.minimum(n_left[here], begin - low)
                right = np.minimum(n_right[here], high - begin - SPAN)
                index = pa.array(row[here])
                yield pa.RecordBatch.from_arrays([
                    item.field("root")[here], item.field("stays")[here], item.field("equal")[here],
                    batch.column("doc_id").take(index), batch.column("stamp").take(index), item.field("start")[here],
                    _binaries(short[np.repeat(begin - 1, left) - _numbers(left)], left),
                    _binaries(short[np.repeat(begin + SPAN, right) + _numbers(right)], right)], names)

    rows = checkpointed(met.mapInArrow(beside, "root long, stays boolean, equal boolean, doc_id long, stamp long, start int, left binary, right binary"))
    first = rows.filter("stays").select("root", F.col("left").alias("first_left"), F.col("right").alias("first_right"))
    first = first.join(rows.groupBy("root").agg(F.count("*").alias("n")), "root")

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, c, d, start, equal in zip(*(batch.column(n).to_pylist() for n in ("left", "first_left", "right", "first_right", "start", "equal"))):
                runs = [(start - agree(a, b), start), (start + SPAN, start + SPAN + agree(c, d))]
                found.append([{"first": x, "end": y} for x, y in ([(runs[0][0], runs[1][1])] if equal else runs)])
            yield pa.RecordBatch.from_arrays([
                *(batch.column(n) for n in ("doc_id", "stamp", "start", "stays")),
                pa.array(found, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))], ["doc_id", "stamp", "start", "stays", "wide"])

    kind = "array<struct<first: int, end: int>>"
    gone = per_key(rows.filter("NOT stays"), first, "root").mapInArrow(
        wide, f"doc_id long, stamp long, start int, stays boolean, wide {kind}")
    return gone.union(rows.filter("stays").select("doc_id", "stamp", "start", "stays", F.lit(None).cast(kind).alias("wide")))


def _gaps(row: np.ndarray, start: np.ndarray, stays: np.ndarray, kept: pa.StructArray) -> np.ndarray:
    """Words to compare before each paragraph, and behind the last one; paragraphs are in order of ``row`` and ``start``."""
    out = np.full(len(row) + 1, BESIDE, dtype=np.int64)
    if len(row) < 2:
        return out
    same = (row[1:] == row[:-1]) & ~stays[1:] & ~stays[:-1]
    doc_id = kept.field("doc_id")
    for values in (doc_id.fill_null(0), doc_id.is_null(), kept.field("stamp")):
        values = values.to_numpy(zero_copy_only=False)
        same &= values[1:] == values[:-1]
    apart = np.diff(start)
    same &= np.diff(kept.field("start").to_numpy()) == apart
    out[1:-1] = np.where(same, np.clip(apart - SPAN, 0, BESIDE), BESIDE)
    return out


def _numbers(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... in each run of ``counts``."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def agree(a: bytes, b: bytes) -> int:
    """Words of four bytes in which both agree from their beginning."""
    n = min(len(a), len(b)) // 4
    if a[:4 * n] == b[:4 * n]:
        return n
    return int((np.frombuffer(a, np.uint32, n) != np.frombuffer(b, np.uint32, n)).argmax())


def spans(cuts: list[int], stays: list[int], more: Iterable[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Maximal runs of words that go: covered by a cut paragraph and by none that stays, or in ``more``.

    Each word in ``more`` equals one that stands earlier, so of all its copies the first is in no such run.
    """
    if not cuts:
        return []
    more = list(more)
    mask = np.zeros(max([max(cuts) + SPAN, *(e for _, e in more)]) + 1, dtype=np.int8)
    for s in cuts:
        mask[s:s + SPAN] = 1
    for s in stays:
        mask[s:s + SPAN] = 0
    for s, e in more:
        mask[s:e] = 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _ranges(more: list[dict] | None) -> list[tuple[int, int]]:
    return [(m["first"], m["end"]) for m in more or []]


def removed(docs: DataFrame, percent: int = PERCENT, whole: bool = False) -> DataFrame:
    """doc_id, n_removed (words), spans (array of first and end word) for every row of ``docs``."""
    found = checkpointed(repeats(docs, percent, whole)).withColumnsRenamed({"doc_id": "__id", "stamp": "__stamp"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("stamp"))
    rows = rows.join(found, (F.col("stamp") == F.col("__stamp")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [spans(c or [], s or [], _ranges(m)) for c, s, m in zip(*(batch.column(n).to_pylist() for n in ("cuts", "stays", "more")))]
            flat = [[{"first": a, "end": b} for a, b in o] for o in own]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([sum(b - a for a, b in o) for o in own], pa.int64()),
                pa.array(flat, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))], ["doc_id", "n_removed", "spans"])

    return rows.select("doc_id", "cuts", "stays", "more").mapInArrow(
        run, "doc_id long, n_removed long, spans array<struct<first: long, end: long>>")


def cut_out(text: str, cuts: list[int], stays: list[int], more: Iterable[tuple[int, int]] = ()) -> str:
    """The text without the words of the runs that go, and without the white space after them."""
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data)]
    out, at = [], 0
    for first, end in spans(cuts, stays, more):
        out.append(data[at:places[first][0]])
        at = places[end][0] if end < len(places) else len(data)
    return (b"".join(out) + data[at:]).decode()


def without_repeats(docs: DataFrame, percent: int = PERCENT, whole: bool = False) -> DataFrame:
    """``docs`` with repeated paragraphs cut out of ``text``."""
    found = checkpointed(repeats(docs, percent, whole)).withColumnsRenamed(
        {"doc_id": "__id", "stamp": "__stamp", "cuts": "__cuts", "stays": "__stays", "more": "__more"})
    rows = docs.withColumn("__at", F.xxhash64("text")).join(
        found, (F.col("__at") == F.col("__stamp")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left")
    rows = rows.select(*docs.columns, "__cuts", "__stays", "__more")
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_out(t, c, s or [], _ranges(m)) if c else t
                     for t, c, s, m in zip(*(batch.column(n).to_pylist() for n in ("text", "__cuts", "__stays", "__more")))]
            cols = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in kept]
            yield pa.RecordBatch.from_arrays(cols, names=kept)

    return rows.mapInArrow(run, docs.schema)
