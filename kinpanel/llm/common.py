"""Helpers shared by the pipeline operators: reading, grouping in tasks, hashing words, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kinpanel.session import checkpointed

#: bytes of text that a task turns into word lists at once
CHUNK_BYTES = 4 << 20
#: long words that a task remembers the hash of
MEMO_WORDS = 400_000
#: bytes from which a word is long; xxh64 takes shorter ones 8, 4 and 1 bytes at a time
LONG_WORD = 32
#: edges of connected components that are written as one file
EDGES = 200_000
#: a key with more than this part of all rows (one in HOT) is joined by broadcast; there are fewer than HOT of them
HOT = 1000
MULTIPLIERS = np.random.RandomState(7).randint(1, 2**62, size=1024, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """Remembered 64-bit hashes of words (bytes)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_arrays(texts: Iterable[bytes | None], memo: WordHashes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes of all words, word count per row) for runs of rows of bounded text size.

    Words are runs of bytes other than ASCII white space, with A-Z in lower case. A null text has no words.
    """
    first, size, held = 0, 0, []
    for at, text in enumerate(texts):
        held.append(text or b"")
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield first, at + 1, *_hashes(held, memo)
            first, size, held = at + 1, 0, []
    if held:
        yield first, first + len(held), *_hashes(held, memo)


def _hashes(texts: list[bytes], memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, each different one hashed once, and word count per text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).view(pa.large_string())))
    # white space at either end of a text makes an empty word
    words = lists.flatten().dictionary_encode()
    different = words.dictionary.cast(pa.large_binary())
    number = words.indices.to_numpy()
    real = (pc.binary_length(different).to_numpy() > 0)[number]
    before = np.concatenate([[0], np.cumsum(real)])
    offsets = lists.offsets.to_numpy()
    return hashed(different, memo)[number[real]], before[offsets[1:]] - before[offsets[:-1]]


def hashed(words: pa.LargeBinaryArray, memo: WordHashes) -> np.ndarray:
    """The xxh64 of each word; all but long ones are hashed together."""
    one, two, three, four, five = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, bits: int) -> np.ndarray:
        return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))

    steps = {8: lambda h, v: turned(h ^ (turned(v * two, 31) * one), 27) * one + four,
             4: lambda h, v: turned(h ^ (v * one), 23) * two + three,
             1: lambda h, v: turned(h ^ (v * five), 11) * one}
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    at, left = ends[:-1].copy(), np.diff(ends)
    long = np.flatnonzero(left >= LONG_WORD)
    out = five + left.astype(np.uint64)
    left[long] = 0
    for width, step in steps.items():
        every = np.ndarray(max(0, len(data) - width + 1), f"<u{width}", data, strides=(1,))
        while len(own := np.flatnonzero(left >= width)):
            out[own] = step(out[own], every[at[own]].astype(np.uint64))
            at[own] += width
            left[own] -= width
    out = (out ^ (out >> np.uint64(33))) * two
    out = (out ^ (out >> np.uint64(29))) * three
    out ^= out >> np.uint64(32)
    for i in long.tolist():
        out[i] = memo[words[i].as_py()]
    return out


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = values ^ (values >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; one value fewer than words for each further word."""
    if len(words) < width:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0x100000001B3) + words[k: len(words) - width + 1 + k]
    return mixed(out)


def document_sets(words: np.ndarray, counts: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per document; shorter documents have their whole sequence as one shingle."""
    starts = np.concatenate([[0], np.cumsum(counts)])
    all_hashes = shingle_hashes(words, width)
    out = []
    for k, n in enumerate(counts):
        if n >= width:
            out.append(np.unique(all_hashes[starts[k]: starts[k] + n - width + 1]))
        elif n:
            out.append(shingle_hashes(words[starts[k]: starts[k] + n], int(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def map_groups(df: DataFrame, keys: list[str], make: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str,
               partitions: int | None = None) -> DataFrame:
    """``make`` for the rows of each key, with all small groups of a partition handled by one Python call chain.

    Groups must be of bounded size. Rows are dealt out by the keys and sorted by them, so a group is a run of rows.
    """
    names = list(df.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None
        for batch in batches:
            if not len(batch):
                continue
            now = batch[keys]
            changed = (now.iloc[1:].reset_index(drop=True) != now.iloc[:-1].reset_index(drop=True)).any(axis=1)
            cuts = [0, *(np.flatnonzero(changed) + 1), len(batch)]
            for begin, end in zip(cuts, cuts[1:]):
                own = tuple(now.iloc[begin])
                if held and own != key:
                    yield from _done(held, make)
                    held = []
                held.append(batch.iloc[begin:end])
                key = own
        if held:
            yield from _done(held, make)

    dealt = df.repartition(*([partitions] if partitions else []), *[F.col(k) for k in keys])
    return dealt.sortWithinPartitions(*keys).select(*names).mapInPandas(run, schema)


def map_runs(df: DataFrame, keys: int, make: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``make`` for the rows of each group of at least two; the first ``keys`` columns name it. Groups are bounded.

    Rows reach it as tuples, which costs less than a data frame for many small groups.
    """
    fields = [part.split() for part in schema.split(", ")]
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    names, types = [f[0] for f in fields], [kinds[f[1]] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        key = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:keys] != key:
                    if len(held) > 1:
                        out += make(held)
                    held, key = [], row[:keys]
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        out = make(held) if len(held) > 1 else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    by = df.columns[:keys]
    return df.repartition(*[F.col(k) for k in by]).sortWithinPartitions(*by).mapInArrow(run, schema)


def _done(held: list[pd.DataFrame], make: Callable) -> Iterator[pd.DataFrame]:
    out = make(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True))
    if out is not None and len(out):
        yield out


def union_find(n: int, left: Iterable[int], right: Iterable[int]) -> np.ndarray:
    """Smallest index of each item's group, for groups of bounded size."""
    parent = list(range(n))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in zip(left, right, strict=True):
        a, b = top(int(a)), top(int(b))
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([top(i) for i in range(n)], dtype=np.int64)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (same type, no nulls); the root is the smallest node.

    Alternating large and small stars: every round a node's larger (then smaller) neighbours are linked to its smallest
    one, by an aggregate and a join, until nothing changes. No group is collected; a hub's rows only meet its minimum.
    """
    now = checkpointed(edges.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
    before, size = None, now.count()
    for _ in range(rounds):
        both = now.union(now.selectExpr("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours of a node, and the node itself, go to the smallest neighbour
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        # files in proportion to the edges, however many partitions the shuffle has
        now = checkpointed(small.filter("a <> b").distinct().coalesce(1 + size // EDGES))
        # a star forest is reached when nothing that has a parent is a parent
        state = now.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")).first()
        if state == before:
            break
        before, size = state, state["n"]
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))


def per_key(rows: DataFrame, known: DataFrame, key: str, count: str = "n") -> DataFrame:
    """``rows`` (a written table) joined with ``known``, which has a row per ``key`` and in ``count`` at least its number of rows.

    Fewer than ``HOT`` keys can have more than that part of all rows; these are broadcast, and their rows stay where they are.
    """
    known = checkpointed(known)
    total = known.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(known.filter(F.col(count) * HOT > total))
    rest = rows.join(hot.select(key), key, "left_anti").join(known.filter(F.col(count) * HOT <= total), key)
    return rest.unionByName(rows.join(hot, key))


def with_fields(df: DataFrame, **types: str) -> T.StructType:
    """The schema of ``df`` with further columns behind, whatever its own are called."""
    more = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in types.items()))
    return T.StructType([*df.schema.fields, *more.fields])


def text_bytes(name: str = "text") -> Column:
    return F.col(name).cast("binary")
