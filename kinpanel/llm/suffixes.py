"""Exact removal of repeated byte strings by external induced sorting.

Every byte that is covered by a ``LENGTH``-byte string which also starts anywhere else goes. A filter that loses nothing
comes first: each string of that length names the place of its smallest 32-byte hash (the rightmost, if equal) as its
anchor, so equal strings have equal anchors at equal offsets, and only anchors that stand in two places go on. Where all that an
anchor's strings cover stands twice, they are all repeated, and one such place goes on for the others' sake. Strings of
an anchor are taken in ranges of ``RANGE`` offsets; all strings of a range share a core, and places whose core is alone
end there. Places with the same core become a short string of symbols, the bytes before it, one symbol for the core and
the bytes after it; ``induced`` sorts the suffixes of many such strings with disk-backed queues, and a string is repeated
if its suffix has a common prefix of the full length with a neighbour in that order.

A core that more than ``CROWD`` places share (a passage in a third of all documents) is not brought together: each of
its strings is counted by its digest instead, with partial counts in every task.

Defined cases: null is empty; texts shorter than the length keep everything. Rows with equal texts, whatever their ids,
repeat each other. Very long texts are read whole; an empty table gives no rows. Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kinpanel.llm.common import CHUNK_BYTES, mixed, text_bytes
from kinpanel.llm.induced import sorted_suffixes
from kinpanel.session import checkpointed

LENGTH = 400
GRAM = 32
RANGE = 46
#: offsets that are sorted together, after a second look at what they share
STEP = 7
CROWD = 10_000
#: symbols that one sort takes
SHARD = 400_000


def _places(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, anchor place, lowest and highest offset of its strings, anchor hash) for joined documents."""
    n, width = len(data), length - GRAM + 1
    if n < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    hashes, size = data.astype(np.uint64) + np.uint64(1), 1
    factor = np.array([0x9E3779B97F4A7C15], dtype=np.uint64)
    while size < GRAM:
        hashes = hashes[:-size] * factor + hashes[size:]
        factor, size = factor * factor, size * 2
    hashes = mixed(hashes)
    low, at, size = hashes, np.arange(len(hashes)), 1
    while size < width:
        move = min(size, width - size)
        left, right = low[:len(low) - move], low[move:]
        take = right <= left
        low, at = np.where(take, right, left), np.where(take, at[move:], at[:len(at) - move])
        size += move
    # strings that lie in one document
    doc = np.searchsorted(starts, np.arange(len(low)), side="right") - 1
    inside = np.flatnonzero(np.arange(len(low)) + length <= starts[doc + 1])
    if not len(inside):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    doc, anchor = doc[inside], at[inside]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    end = np.append(new[1:], len(inside)) - 1
    place = anchor[new]
    return doc[new], place - starts[doc[new]], place - inside[end], place - inside[new], hashes[place].view(np.int64)


_ANCHOR = "key long, context long, stamp binary, pos int, lo int, hi int, runs binary"


def anchors(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, context, stamp, pos, lo, hi, runs for the anchors of ``texts`` (text, stamp).

    An anchor at ``pos`` is that of the strings that start ``lo`` to ``hi`` bytes before it; ``context`` is a hash of all
    bytes they cover, and of lo and hi. Equal contexts of a text are one row, with the runs that they all cover.
    """
    names = [part.split()[0] for part in _ANCHOR.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, first = [], 0, 0
            values, stamps = batch.column("text").to_pylist(), batch.column("stamp").to_pylist()
            for k, text in enumerate(values):
                held.append(text or b"")
                size += len(held[-1])
                if size >= CHUNK_BYTES // 2 or k == len(values) - 1:
                    starts = np.concatenate([[0], np.cumsum([len(t) for t in held])])
                    doc, pos, lo, hi, key = _places(np.frombuffer(b"".join(held), dtype=np.uint8), starts, length)
                    found: dict[tuple[int, int, int], list] = {}
                    for d, p, low, high, name in zip(doc.tolist(), pos.tolist(), lo.tolist(), hi.tolist(), key.tolist()):
                        context = xxhash.xxh64_intdigest(held[d][p - high:p - low + length], low * 512 + high) - 2**63
                        found.setdefault((d, name, context), [p, low, high]).append((p - high, p - low + length))
                    if found:
                        rows = [(name, context, stamps[first + d], p, low, high,
                                 np.array(merged(sorted(own)), dtype=np.int32).tobytes() if len(own) > 1 else None)
                                for (d, name, context), (p, low, high, *own) in found.items()]
                        types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    held, size, first = [], 0, k + 1

    return texts.select("text", "stamp").mapInArrow(run, _ANCHOR)


def pieces(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """core, stamp, pos, base, wide, lo, hi, ahead, behind for ``texts`` (stamp, text, own: list of anchors).

    A piece stands for the strings that start ``lo`` to ``hi`` bytes before ``pos``. Those of the range ``base`` to
    ``base + wide`` share the bytes from ``base`` before ``pos`` on: the core. ``ahead`` and ``behind`` are what stands
    before and after it, up to what the range can reach or the text has.
    """
    schema = "core binary, stamp binary, pos int, base int, wide int, lo int, hi int, ahead binary, behind binary"
    names = [part.split()[0] for part in schema.split(", ")]
    types = [pa.binary(), pa.binary(), *[pa.int32()] * 5, pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for stamp, text, own in zip(*(batch.column(n).to_pylist() for n in ("stamp", "text", "own"))):
                for anchor in own:
                    pos, lowest, highest = anchor["pos"], anchor["lo"], anchor["hi"]
                    for base in range(lowest - lowest % RANGE, highest + 1, RANGE):
                        last = min(base + RANGE - 1, length - GRAM)
                        core = text[pos - base:pos + length - last]
                        rows.append((xxhash.xxh128_digest(core + bytes([base // RANGE])), stamp, pos, base, last - base,
                                     max(lowest, base), min(highest, last), text[max(0, pos - last):pos - base],
                                     text[pos + length - last:pos + length - base]))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return texts.mapInArrow(run, schema)


class _Shard:
    """Strings of symbols to sort together, and which rows each stands for."""

    def __init__(self):
        self.items: list[tuple[int, bytes, bytes, int, list]] = []
        self.cores, self.symbols = 0, 0

    def add(self, group: dict[tuple[bytes, bytes], list], need: int) -> None:
        for (ahead, behind), members in group.items():
            self.items.append((self.cores, ahead, behind, need, members))
            self.symbols += len(ahead) + len(behind) + 2
        self.cores += 1

    def repeated(self) -> Iterator[tuple[list, int, int]]:
        """(members, offset from the core, ...) of every start whose string another item has."""
        n = len(self.items)
        values: list[int] = []
        begin = []
        for k, (core, ahead, behind, _, _) in enumerate(self.items):
            begin.append(len(values))
            values += [n + b for b in ahead]
            values.append(n + 256 + core)
            values += [n + b for b in behind]
            values.append(n - 1 - k)
        order, prefix = sorted_suffixes(values, STEP + 1)
        best = [0] * len(values)
        for rank, place in enumerate(order):
            after = prefix[rank + 1] if rank + 1 < len(order) else 0
            best[place] = max(prefix[rank], after)
        for at, (_, ahead, _, need, members) in zip(begin, self.items):
            for i in range(len(ahead) + 1):
                if best[at + i] >= need:
                    yield members, len(ahead) - i, need


def _narrowed(rows: list[tuple], shard: _Shard, done: list[tuple]) -> None:
    """Deal the pieces of one core by steps of offsets; pieces that are equal need no sort, those alone end here.

    A row is (stamp, pos, base, wide, lo, hi, ahead, behind); ``done`` gets (stamp, pos, offset, offset).
    """
    groups: dict[tuple[int, bytes, bytes], dict[tuple[bytes, bytes], list]] = {}
    for stamp, pos, base, wide, lo, hi, ahead, behind in rows:
        for a in range(0, wide + 1, STEP):
            b = min(a + STEP - 1, wide)
            if base + b < lo or base + a > hi or len(ahead) < a or len(behind) < wide - b:
                continue
            cut = len(ahead) - a
            shared = (a, ahead[cut:], behind[:wide - b])
            own = (ahead[max(0, len(ahead) - b):cut], behind[wide - b:wide - a])
            groups.setdefault(shared, {}).setdefault(own, []).append((stamp, pos, base + a, max(lo, base + a), min(hi, base + b)))
    for (a, _, _), group in groups.items():
        if sum(map(len, group.values())) < 2:
            continue
        need = min(STEP - 1, rows[0][3] - a) + 1
        for members in group.values():
            if len(members) > 1:
                done += [(stamp, pos, lo, hi) for stamp, pos, _, lo, hi in members]
        if len(group) > 1:
            shard.add(group, need)


def sorted_repeats(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """stamp, first, end: runs of bytes covered by repeated strings, from the pieces of cores that are not crowded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, done, held, core = _Shard(), [], [], None

        def out() -> pa.RecordBatch:
            nonlocal shard, done
            for members, offset, _ in shard.repeated() if shard.items else ():
                done += [(stamp, pos, base + offset, base + offset) for stamp, pos, base, lo, hi in members if lo <= base + offset <= hi]
            batch = pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] - d[3] for d in done], pa.int32()),
                 pa.array([d[1] - d[2] + length for d in done], pa.int32())], ["stamp", "first", "end"])
            shard, done = _Shard(), []
            return batch

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("core", "stamp", "pos", "base", "wide", "lo", "hi", "ahead", "behind")]
            for name, *row in zip(*columns):
                if name != core:
                    if len(held) > 1:
                        _narrowed(held, shard, done)
                    held, core = [], name
                    if shard.symbols > SHARD or len(done) > 50_000:
                        yield out()
                held.append(tuple(row))
        if len(held) > 1:
            _narrowed(held, shard, done)
        yield out()

    return rows.repartition("core").sortWithinPartitions("core").mapInArrow(run, "stamp binary, first int, end int")


def counted_repeats(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same for crowded cores: every string is counted by its digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for core, stamp, pos, base, wide, lo, hi, ahead, behind in zip(*(batch.column(n).to_pylist() for n in batch.schema.names)):
                for offset in range(lo, hi + 1):
                    reach = offset - base
                    whole = core + bytes([reach]) + ahead[len(ahead) - reach:] + b"\0" + behind[:wide - reach]
                    found.append((xxhash.xxh128_digest(whole), stamp, pos - offset))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int32()))], ["digest", "stamp", "first"])

    strings = rows.select("core", "stamp", "pos", "base", "wide", "lo", "hi", "ahead", "behind").mapInArrow(
        run, "digest binary, stamp binary, first int")
    strings = checkpointed(strings)
    often = strings.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    return strings.join(often, "digest").select("stamp", "first", (F.col("first") + length).alias("end"))


def _covered(length: int):
    """Runs of bytes that the strings of repeated contexts cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stamp, pos, lo, hi, runs in zip(*(batch.column(n).to_pylist() for n in ("stamp", "pos", "lo", "hi", "runs"))):
                own = np.frombuffer(runs, dtype=np.int32).reshape(-1, 2).tolist() if runs else [(pos - hi, pos - lo + length)]
                out += [(stamp, a, b) for a, b in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.int32()))], ["stamp", "first", "end"])

    return run


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """stamp (of a text), runs (array of first, end) for every distinct text of ``docs`` that loses something."""
    texts = docs.select(text_bytes().alias("text")).filter(F.octet_length("text") >= length).withColumn("stamp", _stamp())
    # rows with equal texts give equal anchors
    found = checkpointed(anchors(texts, length).distinct())
    place = F.struct("stamp", "pos", "lo", "hi")
    contexts = checkpointed(found.groupBy("key", "context").agg(
        F.count("*").alias("n"), F.max(F.col("runs").isNotNull()).alias("inside"), F.min(place).alias("place")))
    known = contexts.filter("n > 1 OR inside").select("key", "context")
    whole = found.join(known, ["key", "context"]).mapInArrow(_covered(length), "stamp binary, first int, end int")
    # anchors with several contexts: one place of each is looked at in pieces
    mixed_keys = contexts.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    lists = contexts.join(mixed_keys, "key").select("place.*").groupBy("stamp").agg(F.collect_list(F.struct("pos", "lo", "hi")).alias("own"))
    lists = checkpointed(lists)
    met = texts.join(lists, "stamp").groupBy("stamp").agg(F.first("text").alias("text"), F.first("own").alias("own"))
    parts = checkpointed(pieces(met, length))
    sizes = parts.groupBy("core").agg(F.count("*").alias("n"))
    crowded = checkpointed(sizes.filter(F.col("n") > CROWD).select("core"))
    plain = parts.join(crowded, "core", "left_anti")
    runs = sorted_repeats(plain, length).union(counted_repeats(parts.join(crowded, "core", "left_semi"), length)).union(whole)
    # whole texts that stand twice repeat all their strings
    again = texts.groupBy("stamp").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).filter("n > 1")
    runs = runs.union(again.select("stamp", F.lit(0).alias("first"), F.col("size").cast("int").alias("end")))
    return runs.groupBy("stamp").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("runs"))


def _stamp():
    return F.unhex(F.md5("text"))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted ones; runs that touch are one."""
    out: list[list[int]] = []
    for first, end in runs:
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [tuple(r) for r in out]


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    found = checkpointed(repeated_runs(docs, length))
    texts = docs.select(text_bytes().alias("text")).filter(F.octet_length("text") >= length).withColumn("stamp", _stamp())
    met = texts.join(found, "stamp").groupBy("stamp").agg(F.first("text").alias("text"), F.first("runs").alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost, spans, digests = [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                own = merged([(r["first"], r["end"]) for r in runs])
                lost.append(sum(e - f for f, e in own))
                spans.append(len(own))
                edges = [0, *[x for pair in own for x in pair], len(text)]
                digests.append(hashlib.sha256(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("stamp"), pa.array(lost, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                ["stamp", "n_removed", "n_spans", "sha"])

    cut = checkpointed(met.mapInArrow(run, "stamp binary, n_removed long, n_spans long, sha string"))
    rows = docs.select(F.col("doc_id"), F.coalesce(text_bytes(), F.lit(b"")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"), _stamp().alias("stamp"))
    return rows.join(cut, "stamp", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("sha", "own").alias("kept_sha256"))
