"""Approximate nearest neighbours over learned partitions of a neighbour graph.

A bounded sample of the distinct vectors gets an exact neighbour graph, which recursive bisection cuts into parts of
equal size with few cut edges. A small network learns to which part a vector and its neighbours belong. It sends every
vector of the table to its likeliest part and every query to its several likeliest parts, where all rows are compared
exactly. How many parts a query visits is the smallest number that finds ``TARGET`` of the true neighbours of the
sample. Parts are cut into blocks of ``BLOCK`` vectors, so a part that holds most rows is spread over tasks.

Equal vectors are one entry with their smallest ids: a query returns ``k`` rows and leaves out itself, so the ``k + 1``
smallest ids of an entry give every result. Nothing is dropped.

Defined cases: vectors that are null, zero, of another length than most, or hold nulls or non-finite numbers take no
part, nor do rows without an id. Rows with the same id and vector are one; a row with the query's id is the query's
own. With fewer than ``k`` others all are returned. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from kinpanel.session import checkpointed

SAMPLE = 8192
#: vectors per part that the number of parts aims at, and sample vectors that a part needs to be learned
PART, LEARN = 2000, 32
BLOCK = 4096
NEIGHBOURS = 10
TARGET = 0.97
HIDDEN = 128


def neighbours(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """Exact nearest other rows of each row."""
    norms = (x * x).sum(1)
    out = np.empty((len(x), k), dtype=np.int64)
    for begin in range(0, len(x), block):
        d = norms[None] - 2 * x[begin:begin + block] @ x.T
        d[np.arange(len(d)), begin + np.arange(len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[begin:begin + block] = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1), 1)
    return out


def bisect(n: int, left: np.ndarray, right: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Side (0 or 1) of each of n vertices: equal halves along the second eigenvector, then swaps that cut fewer edges."""
    degree = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
    scale = 1 / np.sqrt(np.maximum(degree, 1))
    top = np.sqrt(np.maximum(degree, 1e-9))
    top /= np.linalg.norm(top)
    v = np.random.default_rng(n).normal(size=n)
    for _ in range(rounds):
        v -= top * (top @ v)
        w = v * scale
        moved = np.bincount(left, w[right], n) + np.bincount(right, w[left], n)
        v = 0.5 * (v + moved * scale)
        v /= max(np.linalg.norm(v), 1e-12)
    side = np.zeros(n, dtype=np.int64)
    side[np.argsort(v * scale, kind="stable")[n // 2:]] = 1
    for _ in range(20):
        cut = np.where(side[left] != side[right], 1.0, -1.0)
        gain = np.bincount(left, cut, n) + np.bincount(right, cut, n)
        zero, one = (np.flatnonzero(side == s)[np.argsort(-gain[side == s], kind="stable")] for s in (0, 1))
        some = max(1, n // 200)
        pairs = [(a, b) for a, b in zip(zero[:some], one[:some]) if gain[a] + gain[b] > 0]
        if not pairs:
            break
        old = (side[left] != side[right]).sum()
        a, b = map(list, zip(*pairs))
        side[a], side[b] = 1, 0
        if (side[left] != side[right]).sum() >= old:
            side[a], side[b] = 0, 1
            break
    return side


def balanced_parts(near: np.ndarray, depth: int) -> np.ndarray:
    """Part of each vertex of the neighbour graph; ``2 ** depth`` parts of equal size."""
    n = len(near)
    part = np.zeros(n, dtype=np.int64)
    left, right = np.repeat(np.arange(n), near.shape[1]), near.reshape(-1)
    place = np.zeros(n, dtype=np.int64)
    for _ in range(depth):
        new = part * 2
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            place[own] = np.arange(len(own))
            inside = (part[left] == p) & (part[right] == p)
            new[own] += bisect(len(own), place[left[inside]], place[right[inside]])
        part = new
    return part


class Router:
    """One hidden layer over the vectors, softmax over the parts."""

    def __init__(self, dims: int, parts: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.a, self.b = rng.normal(0, np.sqrt(2 / dims), (dims, HIDDEN)), np.zeros(HIDDEN)
        self.c, self.d = rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)
        self.mean, self.spread, self.visits = np.zeros(dims), 1.0, 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.spread @ self.a + self.b, 0) @ self.c + self.d

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 3e-3) -> Router:
        """Adam on cross-entropy with soft targets."""
        self.mean, self.spread = x.mean(0), float(x.std()) or 1.0
        x = (x - self.mean) / self.spread
        params = [self.a, self.b, self.c, self.d]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        rng, step = np.random.default_rng(9), 0
        for _ in range(epochs):
            for own in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                step += 1
                h = np.maximum(x[own] @ self.a + self.b, 0)
                z = h @ self.c + self.d
                p = np.exp(z - z.max(1, keepdims=True))
                dz = (p / p.sum(1, keepdims=True) - target[own]) / len(own)
                dh = dz @ self.c.T * (h > 0)
                for q, g, m, v in zip(params, (x[own].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0)), first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def learn(x: np.ndarray, total: int) -> Router:
    """Router for ``total`` distinct vectors, from the sample ``x``."""
    depth = 0
    while 2**(depth + 1) <= min(total / PART, len(x) / LEARN):
        depth += 1
    parts = 2**depth
    router = Router(x.shape[1], parts)
    if depth == 0:
        return router
    # an eighth of the sample is held out of the fit, to measure visits on vectors that the router has not seen
    asked, x = x[::8], np.delete(x, np.s_[::8], axis=0)
    near = neighbours(x, NEIGHBOURS)
    part = balanced_parts(near, depth)
    target = 0.5 * np.eye(parts)[part] + 0.5 * np.eye(parts)[part[near]].mean(1)
    router.fit(x, target)
    own = router.logits(x).argmax(1)
    norms, order, needed = (x * x).sum(1), np.argsort(-router.logits(asked), axis=1, kind="stable"), []
    for k, q in enumerate(asked):
        exact = np.argpartition(norms - 2 * x @ q, NEIGHBOURS - 1)[:NEIGHBOURS]
        place = np.empty(parts, dtype=np.int64)
        place[order[k]] = np.arange(parts)
        needed.append(place[own[exact]])
    found = np.bincount(np.concatenate(needed), minlength=parts).cumsum() / (len(asked) * NEIGHBOURS)
    router.visits = int(np.argmax(found >= TARGET)) + 1
    return router


def _usable(rows: DataFrame, vector: str) -> DataFrame:
    """id, vec (array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = rows.select(F.col("id"), v.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull())
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(sound & F.exists("vec", lambda x: x != 0))


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """key, vec (bytes of doubles), ids (the ``keep`` smallest, in order) per distinct vector."""
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[bytes, list[int]]] = {}

        def flush() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_arrays([
                pa.array(keys, pa.binary()), pa.array([held[k][0] for k in keys], pa.binary()),
                pa.array([held[k][1] for k in keys], pa.list_(pa.int64()))], ["key", "vec", "ids"])

        for batch in batches:
            lists = batch.column("vec")
            data, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for k, i in enumerate(batch.column("id").to_pylist()):
                raw = (data[cuts[k]:cuts[k + 1]] + 0.0).tobytes()
                key = xxhash.xxh128_digest(raw)
                own = held.setdefault(key, (raw, []))[1]
                if i not in own:
                    own.append(i)
                    own.sort()
                    del own[keep:]
            if len(held) > 20_000:
                yield flush()
                held.clear()
        if held:
            yield flush()

    parts = rows.mapInArrow(combine, "key binary, vec binary, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return parts.groupBy("key").agg(F.first("vec").alias("vec"), ids.alias("ids"))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """query_id, rank, <id_>, score: the ``k`` nearest found of ``rows`` for each row of ``queries`` (same columns)."""
    own, asked = (_usable(df.withColumn("id", F.col(id_).cast("long")), vector) for df in (rows, queries))
    lengths = own.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = lengths["n"] if lengths else 0
    own, asked = own.filter(F.size("vec") == dims), asked.filter(F.size("vec") == dims)
    all_entries = checkpointed(entries(own, k + 1))
    total = all_entries.count()
    share = min(1.0, 1.2 * SAMPLE / max(1, total))
    sample = all_entries.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec", "key")
    # about a fifth more than SAMPLE, of which the first by key are taken
    drawn = [np.frombuffer(r["vec"]) for r in sorted(sample.collect(), key=lambda r: bytes(r["key"]))[:SAMPLE]]
    router = learn(np.array(drawn), total) if drawn else Router(1, 1)
    routed = checkpointed(_routed(all_entries, router, 1))
    sizes = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    blocks = F.element_at(F.create_map(*[F.lit(x) for p in range(len(router.d)) for x in (p, -(-sizes.get(p, 0) // BLOCK))]), F.col("part"))
    spread = routed.select("part", F.pmod(F.xxhash64("key"), blocks).cast("int").alias("block"), F.lit(0).alias("kind"), "key", "vec", "ids")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vec")
            data, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            raw = [(data[a:b] + 0.0).tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(xxhash.xxh128_digest, raw), pa.binary()), pa.array(raw, pa.binary())],
                                             ["id", "key", "vec"])

    named = checkpointed(asked.mapInArrow(name, "id long, key binary, vec binary"))
    distinct = named.groupBy("key").agg(F.first("vec").alias("vec")).withColumn("ids", F.lit(None).cast("array<long>"))
    wide = _routed(distinct, router, router.visits, np.array([sizes.get(p, 0) for p in range(len(router.d))]), k + 1).withColumn("n", blocks).filter("n > 0")
    wide = wide.select("part", F.explode(F.expr("sequence(0, cast(n - 1 as int))")).alias("block"), F.lit(1).alias("kind"), "key", "vec", "ids")
    dealt = spread.union(wide).repartition("part", "block").sortWithinPartitions("part", "block", "kind")
    hits = dealt.mapInArrow(_searcher(k + 1), "key binary, id long, score double")
    best = Window.partitionBy("key").orderBy("score", "id")
    hits = hits.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    hits = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("hits"))
    out = named.select(F.col("id").alias("query_id"), "key").distinct().join(hits, "key")
    out = out.withColumn("hits", F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k))
    out = out.select("query_id", F.posexplode("hits").alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias(id_), F.col("hit.score").alias("score"))


def _routed(df: DataFrame, router: Router, visits: int, sizes: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """``df`` (key, vec, ids) with the part; a row for each of the likeliest ``visits`` parts.

    With the sizes of all parts, a row goes on to further parts until those it goes to hold ``least`` vectors.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("vec").to_pylist())).reshape(batch.num_rows, -1)
            order = np.argsort(-router.logits(x), axis=1, kind="stable")
            number = np.full(len(x), visits)
            if sizes is not None:
                held = sizes[order].cumsum(1)
                number = np.maximum(number, np.minimum((held < least).sum(1) + 1, order.shape[1]))
            again = batch.take(pa.array(np.repeat(np.arange(len(x)), number)))
            parts = order[np.arange(order.shape[1])[None] < number[:, None]]
            yield pa.RecordBatch.from_arrays([*again.columns, pa.array(parts.astype(np.int32))], names=[*again.schema.names, "part"])

    return df.select("key", "vec", "ids").mapInArrow(run, "key binary, vec binary, ids array<long>, part int")


def _searcher(keep: int):
    """Rows come by block, its vectors before the queries sent to it; queries are read in runs, never all at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, vecs, ids, x, norms = None, [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(n).to_numpy() for n in ("part", "block", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1), len(place)]
            for begin, end in zip(cuts, cuts[1:]):
                if at != tuple(place[begin, :2]):
                    at, vecs, ids, x = tuple(place[begin, :2]), [], [], None
                some = batch.slice(begin, end - begin)
                if place[begin, 2] == 0:
                    vecs += some.column("vec").to_pylist()
                    ids += some.column("ids").to_pylist()
                    continue
                if not vecs:
                    continue
                if x is None:
                    x = np.frombuffer(b"".join(vecs)).reshape(len(vecs), -1)
                    norms = (x * x).sum(1)
                for low in range(0, some.num_rows, 512):
                    yield compare(some.slice(low, 512), x, norms, ids)

    def compare(asked: pa.RecordBatch, x: np.ndarray, norms: np.ndarray, ids: list[list[int]]) -> pa.RecordBatch:
        q = np.frombuffer(b"".join(asked.column("vec").to_pylist())).reshape(asked.num_rows, -1)
        d = norms[None] - 2 * q @ x.T + (q * q).sum(1)[:, None]
        last = min(keep, len(x)) - 1
        bound = np.partition(d, last, axis=1)[:, last]
        slack = 1e-9 * (norms.max() + (q * q).sum(1))
        rows = []
        for k, key in enumerate(asked.column("key").to_pylist()):
            near = np.flatnonzero(d[k] <= bound[k] + slack[k])
            exact = np.sqrt(((q[k] - x[near]) ** 2).sum(1))
            found = sorted((float(s), i) for s, j in zip(exact, near) for i in ids[j])[:keep]
            rows += [(key, i, s) for s, i in found]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.float64()))], ["key", "id", "score"])

    return run
