"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become their words (runs of ASCII letters and digits, with A-Z in lower case, and bytes above 0x7F) joined by one
space, with a space on either side; a pattern is a window of 13 benchmark words in the same form. All patterns are cut
to the length m of the shortest one for the search: a table maps each block of bytes that occurs in these heads to how
far the search may move on, any other block moves it by m less a block. Where the move is 0, a bucket keyed by the
block gives the patterns whose head ends there, and each is compared in full.

Defined cases: a null or wordless document has no words and no hits; a null, wordless or repeated item gives no new
patterns (items that share a window are all counted); items shorter than 13 words are one window; long documents are
searched whole. Benchmarks of any size work: patterns are dealt into groups of at most ``GROUP_PATTERNS`` and the
documents pass one searcher after the other; after ``PASSES`` of them their state is written and the groups are given back.
Windows of an item with a null id are searched as well; all such items count as one, which adds no id to the hash.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinpanel.llm.common import with_fields
from kinpanel.session import checkpointed

WIDTH = 13
#: bytes per shift-table block; long enough that blocks of other text are rarely among the patterns'
BLOCK = 12
#: patterns of one searcher
GROUP_PATTERNS = 100_000
#: groups that the rows pass before their state is written
PASSES = 4
#: heads shorter than this are searched apart, so that a one-word item does not shorten everybody's moves
SHORT_HEAD = 24

_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


def windows_of(text: bytes | None, width: int = WIDTH) -> set[bytes]:
    """Distinct windows of an item, each with a space on either side; one window for an item of fewer words."""
    words = words_of(text)
    if not words:
        return set()
    return {b" " + b" ".join(words[i:i + width]) + b" " for i in range(max(1, len(words) - width + 1))}


class Searcher:
    """Wu-Manber tables over patterns whose heads have a similar length."""

    def __init__(self, patterns: list[bytes]):
        self.head = min(map(len, patterns))
        self.block = max(1, min(BLOCK, self.head // 3))
        self.default = self.head - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[tuple[bytes, int]]] = {}
        for number, pattern in enumerate(patterns):
            for end in range(self.block, self.head + 1):
                block = pattern[end - self.block:end]
                move = self.head - end
                if move < self.shift.get(block, self.default):
                    self.shift[block] = move
            self.bucket.setdefault(pattern[self.head - self.block:self.head], []).append((pattern, number))

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence, in order of the start."""
        end, size, block, head = self.head, len(text), self.block, self.head
        shift, default, bucket = self.shift.get, self.default, self.bucket
        while end <= size:
            tail = text[end - block:end]
            move = shift(tail, default)
            if move:
                end += move
                continue
            begin = end - head
            for pattern, number in bucket[tail]:
                if text.startswith(pattern, begin):
                    yield begin, number
            end += 1


def _groups(benchmark: DataFrame, width: int) -> Iterator[list[tuple[bytes, list[str]]]]:
    """Bounded groups of (window, item ids), in the order of the window's hash group."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(w, i) for i, t in zip(ids, texts) for w in windows_of(t, width)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in rows], pa.binary()), pa.array([i for _, i in rows], pa.string())], ["window", "item"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    # read for the count and once for every group
    windows = checkpointed(items.mapInArrow(cut, "window binary, item string").distinct())
    parts = -(-windows.count() // GROUP_PATTERNS)
    for part in range(parts):
        own = windows.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
        found: dict[bytes, list[str]] = {}
        for row in own.collect():
            found.setdefault(bytes(row["window"]), []).append(row["item"])
        yield sorted(found.items())


def _hits(text: bytes, searchers: list) -> tuple[list[tuple[int, int]], set[str]]:
    """(spans of all occurrences, ids of their items); a span runs from a space before to a space after its words."""
    spans, ids = [], set()
    for searcher, own in searchers:
        for begin, number in searcher.find(text):
            window, items = own[number]
            spans.append((begin, begin + len(window) - 1))
            ids.update(items)
    return spans, ids


def _mask(text: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which words of a joined text lie in a span."""
    mask = np.zeros(text.count(b" ") - 1 if len(text) > 2 else 0, dtype=bool)
    if spans:
        blanks = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32).tolist()
        for begin, end in spans:
            mask[bisect_right(blanks, begin) - 1:bisect_right(blanks, end) - 1] = True
    return mask


def _pass(patterns, first: bool, last: bool, kept: list[str]):
    """One pass of the rows over one group of patterns. The first joins the words, the last counts what was hit.

    Between passes a row carries its joined words, the spans so far and the items so far.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = patterns.value if patterns is not None else []
        kinds = [[p for p in group if len(p[0]) < SHORT_HEAD], [p for p in group if len(p[0]) >= SHORT_HEAD]]
        searchers = [(Searcher([w for w, _ in own]), own) for own in kinds if own]
        for batch in batches:
            held = [batch.column(n) for n in kept]
            joined, spans, items, total, hit, masks = [], [], [], [], [], []
            old = zip(batch.column("__spans").to_pylist(), batch.column("items").to_pylist()) if not first else None
            for text in batch.column("__joined").to_pylist():
                text = b" " + b" ".join(words_of(text)) + b" " if first else text
                found, ids = _hits(text, searchers)
                if old is not None:
                    before, known = next(old)
                    found += np.frombuffer(before, dtype=np.int64).reshape(-1, 2).tolist()
                    ids.update(known)
                items.append(sorted(ids, key=lambda i: (i is None, i or "")))
                if last:
                    mask = _mask(text, found)
                    total.append(len(mask))
                    hit.append(int(mask.sum()))
                    masks.append(np.packbits(mask).tobytes() if hit[-1] else None)
                else:
                    joined.append(text)
                    spans.append(np.array(found, dtype=np.int64).tobytes())
            listed = pa.array(items, pa.list_(pa.string()))
            if last:
                new = [pa.array(total, pa.int64()), pa.array(hit, pa.int64()), listed, pa.array(masks, pa.binary())]
                yield pa.RecordBatch.from_arrays([*held, *new], names=[*kept, "n_words", "n_hit", "items", "hit_words"])
            else:
                yield pa.RecordBatch.from_arrays([*held, pa.array(joined, pa.binary()), pa.array(spans, pa.binary()), listed],
                                                 names=[*kept, "__joined", "__spans", "items"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The columns of ``docs`` (with text) and n_words, n_hit, items (sorted item ids), hit_words (mask of words).

    Columns of ``docs`` named like the new ones are replaced. There is no shuffle of the documents: every task searches
    its own rows for each bounded group of patterns.
    """
    sc = docs.sparkSession.sparkContext
    kept = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "hit_words", "__joined", "__spans")]
    plain = docs.select(*kept)
    now = docs.select(*kept, F.col("text").cast("binary").alias("__joined"))
    between = with_fields(plain, __joined="binary", __spans="binary", items="array<string>")
    done = with_fields(plain, n_words="long", n_hit="long", items="array<string>", hit_words="binary")
    waiting, first, used = None, True, []
    for group in _groups(benchmark, width):
        if waiting is not None:
            now, first = now.mapInArrow(_pass(waiting, first, False, kept), between), False
            used.append(waiting)
            if len(used) == PASSES:
                # the rows' state is written, so that no more than so many groups are held at a time
                now = checkpointed(now)
                for done_with in used:
                    done_with.destroy()
                used = []
        waiting = sc.broadcast(group)
    return now.mapInArrow(_pass(waiting, first, True, kept), done)


def verdicts(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per document."""
    found = decontaminate(docs.select("doc_id", "text"), benchmark, width)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least a twentieth of the words are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
