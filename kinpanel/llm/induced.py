"""External induced sorting: suffix order and common prefixes of a string whose working tuples live on disk.

Suffixes are classed as smaller (S) or larger (L) than their successor. The leftmost S suffixes are named by the pieces
between them and sorted by recursion on the string of names. From their order, a priority queue of tuples (symbol,
arrival, place, common prefix) induces first the L suffixes, then, from the largest down, the S suffixes. A tuple carries
the common prefix with the one before it under its symbol: one more than the smallest common prefix among the suffixes
passed since. The queue keeps ``HELD`` tuples in memory and sorted runs of the others in a file; the string itself is
mapped from a file.
"""

from __future__ import annotations

import heapq
import marshal
import mmap
import tempfile
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence

HELD = 200_000
BLOCK = 4096


class DiskQueue:
    """Priority queue of tuples of numbers; sorted runs go to one unnamed file that ends with the queue."""

    def __init__(self, held: int = HELD):
        self.heap: list[tuple] = []
        self.heads: list[tuple[tuple, int]] = []
        self.runs: list[Iterator[tuple]] = []
        self.held = held
        self.file = None

    def push(self, item: tuple) -> None:
        if len(self.heap) >= self.held:
            self._spill()
        heapq.heappush(self.heap, item)

    def _spill(self) -> None:
        """Keep the smaller half; write the rest in blocks that are read back as they are reached."""
        self.file = self.file or tempfile.TemporaryFile()
        self.heap.sort()
        half = self.held // 2
        rest, self.heap = self.heap[half:], self.heap[:half]
        places = []
        for begin in range(0, len(rest), BLOCK):
            self.file.seek(0, 2)
            data = marshal.dumps(rest[begin:begin + BLOCK])
            places.append((self.file.tell(), len(data)))
            self.file.write(data)
        run = self._read(places)
        self.runs.append(run)
        heapq.heappush(self.heads, (next(run), len(self.runs) - 1))

    def _read(self, places: list[tuple[int, int]]) -> Iterator[tuple]:
        for at, size in places:
            self.file.seek(at)
            yield from marshal.loads(self.file.read(size))

    def least(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, run = self.heads[0]
            following = next(self.runs[run], None)
            if following is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (following, run))
            return item
        return heapq.heappop(self.heap)

    def close(self) -> None:
        if self.file:
            self.file.close()


class _Passed:
    """Smallest common prefix among the suffixes passed since a given one; steps are few, as prefixes are capped."""

    def __init__(self):
        self.at: list[int] = []
        self.low: list[int] = []

    def add(self, step: int, prefix: int) -> None:
        while self.low and self.low[-1] >= prefix:
            self.low.pop()
            self.at.pop()
        self.at.append(step)
        self.low.append(prefix)

    def since(self, step: int, cap: int) -> int:
        k = bisect_right(self.at, step)
        return self.low[k] if k < len(self.low) else cap


def _mapped(values: Sequence[int]) -> tuple[memoryview, object]:
    file = tempfile.TemporaryFile()
    array("q", values).tofile(file)
    file.flush()
    held = mmap.mmap(file.fileno(), 0)
    return memoryview(held).cast("q"), file


def _common(text: Sequence[int], a: int, b: int, cap: int) -> int:
    end = min(cap, len(text) - max(a, b))
    k = 0
    while k < end and text[a + k] == text[b + k]:
        k += 1
    return k


def sorted_suffixes(values: Sequence[int], cap: int, held: int = HELD) -> tuple[array, array]:
    """(suffix order, common prefix with the suffix before, at most ``cap``). The last value must be the smallest, once."""
    if len(values) == 1:
        return array("q", [0]), array("q", [0])
    text, file = _mapped(values)
    try:
        return _sorted(text, cap, held)
    finally:
        text.release()
        file.close()


def _sorted(text: memoryview, cap: int, held: int) -> tuple[array, array]:
    n = len(text)
    small = bytearray(n)
    small[n - 1] = 1
    for i in range(n - 2, -1, -1):
        small[i] = text[i] < text[i + 1] or (text[i] == text[i + 1] and small[i + 1])
    seeds = _seeds(text, small, held)
    larger, prefixes = _induce_larger(text, small, seeds, cap, held)
    return _induce_smaller(text, small, larger, prefixes, cap, held)


def _seeds(text: memoryview, small: bytearray, held: int) -> array:
    """Leftmost S suffixes in order: by the names of the pieces between them, and recursion while names repeat."""
    places = array("q", (i for i in range(1, len(text)) if small[i] and not small[i - 1]))
    pieces = [tuple([2 * text[x] + small[x] for x in range(a, b + 1)]) for a, b in zip(places, [*places[1:], places[-1]])]
    names = {piece: k for k, piece in enumerate(sorted(set(pieces)))}
    string = [names[p] for p in pieces]
    if len(names) == len(string):
        order = sorted(range(len(string)), key=string.__getitem__)
    else:
        order = sorted_suffixes(string, 1, held)[0]
    return array("q", (places[k] for k in order))


def _induce_larger(text: memoryview, small: bytearray, seeds: array, cap: int, held: int) -> tuple[array, array]:
    """L suffixes in order, each with its common prefix with the L suffix before it (0 where the symbol changes)."""
    queue, passed, last = DiskQueue(held), _Passed(), {}
    out, prefixes = array("q"), array("q")
    step, before, before_seed, k = 0, -1, False, 0
    while True:
        top = queue.least()
        if top is None and k >= len(seeds):
            break
        from_queue = top is not None and (k >= len(seeds) or top[0] <= text[seeds[k]])
        if from_queue:
            symbol, _, place, prefix = queue.pop()
            if before_seed or before < 0 or text[before] != symbol:
                prefix = 0
            out.append(place)
            prefixes.append(prefix)
        else:
            place = seeds[k]
            k += 1
            prefix = _common(text, before, place, cap) if before >= 0 and text[before] == text[place] else 0
        passed.add(step, prefix)
        ahead = place - 1
        if ahead >= 0 and not small[ahead]:
            symbol = text[ahead]
            common = min(cap, 1 + passed.since(last[symbol], cap)) if symbol in last else 0
            queue.push((symbol, step, ahead, common))
            last[symbol] = step
        before, before_seed = place, not from_queue
        step += 1
    queue.close()
    return out, prefixes


def _induce_smaller(text: memoryview, small: bytearray, larger: array, prefixes: array, cap: int, held: int) -> tuple[array, array]:
    """All suffixes in order with common prefixes; S suffixes come from the queue, from the largest down."""
    queue, passed, last = DiskQueue(held), _Passed(), {}
    out, found = array("q"), array("q")
    step, before, before_small, k = 0, -1, False, len(larger) - 1
    while True:
        top = queue.least()
        if top is None and k < 0:
            break
        from_queue = top is not None and (k < 0 or -top[0] >= text[larger[k]])
        if from_queue:
            symbol, _, place, prefix = queue.pop()
            if before < 0 or text[before] != text[place]:
                prefix = 0
        else:
            place = larger[k]
            if before < 0 or text[before] != text[place]:
                prefix = 0
            elif before_small:
                prefix = _common(text, place, before, cap)
            else:
                prefix = prefixes[k + 1]
            k -= 1
        # the prefix is the one with the suffix after it, which was passed just before
        out.append(place)
        found.append(prefix)
        passed.add(step, prefix)
        ahead = place - 1
        if ahead >= 0 and small[ahead]:
            symbol = text[ahead]
            common = min(cap, 1 + passed.since(last[symbol], cap)) if symbol in last else 0
            queue.push((-symbol, step, ahead, common))
            last[symbol] = step
        before, before_small = place, from_queue
        step += 1
    queue.close()
    # the smallest suffix, the end, is induced by none
    out.append(len(text) - 1)
    found.append(0)
    out.reverse()
    found.reverse()
    # found[i] is now with the suffix after i; shift to the one before
    return out, array("q", [0, *found[:-1]])
