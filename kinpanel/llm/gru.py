"""Language identification with a bidirectional gated recurrent network over bytes, trained here by backpropagation.

The network reads the UTF-8 bytes of a run of letters (in lower case, with a blank on either side, runs of more than
``PIECE`` bytes cut into pieces) in both directions and gives every position a distribution over the languages. A
document's probabilities are the mean over all its positions. Runs are read alone, so equal runs have equal labels and
a task computes each only once while it remembers it.

Training uses at most ``DOCS`` documents per language and ``WORDS`` runs of each, drawn by hash from the whole text; the
fit runs on the driver. Scoring covers every byte of every letter run of every text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Documents without a language are not
learned from. Without any labelled document every text is ``und``. Other columns pass through; columns named like the
results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kinpanel.llm.common import with_fields

HIDDEN = 12
PIECE = 40
DOCS = 600
WORDS = 30
STEPS = 700
BATCH = 256
CHUNK_BYTES = 1 << 20
MEMO = 80_000
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str | None) -> list[str]:
    """Runs of letters in lower case; numbers such as one half or a Roman numeral sign are none."""
    out = []
    for run in _LETTERS.findall(text.lower()) if text else []:
        out += [run] if run.isalpha() else ["".join(part) for letters, part in groupby(run, str.isalpha) if letters]
    return out


def packed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words, one row each, padded with 0, and their lengths."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    width = int(lengths.max())
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width), lengths


def _reversed(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    at = lengths[:, None] - 1 - np.arange(rows.shape[1])
    return np.where(at >= 0, np.take_along_axis(rows, np.maximum(at, 0), 1), 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Direction:
    """One direction: a gated recurrent unit whose input weights are a row per byte."""

    def __init__(self, rng: np.random.Generator, hidden: int, classes: int):
        self.x = rng.normal(0, 0.1, (256, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        self.b = np.zeros((1, 3 * hidden), dtype=np.float32)
        self.out = rng.normal(0, 0.1, (hidden, classes)).astype(np.float32)

    def run(self, rows: np.ndarray, mask: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Hidden state after each byte, [time, word, hidden]."""
        n, width = rows.shape
        k = self.u.shape[0]
        h = np.zeros((n, k), dtype=np.float32)
        states = np.empty((width, n, k), dtype=np.float32)
        for t in range(width):
            given, own = self.x[rows[:, t]] + self.b, h @ self.u
            gates = _sigmoid(given[:, :2 * k] + own[:, :2 * k])
            z, r = gates[:, :k], gates[:, k:]
            new = np.tanh(given[:, 2 * k:] + r * own[:, 2 * k:])
            after = new + z * (h - new)
            if trace is not None:
                trace.append((h, z, r, new, own[:, 2 * k:]))
                after = np.where(mask[:, t:t + 1], after, h)
            states[t] = h = after
        return states

    def back(self, rows: np.ndarray, mask: np.ndarray, trace: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of x, u, b from those of the states, through time."""
        n, width = rows.shape
        k = self.u.shape[0]
        du, carry = np.zeros_like(self.u), np.zeros((n, k), dtype=np.float32)
        given = np.zeros((width, n, 3 * k), dtype=np.float32)
        for t in range(width - 1, -1, -1):
            h, z, r, new, own = trace[t]
            m = mask[:, t:t + 1]
            total = grad[t] + carry
            dh = total * m
            dn = dh * (1 - z) * (1 - new * new)
            dz, dr = dh * (h - new) * z * (1 - z), dn * own * r * (1 - r)
            inner = np.concatenate([dz, dr, dn * r], axis=1)
            given[t] = np.concatenate([dz, dr, dn], axis=1)
            du += h.T @ inner
            carry = total * ~m + dh * z + inner @ self.u.T
        flat = given.reshape(-1, 3 * k)
        hot = np.zeros((len(flat), 256), dtype=np.float32)
        hot[np.arange(len(flat)), rows.T.reshape(-1)] = 1
        return [hot.T @ flat, du, flat.sum(0, keepdims=True)]


class Model:
    """Both directions and the output layer."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.ahead, self.behind = (Direction(rng, hidden, len(labels)) for _ in range(2))
        self.bias = np.zeros(len(labels), dtype=np.float32)

    def positions(self, words: list[bytes], traces: tuple[list, list] | None = None):
        """Distribution over the labels at every position, [time, word, label], and what produced it."""
        rows, lengths = packed(words)
        mask = np.arange(rows.shape[1]) < lengths[:, None]
        turned = _reversed(rows, lengths)
        one, two = traces or (None, None)
        ahead, behind = self.ahead.run(rows, mask, one), self.behind.run(turned, mask, two)
        at = np.maximum(lengths[None, :] - 1 - np.arange(rows.shape[1])[:, None], 0)
        logits = ahead @ self.ahead.out + np.take_along_axis(behind @ self.behind.out, at[:, :, None], 0) + self.bias
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        return p, (rows, turned, mask, at, ahead, behind)

    def gradients(self, words: list[bytes], y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients in the order of ``parameters``."""
        traces: tuple[list, list] = ([], [])
        p, (rows, turned, mask, at, ahead, behind) = self.positions(words, traces)
        m = mask.T[:, :, None].astype(np.float32)
        hot = np.eye(len(self.labels), dtype=np.float32)[y][None]
        loss = float(-(np.log(np.maximum((p * hot).sum(2), 1e-9)) * m[:, :, 0]).sum() / m.sum())
        d = (p - hot) * m / m.sum()
        turned_d = np.take_along_axis(d, at[:, :, None], 0) * m
        grads = []
        for part, states, dd, own, trace in ((self.ahead, ahead, d, rows, traces[0]), (self.behind, behind, turned_d, turned, traces[1])):
            out = np.einsum("tnh,tnc->hc", states, dd)
            grads += [*part.back(own, mask, trace, dd @ part.out.T), out]
        return loss, [*grads, d.sum((0, 1))]

    def parameters(self) -> list[np.ndarray]:
        return [a for part in (self.ahead, self.behind) for a in (part.x, part.u, part.b, part.out)] + [self.bias]

    def fit(self, words: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02) -> Model:
        """Adam over batches of words of similar length."""
        rng = np.random.default_rng(11)
        params = self.parameters()
        first, second = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
        order = np.argsort([len(w) for w in words], kind="stable")
        for step in range(1, steps + 1):
            at = int(rng.integers(0, max(1, len(order) - batch + 1)))
            own = order[at:at + batch]
            _, grads = self.gradients([words[i] for i in own], y[own])
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for a, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.002 * (g * g - v)
                a -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-7)).astype(np.float32)
        return self

    def totals(self, words: list[str], block: int = 1024) -> np.ndarray:
        """Per word: the sum over its positions of each label's probability, and the number of positions."""
        pieces, owner = [], []
        for k, word in enumerate(words):
            data = word.encode()
            for begin in range(0, len(data), PIECE):
                pieces.append(b" " + data[begin:begin + PIECE] + b" ")
                owner.append(k)
        out = np.zeros((len(words), len(self.labels) + 1))
        order = np.argsort([len(p) for p in pieces], kind="stable")
        owners = np.array(owner)
        for begin in range(0, len(order), block):
            own = order[begin:begin + block]
            p, (_, _, mask, *_) = self.positions([pieces[i] for i in own])
            np.add.at(out[:, :-1], owners[own], (p * mask.T[:, :, None]).sum(0))
            np.add.at(out[:, -1], owners[own], mask.sum(1))
        return out


def train(docs: DataFrame, usable=None) -> Model:
    """Fit on a bounded sample of the labelled documents for which ``usable`` (a column, default all) holds."""
    sample = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if usable is not None:
        sample = sample.filter(usable)
    # languages are the model's classes, so their counts are few; a hash below a bound per language leaves about twice
    # DOCS texts of each to be moved
    bounds = {r["lang"]: min(1.0, 2.0 * DOCS / r["count"]) for r in sample.groupBy("lang").count().collect()}
    if not bounds:
        return Model([])
    share = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(bounds.items()) for x in pair]), F.col("lang"))
    drawn = sample.select("lang", "text", F.xxhash64("text").alias("__k")).filter(
        F.pmod(F.col("__k"), F.lit(1 << 30)) < share * (1 << 30))
    first = Window.partitionBy("lang").orderBy("__k")
    sample = drawn.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= DOCS)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                runs = letter_runs(text)
                step = max(1, len(runs) // WORDS)
                rows += [(lang, w) for w in runs[len(text) % step::step][:WORDS]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["lang", "word"])

    rows = sorted((r["lang"], r["word"]) for r in sample.select("lang", "text").mapInArrow(draw, "lang string, word string").collect())
    labels = sorted({lang for lang, _ in rows})
    model = Model(labels)
    if rows:
        words = [b" " + w.encode()[:PIECE] + b" " for _, w in rows]
        model.fit(words, np.array([labels.index(lang) for lang, _ in rows]))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, from the whole text alone."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    source = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        values = np.zeros((0, len(model.labels) + 1))

        def score(texts: list[str | None]) -> tuple[list[str], list[float]]:
            nonlocal values
            runs = [letter_runs(t) if model.labels else [] for t in texts]
            new = {w for own in runs for w in own if w not in memo}
            if len(memo) + len(new) > MEMO:
                memo.clear()
                values = values[:0]
                new = {w for own in runs for w in own}
            if new:
                new = list(new)
                memo.update(zip(new, range(len(memo), len(memo) + len(new))))
                values = np.concatenate([values, model.totals(new)])
            names, scores = [], []
            for own in runs:
                if not own:
                    names.append("und")
                    scores.append(0.0)
                    continue
                total = values[np.fromiter(map(memo.__getitem__, own), dtype=np.int64, count=len(own))].sum(0)
                best = int(total[:-1].argmax())
                names.append(model.labels[best])
                scores.append(min(1.0, float(total[best] / total[-1])))
            return names, scores

        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores, begin, size = [], [], 0, 0
            for k, text in enumerate(texts):
                size += len(text or "")
                if size >= CHUNK_BYTES or k == len(texts) - 1:
                    more = score(texts[begin:k + 1])
                    names += more[0]
                    scores += more[1]
                    begin, size = k + 1, 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "lang_score"])

    return source.mapInArrow(run, with_fields(source, lang_pred="string", lang_score="double"))


def fold(modulus: int, rest: int):
    """Whether crc32 of the doc_id as text leaves ``rest``; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))
