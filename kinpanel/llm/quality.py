"""Quality scores from weak labels: heuristic labellers, a latent-class model of their accuracies, a hashed scorer.

Every labeller votes good (1), bad (-1) or abstains (0) on a document. The vote patterns of all documents are counted
in Spark (there are at most 3 to the number of labellers) and expectation-maximisation over the counts estimates, per
class, how often each labeller gives each vote, and the share of good documents. The posterior of a pattern is the weak
label of its documents. A logistic scorer over hashed words, word shapes and repetitions is trained on the posteriors
of about ``SAMPLE`` documents and scores every whole text.

Defined cases: a null, empty or wordless text gets no vote but "too short" and scores by the model's base; an empty
table returns no rows. Repeated rows count as often as they stand. Other columns pass through; columns named like the
results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kinpanel.llm.common import with_fields

SAMPLE = 6000
SLOTS = 1 << 16
MEMO = 300_000
ROUNDS = 200
#: slots after the hashed ones: repeated neighbours, repeated lines, share of the commonest word
EXTRA = 3
_SYMBOLS = re.compile(r"[*$%&#@^~|<>{}\\_=+]|!!|\?\?")
_UPPER = re.compile(r"[A-ZÀ-Þ]")
_LETTER = re.compile(r"[^\W\d_]")
_RUNS = (re.compile(r"[A-ZÀ-Þ]+"), re.compile(r"[^\W\dA-Z_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+"))

_WORD = re.compile(r"[\"'(«¿¡]?[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?\"')»…]{0,2}")

LABELLERS = ["symbols", "words", "capitals", "repeats", "lines", "variety", "commonest", "length"]


class Words(dict):
    """Remembered words: each has a number, measures (symbols, letters, capitals, usual form, length) and a weight."""

    def __init__(self, weigh=None):
        super().__init__()
        self.rows: list[tuple[float, ...]] = []
        self.filled = 0
        self.weigh = weigh or (lambda word, form=None: 0.0)
        self.table = np.zeros((1024, 6))

    def __missing__(self, word: str) -> int:
        value = self[word] = self.filled + len(self.rows)
        core, mark = (word[:-1], word[-1]) if word[-1] in ".,;:!?" else (word, "")
        if core.isalpha():  # most words; the same measures and shape by the shorter way
            if core.islower():
                self.rows.append((0, len(core), 0, True, len(word), self.weigh(word, "x" + mark)))
                return value
            if core[1:].islower() and _UPPER.match(core):
                self.rows.append((0, len(core), 1, True, len(word), self.weigh(word, "Xx" + mark)))
                return value
        self.rows.append((len(_SYMBOLS.findall(word)), len(_LETTER.findall(word)), len(_UPPER.findall(word)),
                          bool(_WORD.fullmatch(word)), len(word), self.weigh(word)))
        return value

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self) > MEMO:
            self.clear()
            self.rows, self.filled = [], 0
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def measures(self, numbers: np.ndarray) -> np.ndarray:
        if self.rows:
            end = self.filled + len(self.rows)
            if end > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(end, len(self.table)), 6))])
            self.table[self.filled:end] = self.rows
            self.filled, self.rows = end, []
        return self.table.take(numbers, axis=0).sum(axis=0)


def describe(text: str | None, known: Words) -> tuple[list[str], list[int], list[float], float]:
    """Words, votes in the order of ``LABELLERS``, the three extra measures, and the mean weight of the words."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return words, [0] * (len(LABELLERS) - 1) + [-1], [0.0] * EXTRA, 0.0
    numbers = known.numbers(words)
    symbols, letters, capitals, usual, length, weight = known.measures(numbers)
    symbols, capitals, usual, mean = symbols / len(text), capitals / max(letters, 1), usual / n, length / n
    repeats = float((numbers[1:] == numbers[:-1]).sum()) / n
    lines = [line for line in text.split("\n") if line.strip()]
    doubled = 1 - len(set(lines)) / len(lines)
    ordered = np.sort(numbers)
    change = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
    variety, commonest = (len(change) - 1) / n, float(np.diff(change).max()) / n

    def vote(bad: bool, good: bool) -> int:
        return -1 if bad else 1 if good else 0

    long = n >= 20
    return words, [
        vote(symbols > 0.08, symbols < 0.02), vote(usual < 0.6, usual > 0.85), vote(capitals > 0.3, capitals < 0.15),
        vote(repeats > 0.05 and long, repeats < 0.03), vote(doubled > 0.3, doubled == 0 and len(lines) > 2),
        vote(variety < 0.35 and n < 2000 or variety < 0.08, variety > 0.5),
        vote(commonest > 0.2 and long, commonest < 0.12 and long), vote(n < 3, 3.5 < mean < 6.3 and n >= 5),
    ], [repeats, doubled, commonest if long else 0.0], float(weight) / n


def shape(word: str) -> str:
    """Letters as x or X, digits as 0, marks as they are, runs as one."""
    for pattern, sign in zip(_RUNS[:3], ("X", "x", "0")):
        word = pattern.sub(sign, word)
    return _RUNS[3].sub(r"\1+", word)


def slots(word: str) -> tuple[int, int]:
    return (_word_slot(word), _form_slot(shape(word)))


def _word_slot(word: str) -> int:
    return xxhash.xxh32_intdigest("w" + word) % SLOTS


def _form_slot(form: str) -> int:
    return xxhash.xxh32_intdigest("s" + form) % SLOTS


def pattern_counts(docs: DataFrame) -> dict[tuple[int, ...], int]:
    """Votes of all documents, counted; at most 3 ** len(LABELLERS) entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        known = Words()
        for batch in batches:
            seen.update(",".join(map(str, describe(t, known)[1])) for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["votes", "n"])

    sums = docs.select("text").mapInArrow(run, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    return {tuple(map(int, r["votes"].split(","))): r["n"] for r in sums.collect()}


def accuracies(counts: dict[tuple[int, ...], int]) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """(share of good, P(vote | class) as [labeller, class bad/good, vote + 1], posterior of good per pattern) by EM."""
    if not counts:
        return 0.5, np.full((len(LABELLERS), 2, 3), 1 / 3), {}
    patterns = sorted(counts)
    votes = np.array(patterns)
    n = np.array([counts[p] for p in patterns], dtype=float)
    # start from the majority; classes keep their meaning because labellers are better than chance at the start
    good = np.clip(0.5 + votes.sum(1) / (2 * votes.shape[1]), 0.05, 0.95)
    for _ in range(ROUNDS):
        weight = np.stack([n * (1 - good), n * good])
        table = np.array([[[weight[c][votes[:, k] == v].sum() + 1.0 for v in (-1, 0, 1)] for c in (0, 1)] for k in range(votes.shape[1])])
        table /= table.sum(2, keepdims=True)
        prior = np.clip(weight[1].sum() / n.sum(), 0.01, 0.99)
        logs = np.log(table[np.arange(votes.shape[1])[None], :, votes + 1]).sum(1)
        odds = logs[:, 1] - logs[:, 0] + np.log(prior / (1 - prior))
        now = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(now - good).max() < 1e-9:
            good = now
            break
        good = now
    return float(prior), table, {p: float(g) for p, g in zip(patterns, good)}


class Model:
    """Posterior per vote pattern, and the scorer's weights."""

    def __init__(self, posterior: dict[tuple[int, ...], float], weights: np.ndarray, base: float, prior: float, table: np.ndarray):
        self.posterior, self.weights, self.base, self.prior, self.table = posterior, weights, base, prior, table

    def words(self) -> Words:
        weights = self.weights.tolist()  # single values are read faster from a list
        return Words(lambda word, form=None: weights[_word_slot(word)] + weights[_form_slot(form or shape(word))])

    def scores(self, texts: list[str | None], known: Words) -> tuple[list[float], list[float]]:
        weak, scores = [], []
        for text in texts:
            _, votes, extra, total = describe(text, known)
            total += self.base + float(np.dot(extra, self.weights[SLOTS:]))
            weak.append(self.posterior.get(tuple(votes), self.prior))
            scores.append(float(1 / (1 + np.exp(-np.clip(total, -30, 30)))))
        return weak, scores


def train(docs: DataFrame) -> Model:
    counts = pattern_counts(docs)
    prior, table, posterior = accuracies(counts)
    every = max(1, -(-sum(counts.values()) // SAMPLE))
    key = F.xxhash64("text", *(["doc_id"] if "doc_id" in docs.columns else []))
    sample = docs.filter(F.pmod(key, F.lit(every)) == 0).select("text").limit(2 * SAMPLE).repartition(16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            at, value, y = [], [], []
            for text in batch.column(0).to_pylist():
                words, votes, extra, _ = describe(text, known)
                own: Counter[int] = Counter()
                for word, n in Counter(words).items():
                    for slot in slots(word):
                        own[slot] += n / len(words)
                own.update({SLOTS + k: x for k, x in enumerate(extra) if x})
                items = sorted(own.items())
                at.append([k for k, _ in items])
                value.append([v for _, v in items])
                y.append(posterior.get(tuple(votes), prior))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32())), pa.array(y, pa.float64())], ["at", "value", "y"])

    rows = sample.mapInArrow(run, "at array<int>, value array<float>, y double").toArrow()
    weights, base = _fit(rows)
    return Model(posterior, weights, base, prior, table)


def _fit(rows: pa.Table, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic weights for soft labels by full-batch adaptive steps; both classes weigh the same."""
    w, base = np.zeros(SLOTS + EXTRA), 0.0
    if not rows.num_rows:
        return w, base
    y = rows["y"].to_numpy()
    lists = rows["at"].combine_chunks()
    owner = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    at, value = lists.values.to_numpy(), rows["value"].combine_chunks().values.to_numpy().astype(float)
    weight = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    seen = np.zeros_like(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[at] * value, len(y)) + base, -30, 30)))
        d = (p - y) * weight / 2
        g = np.bincount(at, d[owner] * value, SLOTS + EXTRA) + 1e-6 * w
        seen += g * g
        w -= 0.5 * g / (np.sqrt(seen) + 1e-5)
        base -= d.sum()
    return w, float(base)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``weak_label`` (posterior of good) and ``quality_score``, from the whole text alone."""
    kept = [c for c in docs.columns if c not in ("weak_label", "quality_score")]
    source = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.words()
        for batch in batches:
            weak, scores = model.scores(batch.column("text").to_pylist(), known)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weak, pa.float64()), pa.array(scores, pa.float64())],
                                             names=[*kept, "weak_label", "quality_score"])

    return source.mapInArrow(run, with_fields(source, weak_label="double", quality_score="double"))
