"""Toxicity of restored text: a noisy-channel decoder undoes leetspeak, spacing and repetition before scoring.

A written token is a lattice: each character is itself or a letter that it may stand for, a mark may have been put
between letters, a letter may have been repeated. A beam Viterbi search finds the likeliest readings under a
character trigram model, whose counts come from every word of all documents (the table is bounded by the cube of the
alphabet). Runs of single characters with separators between them are read as one lattice in which a word may end
anywhere. A token of letters only, with no letter doubled and no look-alike at its edge, is taken as it stands; any other
one with letters keeps its plain reading beside those of the lattice.

A document's features are its restored words and their beginnings; a logistic model over features that mark toxic
documents gives its score. Labels are learned from at most ``POSITIVE`` and ``NEGATIVE`` documents, drawn by hash.

Defined cases: a null or empty text has the features of no words and gets the model's base score; without labels of
both kinds every score is the share of toxic labels (0 without any). Long documents are read whole. Several labels of
a document count as toxic if one is; a null label is no label. Other columns pass through.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kinpanel.llm.common import with_fields
from kinpanel.session import checkpointed, own_stages

POSITIVE = 4000
NEGATIVE = 8000
CANDIDATES = 5000
BEAM = 24
READINGS = 8
PIECE = 40
#: tokens whose words a task remembers, and tokens that it remembers to have no weight
MEMO = 300_000
QUIET = 600_000
BEGIN = 5
#: bits of a symbol in a trigram's number, and characters whose trigrams are counted at once
BITS = 6
CHUNK = 1 << 20
# fixed values: what written characters may stand for
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
#: log costs of a substitution, of a mark between letters (of one that looks like a letter), of a repeated letter, and of
#: a word end in a spaced run
SUBSTITUTED, MARKED, MARKED_LIKE, REPEATED, ENDED = -0.7, -1.0, -6.0, -0.7, -1.5

_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "…«»“”‘’–—¿¡§€£"
_QUIET = "".join(c for c in _EDGES if c not in LOOKS)
_CLEAN = re.compile(r"[^\W\d_]+")
_BLANK = re.compile(r"\s")
_DOUBLE = re.compile(r"(.)\1")
_SPACED = re.compile(r"(?<!\S)(?:[^\s._*-][ ._*-]+){2,}[^\s._*-](?!\S)")
_LETTERS = set("abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100))) + "œ")
_SYMBOLS = "".join(sorted(_LETTERS)) + "?"


def plain(word: str) -> str:
    """The word over the model's alphabet; other letters become one symbol."""
    return "".join(c if c in _LETTERS else "?" for c in word)


def unspaced(run: str) -> str:
    """The single characters of a spaced run, without the separators between them."""
    return re.sub(r"[ ._*-]+", "", run)


class Language:
    """Interpolated character trigrams; ``^`` stands before and after a word."""

    def __init__(self, counts: Counter[str]):
        self.three = counts
        self.two: Counter[str] = Counter()
        self.one: Counter[str] = Counter()
        self.under_two: Counter[str] = Counter()
        self.under_one: Counter[str] = Counter()
        for gram, n in counts.items():
            self.two[gram[1:]] += n
            self.one[gram[2]] += n
            self.under_two[gram[:2]] += n
            self.under_one[gram[1]] += n
        self.all = sum(self.one.values()) or 1
        self.known: dict[str, float] = {}

    def score(self, gram: str) -> float:
        value = self.known.get(gram)
        if value is None:
            a = self.three.get(gram, 0) / (self.under_two.get(gram[:2], 0) or 1)
            b = self.two.get(gram[1:], 0) / (self.under_one.get(gram[1], 0) or 1)
            c = (self.one.get(gram[2], 0) + 0.5) / (self.all + 40)
            value = self.known[gram] = math.log(0.7 * a + 0.25 * b + 0.05 * c)
        return value

    def readings(self, token: str, spaced: bool = False) -> list[str]:
        """Likeliest letter strings behind each piece of the token, best first."""
        return [r for begin in range(0, len(token), PIECE) for r in self._piece(token[begin:begin + PIECE], spaced)]

    def _piece(self, piece: str, spaced: bool) -> list[str]:
        """Likeliest letter strings behind a short token; in a spaced run a blank may end a word."""
        paths = [(0.0, "", "^^", "")]
        for at, char in enumerate(piece):
            if not spaced and char.isalpha() and char not in LOOKS and char != piece[at - 1:at]:
                # the letter is written once and is itself, so every path goes on in one way
                symbol = char if char in _LETTERS else "?"
                paths = [(score + self.score(last + symbol), text + char, last[1] + symbol, char) for score, text, last, _ in paths]
                continue
            options = [(char, 0.0)] if char in _LETTERS or char.isalpha() else []
            options += [(c, SUBSTITUTED) for c in LOOKS.get(char, "")]
            if not char.isalpha():
                options.append(("", MARKED_LIKE if char in LOOKS else MARKED))
            grown: dict[tuple[str, str], tuple[float, str, str, str]] = {}
            for score, text, last, written in paths:
                more = options + ([("", REPEATED)] if char == written and char.isalpha() else [])
                for letter, cost in more:
                    if not letter:
                        self._keep(grown, (score + cost, text, last, char))
                        continue
                    symbol = letter if letter in _LETTERS else "?"
                    self._keep(grown, (score + cost + self.score(last + symbol), text + letter, last[1] + symbol, char))
                    if spaced and text and last != "^^":
                        ended = score + cost + ENDED + self.score(last + "^") + self.score("^^" + symbol)
                        self._keep(grown, (ended, text + " " + letter, "^" + symbol, char))
            paths = sorted(grown.values(), key=lambda p: (-p[0], p[1]))[:BEAM]
        ends = sorted(((s + self.score(last + "^"), text) for s, text, last, _ in paths if text), key=lambda p: (-p[0], p[1]))
        return list(dict.fromkeys(text for _, text in ends))[:READINGS]

    def _undoubled(self, core: str) -> list[str]:
        """``readings`` of a word of letters only: its lattice is each doubled letter written once or twice."""
        places = [i for i in range(1, len(core)) if core[i] == core[i - 1]]
        if 2 ** len(places) > BEAM or len(core) > PIECE:
            return self.readings(core)
        best: dict[str, float] = {}
        for choice in range(2 ** len(places)):
            gone = {i for k, i in enumerate(places) if choice >> k & 1}
            total, text, last = 0.0, "", "^^"
            for i, c in enumerate(core):
                if i in gone:
                    total += REPEATED
                else:
                    symbol = c if c in _LETTERS else "?"
                    total, text, last = total + self.score(last + symbol), text + c, last[1] + symbol
            total += self.score(last + "^")
            best[text] = max(total, best.get(text, total))
        return sorted(best, key=lambda t: (-best[t], t))[:READINGS]

    def _doubled(self, core: str) -> list[str]:
        """``_undoubled`` in any order; up to ``READINGS`` readings are all kept, so they need no scores."""
        places = [i for i in range(1, len(core)) if core[i] == core[i - 1]]
        if 2 ** len(places) > READINGS or len(core) > PIECE:
            return self._undoubled(core)
        found = [core]
        for i in reversed(places):
            found += [text[:i] + text[i + 1:] for text in found]
        return found

    @staticmethod
    def _keep(grown: dict, path: tuple[float, str, str, str]) -> None:
        key = (path[1], path[2])
        if key not in grown or grown[key][0] < path[0]:
            grown[key] = path

    def words(self, token: str) -> tuple[str, ...]:
        """Words that a written token (in lower case) may be; one, itself, if there is nothing to undo."""
        if token.isalpha() and not _DOUBLE.search(token):
            return (token,)
        core = token.strip(_EDGES)
        if _CLEAN.fullmatch(core):
            marked = core != token and any(c in LOOKS for c in token.replace(core, "", 1))
            odd = self.readings(token.strip(_QUIET)) if marked else self._doubled(core) if _DOUBLE.search(core) else []
            return tuple(dict.fromkeys([core, *odd]))
        if not any(c.isalpha() for c in token) and not (3 <= len(core) <= 12 and any(c in LOOKS for c in core)):
            return ()
        parts = [p for p in _CLEAN.findall(core) if len(p) > 1]
        return tuple(dict.fromkeys([*self.readings(token.strip(_QUIET)), *parts]))

    def restored(self, text: str | None, memo: dict[str, tuple[str, ...]]) -> set[str]:
        """Distinct restored words of a text."""
        if not text:
            return set()
        low = text.lower()
        found: set[str] = set()
        for token in set(low.split()):
            words = memo.get(token)
            if words is None:
                if len(memo) > MEMO:
                    memo.clear()
                words = memo[token] = self.words(token)
            found.update(words)
        return found | self.spaced_words(low)

    def spaced_words(self, low: str) -> set[str]:
        """Words of the runs of single characters in a text (in lower case)."""
        return {w for run in _SPACED.finditer(low) for r in self.readings(unspaced(run.group()), True) for w in r.split()}


@functools.cache
def symbol(point: int) -> int:
    """Number of a code point in lower case: 0 for white space, 1 for what words of letters are without, then the alphabet."""
    c = chr(point)
    return 0 if c.isspace() else 2 + _SYMBOLS.index(plain(c)) if _CLEAN.fullmatch(c) else 1


def pieces(text: str) -> Iterator[str]:
    """Stretches of about ``CHUNK`` characters of a text, cut at blanks."""
    begin = 0
    while blank := _BLANK.search(text, begin + CHUNK):
        yield text[begin:blank.start()]
        begin = blank.start()
    yield text[begin:]


def trigrams(texts: Iterable[str]) -> np.ndarray:
    """Count of each trigram (three symbol numbers of ``BITS`` bits) of the words of letters only, in texts in lower case."""
    points = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le"), dtype=np.uint32)
    present = np.flatnonzero(np.bincount(points))
    number = np.zeros(present[-1] + 1, dtype=np.int32)
    number[present] = [symbol(p) for p in present.tolist()]
    c = number[points]
    blanks = np.flatnonzero(c == 0)
    # a word ends with the blank behind it; one with another symbol than letters counts for nothing
    counts = np.ones(len(blanks), dtype=bool)
    counts[np.searchsorted(blanks, np.flatnonzero(c == 1))] = False
    counts = np.repeat(counts, np.diff(blanks, prepend=-1))
    counts[1:] &= (c[1:] > 0) | (c[:-1] > 0)
    counts[0] = False
    last, before = c[:-1], np.where(c[1:-1] > 0, c[:-2], 0)
    grams = (last << BITS) + c[1:]
    grams[1:] += before << 2 * BITS
    return np.bincount(grams[counts[1:]], minlength=1 << 3 * BITS)


def character_counts(docs: DataFrame) -> Counter[str]:
    """Trigram counts of all words of letters of all documents; the table is bounded by the alphabet."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << 3 * BITS, dtype=np.int64)
        held: list[str] = []
        size = 0
        for batch in batches:
            for piece in (p for text in batch.column(0).to_pylist() if text for p in pieces(text.lower())):
                held.append(piece)
                size += len(piece)
                if size >= CHUNK:
                    sums += trigrams(held)
                    held, size = [], 0
        sums += trigrams(held)
        found = np.flatnonzero(sums)
        names = ["^", "", *_SYMBOLS]
        grams = ["".join(names[g >> k * BITS & (1 << BITS) - 1] for k in (2, 1, 0)) for g in found.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(sums[found], pa.int64())], ["gram", "n"])

    sums = docs.select("text").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return Counter({r["gram"]: r["n"] for r in sums.collect()})


def features(words: Iterable[str]) -> set[str]:
    """The words, and the beginnings of longer ones (marked by a dash)."""
    out = set(words)
    out.update([w[:BEGIN] + "-" for w in out if len(w) > BEGIN])
    return out


class Model:
    """Weights of marking features over a base."""

    def __init__(self, language: Language, weights: dict[str, float], base: float):
        self.language, self.weights, self.base = language, weights, base

    def marks(self, text: str | None, memo: dict[str, tuple[str, ...]], quiet: set[str]) -> set[str]:
        """Features of the restored text that have a weight; ``quiet`` holds tokens without any, ``memo`` those of others."""
        if not text:
            return set()
        low = text.lower()
        found: set[str] = set()
        for token in set(low.split()).difference(quiet):
            own = memo.get(token)
            if own is None:
                own = tuple(features(self.language.words(token)) & self.weights.keys())
                if own:
                    if len(memo) > MEMO:
                        memo.clear()
                    memo[token] = own
                else:
                    if len(quiet) > QUIET:
                        quiet.clear()
                    quiet.add(token)
            found.update(own)
        found.update(features(self.language.spaced_words(low)) & self.weights.keys())
        return found

    def scores(self, texts: list[str | None], memo: dict[str, tuple[str, ...]], quiet: set[str]) -> list[float]:
        out = []
        for text in texts:
            total = self.base + sum(self.weights[f] for f in sorted(self.marks(text, memo, quiet)))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))))
        return out


def train(docs: DataFrame, labels: DataFrame, usable=None) -> Model:
    """Fit on a bounded sample of ``labels`` (doc_id, toxic) for which ``usable`` (a column) holds."""
    language = Language(character_counts(docs))
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if usable is not None:
        known = known.filter(usable)
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    # a hash below a bound per class leaves about twice the wanted rows to be ranked
    known = known.withColumn("__k", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    size = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    most = F.when(F.col("toxic") == 1, POSITIVE).otherwise(NEGATIVE)
    share = F.when(F.col("toxic") == 1, 2.0 * POSITIVE / size.get(1, 1)).otherwise(2.0 * NEGATIVE / size.get(0, 1))
    first = Window.partitionBy("toxic").orderBy("__k", "doc_id")
    drawn = known.filter(F.col("__k") < share * (1 << 30)).withColumn("__n", F.row_number().over(first)).filter(
        F.col("__n") <= most).select("doc_id", "toxic")
    # at most POSITIVE + NEGATIVE rows of two numbers
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            found = [sorted(features(language.restored(t, memo))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], ["toxic", "found"])

    read_rows = sample.select("toxic", "text").mapInArrow(read, "toxic int, found array<string>")
    with own_stages(docs.sparkSession):
        # written, as features are counted before those that mark documents are read
        return fit(checkpointed(read_rows), language)


def fit(read_rows: DataFrame, language: Language) -> Model:
    """Model of a bounded sample of documents (toxic, found: features)."""
    share = {r["toxic"]: r["count"] for r in read_rows.groupBy("toxic").count().collect()}
    p, n = share.get(1, 0), share.get(0, 0)
    if not p or not n:
        return Model(language, {}, 30.0 if p else -30.0)
    counts = read_rows.select("toxic", F.explode("found").alias("f")).groupBy("f").agg(
        F.sum("toxic").alias("yes"), F.count("*").alias("all"))
    # lower bound of the share of toxic documents among those with the feature
    rate, size = F.col("yes") / F.col("all"), F.col("all")
    low = (rate + 2 / size - 2 * F.sqrt(rate * (1 - rate) / size + 1 / size**2)) / (1 + 4 / size)
    picked = counts.filter("yes >= 4").withColumn("low", low).filter(F.col("low") > 2 * p / (p + n) * 0.5).orderBy(
        F.desc("yes"), "f").limit(CANDIDATES)
    names = [r["f"] for r in picked.filter("low >= 0.4").collect()]
    if not names:
        return Model(language, {}, math.log(p / n))
    place = {f: k for k, f in enumerate(names)}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(place[f] for f in found if f in place) for found in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(own, pa.list_(pa.int32()))], ["toxic", "own"])

    rows = sorted((r["toxic"], tuple(r["own"])) for r in read_rows.mapInArrow(keep, "toxic int, own array<int>").collect())
    weights, base = logistic([own for _, own in rows], np.array([y for y, _ in rows]), len(names))
    return Model(language, {f: float(w) for f, w in zip(names, weights) if w}, base)


def logistic(rows: list[tuple[int, ...]], y: np.ndarray, size: int, steps: int = 400, sparse: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic weights over binary features by proximal gradient steps; ``sparse`` pulls weights to 0."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([f for r in rows for f in r], dtype=np.int64)
    w, base = np.zeros(size), math.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    seen = np.zeros(size)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[feature], len(rows)) + base, -30, 30)))
        d = (p - y) / len(rows)
        g = np.bincount(feature, d[at], size)
        seen += g * g
        rate = 0.5 / (np.sqrt(seen) + 1e-6)
        w -= rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparse, 0)
        base -= 2 * d.sum()
    return w, float(base)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxicity`` between 0 and 1, from the whole text alone."""
    kept = [c for c in docs.columns if c != "toxicity"]
    source = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        quiet: set = set()
        for batch in batches:
            found = model.scores(batch.column("text").to_pylist(), memo, quiet)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*kept, "toxicity"])

    return source.mapInArrow(run, with_fields(source, toxicity="double"))
