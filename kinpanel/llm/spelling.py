"""Spelling variants: words one edit apart, found with an index of grams of variable length.

The dictionary of the index holds the grams that too many words have. A word is decomposed at each place into the shortest
gram of two to four characters (the word's ends count as characters) that is not in the dictionary, so frequent beginnings
get longer grams. One edit at a place can only change the grams that cover it. The most grams that cover one place bound
what an edit affects; a word of n grams of which an edit affects at most a keeps n - a of them. So two near words share,
within the a + 1 rarest grams of each, a gram that the edit did not affect, and it stands as far from the words' beginning
(before the edit) or end (behind it) in both. Only these short lists are merged, by gram, place and length, and words that
meet in one are verified by Levenshtein distance.

A list of over ``LIST`` words is not compared pair by pair. Its words are joined by what is left of them when one
character is deleted, which finds every pair one edit apart, too; for one such rest there are at most (length + 1) words
for each character of the alphabet.

The dictionary has at most ``GRAMS`` grams of each length whatever the corpus, and is broadcast. Words, counts, lists, rests
and links cover all documents and stay distributed: their joins are by sorting at every size. Only the names of long lists, at
most one for ``LIST`` rows, may be broadcast.

Defined cases: a null text has no words; a null doc_id counts as an empty one; equal rows count each. An empty table has
no words. Only doc_id and text are read, whatever else the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from kinpanel.session import checkpointed

#: maximal runs of these, in lower case, are words
RUN = r"[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: one of so many runs loses a character
SLIP = 97
#: least code points and occurrences of a word; a form has at least so many times the occurrences of the word
LENGTH, TIMES, LARGER = 5, 3, 2
#: shortest and longest gram
SHORT, LONG = 2, 4
#: a gram in more places than this is in the dictionary, and most grams of one length in it
COMMON, GRAMS = 64, 200_000
#: words of a list that are compared with each other
LIST = 1000
#: the ends of a word, which are no characters of words
BEGIN, END = "\x02", "\x03"


def occurrences(docs: DataFrame) -> DataFrame:
    """``word`` for every run of letters of every text, after slips."""
    lower = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
                       F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    runs = runs.withColumn("h", h)
    place = (F.col("h") % F.length("run")).cast("int")
    left = F.concat(F.substring("run", F.lit(1), place), F.expr("substring(run, cast(h % length(run) as int) + 2)"))
    return runs.select(F.when(F.col("h") % SLIP == 0, left).otherwise(F.col("run")).alias("word"))


def words(docs: DataFrame, length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    counts = occurrences(docs).filter(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= times)


def dictionary(vocabulary: DataFrame, common: int = COMMON, most: int = GRAMS) -> dict[str, int]:
    """The grams to be extended (and, of the longest, those in very many places) with their counts.

    Of each length only grams in more than ``common`` places and in more than a ``most``-th of all places count, so no
    length has more than ``most`` grams.
    """
    ends = F.concat(F.lit(BEGIN), F.col("word"), F.lit(END))
    found: dict[str, int] = {}
    places = vocabulary.agg(F.sum(F.length("word") + 1).alias("n")).first()["n"] or 0
    least = max(common, places // most)
    for size in range(SHORT, LONG + 1):
        start = F.explode(F.sequence(F.lit(1), F.greatest(F.length("ends") - size + 1, F.lit(1))))
        grams = vocabulary.select(ends.alias("ends")).select("ends", start.alias("at")).select(
            F.expr(f"substring(ends, at, {size})").alias("gram"))
        frequent = grams.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > least)
        found.update({r["gram"]: r["n"] for r in frequent.toLocalIterator()})
    return found


def grams_of(word: str, known: dict[str, int]) -> list[tuple[int, str]]:
    """(place, gram): at each place the shortest gram that is not in the dictionary, or the longest there is."""
    whole = BEGIN + word + END
    out = []
    for at in range(len(whole) - SHORT + 1):
        size = SHORT
        while size < LONG and at + size < len(whole) and whole[at: at + size] in known:
            size += 1
        out.append((at, whole[at: at + size]))
    return out


def affected(grams: list[tuple[int, str]], length: int) -> int:
    """Most grams that one edit can change: those that cover one place, or the gap before the word's end.

    An insertion between two places changes grams that cover both, which are some of those that cover either.
    """
    cover = [0] * (length + 2)
    for at, gram in grams:
        for place in range(at, at + len(gram)):
            cover[place] += 1
    return max(cover[1: length + 1], default=0)


def _keys(word: str, known: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(list, side) of a word: lists of words of its own length, and of one more or less.

    In a list of one length the side is 0, in one of two lengths 1 for the shorter words and 2 for the longer ones.
    """
    grams = grams_of(word, known)
    n, a = len(word), affected(grams, len(word))
    # any fixed order serves that is the same for all words; rare grams first makes the lists short
    rare = sorted(grams, key=lambda g: (known.get(g[1], 0), -len(g[1]), g[1], g[0]))[: a + 1]
    for at, gram in rare:
        from_end = n - at
        yield f"={n}:{at}:{gram}", 0
        for short, side in ((n, 1), (n - 1, 2)):
            yield f"<{short}:{at}:{gram}", side
            yield f">{short}:{from_end}:{gram}", side


def index(vocabulary: DataFrame, known: dict[str, int]) -> DataFrame:
    """list (a 64-bit hash of gram, place and length), side, word: the short lists of all words."""
    held = vocabulary.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = held.value
        for batch in batches:
            lists, sides, own = [], [], []
            for word in batch.column(0).to_pylist():
                for key, side in _keys(word, have):
                    lists.append(xxhash.xxh64_intdigest(key.encode()) - (1 << 63))
                    sides.append(side)
                    own.append(word)
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), pa.array(sides, pa.int32()), pa.array(own, pa.string())],
                                             ["list", "side", "word"])

    return vocabulary.select("word").mapInArrow(run, "list long, side int, word string")


def _joined(left: DataFrame, right: DataFrame, on: str | Column, how: str = "inner") -> DataFrame:
    """A join by sorting, never a broadcast.

    Spark takes a table's size from its packed file and does not count the rows that an explode adds, so what it expects to
    be small enough to broadcast can be many times that and not fit into the driver.
    """
    return left.join(right.hint("merge"), on, how)


def _one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def _pairs(lists: DataFrame) -> DataFrame:
    """Word pairs one edit apart that stand in one list; ``side`` 0 is equal lengths, 1 with 2 is one more."""
    other = lists.select(F.col("list").alias("__list"), F.col("side").alias("__side"), F.col("word").alias("b"))
    met = (F.col("list") == F.col("__list")) & (((F.col("side") == 0) & (F.col("__side") == 0) & (F.col("word") < F.col("b")))
                                                 | ((F.col("side") == 1) & (F.col("__side") == 2)))
    return _joined(lists, other, met).filter(_one_edit(F.col("word"), F.col("b"))).select(F.col("word").alias("a"), "b")


def _by_rests(vocabulary: DataFrame) -> DataFrame:
    """Word pairs one edit apart by equal rests: the word itself, or the word without one character.

    Words that share a rest differ by one edit, or by a deletion and an insertion elsewhere, which the distance tells. Rests
    are hashed and words numbered, so that a very long word is not copied for each of its places.
    """
    known = checkpointed(vocabulary.select("word", F.monotonically_increasing_id().alias("id")))
    rest = F.expr("xxhash64(if(at = 0, word, concat(substring(word, 1, at - 1), substring(word, at + 1))))")
    rests = known.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("word")))).select("id", rest.alias("rest")).distinct()
    other = rests.select(F.col("rest").alias("__rest"), F.col("id").alias("other"))
    met = _joined(rests, other, (F.col("rest") == F.col("__rest")) & (F.col("id") < F.col("other"))).select("id", "other").distinct()
    met = _joined(met, known.withColumnRenamed("word", "a"), "id")
    met = _joined(met, known.select(F.col("id").alias("other"), F.col("word").alias("b")), "other")
    return met.filter(_one_edit(F.col("a"), F.col("b"))).select("a", "b")


def links(vocabulary: DataFrame, common: int = COMMON, most: int = GRAMS, longest: int = LIST) -> DataFrame:
    """a, b: every pair of near words, in both orders."""
    known = dictionary(vocabulary, common, most)
    lists = checkpointed(index(vocabulary, known))
    sizes = lists.groupBy("list").agg(F.count("*").alias("n")).filter("n > 1")
    # a list of one word links nothing
    short = _joined(lists, sizes.filter(F.col("n") <= longest).select("list"), "list", "left_semi")
    found = _pairs(short)
    long = checkpointed(sizes.filter(F.col("n") > longest).select("list"))
    if not long.isEmpty():
        crowded = lists.join(long, "list", "left_semi").select("word").distinct()
        found = found.unionByName(_by_rests(checkpointed(crowded)))
    found = checkpointed(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for all of ``word, form``: forms are followed to the last one.

    A form has at least twice the occurrences, so a chain has at most 63 steps and doubling the stride ends in six rounds.
    """
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        now = checkpointed(_joined(now, ahead, F.col("root") == F.col("__at"), "left").select(
            "word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")))
        moved = not now.filter("moved").isEmpty()
        now = now.drop("moved")
        if not moved:
            return now


def variants(docs: DataFrame, length: int = LENGTH, times: int = TIMES, larger: int = LARGER, **index_options: int) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``, which has doc_id and text.

    The form of a word is its near word with most occurrences (ties: first in code point order) if it has ``larger`` times
    as many; the root is the end of the chain of forms.
    """
    vocabulary = checkpointed(words(docs, length, times))
    near = links(vocabulary, **index_options)
    counts = vocabulary.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    # a word has at most (2 * length + 1) near words for each character of the alphabet
    best = _joined(near, counts, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("b_n"), F.col("b"))).alias("best"))
    best = best.select(F.col("a").alias("word"), "n_near", F.col("best.b").alias("near"), (-F.col("best.col1")).alias("near_n"))
    told = checkpointed(_joined(vocabulary, best, "word", "left").withColumn("is_form", F.coalesce(F.col("near_n") >= larger * F.col("n"), F.lit(False))))
    told = told.withColumns({"form": F.when(F.col("is_form"), F.col("near")), "form_n": F.when(F.col("is_form"), F.col("near_n"))})
    ends = roots(told.filter("is_form").select("word", "form"))
    return _joined(told, ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
