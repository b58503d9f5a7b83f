"""Spelling variants against comparing all pairs of words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinpanel.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, side int, list string"


def near(vocabulary):
    """Near words of each word by comparing all words of similar length."""
    by_length = defaultdict(list)
    for word in vocabulary:
        by_length[len(word)].append(word)
    out = {w: set() for w in vocabulary}
    for n, own in by_length.items():
        for i, a in enumerate(own):
            same = [b for b in own[i + 1:] if sum(x != y for x, y in zip(a, b)) == 1]
            longer = [b for b in by_length.get(n + 1, []) if any(b[:k] + b[k + 1:] == a for k in range(n + 1))]
            for b in same + longer:
                out[a].add(b)
                out[b].add(a)
    return out


def brute(pairs):
    counts = Counter()
    lower = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
    for doc, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    links, form = near(n), {}
    for w in n:
        if links[w]:
            best = min(links[w], key=lambda b: (-n[b], b))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(links[w]), n[form[w]] if w in form else None))
    return sorted(out)


def found(spark, pairs, **more):
    df = spark.createDataFrame([(*p, "w", 1, 2, "l") for p in pairs], SCHEMA)
    return sorted(tuple(r) for r in spelling.variants(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus(rng, docs, bases, alphabet="abcéÀ"):
    words = []
    for _ in range(bases):
        base = "".join(rng.choice(alphabet) for _ in range(rng.randrange(4, 9)))
        words += [base] * rng.choice([1, 4, 30])
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(base))
            words += [rng.choice([base[:k] + base[k + 1:], base[:k] + rng.choice(alphabet) + base[k:],
                                  base[:k] + rng.choice(alphabet) + base[k + 1:]])] * rng.choice([2, 3, 7])
    rng.shuffle(words)
    return [(i, " ".join(words[i::docs])) for i in range(docs)]


@pytest.mark.parametrize("options", [{}, {"common": 3, "longest": 2}])
def test_all_pairs_one_edit_apart_are_found(spark, options):
    pairs = corpus(random.Random(5), 40, 300)
    want = brute(pairs)
    assert found(spark, pairs, **options) == want
    assert sum(w[4] for w in want) > 300 and sum(w[1] is not None and w[2] != w[1] for w in want) > 0


def test_template_words_share_a_list_and_are_still_linked(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LIST", 10)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pairs = [(i, f"product{a}{b}name product{a}{b}name product{a}{b}name") for i, (a, b) in enumerate(zip(letters * 3, letters + letters[5:] + letters))]
    assert found(spark, pairs, longest=10) == brute(pairs)


def test_no_words_lists_or_rests_are_broadcast(spark, monkeypatch):
    """Their tables grow with the corpus, however small Spark takes them for; only the names of long lists may be broadcast."""
    plans = []

    def planned(df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return written(df)

    written = spelling.checkpointed
    monkeypatch.setattr(spelling, "checkpointed", planned)
    pairs = corpus(random.Random(5), 40, 60)
    df = spark.createDataFrame([(*p, "w", 1, 2, "l") for p in pairs], SCHEMA)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    last = spelling.variants(df, common=3, longest=2)
    plans.append((last.columns, last._jdf.queryExecution().executedPlan().toString()))
    assert sum("SortMergeJoin" in plan for _, plan in plans) >= 4
    assert {tuple(columns) for columns, plan in plans if "BroadcastExchange" in plan} <= {("word",)}
    assert sorted(map(tuple, last.collect())) == brute(pairs)


def test_odd_texts(spark):
    pairs = [(None, None), (1, ""), (2, "  12 ??"), (None, "Größe größe GRÖßE größer"), (3, "x" * 50_000), (3, "x" * 50_000), (4, "x" * 50_000),
             (5, "x" * 49_999 + " " + "x" * 49_999 + " " + "x" * 49_999), (6, "größe größer größer ÷×÷×÷ ÷×÷×÷ ÷×÷×÷"), (6, "größe größer größer")]
    got = found(spark, pairs)
    assert got == brute(pairs) and any(len(w[0]) == 50_000 and w[4] == 1 for w in got)
    assert found(spark, []) == []


def test_grams_that_an_edit_leaves_alone():
    """The bound: after any one edit at least as many grams as promised are left, aligned with the beginning or end."""
    rng = random.Random(3)
    known = {"ab": 9, "ba": 8, "\x02a": 7, "aba": 5, "b\x03": 4, "bb": 3}
    for _ in range(500):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(5, 10)))
        grams = spelling.grams_of(word, known)
        most = spelling.affected(grams, len(word))
        k, c = rng.randrange(len(word) + 1), rng.choice("abcd")
        for other in (word[:k] + word[k + 1:], word[:k] + c + word[k:], word[:k] + c + word[k + 1:]):
            theirs = spelling.grams_of(other, known)
            start = {(at, g) for at, g in theirs}
            end = {(len(other) - at, g) for at, g in theirs}
            kept = sum((at, g) in start or (len(word) - at, g) in end for at, g in grams)
            assert kept >= len(grams) - most >= 2


def test_the_dictionary_is_bounded(spark):
    words = spark.createDataFrame([(f"{a}{b}{c}word", 3) for a in "abcdef" for b in "abcdef" for c in "abcdef"], "word string, n long")
    known = spelling.dictionary(words, common=0, most=10)
    assert known and max(Counter(map(len, known)).values()) <= 10
    assert known["wo"] == 216 == words.select(F.count("*")).first()[0]
