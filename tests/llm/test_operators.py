"""The operators on small tables: brute force, round trips, held-out accuracy, and odd rows."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinpanel.llm import ann, chosenpath, common, gru, induced, mixing, paragraphs, quality, sql, suffixes, toxicity, warc, wumanber
from kinpanel.llm.common import WordHashes, connected_components, mixed, shingle_hashes, union_find, word_arrays
from kinpanel.session import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, stamp string, spans int, key int"


@pytest.fixture
def docs(spark):
    """docs([(doc_id, text), ...], source=...) with further columns whose names the operators use themselves."""
    def make(pairs, lang=None, source="s"):
        data = [(i, t, lang, source, len(t or ""), "x", 1, 2) for i, t in pairs]
        return spark.createDataFrame(data, DOCS)
    return make


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(words))


ODD = [(None, None), (None, "lone words here"), (1, None), (2, ""), (3, " \n\t"), (3, " \n\t"), (4, "one"), (4, "one"), (5, "***")]


# --- 1: nearest neighbours

VECTORS = "vec_id long, embedding array<float>, label int, key string, part int"


def test_nearest_finds_nearly_all_and_scores_exactly(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = np.float32(centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.3)
    data = [(i, v.tolist(), 0, "k", 1) for i, v in enumerate(x)]
    monkeypatch.setattr(ann, "PART", 200)
    monkeypatch.setattr(ann, "BLOCK", 100)
    rows = spark.createDataFrame(data, VECTORS)
    found = ann.nearest(rows, rows.filter("vec_id % 100 = 0")).collect()
    hit, at = 0, collections.defaultdict(list)
    for r in found:
        at[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x = x.astype(float)
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        own = sorted(at[q])
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert all(abs(d[i] - s) < 1e-12 for _, i, s in own) and [s for *_, s in own] == sorted(s for *_, s in own)
        d[q] = np.inf
        hit += len({i for _, i, _ in own} & set(np.lexsort((np.arange(3000), d))[:10].tolist()))
    assert hit >= 0.9 * 300


def test_nearest_odd_vectors(spark):
    same = [1.0, 0.0]
    data = [(0, same), (100, same), (7, same), (7, same), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]),
            (8, [float("nan"), 1.0]), (9, [1.0, 2.0, 3.0]), (None, same)]
    rows = spark.createDataFrame([(*d, 0, "k", 1) for d in data], VECTORS)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(rows, rows.filter("vec_id % 100 = 0")).collect()]
    assert sorted(got) == [(0, 1, 7), (0, 2, 100), (0, 3, 3), (100, 1, 0), (100, 2, 7), (100, 3, 3)]
    assert ann.nearest(rows.limit(0), rows.limit(0)).count() == 0


def test_queries_whose_parts_hold_few_vectors_still_get_all_they_ask_for(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(ann, "PART", 6)
    monkeypatch.setattr(ann, "LEARN", 6)
    monkeypatch.setattr(ann, "TARGET", 0.1)
    rows = spark.createDataFrame([(i, v.tolist(), 0, "k", 1) for i, v in enumerate(rng.normal(size=(400, 5)))], VECTORS)
    found = ann.nearest(rows, rows.filter("vec_id % 100 = 0")).groupBy("query_id").count().collect()
    assert sorted(tuple(r) for r in found) == [(q, 10) for q in (0, 100, 200, 300)]


def test_balanced_parts_are_equal_and_follow_clusters():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(8, 4)) * 9, 64, axis=0) + rng.normal(size=(512, 4))
    part = ann.balanced_parts(ann.neighbours(x, 8), 3)
    assert np.bincount(part).tolist() == [64] * 8
    near = ann.neighbours(x, 8)
    assert (part[near] == part[:, None]).mean() > 0.8


# --- 2: language

def test_gradients_match_differences():
    model = gru.Model(["a", "b"], hidden=3)
    for part in (model.ahead, model.behind):
        for name in ("x", "u", "b", "out"):
            setattr(part, name, getattr(part, name).astype(np.float64))
    words, y = [b" abc ", b" de ", b" fghij "], np.array([0, 1, 0])
    _, grads = model.gradients(words, y)
    for p, g in zip(model.parameters(), grads):
        i = np.unravel_index(np.argmax(abs(g)), g.shape)
        old, out = p[i], []
        for step in (1e-3, -1e-3):
            p[i] = old + step
            out.append(model.gradients(words, y)[0])
        p[i] = old
        assert abs(g[i] - (out[0] - out[1]) / 2e-3) < 1e-4 * max(1, abs(g[i]))


def test_language_held_out_and_odd_rows(spark, docs):
    rng = random.Random(3)
    syllables = {"aa": ["ka", "ro", "ti", "mu"], "bb": ["sch", "ei", "ung", "pf"]}
    pairs = {lang: ["".join(rng.choices(s, k=rng.randint(2, 4))) for _ in range(3000)] for lang, s in syllables.items()}
    known = None
    for lang, words in pairs.items():
        own = docs([(i, " ".join(rng.sample(words, 30))) for i in range(40)], lang=lang)
        known = own if known is None else known.union(own)
    model = gru.train(known, ~gru.fold(3, 1))
    found = gru.identify(known, model)
    assert found.columns == [*known.columns, "lang_pred", "lang_score"]
    assert found.filter("lang <> lang_pred").count() == 0
    odd = gru.identify(docs(ODD), model).select("text", "lang_pred", "lang_score").collect()
    assert len(odd) == len(ODD)
    for r in odd:
        assert (r["lang_pred"] == "und" and r["lang_score"] == 0) == (not any(c.isalpha() for c in r["text"] or ""))
    assert {r["lang_pred"] for r in gru.identify(docs(ODD), gru.train(docs(ODD))).collect()} == {"und"}
    long = gru.identify(docs([(1, " ".join(pairs["bb"]) * 40)]), model).first()
    assert long["lang_pred"] == "bb"


def test_every_position_has_a_distribution():
    model = gru.Model(["a", "b", "c"])
    p, _ = model.positions([b" abc ", b" d "])
    assert p.shape == (5, 2, 3) and np.allclose(p.sum(2), 1)


def test_number_signs_are_no_letters():
    assert gru.letter_runs("½ ² Ⅷ 12 _") == [] and gru.letter_runs("Ab½é c") == ["ab", "é", "c"]


def test_doubled_letters_are_read_as_by_the_lattice():
    words = ["stupid", "idiot", "moon", "good", "book", "trees", "aaron", "llama"]
    grams = collections.Counter(g for w in words for w in ("^^" + w + "^",) for g in (w[i:i + 3] for i in range(len(w) - 2)))
    language, rng = toxicity.Language(grams), random.Random(8)
    for _ in range(300):
        word = "".join(c * rng.choice([1, 1, 2, 3]) for c in rng.choice(words))
        if sum(a == b for a, b in zip(word, word[1:])) <= 4:
            assert language._undoubled(word) == language.readings(word)


def test_very_long_tokens_are_read_to_their_end():
    language = toxicity.Language(collections.Counter({g: 5 for w in ("^^you^", "^^idiot^") for g in (w[i:i + 3] for i in range(len(w) - 2))}))
    assert len(language.words("4b" * 30_000)) > 1
    assert "idiot" in " ".join(language.restored("x " + "y " * 30_000 + "1 d 1 0 t", {})).replace(" ", "")


# --- 3: toxicity

@pytest.fixture(scope="module")
def language():
    counts = collections.Counter()
    for word, n in [("stupid", 9), ("idiot", 9), ("moron", 9), ("the", 200), ("and", 100), ("hello", 20), ("trash", 9)]:
        w = f"^^{word}^"
        for i in range(len(w) - 2):
            counts[w[i:i + 3]] += n
    return toxicity.Language(counts)


@pytest.mark.parametrize("written, meant", [
    ("1d10t", "idiot"), ("$tup1d", "stupid"), ("stuuuupid", "stupid"), ("m0r0n!!", "moron"), ("s.t.u.p.i.d", "stupid"), ("tr@sh", "trash"),
    ("hello,", "hello")])
def test_words_are_restored(language, written, meant):
    assert meant in language.restored(f"the {written} and", {})


@pytest.mark.parametrize("written, meant", [
    ("stuupid", "stupid"), ("iidiot", "idiot"), ("mooron", "moron"), ("$$$tupid", "stupid"), ("i - d - i - o - t", "idiot"),
    ("m  o  r  o  n", "moron"), ("m..o..r..o..n", "moron"), ("-" * 5000 + "x", "x")])
def test_doubled_marked_and_widely_spaced_words_are_restored(language, written, meant):
    assert meant in language.restored(f"the {written} and", {})


def test_spaced_words_are_restored(language):
    assert {"idiot", "stupid"} <= language.restored("you i d i o t and s-t-u-p-i-d", {})
    assert language.restored(None, {}) == set() == language.restored("", {})


def test_toxicity_learns_from_labels_alone(spark, docs):
    rng = random.Random(5)
    pairs, labels = [], []
    for i in range(200):
        bad = i % 5 == 0
        pairs.append((i, prose(rng, 40).replace("x", "") + (" stupid thing" if bad else " fine thing")))
        labels.append((i, 1, int(bad)))
    table = docs(pairs)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(table, marks, ~gru.fold(5, 0))
    tests = docs([(1000, "some stup1d words"), (1001, "some fine words"), (1002, "s t u p i d"), *ODD])
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(tests, model).collect()}
    assert got[1000] > 0.5 and got[1002] > 0.5 and got[1001] < 0.5 and got[2] < 0.5 and got[1] < 0.5
    none = toxicity.train(table, marks.limit(0))
    assert all(r["toxicity"] < 0.5 for r in toxicity.score(docs(ODD), none).collect())


def test_trigrams_of_all_words_of_letters(spark, docs, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abÉ÷œ_1Σİ漢½Ⅷß^?\x1c\x85\u200b  \n\U0001F600\U00010400") for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += ["", None, " ", "İx ΑΣ ½a", "x" * 50]
    want = collections.Counter()
    for word in (w for t in texts for w in (t or "").lower().split()):
        if toxicity._CLEAN.fullmatch(word):
            padded = f"^^{toxicity.plain(word)}^"
            want.update(padded[i:i + 3] for i in range(len(padded) - 2))
    assert toxicity.character_counts(docs(list(enumerate(texts))).repartition(3)) == want
    assert toxicity.character_counts(docs([(1, None), (2, "")])) == {}
    monkeypatch.setattr(toxicity, "CHUNK", 40)
    for long in [" ".join(t.lower() for t in texts if t), "x" * 100, "x" * 60 + " " + "y" * 60, " " * 100]:
        cut = list(toxicity.pieces(long))
        assert "".join(cut) == long and (sum(map(toxicity.trigrams, ([p] for p in cut))) == toxicity.trigrams([long])).all()


def test_words_with_doubled_letters_have_all_their_readings(language):
    for word in ["stuupid", "iiddiioott", "mooron", "aaa", "ßßé", "off", "llllama", "aabbccdd", "b" * 50]:
        assert set(language.words(word)) == {word, *language.readings(word)}


def test_words_without_weight_are_looked_at_once(language, monkeypatch):
    """A word that stands in many documents is restored and compared with the weights once in a task, with the same scores."""
    weights = {"stupid": 2.0, "idiot": 1.5, "hello": -0.3, "moron": 0.7, "stupi-": 0.11}
    model, rng = toxicity.Model(language, weights, -1.0), random.Random(9)
    tokens = ["stup1d", "hello,", "moron", "i d i o t", "the", "and", "trash!", "stuupid", *(f"w{i}" for i in range(40))]
    texts = [None, "", *(" ".join(rng.choices(tokens, k=30)) for _ in range(100))]
    want = []
    for text in texts:
        found = toxicity.features(language.restored(text, {})) & weights.keys()
        want.append(1 / (1 + np.exp(1.0 - sum(weights[f] for f in sorted(found)))))
    seen = []
    plain_features = toxicity.features
    monkeypatch.setattr(toxicity, "features", lambda words: seen.extend(words) or plain_features(words))
    got = model.scores(texts, {}, set())
    assert np.allclose(got, want, rtol=1e-12) and len(set(got)) > 3
    assert seen.count("moron") == seen.count("and") == 1


# --- 4: WARC

def test_archive_round_trip_with_magic_inside(spark):
    fake = "<p>WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nmore"
    far = "x WARC/1.0\r\nContent-Length: 999999999\r\n\r\ny"
    data = [(1, "http://a/", fake), (2, None, fake), (3, "u r l", ""), (4, "u", None), (5, "u", far), (6, "u", "é" * 70_000 + "WARC/1.0\r\n"),
            (7, "u", "plain"), (7, "u", "plain"), (None, "u", "plain"), (None, "u", "lone"), *[(k, "u", f"page {k} " * 300) for k in range(10, 60)]]
    data = [(*d, 1, "x") for d in data]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, block int, seq string").repartition(3)
    path = scratch_path(spark, "test-warc")
    warc.write_archive(pages, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = warc.read_records(spark, path).select(
            warc.page_of("record_id").alias("page"), "payload_bytes", "payload_digest", "type", warc.page_of("refers_to").alias("to")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    first = {}
    for page, _, html, *_ in data:
        body = (html or "").encode()
        if page is not None:
            first[body] = min(page, first.get(body, page))
    want = []
    for page, _, html, *_ in data:
        body = (html or "").encode()
        to = first.get(body)
        again = to is not None and page != to
        import base64
        want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", to if again else None))
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)


def test_empty_archive(spark):
    path = scratch_path(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_records(spark, path).count() == 0


# --- 5: mixing

def test_mix_hits_targets_and_agrees_with_sql(spark):
    rng = random.Random(7)
    data = [(i, prose(rng, rng.choice([0, 1, 5, 60, 400])), rng.choice(["a", "b", "b", "b", "c", "d", None]), i) for i in range(600)]
    data += [(None, "same text", "a", 1)] * 30 + [(9, None, "zz", 1), (5, "", None, 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size int")
    got = mixing.mix(df)
    listed = sorted(map(tuple, got.select("doc_id", "source", "size", "source_size", "copies", "taken").collect()), key=str)
    con = duckdb.connect()
    con.register("t", df.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(f"SELECT doc_id, source, size, source_size, copies, taken FROM ({sql.MIX.format(docs='t')})").fetchall()
    assert listed == sorted(want, key=str)
    for r in got.groupBy("source").agg({"taken": "sum", "target": "max", "size": "max", "copies": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"] / 2 + 1 and r["max(copies)"] <= 3
    assert mixing.mix(df.limit(0)).count() == 0


# --- 6: near-duplicates

def near_brute(pairs, width, percent):
    sets = []
    for _, text in pairs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(pairs)))

    def top(i):
        return i if parent[i] == i else top(parent[i])

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    groups = collections.defaultdict(list)
    for i in range(len(pairs)):
        groups[top(i)].append(i)
    out = []
    for members in groups.values():
        ids = [pairs[i][0] for i in members if pairs[i][0] is not None]
        out += [(pairs[i][0], len(sets[i]), min(ids) if ids else None) for i in members]
    return sorted(out, key=str)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("width, percent, limit", [(3, 85, 200), (5, 80, 6)])
def test_near_duplicates_match_brute_force(docs, monkeypatch, width, percent, limit):
    """With a limit of 6, groups are larger than a task's share and take the ways for large ones."""
    monkeypatch.setattr(chosenpath, "LIMIT", limit)
    rng = random.Random(11)
    pairs = list(ODD)
    for g in range(12):
        base = prose(rng, rng.choice([3, 30, 200, 900]), 5000)
        for k in range(rng.choice([1, 3, 40])):
            pairs.append((100 * (g + 1) + k, edited(rng, base, rng.choice([0, 1, 2, len(base.split()) // 40]))))
    pairs.append((5000, prose(rng, 60_000, 9000)))
    pairs.append((5001, edited(rng, pairs[-1][1], 300)))
    found = chosenpath.near_duplicates(docs(pairs), width, percent).cache()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=str)
    assert got == near_brute(pairs, width, percent)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in found.collect())
    found.unpersist()


def test_classes_of_two_blocks_of_a_node_meet(spark, monkeypatch):
    """60 pairs of equal sketches in one node that is cut into blocks; sketches of two pairs agree too little."""
    monkeypatch.setattr(chosenpath, "LEVELS", 1)
    monkeypatch.setattr(chosenpath, "LIMIT", 4)
    monkeypatch.setattr(chosenpath, "SHARED", 1)
    rng = np.random.RandomState(3)
    common = rng.randint(0, 2**32, chosenpath.COORDINATES, dtype=np.uint32)
    data = []
    for pair in range(60):
        # the coordinates that the trees choose first are equal in all
        own = np.where(rng.rand(len(common)) < 0.4, common, rng.randint(0, 2**32, len(common), dtype=np.uint32))
        own[chosen_first()] = common[chosen_first()]
        data += [(bytes([pair, side]), own.astype(np.uint32).tobytes(), 100) for side in (0, 1)]
    classes = spark.createDataFrame(data, "digest binary, sketch binary, n_shingles long")
    got = {bytes(r["digest"]): bytes(r["root"]) for r in chosenpath.maybe_connected(classes, 85).collect()}
    assert got == {d: bytes([d[0], 0]) for d, _, _ in data}


def chosen_first():
    seeds = mixed(np.arange(1, chosenpath.TREES + 1, dtype=np.uint64) * np.uint64(0x51ED27))
    return ((seeds >> np.uint64(7)) % np.uint64(chosenpath.COORDINATES)).astype(int)


def test_no_documents(docs):
    assert chosenpath.near_duplicates(docs([])).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (60, 61), (61, 60)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {**{i: 0 for i in range(51)}, **{1000 + i: 1000 for i in range(200)}, 60: 60, 61: 60}
    assert got == want


def test_few_edges_are_written_as_few_files(spark):
    kept = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        found = connected_components(spark.createDataFrame([(i, i // 2) for i in range(1, 200)], "a long, b long"))
        assert {r["root"] for r in found.collect()} == {0} and found.count() == 200
        assert len(found.inputFiles()) == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# --- 7: quality

def test_quality_needs_no_labels(docs):
    rng = random.Random(13)
    good = [" ".join("".join(rng.choices("aeioulnrst", k=rng.randint(3, 8))) for _ in range(60)) + "." for _ in range(150)]
    bad = ["spam " * 60, *[" ".join(w + "***" for w in g.split()) for g in good[:15]], *[" ".join(w.upper() + "!!" for w in g.split()) for g in good[15:30]]]
    table = docs([(i, t) for i, t in enumerate(good + bad)])
    model = quality.train(table)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(table, model).collect()}
    right = sum((got[i] >= 0.5) == (i < len(good)) for i in got) / len(got)
    assert right > 0.95
    odd = quality.score(docs(ODD), model)
    assert odd.count() == len(ODD) and odd.filter("weak_label IS NULL OR quality_score IS NULL").count() == 0
    assert quality.score(docs([]), quality.train(docs([]))).count() == 0


def test_usual_words_are_weighed_without_patterns(monkeypatch):
    """Weights are those of a word's slots, whichever way it goes; the patterns run for unusual words only."""
    words = ["plain", "plain.", "Large", "Éreréé,", "x", "X", "a1", "A-b", "***", "aÀ", "ªb", "Œuf", "×a", "NO!", "Ab!!", "."]
    weights = np.random.RandomState(1).randn(quality.SLOTS + quality.EXTRA)
    want = [float(weights[list(quality.slots(w))].sum()) for w in words]
    seen, shape = [], quality.shape
    monkeypatch.setattr(quality, "shape", lambda w: seen.append(w) or shape(w))
    known = quality.Model({}, weights, 0.0, 0.5, None).words()
    assert [float(known.measures(known.numbers([w]))[5]) for w in words] == want
    assert not {"plain", "plain.", "Large", "Éreréé,", "x"} & set(seen)


def test_accuracies_are_found():
    """Votes drawn with known accuracies of three labellers."""
    rng = random.Random(17)
    names = len(quality.LABELLERS)
    right = [0.95, 0.85, 0.75] + [0.9] * (names - 3)
    counts = collections.Counter()
    for _ in range(20_000):
        y = rng.random() < 0.7
        counts[tuple((1 if y == (rng.random() < r) else -1) for r in right)] += 1
    prior, table, _ = quality.accuracies(counts)
    assert abs(prior - 0.7) < 0.03
    assert all(abs(table[k, 1, 2] - r) < 0.03 and abs(table[k, 0, 0] - r) < 0.03 for k, r in enumerate(right))


# --- 8: repeated passages

def passages_brute(pairs):
    """(doc_id, removed words) with the paragraphs of the module, all pairs of them, and plain sets."""
    memo, windows = WordHashes(), []
    for n, (doc_id, text) in enumerate(pairs):
        for _, _, words, counts in word_arrays([(text or "").encode()], memo):
            _, at = paragraphs.anchors(words, counts)
            shingles = shingle_hashes(words, paragraphs.WIDTH)
            for a in at.tolist():
                begin = a - paragraphs.SPAN // 2
                windows.append((doc_id, n, begin, frozenset(shingles[begin:begin + paragraphs.SPAN - paragraphs.WIDTH + 1].tolist())))
    parent = list(range(len(windows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = collections.defaultdict(list)
    for i, (*_, s) in enumerate(windows):
        for j in {j for v in s for j in by[v]}:
            b = windows[j][3]
            if 100 * len(s & b) >= paragraphs.PERCENT * len(s | b):
                parent[max(top(i), top(j))] = min(top(i), top(j))
        for v in s:
            by[v].append(i)
    groups = collections.defaultdict(list)
    for i in range(len(windows)):
        groups[top(i)].append(i)
    cuts, stays = collections.defaultdict(list), collections.defaultdict(list)
    for members in groups.values():
        if len(members) > 1:
            first = min(members, key=lambda i: (windows[i][0], windows[i][2]))
            for i in members:
                (stays if i == first else cuts)[windows[i][1]].append(windows[i][2])
    return [(doc_id, sum(b - a for a, b in paragraphs.spans(cuts[n], stays[n]))) for n, (doc_id, _) in enumerate(pairs)]


@pytest.mark.parametrize("limit", [200, 5])
def test_repeated_passages_match_brute_force(docs, monkeypatch, limit):
    monkeypatch.setattr(paragraphs, "LIMIT", limit)
    monkeypatch.setattr(chosenpath, "LIMIT", limit)
    rng = random.Random(19)
    passage = [prose(rng, 70, 9000) for _ in range(3)]
    line = prose(rng, 12, 9000)
    pairs = []
    for i in range(90):
        text = prose(rng, rng.choice([10, 60, 150]), 9000)
        if i % 3 == 0:
            own = passage[i % 4 % 3]
            text += "\n" + (edited(rng, own, 1) if i % 2 else own) + " " + prose(rng, 30, 9000)
        if i % 2:
            text = text + " " + line + " " + prose(rng, 40, 9000)
        pairs.append((i, text))
    found = paragraphs.removed(docs(pairs))
    got = sorted((r["doc_id"], r["n_removed"]) for r in found.collect())
    want = passages_brute(pairs)
    same = sum(a == b for a, b in zip(got, want)) / len(want)
    assert same == 1 if limit == 200 else same > 0.95
    caught = {i for i, n in got if n > 0}
    assert {i for i in range(1, 90) if i % 3 == 0 and i > 4} <= caught | {i for i, n in want if n == 0}


def test_cut_texts_and_odd_rows(docs):
    rng = random.Random(23)
    passage = prose(rng, 80, 9000)
    pairs = [(1, "Start, " + passage + " end."), (2, "Other start " + passage + "\nother end"), *ODD]
    rows = paragraphs.without_repeats(docs(pairs))
    assert rows.columns == docs(pairs).columns
    got = {r["doc_id"]: r["text"] for r in rows.filter("doc_id IN (1, 2) AND length(text) > 5").collect()}
    assert got[1] == pairs[0][1] and got[2].startswith("Other start ") and got[2].endswith("\nother end")
    assert len(got[2].split()) < 70  # at least one paragraph of the 80 words
    left = [(r["doc_id"], r["text"]) for r in paragraphs.without_repeats(docs(ODD)).collect()]
    assert sorted(left, key=str) == sorted(ODD, key=str)
    assert paragraphs.removed(docs([])).count() == 0


def test_bands_reach_the_recall():
    bands, rows = paragraphs.tuned(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= paragraphs.RECALL


def test_copies_go_on_once_not_once_per_band(docs):
    rng = random.Random(29)
    passage = prose(rng, 200, 10**7)
    rows = docs([(i, prose(rng, 40, 10**7) + " " + passage + " " + prose(rng, 40, 10**7)) for i in range(5)])
    bands, per_band = paragraphs.tuned(paragraphs.least_similarity(17, 80))
    found = paragraphs.shared_keys(paragraphs.keyed(rows, bands, per_band)).collect()
    # paragraphs that overlap may be near each other
    far = [(r["doc_id"], r["start"]) for r in found if not r["near"]]
    assert bands > 1 and len(far) == len(set(far)) > 20
    copies = {c: {r["doc_id"] for r in found if r["content"] == c} for c in {r["content"] for r in found}}
    assert sum(len(ids) == 5 for ids in copies.values()) >= 5


def test_runs_are_judged_as_pair_by_pair(monkeypatch):
    monkeypatch.setattr(paragraphs, "RUN", 7)
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 10, 2000)
    key = np.repeat(np.arange(2000) // 2 * 4 + rng.integers(0, 2), sizes)
    runs = np.repeat(np.arange(2000) % 2, sizes).astype(np.int32)
    content = rng.integers(0, 4, len(key))
    sketch = rng.integers(0, 2**63, 4, dtype=np.uint64)
    sketch[1] = sketch[0] ^ np.uint64(2**paragraphs.DIFFER - 1)
    sketch[2] = sketch[0] ^ np.uint64(2**(paragraphs.DIFFER + 1) - 1) << np.uint64(20)
    for odd in (0, 1):
        kept, near = paragraphs._judged(key | 1 if odd else key & ~1, runs, content, sketch[content])
        end = 0
        for size in sizes.tolist():
            own, end = range(end, end + size), end + size
            for i in own:
                others = [j for j in own if j != i]
                frequent = runs[i] > 0 or size >= 7
                close = any(content[j] != content[i] and int(sketch[content[i]] ^ sketch[content[j]]).bit_count() <= paragraphs.DIFFER
                            for j in others)
                assert near[i] == (frequent or close)
                assert kept[i] == (near[i] or bool(odd) and any(content[j] == content[i] for j in others))


@pytest.mark.parametrize("chunk", [4 << 20, 300, 1])
def test_words_are_hashed_as_one_by_one(monkeypatch, chunk):
    monkeypatch.setattr(common, "CHUNK_BYTES", chunk)
    rng = random.Random(1)
    texts = [None, b"", b" ", b"  a", b"a ", b"\x0b\x0c\t\n\r x", b"\xff\xfe \x80A", *(b"x" * n + b" " + b"Q" * n for n in range(80))]
    texts += [bytes(rng.choice(b" \t\n\r\x0b\x0c\x00\x1c\x85\xa0abzAZ\xc3\x84\xff0") for _ in range(rng.choice([1, 5, 50]))) for _ in range(400)]
    runs = list(word_arrays(texts, WordHashes()))
    assert [0, *(end for _, end, _, _ in runs)] == [*(first for first, *_ in runs), len(texts)]
    want = [[xxhash.xxh64_intdigest(w) for w in (t or b"").lower().split()] for t in texts]
    assert np.concatenate([words for _, _, words, _ in runs]).tolist() == [h for own in want for h in own]
    assert np.concatenate([counts for *_, counts in runs]).tolist() == [len(own) for own in want]


def test_exact_copies_go_whole(docs):
    """Against the places of the planted copies, without the module's paragraphs."""
    rng = random.Random(31)
    pairs, want = [], {}
    for k, size in enumerate([51, 60, 80, 100, 300] * 6):
        passage = prose(rng, size, 10**7)
        for copy in range(3):
            lead = rng.randrange(12, 60)
            pairs.append((3 * k + copy, prose(rng, lead, 10**7) + " " + passage + " " + prose(rng, rng.randrange(12, 60), 10**7)))
            want[3 * k + copy] = [(lead, lead + size)] if copy else []
    # a phrase of four words over and over has its anchors in every period
    phrase = prose(rng, 4, 10**7)
    for i, size in ((900, 40), (901, 40), (902, 40)):
        pairs.append((i, prose(rng, 40, 10**7) + " " + " ".join([phrase] * size) + " " + prose(rng, 40, 10**7)))
    found = {r["doc_id"]: [(s["first"], s["end"]) for s in r["spans"]] for r in paragraphs.removed(docs(pairs), whole=True).collect()}
    for i, own in want.items():
        # a paragraph of which 16 of 17 shingles are repeated goes, too: with one word of the surroundings
        assert len(found[i]) == len(own), (i, own, found[i])
        assert all(a - 1 <= x <= a and b <= y <= b + 1 for (a, b), (x, y) in zip(own, found[i])), (i, own, found[i])
    assert found[901] == found[902] == [(40, 200)] and sum(b - a for a, b in found[900]) >= 100


def test_crowded_paragraphs_are_linked_exactly(spark):
    """One key that all have, so that nothing but the exact way finds the pairs; against all pairs of plain sets."""
    rng = random.Random(37)
    common = [rng.getrandbits(64) for _ in range(12)]
    sets = [{*common, *(rng.getrandbits(64) for _ in range(rng.choice([3, 4, 5])))} for _ in range(500)]
    sets += [{*s} - {min(s)} | {rng.getrandbits(64)} for s in sets[:60]] + [{*s} - {max(s)} for s in sets[60:90]]
    data = [(i, np.sort(np.array(list(s), dtype=np.uint64)).tobytes()) for i, s in enumerate(sets)]
    described = spark.createDataFrame([(i, bytearray(b)) for i, b in data], "content long, shingles binary")
    pairs = described.select(F.lit(1).alias("key"), "content")
    edges = paragraphs.crowded_links(pairs, described, 80)
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    links = [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 100 * len(a & b) >= 80 * len(a | b)]
    top = union_find(len(sets), *zip(*links))
    assert [got.get(i, i) for i in range(len(sets))] == top.tolist() and 1 < len(set(top.tolist())) < 560
    assert {(a, b) if a < b else (b, a) for a, b in edges.collect()} <= set(links)


# --- 9: decontamination

def test_items_without_an_id_are_searched(spark, docs):
    words = [f"w{i}" for i in range(60)]
    pairs = [(1, " ".join(words[:30])), (2, " ".join(words[30:50])), (3, "nothing of it")]
    rows = [(None, " ".join(words[:15])), ("b", " ".join(words[10:25])), (None, " ".join(words[30:44]))]
    bench = spark.createDataFrame(rows, "item_id string, text string")
    con = duckdb.connect()
    con.register("documents", docs(pairs).toPandas())
    con.register("benchmark", bench.toPandas())
    want = sorted(con.execute(sql.CONTAMINATION.format(docs="documents")).fetchall())
    got = wumanber.verdicts(docs(pairs), bench)
    assert sorted(map(tuple, got.collect())) == want and want[0][2] == 25 and want[1][3] == 1


def test_a_benchmark_of_many_groups_is_written_in_between(spark, docs, monkeypatch):
    monkeypatch.setattr(wumanber, "GROUP_PATTERNS", 5)
    monkeypatch.setattr(wumanber, "PASSES", 2)
    pairs = [(i, " ".join(f"w{j}" for j in range(i, i + 40))) for i in range(20)]
    bench = spark.createDataFrame([(str(i), " ".join(f"w{j}" for j in range(i, i + 14))) for i in range(0, 60, 2)], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in wumanber.verdicts(docs(pairs), bench).collect()}
    texts, items = [t.split() for _, t in pairs], [r["text"].split() for r in bench.collect()]
    for i, words in enumerate(texts):
        runs = {tuple(words[j:j + 13]): j for j in range(len(words) - 12)}
        own = [[runs[w] for w in (tuple(t[:13]), tuple(t[1:])) if w in runs] for t in items]
        hit = {p for at in own for j in at for p in range(j, j + 13)}
        assert got[i] == (len(hit), sum(bool(a) for a in own))


def test_decontamination_matches_plain_search(spark, docs):
    rng = random.Random(29)
    items = [(i, prose(rng, rng.choice([1, 5, 13, 14, 40]), 60)) for i in range(30)] + [(77, None), (78, "--"), (None, "w1x"), (3, "W5X w6x")]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, items int")
    pairs = [(i, prose(rng, 50, 60) + " " + rng.choice(items[:30])[1].upper() + ", " + prose(rng, 50, 60)) for i in range(40)] + ODD
    windows = collections.defaultdict(set)
    for i, t in items:
        for w in wumanber.windows_of((t or "").encode()):
            windows[w].add(None if i is None else str(i))
    want = []
    for doc_id, t in pairs:
        words = wumanber.words_of((t or "").encode())
        hit, ids = set(), set()
        for w, own in windows.items():
            one = w.split()
            for k in range(len(words) - len(one) + 1):
                if words[k:k + len(one)] == one:
                    hit.update(range(k, k + len(one)))
                    ids |= own
        want.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids - {None})).encode()).hexdigest(),
                     bool(hit) and 20 * len(hit) >= len(words)))
    got = [tuple(r) for r in wumanber.verdicts(docs(pairs), bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r["n_hit"] == 0 for r in wumanber.verdicts(docs(pairs), bench.limit(0)).collect())


def test_groups_of_patterns_give_the_same(spark, docs, monkeypatch):
    rng = random.Random(31)
    items = [(i, prose(rng, 20, 50)) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = docs([(i, prose(rng, 20, 50) + " " + items[i % 20][1]) for i in range(40)])
    one = sorted(map(tuple, wumanber.verdicts(table, bench).collect()))
    monkeypatch.setattr(wumanber, "GROUP_PATTERNS", 40)
    assert sorted(map(tuple, wumanber.verdicts(table, bench).collect())) == one


# --- 10: suffixes

def test_induced_order_and_prefixes():
    rng = random.Random(37)
    for _ in range(300):
        text = [rng.randint(1, rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(1, 50))] + [0]
        cap = rng.choice([1, 3, 100])
        order, prefix = induced.sorted_suffixes(text, cap, rng.choice([4, 200_000]))
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert list(order) == want
        for k, (x, y) in enumerate(zip(want, want[1:])):
            same = next(n for n in range(len(text)) if text[x + n:x + n + 1] != text[y + n:y + n + 1])
            assert prefix[k + 1] == min(cap, same)


def bytes_brute(pairs, length):
    seen = collections.Counter()
    for _, t in pairs:
        b = (t or "").encode()
        seen.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for doc_id, t in pairs:
        b = (t or "").encode()
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                mask[i:i + length] = b"\1" * length
        spans = len([p for p in bytes(mask).split(b"\0") if p])
        kept = bytes(c for c, m in zip(b, mask) if not m)
        out.append((doc_id, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [10_000, 3])
def test_repeated_bytes_match_brute_force(docs, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    rng = random.Random(41)
    passage = prose(rng, 120)
    pairs = list(ODD) + [(6, "ab" * 700), (6, "ab" * 200), (7, "abc" * 300 + "abd" * 200), (8, "é" * 450)]
    for i in range(40):
        text = prose(rng, rng.choice([5, 80, 200]))
        if i % 2:
            cut = rng.randrange(0, 60)
            text += passage[cut:cut + rng.choice([350, 399, 400, 401, 560])] + prose(rng, 30)
        pairs.append((100 + i, text))
    pairs += [(300, pairs[-1][1]), (301, edited(rng, pairs[-1][1], 1)), (302, pairs[-2][1][3:])]
    got = sorted((tuple(r) for r in suffixes.removed(docs(pairs)).collect()), key=str)
    assert got == bytes_brute(pairs, 400)
    assert suffixes.removed(docs([])).count() == 0
