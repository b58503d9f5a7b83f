"""Every stage against brute force on its own input, and the table that goes in and out."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from kinpanel import session
from kinpanel.llm import sql
from tests.llm.test_operators import ODD, bytes_brute, edited, near_brute, passages_brute, prose  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, items string, lang_pred string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with documents and a benchmark, with odd rows and further columns."""
    rng = random.Random(43)
    path = str(tmp_path_factory.mktemp("sf"))
    passage, item = prose(rng, 90, 9000), prose(rng, 30, 9000)
    texts = [(10 + i, prose(rng, rng.choice([30, 100, 300]), 9000)) for i in range(60)]
    texts += [(100 + i, edited(rng, texts[i][1], 1)) for i in range(0, 30, 3)] + [(200, texts[5][1]), (None, texts[5][1]), (17, texts[7][1])]
    texts += [(300 + i, prose(rng, 60, 9000) + " " + passage + "\n" + prose(rng, 60, 9000)) for i in range(6)]
    texts += [(400 + i, prose(rng, 30, 9000) + " " + item) for i in range(3)] + ODD
    rows = [(i, t, "en" if k % 3 else None, ["a", "b", None][k % 3], len(t or ""), "r", "i", "p") for k, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_stages_match_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    columns = docs.columns
    before = listed(docs, "doc_id", "text")

    language = corpus_pipeline.language(spark, docs, folder).cache()
    assert language.columns == columns and language.filter("lang IS NULL").count() == 0
    assert listed(language, "doc_id", "text") == [r for r in before if any(c.isalpha() for c in r[1] or "")]

    near = corpus_pipeline.near_duplicates(spark, language, folder).cache()
    assert near.columns == columns
    now = listed(language, "doc_id", "text")
    groups = {}
    for doc_id, _, component in near_brute(now, 5, 80):
        groups.setdefault(component, set()).add(doc_id)
    kept = listed(near, "doc_id", "text")
    # every group has one document left, that with the smallest doc_id
    assert len(kept) == len(groups)
    assert {i for i, _ in kept if i is not None} == {g for g in groups if g is not None}

    cut = corpus_pipeline.repeated_passages(spark, near, folder).cache()
    assert cut.columns == columns and cut.filter("n_chars <> length(text)").count() == 0
    lost = {i: n for i, n in passages_brute(kept)}
    words = {i: t.split() for i, t in kept}
    left = {i: t.split() for i, t in listed(cut, "doc_id", "text")}
    for doc_id, own in left.items():
        # words beside a paragraph that goes may go with it, and nothing goes from a document without one
        assert len(own) <= len(words[doc_id]) - lost[doc_id] and (lost[doc_id] or own == words[doc_id])
    # the copies of the passage go from their first to their last word (and at most one word of the surroundings on a side)
    whole = [i for i in range(301, 306) if lost[i]]
    assert whole == list(range(301, 306)) and not lost[300]
    for i in whole:
        first = words[i][:60]
        ahead = next((k for k, (x, y) in enumerate(zip(first, left[i])) if x != y), len(first))
        assert ahead >= 59 and left[i][-59:] == words[i][-59:] and 118 <= len(left[i]) <= 120

    clean = corpus_pipeline.decontaminate(spark, cut, folder).cache()
    assert clean.columns == columns
    gone = {i for i, _ in listed(cut, "doc_id", "text")} - {i for i, _ in listed(clean, "doc_id", "text")}
    assert 400 in gone and gone <= {400, 401, 402}

    mixed = corpus_pipeline.mix(spark, clean, folder)
    con = duckdb.connect()
    con.register("t", clean.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(f"SELECT doc_id, source, size, copies, taken FROM ({sql.MIX.format(docs='t')})").fetchall()
    assert listed(mixed, "doc_id", "source", "size", "copies", "taken") == sorted(want, key=str)


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_run_leaves_only_the_stages_results(spark, folder):
    """What a stage writes on its way is deleted; the last result still reads."""
    base = session.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(base))
    found = corpus_pipeline.run(spark, folder)
    assert found.count() > 0
    assert sorted(n.split("-")[2] for n in set(os.listdir(base)) - before if "-stage-" not in n) == sorted(n for n, _ in corpus_pipeline.STAGES)
    assert not [n for n in set(os.listdir(base)) - before if "-stage-" in n]
