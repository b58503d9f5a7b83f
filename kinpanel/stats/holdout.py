"""Random train/test splits of exact size, and metric curves over many splits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinpanel.operators.ordering import running_totals
from kinpanel.session import checkpointed
from kinpanel.stats.logit import TASKS, _independent_from_gram, newton, parts_at, run_together, summed, unpacked_sums
from kinpanel.stats.patterns import compress

Levels = Mapping[str, Sequence[object]]

# hexadecimal digits that a round of counting looks at, and rows of a repetition that one task puts in order
DIGITS = 3
ORDERED_ROWS = 100_000
# patterns that one block of a drawn split holds, before more blocks are made
BLOCK_PATTERNS = 10_000


def split_key(key: str, rep: Column, seed: str = "") -> Column:
    """Reproducible pseudo-random order of the rows in one repetition."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), rep.cast("string"), F.lit(seed)))


def holdout_split(df: DataFrame, key: str, prop: float, reps: int, seed: str = "") -> DataFrame:
    """Every row once per repetition with ``in_train``: exactly floor(n * prop) rows are 1.

    ``key`` must be unique. Ordering all rows by their hash would put a repetition into one task. Instead the hashes are
    counted by their first ``DIGITS`` digits, the running counts show which prefix the last training row has, and its rows
    are counted by the next digits, until few enough are left to be put in order. Marking the rows is then a comparison
    without any shuffle.
    """
    drawn = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn(
        "__h", split_key(key, F.col("rep"), seed))
    hashes = checkpointed(drawn.select("rep", "__h"))
    whole = Window.partitionBy("rep")
    upto = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge, width = None, 0
    while True:
        width += DIGITS
        under = hashes.withColumn("__b", F.substring("__h", 1, width))
        if edge is not None:
            # one row per repetition: safe to broadcast, as is the limit below
            under = under.join(F.broadcast(edge.select(F.col("rep").alias("__er"), F.col("__b").alias("__eb"), "__left")),
                               (F.col("rep") == F.col("__er")) & F.col("__b").startswith(F.col("__eb")))
        counts = under.groupBy("rep", "__b").agg(F.count(F.lit(1)).alias("__n"), *([F.max("__left").alias("__size")] if edge is not None else []))
        if edge is None:
            counts = counts.withColumn("__size", F.floor(F.sum("__n").over(whole) * F.lit(prop)))
        # at most 16 ** DIGITS rows per repetition
        edge = counts.withColumn("__upto", F.sum("__n").over(upto)).filter(
            (F.col("__upto") >= F.col("__size")) & (F.col("__upto") - F.col("__n") < F.col("__size")))
        edge = checkpointed(edge.select("rep", "__b", "__n", (F.col("__size") - F.col("__upto") + F.col("__n")).alias("__left")))
        if width >= 30 or (edge.agg(F.max("__n")).first()[0] or 0) <= ORDERED_ROWS:
            break
    ends = edge.select(F.col("rep").alias("__er"), F.col("__b").alias("__eb"), "__left")
    last = hashes.join(F.broadcast(ends), (F.col("rep") == F.col("__er")) & F.col("__h").startswith(F.col("__eb")))
    last = last.withColumn("__r", F.row_number().over(Window.partitionBy("rep").orderBy("__h")))
    limit = last.filter(F.col("__r") == F.col("__left")).select(F.col("rep").alias("__lr"), F.col("__h").alias("__limit"))
    marked = drawn.join(F.broadcast(limit), F.col("rep") == F.col("__lr"), "left")
    return marked.withColumn("in_train", F.coalesce((F.col("__h") <= F.col("__limit")).cast("int"), F.lit(0))).drop(
        "__h", "__lr", "__limit")


# ------------------------------------------------------------------------------------------- metric curve


def draw_split(counts: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Training counts per cell of a uniformly random subset of exactly ``size`` rows.

    Each cell first keeps each row with the same probability; the total is then corrected by adding or removing
    single rows chosen uniformly. Given its size a Bernoulli subset is uniform, and so is the corrected one. Works for
    counts of any size: the correction is of the order of the square root of the row count.
    """
    total = int(counts.sum())
    if total == 0:
        return counts.copy()
    taken = rng.binomial(counts, size / total)
    gap = size - int(taken.sum())
    pool = counts - taken if gap > 0 else taken
    picked = np.zeros(0, dtype=np.int64)
    room, need = int(pool.sum()), abs(gap)
    while len(picked) < need:
        picked = np.unique(np.concatenate([picked, rng.integers(0, room, need - len(picked))]))
    moved = np.bincount(np.searchsorted(np.cumsum(pool), picked, side="right"), minlength=len(counts))
    return taken + np.sign(gap) * moved


def draw_splits(patterns: DataFrame, xs: Sequence[str], props: Sequence[float], reps: int, seed: int) -> DataFrame:
    """``patterns`` with ``train_hits`` and ``train_n``: the training counts of every split, as arrays over the splits.

    A split's size is drawn over blocks of patterns first, from the blocks' row counts, and each block then draws over its
    own patterns. That is the distribution of drawing rows, and no task holds more than a block.
    """
    xs, props = list(xs), list(props)
    blocks = TASKS if patterns.count() > BLOCK_PATTERNS else 1
    own = F.pmod(F.xxhash64(*xs), F.lit(blocks)).cast("int")
    patterns = patterns.withColumn("__block", own)
    sizes = {r["__block"]: int(r["n"]) for r in patterns.groupBy("__block").agg(F.sum("n").alias("n")).collect()}
    totals = np.array([sizes.get(b, 0) for b in range(blocks)], dtype=np.int64)
    # the product is nudged so that e.g. 100 * 0.29 keeps its 29 rows
    wanted = [int(np.floor(totals.sum() * p + 1e-9)) for p in props for _ in range(reps)]
    shares = np.array([draw_split(totals, size, np.random.default_rng([seed, cell])) for cell, size in enumerate(wanted)]).reshape(-1, blocks)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(xs).reset_index(drop=True)
        block, k = int(pdf["__block"].iloc[0]), len(pdf)
        hits = pdf["successes"].to_numpy(np.int64)
        counts = np.concatenate([hits, pdf["n"].to_numpy(np.int64) - hits])
        drawn = np.array([draw_split(counts, int(size), np.random.default_rng([seed, cell, block])) for cell, size in enumerate(shares[:, block])])
        return pd.DataFrame({**{c: pdf[c] for c in [*xs, "successes", "n"]}, "train_hits": list(drawn[:, :k].T),
                             "train_n": list((drawn[:, :k] + drawn[:, k:]).T)})

    schema = ", ".join([*[f"`{x}` string" for x in xs], "successes long, n long, train_hits array<long>, train_n array<long>"])
    return patterns.select(*xs, "successes", "n", "__block").groupBy("__block").applyInPandas(draw, schema)


class Split:
    """The model of one split: covariate columns that its training rows use, by their place among all indicators."""

    def __init__(self, cell: int, columns: Sequence[int]) -> None:
        self.cell, self.columns = cell, list(columns)


def _indicators(pdf: pd.DataFrame, names: Sequence[tuple[str, str]]) -> np.ndarray:
    return np.column_stack([np.ones(len(pdf)), *[(pdf[x] == v).to_numpy(float) for x, v in names]])


def _split_sums(names: Sequence[tuple[str, str]]):
    """``evaluate`` for splits: all models of a round read the patterns once."""
    def evaluate(table: DataFrame, points: Sequence[tuple[Split, np.ndarray | None]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        widths = [len(s.columns) for s, _ in points]

        def add(pdf: pd.DataFrame, sums: list[np.ndarray]) -> None:
            whole = _indicators(pdf, names)
            hits, n = np.stack(pdf["train_hits"]).astype(float), np.stack(pdf["train_n"]).astype(float)
            for total, (split, beta) in zip(sums, points):
                total += parts_at(whole[:, split.columns], hits[:, split.cell], n[:, split.cell], beta)

        return [unpacked_sums(t, k) for t, k in zip(summed(table, [1 + k + k * (k + 1) // 2 for k in widths], add), widths)]

    return evaluate


METRICS = ("accuracy", "precision", "recall", "roc_auc", "skipped")
COUNTS = ("scored",)


def split_metrics(df: DataFrame, y: str, xs: Sequence[str], levels: Levels, props: Sequence[float], reps: int,
                  seed: int = 0, event: int = 0, threshold: float = 0.5) -> DataFrame:
    """(prop, rep, metric, estimate) of a fresh random split for every proportion and repetition.

    The model only sees counts per covariate pattern and outcome, so the rows are counted once and the splits are drawn
    from the counts: the same distribution as splitting the rows. A pattern stands once, with its training counts in all
    splits; all models take their Newton steps together, one job a step. Held-out rows with a level unseen in training are
    skipped and counted. The area under the curve comes from running totals over the scores of all splits.
    """
    xs, props = list(xs), list(props)
    used = {x: levels[x] for x in xs}
    patterns = checkpointed(compress(df.dropna(subset=xs), y, used).dropna(subset=xs))
    table = checkpointed(draw_splits(patterns, xs, props, reps, seed))
    names = [(x, str(v)) for x in xs for v in levels[x]]
    evaluate, splits = _split_sums(names), []
    everything = [Split(c, range(1 + len(names))) for c in range(len(props) * reps)]
    unseen = {}
    for whole, (_, _, gram) in zip(everything, evaluate(table, [(s, None) for s in everything])):
        # the first level that training rows have is the baseline; the others are columns if no earlier ones give them
        seen = [i for i in range(1, len(gram)) if gram[i, i] > 0]
        first = {x: next((i for i in seen if names[i - 1][0] == x), None) for x in xs}
        at = [0, *[i for i in seen if i != first[names[i - 1][0]]]]
        splits.append(Split(whole.cell, [i for i, good in zip(at, _independent_from_gram(gram[np.ix_(at, at)])) if good]))
        unseen[whole.cell] = [i for i in range(1, len(gram)) if gram[i, i] <= 0]
    fits = run_together(table, [(s, newton(np.zeros(len(s.columns)), np.ones(len(s.columns), dtype=bool))) for s in splits], evaluate)
    models = [(s.columns, fit["beta"], unseen[s.cell]) for s, fit in zip(splits, fits)]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            whole = _indicators(pdf, names)
            hits = pdf["successes"].to_numpy(np.int64)[:, None] - np.stack(pdf["train_hits"])
            n = pdf["n"].to_numpy(np.int64)[:, None] - np.stack(pdf["train_n"])
            for cell, (columns, beta, gone) in enumerate(models):
                known = whole[:, gone].sum(1) == 0
                yield pd.DataFrame({"cell": cell, "eta": np.round(whole[:, columns] @ beta, 12), "pos": hits[:, cell],
                                    "neg": n[:, cell] - hits[:, cell], "known": known})

    # one row per split and score: equal scores meet here
    rows = table.mapInPandas(score, "cell int, eta double, pos long, neg long, known boolean").filter("pos + neg > 0")
    skipped = F.sum(F.when(~F.col("known"), F.col("pos") + F.col("neg")).otherwise(0))
    scores = rows.groupBy("cell", F.when(F.col("known"), F.col("eta")).alias("eta")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), skipped.alias("skipped"))
    ranked = running_totals(scores.withColumn("ranked", F.when(F.col("eta").isNotNull(), F.col("neg")).otherwise(0)), ["cell"], "eta", ["ranked"])
    says_one = F.col("eta") > float(np.log(threshold / (1 - threshold)))
    known = F.col("eta").isNotNull()
    hit, miss = (F.col("pos"), F.col("neg")) if event == 1 else (F.col("neg"), F.col("pos"))
    called = known & (says_one if event == 1 else ~says_one)

    def total(test: Column, what: Column) -> Column:
        return F.sum(F.when(test, what).otherwise(0)).cast("double")

    below = F.col("before_ranked").cast("double") + F.col("neg") / 2.0
    per_cell = ranked.groupBy("cell").agg(
        F.try_divide(total(called, hit) + total(known & ~called, miss), total(known, hit + miss)).alias("accuracy"),
        F.try_divide(total(called, hit), total(called, hit + miss)).alias("precision"),
        F.try_divide(total(called, hit), total(known, hit)).alias("recall"),
        F.try_divide(total(known, F.col("pos") * below), total(known, F.col("pos")) * total(known, F.col("neg"))).alias("roc_auc"),
        F.sum("skipped").cast("double").alias("skipped"), total(known, hit + miss).alias("scored"))
    # a split without held-out rows has no scores
    cells = df.sparkSession.createDataFrame([(c, float(props[c // reps]), c % reps + 1) for c in range(len(models))], "cell int, prop double, rep int")
    wide = cells.join(per_cell, "cell", "left").fillna(0.0, ["skipped", "scored"])
    return wide.unpivot(["prop", "rep"], [*METRICS, *COUNTS], "metric", "estimate")


def metric_curve(df: DataFrame, y: str, xs: Sequence[str], levels: Levels, props: Sequence[float], reps: int,
                 seed: int = 0, event: int = 0, threshold: float = 0.5) -> DataFrame:
    """(metric, prop, avg_estimate): each metric averaged over the repetitions of a training proportion."""
    found = split_metrics(df, y, xs, levels, props, reps, seed, event, threshold)
    return found.filter(~F.col("metric").isin(*COUNTS)).groupBy("metric", "prop").agg(
        F.avg("estimate").alias("avg_estimate"))
