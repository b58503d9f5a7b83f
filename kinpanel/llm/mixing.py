"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every document of a source expects ``e`` copies, in proportion to its preference and never above ``cap``. The whole part
of ``e`` is certain. For what is left of the source's target, documents are ranked by their random odds u / (1 - u)
divided by their inclusion odds p / (1 - p), where p is the fractional part of ``e``; the sample is the front of that
order, cut where its size is nearest to what is left.

Defined cases: a null text or one without words has size 0 and is never taken. A null source is a source of its own.
Rows that agree in doc_id, size and source are interchangeable copies; a null doc_id is allowed. An empty table gives
no rows. Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kinpanel.session import checkpointed

WORDS = r"[^\x20\x09-\x0D]+"
#: weights of the sources in code point order, repeating
WEIGHTS = (5, 2, 1)
#: most copies of a document, and most times that a source's size is taken
CAP = 3
#: first and second cut of the rank values; a source of a billion documents leaves a thousand in a last slice
SLICES = 1024


def filled(df: DataFrame, group: list[str], weight: str, limit: str, total: str, out: str, order: list[str]) -> DataFrame:
    """Share ``total`` by weight within a group; what exceeds a row's ``limit`` is reshared among the others.

    The level is found from running sums in order of limit / weight: rows before it stop at their limit. Rows of a
    group are few (sources, or preference classes of a source).
    """
    whole = Window.partitionBy(*group)
    ordered = whole.orderBy(F.col("__full"), *order)
    before, rest = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    level = ((F.col(total) - F.coalesce(F.sum(limit).over(before), F.lit(0))).cast("double")
             / F.sum(weight).over(rest).cast("double"))
    df = df.withColumn("__full", F.col(limit).cast("double") / F.col(weight).cast("double")).withColumn("__level", level)
    # the first (and highest) level that does not exceed its own row's full level holds for all
    df = df.withColumn("__level", F.max(F.when(F.col("__level") <= F.col("__full"), F.col("__level"))).over(whole))
    share = F.least(F.col(weight) * F.col("__level"), F.col(limit).cast("double"))
    return df.withColumn(out, F.coalesce(share, F.col(limit).cast("double"))).drop("__full", "__level")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and preference: short documents expect somewhat more copies than long ones."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size")).withColumn(
        "preference", F.greatest(F.lit(1), 20 - F.length(F.bin("size"))).cast("long"))


def source_targets(items: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target. One row per source; sources are a dimension, ranked in one window."""
    per = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("__place", rank).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__place") - 1) % len(weights) + 1))
    per = per.withColumn("__total", F.sum("source_size").over(Window.partitionBy())).withColumn(
        "__limit", F.col("source_size") * cap)
    out = filled(per, [], "weight", "__limit", "__total", "target", ["__place"])
    return out.select("source", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every document.

    ``docs`` has doc_id, text and source; the result has a row per document. The rank of a document depends on its
    doc_id, size and ``seed`` alone, so reruns agree.
    """
    items = checkpointed(sized(docs).groupBy("doc_id", "source", "size", "preference").agg(F.count("*").alias("rows")))
    rows = items.withColumn("__words", F.col("size") * F.col("rows"))
    # written, so that Spark knows how small the tables of a row per source are and broadcasts them: rows of a source stay put
    targets = checkpointed(source_targets(rows.select("source", F.col("__words").alias("size")), weights, cap))
    classes = rows.groupBy("source", "preference").agg(F.sum("__words").alias("__words"))
    classes = classes.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    classes = classes.withColumn("__pull", F.col("__words") * F.col("preference")).withColumn(
        "__limit", F.col("__words") * cap).filter("__words > 0")
    classes = filled(classes, ["source"], "__pull", "__limit", "target", "__share", ["preference"])
    # expected copies of a document of the class
    classes = classes.withColumn("__e", F.least(F.lit(float(cap)), F.col("__share") / F.col("__words")))
    classes = classes.withColumn("__sure", F.floor("__e").cast("long")).withColumn("__p", F.col("__e") - F.col("__sure"))
    classes = checkpointed(classes.withColumn("__left", F.col("target") - F.sum(
        F.col("__sure") * F.col("__words")).over(Window.partitionBy("source"))))

    # sources with their sizes and targets, also those without any words; preference classes and sources are few rows
    known = classes.select(F.col("source").alias("__s"), F.col("preference").alias("__c"), "__sure", "__p", "__left")
    targets = targets.withColumnRenamed("source", "__s2")
    ranked = items.join(known, F.col("source").eqNullSafe(F.col("__s")) & (F.col("preference") == F.col("__c")), "left")
    ranked = ranked.join(targets, F.col("source").eqNullSafe(F.col("__s2")), "left").drop("__s", "__s2", "__c")
    ranked = ranked.withColumn("__t", rank_value(F.col("doc_id"), F.col("size"), F.col("__p"), seed))
    open_ = (F.col("size") > 0) & (F.col("__sure") < cap)
    ranked = ranked.withColumn("__open", F.coalesce(open_, F.lit(False)))
    ranked = ranked.withColumn("__a", F.floor(F.col("__t") * (SLICES // 2)).cast("int")).withColumn(
        "__b", F.floor((F.col("__t") * (SLICES // 2) - F.col("__a")) * SLICES).cast("int"))
    ranked = checkpointed(ranked)

    cut = checkpointed(_cut(ranked.filter("__open"), ["source"], "__a"))
    cut = checkpointed(_cut(ranked.filter("__open"), ["source", "__a"], "__b", cut))
    cut = cut.select(F.col("source").alias("__s"), F.col("__a").alias("__ca"), F.col("__b").alias("__cb"), "__before")
    placed = ranked.join(cut, F.col("source").eqNullSafe(F.col("__s")), "left")
    earlier = (F.col("__a") < F.col("__ca")) | ((F.col("__a") == F.col("__ca")) & (F.col("__b") < F.col("__cb")))
    in_slice = F.col("__open") & (F.col("__a") == F.col("__ca")) & (F.col("__b") == F.col("__cb"))
    # only the slice that holds the cut is put in order, a millionth of a source
    inside = Window.partitionBy("source").orderBy("__t", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(
        Window.unboundedPreceding, -1)
    near = placed.filter(in_slice).withColumn("__sum", F.col("__before") + F.coalesce(
        F.sum(F.col("size") * F.col("rows")).over(inside), F.lit(0)))
    fits = F.floor((2 * F.col("__left") - 2 * F.col("__sum") - F.col("size")) / (2 * F.col("size"))) + 1
    near = near.withColumn("__more", F.least(F.col("rows"), F.greatest(F.lit(0), fits.cast("long")))).drop("__sum")
    # a source whose whole order fits has no cut
    far = placed.filter(~in_slice | in_slice.isNull()).withColumn("__more", F.when(
        F.col("__open") & (F.col("__s").isNull() & F.col("__ca").isNull() | earlier), F.col("rows")).otherwise(F.lit(0)))
    done = far.unionByName(near)
    return _expanded(done, cap).select(
        "doc_id", "source", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def rank_value(doc_id, size, p, seed: str):
    """Odds ratio turned into a value below 1 (or, for a document that need not be drawn, 1 to 2, behind all others)."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), size.cast("string"), F.lit(":" + seed))
    u = (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    odds = (u / (1 - u)) / F.when(p > 0, p / (1 - p))
    return F.when(p > 0, odds / (1 + odds)).otherwise(1 + u)


def _cut(df: DataFrame, keys: list[str], slice_: str, above: DataFrame | None = None) -> DataFrame:
    """The slice in which the running size of each source first reaches its limit, with the size ``__before`` it."""
    if above is not None:
        top = above.select(F.col("source").alias("__s"), F.col("__a").alias("__ca"), F.col("__before").alias("__base"))
        df = df.join(top, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__a") == F.col("__ca"))).drop("__s", "__ca")
    else:
        df = df.withColumn("__base", F.lit(0).cast("long"))
    sums = df.groupBy(*keys, slice_).agg(F.sum(F.col("size") * F.col("rows")).alias("__n"), F.max("size").alias("__big"),
                                         F.max("__left").alias("__left"), F.max("__base").alias("__base"))
    up_to = Window.partitionBy(*keys).orderBy(slice_)
    sums = sums.withColumn("__end", F.sum("__n").over(up_to) + F.col("__base"))
    # the cut cannot be in a slice that ends well below the limit
    reached = sums.filter(F.col("__end") > F.col("__left")).withColumn("__first", F.row_number().over(up_to)).filter("__first = 1")
    return reached.select(*keys, slice_, (F.col("__end") - F.col("__n")).alias("__before"), "__left")


def _expanded(done: DataFrame, cap: int, block: int = 4096) -> DataFrame:
    """A row per input row: ``__more`` of the ``rows`` alike have one copy above the certain ones."""
    sure = F.coalesce("__sure", F.lit(0))
    kinds = done.withColumn("__kind", F.explode(F.array(
        F.struct((sure + 1).alias("copies"), F.col("__more").cast("long").alias("n")),
        F.struct(sure.alias("copies"), (F.col("rows") - F.col("__more")).cast("long").alias("n"))))).filter("__kind.n > 0")
    kinds = kinds.withColumn("__from", F.explode(F.expr(f"sequence(0L, __kind.n - 1, {block}L)")))
    kinds = kinds.withColumn("__i", F.explode(F.expr(f"sequence(__from, least(__from + {block - 1}, __kind.n - 1))")))
    return kinds.withColumn("copies", F.col("__kind.copies").cast("long"))
