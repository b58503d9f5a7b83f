"""Joins: dimensions, membership, tie-preserving as-of, co-location in time, aligned differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinpanel.operators.ordering import PART, latest_before
from kinpanel.operators import scale
from kinpanel.operators.scale import join_counted, salted_join
from kinpanel.session import checkpointed, checkpointed_with


def membership(df: DataFrame, key: str, members: DataFrame, out: str, check: bool = True) -> DataFrame:
    """1 if the row's key occurs in ``members`` (a one-column table), else 0. ``check`` as in ``salted_join``."""
    ids = members.select(F.col(members.columns[0]).alias(key)).distinct().withColumn("__in", F.lit(1))
    return salted_join(df, ids, [key], "left", check=check).withColumn(out, F.coalesce(F.col("__in"), F.lit(0))).drop("__in")


def excluding(df: DataFrame, keys: Sequence[str] | str, members: DataFrame, null_safe: bool = False) -> DataFrame:
    """Rows whose keys do not occur in ``members``, which has the same number of columns in the same order.

    ``null_safe`` counts a NULL as a value that members can have.

    The list is counted; if it is short it is broadcast and the rows stay where they are.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    ids = members.select(*[F.col(m).alias(k) for m, k in zip(members.columns, keys)]).distinct()
    return join_counted(df, ids, keys, "left_anti", null_safe=null_safe)


def only_members(df: DataFrame, keys: Sequence[str], members: DataFrame) -> DataFrame:
    """Rows whose keys occur in ``members``."""
    return salted_join(df, members.select(*keys).distinct(), list(keys), "left_semi")


def _hot_marks(marks: DataFrame, keys: list[str], time: str, count: str, most: int | None) -> DataFrame | None:
    """Hot (key, time) pairs for ``salted_join``, from counts that stand with the marks."""
    if (most or 0) <= scale.HOT_ROWS:
        return None
    return scale._salts(marks.select(*keys, F.col("__t").alias(time), F.col(count).alias("__rows")), [*keys, time], scale.HOT_ROWS)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
              how: str = "inner", parts: int | None = None, few_times: bool = False) -> DataFrame:
    """Each left row with every right row of the same key at the closest time not after the left time.

    All ties at that time are kept. NULL keys or times never match; ``left`` keeps unmatched rows. Apart from the keys
    the two sides must not share column names. Left and right times are counted per key in one aggregate; these marks are
    scanned in order over all tasks, so a key of any size is cut, and two equi-joins bring the rows back: never the product
    of a key's left and right rows. The counts say which joins need salts. ``few_times`` says that a key has few
    times and rows, as a person in a yearly survey has: a window per key is then enough. ``parts`` sets the number of
    stretches of the scan.
    """
    keys = list(keys)
    left, right = left.withColumn("__lt", F.col(left_time)), right.withColumn("__rt", F.col(right_time))

    def told(rows: DataFrame, time: str, of_left: int) -> DataFrame:
        return rows.select(*keys, F.col(time).alias("__t"), F.lit(of_left).alias("__l"), F.lit(1 - of_left).alias("__r"))

    marks = told(left, "__lt", 1).unionByName(told(right, "__rt", 0)).dropna(subset=[*keys, "__t"]).groupBy(*keys, "__t").agg(
        F.sum("__l").alias("__n_left"), F.sum("__r").alias("__n_right"))
    seen = F.when(F.col("__n_right") > 0, F.col("__t"))
    if few_times:
        found = F.last(seen, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__t"))
        times = marks.withColumn("__rt", found).filter((F.col("__n_left") > 0) & F.col("__rt").isNotNull()).select(
            *keys, F.col("__t").alias("__lt"), "__rt")
        lookup = salted_join(times, right, [*keys, "__rt"], "inner", check=False).drop("__rt")
        return salted_join(left, lookup, [*keys, "__lt"], how, check=False).drop("__lt")
    marks, most = latest_before(marks, keys, "__t", seen, "__rt", parts, left=F.max("__n_left"), right=F.max("__n_right"))
    times = marks.filter((F.col("__n_left") > 0) & F.col("__rt").isNotNull()).select(*keys, F.col("__t").alias("__lt"), "__rt", PART)
    # right rows under each distinct left time; very many left times may follow one right time, but in stretches
    needed = times.select(*keys, "__rt", PART).distinct()
    hot_right = _hot_marks(marks, keys, "__rt", "__n_right", most["right"])
    lookup = salted_join(right, needed, [*keys, "__rt"], "inner", check=False, hot=hot_right)
    lookup = salted_join(times, lookup, [*keys, "__rt", PART], "inner", check=False).drop("__rt", PART)
    hot_left = _hot_marks(marks, keys, "__lt", "__n_left", most["left"])
    return salted_join(left, lookup, [*keys, "__lt"], how, check=False, hot=hot_left).drop("__lt")


def apart_together(sample: DataFrame, seen: DataFrame, entity: str, relatives: Sequence[str], until: str,
                   person: str, wave: str, place: str) -> DataFrame:
    """Entities that, in some wave not after ``until``, were seen in another place than every one of their relatives.

    ``seen`` holds (person, wave, place). The wave is part of each join key, so rows never multiply across waves.
    """
    who = sample.groupBy(entity, *relatives).agg(F.max(until).alias("__until"))
    spots = seen.select(F.col(person).alias("__p"), F.col(wave).alias("__w"), F.col(place).alias("__h")).dropna().distinct()
    own = spots.select(F.col("__p").alias(entity), F.col("__w"), F.col("__h").alias("__own"))
    # the distinct spots of one person are few; many entities may share a relative, so entities are counted per relative
    shared = who.select(F.explode(F.array(*[F.struct(F.lit(r).alias("of"), F.col(r).cast("string").alias("id")) for r in relatives])).alias("r"))
    _, most = checkpointed_with(shared.groupBy("r").agg(F.count(F.lit(1)).alias("n")), n=F.max("n"))
    crowded = (most["n"] or 0) > scale.HOT_ROWS
    found = own.join(who, entity).filter(F.col("__w") <= F.col("__until"))
    for i, relative in enumerate(relatives):
        if i and crowded:
            # a salted join reads its left side twice: cut the steps from each other
            found = checkpointed(found)
        other = spots.select(F.col("__p").alias(relative), F.col("__w"), F.col("__h").alias(f"__h{i}"))
        met = salted_join(found, other, [relative, "__w"], "inner", check=crowded).filter(F.col("__own") != F.col(f"__h{i}"))
        found = met.drop(relative, f"__h{i}")
    return found.select(entity).distinct()


def share_difference(sample: DataFrame, population: DataFrame, keys: Sequence[str], share: str = "share",
                     out: str = "difference") -> DataFrame:
    """Sample share minus population share for every population class; a class absent from the sample counts as 0."""
    theirs = sample.select(*[F.col(k).alias(f"__s_{k}") for k in keys], F.col(share).alias("__share"))
    cond = [population[k] == theirs[f"__s_{k}"] for k in keys]
    return population.join(theirs, cond, "left").select(
        *[population[k] for k in keys],
        (F.coalesce(F.col("__share"), F.lit(0.0)) - F.coalesce(population[share], F.lit(0.0))).alias(out))
