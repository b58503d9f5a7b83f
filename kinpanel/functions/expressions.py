"""Column expressions: everything here stays inside generated JVM code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[Column, object]


def fallback(*cols: Column | str) -> Column:
    """First value that is not NULL; later entries may be computed."""
    return F.coalesce(*cols)


def three_valued(test: Column) -> Column:
    """1 / 0 / NULL from a condition that may be unknown (a plain otherwise would turn unknown into 0)."""
    return F.when(test, F.lit(1)).when(~test, F.lit(0))


def any_of(tests: Sequence[Column]) -> Column:
    """Three-valued OR: true if any test is, else unknown if any is unknown."""
    return reduce(lambda a, b: a | b, tests)


def choose(rules: Sequence[Rule], default: object = None) -> Column:
    """Value of the first rule that holds; an unknown condition falls through."""
    out = F
    for test, value in rules:
        out = out.when(test, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def count_sum(a: Column, b: Column) -> Column:
    """Sum of two optional counts, never negative; 0 if either is missing."""
    return F.greatest(F.coalesce(a + b, F.lit(0)), F.lit(0))


def fixed_bucket(col: Column, width: int) -> Column:
    """Lower edge of the fixed-width bucket."""
    return (F.floor(col / F.lit(width)) * F.lit(width)).cast("int")


def top_code(col: Column, k: int) -> Column:
    """Values of k and more share the label ``>=k``; others keep their number as text."""
    return F.when(col >= k, F.lit(f">={k}")).otherwise(col.cast("int").cast("string"))


def top_code_levels(k: int, start: int = 1) -> list[str]:
    """Labels of ``top_code`` in order; the first is the regression baseline."""
    return [*[str(i) for i in range(start, k)], f">={k}"]


def level_index(col: Column, levels: Sequence[str]) -> Column:
    """Place of the label in an ordered level list (1-based), NULL for other labels."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), col)
    return F.when(place > 0, place.cast("int"))


def plain_number(col: Column, digits: int) -> Column:
    """Rounded number as text without a trailing ``.0``."""
    return F.regexp_replace(F.round(col, digits).cast("string"), r"\.0$", "")


def share_label(n: Column, share: Column) -> Column:
    """``1,234 (56.7%)`` from a count and a share between 0 and 1."""
    return F.concat(F.format_number(n, 0), F.lit(" ("), plain_number(share * 100, 1), F.lit("%)"))


def stars(p: Column) -> Column:
    """Significance marks at .001, .01 and .05; none for an unknown p."""
    return choose([(p < 0.001, "***"), (p < 0.01, "**"), (p < 0.05, "*")], "")


def estimate_label(estimate: Column, error: Column, p: Column) -> Column:
    """``estimate (error)`` with significance marks."""
    return F.concat(plain_number(estimate, 3), F.lit(" ("), plain_number(error, 3), F.lit(")"), stars(p))


def family_key(father: Column, mother: Column) -> Column:
    """Text key of a couple; the separator keeps different couples apart."""
    return F.concat_ws("_", father.cast("string"), mother.cast("string"))


def relation_slots(name: Column) -> tuple[Column, Column]:
    """Member slots in a relation-grid column name such as ``b2.9.1`` or ``b2.91``, as text."""
    shape = r"^b?([^.]+)\.9\.?([^.]+)$"
    return F.regexp_extract(name, shape, 1), F.regexp_extract(name, shape, 2)


def gender_slot(name: Column) -> Column:
    """Member slot in a gender column name such as ``b2.5``, as text."""
    return F.regexp_extract(name, r"^b?([^.]+)\.", 1)


def member_slot(name: Column, prefix: str = "idind") -> Column:
    """Member slot in a member-id column name such as ``idind3``, as text."""
    return F.regexp_replace(name, f"^{prefix}", "")
