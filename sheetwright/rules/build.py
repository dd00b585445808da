"""Turn rule tables into expressions.

Few fixed patterns make one alternation or one ``CASE`` chain: both are
evaluated row by row within a stage, with no join and no shuffle, and Java
compiles a literal pattern once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def any_of(patterns: Iterable[str], ignore_case: bool = True) -> str:
    """One pattern that matches where any of ``patterns`` does."""
    return ("(?i)" if ignore_case else "") + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def matches_any(x: Column, patterns: Iterable[str], ignore_case: bool = True) -> Column:
    patterns = list(patterns)
    return x.rlike(any_of(patterns, ignore_case)) if patterns else F.lit(False)


def first_match(x: Column, named: Iterable[tuple[str, str]], default: Column | None = None) -> Column:
    """The name of the first pattern that matches; null or ``default`` if none does."""
    out = F.lit(None).cast("string") if default is None else default
    for name, pattern in reversed(list(named)):
        out = F.when(x.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def lookup(x: Column, table: Mapping, default=None) -> Column:
    """The table's value for a key; ``default`` if there is none."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    found = F.try_element_at(F.create_map(*pairs), x)
    return found if default is None else F.coalesce(found, F.lit(default))


def categories() -> dict[str, dict]:
    """Base categories, then the expanded ones."""
    return {**fixed.SHEET_CATEGORIES, **fixed.EXPANDED_CATEGORIES}


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is settled once, however often ``f`` names it; long expressions stay small in generated code."""
    return F.get(F.transform(F.array(x), f), F.lit(0))
