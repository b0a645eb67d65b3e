"""Expression operators with the semantics of dynamic values, on typed columns.

Comparison and arithmetic are those of Column.  What differs: ``and`` and ``or`` give an operand, addition also joins texts and arrays,
multiplication also repeats them, and items are counted from 0, from the end if negative.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lift(x: Any) -> Column:
    """A constant as a column; columns stay."""
    return x if isinstance(x, Column) else F.lit(x)


def add(a: Any, b: Any, kind: str = "number") -> Column:
    """kind: number, string or array."""
    return lift(a) + lift(b) if kind == "number" else F.concat(lift(a), lift(b))


def multiply(a: Any, b: Any, kind: str = "number") -> Column:
    """Of a string or array, a is the value and b how often it comes."""
    if kind == "number":
        return lift(a) * lift(b)
    times = F.greatest(lift(b), F.lit(0)).cast("int")
    return F.repeat(lift(a), times) if kind == "string" else F.flatten(F.array_repeat(lift(a), times))


def divide(a: Any, b: Any, caught: Any = None) -> Column:
    """True division as double; by zero it fails, or gives caught if that is given."""
    x, y = lift(a).cast("double"), lift(b).cast("double")
    return x / y if caught is None else F.coalesce(F.try_divide(x, y), lift(caught))


def truthy(a: Column, kind: str = "boolean") -> Column:
    """What counts as true: not null, and not false, 0 or empty."""
    test = {"boolean": a, "number": a != 0, "string": a != "", "array": F.size(a) > 0}[kind]
    return F.coalesce(test, F.lit(False))


def and_(a: Column, b: Column, kind: str = "boolean") -> Column:
    """b if a is true, else a."""
    return F.when(truthy(a, kind), b).otherwise(a)


def or_(a: Column, b: Column, kind: str = "boolean") -> Column:
    """a if it is true, else b."""
    return F.when(truthy(a, kind), a).otherwise(b)


def attribute(a: Column, name: str) -> Column:
    return a.getField(name)


def item(a: Column, key: Any, strict: bool = True) -> Column:
    """Item of an array by position or of a map by key; a missing one fails, or is null if not strict."""
    if isinstance(key, int):
        at = F.lit(key + 1 if key >= 0 else key)
        return F.element_at(a, at) if strict else F.try_element_at(a, at)
    return F.element_at(a, lift(key)) if strict else F.try_element_at(a, lift(key))


def slice_(a: Column, start: int, stop: int, step: int = 1) -> Column:
    """Items from start before stop, each step-th; positions below 0 count from the end."""
    n = F.size(a)
    lo = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    hi = F.least(F.lit(stop) if stop >= 0 else n + stop, n)
    if step < 1:
        raise ValueError("step must be positive")
    part = F.slice(a, lo.cast("int") + 1, F.greatest(hi - lo, F.lit(0)).cast("int"))
    return part if step == 1 else F.filter(part, lambda x, i: i % step == 0)


def unpack(df: DataFrame, struct: str) -> DataFrame:
    """The fields of a struct column as columns, besides the others."""
    return df.select(*[c for c in df.columns if c != struct], f"{struct}.*")
