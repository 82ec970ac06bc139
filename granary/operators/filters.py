"""Metadata filters: a small document language compiled to Spark columns.

``{"lang": "de", "n": {"$gt": 3}, "$or": [{...}, {...}]}``: conditions on several fields all
hold. A missing value equals nothing, is in nothing, and compares to nothing, so ``$ne``
and ``$nin`` match it; ``$exists`` asks for it.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.errors import InvalidFilterError, UnsupportedFilterError

EQUALITY, MEMBERSHIP, ORDER, PRESENCE, LOGIC = ("$eq", "$ne"), ("$in", "$nin"), ("$gt", "$gte", "$lt", "$lte"), ("$exists",), ("$and", "$or")
OPERATORS = frozenset(EQUALITY + MEMBERSHIP + ORDER + PRESENCE + LOGIC)


def _scalar(x: object) -> bool:
    return isinstance(x, (str, int, float, bool))


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def validate(filt: dict | None, path: str = "filter") -> dict:
    """The filter with tuples made lists; None becomes ``{}``. Errors name the place."""
    if filt is None:
        return {}
    if not isinstance(filt, dict):
        raise InvalidFilterError(f"{path}: expected an object, got {type(filt).__name__}")
    out: dict = {}
    for name, value in filt.items():
        at = f"{path}.{name}"
        if not isinstance(name, str) or not name:
            raise InvalidFilterError(f"{path}: field names are non-empty strings")
        if name in LOGIC:
            if not isinstance(value, (list, tuple)) or not value:
                raise InvalidFilterError(f"{at}: expected a non-empty list of filters")
            out[name] = [validate(x, f"{at}[{i}]") for i, x in enumerate(value)]
            if not all(out[name]):
                raise InvalidFilterError(f"{at}: an empty filter inside a list says nothing")
        elif name.startswith("$"):
            raise InvalidFilterError(f"{at}: unknown operator {name}")
        elif isinstance(value, dict):
            out[name] = _conditions(value, at)
        elif _scalar(value):
            out[name] = value
        else:
            raise InvalidFilterError(f"{at}: expected a value or an object of operators")
    return out


def _conditions(conditions: dict, at: str) -> dict:
    if not conditions:
        raise InvalidFilterError(f"{at}: no operator given")
    out = {}
    for op, x in conditions.items():
        here = f"{at}.{op}"
        if op in EQUALITY:
            good, wants = _scalar(x), "a string, number or boolean"
        elif op in MEMBERSHIP:
            good, wants = isinstance(x, (list, tuple)) and len(x) > 0 and all(map(_scalar, x)), "a non-empty list of values"
        elif op in ORDER:
            good, wants = _number(x), "a number"
        elif op in PRESENCE:
            good, wants = isinstance(x, bool), "true or false"
        else:
            raise InvalidFilterError(f"{here}: unknown operator {op}")
        if not good:
            raise InvalidFilterError(f"{here}: expected {wants}")
        out[op] = list(x) if isinstance(x, tuple) else x
    return out


def operators_of(filt: dict | None) -> set[str]:
    """The operators a filter uses; a bare value counts as ``$eq``."""
    used: set[str] = set()
    for name, value in (filt or {}).items():
        if name in LOGIC:
            used |= {name}.union(*map(operators_of, value))
        else:
            used |= set(value) if isinstance(value, dict) else {"$eq"}
    return used


def fields_of(filt: dict | None) -> set[str]:
    """The fields a filter names."""
    named: set[str] = set()
    for name, value in (filt or {}).items():
        named |= set().union(*map(fields_of, value)) if name in LOGIC else {name}
    return named


def require(filt: dict | None, supported: Iterable[str], connector: str = "this connector") -> dict:
    """The validated filter, or an error naming the operators that are not supported."""
    good = validate(filt)
    missing = operators_of(good) - set(supported)
    if missing:
        raise UnsupportedFilterError(f"{connector} does not support {', '.join(sorted(missing))}", operators=sorted(missing), fields=sorted(fields_of(good)))
    return good


def conjunction(*filters: dict | None) -> dict:
    """One filter that holds where all do; conditions are never merged by name."""
    parts = [f for f in map(validate, filters) if f]
    return {} if not parts else parts[0] if len(parts) == 1 else {"$and": parts}


def to_column(filt: dict | None, kinds: dict[str, str]) -> Column:
    """The filter as a predicate. ``kinds``: the fields it may name and their Spark types.

    String columns compare with a value's text form; ordering needs a numeric column.
    """
    good = validate(filt)
    unknown = fields_of(good) - set(kinds)
    if unknown:
        raise UnsupportedFilterError(f"no field {', '.join(sorted(unknown))}; known: {', '.join(sorted(kinds))}", fields=sorted(unknown))
    return _column(good, kinds)


def _column(filt: dict, kinds: dict[str, str]) -> Column:
    parts = []
    for name, value in filt.items():
        if name in LOGIC:
            parts.append(reduce(and_ if name == "$and" else or_, [_column(x, kinds) for x in value]))
        else:
            for op, x in (value if isinstance(value, dict) else {"$eq": value}).items():
                parts.append(_condition(F.col(f"`{name}`"), kinds[name], name, op, x))
    return reduce(and_, parts) if parts else F.lit(True)


def _condition(column: Column, kind: str, name: str, op: str, x: object) -> Column:
    text = kind == "string"

    def value(v: object) -> Column:
        if text:
            return F.lit(str(v))
        # A value that is no number equals no number.
        return F.lit(v) if _number(v) or kind == "boolean" and isinstance(v, bool) else F.lit(None).cast(kind)

    if op == "$exists":
        return column.isNotNull() if x else column.isNull()
    if op == "$eq":
        return F.coalesce(column == value(x), F.lit(False))
    if op == "$ne":
        return F.coalesce(column != value(x), F.lit(True))
    if op in MEMBERSHIP:
        inside = F.coalesce(reduce(or_, [column.eqNullSafe(value(v)) & column.isNotNull() for v in x]), F.lit(False))
        return inside if op == "$in" else ~inside
    if text:
        raise InvalidFilterError(f"filter.{name}.{op}: {name} is text and has no numeric order")
    compare = {"$gt": column > x, "$gte": column >= x, "$lt": column < x, "$lte": column <= x}[op]
    return F.coalesce(compare, F.lit(False))


def apply(df: DataFrame, filt: dict | None) -> DataFrame:
    """The rows of ``df`` that match. The predicate reaches a Parquet scan as it is."""
    return df.where(to_column(filt, dict(df.dtypes)))
