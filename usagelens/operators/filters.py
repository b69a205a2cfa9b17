"""Ad-hoc filters: same key or-ed, different keys and-ed."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, functions as F


class Filter(NamedTuple):
    key: str
    op: str
    value: str


def one_condition(column: Column, op: str, value: str) -> Column:
    """Text comparison; regexes match anywhere; an unknown operator accepts all."""
    literal = F.lit(value)
    tests = {
        "=": lambda: column == literal,
        "!=": lambda: column != literal,
        "=~": lambda: F.rlike(column, literal),
        "!~": lambda: ~F.rlike(column, literal),
        ">": lambda: column > literal,
        "<": lambda: column < literal,
    }
    return tests.get(op, lambda: F.lit(True))()


def by_key(filters: Iterable[Filter]) -> dict[str, list[Filter]]:
    grouped: dict[str, list[Filter]] = {}
    for f in filters:
        grouped.setdefault(f.key, []).append(f)
    return grouped


def any_of(column: Column, filters: Iterable[Filter]) -> Column:
    return reduce(or_, [one_condition(column, f.op, f.value) for f in filters])


def exists_any_of(values: Column, filters: list[Filter]) -> Column:
    """True when *some* array element passes, so ``!=`` means "one that differs"."""
    return F.exists(values, lambda v: any_of(v, filters))


def all_keys(columns: dict[str, Column], filters: Iterable[Filter]) -> Column:
    """The whole filter list over the columns it names; unnamed keys are left out."""
    tests = [any_of(columns[k], fs) for k, fs in by_key(filters).items() if k in columns]
    return reduce(and_, tests, F.lit(True))
