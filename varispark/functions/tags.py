"""Predicates: numeric and text comparators, sets, and lists of SAM tag conditions."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import starmap

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARATORS: dict[str, Callable] = {"!=": operator.ne, ">=": operator.ge, "<=": operator.le, "=": operator.eq, ">": operator.gt, "<": operator.lt}


def compare_number(x: Column, op: str, value: float) -> Column:
    """x op value with x a number or numeric text; false for any other text and null."""
    return F.coalesce(COMPARATORS[op](x.cast("string").try_cast("double"), F.lit(float(value))), F.lit(False))


def compare_text(x: Column, op: str, values: list[str]) -> Column:
    """= or != against one text or any of a set; null is no match for = and one for !=."""
    if op not in ("=", "!="):
        raise ValueError(f"texts compare with = and != only, not {op}")
    hit = F.coalesce(x.isin(values), F.lit(False))
    return hit if op == "=" else ~hit


def combine(how: str, a: Column, b: Column) -> Column:
    """a and b, or a or b, null counting as false."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    if how not in ("and", "or"):
        raise ValueError(how)
    return a & b if how == "and" else a | b


#: Signs of comparison, longer ones first so that none is read as the beginning of another.
_SIGNS = "|".join(map(re.escape, sorted(COMPARATORS, key=lambda sign: (-len(sign), sign))))
_CONDITION = re.compile(rf"(?P<tag>[A-Za-z][A-Za-z0-9])\s*(?P<sign>{_SIGNS})\s*(?P<value>\S.*)")


@dataclass(frozen=True)
class Condition:
    """One condition on a SAM tag; what its value is decides how it compares."""

    tag: str
    sign: str
    value: str

    def holds(self, x: Column) -> Column:
        if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", self.value):
            return compare_number(x, self.sign, float(self.value))
        return compare_text(x, self.sign, self.value.split("/"))


def parse_tag_filter(text: str) -> list[tuple[str, str, str]]:
    """(tag, operator, value) of 'TAG op VALUE,...'."""
    found = [(part, _CONDITION.fullmatch(part.strip())) for part in text.split(",")]
    if wrong := [part for part, m in found if m is None]:
        raise ValueError(f"not a tag condition: {wrong[0]!r}")
    return [(m["tag"], m["sign"], m["value"]) for _, m in found]


def tag_filter(tags: Column, text: str, required: bool) -> Column:
    """Whether all conditions hold; a tag that is absent fails if required and passes otherwise."""
    absent = F.lit(not required)
    each = [F.when(tags[c.tag].isNull(), absent).otherwise(c.holds(tags[c.tag])) for c in starmap(Condition, parse_tag_filter(text))]
    return reduce(lambda a, b: a & b, each)
