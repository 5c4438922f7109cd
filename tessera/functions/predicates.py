"""Predicates of scans: chains of terms `column op constant` under one connective, as the record layer takes them.

AND and OR over an empty chain are true, NOT over one is false, NONE is always true. NOT is the negation of the whole
conjunction. A term on a string may compare only its first `length` characters. Any Column may be used as well.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@dataclass(frozen=True)
class Term:
    column: str
    op: str
    value: Any
    length: int | None = None

    def expression(self) -> Column:
        if self.op not in OPERATORS:
            raise ValueError(f"illegal operator {self.op!r}")
        left, right = F.col(self.column), F.lit(self.value)
        if self.length is not None:
            left, right = F.substring(left, 1, self.length), F.substring(right, 1, self.length)
        return OPERATORS[self.op](left, right)


def chain(terms: Sequence[Term | Column], connective: str = "and") -> Column:
    """One boolean column out of a chain; connective is and, or, not or none."""
    made = [t.expression() if isinstance(t, Term) else t for t in terms]
    if connective == "none":
        return F.lit(True)
    if connective not in ("and", "or", "not"):
        raise ValueError(f"unknown connective {connective!r}")
    if not made:
        return F.lit(connective != "not")
    return reduce(operator.or_, made) if connective == "or" else ~reduce(operator.and_, made) if connective == "not" else reduce(operator.and_, made)


def three_way(left: Column, right: Column) -> Column:
    """-1, 0 or 1 as left is less than, equal to or greater than right; null if either is."""
    return F.when(left < right, -1).when(left > right, 1).when(left == right, 0)
