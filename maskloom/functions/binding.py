"""Binding an expression to a name inside one Column.

A Column that uses its input several times is copied by Catalyst for every use.
Chained rules would therefore grow as k^n, and a filter on the result is pushed
through projections with the same blow-up. A lambda variable is evaluated once
and never copied, so plans stay linear in the number of rules.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column], Column]


def let(value: Column, body: Step) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(start: Column, steps: Sequence[Step]) -> Column:
    """Feed ``start`` through ``steps`` in order.

    One ``reduce`` over step numbers: the expression is as deep for 400 steps as
    for two, and finding a step takes log2(n) comparisons.
    """

    def choose(state: Column, number: Column, low: int, high: int) -> Column:
        if high - low == 1:
            return steps[low](state)
        middle = (low + high) // 2
        left, right = choose(state, number, low, middle), choose(state, number, middle, high)
        return F.when(number < middle, left).otherwise(right)

    numbers = F.array(*[F.lit(i) for i in range(len(steps))])
    return F.reduce(numbers, start, lambda state, number: choose(state, number, 0, len(steps)))
