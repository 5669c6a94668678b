"""Folds over arrays that collect results, without copying all results at every step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas, where Spark shares no subexpressions."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def collected(items: Column, state: Column, empty: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column]) -> Column:
    """Fold ``items`` with ``step(acc, item)`` over acc = struct(state, out); ``out`` collects results from ``empty`` on.

    An array can only grow by being copied, so a step copies the results of its
    block of ``BLOCK`` items and each block is added to the whole once.
    """

    def whole(xs: Column) -> Column:
        def block(acc: Column, i: Column) -> Column:
            part = F.aggregate(F.slice(xs, i * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["state"].alias("state"), empty.alias("out")), step)
            return let(part, lambda p: F.struct(p["state"].alias("state"), F.concat(acc["out"], p["out"]).alias("out")))

        blocks = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(blocks, F.struct(state.alias("state"), empty.alias("out")), block, finish)

    return let(items, whole)
