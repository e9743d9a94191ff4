"""Folds over arrays that append, in time n ** 1.5.

aggregate() with concat() copies what it has at every step, which is quadratic in the array's length. Here the array is cut into
about sqrt(n) blocks: each block appends to an array of its own, and only whole blocks are appended to the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use mentions it."""
    return F.transform(F.array(value), use)[0]


def blocks_of(x: Column) -> Column:
    """The array in blocks of about sqrt(n) elements; an empty array in none."""
    size = F.ceil(F.sqrt(F.size(x))).cast("int")
    blocks = let(size, lambda k: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / k).cast("int")), lambda b: F.slice(x, b * k + 1, k)))
    return F.when(F.size(x) > 0, blocks).otherwise(F.slice(F.array(x), 1, 0))


def fold_append(x: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """An array of all that step appends. step(state, element) gives the next state and an array<out> to append."""
    none = F.array().cast(f"array<{out}>")

    def one(acc: Column, e: Column) -> Column:
        after, more = step(acc["state"], e)
        return F.struct(after.alias("state"), F.concat(acc["out"], more).alias("out"))

    def block(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda v: F.struct(v["state"].alias("state"), F.concat(acc["outs"], F.array(v["out"])).alias("outs")))

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{out}>>").alias("outs"))
    return F.flatten(F.aggregate(blocks_of(x), start, block, lambda acc: acc["outs"]))


def sums_before(x: Column) -> Column:
    """Of each element of an array of whole numbers, the sum of those before it."""
    return fold_append(x, F.lit(0).cast("long"), lambda s, v: (s + v, F.array(s)), "bigint")
