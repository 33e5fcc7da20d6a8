"""Array helpers that stay close to linear on very long arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkweave.functions.text import let

BLOCK = 1024


def rows_of(items: Column) -> Column:
    """``items`` as the input of ``posexplode``.

    From a bare column Spark infers the filter ``size(items) > 0``, pushes it below the projection
    that made the column, and so computes an expensive column two more times.
    """
    return F.transform(items, lambda item: item)


def span(size: Column) -> Column:
    """[0, 1, ..., size-1], empty for zero (``sequence`` would count down)."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def _sums_before(values: Column) -> Column:
    return F.aggregate(
        values,
        F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct(
            (acc["total"] + x).alias("total"), F.concat(acc["out"], F.array(acc["total"])).alias("out")
        ),
        lambda acc: acc["out"],
    )


def running_sums(values: Column) -> Column:
    """Sum of the elements before each one. Two levels of blocks, so appending never copies far."""

    def blocks_of(all_values: Column) -> Column:
        n_blocks = F.ceil(F.size(all_values) / F.lit(BLOCK)).cast("int")
        return F.transform(span(n_blocks), lambda b: F.slice(all_values, b * BLOCK + 1, F.lit(BLOCK)))

    def summed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
        return let(
            _sums_before(totals),
            lambda offsets: F.flatten(
                F.transform(
                    blocks, lambda b, i: F.transform(_sums_before(b), lambda s: s + F.get(offsets, i))
                )
            ),
        )

    return let(values, lambda v: let(blocks_of(v), summed))


def first_of_each(items: Column, key) -> Column:
    """Elements whose key did not occur before, in order (sort-based, not pairwise)."""

    def kept(all_items: Column) -> Column:
        ranked = F.array_sort(
            F.transform(all_items, lambda item, i: F.struct(key(item).alias("key"), i.alias("at")))
        )
        firsts = let(
            ranked,
            lambda r: F.filter(r, lambda e, i: (i == 0) | ~e["key"].eqNullSafe(F.get(r, i - 1)["key"])),
        )
        return F.transform(
            F.array_sort(F.transform(firsts, lambda e: e["at"])), lambda at: F.get(all_items, at)
        )

    return let(items, kept)
