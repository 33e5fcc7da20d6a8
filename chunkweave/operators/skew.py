"""Row-level joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1_000


def hot_keys(rows: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """Keys holding more than 1/``share`` of all rows: fewer than ``share`` by construction."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows_of_key"))
    total = counts.agg(F.sum("rows_of_key")).scalar()
    return counts.where((F.col("rows_of_key") * share > total) & (F.col("rows_of_key") > 1)).select(key)


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "left", share: int = HOT_SHARE) -> DataFrame:
    """Join many ``rows`` to a ``lookup`` with unique keys (``left`` or ``inner``).

    Rows of hot keys stay where they are: the lookup's fewer than ``share`` rows for them are broadcast.
    The others meet in a merge join, in which a lookup that is stored by hash of the key does not move.
    ``rows`` is read three times, once for its key column only: pass a stored table.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"a join of kind {how!r} would repeat rows of the lookup")
    hot = F.broadcast(hot_keys(rows, key, share))
    spread = rows.join(hot, key, "left_semi").join(F.broadcast(lookup.join(hot, key, "left_semi")), key, how)
    others = rows.join(hot, key, "left_anti").join(lookup.hint("merge"), key, how)
    return spread.unionByName(others)
