"""Mixing sources to target weights by hierarchical budgets.

A token budget goes down a tree (by default domain, language, source). At every node the children share
it by weight, but none gets more than its subtree can give (its tokens times ``max_epochs``). What one
cannot use goes to its siblings by weight; because a parent's own share was capped by what its subtree
can give, only what no sibling can use has gone to the ancestors' other children.

Each leaf then takes whole epochs, and of the next epoch the longest prefix that fits, in an order
seeded by the epoch. The place of the cut is found by token sums of 4096 hash buckets and a sort of the
one bucket that holds it, so no leaf is ever sorted or gathered, whatever share of all rows it has. The
decision for a document needs only its leaf's row of a small table; texts do not move.

All amounts are integers. Children's shares are rounded down, so a node may fall short of its budget by
less than a token per child.

Defined results: null levels count as ``''``; null and empty texts have no tokens and are never taken;
repeated rows are taken together or not at all; rows with a null ``doc_id`` share one place in the order
of their leaf; a zero weight takes nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.llm.common import stored

LEVELS = ("domain", "lang", "source")
SPACES = r"[\x20\x09-\x0D]+"
SHARE_PERCENT = 60
MAX_EPOCHS = 2
SEED = 17
BUCKET_DIGITS = 3

#: Weights of the registered query; a name that is not listed weighs 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def word_tokens(text: Column) -> Column:
    """Number of words, the default measure of a text."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACES, -1), lambda w: w != "")), F.lit(0)).cast("long")


def source_domain(source: Column) -> Column:
    """The documents name no domain: every fourth source number belongs to the same one."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract(source, r"([0-9]+)$", 1).try_cast("long") % 4, F.lit(0)).cast("string"))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    named = weights.get(level, {})
    if not named:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for name, weight in named.items() for x in (name, weight)])
    return F.coalesce(table[F.col(level)], F.lit(1)).cast("long")


def _wide(column: Column) -> Column:
    return column.cast("decimal(19,0)")


def shared_out(children: DataFrame, parents: DataFrame, parent: Sequence[str], level: str, weights) -> DataFrame:
    """``children(parent..., level, capacity)`` with the ``budget`` each gets of its parent's.

    Ordered by capacity per weight, the children that saturate come first: one does if its capacity is
    at most its share of what the ones before it leave.
    """
    weighted = children.withColumn("weight", _weight(level, weights)).filter("weight > 0 AND capacity > 0")
    joined = (
        weighted.join(parents.select(*parent, F.col("budget").alias("given")), list(parent))
        if parent
        else weighted.join(parents.select(F.col("budget").alias("given")))  # one row
    )
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = siblings.orderBy(F.col("capacity") / F.col("weight"), level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = joined.withColumns(
        {
            "used": F.sum("capacity").over(ordered) - F.col("capacity"),
            "rest": F.sum("weight").over(siblings) - F.sum("weight").over(ordered) + F.col("weight"),
        }
    ).withColumn("full", _wide(F.col("capacity")) * _wide(F.col("rest")) <= _wide(F.col("weight")) * _wide(F.col("given") - F.col("used")))
    left = ranked.withColumns(
        {
            "left_tokens": F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(siblings), F.lit(0)),
            "left_weight": F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(siblings), F.lit(0)),
        }
    )
    part = F.expr("CAST(left_tokens AS decimal(19,0)) * CAST(weight AS decimal(19,0)) div CAST(left_weight AS decimal(19,0))")
    return left.select(*parent, level, "capacity", F.when(F.col("full"), F.col("capacity")).otherwise(part).cast("long").alias("budget"))


def budgets(leaves: DataFrame, levels: Sequence[str], weights, share_percent: int, max_epochs: int) -> DataFrame:
    """``(levels..., tokens, budget)`` of ``leaves(levels..., tokens)``."""
    able = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    found = able.agg(F.least(F.sum("capacity"), F.expr(f"sum(tokens) * {share_percent} div 100")).alias("budget"))
    for depth, level in enumerate(levels):
        own = able.groupBy(*levels[: depth + 1]).agg(F.sum("capacity").alias("capacity"))
        found = shared_out(own, found, levels[:depth], level, weights)
    return leaves.join(found.select(*levels, "budget"), list(levels))


def _place(doc_id: Column, epoch: Column, seed: int) -> Column:
    """A document's place in the order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def plan_leaves(measured: DataFrame, levels=LEVELS, weights=WEIGHTS, share_percent=SHARE_PERCENT, max_epochs=MAX_EPOCHS, seed=SEED) -> DataFrame:
    """What every leaf takes: ``(levels..., tokens, budget, whole, last_place)``.

    ``whole`` epochs are taken entirely; of the next one the documents with a place up to ``last_place``.
    ``measured`` has ``doc_id``, the levels and ``tokens``; it is read four times, so it should be stored.
    """
    levels = list(levels)
    leaves = stored(
        budgets(measured.filter("tokens > 0").groupBy(*levels).agg(F.sum("tokens").alias("tokens")), levels, weights, share_percent, max_epochs)
        .withColumn("whole", F.expr("budget div tokens"))
        .withColumn("part", F.expr("budget % tokens")),
        "mix-leaves",
    )
    partial = leaves.filter("part > 0").select(*levels, "whole", "part")
    placed = (
        measured.filter("tokens > 0")
        .join(partial, levels)
        .withColumn("place", _place(F.col("doc_id"), F.col("whole"), seed))
        .withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
        .select(*levels, "place", "bucket", "tokens", "part")
    )
    sums = placed.groupBy(*levels, "bucket", "part").agg(F.sum("tokens").alias("held"))
    upto = F.sum("held").over(Window.partitionBy(*levels).orderBy("bucket"))
    cut_buckets = stored(
        sums.withColumn("upto", upto)
        .filter("upto > part AND upto - held <= part")
        .select(*levels, "bucket", (F.col("part") - F.col("upto") + F.col("held")).alias("room")),
        "mix-buckets",
    )
    inside = placed.join(cut_buckets, [*levels, "bucket"])
    running = F.sum("tokens").over(Window.partitionBy(*levels, "bucket").orderBy("place"))
    cuts = inside.withColumn("running", running).filter("running <= room").groupBy(*levels).agg(F.max("place").alias("cut"))
    return stored(
        leaves.join(cut_buckets.select(*levels, "bucket"), levels, "left")
        .join(cuts, levels, "left")
        .select(*levels, "tokens", "budget", "whole", F.coalesce("cut", "bucket").alias("last_place")),
        "mix-plan",
    )


def epochs_of(doc_id: Column, whole: Column, last_place: Column, seed: int = SEED) -> Column:
    """How often a document with tokens is taken, given its leaf's row of the plan."""
    extra = F.coalesce((_place(doc_id, whole, seed) <= last_place).cast("int"), F.lit(0))
    return (whole + extra).cast("int")


def mix(docs: DataFrame, domain: Column, tokens: Column, **options) -> DataFrame:
    """``(doc_id, domain, lang, source, n_tokens, epochs)`` of the documents that are taken at least once."""
    measured = stored(
        docs.select(
            "doc_id",
            F.coalesce(domain, F.lit("")).alias("domain"),
            F.coalesce("lang", F.lit("")).alias("lang"),
            F.coalesce("source", F.lit("")).alias("source"),
            tokens.alias("tokens"),
        ),
        "mix-measured",
    )
    plan = plan_leaves(measured, **options).select(*LEVELS, "whole", "last_place")
    taken = measured.filter("tokens > 0").join(plan, list(LEVELS))
    seed = options.get("seed", SEED)
    return (
        taken.withColumn("epochs", epochs_of(F.col("doc_id"), F.col("whole"), F.col("last_place"), seed))
        .filter("epochs > 0")
        .select("doc_id", *LEVELS, F.col("tokens").alias("n_tokens"), "epochs")
    )


def selected(docs: DataFrame, domain: Column, tokens: Column, **options) -> DataFrame:
    """The rows that the plan takes at least once; all columns stay as they are. Each row meets only its
    leaf's row of the plan."""
    level = {"domain": F.coalesce(domain, F.lit("")), "lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))}
    measured = stored(docs.select("doc_id", *[c.alias(name) for name, c in level.items()], tokens.alias("tokens")), "mix-measured")
    plan = plan_leaves(measured, **options).select(*[F.col(name).alias(f"_leaf_{name}") for name in LEVELS], F.col("whole").alias("_leaf_whole"), F.col("last_place").alias("_leaf_last"))
    seed = options.get("seed", SEED)
    taken = epochs_of(F.col("doc_id"), F.col("_leaf_whole"), F.col("_leaf_last"), seed) > 0
    same = [level[name] == F.col(f"_leaf_{name}") for name in LEVELS]
    return docs.filter(tokens > 0).join(plan, same[0] & same[1] & same[2] & taken, "left_semi")
