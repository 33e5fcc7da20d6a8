"""Quality rules whose cutoffs carry a guarantee on how many good documents they reject.

Every rule compares one measure of a text (larger is worse) with a cutoff. Labelled documents are the
holdout. A cutoff is certified for a stratum if an exact binomial test refutes that it rejects more than
its share ``alpha / number of rules`` of the good documents there. Two corrections keep the error of
*all* certificates together below ``delta``: the tests of one rule and stratum run in a fixed order from
the most lenient cutoff and stop at the first that fails (so they share one level), and that level is
``delta`` divided by the number of (stratum, rule) pairs. Of the certified cutoffs the one with the best
balance of bad against good documents rejected is used; a rule that gains nothing is not used. Where a
stratum has too few labelled documents nothing is certified and only the base rules act.

Only DataFrame expressions. Texts never leave their row; the measures are computed once and stored.

Defined results: a null or empty text has no words and fails the base rules; a null language is the
stratum ``''``; a document labelled both good and bad counts as neither, null labels are ignored;
repeated rows are judged alike; with no labels only the base rules act. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.functions.arrays import rows_of
from chunkweave.functions.text import let
from chunkweave.llm.common import stored

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[^#*$%&|<>]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3

#: Cutoffs of each measure from the most lenient one on.
CUTOFFS = {
    "symbol_ratio": [2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1, 0.05],
    "shout_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "mark_ratio": [2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2],
    "dup_line_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "repeat_ratio": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "word_length": [20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0],
}
ALPHA = 0.02
DELTA = 0.05
GOOD_COST = 10.0


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES, -1), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Number of words inside a window of three words that occurs twice or more.

    Windows are sorted with their places, so equal ones are neighbours; the words they cover are
    counted once. Near-linear in the text, whatever repeats.
    """

    def covered(all_words: Column) -> Column:
        windows = F.transform(
            F.slice(all_words, F.lit(1), F.greatest(F.size(all_words) - (WINDOW - 1), F.lit(0))),
            lambda w, i: F.struct(F.concat_ws(" ", w, *[F.get(all_words, i + k) for k in range(1, WINDOW)]).alias("w"), i.alias("i")),
        )
        places = let(
            F.sort_array(windows),
            lambda s: F.filter(
                s, lambda x, i: x["w"].eqNullSafe(F.get(s, i - 1)["w"]) | x["w"].eqNullSafe(F.get(s, i + 1)["w"])
            ),
        )
        return F.size(
            F.array_distinct(F.flatten(F.transform(places, lambda x: F.array(*[x["i"] + k for k in range(WINDOW)]))))
        )

    return let(words, covered)


def _joined_length(text: Column, pattern: str) -> Column:
    return F.length(F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), ""))


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id, stratum``, the counts and the measures that the rules compare."""
    text = F.col("text")
    plain = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), F.coalesce("text", F.lit("")).alias("text"))
    arrays = plain.withColumns(
        {"words": words_of(text), "lines": F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))}
    )
    counted = arrays.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.when(text.rlike("[#*$%&|<>]"), F.length(F.regexp_replace(text, SYMBOLS, ""))).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(text.rlike(r"\p{Lu}{3}"), _joined_length(text, r"\p{Lu}{3,}")).otherwise(0).cast("long").alias("n_shouted"),
        F.when(text.rlike(r"[!?]{2}"), _joined_length(text, r"[!?]{2,}")).otherwise(0).cast("long").alias("n_marks"),
    )

    def ratio(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return counted.select(
        "doc_id",
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_shouted", "word_chars").alias("shout_ratio"),
        ratio("n_marks", "n_words").alias("mark_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        ratio("word_chars", "n_words").alias("word_length"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )


def log_lower_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(Binomial(n, p) <= k), exact up to rounding: terms follow from one another and are added
    as logarithms, so nothing underflows."""

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + math.log(p / (1 - p))
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    first = n * F.lit(math.log1p(-p))
    return F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("term"), first.alias("total")),
        add,
        lambda acc: acc["total"],
    )


def certified_cutoffs(
    measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, good_cost: float = GOOD_COST, cutoffs: dict = CUTOFFS
) -> DataFrame:
    """``(stratum, <rule>_cutoff ...)``: the certified cutoff of each rule, null where none is used.

    Each labelled document becomes one row per rule holding the first step whose cutoff it exceeds (and
    with it all later ones, which are stricter); all further tables have strata x rules x cutoffs rows.
    """
    agreed = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .filter("low = high")
        .select(F.col("doc_id").alias("labelled"), (F.col("low") > 0).alias("good"))
    )
    held = measured.join(agreed, F.col("doc_id") == F.col("labelled"))
    levels = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                (len(values) + 1 - sum((F.col(rule) > c).cast("int") for c in values)).alias("from_step"),
            )
            for rule, values in cutoffs.items()
        ]
    )
    counts = (
        held.select("stratum", "good", F.explode(rows_of(levels)).alias("level"))
        .groupBy("stratum", "level.rule", "level.from_step")
        .agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    )
    grid = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.lit(i + 1).alias("step"), F.lit(float(c)).alias("cutoff"))
            for rule, values in cutoffs.items()
            for i, c in enumerate(values)
        ]
    )
    strata = counts.groupBy("stratum").agg(F.lit(1).alias("one"))
    tests = strata.select("stratum", F.explode(grid).alias("t")).select("stratum", "t.*")
    share = alpha / len(cutoffs)
    cell = Window.partitionBy("stratum", "rule")
    rejected = (
        tests.join(
            counts.withColumnRenamed("rule", "of_rule").withColumnRenamed("stratum", "of_stratum"),
            (F.col("rule") == F.col("of_rule")) & (F.col("stratum") == F.col("of_stratum")),
        )
        .groupBy("stratum", "rule", "step", "cutoff")
        .agg(
            F.sum("good").alias("n_good"),
            F.sum("bad").alias("n_bad"),
            F.sum(F.when(F.col("step") >= F.col("from_step"), F.col("good")).otherwise(0)).alias("k_good"),
            F.sum(F.when(F.col("step") >= F.col("from_step"), F.col("bad")).otherwise(0)).alias("k_bad"),
        )
    )
    n_strata = F.first("n_strata").over(cell)
    total = strata.agg(F.count("*").alias("n_strata"))
    level = F.log(F.lit(delta) / (n_strata * len(cutoffs)))
    passes = F.when(
        F.col("k_good") < share * F.col("n_good"), log_lower_tail(F.col("k_good"), F.col("n_good"), share) <= level
    ).otherwise(F.lit(False))
    gain = F.col("k_bad") / F.greatest(F.col("n_bad"), F.lit(1)) - good_cost * F.col("k_good") / F.greatest(F.col("n_good"), F.lit(1))
    certified = (
        rejected.join(F.broadcast(total))  # one row
        .withColumn("passes", passes)
        .withColumn("so_far", F.min(F.col("passes").cast("int")).over(cell.orderBy("step")))
        .filter("so_far = 1")
        .withColumn("gain", gain)
        .filter("gain > 0")
        .groupBy("stratum", "rule")
        .agg(F.max_by("cutoff", F.struct("gain", -F.col("step"))).alias("cutoff"))
    )
    return certified.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"{rule}_cutoff") for rule in cutoffs]
    )


def judge(docs: DataFrame, labels: DataFrame, cutoffs: dict = CUTOFFS, **levels: float) -> DataFrame:
    """One row per document: counts, measures, ``base_failed``, ``failed_rules`` and ``kept``."""
    measured = stored(measures(docs), "quality-measures")
    chosen = stored(certified_cutoffs(measured, labels, cutoffs=cutoffs, **levels), "quality-cutoffs").withColumnRenamed("stratum", "of_stratum")
    judged = measured.join(chosen, F.col("stratum") == F.col("of_stratum"), "left")
    failed = F.filter(
        F.array(*[F.when(F.col(rule) > F.col(f"{rule}_cutoff"), F.lit(rule)) for rule in cutoffs]), lambda r: r.isNotNull()
    )
    return (
        judged.withColumn("failed_rules", F.array_join(failed, ","))
        .withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
        .drop("of_stratum")
    )
