"""What several operators of this subpackage need: input tables, shared tables, span expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions.arrays import running_sums
from chunkweave.functions.text import let
from chunkweave.session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written once to the shared folder and read from there: later steps neither
    compute it again nor lose it with an executor."""
    spark = frame.sparkSession
    folder = new_folder(spark, name)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def spread_join(rows: DataFrame, by_key: DataFrame, key: str, number: str) -> DataFrame:
    """``rows`` with the columns of ``by_key``, which has one row per key, none of them null, and says in
    ``number`` how many rows that key has.

    Keys with more than a thousandth of all rows are fewer than a thousand: they are broadcast, so their
    rows stay where they are. The others meet in a shuffle. Both inputs are read twice.
    """
    total = by_key.agg(F.sum(number)).first()[0] or 0
    hot = by_key.filter(F.col(number) * 1000 > total).drop(number)
    cold = by_key.filter(F.col(number) * 1000 <= total).drop(number)
    spread = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key)
    return spread.unionByName(others)


def spans(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, text>>`` of the leftmost non-overlapping matches, in code points.

    The texts between the matches give the offsets, so every match is found once by the regular
    expression engine and no position is searched twice.
    """

    def placed(found: Column) -> Column:
        before = F.transform(F.split(text, pattern, -1), F.length)
        lengths = F.transform(found, F.length)
        steps = F.zip_with(before, lengths, lambda gap, own: gap + F.coalesce(own, F.lit(0)))
        return let(
            running_sums(steps),
            lambda ends_before: let(
                before,
                lambda gaps: F.transform(
                    found,
                    lambda match, i: F.struct(
                        (F.get(ends_before, i) + F.get(gaps, i)).alias("start"),
                        (F.get(ends_before, i) + F.get(gaps, i) + F.length(match)).alias("end"),
                        match.alias("text"),
                    ),
                ),
            ),
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


NO_SPANS = "array<struct<start:int,end:int,text:string>>"


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)
