"""Size limits of enriched chunks: split what is too long, merge what is too short."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkweave.functions.text import char_estimate, join_lines, let, split_lines, strip

MAX_CHUNK_TOKENS = 800
MIN_CHUNK_TOKENS = 120
MAX_SEGMENTS_PER_REQUEST = 8

ENRICHED = (
    "struct<id:string,text:string,title:string,summary:string,tags:array<string>,"
    "anchors:map<string,string>,relations:map<string,string>,metadata:map<string,string>>"
)
NO_TEXTS = "array<string>"


def oversize_parts(text: Column, max_tokens: int = MAX_CHUNK_TOKENS) -> Column:
    """Runs of whole lines whose joined text stays within the estimate; blank runs vanish."""
    state = F.struct(F.array().cast(NO_TEXTS).alias("held"), F.array().cast(NO_TEXTS).alias("done"))

    def add(acc: Column, line: Column) -> Column:
        longer = F.concat(acc["held"], F.array(line))
        return let(
            longer,
            lambda lines: F.when(
                (F.size(acc["held"]) > 0) & (char_estimate(F.array_join(lines, "\n")) > max_tokens),
                F.struct(
                    F.array(line).alias("held"),
                    F.concat(acc["done"], F.array(join_lines(acc["held"]))).alias("done"),
                ),
            ).otherwise(F.struct(lines.alias("held"), acc["done"].alias("done"))),
        )

    parts = F.aggregate(
        split_lines(text), state, add, lambda acc: F.concat(acc["done"], F.array(join_lines(acc["held"])))
    )
    return F.filter(parts, lambda p: p != "")


def split_oversize(chunks: Column, max_tokens: int = MAX_CHUNK_TOKENS) -> Column:
    """Chunks over the limit become ``id:part:n``; all other fields are carried along.

    The last part keeps the plain id when it is the only one.
    """

    def pieces(chunk: Column) -> Column:
        def named(parts: Column) -> Column:
            return F.when(F.size(parts) == 0, F.array(chunk)).otherwise(
                F.transform(
                    parts,
                    lambda p, i: chunk.withField(
                        "id",
                        F.when(F.size(parts) == 1, chunk["id"]).otherwise(
                            F.concat(chunk["id"], F.lit(":part:"), i)
                        ),
                    ).withField("text", p),
                )
            )

        return F.when(
            char_estimate(chunk["text"]) > max_tokens, let(oversize_parts(chunk["text"], max_tokens), named)
        ).otherwise(F.array(chunk))

    return F.flatten(F.transform(chunks, pieces))


def merge_small(chunks: Column, min_tokens: int = MIN_CHUNK_TOKENS) -> Column:
    """While a chunk is below the minimum the next one is appended to it.

    Ids join with ``+``, texts with a blank line, tags form a sorted set, and the first non-empty
    title and summary win; everything else stays that of the first chunk.
    """
    # One pass decides which neighbours belong together; the texts are joined once per group.
    state = F.struct(
        F.lit("").alias("open"),
        F.array().cast("array<int>").alias("members"),
        F.array().cast("array<array<int>>").alias("done"),
    )

    def build(items: Column) -> Column:
        def add(acc: Column, at: Column) -> Column:
            text = F.get(items, at)["text"]
            return (
                F.when(
                    F.size(acc["members"]) == 0,
                    F.struct(text.alias("open"), F.array(at).alias("members"), acc["done"].alias("done")),
                )
                .when(
                    char_estimate(acc["open"]) >= min_tokens,
                    F.struct(
                        text.alias("open"),
                        F.array(at).alias("members"),
                        F.concat(acc["done"], F.array(acc["members"])).alias("done"),
                    ),
                )
                .otherwise(
                    F.struct(
                        strip(F.concat(acc["open"], F.lit("\n\n"), text)).alias("open"),
                        F.concat(acc["members"], F.array(at)).alias("members"),
                        acc["done"].alias("done"),
                    )
                )
            )

        groups = F.aggregate(
            F.transform(items, lambda _, i: i),
            state,
            add,
            lambda acc: F.when(
                F.size(acc["members"]) > 0, F.concat(acc["done"], F.array(acc["members"]))
            ).otherwise(acc["done"]),
        )

        def first_filled(group: Column, field: str) -> Column:
            filled = F.filter(
                F.transform(group, lambda at: F.get(items, at)[field]), lambda v: v.isNotNull() & (v != "")
            )
            return F.coalesce(F.get(filled, F.lit(0)), F.lit(""))

        def merged(group: Column) -> Column:
            head = F.get(items, F.get(group, F.lit(0)))
            tags = F.array_sort(
                F.array_distinct(F.flatten(F.transform(group, lambda at: F.get(items, at)["tags"])))
            )
            text = F.aggregate(
                F.slice(group, F.lit(2), F.size(group)),
                head["text"],
                lambda acc, at: strip(F.concat(acc, F.lit("\n\n"), F.get(items, at)["text"])),
            )
            joined = (
                head.withField("id", F.array_join(F.transform(group, lambda at: F.get(items, at)["id"]), "+"))
                .withField("text", text)
                .withField("title", first_filled(group, "title"))
                .withField("summary", first_filled(group, "summary"))
                .withField("tags", tags)
            )
            return F.when(F.size(group) == 1, head).otherwise(joined)

        return F.transform(groups, merged)

    return let(chunks, build)


def apply_constraints(
    chunks: Column, max_tokens: int = MAX_CHUNK_TOKENS, min_tokens: int = MIN_CHUNK_TOKENS
) -> Column:
    """Split first, merge second; a merge may therefore exceed the maximum again."""
    return merge_small(split_oversize(chunks, max_tokens), min_tokens)
