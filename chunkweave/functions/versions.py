"""Version strings as sortable columns.

A version is cut at ``.``; every part becomes ``(base tokens, stage rank, stage number, rest)``.
Spark orders arrays and structs lexicographically, so the array of these structs *is* the sort key
and ``max_by`` / ``orderBy`` need no user code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkweave.functions.text import let, safe_segment, strip

# Release stages in ascending order.
STAGE_RANKS = {
    "dev": 0,
    "snapshot": 0,
    "nightly": 0,
    "a": 10,
    "alpha": 10,
    "b": 20,
    "beta": 20,
    "pre": 30,
    "preview": 30,
    "rc": 40,
    "candidate": 40,
    "stable": 90,
    "release": 90,
    "ga": 90,
    "final": 100,
}
UNKNOWN_STAGE = 50
NO_QUALIFIER = 1000


def _number(digits: Column) -> Column:
    """A digit run of any length as (length, digits) without leading zeros, which orders by value."""
    return let(
        F.regexp_replace(digits, r"^0+(?=\d)", ""), lambda bare: F.struct(F.length(bare).alias("length"), bare.alias("digits"))
    )


def _zero() -> Column:
    return F.struct(F.lit(1).alias("length"), F.lit("0").alias("digits"))


def _stages() -> Column:
    return F.create_map(*[F.lit(x) for pair in STAGE_RANKS.items() for x in pair])


def _tokens(text: Column) -> Column:
    """Digit runs (kind 0) and other runs (kind 1, lower-cased), in order."""

    def token(run: Column) -> Column:
        digits = F.substring(run, 1, 1).between("0", "9")
        return F.when(
            digits,
            F.struct(F.lit(0).alias("kind"), _number(run).alias("num"), F.lit("").alias("word")),
        ).otherwise(F.struct(F.lit(1).alias("kind"), _zero().alias("num"), F.lower(run).alias("word")))

    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1)), token)


def _is_stage(token: Column) -> Column:
    return (token["kind"] == 1) & F.map_contains_key(_stages(), token["word"])


def _first_where(items: Column, start: Column, test) -> Column:
    """1-based position of the first element at or after ``start`` passing ``test``; null if none."""
    hits = F.filter(
        F.transform(items, lambda item, at: F.when((at + 1 >= start) & test(item), at + 1)),
        lambda at: at.isNotNull(),
    )
    return F.get(hits, F.lit(0))


def _qualifier(words: Column) -> Column:
    """(rank, number, rest) of the dash-separated words after the base.

    The prefix up to and including the first ordinary token after a stage word decides rank (its
    last stage word) and rest (its ordinary tokens); the number is the first one after the first
    stage word, wherever it stands.
    """
    flat = F.flatten(F.transform(words, lambda w: _tokens(strip(w))))

    def ranked(tokens: Column) -> Column:
        stage_at = _first_where(tokens, F.lit(1), _is_stage)

        def with_stage(at: Column) -> Column:
            stop = _first_where(tokens, at + 1, lambda t: ~_is_stage(t))
            head = F.slice(tokens, F.lit(1), F.coalesce(stop, F.size(tokens)))
            number_at = _first_where(tokens, at + 1, lambda t: t["kind"] == 0)
            return F.struct(
                F.element_at(
                    F.transform(F.filter(head, _is_stage), lambda t: F.element_at(_stages(), t["word"])), -1
                ).alias("rank"),
                F.coalesce(F.get(tokens, number_at - 1)["num"], _zero()).alias("number"),
                F.filter(head, lambda t: ~_is_stage(t)).alias("rest"),
            )

        none = F.struct(
            F.lit(UNKNOWN_STAGE).alias("rank"), _zero().alias("number"), tokens.alias("rest")
        )
        return let(stage_at, lambda at: F.when(at.isNull(), none).otherwise(with_stage(at)))

    bare = F.struct(
        F.lit(NO_QUALIFIER).alias("rank"),
        _zero().alias("number"),
        F.filter(_tokens(F.lit("")), lambda t: F.lit(False)).alias("rest"),
    )
    return F.when(F.size(words) == 0, bare).otherwise(let(flat, ranked))


def version_key(version: Column) -> Column:
    """Array of (base, rank, number, rest) structs; comparing two keys orders two versions."""

    def part(text: Column) -> Column:
        def keyed(words: Column) -> Column:
            # Only a part with a dash has a qualifier; a part of dashes alone is its own base.
            lone = ~F.contains(text, F.lit("-")) | (F.size(words) == 0)
            base = F.when(lone, strip(text)).otherwise(F.get(words, F.lit(0)))
            rest = F.when(lone, F.filter(words, lambda w: F.lit(False))).otherwise(
                F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
            )
            return let(
                rest,
                lambda r: let(
                    _qualifier(r),
                    lambda q: F.struct(
                        _tokens(base).alias("base"),
                        q["rank"].alias("rank"),
                        q["number"].alias("number"),
                        q["rest"].alias("rest"),
                    ),
                ),
            )

        return let(F.filter(F.split(strip(text), "-", -1), lambda w: w != ""), keyed)

    parts = F.filter(F.split(F.coalesce(version, F.lit("")), r"\.", -1), lambda p: p != "")
    return F.transform(parts, part)


def sort_text(vkey: Column) -> Column:
    """A key of ``version_key`` as text that sorts as the key does, in a tenth of its room.

    An element of a list begins with ``02`` and a list ends with ``01``, so a shorter list comes first; a word ends
    with ``00``, and ``00`` and ``01`` within words are written as pairs.
    """

    def number(n: Column) -> Column:
        return F.concat(F.lpad(n["length"].cast("string"), 10, "0"), n["digits"])

    def word(w: Column) -> Column:
        plain = F.replace(F.replace(w, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
        return F.concat(plain, F.lit("\x00"))

    def items(values: Column, text) -> Column:
        return F.concat(F.array_join(F.transform(values, lambda v: F.concat(F.lit("\x02"), text(v))), ""), F.lit("\x01"))

    def token(t: Column) -> Column:
        return F.when(t["kind"] == 0, F.concat(F.lit("0"), number(t["num"]))).otherwise(F.concat(F.lit("1"), word(t["word"])))

    def part(p: Column) -> Column:
        return F.concat(items(p["base"], token), F.lpad(p["rank"].cast("string"), 4, "0"), number(p["number"]), items(p["rest"], token))

    return items(vkey, part)


def compare_keys(left: Column, right: Column) -> Column:
    """-1, 0 or 1 for two sort keys."""
    return F.when(left < right, F.lit(-1)).when(left > right, F.lit(1)).otherwise(F.lit(0))


def version_parts(version: Column) -> Column:
    """Dot-separated parts made safe for paths, empty ones dropped."""
    return F.filter(F.transform(F.split(strip(version), r"\.", -1), safe_segment), lambda p: p != "")


def requested_version(version: Column) -> Column:
    """Null when nothing was asked for, ``latest`` in any case folded, else the trimmed text."""
    asked = strip(version)
    return F.when(F.length(asked) == 0, F.lit(None).cast("string")).when(
        F.lower(asked) == "latest", F.lit("latest")
    ).otherwise(asked)
