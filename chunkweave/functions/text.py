"""Text primitives with Python's Unicode rules, as JVM column expressions.

Java's ``\\s`` and ``trim`` know ASCII only, so the white-space and line-break sets are spelled out
once here and used by every operator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip(), str.split() and str.splitlines() act on.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_SET = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# The same for Java, which tests a letter against every range of a set: few tests, not many.
ANY_SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
ANY_BREAK = r"[[^ -~]&&[^\x{a1}-\x{167f}]&&[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]](?:(?<=\r)\n)?"


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable so that ``body`` can use it many times at one cost.

    The finish of a fold over nothing: other than the result of ``transform``, its result is not copied.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE_CHARS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACE_CHARS))


def is_blank(text: Column) -> Column:
    return lstrip(text) == ""  # ends at the first other character


def split_lines(text: Column) -> Column:
    """Lines without their breaks; a final break opens no empty last line."""
    return let(
        F.split(text, ANY_BREAK, -1),
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts),
    )


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, f"{ANY_SPACE}+", -1), lambda word: word != "")


def word_count(text: Column) -> Column:
    """Word tokens; any non-empty text counts as at least one.

    Counting the pieces of a split is several times faster than ``regexp_count``, which collects
    every match.
    """
    edge = lambda piece: F.when(piece == "", F.lit(1)).otherwise(F.lit(0))
    return F.when(text == "", F.lit(0)).otherwise(
        let(
            F.split(text, f"{ANY_SPACE}+", -1),
            lambda p: F.greatest(
                F.lit(1), F.size(p) - edge(F.element_at(p, 1)) - edge(F.element_at(p, -1))
            ),
        )
    )


def char_estimate(text: Column) -> Column:
    """A quarter of the trimmed length, at least one unless the text is blank."""
    return let(
        F.length(strip(text)),
        lambda n: F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int"),
    )


def join_lines(lines: Column) -> Column:
    return strip(F.array_join(lines, "\n"))


def compact_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{ANY_SPACE}+", " "))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def path_suffix(path: Column) -> Column:
    """Lower-cased extension of the last path component, '' where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def path_parts(path: Column) -> Column:
    """Sort key: paths order by component, so ``a/b`` precedes ``a-b``."""
    return F.split(path, "/", -1)


def safe_segment(text: Column) -> Column:
    """A version or name part reduced to file-system-safe characters."""
    slashes = F.translate(strip(text), "\\/", "--")
    cleaned = F.regexp_replace(slashes, r"[^a-zA-Z0-9._\-+@]+", "-")
    return F.coalesce(F.trim(cleaned, F.lit("-")), F.lit(""))


def display_line(text: Column, limit: int = 160) -> Column:
    """One line of at most ``limit`` characters, cut with an ellipsis of dots."""
    return let(
        strip(F.replace(text, F.lit("\n"), F.lit(" "))),
        lambda t: F.when(
            F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))
        ).otherwise(t),
    )


def optional_bool(text: Column) -> Column:
    """Null for an empty value, false for the words of refusal, true for anything else."""
    word = F.lower(strip(text))
    return (
        F.when(text.isNull() | (text == ""), F.lit(None).cast("boolean"))
        .when(word.isin("0", "false", "no", "off"), F.lit(False))
        .otherwise(F.length(text) > 0)
    )


def _glob_set(token: Column) -> Column:
    """A ``[set]`` token as a Java class in which only ``-`` between characters has a meaning."""
    negated = F.substring(token, 2, 1) == "!"
    inner = F.when(negated, F.substring(token, 3, F.length(token) - 3)).otherwise(F.substring(token, 2, F.length(token) - 2))
    # A range that runs backwards holds nothing.
    turned = F.filter(
        F.regexp_extract_all(inner, F.lit(r"(?s).-."), F.lit(0)), lambda r: F.substring(r, 1, 1) > F.substring(r, 3, 1)
    )
    kept = F.aggregate(turned, inner, lambda acc, r: F.replace(acc, r, F.lit("")))
    quoted = F.regexp_replace(kept, r"([\\\[\]^&~|#\s])", r"\\$1")
    return (
        F.when((kept == "") & negated, F.lit("(?s:.)"))
        .when(kept == "", F.lit("(?!)"))
        .otherwise(F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), quoted, F.lit("]")))
    )


def glob_match(value: Column, pattern: Column) -> Column:
    """Case-sensitive shell pattern on the whole value (``*``, ``?``, ``[set]`` and ``[!set]``).

    The pattern is cut into tokens and each is translated on its own; a bracket that is never closed
    is an ordinary character.
    """
    tokens = F.regexp_extract_all(pattern, F.lit(r"(?s)\[!?\]?[^\]]*\]|."), F.lit(0))
    regex = F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(t == "*", F.lit("(?s:.*)"))
            .when(t == "?", F.lit("(?s:.)"))
            .when((F.length(t) > 2) & t.startswith("["), _glob_set(t))
            .otherwise(F.regexp_replace(t, r"([\\.^$|(){}+\[\]*?])", r"\\$1")),
        ),
        "",
    )
    return F.regexp_like(value, F.concat(F.lit("^(?:"), regex, F.lit(r")\z")))


def glob_ends(pattern: Column) -> tuple[Column, Column]:
    """The literal text that whatever a shell pattern matches begins and ends with; both may be empty.

    A set begins with ``[`` and ends with ``]``, so neither end reaches into one.
    """
    return F.regexp_extract(pattern, r"^[^*?\[]*", 0), F.regexp_extract(pattern, r"[^*?\[\]]*\z", 0)
