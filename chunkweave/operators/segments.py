"""Structural segments: sections, symbols, braces, headings, paragraphs, JSON members.

Every function maps one document to an array column inside its own row, so segmentation needs no
shuffle and a long or frequent document cannot skew anything.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkweave.functions.arrays import rows_of, running_sums
from chunkweave.functions.text import ANY_SPACE, is_blank, join_lines, let, lstrip, sha256, split_lines, strip

# Line patterns that open a segment.
SPACE = ANY_SPACE
DEFINITION = rf"^{SPACE}*(def|class|function|fn|interface|type){SPACE}+([A-Za-z_](?U:\w*))"
HEADING = rf"^(#{{1,6}}){SPACE}+(.+)$"
JAVA_TYPE = rf"^{SPACE}*(public{SPACE}+|private{SPACE}+|protected{SPACE}+)?(class|interface|enum){SPACE}+((?U:\w+))"
JAVA_METHOD = (
    rf"^{SPACE}*(public|private|protected)?{SPACE}*(static{SPACE}+)?(?U:[\w<>\[\], ?]+){SPACE}+((?U:\w+))"
    rf"{SPACE}*\([^)]*\){SPACE}*\{{?{SPACE}*$"
)
TYPE_WORDS = ("class ", "interface ", "enum ", "record ", "@interface ")
CODE_BRACE_LINES = 40
JAVA_BRACE_LINES = 30
#: Kind of the lines above the first definition.
CODE_LEAD = "code_lead"

SEGMENT = "struct<id:string,kind:string,text:string,start_line:int,end_line:int,symbol:string>"
NO_SEGMENTS = f"array<{SEGMENT}>"
NO_CUTS = "array<struct<a:int,b:int>>"
MEMBERS = T.ArrayType(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
)
_ARROW_MEMBERS = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
TEXTS_AT_ONCE = 256


def segment(path: Column, kind: Column | str, text: Column, start: Column, end: Column, symbol: Column) -> Column:
    """One segment; its id carries a fingerprint of the text as given, the text itself is trimmed."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(
        F.concat_ws(":", path, kind, start, F.substring(sha256(text), 1, 10)).alias("id"),
        kind.alias("kind"),
        strip(text).alias("text"),
        start.cast("int").alias("start_line"),
        end.cast("int").alias("end_line"),
        symbol.alias("symbol"),
    )


def _no_symbol() -> Column:
    return F.lit(None).cast("string")


def _whole(path: Column, content: Column, lines: Column, kind: str) -> Column:
    return F.array(segment(path, kind, content, F.lit(1), F.size(lines), _no_symbol()))


def _from_spans(path: Column, lines: Column, spans: Column) -> Column:
    """``array<struct<kind, first, last, symbol>>`` of line numbers to segments; blank ones dropped."""
    cut = F.transform(
        spans,
        lambda s: segment(
            path,
            s["kind"],
            join_lines(F.slice(lines, s["first"], s["last"] - s["first"] + 1)),
            s["first"],
            s["last"],
            s["symbol"],
        ),
    )
    return F.filter(cut, lambda s: s["text"] != "")


def _between(marks: Column, n_lines: Column, kind: str) -> Column:
    """Each mark owns the lines up to the next one."""
    return F.transform(
        marks,
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"),
            m["at"].alias("first"),
            F.coalesce(F.get(marks, i + 1)["at"] - 1, n_lines).alias("last"),
            m["symbol"].alias("symbol"),
        ),
    )


def _marked(path: Column, content: Column, mark, kind: str, whole_kind: str, lead_kind: str | None) -> Column:
    """A segment per mark, before them the lead (lines above the first mark) if it has a kind; without any
    mark one segment."""

    def spans(marks: Column, lines: Column) -> Column:
        between = _between(marks, F.size(lines), kind)
        if lead_kind is None:
            return between
        above = F.get(marks, F.lit(0))["at"] - 1
        lead = F.struct(F.lit(lead_kind).alias("kind"), F.lit(1).alias("first"), above.alias("last"), _no_symbol().alias("symbol"))
        return F.when(above > 0, F.concat(F.array(lead), between)).otherwise(between)

    def build(lines: Column) -> Column:
        marks = F.filter(F.transform(lines, mark), lambda m: m["found"])
        return let(
            marks,
            lambda found: F.when(F.size(found) == 0, _whole(path, content, lines, whole_kind)).otherwise(
                _from_spans(path, lines, spans(found, lines))
            ),
        )

    return let(
        split_lines(content),
        lambda lines: F.when(F.size(lines) == 0, F.array().cast(NO_SEGMENTS)).otherwise(build(lines)),
    )


def code_segments(path: Column, content: Column, lead: bool = True) -> Column:
    """One segment per definition line. What stands above the first one is a segment ``code_lead`` of its own
    unless it is blank; with ``lead=False`` it is part of none."""

    def mark(line: Column, i: Column) -> Column:
        return let(
            F.regexp_extract(line, DEFINITION, 2),
            lambda name: F.struct((name != "").alias("found"), (i + 1).alias("at"), name.alias("symbol")),
        )

    return _marked(path, content, mark, "code_symbol", "code_block", CODE_LEAD if lead else None)


def heading_segments(path: Column, content: Column, lead: bool = True) -> Column:
    """One segment per ``#`` heading (levels 1-6), named by its title. What stands above the first one is a
    segment ``markdown_lead`` unless it is blank; with ``lead=False`` it is part of none."""

    def mark(line: Column, i: Column) -> Column:
        return F.struct(
            (F.regexp_extract(line, HEADING, 1) != "").alias("found"),
            (i + 1).alias("at"),
            strip(F.regexp_extract(line, HEADING, 2)).alias("symbol"),
        )

    return _marked(path, content, mark, "heading_section", "markdown_section", "markdown_lead" if lead else None)


def _braces(text: Column) -> Column:
    without = lambda brace: F.length(F.replace(text, F.lit(brace), F.lit("")))
    return without("}") - without("{")


def java_segments(path: Column, content: Column) -> Column:
    """Types and methods from their first line to the line where the braces are closed again."""
    state = F.struct(
        F.lit(0).alias("first"),
        F.lit("").alias("kind"),
        _no_symbol().alias("symbol"),
        F.lit(0).alias("depth"),
        F.array().cast("array<struct<kind:string,first:int,last:int,symbol:string>>").alias("done"),
    )

    def describe(line: Column, i: Column) -> Column:
        def named(name: Column) -> Column:
            is_type = F.regexp_extract(line, JAVA_TYPE, 2) != ""
            method = F.regexp_extract(line, JAVA_METHOD, 3)
            return F.struct(
                (i + 1).alias("at"),
                _braces(line).alias("delta"),
                F.when(is_type, F.lit("class_header")).when(method != "", F.lit("method")).otherwise(F.lit("")).alias("kind"),
                F.when(is_type, name).otherwise(method).alias("symbol"),
            )

        return named(F.regexp_extract(line, JAVA_TYPE, 3))

    def span_of(acc: Column, last: Column) -> Column:
        return F.struct(
            acc["kind"].alias("kind"), acc["first"].alias("first"), last.alias("last"), acc["symbol"].alias("symbol")
        )

    def add(acc: Column, line: Column) -> Column:
        opens = (acc["first"] == 0) & (line["kind"] != "")
        current = F.struct(
            F.when(opens, line["at"]).otherwise(acc["first"]).alias("first"),
            F.when(opens, line["kind"]).otherwise(acc["kind"]).alias("kind"),
            F.when(opens, line["symbol"]).otherwise(acc["symbol"]).alias("symbol"),
            (acc["depth"] + line["delta"]).alias("depth"),
            acc["done"].alias("done"),
        )
        return let(
            current,
            lambda c: F.when(
                (c["first"] > 0) & (c["depth"] <= 0),
                F.struct(
                    F.lit(0).alias("first"),
                    F.lit("").alias("kind"),
                    _no_symbol().alias("symbol"),
                    F.lit(0).alias("depth"),
                    F.concat(c["done"], F.array(span_of(c, line["at"]))).alias("done"),
                ),
            ).otherwise(c),
        )

    def build(lines: Column) -> Column:
        n = F.size(lines)
        spans = F.aggregate(
            F.transform(lines, describe),
            state,
            add,
            lambda acc: F.when(
                acc["first"] > 0, F.concat(acc["done"], F.array(span_of(acc, n)))
            ).otherwise(acc["done"]),
        )
        whole = F.array(
            F.struct(
                F.lit("java_file").alias("kind"), F.lit(1).alias("first"), n.alias("last"), _no_symbol().alias("symbol")
            )
        )
        return let(
            spans, lambda s: _from_spans(path, lines, F.when(F.size(s) > 0, s).otherwise(whole))
        )

    return let(
        split_lines(content),
        lambda lines: F.when(F.size(lines) == 0, F.array().cast(NO_SEGMENTS)).otherwise(build(lines)),
    )


def _member_text(key: str, value: object) -> dict:
    return {"key": str(key), "value": json.dumps(value, ensure_ascii=False, indent=2)}


@F.arrow_udf(MEMBERS)
def json_members(content: pa.Array) -> pa.Array:
    """Members of a JSON object with indented values; null for anything else.

    Python's JSON reader and writer decide here what is valid and how a value is laid out.
    """

    def members(text: str | None):
        # Whatever cannot be read, laid out or encoded (deep nesting, lone surrogates) is no object here.
        try:
            parsed = json.loads(text)
            found = [_member_text(k, v) for k, v in parsed.items()] if isinstance(parsed, dict) else None
            for member in found or ():
                member["key"].encode(), member["value"].encode()
        except (ValueError, TypeError, RecursionError):
            return None
        return found

    # Some texts at a time: parsed, they take many times the room of the text.
    parts = [
        pa.array([members(text) for text in content.slice(at, TEXTS_AT_ONCE).to_pylist()], _ARROW_MEMBERS)
        for at in range(0, len(content), TEXTS_AT_ONCE)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], _ARROW_MEMBERS)


def json_segments(path: Column, content: Column, members: Column) -> Column:
    """One segment per top-level member; invalid or non-object text is one blob.

    ``members`` is ``json_members(content)``, computed beforehand as a column of its own: Python
    columns cannot sit inside a lambda.
    """
    n = F.size(split_lines(content))
    blob = F.array(segment(path, "structured_blob", content, F.lit(1), F.greatest(n, F.lit(1)), _no_symbol()))
    keyed = F.transform(
        members,
        lambda m: segment(
            path,
            "top_level_key",
            strip(F.concat(m["key"], F.lit(":\n"), m["value"])),
            F.lit(1),
            n,
            m["key"],
        ),
    )
    return F.when(members.isNull(), blob).otherwise(keyed)


def structured_blob(path: Column, content: Column) -> Column:
    n = F.size(split_lines(content))
    return F.array(segment(path, "structured_blob", content, F.lit(1), F.greatest(n, F.lit(1)), _no_symbol()))


def paragraph_segments(path: Column, content: Column) -> Column:
    """Paragraphs between blank lines, numbered; line numbers skip the blank lines."""
    parts = F.filter(
        F.transform(F.split(content, rf"\n{SPACE}*\n", -1), strip), lambda p: p != ""
    )

    def build(texts: Column) -> Column:
        sizes = F.transform(texts, lambda t: F.greatest(F.size(split_lines(t)), F.lit(1)))
        return let(
            sizes,
            lambda n: let(
                running_sums(n),
                lambda before: F.transform(
                    texts,
                    lambda t, i: segment(
                        path,
                        "paragraph",
                        t,
                        F.get(before, i) + 1,
                        F.get(before, i) + F.get(n, i),
                        F.concat(F.lit("paragraph_"), i + 1),
                    ),
                ),
            ),
        )

    return let(
        parts, lambda p: F.when(F.size(p) == 0, F.array().cast(NO_SEGMENTS)).otherwise(build(p))
    )


def segments_by_kind(files: DataFrame) -> DataFrame:
    """Dispatch classified files to their segmenter: adds ``segments``.

    One pass over the data: a ``CASE`` picks the expression per row. Only files classified as JSON
    go through the Python reader.
    """
    path, content = F.col("path"), F.col("content")
    with_members = files.withColumn(
        "members", json_members(F.when(F.col("pipeline") == "json", content))
    )
    chosen = (
        F.when(F.col("pipeline") == "java", java_segments(path, content))
        .when(F.col("pipeline") == "code_generic", code_segments(path, content))
        .when(F.col("pipeline").isin("markdown", "html"), heading_segments(path, content))
        .when(F.col("pipeline") == "json", json_segments(path, content, F.col("members")))
        .when(F.col("pipeline") == "yaml", structured_blob(path, content))
        .otherwise(paragraph_segments(path, content))
    )
    return with_members.withColumn("segments", chosen).drop("members")


def explode_segments(files: DataFrame) -> DataFrame:
    """``segments`` to rows with their position in the file."""
    kept = [c for c in files.columns if c not in ("content", "segments")]
    return files.select(*kept, F.posexplode(rows_of(F.col("segments"))).alias("seg_no", "segment")).select(
        *kept,
        "seg_no",
        F.col("segment.id").alias("segment_id"),
        F.col("segment.kind").alias("kind"),
        F.col("segment.text").alias("text"),
        F.col("segment.start_line").alias("start_line"),
        F.col("segment.end_line").alias("end_line"),
        F.col("segment.symbol").alias("symbol"),
    )


def heading_sections(content: Column) -> Column:
    """``array<struct<title, text>>``: a line starting with ``#`` opens a section; a lead is kept."""

    def build(lines: Column) -> Column:
        marks = F.filter(
            F.transform(lines, lambda line, i: F.when((i == 0) | F.startswith(line, F.lit("#")), i + 1)),
            lambda at: at.isNotNull(),
        )
        sections = let(
            marks,
            lambda starts: F.transform(
                starts,
                lambda at, i: F.struct(
                    let(
                        F.get(lines, at - 1),
                        lambda line: F.when(F.startswith(line, F.lit("#")), strip(line)).otherwise(F.lit("")),
                    ).alias("title"),
                    join_lines(
                        F.slice(lines, at, F.coalesce(F.get(starts, i + 1), F.size(lines) + 1) - at)
                    ).alias("text"),
                ),
            ),
        )
        return F.filter(sections, lambda s: s["text"] != "")

    return let(split_lines(content), build)


def brace_sections(content: Column, max_lines: int = CODE_BRACE_LINES) -> Column:
    """Runs of lines cut at blank lines outside braces, or after ``max_lines`` outside braces."""

    def build(lines: Column) -> Column:
        shapes = F.transform(
            lines,
            lambda line, i: F.struct(
                i.alias("at"), is_blank(line).alias("blank"), _braces(line).alias("delta")
            ),
        )
        state = F.struct(F.lit(0).alias("start"), F.lit(0).alias("depth"), F.array().cast(NO_CUTS).alias("done"))

        def cut(acc: Column, stop: Column) -> Column:
            return F.concat(acc["done"], F.array(F.struct(acc["start"].alias("a"), stop.alias("b"))))

        def add(acc: Column, line: Column) -> Column:
            at_gap = line["blank"] & (line["at"] > acc["start"]) & (acc["depth"] == 0)
            depth = acc["depth"] + line["delta"]
            long_enough = (depth == 0) & (line["at"] + 1 - acc["start"] >= max_lines)
            return (
                F.when(
                    at_gap,
                    F.struct(
                        (line["at"] + 1).alias("start"), acc["depth"].alias("depth"), cut(acc, line["at"]).alias("done")
                    ),
                )
                .when(
                    long_enough,
                    F.struct((line["at"] + 1).alias("start"), depth.alias("depth"), cut(acc, line["at"] + 1).alias("done")),
                )
                .otherwise(F.struct(acc["start"].alias("start"), depth.alias("depth"), acc["done"].alias("done")))
            )

        cuts = F.aggregate(
            shapes,
            state,
            add,
            lambda acc: F.when(acc["start"] < F.size(lines), cut(acc, F.size(lines))).otherwise(acc["done"]),
        )
        texts = F.transform(cuts, lambda c: join_lines(F.slice(lines, c["a"] + 1, c["b"] - c["a"])))
        return F.filter(texts, lambda t: t != "")

    return let(split_lines(content), build)


def is_header_line(line: Column) -> Column:
    """Whether a line is a package, import or annotation line."""
    return let(strip(line), _opens_header)


def _opens_header(stripped: Column) -> Column:
    return stripped.startswith("package ") | stripped.startswith("import ") | stripped.startswith("@")


def file_header(content: Column, max_chars: int = 6000) -> Column:
    """Leading block comment, then package, import and annotation lines up to the first type line.

    Expressed on positions: where the comment ends, where the first type line is, and where some
    other statement stops the header before it.
    """

    def kind_of(s: Column) -> Column:
        holds_type = None
        for word in TYPE_WORDS:
            test = F.contains(s, F.lit(word))
            holds_type = test if holds_type is None else holds_type | test
        return (
            F.when(_opens_header(s), F.lit("head"))
            .when(holds_type, F.lit("type"))
            .when((s != "") & ~s.startswith("//"), F.lit("other"))
            .otherwise(F.lit("skip"))
        )

    def build(lines: Column) -> Column:
        filled = F.filter(F.transform(lines, lambda x, i: F.when(~is_blank(x), i)), lambda i: i.isNotNull())
        return let(F.get(filled, F.lit(0)), lambda first: from_first(lines, first))

    def from_first(lines: Column, first: Column) -> Column:
        n = F.size(lines)
        opens_comment = lstrip(F.get(lines, first)).startswith("/*")
        closes = F.get(
            F.filter(
                F.transform(lines, lambda x, i: F.when((i >= first) & F.contains(x, F.lit("*/")), i)),
                lambda i: i.isNotNull(),
            ),
            F.lit(0),
        )
        body_from = F.when(opens_comment, F.coalesce(closes + 1, n)).otherwise(first)

        def header(start: Column) -> Column:
            comment = F.when(opens_comment, F.slice(lines, first + 1, start - first)).otherwise(
                F.array().cast("array<string>")
            )
            tagged = F.transform(
                F.slice(lines, start + 1, F.greatest(n - start, F.lit(0))),
                lambda line, i: F.struct(i.alias("at"), let(strip(line), kind_of).alias("kind"), line.alias("line")),
            )

            def assemble(rows: Column) -> Column:
                comment_ends = ~F.coalesce(
                    F.try_element_at(comment, F.lit(-1)).rlike("package|import|@"), F.lit(True)
                )
                # Another statement ends the header only right after a comment that is no
                # package, import or annotation text; after a header line it is passed over.
                first_head = F.coalesce(
                    F.get(F.filter(rows, lambda r: r["kind"].isin("head", "type")), F.lit(0))["at"], n
                )
                first_other = F.get(F.filter(rows, lambda r: r["kind"] == "other"), F.lit(0))["at"]
                stopped = comment_ends & (F.size(comment) > 0) & first_other.isNotNull() & (first_other < first_head)
                type_at = F.coalesce(F.get(F.filter(rows, lambda r: r["kind"] == "type"), F.lit(0))["at"], n)
                kept = F.filter(
                    rows, lambda r: (r["kind"] == "head") & (r["at"] < type_at) | (r["at"] == type_at)
                )
                kept_lines = F.when(stopped, F.array().cast("array<string>")).otherwise(
                    F.transform(kept, lambda r: r["line"])
                )
                return F.substring(join_lines(F.concat(comment, kept_lines)), 1, max_chars)

            return let(tagged, assemble)

        return F.when(first.isNull(), F.lit("")).otherwise(let(body_from, header))

    return let(split_lines(content), build)
