"""Secret scans: strong patterns, and weak candidates by linking the parts of one credential.

A long random-looking string or a user name alone is no finding. Parts (access identifiers, user
identifiers, secrets, endpoints) are intervals of a text; an interval join within scopes
(paragraphs) reports a weak part only where the parts that complete it stand in its scope, or, if a
``reach`` is given, at most so many code points away there.

Everything is DataFrame code. Only parts travel, never texts.

Defined results: a null text counts as empty; empty texts have no spans; repeated rows get equal
results each; a null ``doc_id`` is kept. Columns other than ``doc_id`` and ``text`` are ignored, so
their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chunkweave.functions.arrays import rows_of, span
from chunkweave.functions.text import let
from chunkweave.llm.common import NO_SPANS, spans, stored

KINDS = ("assign", "access", "hex", "ident", "weak")

# The patterns of the base kinds. For access and hex the least length is part of the
# pattern, which finds the same runs as dropping short ones afterwards.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIN_SECRET = 8

# Parts that are weak on their own.
IDENT = r"""(?i:(user|username|login|account|client_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)"""
WEAK = r"[A-Za-z0-9+/=_-]{20,}"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\x00-\x20"'<>]+"""
SCOPE_BREAK = r"\n[\x20\t\r]*\n"

CELL = 200  # code points; how finely intervals are cut for the join
BLOCK = 1024  # code points of a text that masking handles as one piece
GROUP = 256  # spans whose ends are compared one by one


def _found(text: Column, pattern: str, condition: Column | None = None) -> Column:
    """Spans where the condition holds; the (cheaper) condition keeps most texts from a full scan."""
    condition = text.rlike(pattern) if condition is None else condition
    return F.when(condition, spans(text, pattern)).otherwise(F.array().cast(NO_SPANS))


def _secret_length(match: Column) -> Column:
    """Length of an assignment's value: what follows the name, the sign and an opening quote."""
    return F.length(F.regexp_extract(match, ASSIGN, 2))


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with the arrays ``assign``, ``access`` and ``hex`` of spans, and what linking needs."""
    text = F.col("text")
    has_assign = text.rlike(r"(?i)password|passwd|secret|token|api_?key")
    return docs.withColumns(
        {
            "assign": F.filter(_found(text, ASSIGN, has_assign), lambda m: _secret_length(m["text"]) >= MIN_SECRET),
            "access": _found(text, ACCESS, text.contains("AKIA")),
            "hex": _found(text, HEX),
        }
    )


def _mixed(match: Column) -> Column:
    return match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")


def parts(based: DataFrame) -> DataFrame:
    """``(key, kind, start, end, scope)`` of all parts in texts that hold an identifier at all."""
    text = F.col("text")
    rated = based.withColumn(
        "linkable",
        (F.size("access") > 0) | (text.contains("://") & text.rlike(r"(?i)user|login|account|client_?id")),
    ).filter("linkable")

    def tagged(items: Column, kind: str) -> Column:
        return F.transform(items, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    every = F.concat(
        *[tagged(F.col(kind), kind) for kind in ("assign", "access", "hex")],
        tagged(_found(text, IDENT), "ident"),
        tagged(F.filter(_found(text, WEAK), lambda m: _mixed(m["text"])), "weak"),
        tagged(_found(text, ENDPOINT, text.contains("://")), "endpoint"),
        tagged(_found(text, SCOPE_BREAK), "break"),
    )
    rows = (
        rated.select("key", every.alias("every"))
        .distinct()
        .select("key", F.explode(rows_of(F.col("every"))).alias("part"))
        .select("key", "part.*")
    )
    in_text = Window.partitionBy("key").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    scoped = rows.withColumn("scope", F.sum(F.when(F.col("kind") == "break", 1).otherwise(0)).over(in_text))
    return scoped.filter(F.col("kind") != "break")


def near(left: DataFrame, right: DataFrame, reach: int | None, width: int = CELL) -> DataFrame:
    """Rows of ``left`` with a row of ``right`` in their scope at most ``reach`` code points away
    (-1: overlapping it; None: anywhere).

    An interval join on cells of ``width`` code points: the left interval, widened by the reach,
    meets the right one in a cell they share. Existence is asked for, so no pairs come out.
    """
    if reach is None:
        b = right.select(F.col("key").alias("other_key"), F.col("scope").alias("other_scope")).distinct()
        return left.join(b, (F.col("key") == F.col("other_key")) & (F.col("scope") == F.col("other_scope")), "left_semi").distinct()

    def cells(start: Column, end: Column) -> Column:
        return F.sequence(F.floor(start / width), F.floor(end / width))

    widened = max(reach, 0)
    a = left.withColumn("cell", F.explode(cells(F.col("start") - widened, F.col("end") + widened)))
    b = right.select(
        "key",
        "scope",
        F.col("start").alias("other_start"),
        F.col("end").alias("other_end"),
        F.explode(cells(F.col("start"), F.col("end"))).alias("cell"),
    )
    close = (F.col("other_start") - F.col("end") <= reach) & (F.col("start") - F.col("other_end") <= reach)
    same = (a["key"] == b["key"]) & (a["scope"] == b["scope"]) & (a["cell"] == b["cell"])
    return a.join(b, same & close, "left_semi").drop("cell").distinct()


def link(found: DataFrame, reach: int | None = None) -> DataFrame:
    """Weak parts that their complements confirm.

    * ``weak`` (20 characters or more of mixed classes, outside the base spans): near an access
      identifier, or near a user identifier that itself has an endpoint near.
    * ``ident``: near an endpoint and near a secret (``assign``, ``hex`` or ``weak``).
    """
    kind = F.col("kind")
    base = found.filter(kind.isin("assign", "access", "hex"))
    weak = found.filter(kind == "weak")
    free = weak.subtract(near(weak, base, -1))
    placed = near(found.filter(kind == "ident"), found.filter(kind == "endpoint"), reach)
    confirmed = near(free, found.filter(kind == "access").unionByName(placed), reach)
    named = near(placed, base.filter(kind != "access").unionByName(free), reach)
    return confirmed.unionByName(named)


def scan_secrets(docs: DataFrame, reach: int | None = None, carry: bool = False) -> DataFrame:
    """``(doc_id, assign, access, hex, linked)``: arrays of ``start, end, text`` spans per document,
    ``linked`` with ``kind`` in place of the text. With ``carry``, ``row`` holds the input row."""
    own = [F.struct("*").alias("row")] if carry else []
    plain = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *own)
    based = base_spans(plain).withColumn("key", F.struct(F.col("doc_id"), F.sha2("text", 256).alias("sha")))
    found = stored(parts(based), "secret-parts")
    by_text = stored(
        link(found, reach)
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("linked"))
        .select(F.col("key.doc_id").alias("linked_doc"), F.col("key.sha").alias("linked_sha"), "linked"),
        "secret-links",
    )
    joined = based.join(by_text, F.col("doc_id").eqNullSafe(F.col("linked_doc")) & (F.col("key.sha") == F.col("linked_sha")), "left")
    return joined.select(
        "doc_id",
        "assign",
        "access",
        "hex",
        F.coalesce("linked", F.array().cast("array<struct<start:int,end:int,kind:string>>")).alias("linked"),
        *(["row"] if carry else []),
    )


def _blocks(text: Column) -> Column:
    """The text in pieces of ``BLOCK`` code points, found in one pass."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """The text from one code point to another; only the blocks that hold it are touched."""
    first = F.floor(start / BLOCK).cast("int")
    held = F.array_join(F.slice(blocks, first + 1, F.ceil(end / BLOCK).cast("int") - first), "")
    return F.when(end > start, F.substring(held, start - first * BLOCK + 1, end - start)).otherwise(F.lit(""))


def _reached(ordered: Column) -> Column:
    """The greatest end of the spans before each one, null for the first. Within groups of ``GROUP`` spans, then
    over the groups, so the work stays close to linear."""

    def of_groups(groups: Column, tops: Column) -> Column:
        def within(group: Column, g: Column) -> Column:
            before = F.array_max(F.slice(tops, F.lit(1), g))
            return F.transform(group, lambda _, i: F.greatest(before, F.array_max(F.slice(group, F.lit(1), i))))

        return F.flatten(F.transform(groups, within))

    def grouped(ends: Column) -> Column:
        n = F.ceil(F.size(ends) / GROUP).cast("int")
        groups = F.transform(span(n), lambda g: F.slice(ends, g * GROUP + 1, F.lit(GROUP)))
        return let(groups, lambda gs: let(F.transform(gs, F.array_max), lambda tops: of_groups(gs, tops)))

    return let(F.transform(ordered, lambda m: m["end"]), grouped)


def redacted(docs: DataFrame, mask: str = "[SECRET]", reach: int | None = None) -> DataFrame:
    """The same rows with every span of their text replaced by the mask (touching spans by one; parts are
    linked over their whole scope unless a reach is given), and
    ``n_chars`` recounted where it is a column and the text was changed."""

    def place(m: Column) -> Column:
        return F.struct(m["start"].alias("start"), m["end"].alias("end"))

    scanned = scan_secrets(docs, reach, carry=True)
    every = F.sort_array(F.concat(*[F.transform(F.col(kind), place) for kind in ("assign", "access", "hex", "linked")]))
    text = F.col("row.text")

    def cut(s: Column, blocks: Column) -> Column:
        # What stands before each span that begins after all earlier ones have ended, then the rest.
        pieces = F.zip_with(
            s,
            _reached(s),
            lambda m, before: F.when(
                before.isNull() | (before <= m["start"]),
                F.concat(_between(blocks, F.coalesce(before, F.lit(0)), m["start"]), F.lit(mask)),
            ).otherwise(F.lit("")),
        )
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        return F.concat(F.array_join(pieces, ""), _between(blocks, last, F.length(text)))

    changed = scanned.select("row", every.alias("every")).withColumn(
        "clean", F.when(F.size("every") > 0, let(F.col("every"), lambda s: let(_blocks(text), lambda b: cut(s, b)))).otherwise(text)
    )
    fields = {name: F.col("row").getField(name).alias(name) for name in docs.columns}
    fields["text"] = F.col("clean").alias("text")
    if "n_chars" in fields:
        kind = docs.schema["n_chars"].dataType
        counted = F.when(F.size("every") > 0, F.length("clean").cast(kind)).otherwise(F.col("row.n_chars"))
        fields["n_chars"] = counted.alias("n_chars")
    return changed.select(*fields.values())


def span_text(items: Column) -> Column:
    """``kind:start:end`` of ``(start, kind number, kind, end)`` structs, by start, then kind as listed."""
    return F.array_join(
        F.transform(
            F.sort_array(items),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def numbered(items: Column, kind: Column | None) -> Column:
    def one(m: Column) -> Column:
        own = m["kind"] if kind is None else kind
        number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), own)
        return F.struct(m["start"].alias("start"), number.alias("number"), own.alias("kind"), m["end"].alias("end"))

    return F.transform(items, one)


def digests(scanned: DataFrame) -> DataFrame:
    """The contract's columns: counts, digest of the base spans, all spans as text."""
    base = F.concat(*[numbered(F.col(kind), F.lit(kind)) for kind in ("assign", "access", "hex")])
    return scanned.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.concat(base, numbered(F.col("linked"), None))).alias("spans"),
    )
