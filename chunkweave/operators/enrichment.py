"""Classification of files and enrichment of segments by a user-supplied service function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.functions.arrays import first_of_each, rows_of, span
from chunkweave.functions.text import compact_spaces, is_blank, let, lstrip, path_suffix, rstrip, sha256, strip
from chunkweave.operators.constraints import (
    ENRICHED,
    MAX_CHUNK_TOKENS,
    MAX_SEGMENTS_PER_REQUEST,
    MIN_CHUNK_TOKENS,
    apply_constraints,
)

# Extension, pipeline, language, mime type.
FILE_KINDS = {
    ".java": ("java", "java", "text/x-java"),
    ".md": ("markdown", "markdown", "text/markdown"),
    ".markdown": ("markdown", "markdown", "text/markdown"),
    ".html": ("html", "html", "text/html"),
    ".htm": ("html", "html", "text/html"),
    ".json": ("json", "json", "application/json"),
    ".yml": ("yaml", "yaml", "application/yaml"),
    ".yaml": ("yaml", "yaml", "application/yaml"),
    ".txt": ("text", "text", "text/plain"),
    ".rst": ("text", "rst", "text/plain"),
    ".py": ("code_generic", "python", "text/x-python"),
    ".js": ("code_generic", "javascript", "text/javascript"),
    ".ts": ("code_generic", "typescript", "text/typescript"),
    ".tsx": ("code_generic", "typescript", "text/typescript"),
    ".go": ("code_generic", "go", "text/x-go"),
    ".rs": ("code_generic", "rust", "text/x-rust"),
    ".c": ("code_generic", "c", "text/x-c"),
    ".cpp": ("code_generic", "cpp", "text/x-c++"),
    ".h": ("code_generic", "c", "text/x-c"),
    ".cs": ("code_generic", "csharp", "text/x-csharp"),
    ".kt": ("code_generic", "kotlin", "text/x-kotlin"),
}
SUMMARY_CHARS = 180
MAX_TAGS = 5
REQUESTS_AT_ONCE = 64

SEGMENTS = (
    "array<struct<seg_no:int,segment_id:string,kind:string,text:string,start_line:int,end_line:int,"
    "symbol:string,cache_key:string>>"
)
NO_MAP = "map<string,string>"


def _kind(pipeline: str, language: str, mime: str, supported: bool = True) -> Column:
    return F.struct(
        F.lit(pipeline).alias("pipeline"),
        F.lit(language).alias("language"),
        F.lit(mime).alias("mime"),
        F.lit(supported).alias("is_supported_text"),
    )


def file_kind(path: Column, content: Column) -> Column:
    """Known extension, else the interpreter line, else binary if it holds a NUL, else text."""
    table = F.create_map(
        *[x for ext, kind in FILE_KINDS.items() for x in (F.lit(ext), _kind(*kind))]
    )
    head = F.substring(lstrip(content), 1, 128)
    script = head.startswith("#!")
    return F.coalesce(
        F.try_element_at(table, path_suffix(path)),
        F.when(script & F.contains(head, F.lit("python")), _kind("code_generic", "python", "text/x-python"))
        .when(script & F.contains(head, F.lit("sh")), _kind("text", "shell", "text/x-shellscript"))
        .when(
            F.contains(content, F.lit("\x00")),
            _kind("binary_unsupported", "binary", "application/octet-stream", False),
        )
        .otherwise(_kind("text", "text", "text/plain")),
    )


def classify(sources: DataFrame) -> DataFrame:
    """Adds ``pipeline, language, mime, is_supported_text``. No join: the table is a literal."""
    return (
        sources.withColumn("file_kind", file_kind(F.col("path"), F.col("content")))
        .select(*sources.columns, "file_kind.*")
    )


def reuse_segments(files: DataFrame, file_cache: DataFrame) -> DataFrame:
    """Adds ``cached_segments``: those of the same path and source hash, else null."""
    cached = file_cache.select("path", "source_hash", F.col("segments").alias("cached_segments"))
    return files.join(cached, ["path", "source_hash"], "left")


def migrate_file_cache(old: DataFrame) -> DataFrame:
    """First-version cache rows ``(path, source_hash, chunks)`` to cached segments."""
    numbered = F.transform("chunks", lambda text, i: F.struct(strip(text).alias("text"), i.alias("at")))
    segments = F.transform(
        F.filter(numbered, lambda c: F.coalesce(c["text"] != "", F.lit(False))),
        lambda c: F.struct(
            F.concat_ws(":", "path", F.lit("legacy"), c["at"]).alias("segment_id"),
            F.lit("legacy_chunk").alias("kind"),
            c["text"].alias("text"),
            F.lit(1).alias("start_line"),
            F.lit(1).alias("end_line"),
        ),
    )
    return old.select("path", "source_hash", F.lit("legacy").alias("pipeline"), segments.alias("segments"))


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def segment_cache_key(
    model: str,
    prompt_version: str,
    max_tokens: int = MAX_CHUNK_TOKENS,
    min_tokens: int = MIN_CHUNK_TOKENS,
    per_request: int = MAX_SEGMENTS_PER_REQUEST,
) -> Column:
    """Fingerprint of everything that shapes an enrichment: sorted JSON of settings and segment."""
    head = (
        f'{{"constraints": {{"max_chunk_tokens": {max_tokens}, "max_segments_per_request": {per_request}, '
        f'"min_chunk_tokens": {min_tokens}}}, "model": '
    )
    return sha256(
        F.concat(
            F.lit(head),
            _quoted(F.lit(model)),
            F.lit(', "prompt_version": '),
            _quoted(F.lit(prompt_version)),
            F.lit(', "segment": {"end": '),
            F.col("end_line").cast("string"),
            F.lit(', "id": '),
            _quoted(F.col("segment_id")),
            F.lit(', "kind": '),
            _quoted(F.col("kind")),
            F.lit(', "metadata": {}, "start": '),
            F.col("start_line").cast("string"),
            F.lit(', "symbol": '),
            F.coalesce(_quoted(F.col("symbol")), F.lit("null")),
            F.lit(', "text": '),
            _quoted(F.col("text")),
            F.lit("}}"),
        )
    )


def request_batches(segments: DataFrame, per_request: int = MAX_SEGMENTS_PER_REQUEST) -> DataFrame:
    """Segments of a file grouped in order into requests of at most ``per_request``.

    A request is one row with a small array, so the service function sees bounded input and a file
    with very many segments becomes many independent rows.
    """
    size = max(1, per_request)
    in_file = Window.partitionBy("path").orderBy("seg_no")
    numbered = segments.withColumn("batch", F.floor((F.row_number().over(in_file) - 1) / size).cast("int"))
    key = F.col("cache_key") if "cache_key" in segments.columns else F.lit(None).cast("string").alias("cache_key")
    item = F.struct("seg_no", "segment_id", "kind", "text", "start_line", "end_line", "symbol", key)
    return numbered.groupBy("path", "ext", "language", "mime", "batch").agg(
        F.array_sort(F.collect_list(item)).cast(SEGMENTS).alias("segments")
    )


def file_requests(files: DataFrame, per_request: int = MAX_SEGMENTS_PER_REQUEST) -> DataFrame:
    """As ``request_batches``, of files that still hold their ``segments``: the array is cut inside the
    row, so no text is shuffled."""
    size = max(1, per_request)
    item = F.transform(
        "segments",
        lambda s, i: F.struct(
            i.alias("seg_no"),
            s["id"].alias("segment_id"),
            s["kind"].alias("kind"),
            s["text"].alias("text"),
            s["start_line"].alias("start_line"),
            s["end_line"].alias("end_line"),
            s["symbol"].alias("symbol"),
            F.lit(None).cast("string").alias("cache_key"),
        ),
    )
    batches = let(
        item,
        lambda all_items: F.transform(
            span(F.ceil(F.size(all_items) / F.lit(size)).cast("int")), lambda b: F.slice(all_items, b * size + 1, F.lit(size))
        ),
    )
    kept = ("path", "ext", "language", "mime")
    return files.select(*kept, F.posexplode(rows_of(batches)).alias("batch", "segments")).select(
        *kept, "batch", F.col("segments").cast(SEGMENTS).alias("segments")
    )


Enricher = Callable[[dict], str]


def call_enricher(requests: DataFrame, enricher: Enricher) -> DataFrame:
    """Adds ``raw``, the service's answer per request; null where the call failed."""
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in requests.schema.fields]

    def ask(request: dict) -> str | None:
        try:
            return enricher(request)
        except Exception:  # noqa: BLE001 - any service failure means the fallback
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Some requests at a time: as Python objects they take many times the room of their texts.
            for start in range(0, batch.num_rows, REQUESTS_AT_ONCE):
                part = batch.slice(start, REQUESTS_AT_ONCE)
                raw = pa.array([ask(row) for row in part.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, raw], names=[*part.schema.names, "raw"])

    return requests.mapInArrow(run, ", ".join([*columns, "raw string"]))


def recover_json(text: Column) -> Column:
    """JSON from a chat answer: the whole text, a fenced block, or the outermost braces."""
    fenced = F.filter(
        F.transform(
            F.regexp_extract_all(text, F.lit(r"(?is)```(?:json)?\s*(.*?)```"), F.lit(1)),
            lambda block: F.try_parse_json(strip(block)),
        ),
        lambda parsed: parsed.isNotNull(),
    )
    return F.coalesce(
        F.try_parse_json(strip(text)),
        F.get(fenced, F.lit(0)),
        F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1)),
    )


def chat_text(payload: Column) -> Column:
    """Message text of a chat completion: a string, or the joined texts of its parts."""
    whole = F.try_variant_get(payload, "$.choices[0].message.content", "string")
    parts = F.try_variant_get(payload, "$.choices[0].message.content", "array<variant>")
    joined = F.array_join(
        F.transform(parts, lambda p: F.try_variant_get(p, "$.text", "string")), "\n"
    )
    return F.when(parts.isNotNull(), joined).otherwise(whole)


def _is_text(item: Column) -> Column:
    return F.schema_of_variant(item) == "STRING"


def _is_object(item: Column) -> Column:
    return F.schema_of_variant(item).startswith("OBJECT")


def _plain(value: Column) -> Column:
    return F.when(_is_text(value), F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def coerce_map(value: Column) -> Column:
    """Anything to a string map: objects as they are, JSON text parsed, other text under ``raw``,
    pairs as entries, other lists under ``items``."""
    nothing = F.create_map().cast(NO_MAP)

    def from_object(v: Column) -> Column:
        return F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda _, x: _plain(x))

    def from_text(text: Column) -> Column:
        return let(
            F.try_parse_json(text),
            lambda p: F.when(is_blank(text), nothing)
            .when(p.isNull(), F.create_map(F.lit("raw"), text))
            .when(_is_object(p), from_object(p))
            .otherwise(nothing),
        )

    def from_list(v: Column) -> Column:
        pairs = F.try_variant_get(v, "$", "array<array<variant>>")
        paired = F.forall(pairs, lambda p: F.size(p) == 2)
        entries = F.map_from_entries(
            F.transform(pairs, lambda p: F.struct(_plain(F.get(p, F.lit(0))), _plain(F.get(p, F.lit(1)))))
        )
        return F.when(paired, entries).otherwise(F.create_map(F.lit("items"), F.to_json(v)))

    return F.coalesce(
        F.when(_is_object(value), from_object(value))
        .when(_is_text(value), from_text(F.try_variant_get(value, "$", "string")))
        .when(F.schema_of_variant(value).startswith("ARRAY"), from_list(value)),
        nothing,
    )


def response_chunks(payload: Column) -> Column:
    """Chunks of an answer (a list, ``chunks``, or the first ``output_json`` of ``output``).

    Null when no list is found. Strings are text-only chunks; blank texts are dropped.
    """
    from_output = F.try_variant_get(
        F.get(
            F.filter(
                F.try_variant_get(payload, "$.output", "array<variant>"),
                lambda item: (F.try_variant_get(item, "$.type", "string") == "output_json")
                & F.try_variant_get(item, "$.json.chunks", "variant").isNotNull(),
            ),
            F.lit(0),
        ),
        "$.json.chunks",
        "array<variant>",
    )
    has_chunks = F.try_variant_get(payload, "$.chunks", "variant").isNotNull()
    raw = F.coalesce(
        F.try_variant_get(payload, "$", "array<variant>"),
        F.when(has_chunks, F.try_variant_get(payload, "$.chunks", "array<variant>")).otherwise(from_output),
    )

    def field(item: Column, name: str) -> Column:
        return F.coalesce(F.try_variant_get(item, f"$.{name}", "string"), F.lit(""))

    def chunk(item: Column) -> Column:
        text_only = F.struct(
            F.lit("").alias("id"),
            strip(F.try_variant_get(item, "$", "string")).alias("text"),
            F.lit("").alias("title"),
            F.lit("").alias("summary"),
            F.array().cast("array<string>").alias("tags"),
            *[F.create_map().cast(NO_MAP).alias(m) for m in ("anchors", "relations", "metadata")],
        )
        tags = F.transform(
            F.filter(F.try_variant_get(item, "$.tags", "array<variant>"), _is_text),
            lambda t: F.try_variant_get(t, "$", "string"),
        )
        full = F.struct(
            field(item, "id").alias("id"),
            field(item, "text").alias("text"),
            field(item, "title").alias("title"),
            field(item, "summary").alias("summary"),
            F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
            *[
                coerce_map(F.try_variant_get(item, f"$.{m}", "variant")).alias(m)
                for m in ("anchors", "relations", "metadata")
            ],
        )
        return F.when(_is_text(item), text_only).when(_is_object(item), full)

    return F.filter(
        F.transform(raw, chunk), lambda c: c.isNotNull() & ~is_blank(F.coalesce(c["text"], F.lit("")))
    ).cast(f"array<{ENRICHED}>")


def default_summary(text: Column, limit: int = SUMMARY_CHARS) -> Column:
    return let(
        compact_spaces(text),
        lambda t: F.when(F.length(t) <= limit, t).otherwise(
            F.concat(rstrip(F.substring(t, 1, limit - 1)), F.lit("…"))
        ),
    )


def default_tags(language: Column, kind: Column, mime: Column) -> Column:
    """Language, segment kind and mime tail, lower-cased; only the tail is checked for repeats."""
    first = F.filter(
        F.array(F.lower(language), F.lower(kind)), lambda t: t.isNotNull() & (t != "")
    )
    tail = F.lower(strip(F.element_at(F.split(mime, "/"), -1)))
    return let(
        first,
        lambda f: F.slice(
            F.when((tail != "") & ~F.array_contains(f, tail), F.concat(f, F.array(tail))).otherwise(f),
            F.lit(1),
            F.lit(MAX_TAGS),
        ),
    )


def matched_segments(chunks: Column, segments: Column) -> Column:
    """Place of the segment each answered chunk stands for: by id, else by position, else null."""

    def place(names: Column) -> Column:
        return F.transform(
            chunks,
            lambda chunk, at: let(
                F.when(chunk["id"] != "", F.array_position(names, chunk["id"]).cast("int")).otherwise(F.lit(0)),
                lambda found: F.when(found > 0, found - 1).when(at < F.size(names), at),
            ),
        )

    return let(F.transform(segments, lambda s: s["segment_id"]), place)


def with_defaults(chunks: Column, owners: Column, segments: Column, path: Column, language: Column, mime: Column) -> Column:
    """Answered chunks completed from the segments they stand for."""

    def complete(chunk: Column, at: Column) -> Column:
        def filled(segment: Column) -> Column:
            text = let(
                strip(chunk["text"]),
                lambda t: F.when(t != "", t).otherwise(F.coalesce(segment["text"], F.lit(""))),
            )
            anchors = F.map_concat(
                chunk["anchors"],
                F.map_filter(
                    F.map_from_arrays(
                        F.array(F.lit("path"), F.lit("start_line"), F.lit("end_line")),
                        F.array(path, segment["start_line"].cast("string"), segment["end_line"].cast("string")),
                    ),
                    lambda k, v: v.isNotNull() & ~F.map_contains_key(chunk["anchors"], k),
                ),
            )
            return F.struct(
                F.when(chunk["id"] != "", chunk["id"])
                .otherwise(F.coalesce(segment["segment_id"], F.concat_ws(":", path, F.lit("chunk"), at)))
                .alias("id"),
                text.alias("text"),
                chunk["title"].alias("title"),
                let(
                    strip(chunk["summary"]), lambda s: F.when(s != "", s).otherwise(default_summary(text))
                ).alias("summary"),
                F.when(F.size(chunk["tags"]) > 0, chunk["tags"])
                .otherwise(default_tags(language, segment["kind"], mime))
                .alias("tags"),
                anchors.alias("anchors"),
                chunk["relations"].alias("relations"),
                chunk["metadata"].alias("metadata"),
            )

        return let(F.get(segments, F.get(owners, at)), filled)

    return F.transform(chunks, complete).cast(f"array<{ENRICHED}>")


def fallback_chunks(segments: Column, path: Column) -> Column:
    """Segments as they are, flagged, for requests the service did not answer."""
    return F.transform(
        segments,
        lambda s: F.struct(
            s["segment_id"].alias("id"),
            s["text"].alias("text"),
            F.lit("").alias("title"),
            F.lit("").alias("summary"),
            F.array().cast("array<string>").alias("tags"),
            F.create_map(
                F.lit("path"),
                path,
                F.lit("start_line"),
                s["start_line"].cast("string"),
                F.lit("end_line"),
                s["end_line"].cast("string"),
            ).alias("anchors"),
            F.create_map().cast(NO_MAP).alias("relations"),
            F.create_map(F.lit("fallback"), F.lit("true")).alias("metadata"),
        ),
    ).cast(f"array<{ENRICHED}>")


def answered_chunks(answers: DataFrame) -> DataFrame:
    """Requests with ``raw`` answers to ``chunks`` per request, and whether the fallback was used.

    ``owners`` holds the place of each chunk's segment. Segments that a usable answer leaves out
    follow as fallbacks; ``left_out`` is their number.
    """
    parsed = answers.withColumn("payload", recover_json(F.col("raw"))).withColumn(
        "parsed", response_chunks(F.coalesce(recover_json(chat_text(F.col("payload"))), F.col("payload")))
    )
    usable = F.coalesce(F.size("parsed") > 0, F.lit(False))
    places = span(F.size("segments"))
    matched = parsed.withColumn("fallback", ~usable).withColumn(
        "matched", F.when(usable, matched_segments(F.col("parsed"), F.col("segments"))).otherwise(F.array().cast("array<int>"))
    ).withColumn("missed", F.filter(places, lambda i: ~F.coalesce(F.array_contains("matched", i), F.lit(False))))
    completed = with_defaults(
        F.col("parsed"), F.col("matched"), F.col("segments"), F.col("path"), F.col("language"), F.col("mime")
    )
    missed = fallback_chunks(F.transform("missed", lambda i: F.get("segments", i)), F.col("path"))
    return (
        matched.withColumn("chunks", F.when(usable, F.concat(completed, missed)).otherwise(missed))
        .withColumn("owners", F.concat("matched", "missed"))
        .withColumn("left_out", F.size("missed"))
        .drop("payload", "parsed", "raw", "matched", "missed")
    )


def reuse_enrichment(segments: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds ``cached``, the enriched chunk stored under the segment's ``cache_key``, else null."""
    return segments.join(cache.select("cache_key", F.col("chunk").alias("cached")), "cache_key", "left")


def placed_chunks(answered: DataFrame) -> DataFrame:
    """Answered chunks as rows at the segment they stand for, under that segment's cache key.

    Chunks that stand for none are put behind the last segment and are not cached.
    """
    rows = answered.select(
        "path", "ext", "segments", "owners", "left_out", F.posexplode(rows_of(F.col("chunks"))).alias("pos", "chunk")
    )
    own = F.get("segments", F.get("owners", F.col("pos")))
    return rows.select(
        "path",
        "ext",
        F.coalesce(own["seg_no"], F.element_at("segments", -1)["seg_no"]).alias("seg_no"),
        "pos",
        "chunk",
        (F.col("pos") >= F.size("owners") - F.col("left_out")).alias("fallback"),
        own["cache_key"].alias("cache_key"),
    )


def cached_chunks(hits: DataFrame) -> DataFrame:
    """Segments found in the cache in the shape of ``placed_chunks``."""
    return hits.select(
        "path", "ext", "seg_no", F.lit(0).alias("pos"), F.col("cached").alias("chunk"), F.lit(False).alias("fallback"), "cache_key"
    )


def enrichment_cache(placed: DataFrame) -> DataFrame:
    """What a later run may reuse: one chunk per key, fallbacks left out so that they are retried."""
    kept = placed.where(~F.col("fallback") & F.col("cache_key").isNotNull())
    return kept.groupBy("cache_key").agg(F.min_by("chunk", F.struct("path", "seg_no", "pos")).alias("chunk"))


def gather_files(placed: DataFrame) -> DataFrame:
    """Chunks of a file in segment order: ``(path, ext, chunks)``.

    The group is one source file, whose size a source row already bounds.
    """
    item = F.struct("seg_no", "pos", "chunk")
    ordered = F.array_sort(
        F.collect_list(item),
        lambda a, b: F.when(a["seg_no"] != b["seg_no"], a["seg_no"] - b["seg_no"]).otherwise(a["pos"] - b["pos"]),
    )
    return placed.groupBy("path", "ext").agg(F.transform(ordered, lambda i: i["chunk"]).alias("chunks"))


def file_chunks(answered: DataFrame) -> DataFrame:
    """Chunks of all requests of a file in segment order."""
    return gather_files(placed_chunks(answered))


def constrained(files: DataFrame, max_tokens: int = MAX_CHUNK_TOKENS, min_tokens: int = MIN_CHUNK_TOKENS) -> DataFrame:
    return files.withColumn("chunks", apply_constraints(F.col("chunks"), max_tokens, min_tokens))


def valid_chunks(chunks: Column) -> Column:
    """Chunks with text and an id; of equal ids the first one."""
    return first_of_each(
        F.filter(chunks, lambda c: ~is_blank(c["text"]) & (c["id"] != "")), lambda c: c["id"]
    )


def chunk_warnings(chunks: Column) -> Column:
    """``array<struct<id, warning>>`` in chunk order: why chunks were dropped or look incomplete."""

    def build(items: Column) -> Column:
        numbered = F.transform(items, lambda c, i: F.struct(i.alias("at"), c.alias("chunk")))
        usable = F.filter(numbered, lambda n: ~is_blank(n["chunk"]["text"]) & (n["chunk"]["id"] != ""))
        firsts = let(
            usable,
            lambda u: F.transform(first_of_each(u, lambda n: n["chunk"]["id"]), lambda n: n["at"]),
        )

        def report(kept: Column) -> Column:
            def lines(n: Column) -> Column:
                c = n["chunk"]
                gaps = F.array_compact(
                    F.array(
                        F.when(~F.map_contains_key(c["anchors"], F.lit("path")), F.lit("no anchors.path")),
                        F.when(c["summary"] == "", F.lit("empty summary")),
                        F.when(F.size(c["tags"]) == 0, F.lit("empty tags")),
                    )
                )
                found = (
                    F.when(is_blank(c["text"]), F.array(F.lit("dropped: empty text")))
                    .when(c["id"] == "", F.array(F.lit("dropped: missing id")))
                    .when(~F.array_contains(kept, n["at"]), F.array(F.lit("dropped: duplicate id")))
                    .otherwise(gaps)
                )
                return F.transform(found, lambda w: F.struct(c["id"].alias("id"), w.alias("warning")))

            return F.flatten(F.transform(numbered, lines))

        return let(firsts, report)

    return let(chunks, build)


def final_metadata(chunk: Column, path: Column, ext: Column) -> Column:
    """Own metadata, overlaid with path, extension and the enrichment fields."""
    fixed = F.create_map(
        F.lit("path"), path,
        F.lit("ext"), ext,
        F.lit("title"), chunk["title"],
        F.lit("summary"), chunk["summary"],
        F.lit("tags"), F.to_json(chunk["tags"]),
        F.lit("anchors"), F.to_json(chunk["anchors"]),
        F.lit("relations"), F.to_json(chunk["relations"]),
    )
    names = ("path", "ext", "title", "summary", "tags", "anchors", "relations")
    return F.map_concat(F.map_filter(chunk["metadata"], lambda k, _: ~k.isin(*names)), fixed)


def explode_enriched(files: DataFrame) -> DataFrame:
    """Valid chunks as rows of a chunk table: ``path, ord, id, text, metadata``."""
    return files.select("path", "ext", F.posexplode(valid_chunks(F.col("chunks"))).alias("ord", "chunk")).select(
        "path",
        "ord",
        F.col("chunk.id").alias("id"),
        F.col("chunk.text").alias("text"),
        final_metadata(F.col("chunk"), F.col("path"), F.col("ext")).alias("metadata"),
    )


def enrichment_counts(segments: DataFrame, per_request: int = MAX_SEGMENTS_PER_REQUEST) -> DataFrame:
    """One row of run counters from ``(path, file_hit, segment_hit)`` rows, one per segment.

    Calls are the requests needed for the segments not found in the cache.
    """
    per_file = segments.groupBy("path").agg(
        F.max("file_hit").alias("file_hit"),
        F.count_if(F.col("segment_hit")).alias("hits"),
        F.count_if(~F.col("segment_hit")).alias("misses"),
    )
    return per_file.agg(
        F.coalesce(F.sum(F.ceil(F.col("misses") / max(1, per_request))), F.lit(0)).alias("calls"),
        F.count_if("file_hit").alias("file_cache_hits"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("segment_cache_hits"),
    )
