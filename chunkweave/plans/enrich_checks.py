"""Registered queries: classification, segment caches, enrichment and validation."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from chunkweave.functions.arrays import rows_of
from chunkweave.functions.text import sha256
from chunkweave.operators import enrichment as N
from chunkweave.operators import segments as G
from chunkweave.plans import inputs as In
from chunkweave.plans.chunk_checks import SP, _sql_merge, _sql_split
from chunkweave.sources.tables import stored

MODEL, PROMPT = "model-a", "v1"
MAX_TOKENS, MIN_TOKENS, PER_REQUEST = 120, 20, 4


def classified(spark, folder):
    return N.classify(In.with_source_hash(In.sources(spark, folder)))


def segments(spark, folder):
    """Segments of all supported files, dispatched by pipeline."""
    files = classified(spark, folder).where("is_supported_text")
    return G.explode_segments(G.segments_by_kind(files))


def demo_service(request: dict) -> str:
    """A deterministic stand-in for the enrichment service.

    It answers in several shapes, fails for some languages, leaves ids and summaries out, and wraps
    some answers in prose, as services do.
    """
    if request["language"] == "rust":
        raise TimeoutError("no answer")
    items = [
        {
            "id": s["segment_id"] if s["seg_no"] % 2 == 0 else "",
            "text": s["text"],
            "title": (s["symbol"] or "").lower(),
            "summary": "" if s["kind"] == "paragraph" else s["kind"] + " of " + request["path"],
            "tags": [] if s["seg_no"] % 3 == 0 else ["t", s["kind"]],
            "anchors": {"path": request["path"]} if s["seg_no"] % 2 == 0 else [["note", "x"]],
        }
        for s in request["segments"]
    ]
    answer = json.dumps({"chunks": items}, ensure_ascii=False)
    if request["language"] == "go":
        return "Here it is:\n```json\n" + answer + "\n```\nDone."
    if request["language"] == "markdown":
        return json.dumps({"choices": [{"message": {"content": "Result: " + answer}}]}, ensure_ascii=False)
    if request["language"] == "java":
        return json.dumps({"output": [{"type": "text"}, {"type": "output_json", "json": {"chunks": items}}]}, ensure_ascii=False)
    if request["language"] == "kotlin":
        return "I cannot do that."
    return answer


def answered(spark, folder):
    files = G.segments_by_kind(classified(spark, folder).where("is_supported_text"))
    requests = N.file_requests(files, PER_REQUEST)
    return N.answered_chunks(N.call_enricher(requests, demo_service))


def classify(spark, folder):
    return classified(spark, folder).select("path", "pipeline", "language", "mime", "is_supported_text")


def dispatched_segments(spark, folder):
    return segments(spark, folder).select(
        "path", "pipeline", "seg_no", "segment_id", "kind", "start_line", "end_line", "symbol", sha256(F.col("text")).alias("digest")
    )


def _file_hits(now, before):
    found = N.reuse_segments(now, before.select("path", "source_hash", F.lit("cached").alias("segments")))
    return found.select("path", F.col("cached_segments").isNotNull().alias("file_hit"))


def file_cache(spark, folder):
    """Files whose segments an earlier run already holds."""
    now = In.with_source_hash(In.sources(spark, folder))
    return _file_hits(now, In.with_source_hash(In.earlier(In.sources(spark, folder))))


def segment_keys(spark, folder):
    return segments(spark, folder).select("path", "seg_no", N.segment_cache_key(MODEL, PROMPT).alias("cache_key"))


def _both_builds(spark, folder):
    """The files of now and of the earlier build; they are made once."""
    now = stored(In.with_source_hash(In.sources(spark, folder)), "sources")
    return now, In.with_source_hash(In.earlier(now.drop("source_hash")))


def _keyed_segments(files):
    known = G.segments_by_kind(N.classify(files).where("is_supported_text"))
    return G.explode_segments(known).select("path", "source_hash", "seg_no", N.segment_cache_key(MODEL, PROMPT).alias("cache_key"))


def _segment_hits(now, before):
    """Segments of now with whether the earlier build had their key. A file that did not change had the segments
    it has, so only the others are cut again as they were."""
    same = ["path", "source_hash"]
    keyed = stored(_keyed_segments(now), "segments")
    unchanged = keyed.join(before.select(*same), same, "left_semi").select("cache_key")
    changed = _keyed_segments(before.join(now.select(*same), same, "left_anti")).select("cache_key")
    old = unchanged.union(changed).distinct().withColumn("hit", F.lit(True))
    return keyed.join(old, "cache_key", "left").select("path", "seg_no", "cache_key", F.col("hit").isNotNull().alias("segment_hit"))


def cached_segments(spark, folder):
    """Segments with whether an enrichment under the same key is cached."""
    return _segment_hits(*_both_builds(spark, folder))


def enrichment_counts(spark, folder):
    now, before = _both_builds(spark, folder)
    rows = _segment_hits(now, before).join(_file_hits(now, before), "path")
    return N.enrichment_counts(rows, PER_REQUEST)


def cache_migration(spark, folder):
    """Texts of conversations as a first-version cache, one entry per turn."""
    turns = In.table(spark, folder, "conversations")
    old = turns.select(
        F.concat_ws("/", "role", "conv_id", "turn").alias("path"),
        sha256(F.col("text")).alias("source_hash"),
        F.split("text", r"\. ").alias("chunks"),
    )
    rows = N.migrate_file_cache(old).select("path", "source_hash", "pipeline", F.explode(rows_of(F.col("segments"))).alias("s"))
    return rows.select("path", "source_hash", "pipeline", "s.segment_id", "s.kind", sha256(F.col("s.text")).alias("digest"))


def request_batches(spark, folder):
    batches = N.request_batches(segments(spark, folder), PER_REQUEST)
    return batches.select(
        "path",
        "batch",
        F.size("segments").alias("n_segments"),
        F.get("segments", F.lit(0))["seg_no"].alias("first_seg"),
    )


def enrich_defaults(spark, folder):
    """Answers completed: ids, anchors, summaries and tags from the segments where missing."""
    rows = answered(spark, folder).select("path", "batch", "fallback", F.posexplode(rows_of(F.col("chunks"))).alias("pos", "c"))
    return rows.select(
        "path", "batch", "pos", "fallback", "c.id", "c.title", "c.summary",
        F.array_join("c.tags", ",").alias("tags"),
        F.col("c.anchors")["path"].alias("anchor_path"),
        F.col("c.anchors")["start_line"].alias("anchor_start"),
        F.col("c.anchors")["note"].alias("anchor_note"),
        sha256(F.col("c.text")).alias("digest"),
    )


def fallback_files(spark, folder):
    return answered(spark, folder).groupBy("path").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("fallback").alias("failed")
    )


def constrained_files(spark, folder):
    return N.constrained(N.file_chunks(answered(spark, folder)), MAX_TOKENS, MIN_TOKENS)


def enriched_chunks(spark, folder):
    """The whole enrichment: requests, answers, defaults, limits, validation, final metadata."""
    rows = N.explode_enriched(constrained_files(spark, folder))
    return rows.select("path", "ord", "id", sha256(F.col("text")).alias("digest"), F.col("metadata")["ext"].alias("ext"))


def _page_chunks(spark, folder):
    """Pages as candidate chunks with repeated and missing ids, blank texts and missing fields."""
    pages = In.table(spark, folder, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    parts = F.split("html", "</?p>", -1)
    chunk = lambda t, i: F.struct(
        F.when(i % 7 == 3, F.lit("")).otherwise(F.concat(F.lit("c"), (i % 5).cast("string"))).alias("id"),
        F.when(i % 6 == 4, F.lit(" \n")).otherwise(t).alias("text"),
        F.lit("").alias("title"),
        F.when(i % 3 == 0, F.lit("")).otherwise(host).alias("summary"),
        F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("html"))).alias("tags"),
        F.when(i % 2 == 0, F.create_map(F.lit("path"), F.col("url"))).otherwise(F.create_map().cast("map<string,string>")).alias("anchors"),
        F.create_map().cast("map<string,string>").alias("relations"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )
    return pages.select("page_id", "url", F.transform(parts, chunk).cast(f"array<{N.ENRICHED}>").alias("chunks"))


def valid_chunks(spark, folder):
    rows = _page_chunks(spark, folder).select("page_id", F.posexplode(N.valid_chunks(F.col("chunks"))).alias("ord", "c"))
    return rows.select("page_id", "ord", "c.id", sha256(F.col("c.text")).alias("digest"))


def chunk_warnings(spark, folder):
    rows = _page_chunks(spark, folder).select("page_id", F.posexplode(N.chunk_warnings(F.col("chunks"))).alias("ord", "w"))
    return rows.select("page_id", "ord", "w.id", "w.warning")


def default_summaries(spark, folder):
    pages = In.table(spark, folder, "pages")
    return pages.select(
        "page_id",
        N.default_summary(F.col("html")).alias("summary"),
        F.array_join(N.default_tags(F.lit("HTML"), F.lit("Paragraph"), F.lit("text/html")), ",").alias("tags"),
    )


def recovered_json(spark, folder):
    """JSON wrapped in prose or fences around the event properties, recovered."""
    events = In.table(spark, folder, "events")
    raw = (
        F.when(F.col("event_type") == "view", F.col("props"))
        .when(F.col("event_type") == "click", F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```")))
        .when(F.col("event_type") == "error", F.concat(F.lit("so "), "props", F.lit(" done")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("```\nnot json\n```\n```\n"), "props", F.lit("\n```")))
        .otherwise(F.lit("no json at all"))
    )
    return events.select("event_id", F.try_variant_get(N.recover_json(raw), "$.k", "bigint").alias("k"))


def response_shapes(spark, folder):
    """Answers as a list, under ``chunks`` or in an output envelope, with plain strings among them."""
    docs = In.table(spark, folder, "documents")
    items = F.concat(F.lit('["  note ", " ", {"id": "x'), F.col("doc_id").cast("string"), F.lit('", "text": '), F.to_json(F.array("lang")).substr(F.lit(2), F.length("lang") + 2), F.lit("}, 7]"))
    raw = (
        F.when(F.col("lang") == "en", items)
        .when(F.col("lang") == "fr", F.concat(F.lit('{"chunks": '), items, F.lit("}")))
        .when(F.col("lang") == "de", F.concat(F.lit('{"output": [1, {"type": "output_json", "json": {"chunks": '), items, F.lit("}}]}")))
        .otherwise(F.lit('{"answer": []}'))
    )
    parsed = N.response_chunks(F.try_parse_json(raw))
    return docs.select("doc_id", F.posexplode_outer(parsed).alias("pos", "c")).select("doc_id", "pos", "c.id", "c.text")


def coerced_maps(spark, folder):
    """Open fields given as an object, JSON text, other text, pairs and a plain list."""
    events = In.table(spark, folder, "events")
    raw = (
        F.when(F.col("event_type") == "view", F.col("props"))
        .when(F.col("event_type") == "click", F.to_json(F.array("props")).substr(F.lit(2), F.length(F.to_json(F.array("props"))) - 2))
        .when(F.col("event_type") == "error", F.lit('"not-json"'))
        .when(F.col("event_type") == "signup", F.lit('[["k", "pair"]]'))
        .otherwise(F.lit("[1, 2]"))
    )
    coerced = N.coerce_map(F.try_parse_json(raw))
    return events.select(
        "event_id", coerced["k"].alias("k"), coerced["raw"].alias("raw"), coerced["items"].alias("items")
    )


# --- SQL --------------------------------------------------------------------------------------


def _sql_kinds() -> str:
    rows = [[ext, *kind] for ext, kind in N.FILE_KINDS.items()]
    cells = ", ".join("(" + ", ".join(In.text_literal(c) for c in row) + ")" for row in rows)
    return f"kinds(ext, pipeline, language, mime) AS (VALUES {cells})"


CLASSIFIED = f"""
{_sql_kinds()},
classified AS (
    SELECT path, ext, lang, content, sha256(content) AS source_hash,
           coalesce(k.pipeline, CASE WHEN starts_with(content, '#!') THEN 'text' WHEN contains(content, chr(0)) THEN 'binary_unsupported' ELSE 'text' END) AS pipeline,
           coalesce(k.language, CASE WHEN starts_with(content, '#!') THEN 'shell' WHEN contains(content, chr(0)) THEN 'binary' ELSE 'text' END) AS language,
           coalesce(k.mime, CASE WHEN starts_with(content, '#!') THEN 'text/x-shellscript' WHEN contains(content, chr(0)) THEN 'application/octet-stream' ELSE 'text/plain' END) AS mime
    FROM FILES LEFT JOIN kinds k USING (ext))
"""


def _dispatch(p: str, files: str) -> str:
    """CTE ``{p}segments`` of all supported files: every segmenter over its own pipeline."""
    from chunkweave.plans.chunk_checks import JAVA_SHAPES, WORD_CHARS

    heading = f"^(#{{1,6}}){SP}+(.+)$"
    define = f"^{SP}*(def|class|function|fn|interface|type){SP}+([A-Za-z_][{WORD_CHARS}]*)"
    classified = CLASSIFIED.replace("FROM FILES", f"FROM {files}").replace("classified AS", f"{p}classified AS")
    if p:
        classified = classified[classified.index(f"{p}classified AS"):]
    java = JAVA_SHAPES
    for name in ("java_lines", "java_fold", "java_found", "java_spans", "doc_lines"):
        java = java.replace(name, p + name)
    java = java.replace("FROM ln", f"FROM {p}ln WHERE pipeline = 'java'")
    java = java.replace(f"FROM {p}doc_lines\n    UNION ALL", f"FROM {p}doc_lines WHERE pipeline = 'java'\n    UNION ALL")
    java = java.replace("WHERE len(lines) > 0 AND path NOT IN", "WHERE pipeline = 'java' AND len(lines) > 0 AND path NOT IN")
    return f"""{classified},
{p}doc_lines AS (SELECT *, {In.sql_lines('content')} AS lines FROM {p}classified),
{p}ln AS (SELECT path, pipeline, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS n FROM {p}doc_lines),
{java}
{p}marks AS (
    SELECT path, i, n, 'heading_section' AS kind, {In.sql_strip(f"regexp_extract(line, '{heading}', 2)")} AS symbol FROM {p}ln
    WHERE pipeline IN ('markdown', 'html') AND regexp_matches(line, '{heading}')
    UNION ALL
    SELECT path, i, n, 'code_symbol', regexp_extract(line, '{define}', 2) FROM {p}ln WHERE pipeline = 'code_generic' AND regexp_matches(line, '{define}')),
{p}spans AS (
    SELECT * FROM {p}java_spans UNION ALL
    SELECT path, kind, i, coalesce(lead(i) OVER (PARTITION BY path ORDER BY i) - 1, n), symbol FROM {p}marks
    UNION ALL
    SELECT path, CASE kind WHEN 'code_symbol' THEN 'code_lead' ELSE 'markdown_lead' END, 1, min(i) - 1, NULL FROM {p}marks GROUP BY path, kind HAVING min(i) > 1),
{p}cut AS (
    SELECT s.path, s.kind, s.first, s.last, s.symbol, {In.sql_join('lines[s.first : s.last]')} AS text FROM {p}spans s JOIN {p}doc_lines USING (path)),
{p}json_rows AS (
    SELECT path, len(lines) AS n, unnest(['lang', 'source', 'n_chars']) AS k, unnest([1, 2, 3]) AS i, content FROM {p}doc_lines
    WHERE pipeline = 'json' AND json_valid(content) AND starts_with(content, '{{')),
{p}para_parts AS (
    SELECT path, list_filter(list_transform(string_split_regex(content, '\\n{SP}*\\n'), lambda p: {In.sql_strip('p')}), lambda p: p <> '') AS ps
    FROM {p}classified WHERE pipeline = 'text'),
{p}para_rows AS (SELECT path, unnest(ps) AS text, generate_subscripts(ps, 1) AS i FROM {p}para_parts),
{p}para_sized AS (SELECT *, greatest(len({In.sql_lines('text')}), 1) AS n FROM {p}para_rows),
{p}para_placed AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY i) AS last FROM {p}para_sized),
{p}pieces AS (
    SELECT path, first AS i, kind, first, last, symbol, text, text AS raw FROM {p}cut WHERE text <> ''
    UNION ALL
    SELECT path, 1, CASE pipeline WHEN 'code_generic' THEN 'code_block' ELSE 'markdown_section' END, 1, len(lines), NULL, {In.sql_strip('content')}, content
    FROM {p}doc_lines WHERE pipeline IN ('code_generic', 'markdown', 'html') AND len(lines) > 0 AND path NOT IN (SELECT path FROM {p}marks)
    UNION ALL
    SELECT path, i, 'top_level_key', 1, n, k, t, t FROM (SELECT *, {In.sql_strip("k || ':' || chr(10) || json_extract(content, '$.' || k)::VARCHAR")} AS t FROM {p}json_rows)
    UNION ALL
    SELECT path, 1, 'structured_blob', 1, greatest(len(lines), 1), NULL, {In.sql_strip('content')}, content FROM {p}doc_lines
    WHERE pipeline = 'yaml' OR (pipeline = 'json' AND path NOT IN (SELECT path FROM {p}json_rows))
    UNION ALL
    SELECT path, i, 'paragraph', CAST(last - n + 1 AS BIGINT), CAST(last AS BIGINT), 'paragraph_' || i, text, text FROM {p}para_placed),
{p}segments AS (
    SELECT s.path, ext, pipeline, language, mime, CAST(row_number() OVER (PARTITION BY s.path ORDER BY i) - 1 AS INTEGER) AS seg_no,
           s.path || ':' || kind || ':' || first || ':' || substr(sha256(raw), 1, 10) AS segment_id, kind, text,
           CAST(first AS INTEGER) AS start_line, CAST(last AS INTEGER) AS end_line, symbol
    FROM {p}pieces s JOIN {p}classified USING (path))
"""


DISPATCH = f"WITH RECURSIVE {In.SOURCES}, {_dispatch('', 'sources')}"
DISPATCH_BOTH = f"WITH RECURSIVE {In.SOURCES}, {In.EARLIER}, {_dispatch('', 'sources')}, {_dispatch('old_', 'earlier')}"


def _sql_key(rows: str) -> str:
    quoted = lambda x: f"CAST(to_json({x}) AS VARCHAR)"
    head = '{"constraints": {"max_chunk_tokens": 800, "max_segments_per_request": 8, "min_chunk_tokens": 120}, "model": "model-a", "prompt_version": "v1", "segment": {"end": '
    return (
        f"SELECT path, seg_no, sha256('{head}' || end_line || ', \"id\": ' || {quoted('segment_id')} || ', \"kind\": ' || {quoted('kind')} "
        f"|| ', \"metadata\": {{}}, \"start\": ' || start_line || ', \"symbol\": ' || coalesce({quoted('symbol')}, 'null') || ', \"text\": ' || {quoted('text')} || '}}}}') AS cache_key FROM {rows}"
    )


ANSWERED = f"""{DISPATCH},
batched AS (SELECT *, seg_no // {PER_REQUEST} AS batch, seg_no % {PER_REQUEST} AS pos, language IN ('rust', 'kotlin') AS fallback FROM segments),
answers AS (
    SELECT path, ext, batch, pos, seg_no, fallback, segment_id AS id,
           CASE WHEN fallback THEN '' ELSE lower(coalesce(symbol, '')) END AS title,
           CASE WHEN fallback THEN '' WHEN kind <> 'paragraph' THEN kind || ' of ' || path ELSE SUMMARY END AS summary,
           CASE WHEN fallback THEN []::VARCHAR[] WHEN seg_no % 3 = 0 THEN
                CASE WHEN list_contains([language, kind], string_split(mime, '/')[2]) THEN [language, kind] ELSE [language, kind, string_split(mime, '/')[2]] END
                ELSE ['t', kind] END AS tags,
           path AS anchor_path, CAST(start_line AS VARCHAR) AS anchor_start, CASE WHEN NOT fallback AND seg_no % 2 = 1 THEN 'x' END AS anchor_note, text
    FROM batched)
"""


def _sql_summary(x: str) -> str:
    flat = In.sql_strip(f"regexp_replace({x}, '{SP}+', ' ', 'g')")
    cut = In.sql_rstrip(f"substr({flat}, 1, 179)")
    return f"(CASE WHEN length({flat}) <= 180 THEN {flat} ELSE {cut} || '…' END)"


ANSWERED = ANSWERED.replace("SUMMARY", _sql_summary("text"))
PAGE_ITEMS = f"""
WITH parts AS (SELECT page_id, url, string_split_regex(html, '</?p>') AS ps FROM pages),
raw_items AS (SELECT page_id, url, unnest(ps) AS t, generate_subscripts(ps, 1) - 1 AS i FROM parts),
items AS (
    SELECT page_id, i, CASE WHEN i % 7 = 3 THEN '' ELSE 'c' || (i % 5) END AS id, CASE WHEN i % 6 = 4 THEN ' ' || chr(10) ELSE t END AS text,
           i % 3 = 0 AS no_summary, i % 4 = 0 AS no_tags, i % 2 = 1 AS no_path FROM raw_items),
usable AS (SELECT *, {In.sql_strip('text')} <> '' AS has_text FROM items),
firsts AS (SELECT page_id, id, min(i) AS i FROM usable WHERE has_text AND id <> '' GROUP BY page_id, id)
"""

QUERIES = {
    "classify": (
        classify,
        f"WITH {In.SOURCES}, {CLASSIFIED.replace('FROM FILES', 'FROM sources')} "
        "SELECT path, pipeline, language, mime, pipeline <> 'binary_unsupported' AS is_supported_text FROM classified",
    ),
    "dispatched_segments": (
        dispatched_segments,
        DISPATCH + "SELECT path, pipeline, seg_no, segment_id, kind, start_line, end_line, symbol, sha256(text) AS digest FROM segments",
    ),
    "file_cache": (
        file_cache,
        f"WITH {In.SOURCES}, {In.EARLIER} SELECT path, sha256(s.content) = sha256(e.content) AS file_hit FROM sources s JOIN earlier e USING (path)",
    ),
    "segment_keys": (segment_keys, DISPATCH + _sql_key("segments")),
    "cached_segments": (
        cached_segments,
        DISPATCH_BOTH
        + f", now AS ({_sql_key('segments')}), old AS ({_sql_key('old_segments')}) "
        + "SELECT path, seg_no, cache_key, cache_key IN (SELECT cache_key FROM old) AS segment_hit FROM now",
    ),
    "enrichment_counts": (
        enrichment_counts,
        DISPATCH_BOTH
        + f""", now AS ({_sql_key('segments')}), old AS ({_sql_key('old_segments')}),
        per_file AS (
            SELECT path, count(*) FILTER (cache_key IN (SELECT cache_key FROM old)) AS hits, count(*) FILTER (cache_key NOT IN (SELECT cache_key FROM old)) AS misses
            FROM now GROUP BY path)
        SELECT CAST(sum(ceil(misses / {PER_REQUEST}.0)) AS BIGINT) AS calls,
               count(*) FILTER (path IN (SELECT path FROM sources s JOIN earlier e USING (path) WHERE s.content = e.content)) AS file_cache_hits,
               CAST(sum(hits) AS BIGINT) AS segment_cache_hits FROM per_file""",
    ),
    "cache_migration": (
        cache_migration,
        f"""WITH old AS (SELECT role || '/' || conv_id || '/' || turn AS path, sha256(text) AS source_hash, string_split(text, '. ') AS chunks FROM conversations),
        rows_ AS (SELECT path, source_hash, {In.sql_strip('unnest(chunks)')} AS t, generate_subscripts(chunks, 1) - 1 AS i FROM old)
        SELECT path, source_hash, 'legacy' AS pipeline, path || ':legacy:' || i AS segment_id, 'legacy_chunk' AS kind, sha256(t) AS digest FROM rows_ WHERE t <> ''""",
    ),
    "request_batches": (
        request_batches,
        DISPATCH
        + f"""SELECT path, CAST(seg_no // {PER_REQUEST} AS INTEGER) AS batch, CAST(count(*) AS INTEGER) AS n_segments, min(seg_no) AS first_seg
            FROM segments GROUP BY path, seg_no // {PER_REQUEST}""",
    ),
    "enrich_defaults": (
        enrich_defaults,
        ANSWERED
        + """SELECT path, CAST(batch AS INTEGER) AS batch, CAST(pos AS INTEGER) AS pos, fallback, id, title, summary, array_to_string(tags, ',') AS tags,
            anchor_path, anchor_start, anchor_note, sha256(text) AS digest FROM answers""",
    ),
    "fallback_files": (
        fallback_files,
        DISPATCH
        + f"""SELECT path, count(*) AS requests, count(*) FILTER (language IN ('rust', 'kotlin')) AS failed FROM (
            SELECT DISTINCT path, language, seg_no // {PER_REQUEST} AS batch FROM segments) GROUP BY path""",
    ),
    "enriched_chunks": (
        enriched_chunks,
        ANSWERED
        + f""", items AS (SELECT path, seg_no AS i, id, text, ext AS lang FROM answers), {_sql_split('items', MAX_TOKENS)}, {_sql_merge('split_items', 'i, part', MIN_TOKENS)}
        SELECT path, CAST(k AS INTEGER) AS ord, id, sha256(text) AS digest, lang AS ext FROM merged""",
    ),
    "valid_chunks": (
        valid_chunks,
        PAGE_ITEMS
        + """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS ord, id, sha256(text) AS digest
            FROM usable JOIN firsts USING (page_id, id, i)""",
    ),
    "chunk_warnings": (
        chunk_warnings,
        PAGE_ITEMS
        + """, marked AS (SELECT u.*, f.i IS NOT NULL AS kept FROM usable u LEFT JOIN firsts f USING (page_id, id, i)),
        lines AS (
            SELECT page_id, i, 0 AS n, id, CASE WHEN NOT has_text THEN 'dropped: empty text' WHEN id = '' THEN 'dropped: missing id' ELSE 'dropped: duplicate id' END AS warning
            FROM marked WHERE NOT kept UNION ALL
            SELECT page_id, i, 1, id, 'no anchors.path' FROM marked WHERE kept AND no_path UNION ALL
            SELECT page_id, i, 2, id, 'empty summary' FROM marked WHERE kept AND no_summary UNION ALL
            SELECT page_id, i, 3, id, 'empty tags' FROM marked WHERE kept AND no_tags)
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i, n) - 1 AS INTEGER) AS ord, id, warning FROM lines""",
    ),
    "default_summaries": (
        default_summaries,
        f"SELECT page_id, {_sql_summary('html')} AS summary, 'html,paragraph' AS tags FROM pages",
    ),
    "recovered_json": (
        recovered_json,
        "SELECT event_id, CASE WHEN event_type <> 'purchase' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events",
    ),
    "response_shapes": (
        response_shapes,
        """SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos = 0 THEN '' WHEN pos = 1 THEN 'x' || doc_id END AS id,
            CASE WHEN pos = 0 THEN 'note' WHEN pos = 1 THEN lang END AS text
            FROM (SELECT doc_id, lang, unnest(CASE WHEN lang IN ('en', 'fr', 'de') THEN [0, 1] ELSE [NULL] END) AS pos FROM documents)""",
    ),
    "coerced_maps": (
        coerced_maps,
        """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN CAST(json_extract(props, '$.k') AS VARCHAR) WHEN event_type = 'signup' THEN 'pair' END AS k,
            CASE WHEN event_type = 'error' THEN 'not-json' END AS raw, CASE WHEN event_type = 'purchase' THEN '[1,2]' END AS items FROM events""",
    ),
}
