"""Registered queries: structural segments, micro splits, packing, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkweave.functions.arrays import rows_of
from chunkweave.functions.text import sha256, split_lines
from chunkweave.operators import chunkers as C
from chunkweave.operators import constraints as K
from chunkweave.operators import enrichment as N
from chunkweave.operators import long_documents as L
from chunkweave.operators import packing as P
from chunkweave.operators import segments as G
from chunkweave.plans import inputs as In

SMALL = P.ChunkingOptions(chunk_tokens=120, overlap_tokens=20, micro_chunk_tokens=40, micro_overlap_tokens=8)


def _exploded(rows, column, *names):
    return rows.select("path", F.posexplode(column).alias("ord", "item")).select(
        "path", "ord", *[F.col(f"item.{n}").alias(n) for n in names]
    )


def _texts(rows, column):
    return rows.select("path", F.posexplode(column).alias("ord", "text")).select(
        "path", "ord", sha256(F.col("text")).alias("digest"), F.length("text").alias("n_chars")
    )


def _segments(rows, column):
    return (
        rows.select("path", F.posexplode(column).alias("ord", "s"))
        .select("path", "ord", "s.id", "s.kind", "s.start_line", "s.end_line", "s.symbol", sha256(F.col("s.text")).alias("digest"))
    )


def chunker_route(spark, folder):
    return In.sources(spark, folder).select("path", C.pick_chunker(F.col("ext")).alias("chunker"))


def paragraphs(spark, folder):
    return _texts(In.sources(spark, folder), P.paragraphs(F.col("content")))


def md_sections(spark, folder):
    rows = In.sources(spark, folder)
    found = rows.select("path", F.posexplode(G.heading_sections(F.col("content"))).alias("ord", "s"))
    return found.select("path", "ord", "s.title", sha256(F.col("s.text")).alias("digest"))


def heading_segments(spark, folder):
    return _segments(In.sources(spark, folder), G.heading_segments(F.col("path"), F.col("content")))


def code_segments(spark, folder):
    return _segments(In.sources(spark, folder), G.code_segments(F.col("path"), F.col("content")))


def java_segments(spark, folder):
    return _segments(In.sources(spark, folder), G.java_segments(F.col("path"), F.col("content")))


def paragraph_segments(spark, folder):
    return _segments(In.sources(spark, folder), G.paragraph_segments(F.col("path"), F.col("content")))


def json_segments(spark, folder):
    rows = In.sources(spark, folder).withColumn("members", G.json_members("content"))
    return _segments(rows, G.json_segments(F.col("path"), F.col("content"), F.col("members")))


def brace_sections(spark, folder):
    return _texts(In.sources(spark, folder), G.brace_sections(F.col("content"), 12))


def _packed(found):
    return found.select(
        "path", "ord", "id", "chunker", "block_count", "preamble", sha256(F.col("text")).alias("digest")
    )


def line_blocks(spark, folder):
    return _packed(C.structural_chunks(In.sources(spark, folder), SMALL, "lines"))


def micro_split(spark, folder):
    docs = In.table(spark, folder, "documents").select(F.col("doc_id").alias("path"), "text")
    return _texts(docs, P.micro_split(F.col("text"), target_tokens=60, overlap_tokens=12))


def _lines_of(spark, folder, doc: str):
    """Lines as rows: all documents with one value of ``doc`` are one document, in the order of their ids."""
    docs = In.table(spark, folder, "documents").select(F.col(doc).cast("string").alias("doc"), "doc_id", F.posexplode(split_lines(F.col("text"))).alias("at", "text"))
    return docs.select("doc", F.struct("doc_id", "at").alias("position"), "text")


def _long_parts(parts):
    return parts.select(F.col("doc").alias("path"), F.col("ord").cast("int").alias("ord"), sha256(F.col("text")).alias("digest"), F.length("text").alias("n_chars"))


def long_pack(spark, folder):
    """The texts of a whole source packed as one document, which is no row anywhere."""
    return _long_parts(L.pack_long_lines(_lines_of(spark, folder, "source"), target_tokens=400, overlap_tokens=60))


def long_split(spark, folder):
    return _long_parts(L.split_long_lines(_lines_of(spark, folder, "doc_id"), 60))


def micro_split_paragraphs(spark, folder):
    rows = In.sources(spark, folder)
    return _texts(rows, P.micro_split(F.col("content"), target_tokens=60, overlap_tokens=0, strategy="paragraphs"))


def micro_split_capped(spark, folder):
    rows = In.sources(spark, folder)
    parts = P.micro_split(
        F.col("content"), target_tokens=60, overlap_tokens=12, hard_cap_tokens=40, strategy="paragraphs"
    )
    return _texts(rows, parts)


def pack_lines(spark, folder):
    """Lines of the raw documents packed as blocks."""
    docs = In.table(spark, folder, "documents").select(F.col("doc_id").alias("path"), "text")
    blocks = F.transform(split_lines(F.col("text")), lambda t: F.struct(t.alias("text"), F.lit("line").alias("kind")))
    packed = P.pack_blocks(
        F.filter(blocks, lambda b: F.length(b["text"]) > 0), chunk_tokens=80, overlap_tokens=15
    )
    found = docs.select("path", F.posexplode(packed).alias("ord", "c"))
    return found.select("path", "ord", sha256(F.col("c.text")).alias("digest"), F.size("c.members").alias("block_count"))


def text_chunks(spark, folder):
    return _packed(C.structural_chunks(In.sources(spark, folder), SMALL, "text"))


def markdown_chunks(spark, folder):
    return _packed(C.structural_chunks(In.sources(spark, folder), SMALL, "markdown"))


def parent_child(spark, folder):
    """Parents and children of every chunk, with their levels."""
    options = P.ChunkingOptions(
        chunk_tokens=120, overlap_tokens=0, micro_chunk_tokens=40, micro_overlap_tokens=8, emit_parent_chunks=True
    )
    chunks = C.structural_chunks(In.sources(spark, folder), options, "brace")
    return chunks.select("path", "ord", F.posexplode(rows_of(F.col("blocks_meta"))).alias("pos", "b")).select(
        "path", "ord", "pos", "b.kind", "b.level", "b.parent_id", "b.child_index"
    )


def code_chunks(spark, folder):
    """Symbols with preamble chunk and injected header."""
    return _packed(C.structural_chunks(In.sources(spark, folder), SMALL, "java"))


def file_headers(spark, folder):
    rows = In.sources(spark, folder)
    return rows.select("path", sha256(G.file_header(F.col("content"), 200)).alias("digest"))


def routed_chunks(spark, folder):
    found = C.structural_chunks(In.sources(spark, folder), SMALL)
    return found.select("path", "ord", "id", "chunker", "lang", "block_count", sha256(F.col("text")).alias("digest"))


def multi_view(spark, folder):
    options = P.ChunkingOptions(chunk_tokens=120, overlap_tokens=20, micro_chunk_tokens=40, micro_overlap_tokens=8, mode="multi")
    found = C.structural_chunks(In.sources(spark, folder), options)
    return found.select("path", "ord", "id", "chunker", sha256(F.col("text")).alias("digest"))


def _enriched(rows):
    """Paragraph segments dressed as enriched chunks."""
    segments = G.paragraph_segments(F.col("path"), F.col("content"))
    chunk = lambda s: F.struct(
        s["id"].alias("id"),
        s["text"].alias("text"),
        F.lit("").alias("title"),
        N.default_summary(s["text"]).alias("summary"),
        F.array(s["kind"], F.col("lang")).alias("tags"),
        *[F.create_map().cast("map<string,string>").alias(m) for m in ("anchors", "relations", "metadata")],
    )
    return rows.withColumn("chunks", F.transform(segments, chunk).cast(f"array<{K.ENRICHED}>"))


def _limited(rows, column):
    return rows.select("path", F.posexplode(column).alias("ord", "c")).select(
        "path", "ord", "c.id", sha256(F.col("c.text")).alias("digest"), F.array_join("c.tags", ",").alias("tags")
    )


def split_oversize(spark, folder):
    rows = _enriched(In.sources(spark, folder))
    return _limited(rows, K.split_oversize(F.col("chunks"), 60))


def merge_small(spark, folder):
    rows = _enriched(In.sources(spark, folder))
    return _limited(rows, K.merge_small(F.col("chunks"), 50))


def chunk_limits(spark, folder):
    rows = _enriched(In.sources(spark, folder))
    return _limited(rows, K.apply_constraints(F.col("chunks"), 60, 50))


def annotation_tags(spark, folder):
    rows = In.sources(spark, folder)
    hit = F.explode(C.annotation_tags(C.annotations(F.col("content"))))
    return rows.select("path", hit.alias("h")).select("path", "h.tag", F.array_join("h.matched", ",").alias("matched"))


def annotation_class(spark, folder):
    rows = In.sources(spark, folder)
    return rows.select("path", C.annotation_class(C.annotations(F.col("content")), F.lit("unknown")).alias("symbol_class"))


# --- SQL --------------------------------------------------------------------------------------

BRACES = "(length({0}) - length(replace({0}, '{{', ''))) - (length({0}) - length(replace({0}, '}}', '')))"
SRC = f"WITH RECURSIVE {In.SOURCES}"
LINES = f"""{SRC},
doc_lines AS (SELECT path, content, {In.sql_lines('content')} AS lines FROM sources),
ln AS (SELECT path, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS n FROM doc_lines)
"""
SP = f"[{In.SPACE_SET}]"
PARAGRAPHS = f"""
paras_all AS (
    SELECT path, list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda p: {In.sql_strip('p')}), lambda p: p <> '') AS blocks,
           list_filter(list_transform({In.sql_lines('content')}, lambda p: {In.sql_strip('p')}), lambda p: p <> '') AS flat
    FROM sources),
paras AS (SELECT path, CASE WHEN len(blocks) > 0 THEN blocks ELSE flat END AS units FROM paras_all)
"""


def _sql_segment_rows(span: str) -> str:
    """From ``span(path, kind, first, last, symbol)`` and ``doc_lines`` to segment rows."""
    return f"""
cut AS (
    SELECT s.*, {In.sql_join('lines[first : last]')} AS text FROM {span} s JOIN doc_lines USING (path)),
segs AS (
    SELECT path, kind, first, last, symbol, text, text AS raw FROM cut WHERE text <> '')
"""


SEGMENT_OUT = """
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY first) - 1 AS INTEGER) AS ord,
       path || ':' || kind || ':' || first || ':' || substr(sha256(raw), 1, 10) AS id, kind,
       CAST(first AS INTEGER) AS start_line, CAST(last AS INTEGER) AS end_line, symbol, sha256(text) AS digest
"""


def _sql_marked(test: str, symbol: str, kind: str, whole: str, lead_kind: str) -> str:
    return (
        LINES
        + f""",
marks AS (SELECT path, i, n, {symbol} AS symbol FROM ln WHERE {test}),
spans AS (
    SELECT path, '{kind}' AS kind, i AS first, coalesce(lead(i) OVER (PARTITION BY path ORDER BY i) - 1, n) AS last, symbol FROM marks
    UNION ALL SELECT path, '{lead_kind}', 1, min(i) - 1, NULL FROM marks GROUP BY path HAVING min(i) > 1),
{_sql_segment_rows('spans')},
everything AS (
    SELECT * FROM segs UNION ALL
    SELECT path, '{whole}', 1, len(lines), NULL, {In.sql_strip('content')}, content FROM doc_lines
    WHERE len(lines) > 0 AND path NOT IN (SELECT path FROM marks))
"""
        + SEGMENT_OUT
        + " FROM everything"
    )


def _sql_greedy(units: str, limit: int, overlap: int, p: str = "") -> str:
    """Greedy packing of ``units(path, units, tokens)``, jumping from cut to cut.

    ``s`` is the first unit of the open part and ``m`` the first one not in it yet; the next cut is
    before the first unit at which the running sum leaves the limit.
    """
    tail = (
        "m"
        if overlap == 0
        else f"coalesce(list_min(list_filter(range(s, m), lambda j: cum[m + 1] - cum[j + 1] <= {overlap})), m - 1)"
    )
    return f"""
{p}summed AS (
    SELECT path, units, len(units) AS n,
           list_transform(range(0, len(tokens) + 1), lambda k: coalesce(list_sum(tokens[1 : k]), 0)) AS cum
    FROM {units} WHERE len(units) > 0),
{p}jumps AS (
    SELECT path, 0 AS k, 0::BIGINT AS s, coalesce(list_min(list_filter(range(1, n), lambda j: cum[j + 2] > {limit})), n) AS m FROM {p}summed
    UNION ALL
    SELECT path, k + 1, s2, coalesce(list_min(list_filter(range(m + 1, n), lambda j: cum[j + 2] - cum[s2 + 1] > {limit})), n)
    FROM (SELECT path, k, m, n, cum, {tail} AS s2 FROM {p}jumps JOIN {p}summed USING (path) WHERE m < n) t),
{p}parts AS (
    SELECT path, k, s, m, {In.sql_join('units[s + 1 : m]')} AS text FROM {p}jumps JOIN {p}summed USING (path))
"""


def _tokens_list(x: str) -> str:
    return f"list_transform({x}, lambda u: {In.sql_word_count('u')})"


def _sql_pack_sections(sections: str, strategy: str, p: str) -> str:
    """``sections(path, i, text)`` to micro parts (40/8), and these packed (120/20) in ``{p}parts``."""
    if strategy == "lines":
        units = f"list_filter(list_transform({In.sql_lines('text')}, lambda u: {In.sql_rstrip('u')}), lambda u: u <> '')"
    else:
        units = f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda u: {In.sql_strip('u')}), lambda u: u <> '')"
    return f"""
{p}units AS (SELECT path || chr(1) || i AS path, {units} AS units FROM {sections}),
{p}counted AS (SELECT path, units, {_tokens_list('units')} AS tokens FROM {p}units),
{_sql_greedy(p + 'counted', 40, 8, p + 'm_')},
{p}blocks AS (
    SELECT split_part(path, chr(1), 1) AS path, list(text ORDER BY CAST(split_part(path, chr(1), 2) AS INTEGER), k) AS units
    FROM {p}m_parts GROUP BY 1),
{p}packable AS (SELECT path, units, {_tokens_list('units')} AS tokens FROM {p}blocks),
{_sql_greedy(p + 'packable', 120, 20, p)}
"""


WORD_CHARS = r"\p{L}\p{M}\p{N}_"
DEFINES = f"regexp_matches(line, '^{SP}*(def|class|function|fn|interface|type){SP}+[A-Za-z_]')"
HEADERS = f"""
header_lines AS (
    SELECT path, i, line, CASE WHEN starts_with({In.sql_strip('line')}, 'package ') OR starts_with({In.sql_strip('line')}, 'import ')
        OR starts_with({In.sql_strip('line')}, '@') THEN 'head'
        WHEN regexp_matches(line, 'class |interface |enum |record ') THEN 'type' ELSE 'other' END AS kind FROM ln),
first_types AS (SELECT path, min(i) AS t FROM header_lines WHERE kind = 'type' GROUP BY path),
header_texts AS (
    SELECT path, {In.sql_strip('string_agg(line, chr(10) ORDER BY i)')} AS header FROM header_lines LEFT JOIN first_types USING (path)
    WHERE (kind = 'head' AND (t IS NULL OR i < t)) OR i = t GROUP BY path)
"""
LINE_PACKED = f"""
flat_units AS (SELECT path, list_filter({In.sql_lines('content')}, lambda u: {In.sql_strip('u')} <> '') AS units FROM sources),
flat_counted AS (SELECT path, units, {_tokens_list('units')} AS tokens FROM flat_units),
{_sql_greedy('flat_counted', 120, 20, 'flat_')}
"""
TEXT_PACKED = f"""{PARAGRAPHS},
text_counted AS (SELECT path, units, {_tokens_list('units')} AS tokens FROM paras),
{_sql_greedy('text_counted', 120, 20, 'text_')}
"""
MARKDOWN_PACKED = f"""
md_numbered AS (SELECT *, sum(CASE WHEN i = 1 OR starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS sec FROM ln),
md_sections AS (SELECT path, sec AS i, {In.sql_strip('string_agg(line, chr(10) ORDER BY i)')} AS text FROM md_numbered GROUP BY path, sec),
{_sql_pack_sections('md_sections', 'paragraphs', 'md_')}
"""
CODE_PACKED = f"""
code_marks AS (SELECT path, i, n FROM ln WHERE {DEFINES}),
code_spans AS (SELECT path, i AS first, coalesce(lead(i) OVER (PARTITION BY path ORDER BY i) - 1, n) AS last FROM code_marks),
code_sections AS (
    SELECT path, first AS i, {In.sql_join('lines[first : last]')} AS text FROM code_spans JOIN doc_lines USING (path)
    UNION ALL SELECT path, 1, {In.sql_join('lines[1 : first - 1]')} FROM (
        SELECT path, min(i) AS first FROM code_marks GROUP BY path HAVING min(i) > 1) JOIN doc_lines USING (path)
    WHERE len(list_filter(lines[1 : first - 1], lambda l: {In.sql_strip('l')} <> '' AND NOT regexp_matches({In.sql_strip('l')}, '^(package |import |@)'))) > 0
       OR length({In.sql_join('lines[1 : first - 1]')}) > 6000),
{_sql_pack_sections('code_sections', 'lines', 'code_')}
"""


def _sql_brace_sections(limit: int) -> str:
    """CTE ``brace_parts(path, k, text)``."""
    return f"""
shaped AS (SELECT path, i - 1 AS pos, n, {In.sql_strip('line')} = '' AS blank, {BRACES.format('line')} AS delta FROM ln),
fold AS (
    SELECT path, 0::BIGINT AS pos, 0::BIGINT AS start, 0::BIGINT AS depth, NULL::BIGINT AS a, NULL::BIGINT AS b FROM doc_lines
    UNION ALL
    SELECT path, pos + 1, CASE WHEN gap OR full_ THEN pos + 1 ELSE start END, CASE WHEN gap THEN depth ELSE depth + delta END,
           CASE WHEN gap OR full_ THEN start END, CASE WHEN gap THEN pos WHEN full_ THEN pos + 1 END
    FROM (SELECT f.path, f.pos, f.start, f.depth, s.delta, s.blank AND f.pos > f.start AND f.depth = 0 AS gap,
                 f.depth + s.delta = 0 AND f.pos + 1 - f.start >= {limit} AS full_
          FROM fold f JOIN shaped s ON s.path = f.path AND s.pos = f.pos) t),
cuts AS (SELECT path, a, b FROM fold WHERE a IS NOT NULL UNION ALL
         SELECT path, start, len(lines) FROM fold JOIN doc_lines USING (path) WHERE pos = len(lines) AND start < len(lines)),
brace_all AS (SELECT path, a AS k, {In.sql_join('lines[a + 1 : b]')} AS text FROM cuts JOIN doc_lines USING (path)),
brace_parts AS (SELECT * FROM brace_all WHERE text <> '')
"""


def _sql_code_chunks(name: str, separator: str) -> str:
    """CTE ``{name}_chunks``: preamble, packed symbols with header, or packed lines without symbols."""
    return f"""
{name}_chunks AS (
    SELECT path, 0 AS ord, path || ':{name}:preamble' AS id, '{name}' AS chunker, 1 AS block_count, true AS preamble, header AS text
    FROM (SELECT path, substr(header, 1, 6000) AS header FROM header_texts) JOIN (SELECT DISTINCT path FROM code_marks) USING (path) WHERE header <> ''
    UNION ALL
    SELECT path, CASE WHEN coalesce(header, '') <> '' THEN k + 1 ELSE k END, path || ':{name}:' || k, '{name}', m - s, false,
           CASE WHEN coalesce(header, '') <> '' THEN substr(header, 1, 6000) || {separator} || text ELSE text END
    FROM code_parts LEFT JOIN header_texts USING (path)
    UNION ALL
    SELECT path, k, path || ':code_fallback:' || k, 'code:fallback', m - s, false, text
    FROM flat_parts WHERE path NOT IN (SELECT path FROM code_marks))
"""


PLAIN_SEPARATOR = "chr(10) || chr(10)"
JAVA_SEPARATOR = "chr(10) || chr(10) || '// ... code ...' || chr(10) || chr(10)"
PACKED_OUT = """
SELECT path, CAST(ord AS INTEGER) AS ord, id, chunker, CAST(block_count AS INTEGER) AS block_count, preamble, sha256(text) AS digest
"""


def _sql_simple_chunks(parts: str, chunker: str) -> str:
    return f"SELECT path, k AS ord, path || ':{chunker}:' || k AS id, '{chunker}' AS chunker, m - s AS block_count, false AS preamble, text FROM {parts}"


SEGMENTS_AS_CHUNKS = f"""
parts AS (SELECT path, lang, list_filter(list_transform(string_split_regex(content, '\\n{SP}*\\n'), lambda p: {In.sql_strip('p')}), lambda p: p <> '') AS ps FROM sources),
each AS (SELECT path, lang, unnest(ps) AS text, generate_subscripts(ps, 1) AS i FROM parts),
sized AS (SELECT *, greatest(len({In.sql_lines('text')}), 1) AS n FROM each),
placed AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY i) AS last FROM sized),
items AS (
    SELECT path, CAST(i AS INTEGER) AS i, path || ':paragraph:' || CAST(last - n + 1 AS BIGINT) || ':' || substr(sha256(text), 1, 10) AS id, text, lang FROM placed)
"""
ESTIMATE = f"(CASE WHEN {In.sql_strip('{0}')} = '' THEN 0 ELSE greatest(1, length({In.sql_strip('{0}')}) // 4) END)"


def _sql_split(items: str, limit: int) -> str:
    """CTE ``split_items(path, i, part, id, text, lang)``."""
    return f"""
long_items AS (SELECT path, i, id, lang, {In.sql_lines('text')} AS lines FROM {items} WHERE {ESTIMATE.format('text')} > {limit}),
splits AS (
    SELECT path, i, 0 AS part, 0::BIGINT AS a, coalesce(list_min(list_filter(range(1, len(lines)),
           lambda j: {ESTIMATE.format("array_to_string(lines[1 : j + 1], chr(10))")} > {limit})), len(lines)) AS b FROM long_items
    UNION ALL
    SELECT path, i, part + 1, b, coalesce(list_min(list_filter(range(b + 1, len(lines)),
           lambda j: {ESTIMATE.format("array_to_string(lines[b + 1 : j + 1], chr(10))")} > {limit})), len(lines))
    FROM splits JOIN long_items USING (path, i) WHERE b < len(lines)),
split_texts AS (
    SELECT path, i, part, id, lang, {In.sql_join('lines[a + 1 : b]')} AS text FROM splits JOIN long_items USING (path, i)),
split_parts AS (
    SELECT path, i, row_number() OVER (PARTITION BY path, i ORDER BY part) - 1 AS part, count(*) OVER (PARTITION BY path, i) AS parts, id, lang, text
    FROM split_texts WHERE text <> ''),
split_items AS (
    SELECT path, i, part, CASE WHEN parts = 1 THEN id ELSE id || ':part:' || part END AS id, text, lang FROM split_parts
    UNION ALL
    SELECT path, i, 0, id, text, lang FROM {items} WHERE {ESTIMATE.format('text')} <= {limit})
"""


def _sql_merge(items: str, order: str, limit: int) -> str:
    """CTE ``merged(path, k, id, text, lang, n)``."""
    return f"""
numbered_items AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY {order}) AS pos, count(*) OVER (PARTITION BY path) AS total FROM {items}),
merging AS (
    SELECT path, pos, total, id, text, lang, 0 AS k, NULL::VARCHAR AS out_id, NULL::VARCHAR AS out_text FROM numbered_items WHERE pos = 1
    UNION ALL
    SELECT m.path, n.pos, n.total,
           CASE WHEN {ESTIMATE.format('m.text')} >= {limit} THEN n.id ELSE m.id || '+' || n.id END,
           CASE WHEN {ESTIMATE.format('m.text')} >= {limit} THEN n.text ELSE {In.sql_strip("m.text || chr(10) || chr(10) || n.text")} END,
           m.lang, CASE WHEN {ESTIMATE.format('m.text')} >= {limit} THEN m.k + 1 ELSE m.k END,
           CASE WHEN {ESTIMATE.format('m.text')} >= {limit} THEN m.id END, CASE WHEN {ESTIMATE.format('m.text')} >= {limit} THEN m.text END
    FROM merging m JOIN numbered_items n ON n.path = m.path AND n.pos = m.pos + 1),
merged AS (
    SELECT path, k - 1 AS k, out_id AS id, out_text AS text, lang FROM merging WHERE out_id IS NOT NULL
    UNION ALL
    SELECT path, k, id, text, lang FROM merging WHERE pos = total)
"""


def _limited_out(rows: str, ord_: str, tags: str) -> str:
    return f"SELECT path, CAST({ord_} AS INTEGER) AS ord, id, sha256(text) AS digest, {tags} AS tags FROM {rows}"


TAGS_AS_GIVEN = "'paragraph,' || lang"
TAGS_SORTED = "CASE WHEN contains(id, '+') THEN least('paragraph', lang) || ',' || greatest('paragraph', lang) ELSE 'paragraph,' || lang END"
JAVA_SHAPES = f"""
java_lines AS (
    SELECT path, i, n, {BRACES.format("line")} AS delta,
           regexp_extract(line, '^{SP}*(public{SP}+|private{SP}+|protected{SP}+)?(class|interface|enum){SP}+([{WORD_CHARS}]+)', 3) AS type_name,
           regexp_extract(line, '^{SP}*(public|private|protected)?{SP}*(static{SP}+)?[{WORD_CHARS}<>\\[\\], ?]+{SP}+([{WORD_CHARS}]+){SP}*\\([^)]*\\){SP}*\\{{?{SP}*$', 3) AS method
    FROM ln),
java_fold AS (
    SELECT path, 0::BIGINT AS i, 0::BIGINT AS first, ''::VARCHAR AS kind, ''::VARCHAR AS symbol, 0::BIGINT AS depth,
           NULL::BIGINT AS a, NULL::VARCHAR AS a_kind, NULL::VARCHAR AS a_symbol FROM doc_lines
    UNION ALL
    SELECT path, i, CASE WHEN closes THEN 0 ELSE first END, CASE WHEN closes THEN '' ELSE kind END, CASE WHEN closes THEN '' ELSE symbol END,
           CASE WHEN closes THEN 0 ELSE depth END, CASE WHEN closes THEN first END, CASE WHEN closes THEN kind END, CASE WHEN closes THEN symbol END
    FROM (SELECT *, first > 0 AND depth <= 0 AS closes FROM (
        SELECT f.path, l.i, f.depth + l.delta AS depth,
               CASE WHEN f.first = 0 AND (type_name <> '' OR method <> '') THEN l.i ELSE f.first END AS first,
               CASE WHEN f.first > 0 THEN f.kind WHEN type_name <> '' THEN 'class_header' WHEN method <> '' THEN 'method' ELSE '' END AS kind,
               CASE WHEN f.first > 0 THEN f.symbol WHEN type_name <> '' THEN type_name ELSE method END AS symbol
        FROM java_fold f JOIN java_lines l ON l.path = f.path AND l.i = f.i + 1) x) t),
java_found AS (
    SELECT path, a_kind AS kind, a AS first, i AS last, a_symbol AS symbol FROM java_fold WHERE a IS NOT NULL
    UNION ALL
    SELECT path, kind, first, i, symbol FROM java_fold JOIN doc_lines USING (path) WHERE i = len(lines) AND first > 0),
java_spans AS (
    SELECT * FROM java_found UNION ALL
    SELECT path, 'java_file', 1, len(lines), NULL FROM doc_lines WHERE len(lines) > 0 AND path NOT IN (SELECT path FROM java_found)),
"""

PART_OUT = """
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS INTEGER) AS ord, sha256(text) AS digest, length(text) AS n_chars
FROM parts WHERE text <> ''
"""


QUERIES_ROUTE = """SELECT path, CASE ext WHEN '.java' THEN 'java' WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown'
    WHEN '.txt' THEN 'text' WHEN '.rst' THEN 'text' WHEN '.sh' THEN 'text' WHEN '.bin' THEN 'text' ELSE 'code' END AS route FROM sources"""

QUERIES = {
    "chunker_route": (
        chunker_route,
        SRC
        + """ SELECT path, CASE ext WHEN '.java' THEN 'java' WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown'
            WHEN '.txt' THEN 'text' WHEN '.rst' THEN 'text' WHEN '.sh' THEN 'text' WHEN '.bin' THEN 'text' ELSE 'code' END AS chunker FROM sources""",
    ),
    "paragraphs": (
        paragraphs,
        f"{SRC}, {PARAGRAPHS} SELECT path, CAST(i - 1 AS INTEGER) AS ord, sha256(u) AS digest, length(u) AS n_chars "
        "FROM (SELECT path, unnest(units) AS u, generate_subscripts(units, 1) AS i FROM paras)",
    ),
    "md_sections": (
        md_sections,
        LINES
        + f""",
        numbered AS (SELECT *, sum(CASE WHEN i = 1 OR starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS sec FROM ln),
        grouped AS (SELECT path, sec, {In.sql_strip('arg_min(line, i)')} AS head, {In.sql_strip('string_agg(line, chr(10) ORDER BY i)')} AS text FROM numbered GROUP BY path, sec)
        SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY sec) - 1 AS INTEGER) AS ord,
               CASE WHEN starts_with(head, '#') THEN head ELSE '' END AS title, sha256(text) AS digest FROM grouped WHERE text <> ''""",
    ),
    "heading_segments": (
        heading_segments,
        _sql_marked(
            f"regexp_matches(line, '^(#{{1,6}}){SP}+(.+)$')",
            In.sql_strip(f"regexp_extract(line, '^(#{{1,6}}){SP}+(.+)$', 2)"),
            "heading_section",
            "markdown_section",
            "markdown_lead",
        ),
    ),
    "code_segments": (
        code_segments,
        _sql_marked(
            f"regexp_matches(line, '^{SP}*(def|class|function|fn|interface|type){SP}+[A-Za-z_]')",
            rf"regexp_extract(line, '^{SP}*(def|class|function|fn|interface|type){SP}+([A-Za-z_][\p{{L}}\p{{M}}\p{{Nd}}_]*)', 2)",
            "code_symbol",
            "code_block",
            "code_lead",
        ),
    ),
    "java_segments": (
        java_segments,
        LINES + f", {JAVA_SHAPES} {_sql_segment_rows('java_spans')}" + SEGMENT_OUT + " FROM segs",
    ),
    "paragraph_segments": (
        paragraph_segments,
        f"""{SRC},
        parts AS (SELECT path, list_filter(list_transform(string_split_regex(content, '\\n{SP}*\\n'), lambda p: {In.sql_strip('p')}), lambda p: p <> '') AS ps FROM sources),
        each AS (SELECT path, unnest(ps) AS text, generate_subscripts(ps, 1) AS i FROM parts),
        sized AS (SELECT *, greatest(len({In.sql_lines('text')}), 1) AS n FROM each),
        placed AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY i) AS last FROM sized)
        SELECT path, CAST(i - 1 AS INTEGER) AS ord, path || ':paragraph:' || CAST(last - n + 1 AS BIGINT) || ':' || substr(sha256(text), 1, 10) AS id,
               'paragraph' AS kind, CAST(last - n + 1 AS INTEGER) AS start_line, CAST(last AS INTEGER) AS end_line,
               'paragraph_' || i AS symbol, sha256(text) AS digest FROM placed""",
    ),
    "json_segments": (
        json_segments,
        f"""{SRC},
        kinds AS (SELECT *, json_valid(content) AND starts_with(content, '{{') AS is_object, len({In.sql_lines('content')}) AS n FROM sources),
        members AS (SELECT path, n, unnest(['lang', 'source', 'n_chars']) AS k, unnest([1, 2, 3]) AS i, content FROM kinds WHERE is_object),
        texts AS (SELECT path, n, i, k, {In.sql_strip("k || ':' || chr(10) || json_extract(content, '$.' || k)::VARCHAR")} AS text FROM members),
        everything AS (
            SELECT path, i, 'top_level_key' AS kind, n, k AS symbol, text, text AS raw FROM texts UNION ALL
            SELECT path, 1, 'structured_blob', greatest(n, 1), NULL, {In.sql_strip('content')}, content FROM kinds WHERE NOT is_object)
        SELECT path, CAST(i - 1 AS INTEGER) AS ord, path || ':' || kind || ':1:' || substr(sha256(raw), 1, 10) AS id, kind,
               1 AS start_line, CAST(n AS INTEGER) AS end_line, symbol, sha256(text) AS digest FROM everything""",
    ),
    "brace_sections": (
        brace_sections, f"{LINES}, {_sql_brace_sections(12)}" + PART_OUT.replace("FROM parts", "FROM brace_parts")
    ),
    "line_blocks": (
        line_blocks,
        f"""{SRC},
        kept AS (SELECT path, list_filter({In.sql_lines('content')}, lambda u: {In.sql_strip('u')} <> '') AS units FROM sources),
        counted AS (SELECT path, units, {_tokens_list('units')} AS tokens FROM kept),
        {_sql_greedy('counted', 120, 20)}
        SELECT path, CAST(k AS INTEGER) AS ord, path || ':code_fallback:' || k AS id, 'code:fallback' AS chunker,
               CAST(m - s AS INTEGER) AS block_count, false AS preamble, sha256(text) AS digest FROM parts""",
    ),
    "micro_split": (
        micro_split,
        f"""WITH RECURSIVE kept AS (
            SELECT doc_id AS path, text AS whole, list_filter(list_transform({In.sql_lines('text')}, lambda u: {In.sql_rstrip('u')}), lambda u: u <> '') AS units FROM documents),
        counted AS (SELECT path, units, {_tokens_list('units')} AS tokens FROM kept),
        {_sql_greedy('counted', 60, 12)}"""
        + PART_OUT,
    ),
    "long_pack": (
        long_pack,
        f"""WITH RECURSIVE units_of AS (
            SELECT source, doc_id, unnest({In.sql_lines('text')}) AS u, generate_subscripts({In.sql_lines('text')}, 1) AS i FROM documents),
        kept AS (SELECT source AS path, list({In.sql_rstrip('u')} ORDER BY doc_id, i) AS units FROM units_of WHERE {In.sql_rstrip('u')} <> '' GROUP BY source),
        counted AS (SELECT path, units, {_tokens_list('units')} AS tokens FROM kept),
        {_sql_greedy('counted', 400, 60)}"""
        + PART_OUT,
    ),
    "long_split": (
        long_split,
        f"""WITH RECURSIVE items AS (SELECT CAST(doc_id AS VARCHAR) AS path, 0 AS i, '' AS id, '' AS lang, text FROM documents), {_sql_split('items', 60)}
        SELECT path, CAST(part AS INTEGER) AS ord, sha256({In.sql_strip('text')}) AS digest, length({In.sql_strip('text')}) AS n_chars FROM split_items
        WHERE {In.sql_strip('text')} <> ''""",
    ),
    "micro_split_paragraphs": (
        micro_split_paragraphs,
        f"""{SRC},
        blocks AS (SELECT path, list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda u: {In.sql_strip('u')}), lambda u: u <> '') AS units FROM sources),
        counted AS (SELECT path, units, {_tokens_list('units')} AS tokens FROM blocks),
        {_sql_greedy('counted', 60, 0)}"""
        + PART_OUT,
    ),
    "micro_split_capped": (
        micro_split_capped,
        f"""{SRC},
        blocks AS (SELECT path, list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda u: {In.sql_strip('u')}), lambda u: u <> '') AS units FROM sources),
        units AS (SELECT path, unnest(units) AS u, generate_subscripts(units, 1) AS i, len(units) AS total FROM blocks),
        counted AS (SELECT *, {In.sql_word_count('u')} AS n FROM units),
        big_lines AS (
            SELECT path || chr(1) || i AS path, list_filter(list_transform({In.sql_lines('u')}, lambda x: {In.sql_rstrip('x')}), lambda x: x <> '') AS units
            FROM counted WHERE n > 40),
        big_counted AS (SELECT path, units, {_tokens_list('units')} AS tokens FROM big_lines),
        {_sql_greedy('big_counted', 40, 0, 'big_')},
        pieces AS (SELECT path, list(text ORDER BY k) AS texts FROM big_parts GROUP BY path),
        steps AS MATERIALIZED (SELECT c.*, coalesce(p.texts, []) AS texts FROM counted c LEFT JOIN pieces p ON p.path = c.path || chr(1) || c.i),
        fold AS (
            SELECT DISTINCT path, 0::BIGINT AS i, total, []::VARCHAR[] AS held, []::BIGINT[] AS sizes, []::VARCHAR[] AS done FROM units
            UNION ALL
            SELECT path, i, total, CASE WHEN n > 40 THEN held[t:] ELSE list_append(held[t:], u) END,
                   CASE WHEN n > 40 THEN sizes[t:] ELSE list_append(sizes[t:], n) END,
                   CASE WHEN n > 40 THEN list_concat(closed, texts) ELSE closed END
            FROM (
                SELECT path, i, total, held, sizes, u, n, texts, CASE WHEN closes THEN [{In.sql_join('held')}] ELSE [] END AS closed,
                       CASE WHEN closes THEN coalesce(list_min(list_filter(range(1, len(held) + 1), lambda j: list_sum(sizes[j:]) <= 12)), len(held)) ELSE 1 END AS t
                FROM (SELECT f.path, s.i, s.total, f.held, f.sizes, s.u, s.n, s.texts,
                             len(f.held) > 0 AND (s.n > 40 OR list_sum(f.sizes) + s.n > 40) AS closes
                      FROM fold f JOIN steps s ON s.path = f.path AND s.i = f.i + 1) x) y),
        emitted AS (
            SELECT path, i, unnest(done) AS text, generate_subscripts(done, 1) AS j FROM fold UNION ALL
            SELECT path, i + 1, {In.sql_join('held')}, 1 FROM fold WHERE i = total AND len(held) > 0)
        SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY i, j) - 1 AS INTEGER) AS ord, sha256(text) AS digest, length(text) AS n_chars
        FROM emitted WHERE text <> ''""",
    ),
    "pack_lines": (
        pack_lines,
        f"""WITH RECURSIVE kept AS (
            SELECT doc_id AS path, list_filter({In.sql_lines('text')}, lambda u: u <> '') AS units FROM documents),
        counted AS (SELECT path, units, {_tokens_list('units')} AS tokens FROM kept),
        {_sql_greedy('counted', 80, 15)}
        SELECT path, CAST(k AS INTEGER) AS ord, sha256(text) AS digest, CAST(m - s AS INTEGER) AS block_count FROM parts""",
    ),
    "text_chunks": (
        text_chunks,
        f"{SRC}, {TEXT_PACKED}" + PACKED_OUT + f" FROM ({_sql_simple_chunks('text_parts', 'text')})",
    ),
    "markdown_chunks": (
        markdown_chunks,
        f"{LINES}, {MARKDOWN_PACKED}" + PACKED_OUT + f" FROM ({_sql_simple_chunks('md_parts', 'markdown')})",
    ),
    "parent_child": (
        parent_child,
        f"""{LINES}, {_sql_brace_sections(40)},
        sec AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS i, text FROM brace_parts),
        pc_units AS (
            SELECT path || chr(1) || i AS path, list_filter(list_transform({In.sql_lines('text')}, lambda u: {In.sql_rstrip('u')}), lambda u: u <> '') AS units FROM sec),
        pc_counted AS (SELECT path, units, {_tokens_list('units')} AS tokens FROM pc_units),
        {_sql_greedy('pc_counted', 40, 8, 'pc_')},
        pc_blocks AS (
            SELECT path, i, -1 AS j, text FROM sec UNION ALL
            SELECT split_part(path, chr(1), 1), CAST(split_part(path, chr(1), 2) AS BIGINT), k, text FROM pc_parts),
        pc_placed AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY i, j) - 1 AS pos FROM pc_blocks),
        pc_lists AS (SELECT path, list(text ORDER BY pos) AS units FROM pc_placed GROUP BY path),
        pc_packable AS (SELECT path, units, {_tokens_list('units')} AS tokens FROM pc_lists),
        {_sql_greedy('pc_packable', 120, 0, 'pp_')}
        SELECT b.path, CAST(c.k AS INTEGER) AS ord, CAST(b.pos - c.s AS INTEGER) AS pos, CASE WHEN j < 0 THEN 'brace_part' ELSE 'brace_child' END AS kind,
               CASE WHEN j < 0 THEN 'parent' ELSE 'child' END AS level, b.path || ':brace:part:' || i AS parent_id,
               CASE WHEN j >= 0 THEN CAST(j AS INTEGER) END AS child_index
        FROM pc_placed b JOIN pp_jumps c ON c.path = b.path AND b.pos >= c.s AND b.pos < c.m""",
    ),
    "code_chunks": (
        code_chunks,
        f"{LINES}, {HEADERS}, {CODE_PACKED}, {LINE_PACKED}, {_sql_code_chunks('java', JAVA_SEPARATOR)}" + PACKED_OUT + " FROM java_chunks",
    ),
    "file_headers": (
        file_headers,
        f"{LINES}, {HEADERS} SELECT path, sha256(substr(coalesce(header, ''), 1, 200)) AS digest FROM sources LEFT JOIN header_texts USING (path)",
    ),
    "routed_chunks": (
        routed_chunks,
        f"{LINES}, {HEADERS}, {CODE_PACKED}, {LINE_PACKED}, {TEXT_PACKED}, {MARKDOWN_PACKED}, "
        + ", ".join(_sql_code_chunks(n, JAVA_SEPARATOR if n == "java" else PLAIN_SEPARATOR) for n in ("java", "python", "code"))
        + f""", routes AS ({QUERIES_ROUTE}),
        routed AS (
            SELECT * FROM java_chunks JOIN routes USING (path) WHERE route = 'java' UNION ALL
            SELECT * FROM python_chunks JOIN routes USING (path) WHERE route = 'python' UNION ALL
            SELECT * FROM code_chunks JOIN routes USING (path) WHERE route = 'code' UNION ALL
            SELECT * FROM ({_sql_simple_chunks('md_parts', 'markdown')}) JOIN routes USING (path) WHERE route = 'markdown' UNION ALL
            SELECT * FROM ({_sql_simple_chunks('text_parts', 'text')}) JOIN routes USING (path) WHERE route = 'text')
        SELECT path, CAST(ord AS INTEGER) AS ord, id, chunker, CASE WHEN chunker IN ('text', 'code:fallback') THEN NULL ELSE chunker END AS lang,
               CAST(block_count AS INTEGER) AS block_count, sha256(text) AS digest FROM routed""",
    ),
    "multi_view": (
        multi_view,
        f"{LINES}, {HEADERS}, {CODE_PACKED}, {LINE_PACKED}, {TEXT_PACKED}, {_sql_brace_sections(40)}, "
        + "brace_sections AS (SELECT path, k AS i, text FROM brace_parts), "
        + _sql_pack_sections("brace_sections", "lines", "br_")
        + ", "
        + _sql_code_chunks("code", PLAIN_SEPARATOR)
        + f""", views AS (
            SELECT *, 1 AS view FROM code_chunks UNION ALL
            SELECT *, 2 FROM ({_sql_simple_chunks('br_parts', 'brace')}) UNION ALL
            SELECT *, 3 FROM ({_sql_simple_chunks('text_parts', 'text')})),
        firsts AS (SELECT *, row_number() OVER (PARTITION BY path, chunker, text ORDER BY view, ord) AS copy FROM views)
        SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY view, ord) - 1 AS INTEGER) AS ord, id, chunker, sha256(text) AS digest
        FROM firsts WHERE copy = 1""",
    ),
    "split_oversize": (
        split_oversize,
        f"{SRC}, {SEGMENTS_AS_CHUNKS}, {_sql_split('items', 60)}"
        + _limited_out("split_items", "row_number() OVER (PARTITION BY path ORDER BY i, part) - 1", TAGS_AS_GIVEN),
    ),
    "merge_small": (
        merge_small,
        f"{SRC}, {SEGMENTS_AS_CHUNKS}, {_sql_merge('items', 'i', 50)}" + _limited_out("merged", "k", TAGS_SORTED),
    ),
    "chunk_limits": (
        chunk_limits,
        f"{SRC}, {SEGMENTS_AS_CHUNKS}, {_sql_split('items', 60)}, {_sql_merge('split_items', 'i, part', 50)}"
        + _limited_out("merged", "k", TAGS_SORTED),
    ),
    "annotation_tags": (
        annotation_tags,
        f"""{SRC},
        rules AS (SELECT unnest({[k for k in C.ANNOTATION_GROUPS]!r}) AS tag, unnest({[list(v) for v in C.ANNOTATION_GROUPS.values()]!r}) AS members),
        rule_rows AS (SELECT tag, unnest(members) AS annotation FROM rules),
        found AS (SELECT DISTINCT path, unnest(regexp_extract_all(content, '(@\\w+)', 1)) AS annotation FROM sources)
        SELECT path, tag, string_agg(annotation, ',' ORDER BY annotation) AS matched FROM found JOIN rule_rows USING (annotation) GROUP BY path, tag""",
    ),
    "annotation_class": (
        annotation_class,
        f"""{SRC},
        found AS (SELECT path, regexp_extract_all(content, '(@\\w+)', 1) AS a FROM sources)
        SELECT path, CASE {' '.join(f"WHEN list_has_any(a, {list(v)!r}) THEN '{k}'" for k, v in C.ANNOTATION_CLASSES.items())} ELSE 'unknown' END AS symbol_class FROM found""",
    ),
}
