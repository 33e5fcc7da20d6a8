"""The driver's tables seen as this engine's inputs, for Spark and as SQL for the checks.

``documents`` become source files: the source names the directory and fixes the extension, and a
few literal replacements turn prose into text with blank lines, headings, definitions, braces and
annotations, so that every segmenter has work. Both engines apply the same replacements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions.text import LINE_BREAK, SPACE_CHARS, SPACE_SET, sha256
from chunkweave.sources.tables import spread_dense, spread_small

EXTENSIONS = ".py .java .md .txt .js .ts .go .rs .rst .html .json .yaml .kt .c .cs .cpp .tsx .h .sh .bin".split()
REPLACEMENTS = [
    (".\n", ".\n\n"),
    ("\nE", "\n# E"),
    ("\nA", "\ndef A"),
    ("\nT", "\npublic class T"),
    (", ", " { "),
    (". ", " } "),
    (" the ", " @Service "),
    (" of ", " @Entity "),
    (" and ", " @Autowired "),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; those of texts and vectors, which get heavy per-row work, are spread out."""
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    if name == "orders":
        return spread_dense(found)
    return spread_small(found) if name in ("documents", "embeddings", "pages") else found


def _rendered(text: Column) -> Column:
    for old, new in REPLACEMENTS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, ext, lang, source, content)``, one row per document."""
    docs = table(spark, folder, "documents")
    number = F.substring(F.col("source"), F.lit(4), F.length("source")).cast("int") % len(EXTENSIONS)
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), number)
    json_text = F.concat(
        F.lit('{"lang": "'), "lang", F.lit('", "source": "'), "source", F.lit('", "n_chars": '), F.col("n_chars").cast("string"), F.lit("}")
    )
    body = _rendered(F.col("text"))
    return (
        docs.withColumn("ext", ext)
        .withColumn("path", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), "ext"))
        .withColumn(
            "content",
            F.when(F.col("ext") == ".json", json_text)
            .when(F.col("ext") == ".sh", F.concat(F.lit("#!/bin/bash\n"), body))
            .when(F.col("ext") == ".bin", F.concat(F.lit("\x00"), body))
            .otherwise(body),
        )
        .select("path", "ext", "lang", "source", "content")
    )


def earlier(files: DataFrame) -> DataFrame:
    """The same files at an earlier build: the French ones have since been edited."""
    return files.withColumn(
        "content", F.when(F.col("lang") == "fr", F.concat(F.lit("draft\n"), "content")).otherwise(F.col("content"))
    )


def with_source_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("source_hash", sha256(F.col("content")))


# --- the same in SQL -------------------------------------------------------------------------


def text_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SPACES = text_literal(SPACE_CHARS)
BREAKS = text_literal(LINE_BREAK)
NEWLINE = "chr(10)"


def sql_strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def sql_rstrip(x: str) -> str:
    return f"rtrim({x}, {SPACES})"


def sql_lines(x: str) -> str:
    return (
        f"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE "
        f"string_split_regex(regexp_replace({x}, '({LINE_BREAK})$', ''), {BREAKS}) END)"
    )


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{SPACE_SET}]+'), lambda w: w <> '')"


def sql_word_count(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN 0 ELSE greatest(1, len({sql_words(x)})) END)"


def sql_join(x: str) -> str:
    return sql_strip(f"array_to_string({x}, {NEWLINE})")


def _sql_rendered() -> str:
    text = "text"
    for old, new in REPLACEMENTS:
        text = f"replace({text}, {text_literal(old)}, {text_literal(new)})"
    return text


SOURCES = f"""
src_ext AS (
    SELECT *, ({[e for e in EXTENSIONS]!r})[1 + CAST(substr(source, 4) AS INTEGER) % {len(EXTENSIONS)}] AS ext,
           {_sql_rendered()} AS body
    FROM documents),
sources AS (
    SELECT source || '/' || CAST(doc_id AS VARCHAR) || ext AS path, ext, lang, source,
           CASE ext WHEN '.json' THEN '{{"lang": "' || lang || '", "source": "' || source || '", "n_chars": ' || CAST(n_chars AS VARCHAR) || '}}'
                    WHEN '.sh' THEN '#!/bin/bash' || chr(10) || body
                    WHEN '.bin' THEN chr(0) || body
                    ELSE body END AS content
    FROM src_ext)
"""
EARLIER = """
earlier AS (
    SELECT path, ext, lang, source, CASE WHEN lang = 'fr' THEN 'draft' || chr(10) || content ELSE content END AS content
    FROM sources)
"""


def sql_chunks(name: str, files: str, width: int, overlap: int) -> str:
    """CTEs ``name(path, ext, lang, source, ord, text, hash)`` of line windows over ``files``."""
    step = max(width - overlap, 1)
    return f"""
{name}_lines AS (
    SELECT path, ext, lang, source, {sql_lines('content')} AS lines FROM {files}),
{name}_windows AS (
    SELECT path, ext, lang, source, lines,
           unnest(CASE WHEN len(lines) = 0 THEN []::BIGINT[]
                       ELSE range(0, CAST(ceil(greatest(len(lines) - {width}, 0) / {step}.0) AS BIGINT) + 1) END) AS i
    FROM {name}_lines),
{name}_texts AS (
    SELECT path, ext, lang, source, i, {sql_join(f'lines[i * {step} + 1 : i * {step} + {width}]')} AS text FROM {name}_windows),
{name} AS (
    SELECT path, ext, lang, source, CAST(row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS INTEGER) AS ord, text, sha256(text) AS hash
    FROM {name}_texts WHERE text <> '')
"""


def sql_bag(name: str, texts: str, key: str, dim: int) -> str:
    """CTE ``name(key, slot, value)`` of hashed bag-of-words vectors, zero slots left out."""
    return f"""
{name}_words AS (
    SELECT {key}, unnest({sql_words('lower(text)')}) AS word FROM {texts}),
{name}_counts AS (
    SELECT {key}, CAST('0x' || substr(md5(word), 1, 4) AS INTEGER) % {dim} AS slot, count(*) AS n
    FROM {name}_words GROUP BY ALL),
{name} AS (
    SELECT {key}, slot, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS value FROM {name}_counts)
"""


def sql_half(x: str) -> str:
    """A float rounded to 16-bit precision."""
    step = f"pow(2.0, greatest(floor(log2(abs(CAST({x} AS DOUBLE)))), -14) - 10)"
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE round_even(CAST({x} AS DOUBLE) / {step}, 0) * {step} END)"
