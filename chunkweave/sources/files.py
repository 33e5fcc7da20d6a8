"""Source trees as tables of decoded text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions.text import is_blank, path_suffix

# Extensions that are indexed, and those the enrichment build adds.
CODE_EXTENSIONS = [".py", ".js", ".ts", ".tsx", ".java", ".kt", ".go", ".rs", ".cpp", ".c", ".h", ".cs"]
TEXT_EXTENSIONS = [".md", ".txt", ".rst"]
MARKUP_EXTENSIONS = [".markdown", ".html", ".htm", ".json", ".yml", ".yaml"]


def decode_text(content: Column) -> Column:
    """UTF-8 where the whole file is valid, else latin-1; line ends become ``\\n``."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1")
    )
    return F.regexp_replace(text, r"\r\n?", "\n")


def _glob(extensions: list[str]) -> str:
    """File-name pattern of the extensions in any case, applied while listing."""
    any_case = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext[1:]) for ext in extensions]
    return "*.{" + ",".join(any_case) + "}"


def _qualified(spark: SparkSession, root: str) -> str:
    """The root as Spark's sources spell it, resolved by the file system it belongs to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _relative(spark: SparkSession, root: str) -> Column:
    """Path below ``root``: what follows the qualified root, cut by length."""
    return F.substr(F.col("path"), F.lit(len(_qualified(spark, root)) + 2))


def scan_files(spark: SparkSession, root: str, extensions: list[str] | None = None, hidden: bool = True) -> DataFrame:
    """``(path, ext, size, raw)`` of the files with the given extensions below ``root``.

    Plain names are listed and read by Spark's own binary source; names starting with ``_`` or
    ``.``, which it skips, come from ``hidden_files``, unless ``hidden`` is false: that way trees of
    every file system known to Spark can be read, also of those that ``hidden_files`` cannot list.
    """
    from chunkweave.sources.hidden import hidden_files

    wanted = extensions or CODE_EXTENSIONS + TEXT_EXTENSIONS
    plain = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _glob(wanted))
        .load(root)
        .select(_relative(spark, root).alias("path"), F.col("length").alias("size"), F.col("content").alias("raw"))
    )
    both = plain.unionByName(hidden_files(spark, _qualified(spark, root), wanted)) if hidden else plain
    return both.withColumn("ext", path_suffix(F.col("path"))).where(F.col("ext").isin(*wanted))


def read_sources(spark: SparkSession, root: str, extensions: list[str] | None = None, hidden: bool = True) -> DataFrame:
    """``(path, ext, content)`` of the indexed files, blank ones included."""
    return scan_files(spark, root, extensions, hidden).select("path", "ext", decode_text(F.col("raw")).alias("content"))


def non_blank(files: DataFrame) -> DataFrame:
    return files.where(~is_blank(F.col("content")))
