"""URL filters: a list of host and path rules, and association rules mined from labelled URLs.

A URL becomes a set of tokens (scheme, host and all its labels, all directories, file stem and extension,
all parameter names, fragment; each in full and once per URL). Tokens that stand in the same labelled URLs
are one class: each of them, and any number of them together, has the same support and confidence, so
FP-growth sees one item for all of them. Spark's FP-growth finds the combinations of classes that are frequent
among labelled URLs, the label being one more item. Combinations that predict a label with enough confidence
and support are the rules; a URL fits one if it holds a token of each of its classes, which is what all rules
over single tokens say together. They are matched by an inverted index: each rule is filed under the tokens of
its rarest class, a token set looks up its own tokens there and checks the remaining classes. Distinct token
sets are matched, not URLs, so hosts with many pages cost nothing extra.

The labels of the registered query are the list's own verdicts on the same URLs; the mined rules judge
the URLs that the list leaves open. The most confident matching rule decides, then the one with more
support, then the one with more tokens, then the one whose tokens come last; without a match the verdict is
``allow``. Of listed rules of one length the later one of the list decides.

Defined results: a null URL or one without ``://`` has an empty host and path, no token and the verdict
``allow``; repeated rows are judged alike, and each counts for the supports; with no labelled URL there are no
mined rules. A very long URL is one row with all its tokens. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.functions.arrays import rows_of
from chunkweave.llm.common import spread_join, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The list of the registered query as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.9
LABEL = "verdict="


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own_host, own_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        found = F.when(fits, F.struct(F.lit(own_host + own_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Sorted set of tokens; numbers are alike.

    ``dir`` is the first directory, ``subdir`` any deeper one; ``label`` is a host label before ``under``.
    """

    def named(kind: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(kind + "="), F.regexp_replace(value, "[0-9]+", "#")))

    def each(kind: str, values: Column) -> Column:
        return F.transform(values, lambda value: named(kind, value))

    labels, parts = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda p: p != "")
    directories = F.when(path.endswith("/"), parts).otherwise(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    file = F.regexp_extract(path, "([^/]*)$", 1)
    extension = F.regexp_extract(file, r"\.([A-Za-z0-9]+)$", 1)
    behind = F.coalesce(_rest(url), F.lit(""))
    parameters = F.split(F.regexp_extract(behind, r"^[^?#]*\?([^#]*)", 1), "&")
    single = F.array(
        named("scheme", F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]{0,30})://", 1))),
        named("host", host),
        named("tld", F.element_at(labels, -1)),
        named("site", F.when(F.size(labels) > 1, F.get(labels, F.size(labels) - 2))),
        named("under", F.when(F.size(labels) > 2, F.get(labels, F.size(labels) - 3))),
        named("dir", F.get(directories, F.lit(0))),
        named("stem", F.when(extension != "", F.regexp_replace(file, r"\.[A-Za-z0-9]+$", "")).otherwise(file)),
        named("ext", extension),
        named("fragment", F.when(behind.contains("#"), F.lit("yes"))),
    )
    every = F.concat(
        single,
        each("label", F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 3, F.lit(0)))),
        each("subdir", F.slice(directories, F.lit(2), F.size(directories))),
        each("param", F.transform(parameters, lambda p: F.regexp_extract(p, "^([^=]*)", 1))),
    )
    return F.when(url.contains("://"), F.array_sort(F.array_distinct(F.array_compact(every)))).otherwise(F.array().cast("array<string>"))


def token_classes(sets: DataFrame, min_count: int) -> DataFrame:
    """``(item, members, freq)`` from ``sets(tokens, n_rows)`` of distinct token sets: the tokens of ``min_count``
    rows or more, those of the same rows together under the smallest of them.

    Two 64-bit sums (exclusive or) over the hashes of its sets tell a token's rows apart. All members of a class
    stand in one URL, so a class is never larger than a row.
    """
    held = sets.select(F.explode(rows_of(F.col("tokens"))).alias("token"), "n_rows", F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(1), "tokens").alias("b"))
    of_token = held.groupBy("token").agg(F.sum("n_rows").alias("freq"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    together = of_token.filter(F.col("freq") >= min_count).groupBy("freq", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return together.select(F.get("members", F.lit(0)).alias("item"), "members", "freq")


def _baskets(labelled: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The label and the classes of every labelled row."""
    token_of = classes.select("item", F.explode("members").alias("token"))
    held = sets.select("tokens", F.explode(rows_of(F.col("tokens"))).alias("token")).join(token_of, "token")
    items = held.groupBy("tokens").agg(F.collect_set("item").alias("items")).withColumnRenamed("tokens", "of_tokens")
    by_set = sets.join(items, F.col("tokens") == F.col("of_tokens"), "left").select(
        "tokens", "n_rows", F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )
    rows = spread_join(labelled.select("tokens", "verdict"), stored(by_set, "url-baskets"), "tokens", "n_rows")
    return rows.select(F.concat(F.array(F.concat(F.lit(LABEL), "verdict")), "items").alias("items"))


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``(antecedent, classes, verdict, confidence, support, anchor)`` from ``labelled(tokens, verdict)``.

    ``antecedent`` holds the smallest token of each class, ``classes`` their tokens in the same order; there is a
    row for every token of the rarest class in ``anchor``. A rule is dropped if a part of its classes predicts the
    same label at least as surely.
    """
    sets = stored(labelled.groupBy("tokens").agg(F.count(F.lit(1)).alias("n_rows")), "url-sets")
    total = sets.agg(F.sum("n_rows")).first()[0] or 0
    classes = stored(token_classes(sets, math.ceil(min_support * total)), "url-classes")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(_baskets(labelled, sets, classes))
    rules = stored(
        model.associationRules.filter(F.get("consequent", F.lit(0)).startswith(LABEL)).select(
            F.array_sort("antecedent").alias("antecedent"),
            F.substring(F.get("consequent", F.lit(0)), len(LABEL) + 1, 1 << 20).alias("verdict"),
            "confidence",
            "support",
        ),
        "url-rules",
    )
    shorter = rules.select(F.col("antecedent").alias("part"), F.col("verdict").alias("part_verdict"), F.col("confidence").alias("part_confidence"))
    smaller = F.transform(
        F.col("antecedent"), lambda token: F.struct(F.array_remove(F.col("antecedent"), token).alias("less"))
    )
    longer = rules.select("antecedent", "verdict", "confidence", F.explode(rows_of(smaller)).alias("s"))
    covered = longer.join(
        shorter, (F.col("s.less") == F.col("part")) & (F.col("verdict") == F.col("part_verdict")) & (F.col("part_confidence") >= F.col("confidence")), "left_semi"
    ).select("antecedent", "verdict")
    kept = rules.join(covered.distinct(), ["antecedent", "verdict"], "left_anti")
    named = (
        kept.select("*", F.explode("antecedent").alias("item"))
        .join(classes, "item")
        .groupBy("antecedent", "verdict", "confidence", "support")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("item", "members"))), lambda c: c["members"]).alias("classes"),
            F.min_by("members", F.struct("freq", "item")).alias("rarest"),
        )
    )
    filed = named.select("antecedent", "classes", "verdict", "confidence", "support", F.explode("rarest").alias("anchor"))
    return stored(filed, "url-index")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``(tokens, mined)``: the deciding rule of each distinct token set that has one, in the set's own tokens
    (the last one of each class)."""
    looked_up = sets.select("tokens", F.explode(rows_of(F.col("tokens"))).alias("token")).join(rules, F.col("token") == F.col("anchor"))
    fitting = looked_up.filter(F.forall("classes", lambda c: F.arrays_overlap(c, F.col("tokens"))))
    own = F.array_sort(F.transform("classes", lambda c: F.array_max(F.array_intersect(c, F.col("tokens")))))
    best = F.max(F.struct("confidence", "support", F.size("classes").alias("n"), own.alias("antecedent"), "verdict"))
    return fitting.groupBy("tokens").agg(best.alias("mined"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, **levels: float) -> DataFrame:
    """``(page_id, host, path, rule, verdict, mined_rule, confidence)``, one row per page."""
    url = F.col("url")
    placed = pages.select("page_id", "url", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    known = stored(
        placed.withColumn("listed", listed(F.col("host"), F.col("path"), rules)).select(
            "page_id", "host", "path", "listed", F.coalesce(tokens_of(url, F.col("host"), F.col("path")), F.array().cast("array<string>")).alias("tokens")
        ),
        "url-pages",
    )
    mined = mined_rules(known.filter("listed IS NOT NULL").select("tokens", "listed.verdict"), **levels)
    is_open = F.count_if(F.col("listed").isNull()).alias("n_open")
    sets = stored(known.groupBy("tokens").agg(F.count(F.lit(1)).alias("n_rows"), is_open), "url-sets")
    decided = match(sets.filter("n_open > 0 AND size(tokens) > 0"), mined).withColumnRenamed("tokens", "of_tokens")
    by_set = sets.join(decided, F.col("tokens") == F.col("of_tokens"), "left").select("tokens", "n_rows", "mined")
    judged = spread_join(known, stored(by_set, "url-verdicts"), "tokens", "n_rows")
    open_page = F.col("listed").isNull()
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", "mined.verdict", F.lit("allow")).alias("verdict"),
        F.when(open_page, F.array_join("mined.antecedent", " ")).alias("mined_rule"),
        F.when(open_page, F.col("mined.confidence")).alias("confidence"),
    )
