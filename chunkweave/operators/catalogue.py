"""Package versions: ordering, resolution, pruning, publishing, yanking, model choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.functions.text import glob_ends, glob_match, strip
from chunkweave.functions.versions import requested_version, sort_text, version_key


def with_key(versions: DataFrame) -> DataFrame:
    return versions.withColumn("vkey", version_key(F.col("version")))


def with_sort_key(versions: DataFrame) -> DataFrame:
    """The rows with ``vkey``, text that sorts as their version does. A key costs far more than a join, and versions
    recur from package to package: each distinct one is keyed once."""
    keys = versions.select(F.col("version").alias("of_version")).distinct()
    keyed = keys.withColumn("vkey", sort_text(version_key(F.col("of_version"))))
    return versions.join(keyed, F.col("version").eqNullSafe(F.col("of_version")), "left").drop("of_version")


def package_versions(versions: DataFrame) -> DataFrame:
    """Distinct versions as rows. Sorting is left to the reader: ``orderBy("name", "vkey")``."""
    return with_key(versions.select("name", "version").distinct())


def package_summary(versions: DataFrame, pins: DataFrame) -> DataFrame:
    """One row per package: number of versions, latest, pinned and active version."""
    per_package = with_sort_key(versions.select("name", "version").distinct()).groupBy("name").agg(
        F.count(F.lit(1)).alias("n_versions"), F.max_by("version", "vkey").alias("latest")
    )
    return per_package.join(pins, "name", "left")


def latest_versions(versions: DataFrame) -> DataFrame:
    """``max_by`` combines per task, so a package with very many versions is no hot spot. A task sorts its rows
    for that, so they carry the key as short text."""
    keyed = with_sort_key(versions.select("name", "version"))
    return keyed.groupBy("name").agg(F.max_by("version", "vkey").alias("version"))


def parse_spec(spec: Column) -> tuple[Column, Column]:
    """``name@version`` to its two parts, version null where absent."""
    parts = F.split(spec, "@", 2)
    version = F.when(F.contains(spec, F.lit("@")), strip(F.get(parts, F.lit(1))))
    return strip(F.get(parts, F.lit(0))), F.when(version != "", version)


def resolve(requests: DataFrame, versions: DataFrame, pins: DataFrame) -> DataFrame:
    """``requests(request_id, name, target)`` to the version each one means, and its status.

    An explicit version must exist; ``latest`` is the highest; no target means the pinned version
    if it is installed, else the highest. Each distinct question is answered once (no key of those
    is hot, however often it is asked) and the requests are joined to the answers.
    """
    asked = requests.withColumn("asked", requested_version(F.col("target")))
    questions = asked.select("name", "asked").distinct()
    known = versions.select("name", "version").distinct()
    pinned = pins.select("name", F.col("pinned").alias("version")).join(known, ["name", "version"], "left_semi")
    per_name = (
        latest_versions(versions)
        .withColumnRenamed("version", "latest")
        .join(pinned.withColumnRenamed("version", "pin"), "name", "left")
    )
    exact = known.withColumnRenamed("version", "asked").withColumn("exists", F.lit(True))
    joined = questions.join(per_name, "name", "left").join(exact, ["name", "asked"], "left")
    resolved = (
        F.when(F.col("asked").isNull(), F.coalesce("pin", "latest"))
        .when(F.col("asked") == "latest", F.col("latest"))
        .when(F.col("exists"), F.col("asked"))
    )
    answers = joined.select(
        F.col("name").alias("of_name"),
        F.col("asked").alias("of_asked"),
        resolved.alias("version"),
        F.when(F.col("latest").isNull(), F.lit("no versions installed"))
        .when(resolved.isNull(), F.lit("not installed"))
        .otherwise(F.lit("ok"))
        .alias("status"),
    )
    same = F.col("name").eqNullSafe(F.col("of_name")) & F.col("asked").eqNullSafe(F.col("of_asked"))
    return asked.join(answers, same, "left").select("request_id", "name", "version", "status")


def prune_plan(versions: DataFrame, pins: DataFrame, keep: int = 1) -> DataFrame:
    """Versions to remove: all but the newest ``keep`` and the pinned and active ones.

    The kept set is found with a group limit that runs before the shuffle, then subtracted.
    """
    if keep < 1:
        raise ValueError("keep must be >= 1")
    known = versions.select("name", "version").distinct()
    newest = (
        with_sort_key(known).withColumn("age", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("vkey"), F.desc("version"))))
        .where(F.col("age") <= keep)
        .select("name", "version")
    )
    held = pins.select("name", F.explode(F.array_compact(F.array("pinned", "active"))).alias("version"))
    return known.join(newest.unionByName(held).distinct(), ["name", "version"], "left_anti")


def set_pins(pins: DataFrame, changes: DataFrame) -> DataFrame:
    """The pins table after ``changes(name, pinned, active)``; packages not named, and fields a change
    leaves null, stay as they are."""
    new = changes.select("name", F.col("pinned").alias("new_pinned"), F.col("active").alias("new_active"))
    return pins.join(new, "name", "full_outer").select(
        "name", F.coalesce("new_pinned", "pinned").alias("pinned"), F.coalesce("new_active", "active").alias("active")
    )


def remove_packages(table: DataFrame, names: DataFrame) -> DataFrame:
    return table.join(names.select("name"), "name", "left_anti")


def distinct_paths(paths: DataFrame) -> DataFrame:
    """Paths equal but for case count once; the first one listed stands."""
    return paths.groupBy(F.lower("path").alias("path_key")).agg(F.min_by("path", "ord").alias("path"), F.min("ord").alias("ord"))


def lookup(packets: DataFrame, all_versions: bool = False) -> DataFrame:
    """Catalogue entries, the latest per package or all, with sizes and completeness.

    Descriptor fields win over manifest fields, and these over directory names.
    """
    described = packets.select(
        F.coalesce("descriptor_name", "manifest_name", "dir_name").alias("name"),
        F.coalesce("descriptor_version", "manifest_version", "dir_version").alias("version"),
        F.coalesce("descriptor_description", "manifest_description", F.lit("")).alias("description"),
        F.replace("path", F.lit("\\"), F.lit("/")).alias("path"),
        "docs",
        "vectors",
        "is_valid",
    )
    if all_versions:
        return described
    entry = F.struct(*[c for c in described.columns if c != "name"])
    return (
        described.withColumn("vkey", sort_text(version_key(F.col("version"))))
        .groupBy("name")
        .agg(F.max_by(entry, F.struct("vkey", "path")).alias("entry"))
        .select("name", "entry.*")
    )


def describe_version(catalogue: DataFrame, changes: DataFrame) -> DataFrame:
    """The catalogue with new descriptions for the versions named in ``changes``."""
    new = changes.select("name", "version", F.col("description").alias("new_description"))
    return catalogue.join(new, ["name", "version"], "left").withColumn(
        "description", F.coalesce("new_description", "description")
    ).drop("new_description")


def live_versions(versions: DataFrame, packages: DataFrame, include_yanked: bool = False) -> DataFrame:
    """Versions with their package name; yanked ones are hidden unless asked for."""
    shown = versions if include_yanked else versions.where(~F.col("yanked"))
    return shown.join(packages.select(F.col("id").alias("package_id"), "name"), "package_id")


def newest_first(versions: DataFrame) -> DataFrame:
    return versions.orderBy(F.desc("published_at"), F.desc("id"))


def publish(current: DataFrame, incoming: DataFrame, overwrite: bool = False) -> DataFrame:
    """Outcome per incoming version: ``created``, ``replaced``, ``conflict``, ``empty`` or ``repeated``.

    A conflict is any existing row of the same name and version, yanked or not. Of several incoming
    rows for one version the first that is not empty counts; an empty one is refused and changes nothing.
    """
    known = current.select("name", "version").distinct().withColumn("exists", F.lit(True))
    filled = F.when(F.coalesce(F.col("size_bytes") != 0, F.lit(True)), F.col("upload_id"))
    first = incoming.groupBy("name", "version").agg(F.min(filled).alias("first_id"))
    marked = incoming.join(first.join(known, ["name", "version"], "left"), ["name", "version"])
    return marked.withColumn(
        "outcome",
        F.when(F.col("size_bytes") == 0, F.lit("empty"))
        .when(F.col("upload_id") != F.col("first_id"), F.lit("repeated"))
        .when(F.col("exists") & F.lit(not overwrite), F.lit("conflict"))
        .when(F.col("exists"), F.lit("replaced"))
        .otherwise(F.lit("created")),
    ).drop("first_id", "exists")


def published(current: DataFrame, incoming: DataFrame, overwrite: bool = False) -> DataFrame:
    """The versions table after publishing: accepted rows are added, those they replace leave."""
    outcome = publish(current, incoming, overwrite)
    accepted = outcome.where(F.col("outcome").isin("created", "replaced")).withColumnRenamed("upload_id", "id")
    # Only an overwriting upload replaces rows; all others that are accepted are of versions not there yet.
    kept = current.join(accepted.select("name", "version"), ["name", "version"], "left_anti") if overwrite else current
    return kept.select(*current.columns).unionByName(accepted.select(*current.columns))


def use(pins: DataFrame, specs: DataFrame, versions: DataFrame) -> DataFrame:
    """The pins table after ``specs(spec)`` of ``name@version`` (no version: the pinned or the latest one)
    were made active. What is not installed changes nothing."""
    name, target = parse_spec(F.col("spec"))
    found = resolve(specs.select(F.col("spec").alias("request_id"), name.alias("name"), target.alias("target")), versions, pins)
    chosen = found.where("status = 'ok'").groupBy("name").agg(F.max_by("version", "request_id").alias("active"))
    return set_pins(pins, chosen.select("name", F.lit(None).cast("string").alias("pinned"), "active"))


def new_blobs(stored: DataFrame, accepted: DataFrame) -> DataFrame:
    """Content to upload: one row per fingerprint not stored yet."""
    return (
        accepted.groupBy("sha256")
        .agg(F.min("size_bytes").alias("size_bytes"))
        .join(stored.select("sha256").distinct(), "sha256", "left_anti")
    )


def delete_versions(versions: DataFrame, gone: DataFrame) -> DataFrame:
    return versions.join(gone.select("name", "version"), ["name", "version"], "left_anti")


def yank_state(events: DataFrame) -> DataFrame:
    """Whether each version is yanked now: its last event decides, the later id on equal times."""
    return events.groupBy("name", "version").agg(
        F.max_by("yanked", F.struct("ts", "event_id")).alias("yanked"), F.count(F.lit(1)).alias("events")
    )


def audit_report(log: DataFrame) -> DataFrame:
    return log.groupBy("action", "package").agg(
        F.count(F.lit(1)).alias("entries"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


KEY_LENGTH = 16  # code points of a pattern's literal end that choose the values it is tried on


def glob_pairs(values: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(pattern, value, ...)`` for every match of ``patterns(pattern)`` on ``values(value, ...)``; both distinct.

    A pattern is filed under its literal beginning or its literal end, whichever is longer, and a value
    looks under each of its own beginnings and ends, so a pattern meets only values that share that text.
    The keys are cut at ``KEY_LENGTH``, which bounds the rows of a long value; the whole pattern decides.
    Patterns without such text (``*x*``) meet every distinct value. Null matches nothing.
    """
    head, tail = glob_ends(F.col("pattern"))
    by_tail = F.length(tail) > F.length(head)
    filed = patterns.where("pattern IS NOT NULL").select(
        "pattern",
        by_tail.alias("at_end"),
        F.when(by_tail, F.right(tail, F.lit(KEY_LENGTH))).otherwise(F.left(head, F.lit(KEY_LENGTH))).alias("key"),
    )
    lengths = F.sequence(F.lit(0), F.least(F.length("value"), F.lit(KEY_LENGTH)))
    begins = F.transform(lengths, lambda n: F.struct(F.lit(False).alias("at_end"), F.left("value", n).alias("key")))
    ends = F.transform(F.filter(lengths, lambda n: n > 0), lambda n: F.struct(F.lit(True).alias("at_end"), F.right("value", n).alias("key")))
    looked = values.where("value IS NOT NULL").select("*", F.inline(F.concat(begins, ends)))
    return filed.join(looked, ["at_end", "key"]).where(glob_match(F.col("value"), F.col("pattern"))).drop("at_end", "key")


def choose_models(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """Requested model, else the recommended one, else the first supported; and who provides it.

    ``requests(packet_id, requested, recommended, patterns)``, ``providers(provider, models,
    default_model)``. A model nobody lists goes to the first provider by name; a default model is
    searched only where a provider lists no models. Of the supported models the first one of the first
    provider counts; an empty list supports all, a null list none. Distinct patterns meet distinct
    models (``glob_pairs``) and lists take the least of what their patterns found, so no row holds all
    offers; only one row, the first offer and the first provider, is sent to the tasks.
    """
    default = F.when(F.col("default_model").isNotNull() & (F.col("default_model") != ""), F.array("default_model"))
    own = F.filter(F.coalesce("models", F.array().cast("array<string>")), lambda m: m.isNotNull())
    none = F.array().cast("array<string>")
    named_by = providers.select("provider", own.alias("own"), F.coalesce(default, none).alias("fallback"))
    offers = (
        named_by.select("provider", F.explode(F.concat("own", "fallback")).alias("offered"))
        .groupBy("offered")
        .agg(F.min("provider").alias("offered_by"))
    )
    searched = (
        named_by.select("provider", F.posexplode(F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("fallback"))).alias("at", "value"))
        .groupBy("value")
        .agg(F.min(F.struct("provider", "at", F.col("value").alias("model"))).alias("offer"))
    )
    everywhere = searched.agg(F.min("offer").alias("first_offer")).join(F.broadcast(providers.agg(F.min("provider").alias("first_provider"))))
    named = F.coalesce("requested", "recommended")
    lists = requests.where(named.isNull() & (F.size("patterns") > 0)).select("patterns").distinct()
    of_lists = lists.select("patterns", F.explode(F.array_distinct("patterns")).alias("pattern"))
    found = glob_pairs(searched, of_lists.select("pattern").distinct()).groupBy("pattern").agg(F.min("offer").alias("offer"))
    matched = of_lists.join(found, "pattern").groupBy(F.col("patterns").alias("of_patterns")).agg(F.min("offer").alias("best"))
    asked = requests.withColumn("named", named).join(F.broadcast(everywhere))
    both = asked.join(offers, F.col("named") == F.col("offered"), "left").join(
        matched, F.col("named").isNull() & (F.col("patterns") == F.col("of_patterns")), "left"
    )
    best = F.when(F.size("patterns") == 0, F.col("first_offer")).otherwise(F.col("best"))
    return both.select(
        "packet_id",
        F.coalesce("named", best["model"]).alias("model"),
        F.when(F.col("named").isNotNull(), F.coalesce("offered_by", "first_provider"))
        .otherwise(F.coalesce(best["provider"], "first_provider"))
        .alias("provider"),
    )
