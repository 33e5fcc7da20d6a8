"""Registered queries: versions, catalogue, registry tables and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkweave.functions.text import glob_match, sha256
from chunkweave.functions.versions import compare_keys, requested_version, version_key, version_parts
from chunkweave.operators import catalogue as C
from chunkweave.operators import integrity as I
from chunkweave.plans import inputs as In
from chunkweave.sources.tables import key_values

# Orders stand for published versions: the status names the package, price and priority the version.
STAGES = {"1-URGENT": "rc", "2-HIGH": "beta", "3-MEDIUM": "", "4-NOT SPECIFIED": "dev", "5-LOW": "post"}


def versions(spark, folder):
    orders = In.table(spark, folder, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    stage = F.col("o_orderpriority")
    tail = (
        F.when(stage == "1-URGENT", F.concat(F.lit("-rc"), (cents % 4).cast("string")))
        .when(stage == "2-HIGH", F.concat(F.lit("-Beta-"), (cents % 3).cast("string")))
        .when(stage == "4-NOT SPECIFIED", F.lit("-dev"))
        .when(stage == "5-LOW", F.concat(F.lit("-post"), (cents % 2).cast("string")))
        .otherwise(F.lit(""))
    )
    version = F.concat((cents % 13).cast("string"), F.lit("."), (F.col("o_custkey") % 11).cast("string"), F.lit("."), (cents % 7).cast("string"), tail)
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("pkg-"), F.col("o_custkey").cast("string")).alias("name"),
        version.alias("version"),
        F.col("o_orderdate").alias("published_at"),
        (F.col("o_orderstatus") == "F").alias("yanked"),
        F.sha2(F.concat_ws("|", F.col("o_custkey"), cents % 50), 256).alias("sha256"),
        (cents % 1000).alias("size_bytes"),
        F.col("o_custkey").alias("package_id"),
    )


def pins(spark, folder):
    """Every package pinned to its first and active in its second published version."""
    return versions(spark, folder).groupBy("name").agg(
        F.min_by("version", F.struct("published_at", "id")).alias("pinned"),
        F.max_by("version", F.struct("published_at", "id")).alias("active"),
    )


def packages(spark, folder):
    customers = In.table(spark, folder, "customer")
    return customers.select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("pkg-"), F.col("c_custkey").cast("string")).alias("name")
    )


def version_order(spark, folder):
    """Position of each distinct version within the sort order of all of them."""
    distinct = versions(spark, folder).select("version").distinct()
    ordered = distinct.select("version", version_key(F.col("version")).alias("vkey"))
    part = F.element_at("vkey", -1)
    return ordered.select(
        "version",
        F.size("vkey").alias("parts"),
        part["rank"].alias("rank"),
        part["number"]["digits"].cast("bigint").alias("number"),
        F.size(part["rest"]).alias("rest"),
    )


def compare_versions(spark, folder):
    """Pinned against active version of every package."""
    both = pins(spark, folder)
    return both.select(
        "name",
        "pinned",
        "active",
        compare_keys(version_key(F.col("pinned")), version_key(F.col("active"))).alias("order"),
    )


def latest_version(spark, folder):
    return C.latest_versions(versions(spark, folder))


def package_summary(spark, folder):
    return C.package_summary(versions(spark, folder), pins(spark, folder)).select("name", "n_versions", "latest", "pinned", "active")


def package_versions(spark, folder):
    return C.package_versions(versions(spark, folder)).select("name", "version")


def version_paths(spark, folder):
    rows = versions(spark, folder).select("version").distinct()
    return rows.select("version", F.array_join(version_parts(F.col("version")), "/").alias("path"))


def resolve_versions(spark, folder):
    """One request per line item: an explicit, a latest, or no version."""
    items = In.table(spark, folder, "lineitem")
    target = (
        F.when(F.col("l_returnflag") == "A", F.lit(" Latest "))
        .when(F.col("l_returnflag") == "R", F.concat((F.col("l_partkey") % 13).cast("string"), F.lit("."), (F.col("l_suppkey") % 11).cast("string"), F.lit(".0")))
        .otherwise(F.lit(""))
    )
    requests = items.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice")).alias("request_id"),
        F.concat(F.lit("pkg-"), F.col("l_suppkey").cast("string")).alias("name"),
        target.alias("target"),
    )
    found = C.resolve(requests, versions(spark, folder), pins(spark, folder))
    return found.groupBy("name", "version", "status").agg(F.count(F.lit(1)).alias("requests"))


def prune_plan(spark, folder):
    return C.prune_plan(versions(spark, folder), pins(spark, folder), keep=2)


def set_pins(spark, folder):
    """Packages of the building segment are re-pinned to their latest version."""
    named = In.table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("pkg-"), F.col("c_custkey").cast("string")).alias("name")
    )
    changes = C.latest_versions(versions(spark, folder)).join(named, "name").select(
        "name", F.col("version").alias("pinned"), F.col("version").alias("active")
    )
    return C.set_pins(pins(spark, folder), changes).select("name", "pinned", "active")


def remove_packages(spark, folder):
    gone = packages(spark, folder).join(
        In.table(spark, folder, "customer").where("c_mktsegment = 'MACHINERY'"), F.col("id") == F.col("c_custkey")
    )
    return C.remove_packages(pins(spark, folder), gone).select("name", "pinned")


def _packets(spark, folder):
    rows = versions(spark, folder)
    return rows.select(
        F.when(F.col("size_bytes") % 3 == 0, F.col("name")).alias("descriptor_name"),
        F.when(F.col("size_bytes") % 3 == 1, F.col("name")).alias("manifest_name"),
        F.col("name").alias("dir_name"),
        F.col("version").alias("descriptor_version"),
        F.lit(None).cast("string").alias("manifest_version"),
        F.lit(None).cast("string").alias("dir_version"),
        F.when(F.col("yanked"), F.col("sha256")).alias("descriptor_description"),
        F.lit(None).cast("string").alias("manifest_description"),
        F.concat_ws("\\", F.col("name"), F.col("version"), F.format_string("%012d", F.col("id"))).alias("path"),
        F.col("size_bytes").alias("docs"),
        F.col("size_bytes").alias("vectors"),
        (F.col("size_bytes") > 10).alias("is_valid"),
    )


def lookup_latest(spark, folder):
    return C.lookup(_packets(spark, folder)).select("name", "version", "description", "path", "docs", "is_valid")


def lookup_all(spark, folder):
    return C.lookup(_packets(spark, folder), all_versions=True).select("name", "version", "description", "path", "docs", "is_valid")


def describe_version(spark, folder):
    rows = versions(spark, folder).groupBy("name", "version").agg(F.min("sha256").alias("description"))
    changes = C.latest_versions(versions(spark, folder)).withColumn("description", F.lit("current"))
    return C.describe_version(rows, changes).select("name", "version", "description")


def live_versions(spark, folder):
    shown = C.live_versions(versions(spark, folder).drop("name"), packages(spark, folder))
    return C.newest_first(shown).select("id", "name", "version", "published_at")


def publish_outcome(spark, folder):
    """Later publications against earlier ones of the same version."""
    rows = versions(spark, folder)
    current = rows.where(F.col("published_at") < F.to_timestamp(F.lit("1998-01-01")))
    incoming = rows.where(F.col("published_at") >= F.to_timestamp(F.lit("1998-01-01"))).withColumnRenamed("id", "upload_id")
    return C.publish(current, incoming).select("upload_id", "name", "version", "outcome")


def new_blobs(spark, folder):
    rows = versions(spark, folder)
    early = F.col("published_at") < F.to_timestamp(F.lit("1998-01-01"))
    return C.new_blobs(rows.where(early), rows.where(~early))


def delete_versions(spark, folder):
    rows = versions(spark, folder)
    gone = rows.where("yanked").select("name", "version")
    return C.delete_versions(rows, gone).select("id", "name", "version")


def _yanks(spark, folder):
    events = In.table(spark, folder, "events")
    return events.select(
        "event_id",
        "ts",
        F.concat(F.lit("pkg-"), F.col("user_id").cast("string")).alias("name"),
        F.get_json_object("props", "$.k").alias("version"),
        F.col("event_type").isin("error", "signup").alias("yanked"),
    )


def yank_state(spark, folder):
    return C.yank_state(_yanks(spark, folder))


def audit_report(spark, folder):
    log = In.table(spark, folder, "events").select(
        "ts", F.col("event_type").alias("action"), F.concat(F.lit("pkg-"), F.col("user_id").cast("string")).alias("package")
    )
    return C.audit_report(log)


def _providers(spark, folder):
    """Regions provide models named after their nations; one has a default model only."""
    nations = In.table(spark, folder, "nation").groupBy("n_regionkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda n: n["n_name"]).alias("models")
    )
    regions = In.table(spark, folder, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return regions.select(
        F.col("r_name").alias("provider"),
        F.when(F.col("r_name") == "AMERICA", F.array().cast("array<string>")).otherwise(F.col("models")).alias("models"),
        F.when(F.col("r_name") == "AMERICA", F.lit("default-model")).alias("default_model"),
    )


def model_choice(spark, folder):
    """A model for every part: requested, recommended, or matched by pattern."""
    parts = In.table(spark, folder, "part")
    kind = F.col("p_size") % 4
    requests = parts.select(
        F.col("p_partkey").alias("packet_id"),
        F.when(kind == 0, F.concat(F.lit("NATION_"), (F.col("p_size") % 30).cast("string"))).alias("requested"),
        F.when(kind == 1, F.concat(F.lit("NATION_"), (F.col("p_size") % 25).cast("string"))).alias("recommended"),
        F.when(kind == 2, F.array(F.lit("gpt-*"), F.concat(F.lit("*_1["), (F.col("p_size") % 9).cast("string"), F.lit("-9]"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("patterns"),
    )
    return C.choose_models(requests, _providers(spark, folder))


def glob_matches(spark, folder):
    parts = In.table(spark, folder, "part")
    pattern = F.concat(F.lit("*"), F.substring("p_type", 1, 2), F.lit("?*[A-M]*"))
    return parts.select("p_partkey", glob_match(F.concat("p_brand", "p_type"), pattern).alias("matches"))


def tree_hash(spark, folder):
    """One fingerprint per source directory, of the path and digest of every file."""
    files = In.sources(spark, folder)
    rows = files.select(F.col("source").alias("tree"), "path", sha256(F.col("content")).alias("digest"))
    return I.tree_fingerprints(rows, scheme="flat")


def tree_hash_bucketed(spark, folder):
    """The two-level scheme, in which no task sees a whole tree."""
    files = In.sources(spark, folder)
    rows = files.select(F.col("source").alias("tree"), "path", sha256(F.col("content")).alias("digest"))
    return I.tree_fingerprints(rows)


def drift_report(spark, folder):
    """Files recorded at the earlier build against those of now; scripts have gone missing."""
    now = In.sources(spark, folder)
    recorded = In.earlier(now).select("source", "path", sha256(F.col("content")).alias("digest"))
    actual = now.where(F.col("ext") != ".sh").select("source", "path", sha256(F.col("content")).alias("digest"))
    return I.artifact_drift(recorded, actual, ["source", "path"])


def plan_drift(spark, folder):
    """Recorded version plans against current ones, field by field."""
    both = pins(spark, folder)
    recorded = both.select("name", F.col("pinned").alias("version"), F.lit("default").alias("profile"), F.lit(None).cast("string").alias("retriever"))
    planned = both.select("name", F.col("active").alias("version"), F.lit("default").alias("profile"), F.lit(None).cast("string").alias("retriever"))
    return I.plan_drift(recorded, planned, ["name"], ["version", "profile", "retriever"])


def file_checksums(spark, folder):
    pages = In.table(spark, folder, "pages")
    return I.checksums(pages.select(F.concat_ws("/", F.lit("pages"), "page_id").alias("path"), F.encode("html", "UTF-8").alias("content")))


def packet_counts(spark, folder):
    """Documents per source as docs, labelled ones as vectors."""
    docs = In.table(spark, folder, "documents").withColumnRenamed("source", "packet")
    labelled = docs.join(In.table(spark, folder, "labels"), "doc_id", "left_semi")
    return I.packet_counts(docs, labelled)


def distinct_paths(spark, folder):
    """Page addresses without query or fragment, in any case, as packet paths."""
    pages = In.table(spark, folder, "pages")
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://(www\\.|m\\.)?", "")
    rows = pages.select(path.alias("path"), F.col("page_id").alias("ord"))
    return C.distinct_paths(rows).select("path_key", "path", "ord")


def descriptor_fields(spark, folder):
    """Descriptor files made of the events of a user: last value of a key wins."""
    events = In.table(spark, folder, "events")
    key = F.concat(F.col("event_type"), F.lit(": "), F.format_string('"%s"', F.get_json_object("props", "$.k")))
    text = (
        F.when(F.col("event_type") == "error", F.lit("# a comment: no field"))
        .when(F.col("event_type") == "signup", F.lit("no separator here"))
        .otherwise(key)
    )
    lines = events.select(F.col("user_id").alias("file"), F.col("event_id").alias("line_no"), text.alias("value"))
    return key_values(lines).select("file", "key", "value")


# --- SQL --------------------------------------------------------------------------------------

VERSIONS = """
WITH priced AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
versions AS (
    SELECT o_orderkey AS id, 'pkg-' || o_custkey AS name, o_custkey AS package_id, o_orderdate AS published_at, o_orderstatus = 'F' AS yanked,
           sha256(o_custkey || '|' || (cents % 50)) AS sha256, cents % 1000 AS size_bytes, cents,
           (cents % 13) AS v1, (o_custkey % 11) AS v2, (cents % 7) AS v3,
           CASE o_orderpriority WHEN '1-URGENT' THEN 40 WHEN '2-HIGH' THEN 20 WHEN '4-NOT SPECIFIED' THEN 0 WHEN '5-LOW' THEN 50 ELSE 1000 END AS rank,
           CASE o_orderpriority WHEN '1-URGENT' THEN cents % 4 WHEN '2-HIGH' THEN cents % 3 ELSE 0 END AS number,
           CASE o_orderpriority WHEN '5-LOW' THEN cents % 2 ELSE 0 END AS extra,
           CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 2 ELSE 0 END AS rest,
           (cents % 13) || '.' || (o_custkey % 11) || '.' || (cents % 7) || CASE o_orderpriority WHEN '1-URGENT' THEN '-rc' || (cents % 4)
               WHEN '2-HIGH' THEN '-Beta-' || (cents % 3) WHEN '4-NOT SPECIFIED' THEN '-dev' WHEN '5-LOW' THEN '-post' || (cents % 2) ELSE '' END AS version
    FROM priced),
keyed AS (SELECT *, [v1, v2, v3, rank, number, extra] AS vkey FROM versions),
known AS (SELECT DISTINCT name, version, vkey FROM keyed),
latest AS (SELECT name, arg_max(version, vkey) AS version FROM known GROUP BY name),
pins AS (
    SELECT name, arg_min(version, [epoch_us(published_at), id]) AS pinned, arg_max(version, [epoch_us(published_at), id]) AS active FROM versions GROUP BY name)
"""
TREE = f"WITH {In.SOURCES}, files AS (SELECT source AS tree, path, sha256(content) AS digest FROM sources)"

QUERIES = {
    "version_order": (
        version_order,
        VERSIONS + "SELECT DISTINCT version, 3 AS parts, rank, number, rest FROM keyed",
    ),
    "compare_versions": (
        compare_versions,
        VERSIONS
        + """SELECT p.name, pinned, active, CASE WHEN a.vkey < b.vkey THEN -1 WHEN a.vkey > b.vkey THEN 1 ELSE 0 END AS "order"
            FROM pins p JOIN known a ON a.name = p.name AND a.version = pinned JOIN known b ON b.name = p.name AND b.version = active""",
    ),
    "latest_version": (latest_version, VERSIONS + "SELECT * FROM latest"),
    "package_summary": (
        package_summary,
        VERSIONS
        + """SELECT name, n_versions, l.version AS latest, pinned, active FROM (SELECT name, count(*) AS n_versions FROM known GROUP BY name)
            JOIN latest l USING (name) LEFT JOIN pins USING (name)""",
    ),
    "package_versions": (package_versions, VERSIONS + "SELECT name, version FROM known"),
    "version_paths": (
        version_paths, VERSIONS + "SELECT DISTINCT version, replace(version, '.', '/') AS path FROM versions"
    ),
    "resolve_versions": (
        resolve_versions,
        VERSIONS
        + """, asked AS (
            SELECT 'pkg-' || l_suppkey AS name, CASE l_returnflag WHEN 'A' THEN 'latest'
                WHEN 'R' THEN (l_partkey % 13) || '.' || (l_suppkey % 11) || '.0' END AS asked FROM lineitem),
        joined AS (
            SELECT a.name, l.version IS NOT NULL AS installed,
                   CASE WHEN asked IS NULL THEN coalesce(pinned, l.version) WHEN asked = 'latest' THEN l.version ELSE k.version END AS version
            FROM asked a LEFT JOIN latest l ON l.name = a.name LEFT JOIN pins p ON p.name = a.name
            LEFT JOIN known k ON k.name = a.name AND k.version = a.asked)
        SELECT name, version, CASE WHEN NOT installed THEN 'no versions installed' WHEN version IS NULL THEN 'not installed' ELSE 'ok' END AS status,
               count(*) AS requests FROM joined GROUP BY ALL""",
    ),
    "prune_plan": (
        prune_plan,
        VERSIONS
        + """SELECT name, version FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY vkey DESC) AS age FROM known) k
            WHERE age > 2 AND NOT EXISTS (SELECT 1 FROM pins p WHERE p.name = k.name AND k.version IN (pinned, active))""",
    ),
    "set_pins": (
        set_pins,
        VERSIONS
        + """, named AS (SELECT 'pkg-' || c_custkey AS name FROM customer WHERE c_mktsegment = 'BUILDING')
        SELECT p.name, CASE WHEN n.name IS NULL THEN pinned ELSE l.version END AS pinned, CASE WHEN n.name IS NULL THEN active ELSE l.version END AS active
        FROM pins p LEFT JOIN named n USING (name) JOIN latest l ON l.name = p.name""",
    ),
    "remove_packages": (
        remove_packages,
        VERSIONS
        + """SELECT name, pinned FROM pins WHERE name NOT IN (SELECT 'pkg-' || c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""",
    ),
    "lookup_latest": (
        lookup_latest,
        VERSIONS
        + r""", packets AS (SELECT *, name || '/' || version || '/' || lpad(CAST(id AS VARCHAR), 12, '0') AS path FROM keyed)
        SELECT name, version, CASE WHEN yanked THEN sha256 ELSE '' END AS description, path, size_bytes AS docs, size_bytes > 10 AS is_valid
        FROM packets QUALIFY row_number() OVER (PARTITION BY name ORDER BY vkey DESC, path DESC) = 1""",
    ),
    "lookup_all": (
        lookup_all,
        VERSIONS
        + """SELECT name, version, CASE WHEN yanked THEN sha256 ELSE '' END AS description,
            name || '/' || version || '/' || lpad(CAST(id AS VARCHAR), 12, '0') AS path, size_bytes AS docs, size_bytes > 10 AS is_valid FROM versions""",
    ),
    "describe_version": (
        describe_version,
        VERSIONS
        + """SELECT v.name, v.version, CASE WHEN l.version IS NOT NULL THEN 'current' ELSE min(sha256) END AS description
            FROM versions v LEFT JOIN latest l ON l.name = v.name AND l.version = v.version GROUP BY v.name, v.version, l.version""",
    ),
    "live_versions": (
        live_versions,
        VERSIONS
        + "SELECT v.id, 'pkg-' || c_custkey AS name, version, published_at FROM versions v JOIN customer ON c_custkey = package_id WHERE NOT yanked",
    ),
    "publish_outcome": (
        publish_outcome,
        VERSIONS
        + """, old AS (SELECT DISTINCT name, version FROM versions WHERE published_at < TIMESTAMP '1998-01-01'),
        incoming AS (SELECT *, min(CASE WHEN size_bytes <> 0 THEN id END) OVER (PARTITION BY name, version) AS first_id FROM versions WHERE published_at >= TIMESTAMP '1998-01-01')
        SELECT id AS upload_id, i.name, i.version, CASE WHEN size_bytes = 0 THEN 'empty' WHEN id <> first_id THEN 'repeated'
            WHEN o.name IS NOT NULL THEN 'conflict' ELSE 'created' END AS outcome FROM incoming i LEFT JOIN old o ON o.name = i.name AND o.version = i.version""",
    ),
    "new_blobs": (
        new_blobs,
        VERSIONS
        + """SELECT sha256, min(size_bytes) AS size_bytes FROM versions WHERE published_at >= TIMESTAMP '1998-01-01'
            AND sha256 NOT IN (SELECT sha256 FROM versions WHERE published_at < TIMESTAMP '1998-01-01') GROUP BY sha256""",
    ),
    "delete_versions": (
        delete_versions,
        VERSIONS
        + "SELECT id, name, version FROM versions WHERE (name, version) NOT IN (SELECT (name, version) FROM versions WHERE yanked)",
    ),
    "yank_state": (
        yank_state,
        """SELECT 'pkg-' || user_id AS name, json_extract_string(props, '$.k') AS version,
            arg_max(event_type IN ('error', 'signup'), [epoch_us(ts), event_id]) AS yanked, count(*) AS events FROM events GROUP BY ALL""",
    ),
    "audit_report": (
        audit_report,
        """SELECT event_type AS action, 'pkg-' || user_id AS package, count(*) AS entries, min(ts) AS first_ts, max(ts) AS last_ts
            FROM events GROUP BY ALL""",
    ),
    "model_choice": (
        model_choice,
        """WITH offered AS (
            SELECT r_name AS provider, n_name AS model, n_nationkey AS pos FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'AMERICA'
            UNION ALL SELECT 'AMERICA', 'default-model', 0),
        asked AS (
            SELECT p_partkey AS packet_id, p_size % 4 AS kind, CASE p_size % 4 WHEN 0 THEN 'NATION_' || (p_size % 30) WHEN 1 THEN 'NATION_' || (p_size % 25) END AS named,
                   '^.*_1[' || (p_size % 9) || '-9]$' AS pattern FROM part),
        searched AS (
            SELECT packet_id, arg_min(model, [provider, lpad(CAST(pos AS VARCHAR), 3, '0')]) AS model, min(provider) AS provider
            FROM asked JOIN offered ON kind = 3 OR regexp_matches(model, pattern) WHERE named IS NULL GROUP BY packet_id)
        SELECT a.packet_id, coalesce(named, s.model) AS model,
               CASE WHEN named IS NOT NULL THEN coalesce(o.provider, 'AFRICA') ELSE coalesce(s.provider, 'AFRICA') END AS provider
        FROM asked a LEFT JOIN searched s USING (packet_id) LEFT JOIN (SELECT model, min(provider) AS provider FROM offered GROUP BY model) o ON o.model = named""",
    ),
    "glob_matches": (
        glob_matches,
        "SELECT p_partkey, regexp_matches(p_brand || p_type, '^.*' || substr(p_type, 1, 2) || '..*[A-M].*$') AS matches FROM part",
    ),
    "tree_hash": (
        tree_hash,
        TREE
        + """SELECT tree, count(*) AS n_files, 'flat' AS scheme, sha256(string_agg(path || ':' || digest, chr(10) ORDER BY string_split(path, '/'))) AS fingerprint
            FROM files GROUP BY tree""",
    ),
    "tree_hash_bucketed": (
        tree_hash_bucketed,
        TREE
        + """, buckets AS (SELECT tree, substr(sha256(path), 1, 3) AS bucket, count(*) AS n,
            sha256(string_agg(path || ':' || digest, chr(10) ORDER BY string_split(path, '/'))) AS h FROM files GROUP BY ALL)
        SELECT tree, CAST(sum(n) AS BIGINT) AS n_files, 'bucketed' AS scheme, sha256(string_agg(bucket || ':' || h, chr(10) ORDER BY bucket)) AS fingerprint
        FROM buckets GROUP BY tree""",
    ),
    "drift_report": (
        drift_report,
        f"""WITH {In.SOURCES}, {In.EARLIER}
        SELECT e.source, e.path, sha256(e.content) AS expected, CASE WHEN e.ext <> '.sh' THEN sha256(s.content) END AS actual,
               CASE WHEN e.ext = '.sh' THEN 'missing' ELSE 'mismatch' END AS problem
        FROM earlier e JOIN sources s USING (path) WHERE e.ext = '.sh' OR e.content <> s.content""",
    ),
    "plan_drift": (
        plan_drift,
        VERSIONS + "SELECT name, 'version' AS field, active AS expected, pinned AS got FROM pins WHERE active <> pinned",
    ),
    "file_checksums": (file_checksums, "SELECT 'pages/' || page_id AS path, sha256(html) AS digest FROM pages"),
    "packet_counts": (
        packet_counts,
        """SELECT source AS packet, count(*) AS docs, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS vectors,
            count(*) = count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS consistent FROM documents GROUP BY source""",
    ),
    "distinct_paths": (
        distinct_paths,
        r"""WITH p AS (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://(www\.|m\.)?', '') AS path, page_id FROM pages)
        SELECT lower(path) AS path_key, arg_min(path, page_id) AS path, min(page_id) AS ord FROM p GROUP BY lower(path)""",
    ),
    "descriptor_fields": (
        descriptor_fields,
        """SELECT user_id AS file, event_type AS key, arg_max(json_extract_string(props, '$.k'), event_id) AS value
            FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY ALL""",
    ),
}
