"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from chunkweave.llm import license_scans, mixing, quality_rules, secret_scans, target_resampling, zone_clusters


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any_case(pattern: str) -> str:
    """``(?i:...)`` spelled out: RE2 also folds letters beyond ASCII."""
    start = pattern.index("(?i:") + 4
    end = pattern.index("))", start) + 1
    spelled = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern[start:end])
    return pattern[: start - 4] + spelled + pattern[end + 1 :]


def _spans(pattern: str) -> str:
    """List of ``(s, e, t)`` structs of the matches in ``body``."""
    p = _quoted(pattern)
    found = f"regexp_extract_all(body, {p})"
    gaps = f"list_transform(string_split_regex(body, {p}), lambda g: length(g))"
    return (
        f"list_transform({found}, lambda m, i: {{"
        f"'s': CAST(list_sum({gaps}[1:i]) + coalesce(list_sum(list_transform({found}[1:i-1], lambda x: length(x))), 0) AS INTEGER), 't': m}})"
    )


def _secret_scans() -> str:
    assign, ident = _any_case(secret_scans.ASSIGN), _any_case(secret_scans.IDENT)
    found = {
        "assign": (assign, f"length(regexp_extract(m.t, {_quoted(assign)}, 2)) >= {secret_scans.MIN_SECRET}"),
        "access": (secret_scans.ACCESS, "true"),
        "hex": (secret_scans.HEX, "true"),
        "ident": (ident, "true"),
        "weak": (
            secret_scans.WEAK,
            "regexp_matches(m.t, '[a-z]') AND regexp_matches(m.t, '[A-Z]') AND regexp_matches(m.t, '[0-9]')",
        ),
        "endpoint": (secret_scans.ENDPOINT, "true"),
        "break": (secret_scans.SCOPE_BREAK, "true"),
    }
    parts = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {number} AS number, m.s AS s, CAST(m.s + length(m.t) AS INTEGER) AS e FROM "
        f"(SELECT doc_id, unnest({_spans(pattern)}) AS m FROM d WHERE regexp_matches(body, {_quoted(pattern)})) WHERE {keep}"
        for number, (kind, (pattern, keep)) in enumerate(found.items(), 1)
    )

    def scoped(a: str, b: str) -> str:
        return f"{a}.doc_id = {b}.doc_id AND {a}.scope = {b}.scope"

    def overlapping(a: str, b: str) -> str:
        return f"{scoped(a, b)} AND {b}.s < {a}.e AND {a}.s < {b}.e"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
p AS ({parts}),
q AS (SELECT *, sum(CASE WHEN kind = 'break' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS scope FROM p),
free AS (SELECT * FROM q w WHERE kind = 'weak' AND NOT EXISTS (
    SELECT 1 FROM q b WHERE b.kind IN ('assign', 'access', 'hex') AND {overlapping('w', 'b')})),
placed AS (SELECT * FROM q i WHERE kind = 'ident' AND EXISTS (
    SELECT 1 FROM q o WHERE o.kind = 'endpoint' AND {scoped('i', 'o')})),
confirmed AS (SELECT * FROM free w WHERE EXISTS (
    SELECT 1 FROM (SELECT * FROM q WHERE kind = 'access' UNION ALL SELECT * FROM placed) o WHERE {scoped('w', 'o')})),
named AS (SELECT * FROM placed i WHERE EXISTS (
    SELECT 1 FROM (SELECT * FROM q WHERE kind IN ('assign', 'hex') UNION ALL SELECT * FROM free) o WHERE {scoped('i', 'o')})),
kept AS (SELECT *, kind || ':' || s || ':' || e AS label FROM q WHERE kind IN ('assign', 'access', 'hex')
         UNION ALL SELECT *, kind || ':' || s || ':' || e FROM confirmed
         UNION ALL SELECT *, kind || ':' || s || ':' || e FROM named),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
               count(*) FILTER (kind = 'hex') AS n_hex,
               string_agg(label, ',' ORDER BY s, number) FILTER (number <= 3) AS base,
               string_agg(label, ',' ORDER BY s, number) AS spans
        FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
"""


SECRET_SCANS = _secret_scans()


def _quality_rules() -> str:
    q = quality_rules
    grid = ", ".join(
        f"({_quoted(rule)}, {i}, CAST({c} AS DOUBLE))" for rule, values in q.CUTOFFS.items() for i, c in enumerate(values, 1)
    )
    share = q.ALPHA / len(q.CUTOFFS)
    rules = "UNION ALL ".join(f"SELECT doc_id, {_quoted(r)} AS rule, {r} AS value FROM m " for r in q.CUTOFFS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, stratum, body, list_filter(string_split_regex(body, '{q.SPACES}'), lambda x: x <> '') AS words,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{q.WORD}')) AS lines FROM d),
wins AS (SELECT doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win, i
       FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
          SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1)
        GROUP BY doc_id),
c AS (SELECT doc_id, stratum, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(regexp_replace(body, '{q.SYMBOLS}', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words,
             length(array_to_string(regexp_extract_all(body, '\\p{{Lu}}{{3,}}'), '')) AS n_shouted,
             length(array_to_string(regexp_extract_all(body, '[!?]{{2,}}'), '')) AS n_marks
      FROM w LEFT JOIN rep USING (doc_id)),
m AS (SELECT *, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
             CASE WHEN word_chars > 0 THEN n_shouted / word_chars ELSE 0 END AS shout_ratio,
             CASE WHEN n_words > 0 THEN n_marks / n_words ELSE 0 END AS mark_ratio,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
             CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_ratio,
             CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length,
             n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c),
lm AS ({rules}),
lab AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality)),
grid(rule, step, cutoff) AS (VALUES {grid}),
held AS (SELECT stratum, lm.rule, value, good FROM lm JOIN lab USING (doc_id) JOIN d USING (doc_id)),
ns AS (SELECT count(DISTINCT stratum) AS n FROM held),
t AS (SELECT stratum, rule, step, cutoff, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad,
             count(*) FILTER (good AND value > cutoff) AS k_good, count(*) FILTER (NOT good AND value > cutoff) AS k_bad
      FROM held JOIN grid USING (rule) GROUP BY ALL),
-- ln P(Binomial(n, share) <= k) from the logarithms of the terms
p AS (SELECT *, CASE WHEN k_good >= {share!r} * n_good THEN 0 ELSE
         (SELECT max(l) + ln(sum(exp(l - mx))) FROM (SELECT l, max(l) OVER () AS mx FROM (
            SELECT lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({share!r}) + (n_good - i) * ln(1 - {share!r}) AS l
            FROM (SELECT unnest(range(0, k_good + 1)) AS i)))) END AS tail FROM t),
ok AS (SELECT p.*, min(CASE WHEN tail <= ln({q.DELTA} / (ns.n * {len(q.CUTOFFS)})) AND k_good < {share!r} * n_good THEN 1 ELSE 0 END)
              OVER (PARTITION BY stratum, rule ORDER BY step) AS so_far,
              k_bad / greatest(n_bad, 1) - {q.GOOD_COST} * k_good / greatest(n_good, 1) AS gain FROM p, ns),
cut AS (SELECT stratum, rule, cutoff FROM ok WHERE so_far = 1 AND gain > 0
        QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, step) = 1),
bad AS (SELECT DISTINCT doc_id FROM lm JOIN d USING (doc_id) JOIN cut USING (stratum, rule) WHERE value > cutoff)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.doc_id IS NULL AS kept
FROM m LEFT JOIN bad ON m.doc_id = bad.doc_id
"""


QUALITY_RULES = _quality_rules()


#: Five-gram sets, exact links and their components by brute force.
NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
             ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')))) END AS grams
      FROM w),
c AS (SELECT grams, min(doc_id) AS rep, count(*) AS copies FROM g WHERE len(grams) > 0 GROUP BY grams),
x AS (SELECT rep, copies, len(grams) AS n, unnest(grams) AS gram FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(b.copies) AS copies FROM x a JOIN x b ON a.gram = b.gram AND a.rep <> b.rep
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
k AS (SELECT rep, copies - 1 + coalesce((SELECT sum(copies) FROM p WHERE a = rep), 0) AS n_links,
             least(rep, coalesce((SELECT min(b) FROM r WHERE a = rep), rep)) AS class_id FROM c)
SELECT g.doc_id, coalesce(k.class_id, g.doc_id) AS class_id, coalesce(k.rep, g.doc_id) AS copy_id, coalesce(CAST(k.n_links AS BIGINT), 0) AS n_links
FROM g LEFT JOIN c USING (grams) LEFT JOIN k ON k.rep = c.rep
"""


def mixing_ctes(documents: str, share_percent: int, max_epochs: int) -> str:
    """CTEs that end in ``taken(doc_id, domain, lang, source, tokens, epochs)``."""

    def weight(level: str) -> str:
        named = mixing.WEIGHTS.get(level, {})
        return "CASE " + level + "".join(f" WHEN {_quoted(n)} THEN {w}" for n, w in named.items()) + " ELSE 1 END" if named else "1"

    def shared(name: str, level: str, parents: str, parent: list[str]) -> str:
        keys = ", ".join(parent)
        by = f"PARTITION BY {keys}" if parent else ""
        own = ", ".join([*parent, level])
        source = f"JOIN {parents} USING ({keys})" if parent else f"CROSS JOIN {parents}"
        return f"""
{name}_c AS (SELECT {own}, CAST(sum(capacity) AS HUGEINT) AS capacity, CAST({weight(level)} AS HUGEINT) AS weight FROM leaf GROUP BY {own}),
{name}_r AS (SELECT c.*, given, sum(capacity) OVER o - capacity AS used, sum(weight) OVER s - sum(weight) OVER o + weight AS rest
    FROM {name}_c c {source}
    WINDOW s AS ({by}), o AS ({by} ORDER BY CAST(capacity AS DOUBLE) / CAST(weight AS DOUBLE), {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name}_f AS (SELECT *, capacity * rest <= weight * (given - used) AS filled FROM {name}_r),
{name} AS (SELECT {own}, CASE WHEN filled THEN capacity ELSE
        (given - coalesce(sum(capacity) FILTER (filled) OVER ({by}), 0)) * weight // sum(weight) FILTER (NOT filled) OVER ({by}) END AS given
    FROM {name}_f)"""

    return f"""
measured AS (SELECT doc_id, 'd' || CAST(coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4, 0) AS VARCHAR) AS domain,
        coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        coalesce(len(list_filter(string_split_regex(text, '{mixing.SPACES}'), lambda w: w <> '')), 0) AS tokens FROM {documents}),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS tokens, CAST(sum(tokens) * {max_epochs} AS HUGEINT) AS capacity
         FROM measured WHERE tokens > 0 GROUP BY ALL),
whole_tree AS (SELECT CAST(least(sum(capacity), sum(tokens) * {share_percent} // 100) AS HUGEINT) AS given FROM leaf),
{shared('by_domain', 'domain', 'whole_tree', [])},
{shared('by_lang', 'lang', 'by_domain', ['domain'])},
{shared('by_source', 'source', 'by_lang', ['domain', 'lang'])},
plan AS (SELECT domain, lang, source, given // tokens AS whole, given % tokens AS part FROM by_source JOIN leaf USING (domain, lang, source)),
placed AS (SELECT m.*, whole, part, md5('{mixing.SEED}:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
           FROM measured m JOIN plan USING (domain, lang, source) WHERE m.tokens > 0),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) AS running FROM placed),
taken AS (SELECT doc_id, domain, lang, source, tokens, CAST(whole + CASE WHEN running <= part THEN 1 ELSE 0 END AS INTEGER) AS epochs
          FROM run WHERE whole > 0 OR running <= part)"""


MIXING = f"""
WITH {mixing_ctes('documents', mixing.SHARE_PERCENT, mixing.MAX_EPOCHS)}
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS n_tokens, epochs FROM taken
"""


EXACT_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, o.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.c, o.c), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
      FROM v q JOIN v o ON o.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


def _license_scans() -> str:
    li = license_scans
    names = ", ".join(f"({_quoted(li.normal_text(s))}, {_quoted(n)})" for n, s in li.SENTENCES.items())
    ordered = sorted(enumerate(li.RULES), key=lambda r: (-len(r[1][1]), r[0]))

    def units(separator: str) -> str:
        p = _quoted(separator)
        return f"""SELECT doc_id, i, unit, CAST(list_sum(lens[1:i-1]) + 0 AS INTEGER) AS before FROM (
            SELECT doc_id, unnest(range(1, len(u) + 1)) AS i, unnest(u) AS unit,
                   list_transform(u, lambda x, j: length(x) + coalesce(length(s[j]), 0)) AS lens
            FROM (SELECT doc_id, string_split_regex(text, {p}) AS u, regexp_extract_all(text, {p}) AS s FROM hinted))"""

    steps = [
        f"r{i + 1} AS (SELECT doc_id, regexp_extract_all(rest, {_quoted(li._pattern(ids))}) AS found, regexp_replace(rest, {_quoted(li._pattern(ids))}, '', 'g') AS rest FROM r{i})"
        for i, (_, (_, ids)) in enumerate(ordered)
    ]
    found = " UNION ALL ".join(
        [f"SELECT doc_id, {_quoted(name)} AS license, unnest(found) AS m FROM r{i + 1}" for i, (_, (name, _)) in enumerate(ordered)]
        + [f"SELECT doc_id, 'unknown', unnest(regexp_extract_all(rest, ' [^ :]+:\\d+:\\d+')) FROM r{len(ordered)}"]
    )
    return f"""
WITH known(sentence, id) AS (VALUES {names}),
hinted AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, {_quoted(li.ANCHORS)})),
u AS ({units(li.LINE_BREAK)} UNION ALL {units(li.SENTENCE_BREAK)}),
k AS (SELECT doc_id, id, coalesce(before, 0) AS s, max(coalesce(before, 0) + length(unit)) AS e FROM u
      JOIN known ON sentence = trim(regexp_replace(translate(unit, '{li.UPPER}', '{li.LOWER}'), '[^a-z0-9]+', ' ', 'g')) GROUP BY ALL),
r0 AS (SELECT doc_id, string_agg(' ' || id || ':' || s || ':' || e, '' ORDER BY s, id) AS rest FROM k GROUP BY doc_id),
{', '.join(steps)}
SELECT doc_id, license, CAST(regexp_extract(m, '^ [^ :]+:(\\d+):', 1) AS INTEGER) AS start, CAST(regexp_extract(m, ':(\\d+)$', 1) AS INTEGER) AS "end",
       regexp_replace(trim(m), ':\\d+:\\d+', '', 'g') AS sentences
FROM ({found})
"""


LICENSE_SCANS = _license_scans()


def _zone_clusters() -> str:
    z = zone_clusters
    rounds = ""
    for i in range(z.ROUNDS + 1):
        rounds += f"""
a{i} AS MATERIALIZED (SELECT rid, k, d FROM (
        SELECT rid, k, CAST(list_sum(list_transform(list_zip(v.c, z.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i} z)
    QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)"""
        if i < z.ROUNDS:
            rounds += f""",
m{i} AS (SELECT k, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
         FROM (SELECT k, unnest(c) AS x, unnest(range({z.DIMS})) AS pos FROM a{i} JOIN v USING (rid)) GROUP BY k, pos),
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(n.c, o.c) AS c FROM c{i} o
    LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM m{i} GROUP BY k) n USING (k)),"""
    last = z.ROUNDS
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
                 list_transform(embedding, lambda x: CAST(floor({z.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) = {z.DIMS}
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, c) - 1 AS k, c FROM (
        SELECT sha256('{z.SEED}:' || CAST(vec_id AS VARCHAR)) AS h, c FROM v WHERE vec_id IS NOT NULL ORDER BY h, c LIMIT {z.CLUSTERS})),{rounds}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{last}.c, ',')) AS centroid_sha256
FROM a{last} JOIN v USING (rid) JOIN c{last} USING (k)
"""


ZONE_CLUSTERS = _zone_clusters()


def _resampling() -> str:
    r = target_resampling
    # CRC-32 byte by byte, with the table of its polynomial worked out by eight shifts for each byte value
    shifts = "list_reduce([CAST(i AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS UBIGINT)) ELSE a >> 1 END)"
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, {shifts} AS c FROM range(256) g(i))),
dw AS (SELECT doc_id, rid, unnest(words) AS word FROM (SELECT doc_id, row_number() OVER () AS rid, {words} AS words FROM documents)),
bw AS (SELECT unnest({words}) AS word FROM benchmark),
b AS MATERIALIZED (SELECT word, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT),
          list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS UBIGINT))),
          lambda a, x: xor(a >> 8, tab[CAST(xor(a, x) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % {r.BUCKETS} AS INTEGER) AS bucket
      FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)), tab),
dc AS (SELECT bucket, count(*) AS n FROM dw JOIN b USING (word) GROUP BY bucket),
bc AS (SELECT bucket, count(*) AS n FROM bw JOIN b USING (word) GROUP BY bucket),
g AS (SELECT i AS bucket, CAST(floor(1000 * ln(CAST(coalesce(bc.n, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM dc) + {r.BUCKETS} AS DOUBLE)
          / (CAST(coalesce(dc.n, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM bc) + {r.BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
      FROM range({r.BUCKETS}) x(i) LEFT JOIN dc ON dc.bucket = i LEFT JOIN bc ON bc.bucket = i),
w AS (SELECT rid, count(*) AS n, sum(gain) AS weight FROM dw JOIN b USING (word) JOIN g USING (bucket) GROUP BY rid),
s AS (SELECT doc_id, coalesce(w.n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
             CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{r.SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM (SELECT doc_id, row_number() OVER () AS rid FROM documents) LEFT JOIN w USING (rid)),
e AS (SELECT *, n_features >= {r.MIN_WORDS} AND doc_id IS NOT NULL AS eligible FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id, n_features) AS place, sum(CASE WHEN eligible THEN 1 ELSE 0 END) OVER () AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= {r.DRAW_PERCENT} * n // 100 THEN place END AS rank FROM o
"""


RESAMPLING = _resampling()
