"""SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from . import secrets, urls

WORDS = r"regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: Smallest node that links lead to, by walking from every node.
WALK = """walk(node, seen) AS (
  SELECT node, node FROM nodes
  UNION
  SELECT w.node, e.b FROM walk w JOIN edges e ON e.a = w.seen),
least AS (SELECT node, MIN(seen) AS component FROM walk GROUP BY node)"""

OP3 = """
WITH d AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, s, hash(substr(h, 2 * s - 1, 100)) AS g
           FROM (SELECT doc_id, h, UNNEST(range(1, length(h) // 2 - 48)) AS s FROM d WHERE length(h) >= 100)),
firsts AS (SELECT g, MIN(doc_id) AS m FROM starts GROUP BY g HAVING MIN(doc_id) <> MAX(doc_id)),
hits AS (SELECT doc_id, s FROM starts JOIN firsts USING (g) WHERE m < doc_id),
runs AS (SELECT doc_id, s, SUM(opens) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM (
         SELECT doc_id, s, CASE WHEN s <= LAG(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS opens FROM hits)),
spans AS (SELECT doc_id, r, MIN(s) AS a, MAX(s) + 50 AS b FROM runs GROUP BY doc_id, r),
gaps AS (SELECT doc_id, a, b, COALESCE(LAG(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS z FROM spans),
kept AS (SELECT doc_id, SUM(b - a) AS n_removed, COUNT(*) AS n_spans, MAX(b) AS z,
         string_agg(substr(h, 2 * z - 1, 2 * (a - z)), '' ORDER BY a) AS rest FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(COALESCE(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN rest IS NULL THEN h ELSE rest || substr(h, 2 * z - 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
      FROM (SELECT doc_id, w, UNNEST(range(1, GREATEST(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
edges AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
nodes AS (SELECT DISTINCT a AS node FROM edges), {WALK}
SELECT d.doc_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_shingles, COALESCE(component, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.node = d.doc_id"""


def _op7() -> str:
    def quoted(pattern):
        return "'" + pattern.replace("'", "''") + "'"
    parts = [f"""SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, {r.min_length} AS least,
        UNNEST(regexp_split_to_array(t, {quoted(r.pattern)})) AS piece, UNNEST(regexp_extract_all(t, {quoted(r.pattern)})) AS m,
        UNNEST(regexp_extract_all(t, {quoted(r.pattern)}, {r.group})) AS g,
        UNNEST(range(1, len(regexp_split_to_array(t, {quoted(r.pattern)})) + 1)) AS i FROM d""" for i, r in enumerate(secrets.RULES)]
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE_RULES)
    counts = ", ".join(f"CAST(COUNT(*) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in secrets.BASE_RULES)
    told = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)"
    return f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
cut AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT *, SUM(length(piece) + length(COALESCE(m, ''))) OVER (PARTITION BY doc_id, rank ORDER BY i) AS e FROM cut),
spans AS (SELECT doc_id, rank, kind, CAST(e AS BIGINT) AS e, CAST(e - length(m) AS BIGINT) AS s FROM placed WHERE m IS NOT NULL AND length(g) >= least),
told AS (SELECT doc_id, {counts}, {told} FILTER (kind IN ({base})) AS base, {told} AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'COALESCE(n_{r.kind}, 0) AS n_{r.kind}' for r in secrets.BASE_RULES)},
       sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans FROM d LEFT JOIN told USING (doc_id)"""


def _op9() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
    return rf"""
WITH RECURSIVE rules(rh, rp, v) AS (VALUES {rules}),
u AS (SELECT page_id, url, html,
      translate(COALESCE(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      COALESCE(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
k AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(?:80|443)$', '')
        || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '')
        || COALESCE('?' || array_to_string(NULLIF(list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
             lambda p: p <> '' AND NOT regexp_matches(p, '^{urls.VISIT_PARAMETERS}(?:=|$)'))), []), '&'), '') END AS node FROM u),
hit AS (SELECT page_id, arg_max({{'r': rh || rp, 'v': v}}, (length(rh || rp), v = 'allow', length(rh))) AS x
        FROM k JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY page_id),
judged AS (SELECT k.*, x.r AS rule, x.v AS v FROM k LEFT JOIN hit USING (page_id)),
spread AS (SELECT node, BOOL_OR(v = 'allow') AS ok FROM judged WHERE v IS NOT NULL AND node IS NOT NULL GROUP BY node)
SELECT page_id, host, path, rule, COALESCE(v, CASE WHEN ok THEN 'allow' WHEN NOT ok THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN spread USING (node)"""


def _op11(k: int = 40, rounds: int = 5) -> str:
    """k-means spelled out round by round; the sums divide downwards for negative ones too."""
    square = "CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT)"
    parts = [f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS k, v AS c FROM (
  SELECT v, sha256('2:' || vec_id) AS h FROM e ORDER BY h LIMIT {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, v, CAST(x.k AS INTEGER) AS k, x.d AS d FROM (
  SELECT vec_id, v, MIN({{'d': {square}, 'k': k}}) AS x FROM e CROSS JOIN c{r} GROUP BY vec_id, v))""")
        if r < rounds:
            parts.append(f"""
s{r} AS (SELECT k, i, CAST(SUM(x) AS BIGINT) AS s, COUNT(*) AS n FROM (
  SELECT k, UNNEST(v) AS x, UNNEST(range(64)) AS i FROM a{r}) GROUP BY k, i),
c{r + 1} AS MATERIALIZED (SELECT c{r}.k AS k, COALESCE(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY k) m ON m.k = c{r}.k)""")
    return ",".join(parts) + f"""
SELECT vec_id, a{rounds}.k AS cluster, d AS distance, CAST(SUM(d) OVER (PARTITION BY a{rounds}.k) AS BIGINT) AS cluster_inertia,
       CAST(SUM(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.k = a{rounds}.k"""


#: CRC-32 of the digits of a document's number: bit by bit, as no function is built in.
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

OP12 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC} AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS tail, h // 10 AS g FROM d),
p AS (SELECT *, CASE WHEN tail THEN g % n END AS a, CASE WHEN tail THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM g),
i AS (SELECT doc_id, n, w, tail, a, p, UNNEST(range(n)) AS i FROM p),
word AS MATERIALIZED (SELECT doc_id, n, i, w[1 + CASE WHEN tail AND i >= a THEN a + (i - a) % p ELSE i END] AS w FROM i),
often AS (SELECT doc_id, w FROM word GROUP BY doc_id, w HAVING COUNT(*) >= 4),
able AS MATERIALIZED (SELECT doc_id, n, i, w FROM word JOIN often USING (doc_id, w)),
pairs AS (SELECT x.doc_id AS doc_id, y.i - x.i AS q, x.i AS i FROM able x JOIN able y
          ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isles AS (SELECT doc_id, q, MIN(i) AS s, COUNT(*) + q AS l FROM (
          SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z FROM pairs) GROUP BY doc_id, q, z),
long AS MATERIALIZED (SELECT * FROM isles WHERE l >= GREATEST(6, 4 * q)),
runs AS MATERIALIZED (SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.doc_id = x.doc_id AND y.q < x.q AND x.q % y.q = 0
          AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
told AS (SELECT doc_id, COUNT(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id),
best AS (SELECT doc_id, s, l, q FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT doc_id, UNNEST(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
       CAST(1000 * l // q AS BIGINT) AS exponent_milli, sha256(COALESCE(told.t, '')) AS runs_sha256,
       sha256(COALESCE(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: The full sources are a prefix of the sources by size over weight, found here by running sums and not in rounds.
OP13 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^ 	-]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5('mix:' || doc_id), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
        WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
before AS (SELECT *, SUM(n) OVER () AS total, SUM(w) OVER () AS weights,
           COALESCE(SUM(3 * n) OVER earlier, 0) AS held, COALESCE(SUM(w) OVER earlier, 0) AS used
           FROM s WINDOW earlier AS (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, (total - held) * w > 3 * n * (weights - used) AS full_up FROM before),
rest AS (SELECT MIN(total) - COALESCE(SUM(3 * n) FILTER (full_up), 0) AS r, MIN(weights) - COALESCE(SUM(w) FILTER (full_up), 0) AS u FROM judged),
t AS (SELECT source, n, CASE WHEN full_up THEN CAST(3 * n AS DOUBLE) ELSE CAST(r * w AS DOUBLE) / CAST(u AS DOUBLE) END AS target,
      CAST(CASE WHEN full_up THEN 3 * n ELSE (r * w) // u END AS BIGINT) AS budget FROM judged, rest),
o AS (SELECT *, COALESCE(SUM(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM d)
SELECT doc_id, size, n AS source_size, target,
       CAST(budget // GREATEST(n, 1) * size + GREATEST(0, LEAST(size, budget % GREATEST(n, 1) - b)) AS BIGINT) AS taken
FROM o JOIN t ON t.source IS NOT DISTINCT FROM o.source"""


#: The pages of the given tables hold no redirects and no canonical links, so
#: their components are those of equal canonical addresses.
ORACLE = {"op3_suffix_dedup": OP3, "op4_jaccard_join": OP4, "op7_secret_scan": _op7(), "op9_url_filter": _op9(),
          "op11_centroids": _op11(), "op12_periodic_runs": OP12, "op13_source_mix": OP13}
