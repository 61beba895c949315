"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from maskwright.llm.urls import PATTERN_RULES, SITE_RULES, compile_rules

OP1 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS body FROM pages
), k AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k
"""

OP5 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


OP9 = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), f AS (
  SELECT *, regexp_replace(replace(text, '\\', '\\\\'), '(<)(\\||s>|/s>|<SYS>>|</SYS>>)|(\\[)(/?INST\\])', '\\1\\3\\\\\\2\\4', 'g') AS escaped FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(escaped) + length('<||><|end|>')) AS BIGINT) AS formatted_chars,
  CAST(sum(length(role) + length(escaped) + length('<||><|end|>')) AS BIGINT) AS attended_chars
FROM f GROUP BY conv_id
"""


def _url_sql() -> str:
    """Each rule as a condition of its own, the longest first."""
    rules = sorted(compile_rules(SITE_RULES, PATTERN_RULES), key=lambda r: (r["size"], r["rule"]), reverse=True)

    def case(site: bool, value: str) -> str:
        parts = []
        for r in (r for r in rules if r["site"] == site):
            if site:
                host, _, path = r["rule"].partition("/")
                test = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
            else:
                like = r["rule"].replace("_", r"\_").replace("*", "%")
                test = f"target LIKE '{like}' ESCAPE '\\'"
            parts.append(f"WHEN {test} THEN '{r[value]}'")
        return f"CASE {' '.join(parts)} END"

    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*([^#]*)', 1) AS query FROM u
), t AS (SELECT *, host || path || query AS target FROM h),
r AS (SELECT page_id, host, path, {case(True, "rule")} AS rule, {case(True, "verdict")} AS v, {case(False, "rule")} AS p, {case(False, "verdict")} AS w FROM t)
SELECT page_id, host, path, rule, coalesce(v, w, 'allow') AS verdict, CASE WHEN rule IS NULL THEN p END AS pattern FROM r
"""


def _cluster_sql(count: int = 40, rounds: int = 5) -> str:
    """Every round as three tables: distances to the centroids, the nearest one, and the means."""

    def nearest(k: int) -> str:
        apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        return f"""a{k} AS MATERIALIZED (
  SELECT v.row, min(struct_pack(d := CAST({apart} AS BIGINT), k := c.k)) AS best FROM v CROSS JOIN c{k} c GROUP BY v.row
)"""

    def means(k: int) -> str:
        return f"""m{k} AS MATERIALIZED (
  SELECT k, list(CAST(floor_mean AS BIGINT) ORDER BY i) AS x FROM (
    SELECT best.k AS k, i, (s - ((s % n) + n) % n) // n AS floor_mean FROM (
      SELECT a.best, i, sum(v.x[i]) AS s, count(*) AS n FROM (SELECT row, struct_pack(k := best.k) AS best FROM a{k}) a
      JOIN v ON v.row = a.row CROSS JOIN range(1, 65) r(i) GROUP BY a.best, i
    )
  ) GROUP BY k
), c{k + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON m.k = c.k)"""

    steps = ",\n".join(f"{nearest(k)},\n{means(k)}" for k in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, x FROM (
    SELECT sha256('2:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h LIMIT {count}
  )
),
{steps},
{nearest(rounds)},
d AS (SELECT v.vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance FROM a{rounds} a JOIN v ON v.row = a.row)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM d JOIN c{rounds} c ON c.k = d.cluster
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op5_exact_dedup": OP5, "op6_url_filters": _url_sql(), "op9_chat_tree": OP9, "op11_clusters": _cluster_sql()}
