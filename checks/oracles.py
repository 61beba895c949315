"""DuckDB SQL for the queries of ``checks.queries``, written apart from the Spark code.

Patterns here are RE2 patterns. RE2 has no look-around, so word boundaries are ``\\b`` where
the match begins or ends with a word character, and conditions on the neighbouring
characters elsewhere.
"""

from __future__ import annotations

WORD = "[0-9A-Za-z_]"
OCT = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DIGITS = "regexp_replace(t, '[^0-9]', '', 'g')"
LUHN = (
    f"(list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda k:"
    f" CASE WHEN k % 2 = 0 THEN (2 * CAST(substr(reverse({DIGITS}), k, 1) AS INT)) // 10"
    f" + (2 * CAST(substr(reverse({DIGITS}), k, 1) AS INT)) % 10"
    f" ELSE CAST(substr(reverse({DIGITS}), k, 1) AS INT) END)) % 10 = 0)"
)
SSN = f"NOT regexp_matches({DIGITS}, '^(000|666|9)|^[0-9]{{3}}00|0000$')"
COMPACT = "replace(t, ' ', '')"
IBAN = (
    f"(length({COMPACT}) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split("
    f"substr({COMPACT}, 5) || substr({COMPACT}, 1, 4), ''), lambda ch:"
    " CASE WHEN ch BETWEEN '0' AND '9' THEN CAST(ch AS INT) ELSE ascii(ch) - 55 END),"
    " lambda rest, v: (rest * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97, 0) = 1)"
)
def near(pattern: str) -> str:
    """Whether a pattern occurs within 40 characters of the match, on either side."""
    return f"(regexp_matches(before, '{pattern}') OR regexp_matches(after, '{pattern}'))"


SSN_NEAR = near("(?i)ssn|social security|social sec")
PHONE_NEAR = near("(?i)phone|tel[.:]|call|mobile|cell|fax")
NHS_NEAR = near("(?i)nhs|national health")
NHS = f"(list_sum(list_transform(range(1, 11), lambda k: CAST(substr({DIGITS}, k, 1) AS INT) * (11 - k))) % 11 = 0)"

# type, RE2 pattern, score, condition on the match t, its neighbours b and a, and what is before and after
RULES = [
    ("EMAIL_ADDRESS", r"[\p{L}\p{M}\p{N}._%+-]+@[\p{L}\p{M}\p{N}.-]+\.\p{L}{2,}", "1.0", "true"),
    (
        "PHONE_NUMBER",
        r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}\b"
        r"|(?:\b1[ .-])?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}\b"
        r"|\b(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b",
        f"CASE WHEN {PHONE_NEAR} THEN 0.75 ELSE 0.4 END",
        "NOT regexp_matches(b, '[0-9A-Za-z_+]')",
    ),
    (
        "CREDIT_CARD",
        r"\b(?:[2-6][0-9]{12,18}|[2-6][0-9]{3}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}"
        r"|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5})\b",
        "1.0",
        LUHN,
    ),
    ("US_SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", f"CASE WHEN {SSN_NEAR} THEN 0.85 ELSE 0.5 END", SSN),
    ("US_SSN", r"\b[0-9]{9}\b", f"CASE WHEN {SSN_NEAR} THEN 0.4 ELSE 0.05 END", SSN),
    ("US_ITIN", r"\b9[0-9]{2}-(?:5[0-9]|6[0-5]|7[0-9]|8[0-8]|9[0-24-9])-[0-9]{4}\b", "0.5", "true"),
    ("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", "1.0", IBAN),
    ("IP_ADDRESS", rf"\b(?:{OCT}\.){{3}}{OCT}\b", "0.6", "true"),
    (
        "IP_ADDRESS",
        r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b"
        r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}\b"
        r"|(?:[0-9A-Fa-f]{1,4}:){2,7}:|:(?::[0-9A-Fa-f]{1,4}){1,7}\b",
        "0.6",
        "NOT regexp_matches(b, '[0-9A-Za-z_:]') AND NOT regexp_matches(a, '[0-9A-Za-z_:]')"
        " AND len(string_split(t, ':')) <= (CASE WHEN starts_with(t, '::') OR ends_with(t, '::') THEN 9 ELSE 8 END) AND regexp_matches(t, '[0-9]')",
    ),
    ("URL", r"""https?://[^\x00-\x20<>"]*[^\x00-\x20<>".,;:!?')\]}]""", "0.6", "true"),
    (
        "URL",
        r"""(?i:www)\.[0-9A-Za-z-]+\.[^\x00-\x20<>"]*[^\x00-\x20<>".,;:!?')\]}]""",
        "0.5",
        "NOT regexp_matches(b, '[0-9A-Za-z_./@-]')",
    ),
    ("PHONE_NUMBER", r"\b[2-9][0-9]{9}\b", f"CASE WHEN {PHONE_NEAR} THEN 0.5 ELSE 0.05 END", "true"),
    (
        "DATE_TIME",
        r"\b(?:[12][0-9]{3}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?:[T ][0-2][0-9]:[0-5][0-9](?::[0-5][0-9])?Z?)?"
        r"|(?:0?[1-9]|[12][0-9]|3[01])[./](?:0?[1-9]|1[0-2])[./][12][0-9]{3}"
        r"|(?:0?[1-9]|1[0-2])/(?:1[3-9]|2[0-9]|3[01])/[12][0-9]{3})\b",
        "0.6",
        "true",
    ),
    ("CRYPTO", r"\b(?:bc1[02-9ac-hj-np-z]{25,59}|0x[0-9A-Fa-f]{40})\b", "0.6", "true"),
    ("UK_NHS", r"\b[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}\b", f"CASE WHEN {NHS_NEAR} THEN 0.85 ELSE 0.3 END", NHS),
]
DOMAIN_RULE = ("DOMAIN_NAME", r"\b[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,6}\b", "0.3", "true")


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def matches_cte(source: str, rules=RULES, prefix: str = "raw") -> str:
    """CTEs that end in ``<prefix>(id, start, end, entity_type, score, text)`` over ``source(id, text)``.

    Each match is put between two control characters; positions are running lengths.
    """
    ctes, names = [], []
    for n, (kind, pattern, score, condition) in enumerate(rules):
        cut, seq, out = f"{prefix}_cut{n}", f"{prefix}_seq{n}", f"{prefix}_m{n}"
        marked = f"regexp_replace(text, {lit('(' + pattern + ')')}, chr(1) || '\\1' || chr(2), 'g')"
        ctes.append(
            f"{cut} AS (SELECT id, whole, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT id,"
            f" text AS whole, string_split({marked}, chr(1)) AS ps FROM {source}))"
        )
        ctes.append(
            f"{seq} AS (SELECT id, whole, i, p, lag(p) OVER w AS pp,"
            " CAST(sum(length(replace(p, chr(2), ''))) OVER w - length(replace(p, chr(2), '')) AS BIGINT) AS s"
            f" FROM {cut} WINDOW w AS (PARTITION BY id ORDER BY i))"
        )
        ctes.append(
            f"{out} AS (SELECT id, CAST(s AS INT) AS start, CAST(s + length(t) AS INT) AS \"end\","
            f" {lit(kind)} AS entity_type, CAST({score} AS DOUBLE) AS score, t AS text"
            " FROM (SELECT id, s, split_part(p, chr(2), 1) AS t, substr(whole, greatest(s - 40, 0) + 1, least(s, 40)) AS before,"
            " substr(whole, s + length(split_part(p, chr(2), 1)) + 1, 40) AS after,"
            " right(replace(pp, chr(2), ''), 1) AS b, left(split_part(p, chr(2), 2), 1) AS a"
            f" FROM {seq} WHERE i > 1) WHERE {condition})"
        )
        names.append(out)
    union = " UNION ALL ".join(f"SELECT * FROM {m}" for m in names)
    ctes.append(f"{prefix} AS ({union})")
    return ",\n".join(ctes)


def resolved_cte(raw: str = "raw", out: str = "kept") -> str:
    """Greedy choice of disjoint spans: longest, then score, start, type."""
    return (
        f"{out}_ranked AS (SELECT id, list({{'start': start, 'end': \"end\", 'entity_type': entity_type,"
        " 'score': score, 'text': text}"
        " ORDER BY \"end\" - start DESC, score DESC, start, entity_type) AS l"
        f" FROM {raw} GROUP BY id),\n"
        f"{out} AS (SELECT id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y:"
        " y.\"start\" < x.\"end\" AND x.\"start\" < y.\"end\")) > 0 THEN acc ELSE list_append(acc, x) END,"
        " l[1:1]), recursive := true) FROM " + f"{out}_ranked)"
    )


DOCS = "src AS (SELECT doc_id AS id, text FROM documents)"
FOUND = f"{DOCS},\n{matches_cte('src')},\n{resolved_cte()}"
MATCH_COLUMNS = 'start, "end", entity_type, score, text'
LINE_COLUMN = (
    "CAST(length(p) - length(replace(p, chr(10), '')) + 1 AS INT) AS line,"
    " CAST(length(split_part(p, chr(10), -1)) + 1 AS INT) AS \"column\""
)


def masked_cte(replacement: str, source: str = "kept", docs: str = "src", out: str = "masked") -> str:
    """``out(id, masked)``: gaps and replacements in order; ``replacement`` is SQL over a match ``m``."""
    return (
        f"{out}_new AS (SELECT m.*, {replacement} AS new,"
        " coalesce(lag(\"end\") OVER (PARTITION BY id ORDER BY start), 0) AS before"
        f" FROM {source} m),\n"
        f"{out}_joined AS (SELECT d.id, string_agg(substr(d.text, m.before + 1, m.start - m.before) || m.new, ''"
        f" ORDER BY m.start) || substr(any_value(d.text), max(m.\"end\") + 1) AS masked"
        f" FROM {docs} d JOIN {out}_new m ON m.id = d.id GROUP BY d.id),\n"
        f"{out} AS (SELECT d.id, coalesce(j.masked, d.text) AS masked FROM {docs} d LEFT JOIN {out}_joined j ON j.id = d.id)"
    )


SALT = "pepper"
NUMBER = f"CAST(CAST('0x' || substr(sha256('{SALT}' || m.text), 1, 15) AS BIGINT) % 10000 AS VARCHAR)"
ANONYMIZED = f"'[' || entity_type || '_' || {NUMBER} || ']'"
REDACTED = "'<' || entity_type || '>'"
NUMBERED = "entity_type || '_' || CAST(row_number() OVER (PARTITION BY id, entity_type ORDER BY start) AS VARCHAR)"
COUNTS_JSON = (
    "'{' || string_agg('\"' || entity_type || '\":' || CAST(n AS VARCHAR), ',' ORDER BY entity_type) || '}'"
)
COUNTS = "SELECT id, entity_type, count(*) AS n FROM kept GROUP BY id, entity_type"
STAMP = "2025-01-01T12:00:00Z"
USER = "tester"
EPOCH_DAY = "TIMESTAMP '2024-02-01 00:00:00'"

PATHS = (
    "paths AS (SELECT doc_id, '/in/' || source || '/doc.' || CAST(doc_id AS VARCHAR)"
    " || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.PDF' WHEN 2 THEN '' ELSE '.tar.gz' END AS path FROM documents)"
)
FILES = (
    "files AS (SELECT event_id, '/data/' || event_type || '/' || CAST(user_id AS VARCHAR) || '/'"
    " || CAST(event_id AS VARCHAR) || CASE event_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.json' ELSE '.pdf' END AS path,"
    " ts AS mtime FROM events)"
)
OLD = (
    "old AS (SELECT path, mtime, CAST(epoch_us(" + EPOCH_DAY + ") - epoch_us(mtime) AS DOUBLE) / 86400000000.0 AS age_days"
    " FROM files WHERE mtime < " + EPOCH_DAY + " - INTERVAL 14 DAY"
    " AND (contains(split_part(path, '/', -1), '.md') OR contains(split_part(path, '/', -1), '.pdf')))"
)
KV = (
    "kv AS (SELECT page_id, unnest(items) AS item, generate_subscripts(items, 1) AS i FROM (SELECT page_id,"
    " list_concat(string_split(split_part(split_part(url, '#', 1), '?', 2), '&'), ['flag', 'ref=a=b', 'site=first', 'site=last'])"
    " AS items FROM pages))"
)
LEASES = (
    "src AS (SELECT c_custkey AS id, 'Tenant: ' || c_name || ' | Signer: ' || n_name || ' Holdings Co.'"
    " || chr(10) || 'Agent ' || c_name || ', ' || n_name || '.' AS text"
    " FROM customer JOIN nation ON n_nationkey = c_nationkey)"
)
LEASED = (
    "src AS (SELECT doc_id AS id, 'Tenant: ' || c_name || ' | Signer: ' || n_name || ' Holdings Co.' || chr(10) || text"
    " || chr(10) || 'Agent ' || c_name || ', ' || n_name || '.' AS text FROM documents"
    " JOIN customer ON c_custkey = doc_id % (SELECT count(*) FROM customer) JOIN nation ON n_nationkey = c_nationkey)"
)


def terms_cte(source: str = "src") -> str:
    """``named(id, start, end, entity_type, score, text)``: sequences of up to three words that are terms."""
    word = "[\\p{L}\\p{N}_#&.''-]+"
    return (
        "terms AS (SELECT DISTINCT c_name AS term, 'PERSON' AS entity_type FROM customer UNION ALL"
        " SELECT DISTINCT n_name, 'LOCATION' FROM nation UNION ALL SELECT DISTINCT n_name || ' Holdings Co', 'ORGANIZATION'"
        f" FROM nation), cut AS (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT id, string_split("
        f"regexp_replace(text, '({word})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS ps FROM {source})),"
        " seq AS (SELECT id, i, regexp_replace(split_part(p, chr(2), 1), '[.''-]+$', '') AS w,"
        " sum(length(replace(p, chr(2), ''))) OVER (PARTITION BY id ORDER BY i) - length(replace(p, chr(2), '')) AS s"
        " FROM cut), words AS (SELECT id, s, w, row_number() OVER (PARTITION BY id ORDER BY i) AS j FROM seq WHERE i > 1 AND w <> ''),"
        " grams AS (SELECT id, s, s + length(w) AS e, w AS g FROM words UNION ALL"
        " SELECT a.id, a.s, b.s + length(b.w), a.w || ' ' || b.w FROM words a JOIN words b ON b.id = a.id AND b.j = a.j + 1"
        " UNION ALL SELECT a.id, a.s, c.s + length(c.w), a.w || ' ' || b.w || ' ' || c.w FROM words a JOIN words b"
        " ON b.id = a.id AND b.j = a.j + 1 JOIN words c ON c.id = a.id AND c.j = a.j + 2),"
        " named AS (SELECT id, CAST(s AS INT) AS start, CAST(e AS INT) AS \"end\", entity_type, CAST(0.85 AS DOUBLE) AS score,"
        " g AS text FROM grams JOIN terms ON term = g)"
    )


IDENTITIES = """src AS (SELECT id, 'Tenant ' || name || chr(10) || CASE WHEN id % 2 = 0 THEN 'SSN ' ELSE 'No. ' END
 || ssn || ', tax ' || itin || '; bare ' || bare || ' account ' || iban || ' end, call 415-555-' || substr(bare, 6)
 || chr(10) || 'born 19' || lpad(CAST(id % 80 + 10 AS VARCHAR), 2, '0') || '-02-03, www.example.com/' || bare || ', node 2001:db8:: or ::'
 || lpad(CAST(id % 9999 AS VARCHAR), 4, '0') || '; Jürgen' || CAST(id AS VARCHAR) || '@bücher.example, ' || ssn || ' is an SSN, NHS 943 476 '
 || lpad(CAST(id % 9999 AS VARCHAR), 4, '0') || ', mobile 5' || bare AS text
 FROM (SELECT c_custkey AS id, c_name AS name,
  lpad(CAST(c_custkey % 900 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-'
   || lpad(CAST(c_custkey * 7 % 10000 AS VARCHAR), 4, '0') AS ssn,
  '9' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0')
   || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS itin,
  lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS bare,
  'DE' || lpad(CAST(CASE WHEN c_custkey % 3 = 0 THEN 42 ELSE 98 - CAST((CAST(c_custkey + 370400440532013000 AS HUGEINT)
   * 1000000 + 131400) % 97 AS INT) END AS VARCHAR), 2, '0') || CAST(c_custkey + 370400440532013000 AS VARCHAR) AS iban
  FROM customer))"""
DIRTY = (
    "dirty AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN replace(t, chr(10), chr(13) || chr(10)) ELSE t END AS text"
    " FROM (SELECT doc_id, ' ' || replace(replace(text, chr(10), ' ' || chr(9) || chr(160) || chr(10)), '. ',"
    " '.' || chr(12288) || chr(13) || chr(10) || chr(10) || ' ' || chr(10) || chr(10)) || '  ' AS t FROM documents))"
)
BLANK = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANK_IN_LINE = BLANK.replace(r"\x09-\x0d", r"\x09\x0b-\x0d")
NORMALIZED = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'),"
    f" '[{BLANK_IN_LINE}]+(\\n)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'),"
    f" '^[{BLANK}]+', ''), '[{BLANK}]+$', '') || chr(10)"
)
ANSWERS = (
    "ans AS (SELECT d.id, CASE d.id % 10 WHEN 3 THEN 'none' WHEN 7 THEN '[{broken'"
    " ELSE coalesce(a.answer, '[]') END AS answer FROM src d LEFT JOIN (SELECT id, '[' || string_agg("
    "'{\"entity\":\"' || text || '\",\"category\":\"' || lower(entity_type) || '\"}', ',' ORDER BY start) || ']' AS answer"
    " FROM kept GROUP BY id) a ON a.id = d.id)"
)
PAIRS = "SELECT DISTINCT k.id, k.text AS entity, k.entity_type FROM kept k WHERE k.id % 10 NOT IN (3, 7)"
EMAIL_ONLY = matches_cte("src", [RULES[0]])
PROMPT = (
    "'Output all Personal Identifiable Information (PII) in the following text as a list of JSON objects with"
    " ''entity'' and ''category'' fields:' || chr(10) || '''' || {text} || '''' || chr(10)"
)
MASK_PROMPT = (
    "'Rewrite the text so that it names no person and gives no contact or account data. Put a numbered label such as"
    " EMAIL_1 in place of each.' || chr(10) || chr(10) || 'Text: ' || s.text || chr(10) || chr(10) || 'Rewritten: ' ||"
    " m.masked || chr(10)"
)
# JSON text of a string the way Spark writes it.
JSON_TEXT = "CAST(to_json({text}) AS VARCHAR)"
SPLIT = "CASE WHEN CAST('0x' || substr(sha256('42:' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % 10000 < 2000 THEN 'test' ELSE 'train' END"
OUT_FILE = "'doc_' || CAST(id AS VARCHAR) || '.md'"
PII_EVENT = (
    f"'{{\"timestamp\":\"{STAMP}\",\"operation\":\"pii_anonymize\",\"file\":\"' || {OUT_FILE} || '\",\"user\":\"{USER}\","
    "\"mode\":\"anonymize\",\"pii_total\":' || CAST(coalesce(c.total, 0) AS VARCHAR) || ',\"entity_counts\":' ||"
    f" coalesce(c.counts, '{{}}') || ',\"output_file\":\"' || {OUT_FILE} || '\",\"report_file\":\"' || {OUT_FILE}"
    " || '.pii.json\"}'"
)
DOC_COUNTS = f"dc AS (SELECT id, CAST(sum(n) AS INT) AS total, {COUNTS_JSON} AS counts FROM ({COUNTS}) GROUP BY id)"
ENCRYPT_SHAPE = "'{{ENC:' || entity_type || ':token}}'"

_EVENT_COLUMNS = {
    "timestamp": "VARCHAR", "operation": "VARCHAR", "file": "VARCHAR", "directory": "VARCHAR", "input_file": "VARCHAR",
    "user": "VARCHAR", "mode": "VARCHAR", "pii_total": "INT", "entity_counts": "VARCHAR", "markers_found": "INT",
    "markers_decrypted": "INT", "output_file": "VARCHAR", "report_file": "VARCHAR", "retention_days": "INT",
    "files_deleted": "BIGINT", "errors": "BIGINT", "dry_run": "BOOLEAN", "s3_uri": "VARCHAR", "encryption": "VARCHAR",
    "status": "VARCHAR", "error": "VARCHAR",
}


def event_select(source: str, operation: str, **fields: str) -> str:
    given = {"timestamp": lit(STAMP), "user": lit(USER), "operation": operation, **fields}
    columns = ", ".join(f'CAST({given.get(c, "NULL")} AS {t}) AS "{c}"' for c, t in _EVENT_COLUMNS.items())
    return f"SELECT {columns} FROM {source}"


JOBS = "jobs AS (SELECT doc_id, path, CASE WHEN doc_id % 7 = 0 THEN 'invalid UTF-8' END AS error FROM paths)"
FILE_OF = "split_part(path, '/', -1)"
JOB_EVENTS = " UNION ALL ".join(
    [
        event_select("jobs", "'container_start'", input_file=FILE_OF, mode="'encrypt'"),
        event_select("jobs WHERE error IS NULL", "'container_complete'", input_file=FILE_OF, mode="'encrypt'", status="'success'"),
        event_select("jobs WHERE error IS NOT NULL", "'container_error'", input_file=FILE_OF, error="error"),
    ]
)


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["detect_spans"] = f"WITH {FOUND} SELECT id AS doc_id, {MATCH_COLUMNS} FROM raw"
    sql["pii_matches"] = (
        f"WITH {FOUND} SELECT k.id AS doc_id, k.start, k.\"end\", k.entity_type, k.score, k.text, {LINE_COLUMN}"
        " FROM (SELECT k.*, substr(d.text, 1, k.start) AS p FROM kept k JOIN src d ON d.id = k.id) k"
    )
    pages = "src AS (SELECT page_id AS id, url || chr(10) || html AS text FROM pages)"
    sql["span_line_col"] = (
        f"WITH {pages},\n{matches_cte('src')},\n{resolved_cte()} SELECT k.id AS page_id, k.start, k.entity_type, {LINE_COLUMN}"
        " FROM (SELECT k.*, substr(d.text, 1, k.start) AS p FROM kept k JOIN src d ON d.id = k.id) k"
    )
    sql["detect_identities"] = (
        f"WITH {IDENTITIES},\n{matches_cte('src')},\n{resolved_cte()} SELECT id AS c_custkey, {MATCH_COLUMNS} FROM kept"
    )
    sql["filter_entities"] = (
        f"WITH {FOUND} SELECT id AS doc_id, {MATCH_COLUMNS} FROM kept WHERE entity_type IN ('EMAIL_ADDRESS', 'PHONE_NUMBER')"
    )
    sql["filter_by_source_list"] = (
        f"WITH {FOUND} SELECT k.id AS doc_id, {MATCH_COLUMNS.replace('text', 'k.text')} FROM kept k JOIN documents d"
        " ON d.doc_id = k.id WHERE CASE WHEN right(d.source, 1) = '9' THEN true WHEN right(d.source, 1) IN ('0', '2', '4', '6',"
        " '8') THEN entity_type IN ('EMAIL_ADDRESS', 'PHONE_NUMBER') ELSE entity_type = 'CREDIT_CARD' END"
    )
    sql["entity_counts"] = f"WITH {FOUND} SELECT id AS doc_id, entity_type, n FROM ({COUNTS})"
    sql["entity_rollup"] = (
        f"WITH {FOUND} SELECT source, lang, entity_type, CAST(sum(n) AS BIGINT) AS n_spans, count(*) AS n_doc_types"
        f" FROM ({COUNTS}) c JOIN documents d ON d.doc_id = c.id GROUP BY ROLLUP (source, lang, entity_type)"
    )
    sql["top_docs_by_pii"] = (
        f"WITH {FOUND} SELECT d.id AS doc_id, CAST(coalesce(n, 0) AS INT) AS n FROM src d LEFT JOIN"
        " (SELECT id, count(*) AS n FROM kept GROUP BY id) c ON c.id = d.id ORDER BY 2 DESC, 1 LIMIT 20"
    )
    sql["resolve_overlaps"] = (
        f"WITH {pages},\n{matches_cte('src', [*RULES, DOMAIN_RULE])},\n{resolved_cte()}"
        f" SELECT id AS page_id, {MATCH_COLUMNS} FROM kept"
    )
    for key, replacement in (
        ("mask_redact", REDACTED),
        ("mask_anonymize", ANONYMIZED),
        ("mask_numbered", NUMBERED),
        ("mask_encrypt_shape", ENCRYPT_SHAPE),
    ):
        sql[key] = f"WITH {FOUND},\n{masked_cte(replacement)} SELECT id AS doc_id, masked FROM masked"
    ranked = (
        "numbered AS (SELECT k.*, n FROM kept k JOIN (SELECT entity_type, text, dense_rank() OVER (PARTITION BY entity_type ORDER BY text) AS n"
        " FROM (SELECT DISTINCT entity_type, text FROM kept)) r ON r.entity_type = k.entity_type AND r.text = k.text)"
    )
    sql["mask_numbered_corpus"] = (
        f"WITH {FOUND},\n{ranked},\n"
        + masked_cte("'[' || entity_type || '_' || CAST(n AS VARCHAR) || ']'", "numbered")
        + " SELECT id AS doc_id, masked FROM masked"
    )
    policy = (
        "policed AS (SELECT * FROM kept WHERE entity_type <> 'IP_ADDRESS')"
    )
    by_type = f"CASE entity_type WHEN 'EMAIL_ADDRESS' THEN {REDACTED} ELSE {ANONYMIZED} END"
    sql["mask_policy"] = f"WITH {FOUND},\n{policy},\n{masked_cte(by_type, 'policed')} SELECT id AS doc_id, masked FROM masked"
    sql["masked_items"] = (
        f"WITH {FOUND},\nnewer AS (SELECT m.*, {ANONYMIZED} AS new FROM kept m),\n"
        "shifted AS (SELECT *, coalesce(sum(length(new) - (\"end\" - start)) OVER (PARTITION BY id ORDER BY start"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM newer)"
        " SELECT id AS doc_id, CAST(start + shift AS INT) AS start, CAST(start + shift + length(new) AS INT) AS \"end\","
        " entity_type FROM shifted"
    )
    sql["placeholder_counts"] = (
        f"WITH {FOUND},\n{masked_cte(ANONYMIZED)},\nps AS (SELECT unnest(regexp_extract_all(masked, '\\[.*?\\]')) AS p FROM masked)"
        " SELECT upper(trim(p, '[]')) AS placeholder, count(*) AS n FROM ps GROUP BY 1"
    )
    sql["roundtrip"] = "SELECT doc_id, text FROM documents"
    sql["roundtrip_items"] = "SELECT doc_id, text FROM documents"
    sql["marker_counts"] = (
        f"WITH {FOUND} SELECT d.id AS doc_id, CAST(coalesce(n, 0) AS INT) AS markers_found,"
        " CAST(coalesce(n, 0) AS INT) AS markers_decrypted"
        " FROM src d LEFT JOIN (SELECT id, count(*) AS n FROM kept GROUP BY id) c ON c.id = d.id"
    )
    sql["wrong_key_keeps"] = (
        f"WITH {FOUND} SELECT d.id AS doc_id, true AS unchanged, CAST(coalesce(n, 0) AS INT) AS markers_found,"
        " 0 AS markers_decrypted"
        " FROM src d LEFT JOIN (SELECT id, count(*) AS n FROM kept GROUP BY id) c ON c.id = d.id"
    )
    sql["normalize_text"] = f"WITH {DIRTY} SELECT doc_id, {NORMALIZED} AS text FROM dirty"
    sql["assemble_pages"] = (
        "SELECT conv_id AS doc_id, string_agg(CASE WHEN turn % 3 = 2 THEN '' ELSE text END, chr(10) || chr(10) ORDER BY turn)"
        " AS text FROM conversations GROUP BY conv_id"
    )
    sql["first_nonempty"] = (
        "SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE text END AS text,"
        " CASE doc_id % 4 WHEN 3 THEN 'no extractor gave text' END AS error FROM documents"
    )
    sql["output_paths"] = (
        f"WITH {PATHS}, b AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, split_part(path, '/', -1) AS base"
        " FROM paths), e AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.PDF' WHEN 2 THEN '.' || CAST(doc_id AS"
        " VARCHAR) ELSE '.gz' END AS ext FROM b), s AS (SELECT *, left(base, length(base) - length(ext)) AS stem FROM e)"
        " SELECT doc_id, base, stem, ext, dir || '/' || stem AS outdir, dir || '/' || stem || '/' || stem || '.md' AS out_path,"
        " dir || '/' || stem || '/' || stem || '.md.pii.json' AS report_path, dir || '/' || stem || '.decrypted.md' AS decrypted_path"
        " FROM s"
    )
    sql["route_by_ext"] = (
        f"WITH {PATHS} SELECT path, CASE WHEN doc_id % 4 = 1 THEN 'pdf' ELSE 'text' END AS route FROM paths"
    )
    sql["parse_kv_metadata"] = (
        f"WITH {KV} SELECT page_id, split_part(item, '=', 1) AS \"key\","
        " arg_max(substr(item, strpos(item, '=') + 1), i) AS \"value\" FROM kv WHERE contains(item, '=') GROUP BY 1, 2"
    )
    sql["upload_manifest"] = (
        f"WITH {PATHS} SELECT path, 's3://masked-' || CAST(doc_id % 3 AS VARCHAR) || '/' || CASE WHEN doc_id % 2 = 0 THEN"
        f" 'batch/' || CAST(doc_id AS VARCHAR) ELSE {FILE_OF} END AS s3_uri, 'aws:kms' AS encryption, 'key-1' AS kms_key_id,"
        " 'pii-masked' AS kind FROM paths"
    )
    sql["read_docs"] = (
        "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN text END AS text,"
        " CASE WHEN doc_id % 7 = 0 THEN 'invalid UTF-8' END AS error FROM documents"
    )
    match_json = (
        "'{\"start\":' || CAST(start AS VARCHAR) || ',\"end\":' || CAST(\"end\" AS VARCHAR) || ',\"entity_type\":\"' || entity_type"
        " || '\",\"score\":' || CAST(score AS VARCHAR) || ',\"text\":\"' || text || '\",\"line\":' || CAST(line AS VARCHAR)"
        " || ',\"column\":' || CAST(\"column\" AS VARCHAR) || '}'"
    )
    sql["pii_report"] = (
        f"WITH {FOUND}, placed AS (SELECT k.*, {LINE_COLUMN} FROM (SELECT k.*, substr(d.text, 1, k.start) AS p FROM kept k"
        f" JOIN src d ON d.id = k.id) k), js AS (SELECT id, count(*) AS total, string_agg({match_json}, ',' ORDER BY start) AS ms"
        f" FROM placed GROUP BY id) SELECT d.id AS doc_id, '{{\"file\":\"doc_' || CAST(d.id AS VARCHAR) || '.md\",\"total\":'"
        " || CAST(coalesce(total, 0) AS VARCHAR) || ',\"matches\":[' || coalesce(ms, '') || ']}' AS report"
        " FROM src d LEFT JOIN js ON js.id = d.id"
    )
    sql["audit_pii"] = (
        f"WITH {FOUND}, {DOC_COUNTS} SELECT 'pii_anonymize' AS operation, {PII_EVENT} AS event"
        " FROM (SELECT d.id, c.total, c.counts FROM src d LEFT JOIN dc c ON c.id = d.id) c"
    )
    sql["job_events"] = f"WITH {PATHS}, {JOBS} {JOB_EVENTS}"
    counted = (
        "(SELECT d.id, lang, coalesce(c.total, 0) AS total, coalesce(c.counts, '{}') AS counts"
        " FROM src d JOIN documents ON doc_id = d.id LEFT JOIN dc c ON c.id = d.id)"
    )
    lost = "(total > 0 AND coalesce(lang NOT IN ('en', 'de', 'fr'), true))"
    sql["audit_all"] = (
        f"WITH {FOUND}, {DOC_COUNTS}, {PATHS}, {JOBS}, {FILES}, {OLD} "
        + " UNION ALL ".join(
            [
                event_select(
                    counted, "'pii_encrypt'", file=OUT_FILE, mode="'encrypt'", pii_total=f"CASE WHEN NOT {lost} THEN total END",
                    entity_counts=f"CASE WHEN NOT {lost} THEN counts END", output_file=f"CASE WHEN NOT {lost} THEN {OUT_FILE} END",
                    report_file=f"CASE WHEN NOT {lost} THEN {OUT_FILE} || '.pii.json' END",
                    status=f"CASE WHEN {lost} THEN 'error' END", error=f"CASE WHEN {lost} THEN 'unknown key' END",
                ),
                event_select(
                    f"(SELECT * FROM {counted} WHERE NOT {lost})", "'pii_decrypt'", file=OUT_FILE,
                    output_file="'doc_' || CAST(id AS VARCHAR) || '.decrypted.md'",
                    markers_found="total", markers_decrypted="CASE WHEN lang = 'de' THEN 0 ELSE total END",
                ),
                event_select(
                    "(SELECT count(*) AS n FROM old)", "'cleanup'", directory="'/data'", retention_days="14",
                    files_deleted="n", errors="0", dry_run="true",
                ),
                event_select(
                    "paths", "'s3_upload'", file=FILE_OF, encryption="'AES256'", s3_uri=f"'s3://masked/' || {FILE_OF}"
                ),
                JOB_EVENTS,
            ]
        )
    )
    sql["file_inventory"] = (
        "SELECT coalesce(source, 'none') AS source, count(*) AS documents, CAST(1 AS BIGINT) AS files,"
        " CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS bytes FROM documents GROUP BY 1"
    )
    sql["audit_committed"] = (
        f"WITH {FOUND}, {DOC_COUNTS}, {FILES}, {OLD} "
        + event_select(
            counted, "'pii_anonymize'", file=OUT_FILE, mode="'anonymize'", pii_total="total", entity_counts="counts",
            output_file=OUT_FILE, report_file=f"{OUT_FILE} || '.pii.json'",
        )
        + " UNION ALL "
        + event_select(
            "(SELECT count(*) AS n FROM old)", "'cleanup'", directory="'/data'", retention_days="14",
            files_deleted="n", errors="0", dry_run="true",
        )
    )
    sql["old_files"] = f"WITH {FILES}, {OLD} SELECT path, round(age_days, 6) AS age_days FROM old"
    sql["retention_plan"] = (
        f"WITH {FILES}, {OLD} SELECT path, round(age_days, 6) AS age_days, true AS ok, CAST(NULL AS VARCHAR) AS error FROM old"
    )
    sql["retention_summary"] = (
        f"WITH {FILES}, {OLD} SELECT count(*) AS files_deleted, CAST(0 AS BIGINT) AS errors FROM old"
    )
    sql["retained_rows"] = (
        f"WITH {FILES}, {OLD} SELECT e.event_id, e.event_type, e.value FROM events e JOIN files f ON f.event_id = e.event_id"
        " WHERE f.path NOT IN (SELECT path FROM old)"
    )
    sql["retained_in_place"] = sql["retained_rows"]
    sql["emptied_dirs"] = (
        f"WITH {FILES}, gone AS (SELECT path FROM files WHERE mtime < {EPOCH_DAY} - INTERVAL 3 DAY),"
        " up AS (SELECT path, '/data/' || split_part(path, '/', 3) AS dir FROM files"
        " UNION ALL SELECT path, '/data/' || split_part(path, '/', 3) || '/' || split_part(path, '/', 4) FROM files)"
        " SELECT dir, count(*) AS files, count(*) AS expired FROM up GROUP BY dir"
        " HAVING count(*) = count(*) FILTER (WHERE path IN (SELECT path FROM gone))"
    )
    entities_json = (
        "'[' || string_agg('{\"entity\":\"' || text || '\",\"category\":\"' || entity_type || '\"}', ',' ORDER BY start) || ']'"
    )
    sql["sft_messages"] = (
        f"WITH {FOUND}, en AS (SELECT id, {entities_json} AS j FROM kept GROUP BY id)"
        f" SELECT {PROMPT.format(text='d.text')} AS user_content, coalesce(en.j, '[]') AS assistant_content,"
        " 'user,assistant' AS roles FROM src d LEFT JOIN en ON en.id = d.id"
    )
    sql["sft_base_prompt"] = (
        f"WITH {FOUND},\n{masked_cte(NUMBERED)} SELECT s.id AS doc_id, {MASK_PROMPT} AS prompt FROM src s JOIN masked m ON m.id = s.id"
    )
    sql["sft_split"] = f"SELECT doc_id, {SPLIT} AS split FROM documents"
    sql["model_extract"] = (
        f"WITH {DOCS},\n{EMAIL_ONLY}, js AS (SELECT id, '[' || string_agg('{{\"entity\": \"' || text ||"
        " '\", \"category\": \"EMAIL\"}', ', ' ORDER BY start) || ']' AS answer FROM raw GROUP BY id)"
        " SELECT d.id AS doc_id, coalesce(answer, '[]') AS answer FROM src d LEFT JOIN js ON js.id = d.id"
    )
    sql["parse_model_entities"] = (
        f"WITH {FOUND}, {ANSWERS} SELECT a.id AS doc_id, i AS pos, t AS entity, c AS category FROM"
        " (SELECT id, text AS t, lower(entity_type) AS c, CAST(row_number() OVER (PARTITION BY id ORDER BY start) - 1 AS INT) AS i"
        " FROM kept) k JOIN ans a ON a.id = k.id WHERE a.id % 10 NOT IN (3, 7)"
        " UNION ALL SELECT id, NULL, NULL, NULL FROM ans WHERE id % 10 IN (3, 7)"
    )
    sql["locate_entities"] = (
        f"WITH {FOUND}, pairs AS ({PAIRS}), cuts AS (SELECT p.*, string_split(d.text, p.entity) AS ps FROM pairs p JOIN src d"
        " ON d.id = p.id), seq AS (SELECT id, entity, entity_type, unnest(ps) AS g, generate_subscripts(ps, 1) AS i FROM cuts),"
        " pos AS (SELECT *, sum(length(g) + length(entity)) OVER (PARTITION BY id, entity, entity_type ORDER BY i)"
        " - length(entity) AS e, max(i) OVER (PARTITION BY id, entity, entity_type) AS n FROM seq)"
        " SELECT id AS doc_id, CAST(e AS INT) AS start, CAST(e + length(entity) AS INT) AS \"end\", entity_type,"
        " CAST(0.5 AS DOUBLE) AS score, entity AS text FROM pos WHERE i < n"
    )
    sql["mask_model_answers"] = (
        f"SELECT doc_id, CASE WHEN doc_id % 10 NOT IN (3, 7) THEN masked END AS masked,"
        f" CASE WHEN doc_id % 10 IN (3, 7) THEN 'no findings' END AS error FROM ({sql['mask_redact']}) m"
    )
    model_rule = ("PERSON", r"[A-Z][a-z]+ [A-Z][a-z]+", "0.85", "true")
    sql["detect_with_model"] = (
        f"WITH {DOCS},\n{matches_cte('src', [model_rule])} SELECT id AS doc_id, {MATCH_COLUMNS} FROM raw"
    )
    sql["extract_text_job"] = (
        f"SELECT page_id, CASE page_id % 3 WHEN 2 THEN NULL ELSE {NORMALIZED.replace('(text,', '(html,')} END AS text,"
        " CASE page_id % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' END AS extractor,"
        " CASE page_id % 3 WHEN 2 THEN 'no extractor gave text' END AS error,"
        " CASE page_id % 3 WHEN 2 THEN 'second: not this format' END AS reasons FROM pages"
    )
    sql["gazetteer_join"] = (
        f"WITH {LEASES}, {terms_cte()} SELECT id AS c_custkey, start, \"end\", entity_type, text FROM named"
    )
    sql["mask_all"] = (
        f"WITH {LEASED},\n{terms_cte()},\n{matches_cte('src', prefix='pattern')},\n"
        f"raw AS (SELECT id, {MATCH_COLUMNS} FROM pattern UNION ALL SELECT id, {MATCH_COLUMNS} FROM named),\n"
        f"{resolved_cte()},\n{masked_cte(REDACTED)} SELECT id AS doc_id, masked FROM masked"
    )
    half = terms_cte().replace("FROM customer UNION", "FROM customer WHERE CAST(right(c_name, 1) AS INT) % 2 = 0 UNION", 1)
    sql["detection_scores"] = (
        f"WITH {LEASED},\n{half},\n{matches_cte('src', prefix='pattern')},\n"
        f"raw AS (SELECT id, {MATCH_COLUMNS} FROM pattern UNION ALL SELECT id, {MATCH_COLUMNS} FROM named),\n{resolved_cte()},\n"
        "found AS (SELECT * FROM kept WHERE entity_type IN ('PERSON', 'ORGANIZATION', 'LOCATION')),"
        " facts AS (SELECT s.id, length(s.text) AS n, length(c_name) AS c, length(n_name) AS k FROM src s JOIN customer"
        " ON c_custkey = s.id % (SELECT count(*) FROM customer) JOIN nation ON n_nationkey = c_nationkey),"
        " known AS (SELECT id, 'PERSON' AS entity_type, 8 AS a, 8 + c AS b FROM facts"
        " UNION ALL SELECT id, 'ORGANIZATION', c + 19, c + 19 + k + 12 FROM facts"
        " UNION ALL SELECT id, 'PERSON', n - k - c - 3, n - k - 3 FROM facts UNION ALL SELECT id, 'LOCATION', n - k - 1, n - 1 FROM facts),"
        " hits AS (SELECT f.entity_type, count(*) AS r FROM found f JOIN known k ON k.id = f.id AND k.entity_type = f.entity_type"
        " AND f.start < k.b AND k.a < f.\"end\" WHERE (least(f.\"end\", k.b) - greatest(f.start, k.a))"
        " / (greatest(f.\"end\", k.b) - least(f.start, k.a)) > 0.5 GROUP BY 1),"
        " f AS (SELECT entity_type, count(*) AS n FROM found GROUP BY 1), k AS (SELECT entity_type, count(*) AS n FROM known GROUP BY 1)"
        " SELECT k.entity_type, coalesce(f.n, 0) AS found, k.n AS known, coalesce(r, 0) AS \"right\","
        " CASE WHEN f.n > 0 THEN coalesce(r, 0) / f.n END AS precision, coalesce(r, 0) / k.n AS recall"
        " FROM k LEFT JOIN f ON f.entity_type = k.entity_type LEFT JOIN hits h ON h.entity_type = k.entity_type"
    )
    some = [r for r in RULES if r[0] in ("CREDIT_CARD", "PHONE_NUMBER")]
    sql["preserve_roundtrip"] = (
        f"WITH {DOCS},\n{matches_cte('src', some)} SELECT id AS doc_id, text, true AS valid, true AS alike,"
        " id IN (SELECT id FROM raw) AS changed FROM src"
    )
    made = "epoch(CASE d.doc_id % 3 WHEN 0 THEN TIMESTAMP '2024-03-01' WHEN 1 THEN TIMESTAMP '2024-08-01' ELSE TIMESTAMP '2025-02-01' END)"
    tokens = (
        "tokens AS (SELECT k.id, lang, CAST(row_number() OVER (PARTITION BY k.id ORDER BY k.start) - 1 AS INT) AS n,"
        f" CAST({made} AS BIGINT) AS made FROM kept k JOIN documents d ON d.doc_id = k.id),"
        " versions AS (SELECT l AS lang, CAST(epoch(t) AS BIGINT) AS since FROM (VALUES ('en'), ('de'), ('fr'), ('es')) x(l),"
        " (VALUES (TIMESTAMP '2024-01-01'), (TIMESTAMP '2024-07-01'), (TIMESTAMP '2025-01-01')) y(t)"
        " WHERE NOT (l = 'es' AND t = TIMESTAMP '2024-01-01')),"
        " aged AS (SELECT t.id, t.n, t.made, v.since FROM tokens t ASOF LEFT JOIN versions v ON v.lang = t.lang AND t.made >= v.since)"
    )
    sql["key_versions"] = f"WITH {FOUND}, {tokens} SELECT id AS doc_id, n, made, since AS valid_from FROM aged"
    sql["rotate_keys"] = (
        f"WITH {FOUND}, {tokens}, told AS (SELECT id, count(*) AS f, count(since) AS g FROM aged GROUP BY id)"
        " SELECT s.id AS doc_id, CAST(coalesce(f, 0) AS INT) AS markers_found, CAST(coalesce(g, 0) AS INT) AS markers_decrypted,"
        " CASE WHEN coalesce(f, 0) = coalesce(g, 0) THEN s.text END AS text FROM src s LEFT JOIN told t ON t.id = s.id"
    )
    sql["read_text_files"] = (
        "SELECT coalesce(source, 'none') AS source, CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS n_chars,"
        " false AS returns, CAST(NULL AS VARCHAR) AS error FROM documents GROUP BY 1"
    )
    sql["sft_train_rows"] = (
        f"WITH {FOUND}, en AS (SELECT id, {entities_json} AS j FROM kept GROUP BY id)"
        f" SELECT {PROMPT.format(text='d.text')} AS user_content, coalesce(en.j, '[]') AS assistant_content"
        f" FROM (SELECT id AS doc_id, id, text FROM src) d LEFT JOIN en ON en.id = d.id WHERE {SPLIT} = 'train'"
    )
    sql["stream_mask"] = f"WITH {FOUND},\n{masked_cte(ANONYMIZED)} SELECT id AS doc_id, masked FROM masked"
    sql["stream_windows"] = (
        "WITH m AS (SELECT date_trunc('hour', ts) AS w, event_id FROM events), closed AS (SELECT * FROM m"
        " WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)"
        " SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, entity_type, count(*) AS findings, count(*) AS documents FROM ("
        "SELECT w, 'IP_ADDRESS' AS entity_type FROM closed UNION ALL SELECT w, 'EMAIL_ADDRESS' FROM closed WHERE event_id % 4 = 0)"
        " GROUP BY 1, 2"
    )
    sql["protect_by_source"] = (
        f"WITH {FOUND} SELECT source, count(*) AS documents, CAST(sum(coalesce(n, 0)) AS BIGINT) AS spans,"
        " count(*) FILTER (WHERE n > 0) AS masked_documents FROM documents d LEFT JOIN"
        " (SELECT id, count(*) AS n FROM kept GROUP BY id) c ON c.id = d.doc_id GROUP BY source"
    )
    return sql
