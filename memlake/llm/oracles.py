"""SQL twins (DuckDB) of the queries of this folder, where SQL can express them."""

from __future__ import annotations

import string
from html.entities import html5

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

OP7 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reached r JOIN edges e ON e.a = r.b
), named AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, named.component_id, d.doc_id = named.component_id AS kept
FROM documents d JOIN named USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

def _references() -> str:
    """The characters of all names (those of blanks as a blank), as a map."""
    named = {name[:-1]: char for name, char in html5.items() if name.endswith(";")} | dict.fromkeys(("nbsp", "NonBreakingSpace", "Tab", "NewLine"), " ")
    quoted = [text.replace("'", "''") for text in named.values()]
    return f"MAP {{{', '.join(f"'{name}': '{char}'" for name, char in zip(named, quoted))}}}"


_WINDOWS = ", ".join(f"{n}: '{bytes([n]).decode('cp1252')}'" for n in range(128, 160) if bytes([n]).decode("cp1252", "ignore"))
# One piece of a text cut at the ampersands, with the reference it begins with (without one: the ampersand).
_PIECE = f"""list_transform([regexp_extract(piece, '^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);', 1)], lambda name:
  list_transform([CASE WHEN name LIKE '#%' THEN regexp_replace(lower(name), '^#x?0*', '') END], lambda digits:
    list_transform([CASE WHEN length(digits) > 8 OR digits = '' THEN 0 WHEN lower(name) LIKE '#x%' THEN ('0x' || digits)::BIGINT ELSE digits::BIGINT END], lambda n:
      coalesce(CASE WHEN name LIKE '#%' THEN
        CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n < 32 OR n = 160 THEN ' '
          ELSE coalesce(MAP {{{_WINDOWS}}}[n], chr(n::INTEGER)) END
        WHEN name <> '' THEN m[name] END || substr(piece, length(name) + 2), '&' || piece))[1])[1])[1]"""


def _plain(html: str) -> str:
    """The visible text of a page but for its references, step by step."""
    unseen = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|[\x00-\x1F]+"
    block = r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header|title|blockquote|pre)\b[^>]*>"
    steps = [(unseen, "' '"), (r"(?is)<head\b.*?</head\s*>", "' '"), (r"(?is)<noscript\b.*?</noscript\s*>", "' '")]
    for pattern, by in [*steps, (block, "chr(10)"), ("<[a-zA-Z/!?][^>]*>", "''")]:
        html = f"regexp_replace({html}, '{pattern}', {by}, 'g')"
    return html


def _trimmed(text: str) -> str:
    for pattern, by in ((" *\\n[ \\n]*", "chr(10)"), (" +", "' '"), ("^[ \\n]+|[ \\n]+$", "''")):
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    return text


def _uuid(kind: str) -> str:
    key = f"md5('{kind}' || chr(0) || coalesce(page_id::VARCHAR, '') || chr(0) || coalesce(url, '') || chr(0) || warc_date || chr(0) || block_digest)"
    cut = " || '-' || ".join(f"substr({key}, {start}, {size})" for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {cut} || '>'"


OP3 = f"""
WITH pages2 AS (
  SELECT page_id, url, coalesce(html, '') AS html, '2024-01-01T00:00:00Z' AS warc_date FROM pages
), heads AS (
  SELECT *, ['HTTP/1.1 200 OK', 'Content-Type: text/html; charset=utf-8', 'Content-Length: ' || strlen(html)] AS lines FROM pages2
), digests AS (
  SELECT *, array_to_string(lines, E'\\r\\n') AS source_headers, 'sha256:' || sha256(html) AS source_digest,
    'sha256:' || sha256(array_to_string(lines, E'\\r\\n') || E'\\r\\n' || E'\\r\\n' || html) AS block_digest FROM heads
), named AS (
  SELECT *, {_uuid("response")} AS refers_to, {_uuid("metadata")} AS metadata_id, {_uuid("conversion")} AS conversion_id,
    string_split({_plain("html")}, '&') AS pieces FROM digests
), names AS (SELECT {_references()} AS m
), decoded AS (
  SELECT *, {_trimmed("pieces[1] || array_to_string(list_transform(pieces[2:], lambda piece: " + _PIECE + "), '')")} AS plain FROM named CROSS JOIN names
), records AS (
  SELECT *, 'metadata' AS warc_type, metadata_id AS record_id, 'application/warc-fields' AS content_type,
    'source-record: ' || refers_to || E'\\r\\n' || 'source-block-digest: ' || block_digest || E'\\r\\n' || 'source-payload-digest: ' || source_digest
      || E'\\r\\n' || 'conversion-record: ' || conversion_id || E'\\r\\n'
      || array_to_string(list_transform(lines, lambda x: 'source-header: ' || x || E'\\r\\n'), '') AS block FROM decoded
  UNION ALL
  SELECT *, 'conversion', conversion_id, 'text/plain; charset=utf-8', plain FROM decoded
)
SELECT page_id, warc_type, record_id, refers_to, url AS target_uri, warc_date, content_type, strlen(block) AS content_length,
  'sha256:' || sha256(block) AS block_digest, CASE WHEN warc_type = 'conversion' THEN 'sha256:' || sha256(block) END AS payload_digest,
  source_digest, source_headers, block
FROM records
"""

# Base phrases, then the notices added to them.
_PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
_NOTICES = [
    *_PHRASES.items(),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial license"),
    ("gpl", "licensed under the gnu general public license version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license"),
]
_TEMPLATE_ROWS = ", ".join(f"('{label}', {sorted(set(text.split()))})" for label, text in _NOTICES)
_PHRASE_PLACES = " UNION ALL ".join(
    f"SELECT rid, '{label}' AS label, i - 1 AS place FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM words) "
    f"WHERE w[i:i + {len(text.split()) - 1}] = {text.split()}"
    for label, text in _PHRASES.items()
)

OP4 = rf"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), templates(label, words) AS (VALUES {_TEMPLATE_ROWS}
), phrases AS ({_PHRASE_PLACES}
), base AS (
  SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM phrases GROUP BY rid
), placed AS (
  SELECT rid, unnest(range(len(w))) AS i, unnest(w) AS word FROM words
), hits AS (
  SELECT rid, i, word, label, words FROM placed JOIN templates ON list_contains(words, word)
), shared AS (
  SELECT a.rid, a.i, a.label, a.words, count(DISTINCT b.word) AS c
  FROM hits a JOIN hits b ON a.rid = b.rid AND a.words = b.words AND b.i BETWEEN a.i AND a.i + 31 GROUP BY a.rid, a.i, a.label, a.words
), held AS (
  SELECT rid, label, c / len(words) AS share FROM shared WHERE 100 * c >= 80 * len(words)
), method AS (
  SELECT rid, max(share) AS score, list(DISTINCT label) AS labels FROM held GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(string_split(base_labels, ','), labels))), ',') AS labels, coalesce(score, 0) AS score
FROM words LEFT JOIN base USING (rid) LEFT JOIN method USING (rid)
"""

def _host(url: str) -> str:
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{upper}', '{lower}')"


def _path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"


def _normal(url: str) -> str:
    host = f"regexp_replace({_host(url)}, '^(www|m)\\.', '')"
    path = f"regexp_replace({_path(url)}, '(/index)?(\\.html?)?/*$', '')"
    query = f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^?#]*\\?([^#]*)', 1)"
    query = f"regexp_replace(regexp_replace({query}, '(^|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&', '')"
    return f"CASE WHEN {host} <> '' THEN 'https://' || {host} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"


def _link(tag: str, value: str) -> str:
    """A whole address of what a tag names."""
    link = f"regexp_extract(regexp_extract(coalesce(html, ''), '{tag}'), '{value}', 1)"
    scheme = "regexp_extract(url, '(?s)^(.*?)://', 1)"
    return (
        f"CASE WHEN contains({link}, '://') THEN {link} WHEN starts_with({link}, '//') THEN {scheme} || ':' || {link} "
        f"WHEN starts_with({link}, '/') THEN {scheme} || '://' || {_host('url')} || {link} END"
    )


_CANONICAL = _link("(?is)<link\\b[^>]*\\brel\\s*=\\s*[\"'']?canonical\\b[^>]*>", "(?is)\\bhref\\s*=\\s*[\"'']?([^\"''\\s>]+)")
_REFRESH = _link("(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*[\"'']?refresh\\b[^>]*>", "(?is)\\burl\\s*=\\s*[\"'']?([^\"''\\s>;]+)")


def _rule(host: str, path: str, what: int) -> str:
    """Rule text (0) or verdict (1) of the longest rule that fits."""
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    cases = "".join(
        f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, v)[what]}' "
        for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))
    )
    return f"CASE {cases}END"


OP5 = f"""
WITH RECURSIVE found AS (
  SELECT url AS a, unnest([{_normal("url")}, {_CANONICAL}, {_REFRESH}]) AS b FROM pages WHERE contains(url, '://')
), linked AS (
  SELECT a, b FROM found WHERE b IS NOT NULL UNION SELECT b, {_normal("b")} FROM found WHERE b IS NOT NULL
), edges AS (
  SELECT a, b FROM linked WHERE a <> b AND b IS NOT NULL UNION SELECT b, a FROM linked WHERE a <> b AND b IS NOT NULL
), reached AS (
  SELECT DISTINCT a, a AS b FROM edges UNION SELECT r.a, e.b FROM reached r JOIN edges e ON e.a = r.b
), judged AS (
  SELECT a, {_rule(_host("b"), _path("b"), 1)} AS verdict FROM reached
), blocked AS (
  SELECT a AS url FROM judged GROUP BY a HAVING bool_or(verdict = 'block') AND NOT coalesce(bool_or(verdict = 'allow'), false)
), parts AS (
  SELECT page_id, url, {_host("url")} AS host, {_path("url")} AS path FROM pages
)
SELECT page_id, host, path, {_rule("host", "path", 0)} AS rule,
  coalesce({_rule("host", "path", 1)}, CASE WHEN blocked.url IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN {_rule("host", "path", 1)} IS NOT NULL THEN 'rule' WHEN blocked.url IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM parts LEFT JOIN blocked USING (url)
"""

# Kind, expression and least length, as in the contract and the rules added to it.
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_LABEL = "([A-Z0-9]+ )*PRIVATE KEY( BLOCK)?-----"
_FIELDS = (
    r"(Proc-Type|DEK-Info|Version|Comment|MessageID|Hash|Charset):(-?-?-?-?[^\r\n-])*[\r\n]",
    r"(Proc-Type:\x20*[0-9]+,[A-Z]+|DEK-Info:\x20*[A-Z0-9]+(-[A-Z0-9]+)*(,[0-9A-Fa-f]+)?)[\x09-\x0D\x20\\]",
)
_BODY = rf"([\x09-\x0D\x20\\nr]*({'|'.join(_FIELDS)}))*[A-Za-z0-9+/=\x09-\x0D\x20\\]*"
_KINDS = [
    ("assign", _ASSIGN, 1),
    ("access", "AKIA[A-Z0-9]+", 16),
    ("hex", "[0-9a-f]+", 32),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    ("google", "AIza[A-Za-z0-9_-]+", 39),
    ("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 40),
    ("private_key", f"-----BEGIN {_LABEL}((-?-?-?-?[^-])*-----END {_LABEL}|{_BODY})", 1),
]


def _hits(number: int, kind: str, expression: str, least: int) -> str:
    quoted = expression.replace("'", "''")
    return f"""
  SELECT rid, {number} AS k, '{kind}' AS kind, {least} AS least, string_split_regex(t, '{quoted}') AS between,
    regexp_extract_all(t, '{quoted}') AS hits FROM texts WHERE regexp_matches(t, '{quoted}')"""


OP6 = f"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), found AS ({" UNION ALL ".join(_hits(i, *kind) for i, kind in enumerate(_KINDS))}
), placed AS (
  SELECT rid, k, kind, least, unnest(range(1, len(hits) + 1)) AS i, between, hits FROM found
), spans AS (
  SELECT rid, k, kind, hits[i] AS hit, least,
    list_sum(list_transform(between[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
  FROM placed
), kept AS (
  SELECT rid, k, start, kind || ':' || start || ':' || (start + length(hit)) AS span FROM spans
  WHERE length(hit) >= least
    AND (k > 0 OR length(regexp_extract(hit, '{_ASSIGN.replace("'", "''")}', 2)) >= 8)
)
SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, k) FILTER (k <= 2), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, k), '') AS spans, count(span) AS n_spans
FROM texts LEFT JOIN kept USING (rid) GROUP BY rid, doc_id
"""



def _nibble_table() -> list[int]:
    """Remainders of the four-bit numbers by the CRC-32 polynomial, lowest bit first."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


def _crc_step(crc: str, value: str) -> str:
    return f"xor(({crc}) >> 4, list_extract(CAST({_nibble_table()} AS BIGINT[]), (xor({crc}, {value}) & 15) + 1))"


# crc32 of the id as text.
CRC32 = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), "
    "lambda x: ascii(x)::BIGINT)), lambda c, b: " + _crc_step(_crc_step("c", "b"), "(b >> 4)") + "), 4294967295)"
)

# N-grams as (a << 42) + (b << 21) + c; 2097151 stands after the end of shorter ones.
OP10 = """
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, {crc32} % 4 = 2 AS held, lower(coalesce(text, '')) AS t FROM documents
), codes AS (
  SELECT rid, doc_id, lang, held, list_concat([0::BIGINT], list_transform(string_split(t, ''),
    lambda x: CASE WHEN regexp_matches(x, '^\\p{L}$') THEN unicode(x)::BIGINT ELSE 0 END), [0::BIGINT]) AS c FROM texts
), spots AS (
  SELECT rid, unnest(range(1, len(c) + 1)) AS i, c FROM codes
), grams AS (
  SELECT rid, (c[i] << 42) + (2097151::BIGINT << 21) + 2097151 AS g FROM spots WHERE c[i] > 0
  UNION ALL
  SELECT rid, (c[i] << 42) + (c[i + 1] << 21) + 2097151 FROM spots WHERE i < len(c) AND (c[i] > 0 OR c[i + 1] > 0)
  UNION ALL
  SELECT rid, (c[i] << 42) + (c[i + 1] << 21) + c[i + 2] FROM spots WHERE i + 1 < len(c) AND c[i + 1] > 0
), counted AS (
  SELECT rid, g, count(*) AS n FROM grams GROUP BY rid, g
), own AS (
  SELECT rid, g, row_number() OVER (PARTITION BY rid ORDER BY n DESC, g) - 1 AS place FROM counted
  QUALIFY place < 300
), learned AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) - 1 AS place
  FROM counted JOIN codes USING (rid) WHERE NOT held AND lang IS NOT NULL GROUP BY lang, g QUALIFY place < 300
), languages AS (
  SELECT DISTINCT lang FROM learned
), distances AS (
  SELECT rid, l.lang, sum(CASE WHEN k.place IS NULL THEN 300 ELSE abs(k.place - own.place) END)::BIGINT AS d, count(*) * 300 AS most
  FROM own CROSS JOIN languages l LEFT JOIN learned k ON k.lang = l.lang AND k.g = own.g GROUP BY rid, l.lang
), best AS (
  SELECT rid, lang, (most - d) / most AS score FROM distances
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, lang) = 1
)
SELECT doc_id, held AS held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(score, 0) AS score
FROM codes LEFT JOIN best USING (rid)
""".replace("{crc32}", CRC32)

OP9 = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * r.v[i]))::BIGINT AS score
  FROM usable q JOIN usable r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


def _rounds(count: int) -> str:
    """Assignment a0, centroids c1, assignment a1, ... as common table expressions."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT"
    steps = []
    for i in range(count + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
  SELECT rid, vec_id, v, cluster, {distance} AS distance FROM vecs CROSS JOIN c{i}
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1
)"""
        )
        if i < count:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
  WITH parts AS (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{i}),
  sums AS (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM parts GROUP BY cluster, i),
  means AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sums GROUP BY cluster)
  SELECT cluster, coalesce(means.c, c{i}.c) AS c FROM c{i} LEFT JOIN means USING (cluster)
)"""
            )
    return ", ".join(steps)


OP11 = f"""
WITH vecs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS cluster, v AS c FROM vecs WHERE vec_id IS NOT NULL
  QUALIFY cluster < 40
), {_rounds(5)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a5 JOIN c5 USING (cluster)
"""

OP12 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), failing AS (
  SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM texts
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), groups AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.b | b.b | c.b | d.b | e.b = 31
), steps AS (
  SELECT filter_order, step::INTEGER AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
  FROM orders, range(1, 6) AS r(step)
), figures AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (mask & (before | own) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost
  FROM groups, steps GROUP BY part, filter_order, step, own
)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM figures
"""

ORACLES: dict[str, str] = {
    "op3_warc_derivatives": OP3,
    "op4_license_join": OP4,
    "op5_redirect_verdicts": OP5,
    "op6_secret_scan": OP6,
    "op7_minmax_near_dedup": OP7,
    "op9_mtree_top_products": OP9,
    "op10_rank_order_language": OP10,
    "op11_simplex_clusters": OP11,
    "op12_filter_survival": OP12,
}
