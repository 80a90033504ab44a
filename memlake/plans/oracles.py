"""The queries of ``catalog.py`` as plain SQL on the given tables."""

from __future__ import annotations

from memlake.functions import guard
from memlake.plans import fixtures as fx
from memlake.plans.catalog import AFTER_MS, BEFORE_MS, K

BASE, HOUR, MINUTE, NOW = fx.BASE_MS, fx.HOUR_MS, fx.MINUTE_MS, fx.NOW_MS
DAY = 24 * HOUR
CUTOFF = NOW - 28 * DAY
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
HAN = r"[\x{4E00}-\x{9FA5}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}]"
SPACE = r"[\t\n\x{0b}\f\r\x{85}\p{Z}]"
SEP = "chr(10) || '§' || chr(10)"


def iso(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"


def trimmed(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def tokens(text: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(regexp_replace({text}, '({HAN})', ' \\1 ', 'g'))), '{TOKEN}')"


# --- input tables ------------------------------------------------------------------

TURNS = f"""turns AS (
  SELECT conv_id * 1000 + turn AS turn_id, 'conv-' || conv_id AS session_id, 'p' || (conv_id % 3) AS profile_id,
         turn + 1 AS seq, {BASE} + conv_id * {HOUR} + CASE WHEN role = 'system' THEN 0 ELSE turn * {MINUTE} END AS timestamp_ms,
         role, text AS content, substring(text, 1, 200) AS preview, strlen(text) AS char_count, length(text) AS n_chars,
         conv_id, turn,
         CASE WHEN role = 'assistant' THEN length(text) END AS input_tokens,
         CASE WHEN role = 'assistant' AND turn % 4 <> 3 THEN turn + 1 END AS output_tokens
  FROM conversations)"""

# Turns as archived, and as a store holds them: some changed, lost or in another profile.
ALTERED = """archived AS (SELECT * FROM turns WHERE NOT (conv_id % 10 = 4 AND seq = 3)),
  stored AS (SELECT * REPLACE (CASE WHEN conv_id % 10 = 1 AND seq = 2 THEN content || '!' ELSE content END AS content,
                               CASE WHEN conv_id % 10 = 3 THEN 'elsewhere' ELSE profile_id END AS profile_id), profile_id AS old
             FROM turns WHERE NOT (conv_id % 10 = 2 AND seq = 1))"""

# One profile's documents alone.
PROFILE_TURNS = f"""turns AS (
  SELECT doc_id AS turn_id, source AS session_id, {BASE} + doc_id * {MINUTE} AS timestamp_ms, lang AS role,
         text AS content, substring(text, 1, 200) AS preview
  FROM documents WHERE doc_id % 3 = 1)"""

SPOKEN_TURNS = TURNS.replace("FROM conversations)", "FROM conversations WHERE role <> 'system')")

DOCUMENT_TURNS = f"""turns AS (
  SELECT doc_id AS turn_id, source AS session_id, {BASE} + doc_id * {MINUTE} AS timestamp_ms, lang AS role,
         text AS content, substring(text, 1, 200) AS preview
  FROM documents)"""


def sessions(strict: bool = False, source: str = "turns", name: str = "sessions") -> str:
    both = "input_tokens + output_tokens" if strict else "greatest(coalesce(input_tokens, 0) + coalesce(output_tokens, 0), 0)"
    last = "arg_max(role, seq)"
    end = f"{BASE} + conv_id * {HOUR} + (arg_max(seq, seq) - 1) * {MINUTE}"
    fallback = f"{BASE} + conv_id * {HOUR}" if strict else "NULL"
    return f"""{name} AS (
  SELECT session_id, {BASE} + conv_id * {HOUR} AS start_ts,
         CASE WHEN {last} = 'system' THEN {fallback} ELSE {end} END AS end_ts,
         'About ' || conv_id AS title, 'p' || (conv_id % 3) AS profile_id, 'src' || (conv_id % 5) AS source,
         count(*) AS turn_count, CAST(sum(coalesce({both}, 0)) AS BIGINT) AS total_tokens,
         CASE WHEN conv_id % 2 = 0 THEN '["even","' || (SELECT role FROM turns f WHERE f.conv_id = t.conv_id AND f.turn = 0) || '"]' END AS tags,
         session_id || '.jsonl' AS file_path
  FROM {source} t GROUP BY session_id, conv_id)"""


SESSION_COLUMNS = "session_id, start_ts, end_ts, title, profile_id, source, turn_count, total_tokens, tags"

INDEX = f"""toks AS (SELECT turn_id, timestamp_ms, role, {tokens('content')} AS tokens FROM turns),
words AS (SELECT turn_id, len(tokens) AS dl, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS position FROM toks),
postings AS (SELECT term, turn_id, dl, count(*) AS tf, list(position ORDER BY position) AS positions FROM words GROUP BY ALL),
corpus AS (SELECT count(*) AS n, sum(len(tokens)) / count(*) AS avgdl FROM toks),
stats AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""


INDEX_OF_TOKENS = INDEX[INDEX.index("words AS") :]


def bm25(df: str = "df", tf: str = "tf", dl: str = "dl") -> str:
    ratio = f"ln((n - {df} + 0.5) / ({df} + 0.5))"
    idf = f"CASE WHEN {ratio} > 0 THEN {ratio} ELSE 1e-6 END"
    return f"({idf}) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * {dl} / avgdl))"


def values(*texts: str) -> str:
    rows = ", ".join(f"({i}, '{text}')" for i, text in enumerate(texts, 1))
    return f"queries AS (SELECT * FROM (VALUES {rows}) AS v(query_id, text))"


BENCHMARK = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"

QUERY_TERMS = f"""asked AS (SELECT query_id, unnest({tokens('text')}) AS term FROM queries),
terms AS (SELECT query_id, term, count(*) AS weight FROM asked GROUP BY ALL),
sizes AS (SELECT query_id, count(*) AS n_terms FROM terms GROUP BY query_id)"""


def scores(every: bool = True) -> str:
    rule = "HAVING count(*) = any_value(n_terms)" if every else ""
    return f"""scores AS (
  SELECT query_id, turn_id, round(sum(weight * {bm25()}), 6) AS score
  FROM terms JOIN sizes USING (query_id) JOIN postings USING (term) JOIN stats USING (term), corpus
  GROUP BY query_id, turn_id {rule})"""


def best(source: str, k: int, order: str = "score DESC, turn_id") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank
  FROM {source} QUALIFY rank <= {k}"""


def keyword(corpus: str, queries: str, every: bool = True, where: str = "", k: int = K) -> str:
    kept = f"kept AS (SELECT s.* FROM scores s JOIN turns USING (turn_id) {where})"
    return f"WITH {corpus}, {INDEX}, {queries}, {QUERY_TERMS}, {scores(every)}, {kept} {best('kept', k)}"


CONTEXT = "query_id, turn_id, score, rank, preview, session_id, timestamp_ms, role"

VECTORS = """vectors AS (
  SELECT vec_id AS turn_id, label,
         list_transform(embedding, lambda x: CAST(round(greatest(-1, least(1, x)) * 127::FLOAT) AS INTEGER)) AS q8
  FROM embeddings)"""

LABEL_QUERIES = """parts AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, avg(x) AS x FROM parts GROUP BY ALL),
lengths AS (SELECT label, sqrt(sum(x * x)) AS length FROM means GROUP BY label),
centres AS (
  SELECT label AS query_id,
         list(CAST(round(greatest(-1, least(1, round(x / length, 6)::FLOAT)) * 127::FLOAT) AS INTEGER) ORDER BY i) AS q8
  FROM means JOIN lengths USING (label) GROUP BY label)"""

L2 = "round(list_distance(a.q8::DOUBLE[], b.q8::DOUBLE[]), 6)"
COSINE = "round(1 - list_cosine_similarity(a.q8::DOUBLE[], b.q8::DOUBLE[]), 6)"


def nearest(queries: str, k: int, distance: str = L2, source: str = "vectors") -> str:
    return f"""SELECT a.query_id, b.turn_id, {distance} AS distance,
       row_number() OVER (PARTITION BY a.query_id ORDER BY {distance}, b.turn_id) AS rank
  FROM {queries} a, {source} b QUALIFY rank <= {k}"""


def text_vectors(source: str = "SELECT turn_id, content FROM turns", name: str = "") -> str:
    """Hashed term counts of texts, scaled to length 1, as whole numbers."""
    slot = "CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 384"
    whole = "CAST(round(greatest(-1, least(1, (coalesce(c, 0) / length)::FLOAT)) * 127::FLOAT) AS INTEGER)"
    return f"""{name}slots AS (
  SELECT turn_id, {slot} AS slot, count(*) AS c
  FROM (SELECT turn_id, unnest({tokens('content')}) AS term FROM ({source})) GROUP BY ALL),
{name}grid AS (SELECT turn_id, unnest(range(384)) AS slot FROM ({source})),
{name}lengths AS (SELECT turn_id, coalesce(nullif(sqrt(sum(c * c)), 0), 1) AS length FROM {name}grid LEFT JOIN {name}slots USING (turn_id, slot) GROUP BY turn_id),
{name}text_vectors AS (
  SELECT turn_id, list({whole} ORDER BY slot) AS q8
  FROM {name}grid LEFT JOIN {name}slots USING (turn_id, slot) JOIN {name}lengths USING (turn_id) GROUP BY turn_id)"""


SCAN_TEXTS = f"""texts AS (
  SELECT doc_id, source, text || CASE doc_id % 40 WHEN 0 THEN '{fx.INJECTION_TEXT}' WHEN 1 THEN '{fx.KEY_TEXT}'
         WHEN 2 THEN chr(8203) WHEN 3 THEN '{fx.HAN_INJECTION_TEXT}' ELSE '' END AS content
  FROM documents)"""


def issues(text: str) -> str:
    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    found = [
        f"CASE WHEN contains(lower({text}), {quoted(p)}) THEN {quoted(guard.INJECTION_FINDING.format(p))} END"
        for p in guard.INJECTION_PHRASES
    ]
    found += [
        f"CASE WHEN regexp_matches({text}, {quoted(p)}) THEN {quoted(guard.CREDENTIAL_FINDING.format(p))} END"
        for p in guard.CREDENTIAL_SHAPES
    ]
    found += [
        f"CASE WHEN contains({text}, chr({c})) THEN {quoted(guard.INVISIBLE_FINDING.format(c))} END"
        for c in guard.INVISIBLE_CODE_POINTS
    ]
    return f"list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)"


CANDIDATES = f"""{SCAN_TEXTS},
lines AS (SELECT doc_id, source, unnest(string_split(content, chr(10))) AS line,
                 generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i FROM texts),
candidates AS (
  SELECT source AS profile_id, CASE WHEN doc_id % 2 = 0 THEN 'memory' ELSE 'user' END AS target, doc_id AS ts,
         doc_id * 100000 + i AS entry_id, {trimmed('line')} AS content, length({trimmed('line')}) AS n_chars,
         array_to_string({issues('line')}, '; ') AS reason, line, i,
         CASE WHEN doc_id % 2 = 0 THEN 2200 ELSE 1375 END AS capacity,
         CASE WHEN doc_id % 5 <> 0 THEN 'conv-' || (doc_id % 150) END AS source_session,
         ['high', 'medium', 'low'][doc_id % 3 + 1] AS confidence
  FROM lines)"""

# The memories are filled entry by entry, in order.
ADMITTED = f"""{CANDIDATES},
placed AS (SELECT *, row_number() OVER (PARTITION BY profile_id, target ORDER BY ts, entry_id) AS pos FROM candidates),
walk AS (
  SELECT profile_id, target, 0::BIGINT AS pos, 0::BIGINT AS used, []::VARCHAR[] AS kept, 0::BIGINT AS entry_id, '' AS verdict
  FROM placed GROUP BY ALL
  UNION ALL
  SELECT profile_id, target, pos, CASE WHEN verdict = 'accepted' THEN used + n_chars + 3 ELSE used END,
         CASE WHEN verdict = 'accepted' THEN list_append(kept, content) ELSE kept END, entry_id, verdict
  FROM (
    SELECT p.*, w.used, w.kept,
           CASE WHEN p.reason <> '' THEN 'unsafe' WHEN p.content = '' THEN 'empty'
                WHEN list_contains(w.kept, p.content) THEN 'duplicate'
                WHEN w.used + p.n_chars > p.capacity THEN 'capacity' ELSE 'accepted' END AS verdict
    FROM walk w JOIN placed p ON p.profile_id = w.profile_id AND p.target = w.target AND p.pos = w.pos + 1)),
verdicts AS (
  SELECT p.*, w.verdict FROM placed p JOIN walk w USING (profile_id, target, pos) WHERE w.pos > 0),
accepted AS (SELECT * FROM verdicts WHERE verdict = 'accepted')"""

BODIES = f"""bodies AS (
  SELECT profile_id, target, capacity, string_agg(content, {SEP} ORDER BY pos) AS body FROM accepted GROUP BY ALL)"""

EVENTS = f"""{CANDIDATES},
events AS (
  SELECT profile_id, target, ts, entry_id AS event_id, capacity, source_session, confidence,
         CASE i % 7 WHEN 5 THEN 'update' WHEN 6 THEN 'remove' ELSE 'write' END AS op,
         regexp_extract(line, '^([^ ]*)', 1) AS word, content,
         CASE i % 7 WHEN 5 THEN len({issues("word || '+'")}) > 0 WHEN 6 THEN FALSE ELSE reason <> '' END AS has_issue
  FROM candidates),
placed AS (SELECT *, row_number() OVER (PARTITION BY profile_id, target ORDER BY ts, event_id) AS pos FROM events),
walk AS (
  SELECT profile_id, target, 0::BIGINT AS pos, []::STRUCT(t VARCHAR, born BIGINT, origin BIGINT)[] AS kept, '' AS verdict FROM placed GROUP BY ALL
  UNION ALL
  SELECT profile_id, target, pos, CASE WHEN verdict = 'accepted' THEN after ELSE kept END, verdict
  FROM (
    SELECT *, CASE
      WHEN has_issue THEN 'unsafe'
      WHEN op = 'write' AND content = '' THEN 'empty'
      WHEN op = 'write' AND list_contains(list_transform(kept, lambda e: e.t), content) THEN 'duplicate'
      WHEN op <> 'write' AND (word = '' OR len(list_filter(kept, lambda e: contains(e.t, word))) = 0) THEN 'not_found'
      WHEN op <> 'remove' AND length(array_to_string(list_transform(after, lambda e: e.t), {SEP})) > capacity THEN 'capacity'
      ELSE 'accepted' END AS verdict
    FROM (
      SELECT p.*, w.kept,
             CASE WHEN p.op = 'write' THEN list_append(w.kept, {{'t': p.content, 'born': p.pos, 'origin': p.pos}})
                  WHEN p.word = '' THEN w.kept
                  ELSE list_filter(list_transform(w.kept, lambda e: CASE WHEN contains(e.t, p.word) THEN
                         {{'t': {trimmed("replace(e.t, p.word, CASE WHEN p.op = 'update' THEN p.word || '+' ELSE '' END)")}, 'born': p.pos, 'origin': e.origin}}
                         ELSE e END), lambda e: e.t <> '')
             END AS after
      FROM walk w JOIN placed p ON p.profile_id = w.profile_id AND p.target = w.target AND p.pos = w.pos + 1))),
last_states AS (
  SELECT profile_id, target, arg_max(kept, pos) AS kept FROM walk GROUP BY ALL),
snapshot AS (
  SELECT profile_id, target, piece, e.t AS content, e.born AS born, e.origin AS origin
  FROM (SELECT profile_id, target, generate_subscripts(kept, 1) - 1 AS piece, unnest(kept) AS e FROM last_states))"""

SOURCES = """sources AS (
  SELECT session_id, 'src' || p AS profile_id, 'src' || p || '/' || session_id || '.jsonl' AS file_path
  FROM (SELECT DISTINCT session_id, unnest([conv_id % 20, (conv_id + 1) % 20]) AS p FROM turns))"""

TRACED = f"""{TURNS}, {SOURCES}, {CANDIDATES},
traced AS (SELECT c.*, s.file_path IS NOT NULL AS session_exists, s.file_path AS session_file_path
           FROM candidates c LEFT JOIN sources s ON s.session_id = c.source_session AND s.profile_id = c.profile_id)"""

IN_SYNC = """SELECT *, missing_in_index = 0 AND missing_in_archive = 0 AS in_sync FROM (
          SELECT count(a.session_id) AS archive_count, count(b.session_id) AS session_count,
                 count(*) FILTER (b.session_id IS NULL) AS missing_in_index, count(*) FILTER (a.session_id IS NULL) AS missing_in_archive
          FROM a FULL JOIN b USING (profile_id, session_id))"""

# Both profiles use the same session ids; the second one's rows follow.
def shared(kept: str) -> str:
    return f"shared AS (SELECT * FROM turns UNION ALL SELECT * REPLACE ('other' AS profile_id) FROM turns WHERE {kept})"


AUDIT = """audit AS (
  SELECT epoch_us(ts) // 1000 AS timestamp_ms, event_type AS action, CASE WHEN user_id % 2 = 0 THEN 'memory' ELSE 'user' END AS target,
         props AS detail, 'conv-' || user_id AS session_id
  FROM events)"""

HAN_TEXTS = f"""{TURNS}, mixed AS (
  SELECT turn_id, CASE turn % 4 WHEN 0 THEN '{fx.HAN_PREFIX}' || content WHEN 1 THEN content || '{fx.HAN_PREFIX}'
         WHEN 2 THEN 'a据b' || content ELSE content END AS text FROM turns),
chars AS (SELECT turn_id, text, regexp_extract_all(text, '(?s).') AS c FROM mixed),
spaced AS (
  SELECT turn_id, text, array_to_string(list_transform(range(1, len(c) + 1), lambda i: CASE
    WHEN i > 1 AND ((regexp_matches(c[i], '{HAN}') AND c[i - 1] <> ' ')
                    OR (NOT regexp_matches(c[i], '{HAN}') AND regexp_matches(c[i - 1], '{HAN}') AND c[i] <> ' '))
    THEN ' ' || c[i] ELSE c[i] END), '') AS spaced
  FROM chars)"""

SYSTEM_SESSIONS = "(SELECT session_id FROM turns WHERE role = 'system')"
PHRASES = f"""phrases AS (SELECT query_id, {tokens('text')} AS words FROM queries),
texts_of AS (SELECT turn_id, tokens, len(tokens) AS dl, ' ' || array_to_string(tokens, ' ') || ' ' AS joined FROM toks),
holding AS (
  SELECT query_id, turn_id, tokens, w FROM (SELECT query_id, words AS w FROM phrases)
  JOIN texts_of ON contains(joined, ' ' || array_to_string(w, ' ') || ' ')),
found AS (
  SELECT query_id, turn_id, words.dl, count(*) AS tf FROM holding JOIN words USING (turn_id)
  WHERE term = w[1] AND tokens[position + 1:position + len(w)] = w GROUP BY query_id, turn_id, words.dl)"""
UNITS = f"""units AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS df FROM found WHERE tf > 0),
scored AS (SELECT query_id, turn_id, round({bm25()}, 6) AS score FROM units, corpus)"""



def prefix(index: str, *texts: str) -> str:
    """All words but the last must occur; the last is a phrase whose end may go on."""
    asked = values(*texts)
    return f"""WITH {index}, {asked},
        split AS (SELECT query_id, {tokens("regexp_extract(text, '^(.*?)([^ ]*)$', 1)")} AS rest,
                         {tokens("regexp_extract(text, '^(.*?)([^ ]*)$', 2)")} AS w FROM queries),
        found AS (SELECT query_id, turn_id, words.dl, count(*) AS tf
                  FROM split JOIN words ON starts_with(term, w[-1]) JOIN toks USING (turn_id)
                  WHERE tokens[position + 2 - len(w):position] = w[:len(w) - 1] AND position + 1 >= len(w) GROUP BY query_id, turn_id, words.dl),
        units AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS df FROM found),
        unit_scores AS (SELECT query_id, turn_id, {bm25()} AS score FROM units, corpus),
        wanted AS (SELECT query_id, unnest(rest) AS term, len(list_distinct(rest)) AS n_terms FROM split),
        weights AS (SELECT query_id, term, any_value(n_terms) AS n_terms, count(*) AS weight FROM wanted GROUP BY query_id, term),
        rest_scores AS (
          SELECT query_id, turn_id, sum(weight * {bm25()}) AS score FROM weights JOIN postings USING (term) JOIN stats USING (term), corpus
          GROUP BY query_id, turn_id HAVING count(*) = any_value(n_terms)),
        scored AS (
          SELECT u.query_id, u.turn_id, round(u.score + coalesce(r.score, 0), 6) AS score
          FROM unit_scores u LEFT JOIN rest_scores r USING (query_id, turn_id) JOIN split USING (query_id)
          WHERE r.score IS NOT NULL OR len(rest) = 0)
        {best('scored', K)}"""


LABEL_WORDS = values("the of", "and with", "que", "in this", "der")
STREAM_ORACLES = {
    "stream_ingest_sessions": "rebuilt_sessions",
    "stream_scan": "scan_content",
    "stream_admit": "admit_entries",
    "stream_audit": "audit_events",
    "stream_replay": "memory_snapshot",
    "stream_audit_edits": "audit_edits",
}

AUDIT_ROWS = f"""WITH RECURSIVE {ADMITTED} SELECT ts AS timestamp_ms, 'write' AS action, target,
  substring(content, 1, 100) AS detail, source_session AS session_id FROM accepted"""

PAYLOADS = f"""payloads AS (
  SELECT 'conv-' || conv_id || '-' || turn AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'p' || (conv_id % 3) ELSE 'default' END AS profile_id,
         {BASE} + conv_id * {HOUR} + turn * {MINUTE} AS start, role, turn,
         unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM conversations)"""

ORACLES: dict[str, str] = {
    "build_turns": f"""WITH {TURNS} SELECT turn_id, content, session_id, profile_id, seq, timestamp_ms, role, preview,
        char_count, n_chars FROM turns""",
    "build_sessions_lenient": f"WITH {TURNS}, {sessions()} SELECT {SESSION_COLUMNS} FROM sessions",
    "build_sessions_strict": f"WITH {TURNS}, {sessions(True)} SELECT {SESSION_COLUMNS} FROM sessions",
    "assign_turn_ids": f"""WITH {TURNS} SELECT row_number() OVER (ORDER BY session_id, seq) AS turn_id, session_id, seq FROM turns""",
    "sessions_from_payload_turns": f"""WITH {PAYLOADS} SELECT session_id, profile_id, {iso('start')} AS start_time, i + 1 AS pos,
        CASE WHEN i % 4 = 3 THEN '' ELSE {iso('start + i * 1000')} END AS ts, i + 1 AS seq,
        CASE WHEN i % 3 = 1 THEN 'user' ELSE role END AS role, CASE WHEN i % 5 = 4 THEN '' ELSE line END AS content FROM payloads""",
    "sessions_from_payload_headers": f"""WITH {PAYLOADS} SELECT session_id, {iso('start')} AS start_time, profile_id,
        role || CASE WHEN turn > 1 THEN ',late' ELSE '' END AS tags FROM payloads WHERE i = 0""",
    "malformed_records": """WITH lines AS (
          SELECT event_type || '-' || user_id AS file_path, user_id, event_id AS place, CAST(json_extract(props, '$.k') AS BIGINT) > 90 AS broken
          FROM events),
        blocks AS (SELECT file_path, user_id, bool_or(broken) OR user_id % 10 = 9 AS bad FROM lines GROUP BY file_path, user_id)
        SELECT file_path, place, 'good' AS outcome FROM lines JOIN blocks USING (file_path) WHERE NOT bad
        UNION ALL SELECT file_path, place, 'bad turn' FROM lines WHERE broken
        UNION ALL SELECT file_path, -1, 'bad start time' FROM blocks WHERE user_id % 10 = 9""",
    "archive_round_trip": f"""WITH {TURNS} SELECT session_id, profile_id, {iso(f'{BASE} + conv_id * {HOUR}')} AS start_time,
        seq AS pos, CASE WHEN role = 'system' THEN 'n/a' ELSE {iso('timestamp_ms')} END AS ts, seq, role, content,
        CASE WHEN role = 'assistant' AND output_tokens IS NULL THEN '{{"usage":{{"input_tokens":' || input_tokens || '}}}}'
             WHEN role = 'assistant' THEN '{{"usage":{{"input_tokens":' || input_tokens || ',"output_tokens":' || output_tokens || '}}}}'
        END AS metadata FROM turns""",
    "rebuild_two_profiles": f"""WITH {TURNS}, both_profiles AS (
          SELECT profile_id, session_id, seq, role FROM turns
          UNION ALL SELECT 'other', session_id, seq, role FROM turns WHERE role <> 'system')
        SELECT *, count(*) OVER (PARTITION BY profile_id, session_id) AS turn_count FROM both_profiles""",
    "save_then_search": f"""SELECT 'all' AS profile, query_id, score, rank FROM ({keyword(SPOKEN_TURNS, values("the of", "and"))})
        UNION ALL SELECT 'p1', query_id, score, rank FROM ({keyword(SPOKEN_TURNS.replace("<> 'system'", "<> 'system' AND conv_id % 3 = 1"), values("the of", "and"))})""",
    "save_then_stats": f"""WITH {SPOKEN_TURNS}, {INDEX} SELECT term, df FROM stats
        UNION ALL SELECT '(n_sessions)', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT '(n_turns)', count(*) FROM turns
        UNION ALL SELECT '(n_vectors)', count(*) FROM turns UNION ALL SELECT '(created_at)', {NOW}""",
    "list_archive_days": f"""WITH {TURNS} SELECT DISTINCT strftime(make_timestamp(({BASE} + conv_id * {HOUR}) * 1000), '%Y-%m-%d') AS day
        FROM turns""",
    "import_archive": f"""WITH {TURNS},
        kept AS (SELECT * FROM turns WHERE role <> 'system'), {sessions(source='kept')}
        SELECT {SESSION_COLUMNS} FROM sessions""",
    "upsert_sessions": f"""WITH {TURNS} SELECT turn_id, session_id, seq, role, char_count FROM turns WHERE role <> 'system'""",
    "latest_version": f"""WITH {TURNS} SELECT turn_id, session_id, 1 AS version FROM turns WHERE session_id NOT IN {SYSTEM_SESSIONS}
        UNION ALL SELECT turn_id, session_id, 2 FROM turns WHERE role = 'user' AND session_id IN {SYSTEM_SESSIONS}""",
    "purge_orphans": "SELECT vec_id AS turn_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)",
    "refresh_postings": f"""WITH {TURNS.replace('turns AS', 'saved AS', 1)},
        turns AS (SELECT turn_id, timestamp_ms, role, CASE WHEN role = 'assistant' THEN 'edited ' ELSE '' END || content AS content
                  FROM saved WHERE role <> 'system'), {INDEX}
        SELECT term, turn_id, tf, dl FROM postings""",
    "vector_maintenance": """SELECT vec_id + CASE WHEN label % 2 = 0 THEN 1000000 ELSE 0 END AS turn_id, label FROM embeddings""",
    "count_vectors": """SELECT 'stored' AS state, count(*) AS n_vectors FROM embeddings UNION ALL SELECT 'cleared', 0""",
    "rebuild_stats": """SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS sessions_processed, count(*) AS turns_indexed,
        count(*) AS vectors_indexed, 0 AS n_errors FROM conversations""",
    "rebuilt_sessions": f"WITH {TURNS}, {sessions()} SELECT {SESSION_COLUMNS} FROM sessions",
    "index_stats": """SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS n_sessions,
        (SELECT count(*) FROM conversations) AS n_turns, (SELECT count(*) FROM embeddings) AS n_vectors""",
    "index_parity": f"""WITH {TURNS}, {INDEX}
        SELECT (SELECT count(*) FROM turns) AS n_turns,
          (SELECT count(*) FROM turns WHERE turn_id NOT IN (SELECT turn_id FROM postings)) AS without_postings,
          (SELECT count(*) FROM turns WHERE turn_id NOT IN (SELECT vec_id FROM embeddings)) AS without_vector,
          (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT turn_id FROM turns)) AS without_turn""",
    "check_consistency": f"""WITH {TURNS}, a AS (SELECT DISTINCT profile_id, session_id FROM turns),
        b AS (SELECT DISTINCT profile_id, session_id FROM turns WHERE role = 'system' UNION SELECT 'p' || (doc_id % 3), source FROM documents)
        {IN_SYNC}""",
    "unequal_groups": f"""WITH {TURNS}, {ALTERED}, a AS (
          SELECT profile_id, count(*) AS n_archived, list_sort(list(session_id || '/' || seq || '/' || content)) AS held FROM archived GROUP BY 1),
        b AS (SELECT profile_id, count(*) AS n_stored, list_sort(list(session_id || '/' || seq || '/' || content)) AS held FROM stored GROUP BY 1)
        SELECT profile_id, coalesce(n_archived, 0) AS n_archived, coalesce(n_stored, 0) AS n_stored
        FROM a FULL JOIN b USING (profile_id) WHERE a.held IS DISTINCT FROM b.held""",
    "content_differences": f"""WITH {TURNS}, {ALTERED}
        SELECT a.profile_id, session_id, seq,
               CASE WHEN a.content <> b.content THEN 'changed' WHEN a.conv_id % 10 = 3 THEN 'moved' ELSE 'missing' END AS kind,
               CASE WHEN a.conv_id % 10 = 3 THEN 'elsewhere' END AS other_profile
        FROM archived a LEFT JOIN stored b USING (profile_id, session_id, seq) WHERE b.content IS DISTINCT FROM a.content
        UNION ALL
        SELECT b.profile_id, session_id, seq, CASE WHEN b.profile_id = 'elsewhere' THEN 'arrived' ELSE 'added' END,
               CASE WHEN b.profile_id = 'elsewhere' THEN old END
        FROM stored b ANTI JOIN archived a USING (profile_id, session_id, seq)""",
    "consistency_of_profiles": f"""WITH {TURNS}, pairs AS (
          SELECT DISTINCT conv_id, session_id, unnest([profile_id, 'other']) AS profile_id FROM turns),
        a AS (SELECT profile_id, session_id FROM pairs), b AS (SELECT profile_id, session_id FROM pairs WHERE profile_id <> 'other' OR conv_id % 2 = 0)
        {IN_SYNC}""",
    "list_sessions": f"""WITH {TURNS}, {sessions()} SELECT session_id, start_ts, {iso('start_ts')} AS start_time, source, turn_count, title
        FROM sessions WHERE start_ts >= {CUTOFF} ORDER BY start_ts DESC, session_id LIMIT 20""",
    "export_sessions": f"""WITH {TURNS}, {sessions()} SELECT profile_id, session_id, file_path, {iso('start_ts')} AS start_time, source, turn_count,
        seq, role, {iso('timestamp_ms')} AS time, preview
        FROM sessions JOIN (SELECT session_id, seq, role, timestamp_ms, preview FROM turns) USING (session_id)
        WHERE session_id IN {SYSTEM_SESSIONS} ORDER BY profile_id, session_id, seq""",
    "export_shared_sessions": f"""WITH {TURNS}, {sessions()} SELECT 'other' AS profile_id, session_id, file_path, {iso('start_ts')} AS start_time, source,
        turn_count, seq, role, {iso('timestamp_ms')} AS time, preview
        FROM sessions JOIN (SELECT session_id, seq, role, timestamp_ms, preview FROM turns WHERE role <> 'system') USING (session_id)
        WHERE session_id IN {SYSTEM_SESSIONS} ORDER BY session_id, seq""",
    "list_profiles": f"WITH {TURNS} SELECT DISTINCT profile_id FROM turns ORDER BY profile_id",
    "by_profile_counts": f"""WITH {TURNS} SELECT profile_id, count(DISTINCT session_id) AS n_sessions, count(*) AS n_turns
        FROM turns GROUP BY profile_id""",
    "by_profile": f"WITH {TURNS} SELECT turn_id, profile_id, timestamp_ms FROM turns WHERE profile_id = 'p1'",
    "time_range": f"WITH {TURNS} SELECT turn_id, timestamp_ms FROM turns WHERE timestamp_ms BETWEEN {AFTER_MS} AND {BEFORE_MS}",
    "last_days": f"WITH {TURNS} SELECT turn_id, timestamp_ms FROM turns WHERE timestamp_ms >= {CUTOFF}",
    "role_filter": f"WITH {TURNS} SELECT turn_id, role FROM turns WHERE role = 'assistant'",
    "by_session": f"WITH {TURNS} SELECT turn_id, session_id FROM turns WHERE session_id IN {SYSTEM_SESSIONS}",
    "by_session_of_profile": f"""WITH {TURNS}, {shared("role <> 'system'")}, chosen AS (
          SELECT profile_id, session_id FROM shared WHERE role = 'system' UNION SELECT profile_id, session_id FROM shared WHERE seq > 5 AND profile_id = 'other')
        SELECT profile_id, session_id, seq FROM shared JOIN chosen USING (profile_id, session_id)""",
    "non_null_preview": f"WITH {TURNS} SELECT turn_id, preview FROM turns WHERE role <> 'system'",
    "containing_text": "SELECT doc_id AS turn_id, source AS session_id FROM documents WHERE contains(text, 'the ')",
    "hit_context": f"""WITH {TURNS} SELECT turn_id, label, preview, session_id, timestamp_ms, role
        FROM turns JOIN embeddings ON vec_id = turn_id""",
    "tokenize_cjk": f"WITH {HAN_TEXTS} SELECT turn_id, spaced FROM spaced",
    "fold_terms": f"SELECT doc_id, array_to_string(regexp_extract_all(strip_accents(lower(text)), '{TOKEN}'), ' ') AS terms FROM documents",
    "explain_terms": f"WITH {HAN_TEXTS} SELECT turn_id, spaced, array_to_string({tokens('text')}, '|') AS terms FROM spaced",
    "build_postings": f"""WITH {DOCUMENT_TURNS}, {INDEX}
        SELECT term, turn_id, tf, dl, array_to_string(positions, ',') AS positions FROM postings""",
    "term_stats": f"WITH {DOCUMENT_TURNS}, {INDEX} SELECT term, df FROM stats",
    "corpus_stats": f"WITH {DOCUMENT_TURNS}, {INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM corpus",
    "keyword_topk": keyword(TURNS, values("the of")),
    "keyword_topk_documents": keyword(DOCUMENT_TURNS, values("the of", "que la", "with from this", "der", "the zzzz")),
    "keyword_batch": keyword(DOCUMENT_TURNS, BENCHMARK),
    "keyword_by_profile": keyword(PROFILE_TURNS, values("the of", "que la", "der")),
    "keyword_time": keyword(TURNS, values("the of", "and"), where=f"WHERE timestamp_ms BETWEEN {AFTER_MS} AND {BEFORE_MS}"),
    "keyword_role_pre": f"""SELECT {CONTEXT} FROM (
        {keyword(TURNS, values("the of", "and"), where=f"WHERE timestamp_ms >= {AFTER_MS} AND role = 'assistant'")})
        JOIN (WITH {TURNS} SELECT turn_id, preview, session_id, timestamp_ms, role FROM turns) USING (turn_id)""",
    "keyword_role_post": f"""SELECT query_id, turn_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank,
        preview, session_id, timestamp_ms, role FROM (
        {keyword(TURNS, values("the of", "and"), where=f"WHERE timestamp_ms >= {AFTER_MS}")})
        JOIN (WITH {TURNS} SELECT turn_id, preview, session_id, timestamp_ms, role FROM turns) USING (turn_id)
        WHERE role = 'assistant'""",
    "keyword_any": keyword(DOCUMENT_TURNS, values("the of", "que der", "zzzz with"), every=False),
    "keyword_none": keyword(
        DOCUMENT_TURNS,
        values("the of", "en"),
        where="""WHERE (query_id, turn_id) NOT IN (SELECT * FROM (
            SELECT 1 AS query_id, turn_id FROM postings WHERE term = 'with'
            UNION ALL SELECT 2, turn_id FROM postings WHERE term IN ('les', 'der')))""",
    ),
    "keyword_phrase": f"""WITH {DOCUMENT_TURNS}, {INDEX}, {values("of the", "in the", "that is the")}, {PHRASES}, {UNITS}
        {best('scored', K)}""",
    "keyword_phrase_batch": f"WITH {DOCUMENT_TURNS}, {INDEX}, {BENCHMARK}, {PHRASES}, {UNITS} {best('scored', K)}",
    "keyword_near": f"""WITH {DOCUMENT_TURNS}, {INDEX}, {values("with from", "the and of")}, {QUERY_TERMS},
        places AS (SELECT query_id, turn_id, term, dl, position FROM words JOIN terms USING (term)),
        windows AS (
          SELECT a.query_id, a.turn_id, any_value(a.dl) AS dl, a.position, count(DISTINCT b.term) AS n_found
          FROM places a JOIN places b ON a.query_id = b.query_id AND a.turn_id = b.turn_id
               AND b.position BETWEEN a.position AND a.position + 4
          GROUP BY a.query_id, a.turn_id, a.position),
        found AS (
          SELECT query_id, turn_id, any_value(dl) AS dl, count(*) AS tf
          FROM windows JOIN sizes USING (query_id) WHERE n_found = n_terms GROUP BY query_id, turn_id), {UNITS}
        {best('scored', K)}""",
    "keyword_prefix": prefix(f"{DOCUMENT_TURNS}, {INDEX}", "wit", "th", "quee", "the of wit", "que la mi"),
    "keyword_prefix_han": prefix(
        f"{HAN_TEXTS}, toks AS (SELECT turn_id, {tokens('text')} AS tokens FROM mixed), {INDEX_OF_TOKENS}", "数据", "the 数据湖", "b据", "据"
    ),
    "mean_pool": """WITH parts AS (
          SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i,
                 CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END AS mask FROM embeddings)
        SELECT label::BIGINT AS label, i::BIGINT AS i, round(sum(x * mask) / greatest(sum(mask), 1), 6) AS x FROM parts GROUP BY label, i""",
    "l2_normalize_vectors": """WITH scaled AS (
          SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 2)) AS v FROM embeddings),
        parts AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS length
                  FROM scaled)
        SELECT vec_id, i::BIGINT AS i, round(x / length, 6) AS x FROM parts""",
    "quantize_int8_vectors": """SELECT vec_id AS turn_id, array_to_string(list_transform(embedding,
          lambda x: CAST(round(greatest(-1, least(1, x * 8::FLOAT)) * 127::FLOAT) AS INTEGER)), ',') AS q8 FROM embeddings""",
    "knn_l2": f"WITH {VECTORS}, {LABEL_QUERIES} {nearest('centres', 5)}",
    "knn_cosine": f"WITH {VECTORS}, {LABEL_QUERIES} {nearest('centres', 5, COSINE)}",
    "knn_join": f"WITH {VECTORS}, asked AS (SELECT turn_id AS query_id, q8 FROM vectors) {nearest('asked', 5)}",
    "semantic_filtered": f"""WITH {VECTORS}, {LABEL_QUERIES}, {DOCUMENT_TURNS},
        allowed AS (SELECT v.* FROM vectors v JOIN turns USING (turn_id)
                    WHERE timestamp_ms >= {AFTER_MS - 8 * HOUR} AND role = 'en'),
        hits AS ({nearest('centres', 5, source='allowed')})
        SELECT query_id, turn_id, round(1 - distance, 6) AS score, rank, preview, session_id, timestamp_ms, role
        FROM hits JOIN turns USING (turn_id)""",
    "semantic_post_filtered": f"""WITH {VECTORS}, {LABEL_QUERIES}, {DOCUMENT_TURNS}, hits AS ({nearest('centres', K)})
        SELECT query_id, turn_id, round(1 - distance, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
        FROM hits JOIN turns USING (turn_id) WHERE timestamp_ms >= {AFTER_MS - 8 * HOUR} AND role = 'en'""",
    "embed_texts": f"WITH {DOCUMENT_TURNS}, {text_vectors()} SELECT turn_id, array_to_string(q8, ',') AS q8 FROM text_vectors",
    "semantic_text_search": f"""WITH {DOCUMENT_TURNS}, {text_vectors()},
        {text_vectors("SELECT item_id AS turn_id, text AS content FROM benchmark", "asked_")},
        asked AS (SELECT turn_id AS query_id, q8 FROM asked_text_vectors), hits AS ({nearest('asked', 5, source='text_vectors')})
        SELECT query_id, turn_id, round(1 - distance, 6) AS score, rank, preview, session_id, timestamp_ms, role
        FROM hits JOIN turns USING (turn_id)""",
    "rrf_fuse": f"""WITH {DOCUMENT_TURNS}, {INDEX}, {LABEL_WORDS}, {QUERY_TERMS}, {scores()}, {VECTORS}, {LABEL_QUERIES},
        both_lists AS (SELECT query_id, turn_id, rank FROM ({best('scores', K)})
                       UNION ALL SELECT query_id, turn_id, rank FROM ({nearest('centres', K)})),
        fused AS (SELECT query_id, turn_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM both_lists GROUP BY query_id, turn_id)
        {best('fused', K)}""",
    "hybrid_keyword_only": f"""WITH {DOCUMENT_TURNS}, {INDEX}, {LABEL_WORDS}, {QUERY_TERMS}, {scores()},
        fused AS (SELECT query_id, turn_id, round(1.0 / (60 + rank), 6) AS score FROM ({best('scores', K)})),
        hits AS ({best('fused', K)})
        SELECT {CONTEXT} FROM hits JOIN (SELECT turn_id, preview, session_id, timestamp_ms, role FROM turns) USING (turn_id)""",
    "search_hybrid": f"""WITH {DOCUMENT_TURNS}, {INDEX}, {LABEL_WORDS}, {QUERY_TERMS}, {scores()}, {VECTORS}, {LABEL_QUERIES},
        asked_words AS (SELECT s.* FROM scores s JOIN turns USING (turn_id) WHERE role = 'en' AND query_id IN (SELECT query_id FROM centres)),
        asked_centres AS (SELECT * FROM centres WHERE query_id IN (SELECT query_id FROM queries)),
        allowed AS (SELECT v.* FROM vectors v JOIN turns USING (turn_id) WHERE role = 'en'),
        both_lists AS (SELECT query_id, turn_id, rank FROM ({best('asked_words', K)})
                       UNION ALL SELECT query_id, turn_id, rank FROM ({nearest('asked_centres', K, source='allowed')})),
        fused AS (SELECT query_id, turn_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM both_lists GROUP BY query_id, turn_id),
        hits AS ({best('fused', K)})
        SELECT {CONTEXT} FROM hits JOIN (SELECT turn_id, preview, session_id, timestamp_ms, role FROM turns) USING (turn_id)""",
    "scan_content": f"""WITH {SCAN_TEXTS}, found AS (SELECT doc_id, {issues('content')} AS issues FROM texts)
        SELECT doc_id, array_to_string(issues, '; ') AS issues, len(issues) = 0 AS is_safe FROM found""",
    "scan_summary": f"""WITH {SCAN_TEXTS}, found AS (SELECT unnest({issues('content')}) AS issue FROM texts)
        SELECT issue, count(*) AS n FROM found GROUP BY issue""",
    "admit_entries": f"WITH RECURSIVE {ADMITTED} SELECT profile_id, target, ts, entry_id, n_chars, verdict FROM verdicts",
    "rejected_entries": f"""WITH RECURSIVE {ADMITTED} SELECT profile_id, target, entry_id, verdict, reason FROM verdicts
        WHERE verdict <> 'accepted'""",
    "memory_usage": f"""WITH RECURSIVE {ADMITTED}, {BODIES}, counts AS (SELECT profile_id, target, count(*) AS n_entries FROM accepted GROUP BY ALL)
        SELECT profile_id, target, n_entries, length(body) AS used_chars, capacity::BIGINT AS capacity,
               round(100 * (length(body) / capacity), 2) AS used_percent, length(body) / capacity > 0.8 AS near_full
        FROM bodies JOIN counts USING (profile_id, target)""",
    "render_memory": f"""WITH RECURSIVE {ADMITTED}, {BODIES}
        SELECT profile_id, target, '<!-- ' || CASE WHEN target = 'user' THEN 'USER PROFILE' ELSE 'MEMORY' END || ' | capacity: ' || capacity
               || ' chars | updated: ' || {iso(str(NOW))} || ' -->' || chr(10) || chr(10) || body AS document FROM bodies""",
    "parse_memory": f"""WITH RECURSIVE {ADMITTED} SELECT profile_id, target,
        row_number() OVER (PARTITION BY profile_id, target ORDER BY pos) - 1 AS piece, content FROM accepted""",
    "list_entries": f"""WITH RECURSIVE {ADMITTED} SELECT profile_id, target, content, ts AS created_at FROM accepted
        WHERE target = 'memory' ORDER BY ts DESC, entry_id""",
    "user_profile": f"WITH RECURSIVE {ADMITTED}, {BODIES} SELECT profile_id, body FROM bodies WHERE target = 'user'",
    "apply_memory_events": f"""WITH RECURSIVE {EVENTS} SELECT profile_id, target, event_id, pos, op, verdict
        FROM placed JOIN (SELECT profile_id, target, pos, verdict FROM walk) USING (profile_id, target, pos)""",
    "stream_replay_verdicts": f"""WITH RECURSIVE {EVENTS} SELECT profile_id, target, event_id, op, verdict
        FROM placed JOIN (SELECT profile_id, target, pos, verdict FROM walk) USING (profile_id, target, pos)""",
    "memory_snapshot": f"""WITH RECURSIVE {EVENTS} SELECT profile_id, target, piece, content FROM snapshot""",
    "memory_provenance": f"""WITH RECURSIVE {TURNS}, {SOURCES}, {EVENTS}
        SELECT s.profile_id, s.target, s.piece, s.content, b.ts, o.ts AS created_at, o.confidence, o.source_session,
               f.session_id IS NOT NULL AS session_exists, f.file_path AS session_file_path
        FROM snapshot s JOIN placed b ON b.profile_id = s.profile_id AND b.target = s.target AND b.pos = s.born
        JOIN placed o ON o.profile_id = s.profile_id AND o.target = s.target AND o.pos = s.origin
        LEFT JOIN sources f ON f.session_id = o.source_session AND f.profile_id = s.profile_id""",
    "audit_edits": f"""WITH RECURSIVE {EVENTS}
        SELECT ts AS timestamp_ms, op AS action, target, source_session AS session_id,
               CASE op WHEN 'write' THEN to_json({{'content_preview': substring(content, 1, 100)}})
                 WHEN 'update' THEN to_json({{'old': substring(word, 1, 50), 'new': substring(word || '+', 1, 50)}})
                 ELSE to_json({{'removed': substring(word, 1, 50)}}) END::VARCHAR AS detail
        FROM placed JOIN (SELECT profile_id, target, pos, verdict FROM walk) USING (profile_id, target, pos) WHERE verdict = 'accepted'""",
    "trace_sources": f"""WITH {TRACED} SELECT entry_id, target, confidence, source_session, session_exists, session_file_path FROM traced""",
    "provenance_report": f"""WITH {TRACED} SELECT profile_id, target, count(*) AS total,
        count(*) FILTER (source_session IS NOT NULL AND session_exists) AS verified,
        count(*) FILTER (source_session IS NOT NULL AND NOT session_exists) AS missing_source,
        count(*) FILTER (source_session IS NULL) AS no_source FROM traced GROUP BY profile_id, target""",
    "audit_events": AUDIT_ROWS,
    "audit_range": f"""WITH {AUDIT} SELECT * FROM audit WHERE timestamp_ms BETWEEN {BASE + 3 * DAY} AND {BASE + 9 * DAY}""",
    "time_parse": f"""WITH {AUDIT}, texts AS (
          SELECT timestamp_ms, session_id, CASE timestamp_ms % 5 WHEN 0 THEN {iso('timestamp_ms')}
            WHEN 1 THEN replace({iso('timestamp_ms')}, 'Z', '') WHEN 2 THEN strftime(make_timestamp(timestamp_ms * 1000), '%Y%m%dT%H%M%S')
            WHEN 3 THEN replace({iso('timestamp_ms')}, 'Z', '+08:00') ELSE strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d') END AS text
          FROM audit)
        SELECT timestamp_ms, session_id, text, CASE timestamp_ms % 5 WHEN 0 THEN timestamp_ms WHEN 1 THEN timestamp_ms
          WHEN 2 THEN timestamp_ms - timestamp_ms % 1000 WHEN 3 THEN timestamp_ms - 8 * {HOUR} END AS parsed FROM texts""",
    "time_format": f"""WITH {AUDIT} SELECT timestamp_ms, session_id, {iso('timestamp_ms')} AS iso,
        strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d') AS day,
        strftime(make_timestamp(timestamp_ms * 1000), '%Y%m%dT%H%M%S') AS compact FROM audit""",
    "json_path": f"""WITH {TURNS} SELECT turn_id, coalesce(input_tokens + output_tokens, 0) AS strict,
        coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS lenient, output_tokens FROM turns""",
}
ORACLES["archive_rewrite"] = ORACLES["archive_round_trip"]
ORACLES["stream_ingest_versions"] = f"""WITH {SPOKEN_TURNS},
    kept AS (SELECT * FROM turns WHERE conv_id % 2 = 1 OR role = 'user')
    SELECT 'conv-' || conv_id AS session_id, count(kept.turn_id) AS turn_count,
           CASE WHEN count(kept.turn_id) > 0 THEN count(kept.turn_id) END AS n_turns, CAST(sum(seq) AS BIGINT) AS seqs
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN kept USING (conv_id) GROUP BY conv_id"""
ORACLES["stream_merged_sessions"] = ORACLES["stream_ingest_versions"].replace(SPOKEN_TURNS, TURNS)
ORACLES["search_by_profile"] = ORACLES["search_hybrid"].replace("FROM documents)", "FROM documents WHERE doc_id % 3 = 1)").replace("role = 'en'", "true")
ORACLES["sql_tokenize"] = ORACLES["tokenize_cjk"]
ORACLES["read_table"] = f"WITH {TURNS} SELECT turn_id, '0' || (conv_id % 3) AS profile_id FROM turns"
ORACLES["random_ids"] = "SELECT count(*) AS n_ids, count(*) AS n_well_formed FROM documents"
ORACLES["user_profile_edits"] = f"""WITH RECURSIVE {EVENTS}
    SELECT profile_id, string_agg(content, {SEP} ORDER BY piece) AS body FROM snapshot WHERE target = 'user' GROUP BY profile_id"""
ORACLES.update({stream: ORACLES[batch] for stream, batch in STREAM_ORACLES.items()})
