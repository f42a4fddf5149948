"""DuckDB SQL with the rows of the named queries, written from their meaning and not from their Spark plans."""

from __future__ import annotations

#: Written out here, so that no wrong constant of the engine can agree with itself.
MAX_CHARS, MAX_ATTEMPTS = 2000, 2
STAMP, NOW = "2026-01-01 00:00:00", "2026-01-02 00:00:00"
URL = "'https://' || coalesce(source, 'unknown') || '.example.com/doc/' || doc_id"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {_quoted(p)})" for p in phrases) + ")"


def _in(values) -> str:
    return "(" + ", ".join(_quoted(v) for v in values) + ")"


SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_step = "html"
for _pattern, _by in (("(?is)<script.*?</script>", " "), ("(?is)<style.*?</style>", " "), ("<[^>]+>", " "), ("&nbsp;|&#(9|10|11|12|13|32|160);", " "), ("&(amp|lt|gt|quot|copy|middot|reg|deg|eacute|#[0-9]{1,7});", "x"), (SPACES, "")):
    _step = f"regexp_replace({_step}, {_quoted(_pattern)}, {_quoted(_by)}, 'g')"
VISIBLE = f"length({_step})"
EMPTY = "(coalesce(length(html), 0) = 0 OR bad OR visible < {t} OR (length(html) > 5000 AND visible < length(html) * 0.01))"
SEEN = f"seen AS (SELECT *, coalesce({VISIBLE}, 0) AS visible, coalesce({_any('html', ('javascript is disabled', 'robot check', 'verify you''re not a robot'.replace(chr(39) * 2, chr(39)), 'access denied', 'cloudflare'))}, FALSE) AS bad FROM pages)"

RESULTS = f"""results AS (
  SELECT doc_id, {URL} AS source_url, coalesce(text, '') AS content,
         CASE WHEN doc_id % 97 = 0 THEN 'unknown' ELSE 'text' END AS content_type,
         CASE quality WHEN 1 THEN 0.9 WHEN 0 THEN 0.3 ELSE 0.5 END AS confidence
  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id))"""

BLANK = rf"regexp_replace(content, '{SPACES}', '', 'g') = ''"
ERRORS = f"""list_filter([CASE WHEN {BLANK} THEN 'section 0 has empty content' END, CASE WHEN confidence < 0.5 THEN 'confidence below threshold' END,
  CASE WHEN content_type = 'unknown' THEN 'unsupported content type: unknown' END], lambda e: e IS NOT NULL)"""

LOG = """log AS (
  SELECT event_id AS id, ts, event_type, 'https://u' || user_id || '.example.com/' AS url, props,
         CASE event_type WHEN 'purchase' THEN 'stored' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'flagged' WHEN 'click' THEN 'begin' ELSE 'empty' END AS outcome
  FROM events)"""

ATTEMPTS = """attempts AS (
  SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS key, event_id AS id,
         CASE event_type WHEN 'purchase' THEN 'stored' WHEN 'error' THEN 'fetch_failed' WHEN 'signup' THEN 'flagged' WHEN 'click' THEN 'blocked' ELSE 'no_content' END AS status
  FROM events)"""

FOLD = f"""{ATTEMPTS},
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS n FROM attempts),
live AS (
  SELECT * FROM n a WHERE NOT EXISTS (
    SELECT 1 FROM n b WHERE b.key = a.key AND b.n < a.n AND (b.status <> 'fetch_failed' OR b.n >= {MAX_ATTEMPTS}))),
fin AS (SELECT key, max(n) AS attempts, arg_max(status, n) AS status FROM live GROUP BY key),
fold AS (
  SELECT key, CAST(attempts AS INTEGER) AS attempts,
         CASE WHEN status = 'stored' THEN 'done' WHEN status = 'no_content' THEN 'failed' WHEN status <> 'fetch_failed' THEN status
              WHEN attempts >= {MAX_ATTEMPTS} THEN 'failed' ELSE 'retrying' END AS state FROM fin)"""

FRONTIER = f"""frontier AS (
  SELECT page_id, url, ['pending', 'retrying', 'processing', 'done', 'failed', 'retrying'][CAST(page_id % 6 + 1 AS INTEGER)] AS state,
         CAST(CASE WHEN page_id % 6 = 0 THEN 0 ELSE 1 END AS INTEGER) AS attempts,
         CASE page_id % 6 WHEN 1 THEN epoch(TIMESTAMP '{NOW}') - 5 WHEN 5 THEN epoch(TIMESTAMP '{NOW}') + 5 END AS due FROM pages)"""

#: Pieces of ``good`` (source_url, content), one a step: what is left, and how much of an overlong line is left.
STEPS = rf"""step(source_url, k, piece, rest, long_left) AS (
  SELECT source_url, 0, '', content, 0 FROM good
  UNION ALL
  SELECT source_url, k + 1, left(rest, n), substr(rest, n + 1),
         CASE WHEN long_left > 0 THEN long_left - n WHEN line > {MAX_CHARS} AND NOT whole THEN line - n ELSE 0 END
  FROM (
    SELECT *, CASE
        WHEN whole THEN length(rest)
        WHEN long_left = 0 AND line <= {MAX_CHARS} THEN
          CASE WHEN length(rest) <= {MAX_CHARS} THEN length(rest)
               ELSE {MAX_CHARS} - position(chr(10) IN reverse(left(rest, {MAX_CHARS}))) + 1 END
        WHEN span <= {MAX_CHARS} THEN span
        WHEN sentence > 0 THEN sentence
        WHEN blank > 0 THEN blank
        ELSE {MAX_CHARS} END AS n
    FROM (
      SELECT *, length(regexp_extract(w, '(?s)^(.*[.!?](?: |\z))', 1)) AS sentence,
             CASE WHEN position(' ' IN reverse(w)) > 0 THEN length(w) - position(' ' IN reverse(w)) ELSE 0 END AS blank
      FROM (
        SELECT *, left(rest, {MAX_CHARS}) AS w, CASE WHEN long_left > 0 THEN long_left ELSE line END AS span, k = 0 AND length(rest) <= {MAX_CHARS} AS whole
        FROM (
          SELECT *, CASE WHEN position(chr(10) IN rest) > 0 THEN position(chr(10) IN rest) ELSE length(rest) END AS line
          FROM step WHERE rest <> ''))))),
pieces AS (SELECT source_url, k AS chunk_index, piece AS content, count(*) OVER (PARTITION BY source_url) AS chunk_total FROM step WHERE k > 0)"""
CHUNKS = f"""RECURSIVE {RESULTS},
good AS (SELECT source_url, content FROM results WHERE NOT {BLANK}),
{STEPS}"""

TURNS = f"""turns AS (
  SELECT conv_id, turn, text, 'https://chat.example.com/' || conv_id AS source_url, CASE WHEN turn % 2 = 0 THEN role END AS heading,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, text, role) AS i FROM conversations)"""

#: The question of every conversation, its shape, how much of its evidence can be cited, and what comes of the model's answer.
ANSWERS = f"""{TURNS}, c AS (SELECT conv_id, least(3, count(*) FILTER (coalesce(text, '') <> '')) AS cited FROM turns GROUP BY conv_id),
f AS (SELECT conv_id, coalesce(first(text ORDER BY turn), '') AS q FROM conversations GROUP BY conv_id),
k AS (SELECT *, length(q) % 7 AS k FROM c JOIN f USING (conv_id)),
answers AS (
  SELECT conv_id, CASE WHEN k < 2 THEN 'answered' WHEN k = 2 THEN 'unwrapped' WHEN k IN (3, 5) AND cited > 0 THEN 'fallback_rescue' ELSE 'failed' END AS answer_outcome,
    CASE k WHEN 4 THEN 'llm call failed: down' WHEN 5 THEN 'schema validation failed: answer or citations missing' WHEN 3 THEN 'model returned no parseable structured output' WHEN 6 THEN 'model returned no parseable structured output' END AS answer_error,
    CASE WHEN k < 3 THEN 'said: ' || q WHEN k = 3 AND cited > 0 THEN trim(q) WHEN k = 5 AND cited > 0 THEN '{{"citations": []}}' END AS answer,
    CASE WHEN k < 3 THEN 1 WHEN k IN (3, 5) THEN cited ELSE 0 END AS citations FROM k)"""

KNN = "0.0 + round(1 - list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 6)"
RAW_KNN = KNN[len("0.0 + round(") : -len(", 6)")]

#: Outcomes in the order of the query, with what each of them says.
SEVERITIES = """success ok, empty other, blocked error, failed error, no_fallback other, fallback other, kept_static ok, dismissed ok, follow_and_log other, encoding_fallback warn,
detection_failure warn, wait other, stripped other, title_extraction_failed other, retrying progress, fallback_section other, extracted other, flagged error, valid other, repairing other,
tool_use_failed other, json_mode progress, ok ok, begin other, complete other, fetch_done progress, validate_done progress, store_start progress, completed ok, started other, finished other, done other,
corpus_hit ok, corpus_error error, corpus_miss_single_shot_ok ok, corpus_miss_single_shot_blocked other, no_content error, fetch_failed error, stored other, single_shot_ok ok, timeout warn, rescued ok,
unwrapped other, unheard_of other"""
_said = ", ".join(f"({i}, '{x.split()[0]}', '{x.split()[1]}')" for i, x in enumerate(SEVERITIES.split(",")))

#: Pages of the one template: the heading, the paragraphs, the title, as a reader sees them.
_flat = lambda t: f"trim(regexp_replace({t}, '{SPACES}+', ' ', 'g'))"
_plain = lambda t: f"replace(replace(replace(replace({t}, '&middot;', '·'), '&copy;', '©'), '&quot;', chr(34)), '&amp;', '&')"
PAGE = f"""art AS (
  SELECT page_id, url, html, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS inside, {_flat(_plain("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title FROM pages),
page AS (
  SELECT page_id, url, html, nullif(title, '') AS title, {_flat(_plain("regexp_extract(inside, '(?s)<h1>(.*?)</h1>', 1)"))} AS head,
         list_filter(list_transform(regexp_split_to_array(replace(replace(regexp_replace(inside, '(?s)^.*?</h1>', ''), '<br>', ' '), '<b>', ''), '</?p>'), lambda x: {_flat(_plain("x"))}), lambda x: x <> '') AS parts
  FROM art),
body AS (SELECT *, head || chr(10) || array_to_string(parts, chr(10) || chr(10)) AS text FROM page)"""
BARE = """'  ' || regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[<>]', '', 'g') || ' ' || chr(9) || ' end '"""
VARIED = f"""{PAGE}, seen AS (
  SELECT *, page_id % 4 AS k, trim(regexp_replace({BARE}, '[ \\t]+', ' ', 'g')) AS bare, length({BARE}) AS bare_size FROM body)"""

#: Sections of a stripped page: its paragraphs, the heading apart from the first where it looks like one.
SECTIONS = f"""{PAGE}, sec AS (
  SELECT url, title, i, CASE WHEN i > 1 THEN part WHEN length(head) <= 120 AND NOT regexp_matches(head, '[.!?:,;]$') THEN part ELSE head || chr(10) || part END AS content,
         CASE WHEN i = 1 AND length(head) <= 120 AND NOT regexp_matches(head, '[.!?:,;]$') THEN head END AS heading
  FROM (SELECT url, title, head, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM page))"""

MIXED = """mixed AS (
  SELECT url, page_id % 8 AS k FROM pages)"""

SQL = {
    "schema_checks": f"WITH {RESULTS} SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND confidence > 0.5 THEN 'empty_but_confident' ELSE '' END AS violations FROM results",
    "page_visible_length": f"WITH {SEEN} SELECT page_id, CAST(visible AS INTEGER) AS visible FROM seen",
    "page_looks_empty": f"WITH {SEEN} SELECT page_id, {EMPTY.format(t=100)} AS empty_100, {EMPTY.format(t=1000)} AS empty_1000, bad AS error_page FROM seen",
    "page_fetch_decision": f"""WITH {SEEN}, e AS (SELECT url, coalesce(length(html), 0) > 0 AS ok, {EMPTY.format(t=1000)} AS short FROM seen)
SELECT url, CASE WHEN ok AND NOT short THEN 'kept_static' ELSE 'fallback' END AS decision,
  CASE WHEN NOT ok THEN 'static fetch failed (None), falling back to browser fetch' WHEN short THEN 'static content insufficient, falling back to browser fetch' ELSE 'static fetch sufficient' END AS decision_reason,
  NOT (ok AND NOT short) AS needs_browser FROM e""",
    "fetch_with_browser": f"""WITH {SEEN}, e AS (SELECT page_id, url, coalesce(length(html), 0) > 0 AS ok, {EMPTY.format(t=1000)} AS short FROM seen)
SELECT url, CASE WHEN ok AND NOT short THEN 'success' WHEN page_id % 2 = 0 THEN CASE WHEN ok THEN 'success' ELSE 'failed' END ELSE 'failed' END AS outcome,
  CASE WHEN ok AND NOT short THEN 'static' ELSE 'browser' END AS fetcher,
  CASE WHEN NOT (ok AND NOT short) AND page_id % 2 <> 0 THEN 'no rendered page' END AS reason,
  CASE WHEN ok AND NOT short THEN 'kept_static' ELSE 'fallback' END AS decision FROM e""",
    "page_domain_counts": "SELECT regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS domain, count(*) AS n FROM pages GROUP BY 1",
    "mime_routing": """WITH m AS (SELECT page_id, ['text/html; charset=utf-8', 'application/pdf', 'TEXT/PLAIN', 'application/json', 'application/xml', 'image/png', '', NULL][CAST(page_id % 8 + 1 AS INTEGER)] AS mime FROM pages)
SELECT page_id, CASE WHEN lower(mime) LIKE '%html%' THEN 'html' WHEN lower(mime) LIKE '%pdf%' THEN 'pdf' WHEN regexp_matches(lower(mime), 'text|json|xml') THEN 'text' ELSE 'unknown' END AS content_type,
  coalesce(mime, '') = '' OR lower(mime) LIKE 'text/%' OR regexp_matches(lower(mime), 'html|xml') AS html_like FROM m""",
    "page_obstacles": """WITH o AS (SELECT page_id, [NULL, 'captcha_gate', 'session_expiry', 'cookie_banner', 'popup_modal', 'load_more', 'popup_modal'][CAST(page_id % 7 + 1 AS INTEGER)] AS obstacle FROM pages)
SELECT page_id, obstacle, coalesce(obstacle, 'session_expiry') <> 'session_expiry' AS enabled,
  CASE obstacle WHEN 'captcha_gate' THEN 'terminal_blocked' WHEN 'session_expiry' THEN 'terminal_blocked' WHEN 'cookie_banner' THEN 'dismiss' WHEN 'popup_modal' THEN 'dismiss' WHEN 'load_more' THEN 'paginate' ELSE '' END AS policy, 3 AS max_retries FROM o""",
    "url_list": "SELECT url FROM pages WHERE page_id % 3 = 1",
    "redirect_hops": "SELECT url, 1 AS hop, url AS from_url, url || '?a' AS to_url FROM pages UNION ALL SELECT url, 2, url || '?a', url || '?b' FROM pages",
    "backoff_plan": "SELECT event_id, CASE WHEN event_id % 8 = 7 THEN 12.5 ELSE least(30.0, pow(2.0, event_id % 8)) END AS wait FROM events",
    "events_recent": f"WITH {LOG} SELECT id, event_type, url, outcome FROM log ORDER BY id DESC LIMIT 200",
    "events_filtered": f"WITH {LOG} SELECT id, event_type, url FROM log WHERE event_type IN ('error', 'purchase') AND url ILIKE '%U1%' ORDER BY id DESC LIMIT 50",
    "events_for_key": f"WITH {LOG} SELECT id, ts, event_type FROM log WHERE url = 'https://u1.example.com/' ORDER BY ts DESC, id DESC LIMIT 20",
    "event_types": "SELECT DISTINCT event_type FROM events",
    "newest_per_key": f"WITH {LOG} SELECT url, id, event_type, outcome FROM log QUALIFY row_number() OVER (PARTITION BY url ORDER BY id DESC) = 1",
    "last_three_per_key": f"WITH {LOG} SELECT url, id, event_type FROM log QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, id DESC) <= 3",
    "newest_streamed": f"WITH {LOG} SELECT url, id, event_type FROM log QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, id DESC) <= 3",
    "event_severity": f"""WITH said(k, outcome, severity) AS (VALUES {_said})
SELECT outcome, coalesce(severity, 'other') AS severity, count(*) AS n FROM events LEFT JOIN said ON event_id % 45 = k GROUP BY ALL""",
    "domain_spacing": f"""WITH {LOG}, g AS (SELECT id, 'u' || substr(url, 10, length(url) - 10) AS domain, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY url ORDER BY ts, id)) AS gap FROM log)
SELECT id, domain, round(coalesce(greatest(0, 3600.0 - gap), 0), 3) AS wait FROM g""",
    "kept_spacing": f"""WITH {LOG}, n AS (SELECT id, 'u' || substr(url, 10, length(url) - 10) AS domain, epoch_us(ts) AS t, row_number() OVER (PARTITION BY url ORDER BY ts, id) AS i FROM log)
SELECT id, domain, (i * 3600000000 + max(t - i * 3600000000) OVER (PARTITION BY domain ORDER BY i) - t) / 1000000.0 AS wait FROM n""",
    "run_durations": f"""WITH {LOG}, f AS (SELECT *, coalesce(event_type = 'click' OR epoch(ts) - epoch(lag(ts) OVER w) > 86400, TRUE) AS new FROM log WINDOW w AS (PARTITION BY url ORDER BY ts, id))
SELECT id, CAST(sum(CAST(new AS INTEGER)) OVER w AS INTEGER) AS run, round(epoch(ts) - epoch(last_value(CASE WHEN new THEN ts END IGNORE NULLS) OVER w), 2) AS duration_seconds FROM f WINDOW w AS (PARTITION BY url ORDER BY ts, id)""",
    "stage_durations": f"WITH {LOG} SELECT id, round(epoch(ts) - epoch(min(ts) OVER (PARTITION BY url, event_type)), 2) AS duration_seconds FROM log",
    "unfinished_ingests": f"""WITH {LOG}, l AS (SELECT url, max(id) FILTER (event_type = 'click') AS begun, max(id) FILTER (event_type = 'purchase') AS ended FROM log GROUP BY url)
SELECT url, begun FROM l WHERE begun IS NOT NULL AND (ended IS NULL OR ended < begun)""",
    "events_appended": """SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY url, length(html)) AS id, url, '{"size":' || length(html) || '}' AS details_json FROM pages""",
    "frontier_fold": f"WITH {FOLD} SELECT key, state, attempts FROM fold",
    "frontier_replayed": f"WITH {FOLD} SELECT key, state, attempts FROM fold",
    "batch_summary": f"WITH {FOLD} SELECT CAST(sum(count(*)) OVER () AS BIGINT) AS total, state, count(*) AS n FROM fold GROUP BY state",
    "running_attempts": f"WITH {ATTEMPTS} SELECT key, id, CAST(row_number() OVER (PARTITION BY key ORDER BY id) AS INTEGER) AS attempt FROM attempts",
    "pending_due": f"WITH {FRONTIER} SELECT url, state, attempts FROM frontier WHERE state = 'pending' OR (state = 'retrying' AND due <= epoch(TIMESTAMP '{NOW}'))",
    "state_counts": f"WITH {FRONTIER} SELECT state, count(*) AS n FROM frontier GROUP BY state",
    "enqueue_dedupe": f"WITH {FRONTIER} SELECT url, CASE WHEN state = 'done' THEN 'done' ELSE 'pending' END AS state, CAST(CASE WHEN state = 'done' THEN attempts ELSE 0 END AS INTEGER) AS attempts FROM frontier",
    "recover_interrupted": f"WITH {FRONTIER} SELECT url, CASE WHEN state = 'processing' THEN 'pending' ELSE state END AS state, attempts FROM frontier",
    "apply_outcomes": f"""WITH {FRONTIER}, a AS (
  SELECT *, page_id % 6 < 2 AS hit, CASE WHEN page_id % 6 < 2 THEN attempts + 1 ELSE attempts END AS tries,
         ['stored', 'fetch_failed', 'blocked', 'flagged', 'no_content'][CAST(page_id % 5 + 1 AS INTEGER)] AS status FROM frontier)
SELECT url, CASE WHEN NOT hit THEN state WHEN status = 'stored' THEN 'done' WHEN status = 'no_content' THEN 'failed' WHEN status <> 'fetch_failed' THEN status WHEN tries >= {MAX_ATTEMPTS} THEN 'failed' ELSE 'retrying' END AS state,
  CAST(tries AS INTEGER) AS attempts,
  CASE WHEN NOT hit OR status = 'stored' THEN NULL WHEN status IN ('blocked', 'flagged') THEN 'why' WHEN status = 'no_content' THEN 'no_content: why' ELSE 'attempts=' || tries || '/{MAX_ATTEMPTS}' END AS reason,
  CAST(CASE WHEN hit AND status = 'fetch_failed' THEN CASE WHEN tries < {MAX_ATTEMPTS} THEN epoch(TIMESTAMP '{NOW}') + 5 END ELSE due END AS BIGINT) AS due FROM a""",
    "page_title": r"SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1), '<[^>]+>', ' ', 'g')), '') AS title FROM pages",
    "validation_errors": f"""WITH {RESULTS}, e AS (SELECT doc_id, {ERRORS} AS es FROM results)
SELECT doc_id, coalesce(array_to_string(es, '; '), '') AS errors, coalesce(array_to_string(list_transform(es, lambda x, i: i || '. ' || x), chr(10)), '') AS numbered FROM e""",
    "validation_flags": f"""WITH {RESULTS}, e AS (SELECT source_url, content_type, {ERRORS} AS es FROM results)
SELECT source_url, len(es) = 0 AS is_valid, CASE WHEN len(es) = 0 THEN NULL WHEN content_type = 'unknown' THEN 'unsupported_content_type' ELSE 'repair_budget_exhausted' END AS flag_reason, 0 AS retry_count FROM e""",
    "repair_partition": f"""WITH {RESULTS}, e AS (SELECT content, content_type, {ERRORS} AS es FROM results), r AS (
  SELECT CASE WHEN len(es) = 0 THEN TRUE WHEN content_type = 'unknown' THEN FALSE ELSE NOT {BLANK} END AS is_valid,
         CASE WHEN len(es) = 0 OR content_type = 'unknown' THEN 0 ELSE 1 END AS retry_count, content_type FROM e)
SELECT is_valid, retry_count, CASE WHEN is_valid THEN NULL WHEN content_type = 'unknown' THEN 'unsupported_content_type' ELSE 'repair_budget_exhausted' END AS flag_reason, count(*) AS n FROM r GROUP BY ALL""",
    "chunks": f"WITH {CHUNKS} SELECT source_url, 1 AS section_index, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(chunk_total AS INTEGER) AS chunk_total, content FROM pieces",
    "chunk_ids": f"WITH {CHUNKS} SELECT source_url, CAST(chunk_index AS INTEGER) AS chunk_index, sha1(source_url || chr(0) || '1' || chr(0) || chunk_index) AS chunk_id FROM pieces",
    "chunk_totals": f"WITH {CHUNKS} SELECT source_url, CAST(1 AS BIGINT) AS num_sections, count(*) AS num_chunks, CASE WHEN count(*) > 1 THEN '1' ELSE '' END AS sections_split FROM pieces GROUP BY source_url",
    "concat_invariant": f"WITH {RESULTS} SELECT count(*) AS sections, CAST(0 AS BIGINT) AS broken FROM results WHERE NOT {BLANK}",
    "chunk_metadata": f"""WITH {CHUNKS} SELECT source_url, CAST(chunk_index AS INTEGER) AS chunk_index,
  'source_url=' || source_url || '|scrape_timestamp=2026-01-01T00:00:00.000+00:00|ingest_timestamp=2026-01-01T00:00:00.000+00:00|content_type=' || content_type || '|confidence=' || confidence ||
  '|chunk_index=' || chunk_index || '|chunk_total=' || chunk_total || '|truncated=false|page_title=Document ' || doc_id AS metadata FROM pieces JOIN results USING (source_url)""",
    "knn_topk": f"SELECT vec_id, distance FROM (SELECT e.vec_id, {RAW_KNN} AS raw, {KNN} AS distance FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q) ORDER BY raw, vec_id LIMIT 5",
    "knn_filtered": f"SELECT vec_id, distance FROM (SELECT e.vec_id, {RAW_KNN} AS raw, {KNN} AS distance FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q WHERE e.label = 1) ORDER BY raw, vec_id LIMIT 5",
    "knn_multi_query": f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS vec_id, {KNN} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {RAW_KNN}, e.vec_id) AS rank
  FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 5""",
    "knn_indexed": f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS vec_id, {KNN} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {RAW_KNN}, e.vec_id) AS rank
  FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.label <> 4) WHERE rank <= 5""",
    "knn_indexed_recall": "SELECT count(*) AS queries, CAST(5 * count(*) AS BIGINT) AS neighbours, TRUE AS recalled FROM embeddings WHERE vec_id % 50 = 0",
    "get_all": "SELECT vec_id, label FROM embeddings WHERE label = 2",
    "count_by_url": f"WITH {CHUNKS} SELECT source_url, count(*) AS chunks FROM pieces GROUP BY source_url",
    "replace_by_url": f"SELECT {URL} AS source_url, CASE WHEN lang = 'fr' THEN 'new' ELSE 'old' END AS version, CASE WHEN lang = 'fr' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents",
    "delete_scoped": f"SELECT {URL} AS source_url, doc_id FROM documents WHERE NOT (doc_id < 20 AND coalesce(source, '') = 'src' || doc_id)",
    "collection_names": "SELECT DISTINCT label, 'corpus_BAAI_bge_m' || label || '_' || len(embedding) AS name FROM embeddings",
    "live_hit_miss": f"""WITH d AS (SELECT doc_id, {URL} AS url, lang = 'en' AS hit, length({URL}) % 2 = 0 AS good, coalesce(text, '') AS text FROM documents)
SELECT doc_id, url, coalesce(hit, FALSE) AS found_in_corpus, CASE WHEN hit THEN 'corpus' ELSE 'live_scrape' END AS source_used, CASE WHEN hit THEN 'ok' WHEN good THEN 'single_shot_ok' ELSE 'fetch_failed' END AS status,
  CASE WHEN NOT coalesce(hit, FALSE) AND NOT good THEN 'down' END AS reason, CASE WHEN hit THEN 'corpus_hit' WHEN good THEN 'corpus_miss_single_shot_ok' ELSE 'corpus_miss_single_shot_fetch_failed' END AS event_outcome,
  CAST(CASE WHEN hit OR good THEN 1 ELSE 0 END AS INTEGER) AS pieces, CASE WHEN hit THEN 'source_url,scrape_timestamp' WHEN good THEN 'source_url,scrape_timestamp,page_title' ELSE 'source_url' END AS provenance,
  CASE WHEN hit THEN md5(text) WHEN good THEN md5(url) END AS first FROM d""",
    "render_evidence": f"""WITH {TURNS}
SELECT conv_id, string_agg('[' || i || '] source_url=' || source_url || CASE WHEN coalesce(heading, '') <> '' THEN ' section_heading=' || heading ELSE '' END || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY i) AS rendered FROM turns GROUP BY conv_id""",
    "citations_top3": f"""WITH {TURNS}, s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS k FROM turns WHERE coalesce(text, '') <> '')
SELECT conv_id, CAST(k - 1 AS INTEGER) AS k, source_url, heading AS section_heading, left(text, 300) AS quote FROM s WHERE k <= 3""",
    "answers_of_every_shape": f"WITH {ANSWERS} SELECT conv_id, answer_outcome, answer_error, md5(answer) AS answer, CAST(citations AS INTEGER) AS citations FROM answers",
    "answer_events": f"""WITH {ANSWERS}
SELECT CASE answer_outcome WHEN 'unwrapped' THEN 'answer_unwrap_rescue' WHEN 'fallback_rescue' THEN 'answer_fallback_rescued' ELSE 'answer_generation_failed' END AS event_type, answer_outcome AS outcome,
  CASE answer_outcome WHEN 'unwrapped' THEN 'JSON-inside-JSON detected and unwrapped' WHEN 'fallback_rescue' THEN 'structural path failed (' || answer_error || '), rescued from markdown' ELSE answer_error END AS reason, count(*) AS n
FROM answers WHERE answer_outcome <> 'answered' GROUP BY ALL""",
    "extraction_cleanup": rf"""WITH {RESULTS}, t AS (SELECT source_url, trim(content, ' ') AS content FROM results WHERE content_type <> 'unknown'),
h AS (SELECT source_url, {BLANK} AS bare, length(content) % 3 = 0 AS none, [left(content, length(content) // 2), substr(content, length(content) // 2 + 1)] AS halves FROM t),
b AS (SELECT *, len(list_filter(halves, lambda x: regexp_replace(x, '{SPACES}', '', 'g') <> '')) AS whole FROM h)
SELECT source_url, CASE WHEN bare THEN 'flagged' WHEN none THEN 'fallback_section' ELSE 'extracted' END AS extraction_outcome,
  CASE WHEN bare THEN 'empty content: nothing to extract' WHEN none THEN 'none found | extractor returned 0 sections; raw content wrapped as fallback' ELSE (3 - whole) || ' empty sections filtered' END AS extraction_notes,
  CAST(CASE WHEN bare THEN 0.0 WHEN none THEN 0.3 ELSE 0.8 END AS DOUBLE) AS confidence, CAST(CASE WHEN bare THEN 0 WHEN none THEN 1 ELSE whole END AS INTEGER) AS sections FROM b""",
    "quarantined_chunks": f"""WITH {CHUNKS}, s AS (SELECT chunk_total > 1 AND chunk_index = chunk_total AS bad FROM pieces)
SELECT CASE WHEN bad THEN 'bad' ELSE 'good' END AS kind, CASE WHEN bad THEN 'chunk_index_beyond_total' ELSE '' END AS reason, count(*) AS n, count(*) AS counted FROM s GROUP BY bad""",
    "text_previews": f"""SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview,
  left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 200) AS flat, left(sha256({URL}), 16) AS marker FROM documents""",
    "ingest_reports": f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'url=' || {URL} || ' is_valid=True stored_chunks=3 sections=2 confidence=0.9' WHEN 3 THEN 'fetch succeeded but no content to ingest'
  ELSE 'fetch outcome=failed reason=None -> no ingestion' END AS report FROM documents""",
    "live_events": f"""WITH d AS (SELECT {URL} AS url, coalesce(lang = 'en', FALSE) AS hit, length({URL}) % 2 = 0 AS good FROM documents)
SELECT 'live_query' AS event_type, url, CASE WHEN hit THEN 'corpus_hit' WHEN good THEN 'corpus_miss_single_shot_ok' ELSE 'corpus_miss_single_shot_fetch_failed' END AS outcome, CASE WHEN NOT hit AND NOT good THEN 'down' END AS reason,
  '{{"found_in_corpus":' || hit || ',"source_used":"' || CASE WHEN hit THEN 'corpus' ELSE 'live_scrape' END || '","evidence_count":' || CASE WHEN hit OR good THEN 1 ELSE 0 END || ',"query_given":false}}' AS details_json FROM d""",
    "strip_stats": f"""WITH {VARIED}
SELECT page_id, CASE WHEN k IN (0, 3) THEN title END AS title, CASE k WHEN 1 THEN 'fallback' WHEN 2 THEN 'empty' ELSE 'stripped' END AS outcome, CASE WHEN k IN (0, 3) THEN 'content' ELSE 'raw' END AS method,
  CAST(CASE k WHEN 0 THEN length(html) WHEN 1 THEN bare_size WHEN 2 THEN CASE WHEN page_id % 8 = 2 THEN 2 ELSE 0 END ELSE length(html) + 117 END AS INTEGER) AS chars_before,
  CAST(CASE k WHEN 0 THEN length(text) WHEN 1 THEN length(bare) WHEN 2 THEN 0 ELSE length(text) + 30 END AS INTEGER) AS chars_after,
  CAST(CASE k WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS INTEGER) AS num_blocks, CAST(CASE k WHEN 3 THEN 1 ELSE 0 END AS INTEGER) AS num_tables FROM seen""",
    "page_main_content": f"""WITH {PAGE}, b AS (SELECT page_id, page_id % 3 = 2 AS bare, coalesce(html, '') = '' AS none, text FROM body)
SELECT page_id, CASE WHEN bare THEN 'fallback' WHEN none THEN 'empty' ELSE 'stripped' END AS outcome, CASE WHEN bare THEN 'html-text-content' WHEN none THEN 'raw' ELSE 'content' END AS method,
  CAST(CASE WHEN none AND NOT bare THEN 0 ELSE 1 END AS INTEGER) AS num_blocks, md5(CASE WHEN bare THEN 'few words of page ' || page_id WHEN none THEN '' ELSE text END) AS text FROM b""",
    "page_blocks": f"""WITH {VARIED}
SELECT page_id, 1 AS block_index, CASE WHEN k <> 1 THEN head END AS heading, CASE WHEN k <> 1 THEN 1 ELSE 0 END AS level, CASE WHEN k = 1 THEN bare ELSE array_to_string(parts, chr(10) || chr(10)) END AS text FROM seen WHERE k <> 2
UNION ALL SELECT page_id, 2, 'Part two', 2, 'tail & end' || chr(10) || chr(10) || 'a | b c' FROM seen WHERE k = 3""",
    "ingest_pages_end_to_end": f"""WITH RECURSIVE {SECTIONS}, {SEEN}, good AS (SELECT url || chr(0) || i AS source_url, content FROM sec),
{STEPS}, n AS (SELECT split_part(source_url, chr(0), 1) AS url, count(*) AS n FROM pieces GROUP BY 1),
e AS (SELECT url, coalesce(length(html), 0) > 0 AS ok, {EMPTY.format(t=100)} AS short FROM seen)
SELECT url, CASE WHEN ok AND NOT short THEN 'stored' ELSE 'fetch_failed' END AS status, CASE WHEN ok AND short THEN 'no rendered page' END AS reason,
  CASE WHEN ok AND NOT short THEN 'success' WHEN ok THEN 'empty' ELSE 'failed' END AS fetch_outcome, CAST(CASE WHEN ok AND NOT short THEN n ELSE 0 END AS INTEGER) AS stored_chunks, ok AND NOT short AS written,
  CASE WHEN ok AND NOT short THEN title END AS page_title, CASE WHEN ok AND NOT short THEN 'html' END AS content_type, CASE WHEN ok AND NOT short THEN CAST(0.9 AS DOUBLE) END AS confidence
FROM e JOIN page USING (url) LEFT JOIN n USING (url)""",
    "corpus_of_pages": f"""WITH RECURSIVE {SECTIONS}, {SEEN}, kept AS (SELECT sec.*, url || chr(0) || i AS source_url FROM sec JOIN seen USING (url) WHERE length(html) > 0 AND NOT {EMPTY.format(t=100)}),
good AS (SELECT source_url, content FROM kept),
{STEPS}
SELECT sha1(source_url || chr(0) || chunk_index) AS chunk_id, url AS source_url, heading AS section_heading, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(chunk_total AS INTEGER) AS chunk_total, pieces.content, 64 AS dimension
FROM pieces JOIN kept USING (source_url)""",
    "ingest_outcomes": f"""WITH {MIXED}
SELECT url, ['stored', 'blocked', 'fetch_failed', 'stored', 'flagged', 'no_content', 'flagged', 'stored'][CAST(k + 1 AS INTEGER)] AS status,
  CASE k WHEN 1 THEN 'HTTP 403' WHEN 2 THEN 'HTTP 500' WHEN 4 THEN 'validation failed: 3 errors, repair budget exhausted' WHEN 5 THEN 'fetch succeeded but no usable content (no html, no raw bytes)' WHEN 6 THEN 'validation failed: 2 errors, repair budget exhausted' END AS reason,
  CASE k WHEN 1 THEN 'blocked' WHEN 2 THEN 'failed' WHEN 5 THEN '' ELSE 'success' END AS fetch_outcome, k IN (0, 3, 7) AS written,
  CASE k WHEN 0 THEN 'html' WHEN 3 THEN 'text' WHEN 4 THEN 'unknown' WHEN 6 THEN 'html' WHEN 7 THEN 'text' END AS content_type, CASE k WHEN 4 THEN 'unsupported_content_type' WHEN 6 THEN 'repair_budget_exhausted' END AS flag_reason,
  CASE WHEN k IN (1, 2, 5) THEN NULL WHEN k IN (4, 6) THEN 'no content extracted: sections list is empty; confidence below threshold' || CASE k WHEN 4 THEN '; unsupported content type: unknown' ELSE '' END ELSE '' END AS errors FROM mixed""",
    "ingest_events": f"""WITH {MIXED}, said(event_type, outcome, ks) AS (VALUES
  ('fetch_attempt', 'success', [0, 3, 4, 5, 6, 7]), ('fetch_attempt', 'blocked', [1]), ('fetch_attempt', 'failed', [2]), ('strip_attempt', 'stripped', [0]), ('strip_attempt', 'empty', [6]),
  ('extraction_attempt', 'extracted', [0, 3, 7]), ('extraction_attempt', 'flagged', [4, 6, 6]), ('extraction_flagged', 'flagged', [4, 6, 6]),
  ('validation_attempt', 'valid', [0, 3, 7]), ('validation_attempt', 'repairing', [6]), ('validation_attempt', 'failed', [4, 6]), ('validation_flagged', 'flagged', [4, 6]), ('obstacle_detected', 'flagged', [4, 6]),
  ('chunk_complete', 'ok', [0, 3, 7]), ('ingest_lifecycle', 'fetch_done', [1, 2, 5]), ('ingest_lifecycle', 'validate_done', [4, 6]), ('ingest_lifecycle', 'store_start', [0, 3, 7]), ('ingest_lifecycle', 'completed', [0, 3, 7])),
one AS (SELECT event_type, outcome, unnest(ks) AS k FROM said)
SELECT event_type, outcome, count(*) AS n, count(DISTINCT url) AS urls FROM one JOIN mixed USING (k) GROUP BY ALL""",
    "corpus_lifecycle": f"""WITH {CHUNKS}, p AS (
  SELECT pieces.source_url, pieces.content, coalesce(lang = 'fr', FALSE) AS french FROM pieces JOIN (SELECT {URL} AS source_url, lang, doc_id, source FROM documents) d USING (source_url)
  WHERE NOT (doc_id < 20 AND coalesce(source, '') = 'src' || doc_id))
SELECT source_url, count(*) AS chunks, CAST(sum(length(content) + CAST(french AS INTEGER)) AS BIGINT) AS chars FROM p GROUP BY source_url""",
    "event_store_search": """WITH b AS (SELECT url, '{"size":' || length(html) || '}' AS details_json, CASE WHEN contains(url, '.com/') THEN 0 ELSE 1 END AS batch FROM pages),
n AS (SELECT *, row_number() OVER (ORDER BY batch, url, details_json) AS id FROM b)
SELECT id, url, details_json FROM n WHERE contains(lower(url), '/en/') AND url <> (SELECT min(url) FROM pages) ORDER BY id DESC LIMIT 100""",
    "cascade_deleted": """WITH f AS (SELECT min(url) AS url FROM pages), n AS (SELECT count(*) AS total, count(*) FILTER (url = (SELECT url FROM f)) AS gone FROM pages)
SELECT 'frontier' AS place, total - gone AS n, gone AS deleted FROM n UNION ALL SELECT 'events', 2 * (total - gone), 2 * gone FROM n UNION ALL SELECT 'corpus', total - gone, gone FROM n""",
    "batch_pass": f"""WITH RECURSIVE {SECTIONS}, {SEEN}, good AS (SELECT url || chr(0) || i AS source_url, content FROM sec),
{STEPS}, n AS (SELECT split_part(source_url, chr(0), 1) AS url, count(*) AS n FROM pieces GROUP BY 1),
e AS (SELECT url, coalesce(length(html), 0) > 0 AND NOT {EMPTY.format(t=100)} AS fine FROM seen)
SELECT url, CASE WHEN fine THEN 'done' ELSE 'retrying' END AS state, 1 AS attempts, CASE WHEN NOT fine THEN 'attempts=1/2' END AS reason, CASE WHEN fine THEN n ELSE 0 END AS chunks,
  CASE WHEN NOT fine THEN CAST(epoch(TIMESTAMP '{NOW}') + 5 AS BIGINT) END AS due FROM e LEFT JOIN n USING (url)""",
    "completed_states": f"""WITH {FRONTIER}, m AS (SELECT min(url) AS first FROM pages)
SELECT url, CASE WHEN url = first THEN 'blocked' ELSE state END AS state, CASE WHEN url = first THEN 'by hand' END AS reason, url = first AS asked FROM frontier, m""",
    "url_file_roundtrip": "SELECT url FROM pages",
    "saved_results_sorted": """SELECT CASE doc_id % 10 WHEN 3 THEN 'unreadable record' WHEN 5 THEN 'confidence_out_of_range' WHEN 7 THEN 'scrape_timestamp_missing' ELSE '' END AS reason, count(*) AS n FROM documents GROUP BY 1""",
    "decoded_bodies": "SELECT doc_id, md5(text) AS text FROM documents",
}
