"""The queries of plans.catalogue in DuckDB's SQL, written independently of them."""

from __future__ import annotations

_TAG = "<[^>]+>"


def _html_text(c: str) -> str:
    no_blocks = (
        f"regexp_replace(regexp_replace({c}, '<script[^>]*>.*?</script>', '', 'gis'), "
        "'<style[^>]*>.*?</style>', '', 'gis')"
    )
    return f"trim(regexp_replace(regexp_replace({no_blocks}, '{_TAG}', ' ', 'g'), '\\s+', ' ', 'g'))"


def _html_title(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches({c}, '<title[^>]*>(.*?)</title>', 'is') THEN "
        f"regexp_replace(trim(regexp_extract({c}, '<title[^>]*>(.*?)</title>', 1, 'is')), '\\s+', ' ', 'g') END"
    )


def _text_title(c: str) -> str:
    line = f"trim(split_part(trim({c}, chr(10) || ' '), chr(10), 1))"
    return (
        f"CASE WHEN length({line}) > 100 THEN substring({line}, 1, 100) || '...' "
        f"WHEN length({line}) > 0 THEN {line} ELSE 'Untitled Document' END"
    )


_EXT = "CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.html' WHEN 3 THEN '.json' WHEN 4 THEN '.rst' ELSE '.TXT' END"
_MIME_OF = (
    "CASE doc_id % 6 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'text/html' "
    "WHEN 3 THEN 'application/json' WHEN 4 THEN 'application/octet-stream' ELSE 'text/plain' END"
)
_UUID = (
    "substr(md5(doc_id::VARCHAR),1,8)||'-'||substr(md5(doc_id::VARCHAR),9,4)||'-'||substr(md5(doc_id::VARCHAR),13,4)"
    "||'-'||substr(md5(doc_id::VARCHAR),17,4)||'-'||substr(md5(doc_id::VARCHAR),21,12)"
)
_DOCS = f"""docs AS (SELECT doc_id, 'file:///corpus/'||source||'/'||doc_id||{_EXT} AS source_url, text, source, lang,
  n_chars, {_MIME_OF} AS mime_type, {_UUID} AS unique_id,
  source||'|.txt|'||{_UUID}||'|0' AS cache_id FROM documents)"""
_ITEMS = f"""{_DOCS}, items AS (SELECT 'item_'||doc_id AS item_id, doc_id AS insert_seq, sha256(text) AS content_hash,
  'string' AS content_type, source_url, CASE WHEN doc_id % 2 = 0 THEN cache_id END AS location,
  'extracted' AS processing_state, source AS author, lang, 'text/plain' AS mime_type
  FROM docs WHERE doc_id IN (SELECT doc_id FROM labels))"""
_URLS = f"{_DOCS}, urls AS (SELECT source_url FROM docs UNION ALL SELECT url FROM pages)"
# The last dot of the last part of a path and what follows it, by string functions: nothing if that dot
# is the first or the last character.
_LAST = "list_last(string_split(rtrim(source_url, '/'), '/'))"
_AFTER = f"list_last(string_split({_LAST}, '.'))"
_SUFFIX = (
    f"CASE WHEN contains({_LAST}, '.') AND length({_AFTER}) > 0 AND length({_AFTER}) + 1 < length({_LAST}) "
    f"THEN '.'||{_AFTER} ELSE '' END"
)
_LOG = """log AS (SELECT event_type AS partition_key, user_id::VARCHAR AS key, props AS value_json,
  json_extract_string(props, '$.k')::INTEGER AS version, ts, event_id FROM events)"""


def _latest(name: str, where: str = "true", log: str = "log") -> str:
    return (
        f"{name} AS (SELECT partition_key, key, value_json, version FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY partition_key, key ORDER BY ts DESC, event_id DESC) AS rn FROM {log} WHERE {where}) WHERE rn = 1)"
    )


_STATE = f"{_LOG}, {_latest('latest')}"


def _snapshot(name: str, when: str) -> str:
    """The state as it was then, of the keys with an entry in the three days before."""
    return (
        f"{name} AS (SELECT partition_key, key, value_json, version FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY partition_key, key ORDER BY ts DESC, event_id DESC) AS rn FROM log WHERE ts < TIMESTAMP '{when}') "
        f"WHERE rn = 1 AND ts >= TIMESTAMP '{when}' - INTERVAL 3 DAY)"
    )


_SNAPS = f"{_LOG}, {_snapshot('o', '2024-01-16')}, {_snapshot('n', '2024-02-01')}"
# What the files of the corpus hold: (doc_id, rel, ext, kind, text as read).
_FILES = f"""files AS (SELECT doc_id, source||'/'||doc_id||{_EXT} AS relative_path, doc_id||{_EXT} AS name, {_EXT} AS ext,
  {_MIME_OF} AS mime_type, doc_id % 10 AS kind, text,
  octet_length(encode(text)) + CASE doc_id % 10 WHEN 7 THEN length(text) - length(replace(text, chr(10), ''))
    WHEN 8 THEN 1 WHEN 9 THEN 2 ELSE 0 END AS file_size,
  CASE WHEN doc_id % 10 = 8 THEN chr(0)||text ELSE text END AS read_text FROM documents)"""
_INDEXED = f"""WITH {_FILES} SELECT relative_path,
  CASE WHEN ext = '.html' THEN coalesce(nullif({_html_title('read_text')}, ''), name) ELSE name END AS title,
  sha256(CASE WHEN ext = '.html' THEN {_html_text('read_text')} ELSE read_text END) AS content_hash,
  'string' AS content_type, 'text/plain' AS mime_type, 'extracted' AS processing_state
  FROM files WHERE kind <> 9 AND ext IN ('.txt', '.md', '.html', '.TXT')"""
_RAW = """CASE doc_id % 10 WHEN 7 THEN encode(replace(text, chr(10), chr(13)||chr(10))) WHEN 8 THEN encode(chr(0)||text)
  WHEN 9 THEN '\\xFF\\xFE'::BLOB || encode(text) ELSE encode(text) END"""
_PAGES_STORED = f"""SELECT url AS source_url,
  coalesce(nullif({_html_title('html')}, ''), nullif('Content from '||url, ''), 'Untitled HTML Document') AS title,
  sha256({_html_text('html')}) AS content_hash"""
_EXTRACTOR = (
    "CASE WHEN mime_type IN ('text/plain','text/markdown') THEN 'text' WHEN mime_type = 'text/html' THEN 'html' END"
)
_CONV_LAST = (
    "last AS (SELECT 'item_'||conv_id AS item_id, conv_id, turn, role, text FROM (SELECT *, row_number() OVER "
    "(PARTITION BY conv_id ORDER BY turn DESC) rn FROM conversations) WHERE rn = 1)"
)
_DIFF_ROWS = """SELECT {keys}, unnest(CASE
    WHEN o_in IS NULL THEN [{{'kind': 'added', 'value_json': nv}}]
    WHEN n_in IS NULL THEN [{{'kind': 'removed', 'value_json': ov}}]
    WHEN ov = nv THEN [{{'kind': 'unchanged', 'value_json': nv}}]
    ELSE [{{'kind': 'removed', 'value_json': ov}}, {{'kind': 'added', 'value_json': nv}}] END, recursive := true)
  FROM (SELECT coalesce(o.partition_key, n.partition_key) AS partition_key, coalesce(o.key, n.key) AS key,
    o.key AS o_in, n.key AS n_in, {ov} AS ov, {nv} AS nv
    FROM o FULL JOIN n ON o.partition_key = n.partition_key AND o.key = n.key {where})"""
_FLAT_DIFF = _DIFF_ROWS.format(keys="partition_key, key", ov="o.value_json", nv="n.value_json", where="")
_NESTED_DIFF = "SELECT key, partition_key||'.k' AS path, kind, value_json FROM (" + _DIFF_ROWS.format(
    keys="partition_key, key",
    ov="json_extract_string(o.value_json, '$.k')",
    nv="json_extract_string(n.value_json, '$.k')",
    where="WHERE coalesce(o.key, n.key) IN (SELECT key FROM o)",
) + ")"
_CONFIG = (
    "config AS (SELECT doc_id, json_object('doc', doc_id, 'plugin', json_object('limits', "
    "json_object('lang', lang, 'n_chars', n_chars), 'name', source)) AS r FROM documents)"
)
_STAGES = f"""{_URLS}, stages AS (
  SELECT 'fetch' AS stage, 'success' AS status, 'Fetched content' AS message, count(*) AS rows FROM urls GROUP BY ALL
  UNION ALL SELECT 'extract', CASE WHEN {_EXTRACTOR} IS NULL THEN 'error' ELSE 'success' END,
    CASE WHEN {_EXTRACTOR} IS NULL THEN 'No extractor found for content type' ELSE 'Content extraction completed' END,
    count(*) FROM docs GROUP BY ALL
  UNION ALL SELECT 'store', 'success', 'Content stored successfully', count(*) FROM docs
    WHERE {_EXTRACTOR} IS NOT NULL GROUP BY ALL)"""

ORACLE = {
    "index_pages": f"""SELECT page_id, url AS source_url,
      coalesce(nullif({_html_title('html')}, ''), 'Content from '||url) AS title,
      length({_html_text('html')}) AS text_length, sha256({_html_text('html')}) AS content_hash,
      'html' AS extractor, 'extracted' AS processing_state FROM pages""",
    "discover_files": f"""WITH {_FILES} SELECT relative_path, file_size, 'directory' AS source_plugin
      FROM files WHERE ext IN ('.txt', '.md')""",
    "read_files": f"""WITH {_FILES} SELECT relative_path, name AS title, mime_type,
      CASE WHEN kind = 8 THEN 'blob' ELSE 'string' END AS content_type,
      CASE WHEN kind <> 9 THEN sha256(read_text) END AS content_hash,
      CASE WHEN kind = 9 THEN 'content is not valid UTF-8' END AS error FROM files""",
    "fetched_pages": """SELECT url AS source_url, 'Content from '||url AS title, 'text/html' AS mime_type,
      html AS content_text, 'http' AS fetcher FROM pages""",
    "scan_items": f"WITH {_ITEMS} SELECT item_id, source_url, mime_type, processing_state, author FROM items",
    "append_retry": f"WITH {_ITEMS} SELECT item_id, source_url, mime_type, processing_state, author FROM items",
    "append_items": f"""WITH {_DOCS}, x AS (SELECT doc_id AS insert_seq, source_url,
        {_EXTRACTOR} AS extractor, CASE WHEN {_EXTRACTOR} = 'html' THEN {_html_text('text')} ELSE text END AS t,
        CASE WHEN {_EXTRACTOR} = 'html' THEN coalesce(nullif({_html_title('text')}, ''), 'Untitled HTML Document')
          ELSE {_text_title('text')} END AS title FROM docs)
      SELECT sha256(source_url||'|'||sha256(t)||'|'||insert_seq) AS item_id, insert_seq, sha256(t) AS content_hash,
        'string' AS content_type, source_url, title, 'text/plain' AS mime_type, 'extracted' AS processing_state
      FROM x WHERE extractor IS NOT NULL""",
    "store_content": f"""WITH {_DOCS} SELECT source_url, sha256(text) AS content_hash, 'string' AS content_type,
      mime_type, 'pending' AS processing_state FROM docs""",
    "scan_state": f"WITH {_STATE} SELECT key, value_json, version FROM latest WHERE partition_key = 'click'",
    "state_store": f"""WITH {_STATE} SELECT partition_key, key, value_json,
      CASE WHEN partition_key = 'error' THEN 1 ELSE version END AS version FROM latest""",
    "cache_save": f"WITH {_DOCS} SELECT cache_id, source AS partition_key FROM docs",
    "cache_list": f"WITH {_DOCS} SELECT cache_id FROM docs WHERE source = 'src3'",
    "mime_from_path": f"""WITH {_URLS} SELECT source_url, CASE lower({_SUFFIX})
      WHEN '.txt' THEN 'text/plain' WHEN '.md' THEN 'text/markdown' WHEN '.html' THEN 'text/html'
      WHEN '.htm' THEN 'text/html' WHEN '.json' THEN 'application/json' WHEN '.xml' THEN 'application/xml'
      WHEN '.pdf' THEN 'application/pdf' WHEN '.doc' THEN 'application/msword'
      WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
      ELSE 'application/octet-stream' END AS mime_type FROM urls""",
    "path_suffix": f"WITH {_URLS} SELECT source_url, {_SUFFIX} AS suffix FROM urls",
    "file_name": f"""WITH {_URLS} SELECT source_url, list_last(string_split(rtrim(source_url, '/'), '/')) AS name FROM urls""",
    "is_binary": "SELECT doc_id, doc_id % 10 = 8 AS is_binary FROM documents",
    "decode_text": """SELECT doc_id, CASE doc_id % 10 WHEN 9 THEN NULL WHEN 8 THEN chr(0)||text ELSE text END AS text
      FROM documents""",
    "text_title": f"SELECT doc_id, {_text_title('text')} AS title FROM documents",
    "html_text": f"SELECT page_id, {_html_text('html')} AS text FROM pages",
    "html_title": f"SELECT page_id, {_html_title('html')} AS title FROM pages",
    "resolve_title": f"""SELECT 'doc/'||doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN source ELSE {_text_title('text')} END
        AS title FROM documents
      UNION ALL SELECT 'page/'||page_id, coalesce(nullif({_html_title('html')}, ''), url) FROM pages""",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "content_type": "SELECT doc_id, CASE WHEN doc_id % 10 = 8 THEN 'blob' ELSE 'string' END AS content_type FROM documents",
    "text_length": "SELECT doc_id, length(text) AS text_length FROM documents",
    "metadata_copy": f"""WITH {_DOCS} SELECT source_url, source AS author, 'text/plain' AS mime_type,
      'extracted' AS processing_state, NULL::VARCHAR AS title FROM docs""",
    "default_source_url": f"""WITH {_DOCS} SELECT doc_id, CASE WHEN quality = 1 THEN source_url ELSE 'unknown' END AS source_url
      FROM docs LEFT JOIN labels USING (doc_id)""",
    "metadata_json": f"""WITH {_ITEMS} SELECT source_url, NULL::VARCHAR AS title, author, mime_type, processing_state,
      author||','||lang AS tags, '{{}}' AS extra_json FROM items""",
    "nested_get": f"""WITH {_CONFIG} SELECT doc_id, (r->'$.plugin.limits.n_chars')::VARCHAR AS n_chars,
      (r->'$.plugin.limits.lang')::VARCHAR AS lang,
      coalesce((r->'$.plugin.name.deeper')::VARCHAR, 'none') AS not_an_object,
      coalesce((r->'$.plugin.missing')::VARCHAR, 'none') AS missing FROM config""",
    "nested_section": f"""WITH {_CONFIG} SELECT doc_id, (r->'$.plugin')::VARCHAR AS section,
      CASE WHEN json_type(r->'$.doc') = 'OBJECT' THEN (r->'$.doc')::VARCHAR ELSE '{{}}' END AS not_an_object,
      coalesce((r->'$.missing')::VARCHAR, '{{}}') AS missing FROM config""",
    "cache_id_encode": f"WITH {_DOCS} SELECT unique_id, cache_id FROM docs",
    "cache_id_decode": f"""WITH {_DOCS} SELECT CASE WHEN doc_id % 5 = 0 THEN source||'|.txt|'||unique_id ELSE cache_id END AS cache_id,
      CASE WHEN doc_id % 5 <> 0 THEN source END AS partition_key, CASE WHEN doc_id % 5 <> 0 THEN '.txt' END AS file_extension,
      CASE WHEN doc_id % 5 <> 0 THEN false END AS is_binary FROM docs""",
    "cache_path_decode": f"""WITH {_DOCS}, f AS (SELECT doc_id, source||'/'||CASE doc_id % 4 WHEN 3 THEN 'not-a-valid-uuid.txt'
        WHEN 1 THEN unique_id||'.bin.jpg' WHEN 2 THEN unique_id ELSE unique_id||'.tar.gz' END AS file_path FROM docs),
      m AS (SELECT *, '^([^/]+)/([0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}})(\\.bin)?(\\..*)?$' AS p FROM f),
      d AS (SELECT *, regexp_matches(file_path, p) AS ok FROM m)
      SELECT doc_id, file_path, CASE WHEN ok THEN regexp_extract(file_path, p, 1) END AS partition_key,
        CASE WHEN ok THEN regexp_extract(file_path, p, 4) END AS file_extension,
        CASE WHEN ok THEN regexp_extract(file_path, p, 2) END AS unique_id,
        CASE WHEN ok THEN regexp_extract(file_path, p, 3) = '.bin' END AS is_binary FROM d""",
    "file_uri": f"""WITH {_DOCS} SELECT doc_id, source_url AS from_listing, 'file:///corpus/'||source AS from_path FROM docs""",
    "filter_extensions": f"""WITH {_DOCS} SELECT source_url FROM docs
      WHERE source_url LIKE '%.txt' OR source_url LIKE '%.md'""",
    "can_fetch_file": f"""WITH {_ITEMS} SELECT source_url, true AS can_fetch FROM docs
      UNION ALL SELECT substr(source_url, 8), doc_id IN (SELECT doc_id FROM labels) FROM docs""",
    "can_fetch_http": f"WITH {_URLS} SELECT source_url, source_url LIKE 'http%' AS can_fetch FROM urls",
    "can_extract_text": f"""WITH {_DOCS} SELECT source_url, mime_type, mime_type LIKE 'text/%' AS can_extract FROM docs
      UNION ALL SELECT source_url, NULL, regexp_matches(lower(source_url), '\\.(txt|md|rst|log|cfg|ini|conf)$') FROM docs""",
    "can_extract_html": f"""WITH {_DOCS} SELECT source_url, mime_type, mime_type = 'text/html' AS can_extract FROM docs
      UNION ALL SELECT source_url, NULL, regexp_matches(lower(source_url), '\\.(html|htm|xhtml)$') FROM docs""",
    "preferred_mime": f"""WITH {_DOCS} SELECT source_url, mime_type IN ('text/plain','text/markdown') AS text_preferred,
      mime_type = 'text/html' AS html_preferred FROM docs""",
    "state_get": f"""WITH {_STATE} SELECT 'click' AS partition_key, c_custkey::VARCHAR AS key,
      l.key IS NOT NULL AS found, CASE WHEN l.key IS NULL THEN '"none"' ELSE value_json END AS value_json
      FROM customer LEFT JOIN latest l ON l.partition_key = 'click' AND l.key = c_custkey::VARCHAR""",
    "state_lookup": f"""WITH {_STATE} SELECT 'click' AS partition_key, c_custkey::VARCHAR AS key,
      l.key IS NOT NULL AS found, CASE WHEN l.key IS NULL THEN '"none"' ELSE value_json END AS value_json
      FROM customer LEFT JOIN latest l ON l.partition_key = 'click' AND l.key = c_custkey::VARCHAR""",
    "state_older_than": f"""WITH {_STATE} SELECT key, value_json, version FROM latest
      WHERE partition_key = 'click' AND version < 50 ORDER BY version, key""",
    "state_keys_with_value": f"""WITH {_STATE} SELECT key FROM latest
      WHERE partition_key = 'click' AND value_json = '{{"k": 5}}'""",
    "state_exists": f"""WITH {_STATE} SELECT partition_key, key, partition_key <> 'error' AS exists FROM latest""",
    "state_delete": f"""WITH {_STATE} SELECT partition_key, key,
      CASE WHEN partition_key = 'error' THEN 'null' ELSE value_json END AS value_json,
      CASE WHEN partition_key = 'error' THEN 1 ELSE version END AS version FROM latest""",
    "item_lookup": f"WITH {_ITEMS} SELECT item_id, source_url, mime_type, processing_state, author FROM items",
    "find_item": f"WITH {_ITEMS} SELECT item_id, source_url, mime_type, processing_state, author FROM items",
    "cache_get": f"""WITH {_DOCS} SELECT cache_id, source AS partition_key, text AS content_text, false AS is_binary
      FROM docs WHERE doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM labels)""",
    "skip_existing": f"""WITH {_ITEMS} SELECT source_url, source AS author FROM docs
      WHERE source_url NOT IN (SELECT source_url FROM items)""",
    "find_item_id": f"""WITH {_ITEMS}, f AS (SELECT source_url, arg_min(item_id, insert_seq) AS item_id FROM items GROUP BY 1)
      SELECT d.source_url, f.item_id FROM docs d LEFT JOIN f USING (source_url)""",
    "route_fetch": f"""WITH {_URLS} SELECT source_url,
      CASE WHEN source_url LIKE 'file:%' THEN 'file' WHEN regexp_matches(source_url, '^https?:') THEN 'http' END AS fetcher,
      'success' AS route_status, 'Fetched content from '||source_url AS message FROM urls""",
    "route_extract": f"""WITH {_DOCS} SELECT source_url, mime_type, {_EXTRACTOR} AS extractor,
      CASE WHEN {_EXTRACTOR} IS NULL THEN 'error' ELSE 'success' END AS route_status,
      CASE WHEN {_EXTRACTOR} IS NULL THEN 'No extractor found for content type: '||mime_type
        ELSE 'Content extraction completed' END AS message FROM docs""",
    "extract_documents": f"""WITH {_DOCS}, x AS (SELECT *, {_EXTRACTOR} AS extractor FROM docs)
      SELECT source_url, CASE extractor WHEN 'text' THEN {_text_title('text')}
          WHEN 'html' THEN coalesce(nullif({_html_title('text')}, ''), 'Untitled HTML Document') END AS title,
        CASE extractor WHEN 'text' THEN text WHEN 'html' THEN {_html_text('text')} END AS content_text, extractor,
        CASE WHEN extractor IS NULL THEN 'error' ELSE 'success' END AS route_status,
        CASE WHEN extractor IS NULL THEN 'No extractor found for content type: '||mime_type END AS error,
        CASE WHEN extractor IS NULL THEN 'pending' ELSE 'extracted' END AS processing_state,
        CASE WHEN extractor IS NULL THEN mime_type ELSE 'text/plain' END AS mime_type FROM x""",
    "update_items": f"""WITH {_ITEMS}, {_CONV_LAST} SELECT item_id, source_url,
      coalesce(sha256(last.text), content_hash) AS content_hash,
      CASE WHEN last.item_id IS NULL THEN content_type ELSE 'blob' END AS content_type
      FROM items LEFT JOIN last USING (item_id)""",
    "update_metadata": f"""WITH {_ITEMS}, {_CONV_LAST} SELECT item_id,
      CASE WHEN conv_id IS NULL THEN source_url ELSE 'conv://'||conv_id END AS source_url,
      CASE WHEN conv_id IS NULL THEN processing_state ELSE 'completed' END AS processing_state,
      CASE WHEN conv_id IS NULL THEN author ELSE role END AS author,
      CASE WHEN conv_id IS NULL THEN mime_type END AS mime_type, content_hash
      FROM items LEFT JOIN last USING (item_id)""",
    "remove_item": f"""WITH {_ITEMS} SELECT item_id, CASE WHEN item_id IN (SELECT 'item_'||conv_id FROM conversations)
      THEN 'cache_'||item_id END AS cache_id, location FROM items""",
    "remove_by_url": """SELECT conv_id||'/'||turn AS item_id, CASE WHEN conv_id IN
      (SELECT doc_id FROM labels WHERE quality = 0) THEN 'cache_'||conv_id||'/'||turn END AS cache_id FROM conversations""",
    "cache_remove": f"""WITH {_DOCS} SELECT cache_id, doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM labels) AS removed FROM docs""",
    "cache_orphans": f"""WITH {_ITEMS} SELECT cache_id, source AS partition_key FROM docs
      WHERE cache_id NOT IN (SELECT location FROM items WHERE location IS NOT NULL)""",
    "snapshot_diff": f"WITH {_SNAPS} {_FLAT_DIFF}",
    "snapshot_stored_diff": f"WITH {_SNAPS} {_FLAT_DIFF}",
    "snapshot_changes": f"WITH {_SNAPS}, d AS ({_FLAT_DIFF}) SELECT * FROM d WHERE kind <> 'unchanged'",
    "snapshot_small_change": """WITH d AS (SELECT * FROM documents
        WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
      SELECT doc_id::VARCHAR AS key, 'added' AS kind, '"blocked"' AS value_json FROM d
      UNION ALL SELECT doc_id::VARCHAR, 'removed',
        '{"source":"'||source||'","lang":"'||lang||'","n_chars":'||n_chars||'}' FROM d""",
    "nested_diff": f"WITH {_SNAPS} {_NESTED_DIFF}",
    "diff_has_changed": f"""WITH {_SNAPS}, d AS ({_NESTED_DIFF})
      SELECT key, bool_or(kind <> 'unchanged' AND path = 'click.k') AS changed FROM d GROUP BY key""",
    "diff_addition": f"""WITH {_SNAPS}, d AS ({_NESTED_DIFF})
      SELECT key, value_json FROM d WHERE kind = 'added' AND path = 'click.k'""",
    "diff_removal": f"""WITH {_SNAPS}, d AS ({_NESTED_DIFF})
      SELECT key, 'k' AS path, value_json FROM d WHERE kind = 'removed' AND path = 'click.k'""",
    "snapshot_history": """WITH d AS (SELECT doc_id::VARCHAR AS key, * FROM documents JOIN labels USING (doc_id))
      SELECT key, 'plugin.limits.n_chars' AS path, 'unchanged' AS kind, n_chars::VARCHAR AS value_json FROM d
      UNION ALL SELECT key, 'plugin.limits.lang', 'unchanged', '"'||lang||'"' FROM d
      UNION ALL SELECT key, 'plugin.name', CASE WHEN toxic = 1 THEN 'removed' ELSE 'unchanged' END, '"'||source||'"' FROM d
      UNION ALL SELECT key, 'plugin.name', 'added', '"blocked"' FROM d WHERE toxic = 1
      UNION ALL SELECT key, 'label.quality', 'added', quality::VARCHAR FROM d""",
    "duplicate_groups": """SELECT sha256(text) AS content_hash, count(*) AS copies,
      'item_'||min(doc_id) AS first_item_id FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "dedup_by_hash": f"""WITH {_DOCS} SELECT sha256(text) AS content_hash, 'item_'||min(doc_id) AS item_id,
      min(doc_id) AS insert_seq, arg_min(source_url, doc_id) AS source_url, arg_min(source, doc_id) AS author,
      count(*) AS copies FROM docs GROUP BY 1""",
    "discovery_summary": f"""WITH {_ITEMS} SELECT count(*) FILTER (source_url NOT IN (SELECT source_url FROM items)) AS scheduled,
      count(*) FILTER (source_url IN (SELECT source_url FROM items)) AS skipped, count(*) AS discovered FROM docs""",
    "stage_status": f"WITH {_STAGES} SELECT stage, status, message, rows FROM stages",
    "pipeline_health": f"""WITH {_STAGES}, c AS (SELECT stage, bool_and(status <> 'success') AS dead,
      bool_or(status <> 'success') AS ill FROM stages GROUP BY 1)
      SELECT CASE WHEN bool_or(dead) THEN 'unhealthy' WHEN bool_or(ill) THEN 'degraded' ELSE 'healthy' END AS status FROM c""",
    "backlog": f"""WITH {_ITEMS} SELECT coalesce(i.processing_state, 'pending') AS processing_state, count(*) AS rows
      FROM docs d LEFT JOIN items i USING (source_url) GROUP BY 1 HAVING coalesce(i.processing_state, 'pending') <> 'completed'""",
    "layered_merge": """WITH lastturn AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
      SELECT conv_id, 'role' AS path, 'scalar' AS kind, turn AS layer, NULL::BIGINT AS idx, to_json(role)::VARCHAR AS value_json FROM lastturn
      UNION ALL SELECT conv_id, 'text', 'scalar', turn, NULL, to_json(text)::VARCHAR FROM lastturn
      UNION ALL SELECT conv_id, 'seen.'||role, 'scalar', max(turn), NULL, max(turn)::VARCHAR FROM conversations GROUP BY conv_id, role
      UNION ALL SELECT conv_id, 'roles', 'list', turn, 0, to_json(role)::VARCHAR FROM conversations""",
    "metadata_merge": """SELECT 'conv://'||conv_id AS source_url, arg_max(text, turn) FILTER (role = 'user') AS title,
      arg_max(text, turn) FILTER (role = 'assistant') AS description, arg_max(role, turn) FILTER (turn % 2 = 0) AS author,
      arg_max(CASE WHEN role = 'system' THEN 'completed' ELSE 'pending' END, turn) AS processing_state
      FROM conversations GROUP BY conv_id""",
    "metadata_merge_apply": """SELECT 'item_'||conv_id AS item_id, arg_max(text, turn) FILTER (role = 'user') AS title,
      arg_max(role, turn) FILTER (turn % 2 = 0) AS author,
      arg_max(CASE WHEN role = 'system' THEN 'completed' ELSE 'pending' END, turn) AS processing_state,
      string_agg(role||','||turn, ',' ORDER BY turn) AS tags, arg_max(role, turn) AS last_role,
      (max(turn) FILTER (role = 'user'))::VARCHAR AS last_user_turn FROM conversations GROUP BY conv_id""",
    "metadata_merge_tags": """SELECT 'conv://'||conv_id AS source_url, turn AS seq, 0::BIGINT AS idx, role AS tag FROM conversations
      UNION ALL SELECT 'conv://'||conv_id, turn, 1, turn::VARCHAR FROM conversations""",
    "metadata_merge_extra": """SELECT 'conv://'||conv_id AS source_url, 'roles.'||role AS path, max(turn)::VARCHAR AS value_json
        FROM conversations GROUP BY conv_id, role
      UNION ALL SELECT 'conv://'||conv_id, 'last.turn', max(turn)::VARCHAR FROM conversations GROUP BY conv_id
      UNION ALL SELECT 'conv://'||conv_id, 'last.role', to_json(arg_max(role, turn))::VARCHAR FROM conversations GROUP BY conv_id""",
    "state_latest": f"WITH {_STATE} SELECT partition_key, key, value_json, version FROM latest",
    "item_ids": """SELECT 'item_'||row_number() OVER (ORDER BY doc_id) AS item_id,
      row_number() OVER (ORDER BY doc_id) AS item_number, doc_id * 7 AS insert_seq FROM documents""",
    "first_item_per_url": """SELECT 'conv://'||conv_id AS source_url, conv_id||'/'||max(turn) AS item_id
      FROM conversations GROUP BY conv_id""",
    "extractor_rank": f"""WITH {_DOCS}, c AS (
        SELECT source_url, 'text' AS extractor, mime_type IN ('text/plain','text/markdown') AS preferred, 1 AS priority
          FROM docs WHERE mime_type LIKE 'text/%'
        UNION ALL SELECT source_url, 'html', true, 2 FROM docs WHERE mime_type = 'text/html')
      SELECT source_url, (row_number() OVER (PARTITION BY source_url ORDER BY NOT preferred, priority))::INTEGER AS rank,
        extractor, preferred, priority FROM c""",
    "layer_order": """WITH l AS (SELECT DISTINCT CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS rank,
        source||'.yaml' AS name FROM documents)
      SELECT rank, name, row_number() OVER (ORDER BY rank, name) AS layer FROM l""",
    "union_sources": f"""WITH {_DOCS} SELECT source_url, n_chars AS file_size, 'documents' AS source, NULL::VARCHAR AS error FROM docs
      UNION ALL SELECT url, NULL, 'pages', NULL FROM pages
      UNION ALL SELECT NULL, NULL, 'broken', 'PATH_NOT_FOUND'""",
    "key_union": f"WITH {_SNAPS} SELECT partition_key, key FROM o UNION SELECT partition_key, key FROM n",
    "keys_added": f"WITH {_SNAPS} SELECT partition_key, key FROM n EXCEPT SELECT partition_key, key FROM o",
    "keys_removed": f"WITH {_SNAPS} SELECT partition_key, key FROM o EXCEPT SELECT partition_key, key FROM n",
    "extract_nested": f"""WITH {_DOCS},
      lines AS (SELECT source_url AS root_url, source_url||'/line'||(i - 1) AS parent_url, l[i] AS line, source FROM (
        SELECT source_url, source, list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '') AS l,
          unnest(range(1, len(l) + 1)) AS i FROM docs)),
      parts AS (SELECT root_url, parent_url, parent_url||'/sentence'||(i - 1) AS source_url, s[i] AS t, source FROM (
        SELECT root_url, parent_url, source, list_filter(string_split(line, '. '), lambda p: trim(p) <> '') AS s,
          unnest(range(1, len(s) + 1)) AS i FROM lines))
      SELECT source_url, parent_url, root_url, 2::INTEGER AS depth, {_text_title('t')} AS title, t AS content_text,
        source AS author, 'text' AS extractor FROM parts""",
    "item_tree": """WITH RECURSIVE p AS (SELECT conv_id||'/'||turn AS item_id,
        CASE WHEN turn > 0 THEN conv_id||'/'||(turn - 1) END AS parent_id FROM conversations),
      t AS (SELECT item_id, parent_id, 0::BIGINT AS depth, item_id AS root_id FROM p
          WHERE parent_id IS NULL OR parent_id NOT IN (SELECT item_id FROM p)
        UNION ALL SELECT p.item_id, p.parent_id, t.depth + 1, t.root_id FROM p JOIN t ON p.parent_id = t.item_id)
      SELECT * FROM t""",
    "discover_stream": f"WITH {_FILES} SELECT relative_path, file_size FROM files WHERE ext IN ('.txt', '.md')",
    "listing_stream": f"WITH {_FILES} SELECT relative_path, file_size FROM files WHERE ext IN ('.txt', '.md')",
    "index_folder": _INDEXED,
    "index_stream": _INDEXED,
    "resume": _INDEXED,
    "index_two_writers": _INDEXED,
    "index_errors": f"""WITH {_FILES} SELECT relative_path, CASE WHEN kind = 9 THEN 'fetch' ELSE 'extract' END AS stage,
      CASE WHEN kind = 9 THEN 'content is not valid UTF-8' ELSE 'No extractor found for content type: '||mime_type END AS message
      FROM files WHERE kind = 9 OR ext NOT IN ('.txt', '.md', '.html', '.TXT')""",
    "remove_retry": f"""WITH {_ITEMS} SELECT item_id,
      CASE WHEN item_id NOT IN (SELECT 'item_'||conv_id FROM conversations) THEN 'new' END AS content_hash FROM items""",
    "cache_remove_retry": f"""WITH {_DOCS} SELECT cache_id,
      doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM labels) AS removed FROM docs""",
    "register_binary_extractor": f"""WITH {_FILES}, r AS (SELECT *, {_RAW} AS raw FROM files)
      SELECT relative_path AS source_url, CASE WHEN ext = '.json' THEN 'digest' WHEN ext = '.html' THEN 'html'
          WHEN ext IN ('.txt', '.md', '.TXT') THEN 'text' END AS extractor,
        CASE WHEN ext = '.json' THEN sha256(raw) END AS digest,
        CASE WHEN ext = '.rst' THEN 'No extractor found for content type: application/octet-stream'
          WHEN kind = 9 AND ext <> '.json' THEN 'content is not valid UTF-8' END AS error FROM r""",
    "extract_binary_members": f"""WITH {_FILES}, r AS (SELECT relative_path, {_RAW} AS raw FROM files),
      h AS (SELECT *, hex(raw) AS x, octet_length(raw) // 2 AS half FROM r)
      SELECT relative_path||'/head' AS source_url, sha256(unhex(substr(x, 1, 2 * half))) AS digest, NULL::VARCHAR AS error FROM h
      UNION ALL SELECT relative_path||'/tail', sha256(unhex(substr(x, 2 * half + 1))), NULL::VARCHAR FROM h""",
    "dedup_stream": "SELECT DISTINCT 'conv://'||conv_id AS source_url FROM conversations",
    "state_stream": f"WITH {_STATE} SELECT partition_key, key, value_json, version FROM latest",
    "state_changes": f"WITH {_STATE} SELECT partition_key, key, value_json, version FROM latest",
    "latest_stream": f"WITH {_STATE} SELECT partition_key, key, value_json, version FROM latest",
    "register_extractor": f"""WITH {_DOCS}, x AS (SELECT *, CASE WHEN mime_type = 'application/json' THEN 'json'
        ELSE {_EXTRACTOR} END AS extractor FROM docs)
      SELECT source_url, CASE extractor WHEN 'text' THEN {_text_title('text')} WHEN 'json' THEN substr(text, 1, 20)
          WHEN 'html' THEN coalesce(nullif({_html_title('text')}, ''), 'Untitled HTML Document') END AS title,
        CASE extractor WHEN 'text' THEN text WHEN 'html' THEN {_html_text('text')} WHEN 'json' THEN 'json: '||text END
          AS content_text, extractor,
        CASE WHEN extractor IS NULL THEN 'No extractor found for content type: '||mime_type END AS error FROM x""",
    "register_arrow_extractor": f"""WITH {_DOCS}, x AS (SELECT *, CASE WHEN mime_type = 'application/json' THEN 'json'
        ELSE {_EXTRACTOR} END AS extractor FROM docs)
      SELECT source_url, CASE extractor WHEN 'text' THEN {_text_title('text')} WHEN 'json' THEN CASE WHEN length(text) >= 300 THEN substr(text, 1, 20) END
          WHEN 'html' THEN coalesce(nullif({_html_title('text')}, ''), 'Untitled HTML Document') END AS title,
        CASE extractor WHEN 'text' THEN text WHEN 'html' THEN {_html_text('text')} WHEN 'json' THEN
          CASE WHEN length(text) >= 300 THEN 'json: '||text END END
          AS content_text, extractor,
        CASE WHEN extractor IS NULL THEN 'No extractor found for content type: '||mime_type
          WHEN extractor = 'json' AND length(text) < 300 THEN 'ValueError: '||length(text)||' characters' END AS error,
        CASE WHEN extractor IS NULL OR (extractor = 'json' AND length(text) < 300) THEN 'pending' ELSE 'extracted' END
          AS processing_state FROM x""",
    "register_fetcher": f"{_PAGES_STORED}, 'text/plain' AS mime_type FROM pages",
    "register_source": f"{_PAGES_STORED} FROM pages",
    "register_store": f"{_PAGES_STORED} FROM pages",
}
