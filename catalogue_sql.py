"""SQL twins of the named queries, for an independent check in DuckDB.

Written against the plain tables with naive plans (cross joins, string functions);
nothing here is used by the library itself.
"""

from __future__ import annotations

from procura import vocab
from procura.plans.catalogue import LINK_KEYWORDS, SOURCE_WORDS, TEMPLATE

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


def _any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {_q(w)})" for w in words) + ")"


def _strip(x: str) -> str:
    return f"trim({x}, {BLANK})"


def _norm(x: str) -> str:
    out = f"lower({x})"
    for a, b in (("'ё'", "'е'"), ("'й'", "'и'"), ("chr(774)", "''"), ("'_'", "' '"), ("'-'", "' '")):
        out = f"replace({out}, {a}, {b})"
    return _strip(out)


def _tokens(x: str) -> str:
    return (
        f"list_filter(regexp_extract_all({_norm(x)}, '[a-zа-я0-9]+'), "
        f"lambda w: length(w) >= 4 AND w NOT IN {_list(vocab.STOPWORDS)})"
    )


def _suffix(name: str) -> str:
    return f"regexp_extract({name}, '^.+(\\.[^.]+)$', 1)"


LOTS = """lots AS (
  SELECT CAST(b.item_id AS INTEGER) AS row_number,
         lpad(CAST(b.item_id * 97 + 13 AS VARCHAR), 5, '0') AS tender_id,
         b.text AS title,
         'https://zakupki.example.org/tender/' || lpad(CAST(b.item_id * 97 + 13 AS VARCHAR), 5, '0') AS url,
         o.o_orderdate AS deadline_at,
         regexp_extract(b.text, '([a-zA-Z]+ [a-zA-Z]+)', 1) AS customer
  FROM benchmark b LEFT JOIN orders o ON o.o_orderkey = b.item_id)"""

_NAME = """CASE d.doc_id % 9 WHEN 0 THEN 'Техническое задание_' WHEN 1 THEN 'CRM-отчёт '
    WHEN 2 THEN 'Проект договора ' ELSE 'doc ' END || lpad(CAST(d.doc_id AS VARCHAR), 7, '0')
    || CASE d.doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.docx' WHEN 2 THEN '.PDF' ELSE '.md' END"""

# Every fiftieth document has an archive without text beside it.
_BOTH = f"""docs AS (
  SELECT doc_id, source, {_NAME} AS name, text AS text_sample FROM documents d
  UNION ALL
  SELECT doc_id, source, 'doc ' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || '.rar', ''
  FROM documents WHERE doc_id % 50 = 7)"""

FILES = f"""{_BOTH}, files AS (
  SELECT '/inbox/' || source || '/' || name AS path, source AS top_dir, name, text_sample FROM docs)"""

FILED = f"""{_BOTH}, files AS (
  SELECT '/inbox/' || top_dir || '/' || name AS path, top_dir, name, text_sample FROM (
    SELECT CASE WHEN d.doc_id % 13 = 5 THEN lpad(CAST(d.doc_id * 97 + 13 AS VARCHAR), 5, '0')
                WHEN b.text IS NOT NULL THEN 'Лот ' || translate(b.text, '/ ', '__')
                ELSE d.source END AS top_dir, d.name, d.text_sample
    FROM docs d LEFT JOIN benchmark b ON b.item_id * 11 + 3 = d.doc_id))"""

READABLE = "NOT (f.text_sample = '' AND lower(" + _suffix("f.name") + ") IN ('.rar', '.7z'))"


def _pairs(explicit: str) -> str:
    """CTEs ``pairs`` (all scored pairs) and ``ranked`` (top five per file)."""
    name = _norm("f.name")
    return f"""
open_lots AS (SELECT * FROM lots WHERE tender_id NOT IN ({explicit})),
hay AS (SELECT path, name, {_norm('path')} || ' ' || {_norm('text_sample')} AS hay,
        CASE WHEN {_any(name, vocab.GENERIC_NAMES)} THEN -2 ELSE 0 END
        + CASE WHEN {_any(name, vocab.PROJECT_MARKERS)} THEN 2 ELSE 0 END AS by_name
        FROM files f WHERE {READABLE} AND name <> '.DS_Store'),
words AS (SELECT tender_id, unnest({_tokens('title')}) AS token FROM open_lots),
counts AS (SELECT h.path, w.tender_id, count(*) AS m,
           sum(CASE WHEN length(w.token) >= 8 THEN 2 ELSE 1 END) AS s
           FROM hay h JOIN words w ON contains(h.hay, w.token) GROUP BY ALL),
pairs AS (SELECT * FROM (
  SELECT h.path, t.tender_id, CAST(CASE WHEN contains(h.hay, t.tender_id) THEN 100 ELSE
           coalesce(c.s, 0) + h.by_name
           + CASE coalesce(c.m, 0) WHEN 0 THEN -3 WHEN 1 THEN -1 ELSE 0 END
           + CASE WHEN {_norm('t.customer')} <> '' AND contains(h.hay, {_norm('t.customer')})
             THEN 3 ELSE 0 END END AS INTEGER) AS score
  FROM hay h CROSS JOIN open_lots t
  LEFT JOIN counts c ON c.path = h.path AND c.tender_id = t.tender_id) WHERE score >= 4),
ranked AS (SELECT path, tender_id, score, CAST(row_number() OVER (
             PARTITION BY path ORDER BY score DESC, tender_id) AS INTEGER) AS rn
           FROM pairs QUALIFY rn <= 5)"""


CHOSEN = """chosen AS (SELECT path, tender_id, score FROM (
  SELECT *, lead(score, 1, 0) OVER (PARTITION BY path ORDER BY rn) AS second FROM ranked)
  WHERE rn = 1 AND score >= 8 AND score - second >= 3)"""

BAND = """band AS (SELECT path, tender_id, score FROM chosen
  QUALIFY score >= greatest(8, max(score) OVER (PARTITION BY tender_id) - 1))"""

IN_PATH = "SELECT t.tender_id FROM lots t JOIN files f ON contains(f.path, t.tender_id)"
MATCH = f"WITH {LOTS}, {FILES}, {_pairs(IN_PATH)}, {CHOSEN}, {BAND}"

TIERS = f"""WITH {LOTS}, {FILED},
by_title AS (SELECT t.tender_id, min(f.top_dir) AS top_dir FROM lots t JOIN files f
  ON {_norm('t.title')} <> '' AND contains({_norm('f.top_dir')}, {_norm('t.title')}) GROUP BY 1),
named AS (
  SELECT t.tender_id, f.path, 1 AS tier FROM lots t JOIN files f ON f.top_dir = t.tender_id
  UNION ALL
  SELECT t.tender_id, f.path, 2 FROM lots t JOIN files f ON contains(f.path, t.tender_id)
  UNION ALL
  SELECT b.tender_id, f.path, 3 FROM by_title b JOIN files f ON f.top_dir = b.top_dir),
{_pairs('SELECT tender_id FROM named')}, {CHOSEN}, {BAND},
all_tiers AS (SELECT * FROM named UNION ALL SELECT tender_id, path, 4 FROM band),
found AS (SELECT * FROM all_tiers QUALIFY tier = min(tier) OVER (PARTITION BY tender_id))"""


FILED_LOTS = f"{LOTS}, {FILED}"
_RAW_FILES = """files AS (
  SELECT path, CASE WHEN contains(path[8:], '/') THEN string_split(path, '/')[3] END AS top_dir,
         regexp_extract(path, '([^/]*)$', 1) AS name, text_sample FROM (
    SELECT '/inbox/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.TXT' WHEN 1 THEN '.docx' ELSE '.bin' END AS path,
      CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), ' ') ELSE '' END AS text_sample
    FROM documents
    UNION ALL SELECT '/inbox/' || source || '/d' || doc_id || '__extracted/docs/d' || doc_id || '.txt', text
    FROM documents WHERE doc_id % 7 <> 6
    UNION ALL SELECT '/inbox/' || source || '/d' || doc_id || '__extracted/readme.md', CAST(length(text) AS VARCHAR)
    FROM documents WHERE doc_id % 7 <> 6))"""
REVIEW_RUN = TIERS.replace(
    f"WITH {LOTS}, {FILED}",
    f"""WITH {LOTS.replace('lots AS', 'all_lots AS', 1)}, lots AS (SELECT * FROM (
  SELECT *, row_number() OVER (ORDER BY deadline_at NULLS LAST, row_number) AS n FROM all_lots)
  WHERE n > 3 AND n <= 33), {_RAW_FILES}""",
)


def _priority(group: str, path: str = "path") -> str:
    name = f"regexp_extract({path}, '([^/]*)$', 1)"
    words = " + ".join(
        f"CAST(contains({_norm(name)}, {_q(w)}) AS INTEGER)" for w in vocab.PRIORITY_KEYWORDS
    )
    return (
        f"row_number() OVER (PARTITION BY {group} ORDER BY {words} DESC, "
        f"CASE WHEN lower({_suffix(name)}) IN ('.pdf', '.docx', '.doc') THEN 0 ELSE 1 END, "
        f"lower({name}), {path})"
    )


ORDER_LOTS = """lots AS (
  SELECT CAST(o_orderkey AS INTEGER) AS row_number, CAST(o_orderkey AS VARCHAR) AS tender_id,
         c_mktsegment || ' / ' || o_orderpriority AS title,
         'https://etp.example.com/lot/' || o_orderkey AS url,
         CASE WHEN o_orderkey % 19 <> 0
              THEN o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) END AS deadline_at,
         c_name AS customer, CAST(o_custkey AS VARCHAR) AS customer_inn,
         o_orderstatus, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

MONTH = "CASE month({d}) " + " ".join(
    f"WHEN {i} THEN {_q(m)}" for i, m in enumerate(vocab.MONTHS, 1)
) + " END"


def _sheet(d: str) -> str:
    return f"CASE WHEN {d} IS NULL THEN {_q(vocab.UNDATED_SHEET)} ELSE {MONTH.format(d=d)} || ' ' || year({d}) END"


def _deadline(d: str) -> str:
    return (
        f"coalesce(CASE WHEN hour({d}) = 0 AND minute({d}) = 0 "
        f"THEN strftime({d}, '%-d.%-m.%Y') ELSE strftime({d}, '%-d.%-m.%Y %H:%M') END, '')"
    )


def _folder(x: str) -> str:
    clean = f"rtrim({_strip(f'''replace(replace({x}, '/', '／'), chr(0), '')''')}, '. ')"
    clean = f"coalesce(nullif({clean}, ''), {_q(vocab.UNTITLED_FOLDER)})"
    size = f"list_max(list_filter(range(0, 178), lambda i: strlen(left({clean}, i)) <= 177))"
    return (
        f"CASE WHEN strlen({clean}) <= 180 THEN {clean} "
        f"ELSE rtrim(left({clean}, CAST({size} AS BIGINT)), {BLANK}) || '...' END"
    )


_HTML = "html"
for _rx in ("<!--.*?-->", "<script\\b.*?</script\\s*>", "<style\\b.*?</style\\s*>"):
    _HTML = f"regexp_replace({_HTML}, {_q(_rx)}, '', 'gis')"


def _unescape(x: str) -> str:
    for code, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, {_q(code)}, {_q(char)})"
    return x


_REF = _unescape("regexp_extract(a, '^<a\\s(?:[^>]*?\\s)?href\\s*=\\s*\"([^\"]*)\"', 1, 'i')")
_LABEL = _unescape(
    "regexp_replace(regexp_extract(a, '^<a\\s[^>]*>(.*)</a\\s*>$', 1, 'is'), '<[^>]*>', '', 'g')"
)
# Links of the test pages are rooted or absolute.
ANCHORS = f"""raw AS (
  SELECT page_id, url, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS pos FROM (
    SELECT page_id, url, regexp_extract_all({_HTML}, '<a\\s[^>]*>.*?</a\\s*>', 0, 'is') AS l FROM pages)),
anchors AS (
  SELECT page_id, CAST(pos AS INTEGER) AS pos, href,
         CASE WHEN starts_with(href, '/') THEN
           regexp_extract(url, '^(https?://[^/?#]*)', 1) || href ELSE href END AS abs_url, text
  FROM (SELECT page_id, url, pos, {_REF} AS href,
               {_strip(f"regexp_replace({_LABEL}, '[ \\t\\n\\r]+', ' ', 'g')")} AS text FROM raw)
  WHERE href <> '')"""

_HOST = "lower(regexp_extract(abs_url, '^[a-z]+://([^/?#]*)', 1))"
FOLLOW = f"""follow AS (SELECT * FROM anchors
  WHERE regexp_matches(abs_url, '^https?:') AND NOT {_any(_HOST, vocab.IGNORED_HOSTS)})"""
_PATH = "lower(regexp_extract(abs_url, '^[a-z]+://[^/?#]*([^?#]*)', 1))"
_LAST = f"regexp_extract(rtrim({_PATH}, '/'), '([^/]*)$', 1)"
LINKS = f"""links AS (
  SELECT page_id, abs_url, min(pos) AS pos, arg_max(text, pos) AS text FROM follow
  WHERE {_suffix(_LAST)} IN {_list(vocab.DOCUMENT_EXTENSIONS)}
     OR {_any('lower(abs_url)', LINK_KEYWORDS)} OR {_any('lower(text)', LINK_KEYWORDS)}
  GROUP BY 1, 2)"""
SOURCES = f"""sources AS (
  SELECT page_id, arg_min(abs_url, pos) AS source_url FROM follow
  WHERE {_HOST} <> '' AND {_HOST} NOT IN {_list(vocab.PORTAL_HOSTS)}
    AND NOT contains({_HOST}, {_q(vocab.PORTAL_SERVICE_HOST)})
    AND {_any('lower(abs_url)', SOURCE_WORDS)} GROUP BY 1)"""


def _detect(href: str, label: str) -> str:
    text = f"trim(regexp_replace({_strip(label)}, '[^a-zA-Z0-9а-яА-Я._-]+', '_', 'g'), '_')"
    last = f"string_split(regexp_extract({href}, '([^/]*)$', 1), '?')[1]"
    name = f"coalesce(nullif({last}, ''), nullif({text}, ''), 'document')"
    return (
        f"left(CASE WHEN NOT contains({name}, '.') AND {text} <> '' "
        f"THEN {text} || '.bin' ELSE {name} END, 180)"
    )


FETCHED = f"""named AS (
  SELECT l.page_id, l.abs_url, l.pos, e.event_type, e.value,
    CASE e.user_id % 3 WHEN 0 THEN 'doc_' || l.page_id || '.pdf' WHEN 1 THEN 'scan.html'
    ELSE {_detect('l.abs_url', 'l.text')} END AS filename
  , e.event_id
  FROM links l JOIN events e ON e.event_id % (SELECT count(*) FROM pages) = l.page_id),
fetched AS (SELECT page_id, abs_url, pos, filename FROM named
  WHERE event_type <> 'error' AND NOT (value > 10 AND
    lower({_suffix('filename')}) NOT IN {_list(vocab.DOCUMENT_EXTENSIONS)})
  QUALIFY row_number() OVER (PARTITION BY page_id, abs_url ORDER BY event_id DESC) = 1)"""
OUTCOMES = f"""outcomes AS (
  SELECT *, CASE WHEN n_files > 0 THEN 'ok' WHEN n_links > 0 THEN 'blocked' ELSE 'error' END AS status,
    CASE WHEN n_files > 0 THEN NULL WHEN n_links > 0 THEN 10
         WHEN source_url IS NULL THEN 5 ELSE 0 END AS confidence_percent,
    CASE WHEN n_files > 0 THEN NULL WHEN n_links > 0 THEN {_q(vocab.BLOCKED_COMMENT)}
         WHEN source_url IS NULL THEN {_q(vocab.NOTHING_FOUND_COMMENT.format(portal=vocab.PORTAL_LABEL))}
         ELSE {_q(vocab.PIPELINE_ERROR_COMMENT)} END AS classification_comment,
    CASE WHEN n_files > 0 THEN '' WHEN n_links > 0 THEN {_q(vocab.BLOCKED_ERROR)}
         WHEN source_url IS NULL THEN {_q(vocab.NOTHING_FOUND_ERROR.format(portal=vocab.PORTAL_LABEL))}
         ELSE {_q(vocab.SOURCE_EMPTY_ERROR)} END AS error
  FROM (SELECT p.page_id,
          (SELECT count(*) FROM links l WHERE l.page_id = p.page_id) AS n_links,
          (SELECT count(*) FROM fetched f WHERE f.page_id = p.page_id) AS n_files,
          s.source_url
        FROM pages p LEFT JOIN sources s ON s.page_id = p.page_id))"""
PORTAL = f"WITH {ANCHORS}, {FOLLOW}, {LINKS}, {SOURCES}, {FETCHED}, {OUTCOMES}"


def _stub_comment(names: str) -> str:
    before, after = vocab.STUB_COMMENT.split("{files}")
    return f"{_q(before)} || coalesce(nullif({names}, ''), {_q(vocab.STUB_NO_FILES)}) || {_q(after)}"


_before, _rest = vocab.ANALYSIS_PROMPT.split("{url}")
_PROMPT_TAIL = _rest.replace("{template}", TEMPLATE).replace("{{", "{").replace("}}", "}").replace(
    "{tags}", ", ".join(vocab.TAGS)
)
ORDER_FILES = f"""{ORDER_LOTS}, {FILES},
top AS (SELECT tender_id, path, name, {_priority('tender_id')} AS priority FROM (
  SELECT CAST(CAST(regexp_extract(name, '([0-9]{{7}})', 1) AS INTEGER) AS VARCHAR) AS tender_id, path, name
  FROM files) QUALIFY priority <= 4),
listed AS (SELECT t.*, coalesce(n.n_files, 0) AS n_files, n.names, n.paths FROM lots t LEFT JOIN (
  SELECT tender_id, count(*) AS n_files, string_agg(name, ', ' ORDER BY priority) AS names,
         string_agg(path, '|' ORDER BY priority) AS paths FROM top GROUP BY 1) n USING (tender_id))"""

OPTION = """'- "' || tender_id || '": ' || title || ' | заказчик: '
  || coalesce(nullif(customer, ''), '-') || ' | дедлайн: '
  || coalesce(strftime(deadline_at, '%d.%m.%Y %H:%M'), '')"""

_TAG_LIST = "[" + ", ".join(_q(t) for t in (*vocab.TAGS, "Иное")) + "]"
_CONFIDENCES = (
    "85", '" 140 "', "85.7", "-3", "true", "null", '"85%"', '"85.7"', "[1]", '"+7"', "1e2", "false",
)
# The value each of the confidences stands for; NULL where it cannot be read.
_VALUES = "[85, 100, 85, 0, 1, NULL, NULL, NULL, NULL, 7, 100, 0]"
_BODY = (
    "'{\"classification_tag\": \" ' || tag || '\", \"confidence_percent\": ' || conf "
    "|| ', \"classification_comment\": \"' || CASE WHEN event_id % 4 = 0 THEN '  ' ELSE event_type END "
    "|| '\", \"analysis_markdown\": ' || CASE WHEN event_id % 5 = 0 THEN 'null' "
    "ELSE '\"разбор\\n1\"' END || '}'"
)
RESPONSES = f"""answers AS (SELECT *, {_BODY} AS body FROM (
  SELECT *, {_TAG_LIST}[event_id % 11 + 1] AS tag,
    [{', '.join(_q(c) for c in _CONFIDENCES)}][event_id % 12 + 1] AS conf,
    {_VALUES}[event_id % 12 + 1] AS val FROM events)),
kinds AS (SELECT *, CASE WHEN event_id % 29 = 0 THEN 'error'
    WHEN event_id % 13 = 1 THEN 'props' WHEN event_id % 13 IN (0, 2, 3) OR val IS NULL THEN 'bad'
    ELSE 'good' END AS kind,
    CASE event_id % 13 WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```'
      WHEN 1 THEN props WHEN 2 THEN '[' || body || ']' WHEN 3 THEN event_type ELSE body END AS raw
  FROM answers)"""

GRADED = f"""{ORDER_LOTS}, graded AS (
  SELECT row_number, tender_id, title, url, deadline_at,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'В работу' WHEN '2-HIGH' THEN 'Подано'
      WHEN '3-MEDIUM' THEN 'Не наш стек' ELSE 'Не изучено' END AS tag,
    row_number % 101 AS confidence_percent, 'статус ' || o_orderstatus AS comment,
    {_sheet('deadline_at')} AS sheet FROM lots)"""

THIRD = f"""{GRADED}, third AS (
        SELECT row_number, tender_id, title, tag,
          CASE WHEN year(deadline_at) = 1992 THEN NULL
               WHEN row_number % 7 = 0 THEN deadline_at + INTERVAL 40 DAY ELSE deadline_at END AS deadline_at,
          CASE WHEN year(deadline_at) = 1992 THEN 3 WHEN row_number % 7 = 0 THEN 2 ELSE 1 END AS version
        FROM graded)"""

_RAW_DATE = """CASE o_orderkey % 7
  WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y')
  WHEN 1 THEN strftime(o_orderdate, '%-d.%-m.%Y') || '  ' || (o_orderkey % 30) || ':' || (o_orderkey % 70)
  WHEN 2 THEN strftime(o_orderdate, '%d.%m.%y')
  WHEN 3 THEN (o_orderkey % 40) || strftime(o_orderdate, '.%-m.%Y')
  WHEN 5 THEN '1.2.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0')
  ELSE '' END"""


def _serial(day: str) -> str:
    return (
        f"TIMESTAMP '{day} 00:00:00' + to_days(CAST(trunc(x) AS INTEGER)) "
        "+ to_milliseconds(CAST(round_even((x - trunc(x)) * 86400000.0, 0) AS BIGINT))"
    )


def _url_id(url: str, number: str) -> str:
    parts = f"string_split(regexp_extract({url}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/')"
    digits = f"list_filter({parts}, lambda p: regexp_full_match(p, '[0-9]+'))[-1]"
    coded = f"list_filter({parts}, lambda p: regexp_matches(p, '[A-Za-z0-9]{{6,}}'))[-1]"
    return f"coalesce({digits}, {coded}, 'row-' || {number})"


def _manifest(source: str) -> str:
    return f"""SELECT CAST(n AS INTEGER) AS "order", tender_id, title,
      printf('%03d. ', n) || {_folder('title')} AS folder_name,
      coalesce(strftime(deadline_at, '%Y-%m-%d %H:%M'), '') AS deadline_at, url
    FROM (SELECT *, row_number() OVER (ORDER BY deadline_at NULLS LAST, lower(title), row_number) AS n
          FROM {source})"""


# Some titles already end in a number.
_SUFFIXED = "CASE WHEN row_number % 97 = 0 THEN ' (2)' WHEN row_number % 89 = 0 THEN ' (3)' ELSE '' END"
_ORDERED = "row_number() OVER (ORDER BY deadline_at NULLS LAST, row_number)"

ORACLE: dict[str, str] = {
    "normalize_tokens": f"""SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos,
      unnest(l) AS token FROM (SELECT doc_id, {_tokens('text')} AS l FROM documents)""",
    "file_names": f"""WITH {FILES} SELECT path, {_suffix('name')} AS suffix,
      {_any(_norm('name'), vocab.GENERIC_NAMES)} AS is_generic,
      {_any(_norm('name'), vocab.PROJECT_MARKERS)} AS is_project,
      CAST({' + '.join(f"CAST(contains({_norm('name')}, {_q(w)}) AS INTEGER)" for w in vocab.PRIORITY_KEYWORDS)} AS INTEGER) AS keywords,
      regexp_replace(name, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') AS dirname,
      {_detect("path || '/?v=1'", 'text_sample')} AS by_label,
      {_detect("path || '?v=1/2'", "''")} AS by_href,
      CASE WHEN length(text_sample) % 2 = 0 THEN name ELSE 'fallback.bin' END AS by_header
      FROM files""",
    "parse_cells": f"""SELECT o_orderkey,
      CASE WHEN regexp_full_match(raw, '\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}') THEN try_strptime(raw, '%d.%m.%Y')
           WHEN regexp_full_match(raw, '\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}\\s+\\d+:\\d+')
             THEN try_strptime(replace(raw, '  ', ' '), '%d.%m.%Y %H:%M')
           WHEN regexp_full_match(raw, '\\d{{1,2}}\\.\\d{{1,2}}\\.\\d\\d') THEN try_strptime(
             regexp_extract(raw, '^(.*)\\d\\d$', 1)
             || CASE WHEN right(raw, 2) >= '69' THEN '19' ELSE '20' END || right(raw, 2), '%d.%m.%Y')
      END AS from_text,
      CASE WHEN x < 60 THEN {_serial('1899-12-31')} ELSE {_serial('1899-12-30')} END AS from_serial,
      {_serial('1904-01-01')} AS from_serial_1904,
      CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR)
           ELSE CAST(o_totalprice AS VARCHAR) END AS shown,
      CAST(o_orderkey AS VARCHAR) AS shown_key
      FROM (SELECT *, {_RAW_DATE} AS raw, o_totalprice / 10 AS x FROM orders)""",
    "derive_ids": f"""SELECT page_id, url, portal_url,
      CASE WHEN shown IN ('', 'Источник') THEN {_url_id('url', '(page_id + 1)')} ELSE shown END AS tender_id,
      {_url_id('url', '(page_id + 1)')} AS derived_id
      FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN card ELSE url END AS url,
              CASE WHEN page_id % 3 = 0 THEN card ELSE '' END AS portal_url,
              CASE page_id % 4 WHEN 0 THEN 'Источник' WHEN 1 THEN '' ELSE '№' || page_id END AS shown
            FROM (SELECT *, 'https://CARDS.portal.example.org/ru/Tender/' || page_id || '/x' AS card FROM pages))""",
    "tender_listing": f"""SELECT * FROM (SELECT row_number,
      CASE WHEN k % 5 > 1 THEN 'L' || k ELSE {_url_id('url', 'row_number')} END AS tender_id,
      title, url, deadline_at, customer, customer_inn,
      CASE k % 5 WHEN 0 THEN 'Источник' WHEN 1 THEN '' ELSE ' L' || k END AS raw_number, n_links
    FROM (SELECT o_orderkey AS k, CAST(o_orderkey + 2 AS INTEGER) AS row_number,
        c_mktsegment || ' ' || o_orderpriority || ' ' || c_name AS title,
        CASE WHEN o_orderkey % 12 = 0 THEN 'https://cards.portal.example.org/ru/tender/' || o_orderkey
             WHEN o_orderkey % 17 = 0 THEN '' ELSE 'https://etp.example.com/card/x' || o_orderkey END AS url,
        o_orderdate AS deadline_at, c_name AS customer,
        CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR)
             ELSE CAST(c_acctbal AS VARCHAR) END AS customer_inn,
        CAST(CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n_links
      FROM orders JOIN customer ON o_custkey = c_custkey)) WHERE url <> ''""",
    "deadline_day": f"""WITH {ORDER_LOTS} SELECT tender_id, title, deadline_at FROM lots
      WHERE CAST(deadline_at AS DATE) = DATE '1998-10-03'""",
    "deadline_queue": f"""WITH {ORDER_LOTS} SELECT tender_id, deadline_at, row_number FROM (
      SELECT *, {_ORDERED} AS n FROM lots) WHERE n > 100""",
    "queue_head": f"""WITH {ORDER_LOTS} SELECT tender_id, deadline_at, row_number FROM (
      SELECT *, {_ORDERED} AS n FROM lots) WHERE n > 20 AND n <= 520""",
    "page_anchors": f"WITH {ANCHORS} SELECT page_id, pos, href, abs_url, text FROM anchors",
    "page_links": f"WITH {ANCHORS}, {FOLLOW}, {LINKS} SELECT page_id, abs_url, pos, text FROM links",
    "source_link": f"WITH {ANCHORS}, {FOLLOW}, {SOURCES} SELECT page_id, source_url FROM sources",
    "selected_links": f"""WITH {ANCHORS}, {FOLLOW}, marked AS (SELECT *,
        contains(href, 'ent') OR ends_with(href, '.') OR starts_with(href, '/da') AS hit FROM follow),
      links AS (SELECT page_id, abs_url, min(pos) AS pos, arg_max(text, pos) AS text,
        bool_or(hit) AS hit FROM marked GROUP BY 1, 2)
      SELECT page_id, abs_url, pos, text FROM links
      QUALIFY hit OR NOT bool_or(hit) OVER (PARTITION BY page_id)""",
    "fetched_files": f"{PORTAL} SELECT page_id, abs_url, pos, filename FROM fetched",
    "link_outcome": f"""{PORTAL} SELECT page_id, n_links, n_files, source_url, status,
      CAST(confidence_percent AS INTEGER) AS confidence_percent, classification_comment, error
      FROM outcomes""",
    "portal_run": f"""{PORTAL}, names AS (SELECT page_id,
        string_agg(filename, ', ' ORDER BY pos, filename) AS names FROM fetched GROUP BY 1)
      SELECT CAST(o.page_id AS VARCHAR) AS tender_id, status, {_q(vocab.DEFAULT_TAG)} AS classification_tag,
        CAST(CASE WHEN status = 'ok' THEN 1 ELSE confidence_percent END AS INTEGER) AS confidence_percent,
        CASE WHEN status = 'ok' THEN {_stub_comment('names')} ELSE classification_comment END
          AS classification_comment,
        CAST(n_files AS INTEGER) AS n_files, error
      FROM outcomes o JOIN orders ON o_orderkey = o.page_id JOIN customer ON o_custkey = c_custkey
      LEFT JOIN names n ON n.page_id = o.page_id""",
    "match_candidates": f"{MATCH} SELECT path, tender_id, score, rn FROM ranked",
    "match_assign": f"{MATCH} SELECT path, tender_id, score FROM chosen",
    "match_band": f"{MATCH} SELECT path, tender_id, score FROM band",
    "match_tiers": f"{TIERS} SELECT DISTINCT tender_id, path, tier FROM found",
    "file_priority": f"""WITH {FILES} SELECT top_dir, path,
      CAST({_priority('top_dir')} AS INTEGER) AS priority FROM files QUALIFY priority <= 4""",
    "match_prompts": f"""{MATCH} SELECT f.path, {_q(vocab.MATCH_PROMPT_HEAD)} || f.name || {_q(vocab.MATCH_PROMPT_TEXT)}
        || coalesce(nullif(left(f.text_sample, 5000), ''), {_q(vocab.MATCH_NO_TEXT)})
        || {_q(vocab.MATCH_PROMPT_OPTIONS)} AS prompt,
        CASE WHEN f.path IN (SELECT path FROM ranked) THEN f.path ELSE '*' END AS option_set
      FROM files f WHERE {READABLE}""",
    "match_options": f"""{MATCH}, lines AS (SELECT tender_id, {OPTION} AS line FROM lots)
      SELECT path AS option_set, rn, tender_id, line FROM ranked JOIN lines USING (tender_id)
      UNION ALL SELECT '*', CAST(0 AS INTEGER), tender_id, line FROM lines""",
    "match_scored": f"""{MATCH}, everyone AS (SELECT min(tender_id) AS tender_id FROM lots)
      SELECT f.path, coalesce(r.tender_id, e.tender_id) AS tender_id,
        CAST(coalesce(r.score, 8) AS INTEGER) AS score
      FROM files f CROSS JOIN everyone e LEFT JOIN ranked r ON r.path = f.path AND r.rn = 1
      WHERE {READABLE} AND length(f.path) % 3 > 0
      UNION ALL SELECT path, tender_id, score FROM chosen WHERE length(path) % 3 = 0""",
    "match_paged": f"""{MATCH}, lines AS (SELECT tender_id, length({OPTION}) AS size FROM lots),
      longest AS (SELECT tender_id FROM lines ORDER BY size DESC, tender_id LIMIT 1),
      own AS (SELECT path, tender_id, score FROM ranked JOIN lines USING (tender_id)
        QUALIFY row_number() OVER (PARTITION BY path ORDER BY size DESC, tender_id) = 1)
      SELECT f.path, coalesce(r.tender_id, e.tender_id) AS tender_id,
        CAST(coalesce(r.score, 8) AS INTEGER) AS score
      FROM files f CROSS JOIN longest e LEFT JOIN own r ON r.path = f.path
      WHERE {READABLE}""",
    "match_choices": f"""{MATCH}, first AS (SELECT *, length(path) % 5 AS k FROM ranked WHERE rn = 1)
      SELECT path, tender_id, score FROM first WHERE k IN (0, 2, 4) AND score % 4 NOT IN (0, 1)
      UNION ALL SELECT c.path, c.tender_id, c.score FROM chosen c JOIN first f ON f.path = c.path
      WHERE f.k = 3""",
    "folder_review": f"""{TIERS}, top AS (SELECT *, {_priority('tender_id')} AS priority
        FROM (SELECT DISTINCT tender_id, path FROM found) QUALIFY priority <= 4)
      SELECT tender_id, 'ok' AS status, {_q(vocab.DEFAULT_TAG)} AS classification_tag,
        CAST(1 AS INTEGER) AS confidence_percent,
        {_stub_comment("string_agg(regexp_extract(path, '([^/]*)$', 1), ', ' ORDER BY priority)")}
          AS classification_comment,
        string_agg(path, '|' ORDER BY priority) AS files FROM top GROUP BY tender_id""",
    "analysis_prompts": f"""WITH {ORDER_FILES} SELECT tender_id,
      {_q(_before)} || url || {_q(_PROMPT_TAIL)} AS prompt, CAST(n_files AS INTEGER) AS n_files FROM listed""",
    "scorer_results": f"""WITH {ORDER_FILES} SELECT tender_id, {_q(vocab.DEFAULT_TAG)} AS classification_tag,
      CAST(CASE WHEN n_files = 0 OR contains(names, 'CRM') THEN 0 ELSE 1 END AS INTEGER) AS confidence_percent,
      CASE WHEN n_files = 0 THEN {_q(vocab.NO_FILES_COMMENT)}
           WHEN contains(names, 'CRM') THEN {_q(vocab.PROVIDER_ERROR_PREFIX)} || 'no access to ' || names
           ELSE {_stub_comment('names')} END AS classification_comment,
      CASE WHEN n_files = 0 THEN {_q(vocab.NO_FILES_ANALYSIS)}
           WHEN contains(names, 'CRM') THEN 'no access to ' || names
           ELSE {_q(vocab.STUB_ANALYSIS)} END AS analysis_markdown,
      CAST(n_files AS INTEGER) AS n_files FROM listed""",
    "scorer_stored": f"""WITH {ORDER_FILES} SELECT tender_id, {_q(vocab.DEFAULT_TAG)} AS classification_tag,
      CAST(CASE WHEN n_files = 0 OR contains(names, 'CRM') THEN 0 ELSE 1 END AS INTEGER) AS confidence_percent,
      CASE WHEN n_files = 0 THEN {_q(vocab.NO_FILES_COMMENT)}
           WHEN contains(names, 'CRM') THEN {_q(vocab.PROVIDER_ERROR_PREFIX)} || 'no access to ' || names
           ELSE {_stub_comment('names')} END AS classification_comment,
      CASE WHEN n_files = 0 THEN {_q(vocab.NO_FILES_ANALYSIS)}
           WHEN contains(names, 'CRM') THEN 'no access to ' || names
           ELSE {_q(vocab.STUB_ANALYSIS)} END AS analysis_markdown,
      CAST(n_files AS INTEGER) AS n_files FROM listed""",
    "stub_results": f"""WITH {ORDER_FILES} SELECT tender_id, title, customer, 'ok' AS status,
      {_q(vocab.DEFAULT_TAG)} AS classification_tag,
      CAST(1 AS INTEGER) AS confidence_percent, {_stub_comment('names')} AS classification_comment,
      {_q(vocab.STUB_ANALYSIS)} AS analysis_markdown,
      coalesce(paths, '') AS files FROM listed""",
    "parse_responses": f"""WITH {RESPONSES} SELECT event_id,
      CASE WHEN kind = 'good' AND tag <> 'Иное' THEN tag ELSE {_q(vocab.DEFAULT_TAG)} END AS classification_tag,
      CAST(CASE WHEN kind = 'good' THEN val ELSE 0 END AS INTEGER) AS confidence_percent,
      CASE kind WHEN 'error' THEN {_q(vocab.PROVIDER_ERROR_PREFIX)} || 'timeout'
        WHEN 'bad' THEN {_q(vocab.NOT_JSON_COMMENT)} WHEN 'props' THEN {_q(vocab.NO_COMMENT)}
        ELSE CASE WHEN event_id % 4 = 0 THEN {_q(vocab.NO_COMMENT)} ELSE event_type END
        END AS classification_comment,
      CASE WHEN kind = 'error' THEN 'timeout' WHEN kind = 'good' AND event_id % 5 <> 0
        THEN 'разбор' || chr(10) || '1' ELSE raw END AS analysis_markdown FROM kinds""",
    "report_months": f"""WITH {GRADED} SELECT sheet, tag, confidence_percent, comment,
      row_number() OVER (PARTITION BY sheet ORDER BY deadline_at NULLS LAST, row_number) AS number,
      title, url, {_deadline('deadline_at')} AS deadline FROM graded""",
    "tag_summary": f"""WITH {GRADED}, tags AS (SELECT unnest([{', '.join(_q(t) for t in vocab.TAGS)}]) AS tag,
        unnest(range(1, {len(vocab.TAGS) + 1})) AS ord),
      sheets AS (SELECT DISTINCT sheet FROM graded)
      SELECT s.sheet, CAST(t.ord AS INTEGER) AS ord, t.tag,
        (SELECT count(*) FROM graded g WHERE g.sheet = s.sheet AND g.tag = t.tag) AS n
      FROM sheets s CROSS JOIN tags t""",
    "listing_scan": f"""WITH {ORDER_LOTS} SELECT row_number, 'N' || tender_id AS tender_id,
      title || chr(10) || 'line "two"' AS title, url, deadline_at, customer, customer_inn FROM lots""",
    "folder_scan": """SELECT 'source=' || source AS top_dir, '.txt' AS suffix,
      CAST(sum(2 * strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY source""",
    "manifest_cycle": f"WITH {ORDER_LOTS} {_manifest('lots')}",
    "report_cycle": f"""WITH {THIRD}
      SELECT {_sheet('deadline_at')} AS sheet, tender_id, tag, title, {_deadline('deadline_at')} AS deadline,
        CAST(version AS BIGINT) AS version,
        row_number() OVER (PARTITION BY {_sheet('deadline_at')} ORDER BY deadline_at NULLS LAST, row_number) AS number
      FROM third""",
    "report_counts": f"""WITH {THIRD}, held AS (SELECT {_sheet('deadline_at')} AS sheet, tag FROM third),
      tags AS (SELECT unnest([{', '.join(_q(t) for t in vocab.TAGS)}]) AS tag,
        unnest(range(1, {len(vocab.TAGS) + 1})) AS ord),
      sheets AS (SELECT DISTINCT sheet FROM held)
      SELECT s.sheet, CAST(t.ord AS INTEGER) AS ord, t.tag,
        (SELECT count(*) FROM held h WHERE h.sheet = s.sheet AND h.tag = t.tag) AS n
      FROM sheets s CROSS JOIN tags t""",
    "due_days": f"""WITH {ORDER_LOTS} SELECT tender_id, title, deadline_at FROM lots
      WHERE CAST(deadline_at AS DATE) IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_totalprice > 400000)""",
    "portal_cycle": f"""{PORTAL}, names AS (SELECT page_id,
        string_agg(filename, ', ' ORDER BY pos, filename) AS names FROM fetched GROUP BY 1), {ORDER_LOTS},
      queued AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY deadline_at NULLS LAST, row_number) AS n
        FROM lots WHERE row_number IN (SELECT page_id FROM pages)) WHERE n > 5 AND n <= 5005)
      SELECT {_sheet('deadline_at')} AS sheet, tender_id, {_q(vocab.DEFAULT_TAG)} AS tag,
        CAST(CASE WHEN status = 'ok' THEN 1 ELSE confidence_percent END AS INTEGER) AS confidence_percent,
        CASE WHEN status = 'ok' THEN {_stub_comment('names')} ELSE classification_comment END AS comment,
        {_deadline('deadline_at')} AS deadline,
        row_number() OVER (PARTITION BY {_sheet('deadline_at')} ORDER BY deadline_at NULLS LAST, row_number) AS number
      FROM queued q JOIN outcomes o ON o.page_id = q.row_number LEFT JOIN names m ON m.page_id = o.page_id""",
    "review_run": f"""{REVIEW_RUN}, top AS (SELECT *, {_priority('tender_id')} AS priority
        FROM (SELECT DISTINCT tender_id, path FROM found) QUALIFY priority <= 4),
      done AS (SELECT tender_id,
        {_stub_comment("string_agg(regexp_extract(path, '([^/]*)$', 1), ', ' ORDER BY priority)")} AS comment
        FROM top GROUP BY tender_id)
      SELECT {_sheet('deadline_at')} AS sheet, title, {_q(vocab.DEFAULT_TAG)} AS tag,
        CAST(1 AS INTEGER) AS confidence_percent, comment, {_deadline('deadline_at')} AS deadline,
        row_number() OVER (PARTITION BY {_sheet('deadline_at')} ORDER BY deadline_at NULLS LAST, row_number) AS number
      FROM done JOIN lots USING (tender_id)""",
    "retargeted": f"""WITH {ANCHORS}, {FOLLOW}, {SOURCES}, {ORDER_LOTS}
      SELECT tender_id, title, source_url AS url FROM lots JOIN sources ON page_id = row_number""",
    "target_day": f"""WITH {ORDER_LOTS} SELECT customer, count(*) AS n FROM lots
      WHERE CAST(deadline_at AS DATE) = DATE '1998-10-03' GROUP BY 1""",
    "files_by_path": f"""WITH {FILED_LOTS} SELECT path,
      row_number() OVER (ORDER BY string_split(path, '/')) AS n FROM files""",
    "matched_order": f"""{MATCH} SELECT path, tender_id, score, row_number() OVER (ORDER BY tender_id, score DESC,
      lower(regexp_extract(path, '([^/]*)$', 1)), path) AS n FROM chosen""",
    "report_upsert": f"""WITH {ORDER_LOTS}, both_sides AS (
        SELECT customer_inn AS tender_id, CAST(tender_id AS BIGINT) AS version, title, deadline_at, 0 AS fresh FROM lots
        UNION ALL
        SELECT CAST(user_id AS VARCHAR), event_id, event_type, ts, 1 FROM events)
      SELECT tender_id, version, title, {_sheet('deadline_at')} AS sheet, {_deadline('deadline_at')} AS deadline
      FROM both_sides QUALIFY row_number() OVER (PARTITION BY tender_id ORDER BY version DESC, fresh DESC) = 1""",
    "manifest": f"WITH {LOTS} {_manifest('lots')}",
    "order_manifest": f"WITH {ORDER_LOTS} {_manifest('lots')}",
    "folder_names": f"SELECT doc_id, {_folder('text')} AS folder_name FROM documents",
    "unique_names": f"""WITH {ORDER_LOTS}, titled AS (SELECT row_number, title || {_SUFFIXED} AS title FROM lots),
      used AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY row_number) AS n FROM titled),
      open_numbers AS (SELECT title, k, row_number() OVER (PARTITION BY title ORDER BY k) + 1 AS n
        FROM (SELECT DISTINCT title FROM titled) t, range(2, 20002) r(k)
        WHERE title || ' (' || k || ')' NOT IN (SELECT title FROM titled))
      SELECT row_number, CASE WHEN u.n = 1 THEN title ELSE title || ' (' || k || ')' END AS title
      FROM used u LEFT JOIN open_numbers o USING (title, n)""",
    "archive_members": """WITH zips AS (SELECT '/inbox/' || source || '/d' || doc_id AS stem, doc_id, text
        FROM documents WHERE doc_id % 7 <> 6)
      SELECT stem || '.ZIP' AS archive, member, stem || '__extracted/' || member AS path,
        strlen(body) AS size, md5(body) AS content_md5
      FROM (SELECT stem, 'docs/d' || doc_id || '.txt' AS member, text AS body FROM zips
            UNION ALL SELECT stem, 'readme.md', CAST(length(text) AS VARCHAR) FROM zips)""",
    "text_samples": """SELECT '/inbox/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.TXT' WHEN 1 THEN '.docx'
        ELSE '.bin' END AS path,
      CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), ' ') ELSE '' END AS text_sample
      FROM documents""",
}
# The review of all lots is that of a page without the page.
ORACLE["review_all"] = ORACLE["review_run"].replace("WHERE n > 3 AND n <= 33", "")
ORACLE["report_stream"] = ORACLE["report_upsert"]
