"""SQL for DuckDB that gives the same rows as the registered queries.

The inputs follow the rules written down in :mod:`inkfold.sources.derived`.  Where it
can, the SQL takes another way than the Spark job: windows over exploded blocks
instead of array functions, lists built from the tables instead of parsed listings.
"""

from __future__ import annotations

from html.entities import html5


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# ---------------------------------------------------------------- coverage


def _next_dates(dates: str, floor: str) -> str:
    return f"""
WITH c AS (
  SELECT count(DISTINCT d) AS n_dates, min(d) AS min_date, max(d) AS max_date FROM ({dates})
), s AS (
  SELECT *, CASE WHEN n_dates = 0 THEN 'no_collection'
    WHEN n_dates <> date_diff('day', min_date, max_date) + 1 THEN 'gap'
    WHEN min_date > DATE '{floor}' THEN 'backfill' ELSE 'forward' END AS status FROM c
)
SELECT status, n_dates, min_date, max_date,
  CASE WHEN status = 'backfill' THEN min_date - 1 END AS before,
  CASE WHEN status IN ('backfill', 'forward') THEN max_date + 1 END AS after,
  CASE status WHEN 'no_collection' THEN DATE '{floor}' WHEN 'backfill' THEN DATE '{floor}'
    WHEN 'forward' THEN max_date + 1 END AS first,
  CASE status WHEN 'backfill' THEN min_date - 1 WHEN 'forward' THEN DATE '2024-02-05'
    WHEN 'no_collection' THEN DATE '2024-02-05' END AS last
FROM s"""


def _coverage(dates: str) -> str:
    return f"""
WITH c AS (
  SELECT count(DISTINCT d) AS n_dates, min(d) AS min_date, max(d) AS max_date FROM ({dates})
)
SELECT *, date_diff('day', min_date, max_date) + 1 AS n_calendar,
  n_dates <> date_diff('day', min_date, max_date) + 1 AS has_gap
FROM c"""


EVENTS = "SELECT CAST(ts AS DATE) AS d FROM events"
ORDERS = "SELECT CAST(o_orderdate AS DATE) AS d FROM orders"
_ORDER_DAYS = (
    f"SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS date FROM ({ORDERS})"
)

# ---------------------------------------------------------------- feeds and lists

_PAGES = r"""
n AS (SELECT count(*) AS n FROM supplier),
pc AS (
  SELECT p.page_id, p.url, DATE '2024-01-01' + CAST(p.page_id % 28 AS INTEGER) AS date,
    p.page_id % 28 AS day_no, CAST(p.page_id // 112 AS INTEGER) AS part,
    regexp_replace(p.url, '[?&]utm_source=[^#]*', '') AS listed,
    a.s_name || CASE WHEN p.page_id % 3 = 0 THEN ',' || b.s_name ELSE '' END AS stockname,
    b.s_name AS next_name
  FROM pages p, n
  JOIN supplier a ON a.s_suppkey = p.page_id % n.n
  JOIN supplier b ON b.s_suppkey = (p.page_id + 1) % n.n
)"""

_FEEDS = rf"""
{_PAGES},
entry AS (
  SELECT date, part, day_no, page_id,
    '[{{"infourl":"' || replace(listed, '/', '\/') || '","stockname":"'
    || CASE WHEN day_no % 7 = 0 AND page_id % 5 = 0 THEN '\d' ELSE '' END || stockname || '"}}]'
    || CASE day_no WHEN 20 THEN ',[]' WHEN 21 THEN ',[{{"infourl":"nameless"}}]' ELSE '' END AS entry
  FROM pc
),
feed AS (
  SELECT date, part,
    CASE WHEN day_no = 10 THEN '{{"news":[' ELSE '{{"newsinfo":[' END
    || string_agg(entry, ',' ORDER BY page_id)
    || CASE WHEN day_no = 12 THEN ']}}],"x":[{{"newsinfo":[' || string_agg(entry, ',' ORDER BY page_id) ELSE '' END
    || CASE WHEN day_no = 14 THEN ']' ELSE ']}}' END AS payload
  FROM entry GROUP BY date, part, day_no
  UNION ALL
  SELECT DISTINCT CAST(ts AS DATE), 0, '{{"newsinfo":[]}}' FROM events
  WHERE CAST(ts AS DATE) NOT IN (SELECT date FROM pc)
),
tried AS (
  SELECT *, json_valid(payload) AS fine,
    replace(replace(replace(
      replace(replace(replace(replace(payload, '\/', chr(1)), '\u', chr(2)), '\"', chr(3)), '\', '\\'),
      chr(1), '\/'), chr(2), '\u'), chr(3), '\"') AS mended
  FROM feed
),
parsed AS (
  SELECT date, part, payload,
    CASE WHEN fine THEN json_extract(payload, '$.newsinfo')
      WHEN json_valid(mended) THEN json_extract(mended, '$.newsinfo') END AS newsinfo,
    CASE WHEN fine AND json_extract(payload, '$.newsinfo') IS NULL THEN 'no newsinfo'
      WHEN fine THEN 'ok' WHEN json_valid(mended) THEN 'repaired' ELSE 'bad json' END AS status
  FROM tried
),
log AS (
  SELECT date, part, CAST(json_array_length(newsinfo) AS BIGINT) AS total FROM parsed
  WHERE status IN ('ok', 'repaired')
)"""

# Lists straight from the tables: unreadable days are left out, positions follow the page ids.
_LISTS = rf"""
{_PAGES},
named AS (
  SELECT date, part, page_id, url, listed,
    CASE WHEN day_no % 7 = 0 AND page_id % 5 = 0 THEN '\d' ELSE '' END AS stray, stockname, next_name
  FROM pc WHERE day_no NOT IN (10, 12, 14)
),
list AS (
  SELECT date, part, row_number() OVER (PARTITION BY date, part ORDER BY page_id) - 1 AS pos,
    listed AS url, string_split(stray || stockname, ',') AS pre_info
  FROM named
),
late AS (
  SELECT date, part, row_number() OVER (PARTITION BY date, part ORDER BY page_id) - 1 AS pos,
    listed AS url, string_split(stray || next_name, ',') AS pre_info
  FROM named WHERE url LIKE '%#top'
  UNION ALL
  SELECT date, part, row_number() OVER (PARTITION BY date, part ORDER BY page_id) - 1,
    listed, string_split(next_name, ',')
  FROM pc WHERE day_no = 14 AND url LIKE '%#top'
),
unlogged AS (SELECT listed AS url FROM pc WHERE day_no = 14 AND url LIKE '%#top'),
whole AS (
  SELECT * FROM list
  UNION ALL
  SELECT l.date, l.part, l.pos + coalesce(c.n, 0), l.url, l.pre_info
  FROM late l LEFT JOIN (SELECT date, part, count(*) AS n FROM list GROUP BY ALL) c USING (date, part)
),
logs AS (
  SELECT date, part,
    count(*) * CASE WHEN date IN (DATE '2024-01-21', DATE '2024-01-22') THEN 2 ELSE 1 END AS total
  FROM list GROUP BY date, part
  UNION ALL
  SELECT DISTINCT CAST(ts AS DATE), 0, 0 FROM events WHERE CAST(ts AS DATE) NOT IN (SELECT date FROM pc)
),
numbered AS (
  SELECT date, part, total, row_number() OVER (ORDER BY date, part) - 1 AS index FROM logs
),
job AS (
  SELECT n.index, w.pos, w.url, w.pre_info, count(*) OVER (PARTITION BY n.index) AS urls,
    first_value(w.pre_info) OVER (PARTITION BY n.index ORDER BY w.pos) AS only_info
  FROM whole w JOIN numbered n USING (date, part)
),
last_info AS (SELECT index, url, arg_max(pre_info, pos) AS pre_info FROM job GROUP BY index, url)"""


def _with_lists(select: str) -> str:
    return f"WITH {_LISTS}\n{select}"


_LIST_COLUMNS = "date, part, pos, url, array_to_string(pre_info, '|') AS pre_info"

# ---------------------------------------------------------------- extraction

# Patterns of its own, for RE2: what the given pages hold, not all that pages may hold.
_ENTITIES = ", ".join(f"{_text(k)}: {_text(v)}" for k, v in html5.items() if k.endswith(";"))
_SHORT = {k: v for k, v in html5.items() if not k.endswith(";")}
_SHORT_ENTITIES = ", ".join(f"{_text(k)}: {_text(v)}" for k, v in _SHORT.items())
_SHORT_NAME = "^(?:" + "|".join(sorted(_SHORT, key=len, reverse=True)) + ")"
_INLINE_NAMES = (
    "abbr|acronym|b|bdi|bdo|big|cite|code|data|del|dfn|em|font|i|ins|kbd|label|mark|q|s|samp|small|span|strike|strong"
    "|sub|sup|time|tt|u|var|wbr"
)
_INLINE_TAG = r"(?i)</?(?:" + _INLINE_NAMES + r")(?:[ \t\r\n\f/][^>]*)?>"
_HIDDEN = (
    r"(?is)<script\b[^>]*>.*?(?:</script[^>]*>|\z)|<style\b[^>]*>.*?(?:</style[^>]*>|\z)"
    r"|<noscript\b[^>]*>.*?(?:</noscript[^>]*>|\z)|<option\b[^>]*>[^<]*|<!--.*?(?:-->|\z)"
)
_HEAD_TITLE = r"(?is)<title\b[^>]*>([^<]*)"
_TAG = r"<[/!?a-zA-Z][^>]*>"
_ASIAN = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
_BLANKS = "[ \\t\\r\\n\\f\xa0]+"


def _decoded(text: str) -> str:
    name = "regexp_extract(x, '^(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)', 0)"
    short = f"regexp_extract(x, {_text(_SHORT_NAME)}, 0)"
    return f"""array_to_string(list_transform(string_split({text}, '&'), lambda x, i: CASE
      WHEN i = 1 THEN x
      WHEN {name} LIKE '#x%' OR {name} LIKE '#X%'
        THEN chr(CAST('0x' || rtrim(substr({name}, 3), ';') AS INTEGER)) || substr(x, length({name}) + 1)
      WHEN {name} LIKE '#%' THEN chr(CAST(rtrim(substr({name}, 2), ';') AS INTEGER)) || substr(x, length({name}) + 1)
      ELSE coalesce(MAP {{{_ENTITIES}}}[{name}] || substr(x, length({name}) + 1),
        MAP {{{_SHORT_ENTITIES}}}[{short}] || substr(x, length({short}) + 1), '&' || x) END), '')"""


def _words(text: str) -> str:
    return (
        f"len(list_filter(string_split(regexp_replace({text}, {_text(_ASIAN)}, ' \\0 ', 'g'), ' '),"
        " lambda w: w <> ''))"
    )


_BLOCKS = rf"""
markup AS (
  SELECT page_id, url, regexp_replace(
    regexp_replace(html, {_text(_HIDDEN)}, '', 'g'), '[\x02-\x04]', ' ', 'g') AS m
  FROM pages
),
marked AS (
  SELECT page_id, url, trim(regexp_replace({_decoded(f"regexp_extract(m, {_text(_HEAD_TITLE)}, 1)")},
      {_text(_BLANKS)}, ' ', 'g')) AS title,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      m, {_text(_HEAD_TITLE)}, chr(2), 'g'),
      {_text(_INLINE_TAG)}, '', 'g'),
      '(?i)<a(?:[ \t\r\n\f/][^>]*)?>', chr(3), 'g'),
      '(?i)</a(?:[ \t\r\n\f/][^>]*)?>', chr(4), 'g'),
      {_text(_TAG)}, chr(2), 'g') AS t
  FROM markup
),
squeezed AS (
  SELECT page_id, url, title, regexp_replace({_decoded("t")}, {_text(_BLANKS)}, ' ', 'g') AS t FROM marked
),
raw AS (
  SELECT page_id, url, title, unnest(string_split(t, chr(2))) AS raw,
    generate_subscripts(string_split(t, chr(2)), 1) AS place
  FROM squeezed
),
/* a link left open by an earlier block goes on in this one */
open_link AS (
  SELECT *, coalesce(last_value(CASE WHEN contains(raw, chr(3)) OR contains(raw, chr(4))
      THEN regexp_extract(raw, '([\x03\x04])[^\x03\x04]*$', 1) END IGNORE NULLS) OVER (
      PARTITION BY page_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS carried
  FROM raw
),
measured AS (
  SELECT page_id, url, title, place,
    trim(replace(replace(raw, chr(3), ''), chr(4), '')) AS text,
    regexp_extract_all(CASE WHEN carried = chr(3) THEN chr(3) ELSE '' END || raw, '\x03([^\x03\x04]*)', 1) AS links
  FROM open_link
),
block AS (
  SELECT page_id, url, title, text, row_number() OVER w - 1 AS pos, {_words("text")} AS words,
    {_words("array_to_string(links, ' ')")} AS link_words
  FROM measured WHERE text <> ''
  WINDOW w AS (PARTITION BY page_id ORDER BY place)
),
around AS (
  SELECT *, link_words / words AS density,
    coalesce(lag(link_words / words) OVER w, 0) AS density_before,
    coalesce(lag(words) OVER w, 0) AS words_before, coalesce(lead(words) OVER w, 0) AS words_after
  FROM block WINDOW w AS (PARTITION BY page_id ORDER BY pos)
),
judged AS (
  SELECT *, CASE WHEN density > 0.333333 THEN false
    WHEN density_before <= 0.555556 THEN words > 16 OR words_after > 15 OR words_before > 4
    ELSE words > 40 OR words_after > 17 END AS is_content
  FROM around
),
article AS (
  SELECT m.page_id, m.url, m.title, coalesce(j.content, '') AS content
  FROM marked m LEFT JOIN (
    SELECT page_id, string_agg(text, chr(10) ORDER BY pos) AS content FROM judged WHERE is_content
    GROUP BY page_id) j USING (page_id)
)"""

# The article as a whole: windows over the blocks.
_END_MARKS = (
    "(?i)^(?:©|\\(c\\) |copyright |all rights reserved|comments?$|comments?[ (:]|leave a (?:comment|reply)"
    "|related (?:articles|posts|stories|news)|read (?:more|next)|share (?:this|on)|more from |tags?:"
    "|责任编辑|相关阅读|相关新闻|版权所有|免责声明|网友评论)"
)
_MAIN = rf"""
kind AS (
  SELECT *, words - link_words AS weight, CASE
    WHEN lower(text) = lower(title)
      OR list_contains(list_transform(string_split_regex(lower(title), ' [-|»·–—:] |_'), lambda p: trim(p)), lower(text)) THEN 'heading'
    WHEN words <= 20 AND regexp_matches(text, {_text(_END_MARKS)}) THEN 'end'
    WHEN is_content THEN 'body' ELSE 'other' END AS kind
  FROM judged
),
upto AS (
  SELECT *, coalesce(sum(CASE WHEN kind = 'body' THEN weight END) OVER w, 0) AS before,
    count(CASE WHEN kind = 'heading' THEN 1 END) OVER w AS headings
  FROM kind WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
closing AS (SELECT page_id, min(pos) AS closed FROM upto WHERE kind = 'end' AND before >= 20 GROUP BY page_id),
open_body AS (
  SELECT u.*, coalesce(pos - lag(pos) OVER w > 2 OR headings <> lag(headings) OVER w, true) AS begins
  FROM upto u LEFT JOIN closing c USING (page_id) WHERE kind = 'body' AND (closed IS NULL OR pos < closed)
  WINDOW w AS (PARTITION BY page_id ORDER BY pos)
),
grouped AS (SELECT *, count(CASE WHEN begins THEN 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS part FROM open_body),
best AS (
  SELECT page_id, first(part ORDER BY total DESC, part) AS part
  FROM (SELECT page_id, part, sum(weight) AS total FROM grouped GROUP BY ALL) WHERE total > 0 GROUP BY page_id
),
main AS (
  SELECT m.page_id, m.title, coalesce(g.content, '') AS content FROM marked m LEFT JOIN (
    SELECT page_id, string_agg(text, chr(10) ORDER BY pos) AS content FROM grouped JOIN best USING (page_id, part) GROUP BY page_id
  ) g USING (page_id)
)"""
_FRAMED_START = """framed AS (
  SELECT page_id, url, replace(html, '</article>', '</article><p>Comments (3)</p><p>One reader writes that this is all very well but that it could have been said in fewer words, and then goes on for quite a while about it.</p><p>Related articles</p><ul><li><a href=''/x''>Another one</a></li></ul>') AS html
  FROM pages
),
"""

# Text nodes: no element the selectors ask for is nested in another one of its kind.
_END_OF_P = (
    r"(?i)</?(?:address|article|aside|blockquote|body|center|div|dl|footer|form|h[1-6]|header|hr|html"
    r"|li|main|nav|ol|p|pre|section|table|tr|ul)(?:[ \t\r\n\f/][^>]*)?>"
)


def _nodes(region: str, inner: str, end: str) -> str:
    pieces = f"string_split_regex({region}, '(?i)<{inner}(?:[ \\t\\r\\n\\f/][^>]*)?>')[2:]"
    nodes = (
        f"flatten(list_transform({pieces}, lambda e: "
        f"string_split_regex(string_split_regex(e, {_text(end)})[1], {_text(_TAG)})))"
    )
    return f"list_transform(list_filter({nodes}, lambda s: s <> ''), lambda s: {_decoded('s')})"


_SELECTED = rf"""
article_part AS (
  SELECT page_id, url, regexp_extract(regexp_replace(html, {_text(_HIDDEN)}, '<!>', 'g'),
    '(?is)<article(?:[ \t\r\n\f/][^>]*)?>(.*?)(?:</article>|\z)', 1) AS region
  FROM pages
),
selected AS (
  SELECT page_id, url, {_nodes("region", "h1", "(?i)</h1(?:[ ][^>]*)?>")} AS titles,
    {_nodes("region", "p", _END_OF_P)} AS texts
  FROM article_part
)"""

# ---------------------------------------------------------------- redirects

_REDIRECTS = """
moved AS (SELECT page_id, listed, CASE WHEN page_id % 11 = 0 THEN listed ELSE url END AS target, page_id % 3 + 1 AS hops FROM pc WHERE url <> listed),
hop AS (
  SELECT CASE k WHEN 0 THEN listed ELSE listed || '#hop' || k END AS asked,
    CASE WHEN k + 1 = hops THEN target ELSE listed || '#hop' || (k + 1) END AS target
  FROM moved, range(3) t(k) WHERE k < hops
),
edge AS (SELECT asked, max(target) AS target FROM hop GROUP BY asked),
follow(asked, url, hops) AS (
  SELECT asked, target, 1 FROM edge
  UNION ALL
  SELECT f.asked, e.target, f.hops + 1 FROM follow f JOIN edge e ON e.asked = f.url WHERE f.hops < 100
),
resolved AS (SELECT asked AS url, url AS final, CAST(hops AS BIGINT) AS hops FROM follow f WHERE url NOT IN (SELECT asked FROM edge)),
answered AS (
  SELECT j.index, j.pos, j.url AS asked, coalesce(r.final, j.url) AS url, l.pre_info
  FROM job j JOIN last_info l USING (index, url) LEFT JOIN resolved r ON r.url = j.url
)"""

# ---------------------------------------------------------------- messages

_RESULTS = """
result AS (
  SELECT pc.page_id % 16 AS variant, a.url, a.title, a.content, string_split(pc.stockname, ',') AS companies
  FROM pc JOIN article a USING (page_id)
),
result_message AS (
  SELECT CASE WHEN variant = 1 THEN 'heartbeat' WHEN variant IN (2, 8, 9) THEN NULL ELSE 'crawlerResult' END AS kind,
    variant NOT IN (2, 7, 8, 9) AS has_data, CAST(NULL AS VARCHAR) AS log_date, CAST(NULL AS BIGINT) AS total,
    CASE WHEN variant NOT IN (2, 3, 7, 8, 9) THEN url END AS link,
    CASE WHEN variant NOT IN (2, 7, 8, 9) THEN title END AS title,
    CASE variant WHEN 2 THEN NULL WHEN 8 THEN NULL WHEN 9 THEN NULL WHEN 7 THEN NULL WHEN 5 THEN replace(content, chr(10), '') ELSE content END AS content,
    CASE variant WHEN 0 THEN NULL WHEN 2 THEN NULL WHEN 8 THEN NULL WHEN 9 THEN NULL WHEN 4 THEN [] WHEN 6 THEN [''] ELSE companies END AS pre_info,
    variant IN (2, 8, 9) AS bad
  FROM result
),
log_message AS (
  SELECT 'logInfo' AS kind, true AS has_data,
    CASE WHEN d = 27 THEN '2020-13-40' WHEN d % 5 = 1 THEN strftime(date, '%Y-%-m-%-d')
      ELSE strftime(date, '%Y-%m-%d') END AS log_date,
    total, CAST(NULL AS VARCHAR) AS link, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS content,
    CAST(NULL AS VARCHAR[]) AS pre_info, false AS bad
  FROM (SELECT *, date_diff('day', DATE '2024-01-01', date) AS d FROM logs)
),
message AS (SELECT * FROM log_message UNION ALL SELECT * FROM result_message),
routed AS (
  SELECT *, CASE WHEN bad THEN 'bad json'
      WHEN kind NOT IN ('logInfo', 'crawlerResult') THEN 'unknown type'
      WHEN NOT has_data THEN 'missing key data'
      WHEN kind = 'logInfo' AND try_strptime(log_date, '%Y-%m-%d') IS NULL THEN 'bad date'
      WHEN kind = 'logInfo' THEN NULL
      WHEN pre_info IS NULL THEN 'missing key preInfo'
      WHEN len(pre_info) = 0 THEN 'no company'
      WHEN len(pre_info) = 1 AND pre_info[1] = '' THEN 'empty company' END AS reason
  FROM message
),
stored AS (
  SELECT CASE WHEN kind = 'logInfo' THEN 'LogInfo' WHEN len(pre_info) > 1 THEN 'multiCompaniesTogether'
      ELSE pre_info[1] END AS collection,
    array_to_string(pre_info, '|') AS pre_info,
    CASE WHEN len(pre_info) > 1 THEN array_to_string(pre_info, '_') END AS keywords,
    link, title, content, '' AS post_info, kind, log_date, total
  FROM routed WHERE reason IS NULL
)"""


def _with_messages(select: str) -> str:
    return f"WITH {_LISTS},{_BLOCKS},{_RESULTS}\n{select}"


def _with_news(select: str) -> str:
    return f"""WITH {_LISTS},{_BLOCKS},
list_last AS (SELECT date, part, url, arg_max(pre_info, pos) AS pre_info FROM list GROUP BY ALL),
news AS (
  SELECT l.pos, s.pre_info, a.url, a.title, a.content
  FROM list l JOIN list_last s USING (date, part, url) JOIN article a USING (url)
)
{select}"""


_ARTICLES = "collection, pre_info, keywords, link, title, content, post_info"
_STORED_COUNTS = _with_messages(
    "SELECT collection, count(*) AS n FROM stored WHERE kind = 'crawlerResult' GROUP BY collection"
)
_URL_COMPANIES = _with_lists(
    """SELECT j.index, j.pos, p.page_id, j.url, 'paired' AS pairing, array_to_string(l.pre_info, '|') AS pre_info
FROM job j JOIN last_info l USING (index, url) JOIN pages p USING (url)"""
)
_ROUTED = _with_messages(f"SELECT {_ARTICLES} FROM stored WHERE kind = 'crawlerResult'")
_FEED_REJECTS = """
  SELECT 'feed' AS stage, status AS reason FROM parsed WHERE status NOT IN ('ok', 'repaired')
  UNION ALL
  SELECT 'feed entry', CASE WHEN json_array_length(e) = 0 THEN 'empty entry'
    ELSE 'entry without stockname' END
  FROM (SELECT unnest(CAST(newsinfo AS JSON[])) AS e FROM parsed WHERE status IN ('ok', 'repaired'))
  WHERE json_array_length(e) = 0 OR json_extract(e, '$[0].stockname') IS NULL"""
_UNLISTED = """
  SELECT 'enrich' AS stage, 'page url not in any list' AS reason, url AS payload FROM pages
  WHERE url NOT IN (SELECT url FROM list)"""

ORACLE = {
    "coverage_events": _coverage(EVENTS),
    "coverage_orders": _coverage(ORDERS),
    "next_dates": _next_dates(EVENTS, "2015-10-01"),
    "next_dates_gap": _next_dates(ORDERS, "2015-10-01"),
    "next_dates_forward": _next_dates(EVENTS, "2024-01-01"),
    "next_dates_no_log": _next_dates(EVENTS + " WHERE ts IS NULL", "2015-10-01"),
    "date_walk": _ORDER_DAYS,
    "missing_dates": f"{_ORDER_DAYS} EXCEPT {ORDERS}",
    "source_addresses": f"""
SELECT d AS date, 'http://stock.jrj.com.cn/share/news/company/' || strftime(d, '%Y-%m-%d') || '.js' AS address
FROM (SELECT CAST(unnest(generate_series(DATE '2015-10-01', min(d) - 1, INTERVAL 1 DAY)) AS DATE) AS d
  FROM ({EVENTS}))""",
    "feed_unwrap_parse": f"""WITH {_FEEDS}
SELECT date, part, status, CAST(json_array_length(newsinfo) AS BIGINT) AS entries, payload FROM parsed""",
    "feed_flatten": _with_lists(f"SELECT {_LIST_COLUMNS} FROM list"),
    "daily_log": f"WITH {_FEEDS}\nSELECT date, part, total FROM log",
    "feed_rejects": f"WITH {_FEEDS}\n{_FEED_REJECTS}",
    "joblist_append": _with_lists(f"SELECT {_LIST_COLUMNS} FROM whole"),
    "joblist_replace": _with_lists(
        f"""SELECT {_LIST_COLUMNS} FROM list WHERE (date, part) NOT IN (SELECT (date, part) FROM late)
UNION ALL SELECT {_LIST_COLUMNS} FROM late"""
    ),
    "joblist_clear": _with_lists(
        f"SELECT {_LIST_COLUMNS} FROM list WHERE (date, part) NOT IN (SELECT (date, part) FROM late)"
    ),
    "joblist_slice": _with_lists(
        f"SELECT {_LIST_COLUMNS}, 'subList' AS list_type FROM list WHERE pos >= 0 AND pos < 2"
    ),
    "joblist_slice_from_end": _with_lists(
        """SELECT date, part, pos - greatest(n - 3, 0) AS pos, url,
  array_to_string(pre_info, '|') AS pre_info, 'subList' AS list_type
FROM (SELECT *, count(*) OVER (PARTITION BY date, part) AS n FROM list)
WHERE pos >= greatest(n - 3, 0) AND pos < n - 1"""
    ),
    "joblist_count": _with_lists("SELECT date, part, count(*) AS n FROM whole GROUP BY date, part"),
    "job_numbers": _with_lists("SELECT date, part, total, index FROM numbered"),
    "job_messages": _with_lists(
        """SELECT n.index, coalesce(w.pos // 5 * 5, 0) AS start, strftime(n.date, '%Y-%m-%d') AS log_date, n.total,
  coalesce(string_agg(w.url, '|' ORDER BY w.pos), '') AS urls,
  coalesce(string_agg(array_to_string(w.pre_info, '+'), '|' ORDER BY w.pos), '') AS pre_infos
FROM numbered n LEFT JOIN whole w USING (date, part) GROUP BY ALL"""
    ),
    "sublist_messages": _with_lists(
        """SELECT n.index, coalesce(w.pos // 2 * 2, 0) AS start, strftime(n.date, '%Y-%m-%d') AS log_date, n.total,
  CASE WHEN count(w.url) > 0 THEN 'subList' END AS list_type, coalesce(string_agg(w.url, '|' ORDER BY w.pos), '') AS urls
FROM numbered n LEFT JOIN (SELECT * FROM list WHERE pos < 3) w USING (date, part)
GROUP BY n.index, coalesce(w.pos // 2 * 2, 0), n.date, n.total"""
    ),
    "url_companies": _URL_COMPANIES,
    "url_companies_split": _URL_COMPANIES,
    "url_companies_copies": _URL_COMPANIES,
    "url_companies_single": _with_lists(
        """SELECT j.index, j.pos, p.page_id, CASE WHEN urls = 1 THEN 'paired' ELSE 'single' END AS pairing,
  array_to_string(only_info, '|') AS pre_info
FROM job j JOIN pages p USING (url)"""
    ),
    "url_no_companies": _with_lists(
        """SELECT j.index, j.pos, p.page_id, CASE WHEN urls <= 2 THEN 'paired' ELSE 'none' END AS pairing,
  CASE WHEN urls <= 2 THEN array_to_string(l.pre_info, '|') END AS pre_info
FROM job j JOIN last_info l USING (index, url) JOIN pages p USING (url)"""
    ),
    "url_unmatched": _with_lists(_UNLISTED),
    "url_redirected": f"""WITH RECURSIVE {_LISTS},{_REDIRECTS}
SELECT a.index, a.pos, p.page_id, a.asked, a.url, array_to_string(a.pre_info, '|') AS pre_info FROM answered a JOIN pages p USING (url)""",
    "redirect_hops": f"WITH RECURSIVE {_PAGES},{_REDIRECTS[: _REDIRECTS.index('answered') - 2]}\nSELECT url, final, hops FROM resolved",
    "redirect_rejects": f"""WITH RECURSIVE {_LISTS},{_REDIRECTS}
SELECT stage, reason, count(*) AS n FROM (
  SELECT 'enrich' AS stage, 'redirect loop' AS reason FROM edge WHERE asked NOT IN (SELECT url FROM resolved)
  UNION ALL SELECT 'enrich', 'page url not in any list' FROM pages WHERE url NOT IN (SELECT url FROM answered)
  UNION ALL SELECT 'enrich', 'listed url has no page' FROM answered WHERE url NOT IN (SELECT url FROM pages)
) GROUP BY stage, reason""",
    "listed_filter": _with_lists("SELECT page_id, url FROM pages WHERE url IN (SELECT url FROM list)"),
    "article_main": f"WITH {_BLOCKS},{_MAIN}\nSELECT page_id, title, content FROM main",
    "article_main_layouts": f"""WITH {_BLOCKS.replace("FROM pages", "FROM framed").replace("markup AS (", _FRAMED_START + "markup AS (", 1)},{_MAIN}
SELECT page_id, title, content FROM main""",
    "text_blocks": f"WITH {_BLOCKS}\nSELECT page_id, is_content, text, pos, words, link_words FROM judged",
    "article_content": f"WITH {_BLOCKS}\nSELECT url AS link, title, content FROM article",
    "selector_extract": f"""WITH {_SELECTED}
SELECT page_id, array_to_string(titles, '|') AS title, array_to_string(texts, '|') AS content FROM selected""",
    "selector_places": f"""WITH {_SELECTED}
SELECT page_id, array_to_string(titles, '|') AS title, array_to_string(texts, '|') AS content FROM selected""",
    "selector_blocks": "SELECT page_id, CASE WHEN html LIKE '%<h1>%' THEN 'a|b|c' ELSE '' END AS texts FROM pages",
    "selector_links": rf"""
SELECT page_id, array_to_string(list_transform(
  regexp_extract_all(nav, '(?is)<a(?:[ \t\r\n\f/][^>]*)?>([^<]+)</a>', 1), lambda s: {_decoded('s')}), '|') AS links
FROM (SELECT page_id, regexp_extract(html, '(?is)<nav[^>]*>(.*?)</nav>', 1) AS nav FROM pages)""",
    "messages_encoded": _with_news(
        """SELECT 'logInfo' AS kind, strftime(date, '%Y-%m-%d') AS log_date, total, CAST(NULL AS VARCHAR) AS link,
  CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS content, CAST(NULL AS VARCHAR) AS pre_info FROM logs
UNION ALL
SELECT 'crawlerResult', NULL, NULL, url, title, content, array_to_string(pre_info, '|') FROM news"""
    ),
    "messages_decoded": _with_messages(
        """SELECT kind, has_data, log_date, total, link, title, content,
  array_to_string(pre_info, '|') AS pre_info, bad FROM message"""
    ),
    "legacy_normalised": f"""WITH {_LISTS},{_SELECTED}
SELECT 'logInfo' AS kind, strftime(date, '%Y-%m-%d') AS log_date, total, CAST(NULL AS VARCHAR) AS link,
  CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS content, CAST(NULL AS VARCHAR) AS pre_info FROM logs
UNION ALL
SELECT 'crawlerResult', NULL, NULL, s.url, array_to_string(titles, ''), array_to_string(texts, ''),
  replace(stockname, ',', '|') FROM selected s JOIN pc USING (page_id)""",
    "routed": _ROUTED,
    "route_counts": _with_messages("SELECT collection, count(*) AS n FROM stored GROUP BY collection"),
    "keywords": _with_messages(
        "SELECT keywords, count(*) AS n FROM stored WHERE kind = 'crawlerResult' GROUP BY keywords"
    ),
    "log_dates": _with_messages(
        "SELECT CAST(strptime(log_date, '%Y-%m-%d') AS DATE) AS date, total FROM stored WHERE kind = 'logInfo'"
    ),
    "rejects": f"""WITH {_LISTS},{_BLOCKS},{_RESULTS},
{_FEEDS.replace(_PAGES + ",", "")}
SELECT stage, reason, count(*) AS n FROM (
  {_FEED_REJECTS}
  UNION ALL SELECT stage, reason FROM ({_UNLISTED})
  UNION ALL SELECT 'route', reason FROM routed WHERE reason IS NOT NULL
  UNION ALL SELECT 'job', 'list without log' FROM unlogged
) GROUP BY stage, reason""",
    "required_gate": _with_messages(
        """SELECT link, title, '' AS post_info, CASE WHEN pre_info IS NULL THEN 'missing key pre_info'
  WHEN link IS NULL THEN 'missing key link' WHEN title IS NULL THEN 'missing key title' END AS reason
FROM message WHERE kind = 'crawlerResult'"""
    ),
    "store_roundtrip": f"SELECT *, true AS stamped FROM ({_STORED_COUNTS})",
    "collection_exists": _with_messages(
        """SELECT s_name AS collection, s_name IN (SELECT collection FROM stored WHERE kind = 'crawlerResult') AS present
FROM supplier"""
    ),
    "item_export": f"WITH {_BLOCKS}\nSELECT url AS link, title, content FROM article",
    "stream_drain": _ROUTED,
    "stream_two_queues": _with_messages(
        "SELECT collection, 2 * count(*) AS n FROM stored WHERE kind = 'crawlerResult' GROUP BY collection"
    ),
    "store_joined": _with_messages(
        "SELECT collection, 3 * count(*) AS n, 3 * count(*) AS indexed FROM stored WHERE kind = 'crawlerResult' GROUP BY collection"
    ),
    "stream_collection_exists": _with_messages(
        """SELECT s_name AS collection, s_name IN (SELECT collection FROM stored WHERE kind = 'crawlerResult') AS present
FROM supplier UNION ALL SELECT 'a late one', true"""
    ),
    "stream_empty": """
SELECT count(*) AS suppliers, 0 AS present, 0 AS messages, 'no_collection' AS status, unnest(['before', 'after']) AS state
FROM supplier""",
    "stream_rejects": _with_messages(
        "SELECT 'route' AS stage, reason, count(*) AS n FROM routed WHERE reason IS NOT NULL GROUP BY reason"
    ),
    "stream_next_dates": _next_dates(
        _with_lists(
            """SELECT date AS d FROM logs WHERE date <> DATE '2024-01-28'"""
        ),
        "2015-10-01",
    ),
    "stream_backlog": f"""WITH {_LISTS}
SELECT 'before' AS state, (SELECT count(*) FROM pages) + (SELECT count(*) FROM logs) AS messages
UNION ALL SELECT 'after', 0""",
    "latest_result": """
SELECT CAST(user_id AS VARCHAR) AS key, arg_max(props, event_id) AS value FROM events GROUP BY user_id""",
    "latest_result_folded": """
SELECT CAST(user_id AS VARCHAR) AS key, arg_max(props, event_id) AS value FROM events GROUP BY user_id""",
    "coverage_intervals": f"""
SELECT min(d) AS first, max(d) AS last FROM (
  SELECT d, d - CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS island FROM (SELECT DISTINCT d FROM ({ORDERS}) WHERE d IS NOT NULL)
) GROUP BY island""",
    "missing_dates_folded": f"{_ORDER_DAYS} EXCEPT {ORDERS}",
    "next_dates_folded": _next_dates(EVENTS, "2015-10-01"),
    "collection_rows": _with_messages(
        "SELECT collection, 2 * count(*) AS n FROM stored WHERE kind = 'crawlerResult' GROUP BY collection"
    ),
    "stream_stop_rule": _STORED_COUNTS,
    "next_dates_answer": f"""
SELECT 'nextDate' AS key, status, before, after FROM ({_next_dates(EVENTS, "2015-10-01")})""",
    "daily_news": _with_news(
        """SELECT CASE WHEN len(pre_info) > 1 THEN 'multiCompaniesTogether' ELSE pre_info[1] END AS collection,
  array_to_string(pre_info, '|') AS pre_info,
  CASE WHEN len(pre_info) > 1 THEN array_to_string(pre_info, '_') END AS keywords,
  url AS link, title, content, '' AS post_info FROM news"""
    ),
    "daily_news_redirected": f"""WITH RECURSIVE {_LISTS},{_BLOCKS},{_REDIRECTS},
list_last AS (SELECT date, part, url, arg_max(pre_info, pos) AS pre_info FROM list GROUP BY ALL),
news AS (
  SELECT s.pre_info, a.url, a.title, a.content FROM list l JOIN list_last s USING (date, part, url)
  LEFT JOIN resolved r ON r.url = l.url JOIN article a ON a.url = coalesce(r.final, l.url)
)
SELECT CASE WHEN len(pre_info) > 1 THEN 'multiCompaniesTogether' ELSE pre_info[1] END AS collection,
  array_to_string(pre_info, '|') AS pre_info, url AS link, title, content FROM news""",
    "daily_news_rejects": f"""WITH {_LISTS},
{_FEEDS.replace(_PAGES + ",", "")}
SELECT stage, reason, count(*) AS n FROM (
  {_FEED_REJECTS}
  UNION ALL SELECT stage, reason FROM ({_UNLISTED})
  UNION ALL SELECT 'enrich', 'listed url has no page' FROM list WHERE url NOT IN (SELECT url FROM pages)
) GROUP BY stage, reason""",
}
