"""SQL twins of the registered queries, for an independent engine on the same tables."""

from __future__ import annotations

import re

from newsloom.catalogue import tables as V
from newsloom.functions.topics import TOPIC_KEYWORDS
from newsloom.operators.scoring import NEGATIVE_WORDS, POSITIVE_WORDS

SQL: dict[str, str] = {}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


# --- shared pieces -------------------------------------------------------------------------------

_T_USER, _T_EVENT = "concat('T', user_id % 20)", "concat('T', event_id % 7)"
SCORED = f"""scored AS (
    SELECT ts, CAST(event_id AS VARCHAR) AS id, event_type AS source,
           concat('https://example.com/n/', event_id) AS url, concat(event_type, ' ', event_id) AS title,
           CASE WHEN {_T_USER} = {_T_EVENT} THEN [{_T_USER}] ELSE [{_T_USER}, {_T_EVENT}] END AS tickers,
           CAST((event_id % 201 - 100) / 100.0 AS FLOAT) AS sentiment,
           CASE event_type WHEN 'purchase' THEN ['earnings', 'product'] WHEN 'signup' THEN ['guidance']
                WHEN 'click' THEN ['macro', 'product'] WHEN 'view' THEN ['legal']
                ELSE CAST([] AS VARCHAR[]) END AS topics,
           epoch_us(ts) // 1000 AS scored_ts
    FROM events)"""
SENT = "round(CAST(sentiment AS DOUBLE), 6)"
RECENT = "ts IS NOT NULL"  # a trailing window as long as the events
DAY = "ts >= (SELECT max(ts) FROM events) - INTERVAL 1440 MINUTE"


def means(window: str = RECENT) -> str:
    return f"""means AS (
    SELECT ticker, avg(CAST(sentiment AS DOUBLE)) AS avg_sent, count(*) AS n
    FROM (SELECT unnest(tickers) AS ticker, sentiment FROM scored WHERE {window})
    GROUP BY ticker HAVING count(*) >= 3)"""


def band(s: str) -> str:
    return f"CASE WHEN {s} >= 0.4 THEN 'positive' WHEN {s} <= -0.4 THEN 'negative' ELSE 'neutral' END"


def normalized(u: str) -> str:
    bare = f"split_part({u}, '#', 1)"
    host = rf"regexp_replace(lower(regexp_extract({bare}, '^.*?://([^/]*)', 1)), '^www\.', '')"
    path = rf"regexp_replace(regexp_extract({bare}, '^.*?://[^/]*(/[^?]*)', 1), '^(.+)/$', '\1')"
    query = rf"regexp_extract({bare}, '^.*?://[^/]*/[^?]*\?(.*)$', 1)"
    kept = (
        f"array_to_string(list_filter(string_split({query}, '&'), "
        "lambda p: NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'fbclid=')), '&')"
    )
    return (
        f"CASE WHEN contains({bare}, '://') THEN lower(split_part({bare}, '://', 1)) || '://' || {host} || {path} || "
        f"CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END ELSE {bare} END"
    )


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^.*?://([^/]*)', 1))"


def path_words(u: str) -> str:
    return f"regexp_extract_all(lower(regexp_extract({u}, '^.*?://[^/]*/(.*)$', 1)), '[a-z0-9]{{3,}}')"


def hints(u: str, text: str) -> str:
    tags = rf"regexp_extract_all({text}, '(?:^|[\s(\[])(\$[A-Z]{{1,5}})(?:$|[\s)\],.!?;:])', 1)"
    hosts = f"CASE WHEN {host(u)} <> '' THEN ['host:' || {host(u)}] ELSE CAST([] AS VARCHAR[]) END"
    paths = f"list_transform({path_words(u)}, lambda p: 'path:' || p)"
    return f"list_sort(list_distinct(list_concat({tags}, {hosts}, {paths})))"


def cashtags(text: str) -> str:
    # Each dollar sign gets a blank in front, so the character after a tag can be consumed.
    return rf"list_distinct(regexp_extract_all(replace({text}, '$', ' $'), '\$([A-Z]{{1,5}})(?:[^\p{{L}}\p{{N}}_]|$)', 1))"


def topics(low: str) -> str:
    cases = []
    for topic, words in sorted(TOPIC_KEYWORDS.items()):
        test = " OR ".join(f"contains({low}, {_text(w)})" for w in words)
        cases.append(f"CASE WHEN {test} THEN {_text(topic)} END")
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


def decoded(html: str) -> str:
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        html = f"replace({html}, {_text(entity)}, {_text(char)})"
    return html


def trimmed(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+$', '')"


def page_title(html: str) -> str:
    title = trimmed(decoded(f"regexp_extract({html}, '(?s)<title>(.*?)</title>', 1)"))
    heading = trimmed(decoded(f"regexp_extract({html}, '(?s)<h1>(.*?)</h1>', 1)"))
    return f"CASE WHEN {title} <> '' THEN {title} ELSE {heading} END"


def page_body(html: str) -> str:
    inner = f"regexp_extract({html}, '(?s)<article>(.*?)</article>', 1)"
    lines = f"regexp_replace({inner}, '<(p|div|section|br|li)>', chr(10), 'g')"
    return trimmed(decoded(f"regexp_replace({lines}, '<[^>]*>', '', 'g')"))


def language(text: str) -> str:
    """Bytes as pairs of hex digits; printable ASCII, tab and line ends count."""
    digits = f"substr(hex(encode({text})), 1, 10002)"
    pairs = f"regexp_extract_all({digits}, '..')"
    plain = f"len(list_filter({pairs}, lambda b: (b >= '20' AND b <= '7E') OR b IN ('09', '0A', '0D')))"
    return f"CASE WHEN {text} <> '' AND {plain} / (length({digits}) / 2) > 0.85 THEN 'en' ELSE 'unknown' END"


def model_text(title: str, body: str) -> str:
    return f"({title} || chr(10) || substr({body}, 1, 2000))"


def judged(text: str) -> tuple[str, str]:
    words = f"regexp_extract_all(lower({text}), '[a-z]+')"
    neg = f"exp(len(list_filter({words}, lambda w: w IN ({', '.join(map(_text, NEGATIVE_WORDS))}))))"
    pos = f"exp(len(list_filter({words}, lambda w: w IN ({', '.join(map(_text, POSITIVE_WORDS))}))))"
    total = f"({neg} + exp(1) + {pos})"
    as_float = "round(CAST(CAST({} AS FLOAT) AS DOUBLE), 5)"
    return as_float.format(f"(({pos} - {neg}) / {total})"), as_float.format(f"(greatest({neg}, exp(1), {pos}) / {total})")


_TITLES = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {_text(t)}" for i, t in enumerate(V.DOC_TITLES)) + " END"
_HOSTS = "CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN {_text(h)}" for i, h in enumerate(V.DOC_HOSTS)) + " END"
DOCS = f"""docs AS (
    SELECT CAST(doc_id AS VARCHAR) AS id, source, {_TITLES} AS title, concat(text, ' ', {_TITLES}) AS body,
           concat('https://', {_HOSTS}, '/', source, '/', lang, '-story_', doc_id) AS url
    FROM documents)"""

_DICTIONARY = ", ".join(
    f"({i}, {_text(symbol)}, {_list([a.lower() for a in dict.fromkeys([name, *aliases.split(';')])])})"
    for i, (symbol, name, aliases) in enumerate(V.TICKER_ROWS)
)


# Fixed dictionary of the twins: place, alias, the symbol that owns it.
_OWNED: dict[str, str] = {}
for _symbol, _name, _aliases in V.TICKER_ROWS:
    for _alias in (_name, *_aliases.split(";")):
        _OWNED.setdefault(_alias, _symbol)
_ALIASES = ", ".join(f"({i}, {_text(alias)}, {_text(symbol)})" for i, (alias, symbol) in enumerate(_OWNED.items()))


def entity_text(title: str, body: str) -> str:
    return trimmed(f"({title} || chr(10) || substr({body}, 1, 3000))")


def runs(text: str) -> str:
    """Capitalized runs: binding signs are marked by control characters, neighbours that share a letter in a second pass."""
    for _ in range(2):
        text = rf"regexp_replace({text}, '([A-Za-z0-9&''-])\.([A-Za-z0-9&''-])', '\1' || chr(2) || '\2', 'g')"
    text = rf"regexp_replace({text}, '\b(Inc|Corp|Co|Ltd)\.', '\1' || chr(3), 'g')"
    for _ in range(2):
        text = rf"regexp_replace({text}, '([A-Za-z0-9&''\x03-]) ([A-Z])', '\1' || chr(1) || '\2', 'g')"
    found = rf"regexp_extract_all({text}, '[A-Z][A-Za-z0-9&''\x01\x02\x03-]*')"
    return f"list_transform({found}, lambda r: translate(r, chr(1) || chr(2) || chr(3), ' ..'))"


def matches(mentions: str) -> str:
    """CTE `matches(mention, alias, score, symbol)` of the distinct `mention` column of a query: token-set
    similarity with the longest common subsequence as a recursive table, a letter of one text per step."""
    return f"""aliases(place, alias, symbol) AS (VALUES {_ALIASES}),
pairs AS (
    SELECT mention, place, alias, symbol, list_sort(list_intersect(a, b)) AS joint,
           array_to_string(list_sort(list_filter(a, lambda w: NOT list_contains(b, w))), ' ') AS ta,
           array_to_string(list_sort(list_filter(b, lambda w: NOT list_contains(a, w))), ' ') AS tb
    FROM (SELECT mention, place, alias, symbol, list_distinct(string_split(mention, ' ')) AS a, list_distinct(string_split(alias, ' ')) AS b
          FROM (SELECT DISTINCT mention FROM ({mentions})), aliases)),
sized AS (
    SELECT *, CASE WHEN len(joint) > 0 THEN 1 ELSE 0 END AS gap, length(array_to_string(joint, ' ')) AS joined, length(ta) AS na, length(tb) AS nb FROM pairs),
near AS (
    SELECT * FROM sized WHERE (gap = 1 AND (na = 0 OR nb = 0)) OR 100.0 - 100.0 * abs(na - nb) / (2 * joined + 2 * gap + na + nb) >= 85
        OR (gap = 1 AND 100.0 - 100.0 * (gap + least(na, nb)) / (2 * joined + gap + least(na, nb)) >= 85)),
steps AS (
    SELECT DISTINCT ta, tb, 0 AS k, [0 for i in range(length(ta))] AS line FROM near
    UNION ALL
    SELECT ta, tb, k + 1, list_transform(range(1, length(ta) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i:
        greatest(line[i], (CASE WHEN i > 1 THEN line[i - 1] ELSE 0 END) + (CASE WHEN substr(ta, i, 1) = substr(tb, k + 1, 1) THEN 1 ELSE 0 END)))))
    FROM steps WHERE k < length(tb)),
common AS (SELECT ta, tb, coalesce(line[-1], 0) AS n FROM steps WHERE k = length(tb)),
judged AS (
    SELECT mention, place, alias, symbol, CASE WHEN gap = 1 AND (na = 0 OR nb = 0) THEN 100.0::DOUBLE
        ELSE greatest(100.0::DOUBLE - 100.0::DOUBLE * (na + nb - 2 * n) / (2 * joined + 2 * gap + na + nb),
                      CASE WHEN gap = 1 THEN 100.0::DOUBLE - 100.0::DOUBLE * (gap + least(na, nb)) / (2 * joined + gap + least(na, nb)) ELSE 0 END) END AS score
    FROM near JOIN common USING (ta, tb)),
matches AS (
    SELECT mention, alias, score, symbol FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, place) AS nth FROM judged WHERE score >= 85)
    WHERE nth = 1)"""


def entities(articles: str, names: bool = False) -> str:
    """CTEs `entities(id, entities)` and `matched(id, symbol, mentions)` of the articles in a CTE with id, title, body."""
    text = entity_text("title", "body")
    with_names = f"list_concat(found, list_filter({_known('t')}, lambda n: NOT list_contains(found, n)))" if names else "found"
    return f"""heads AS (SELECT id, {text} AS t FROM {articles}), run_lists AS (SELECT id, t, {runs('t')} AS found FROM heads),
entities AS (SELECT id, {with_names} AS entities FROM run_lists),
{matches("SELECT unnest(entities) AS mention FROM entities")},
matched AS (SELECT id, symbol, count(*) AS mentions FROM (SELECT id, unnest(entities) AS mention FROM entities) JOIN matches USING (mention) GROUP BY id, symbol)"""


def _known(text: str) -> str:
    """Dictionary names as whole words, the longest first; doubled blanks let neighbours share one."""
    escaped = [re.sub(r"([.&-])", r"\\\1", n).replace(" ", "  ") for n in sorted({r[1] for r in V.TICKER_ROWS}, key=len, reverse=True)]
    edge = r"[^\p{L}\p{N}&''-]"
    found = f"regexp_extract_all(replace({text}, ' ', '  '), '(?:^|{edge})({'|'.join(escaped)})(?:$|{edge})', 1)"
    return f"list_distinct(list_transform({found}, lambda n: replace(n, '  ', ' ')))"


def scores(articles: str, mentions: bool = False, dictionary: str = f"dictionary(ord, symbol, names) AS (VALUES {_DICTIONARY})") -> str:
    """`scores(id, symbol, ord, score)` of every article in a CTE with id, title, body, url; `mentions` adds those of CTE `matched`."""
    h = host("url")
    table, add = ("LEFT JOIN matched USING (id, symbol)", " + coalesce(mentions, 0)") if mentions else ("", "")
    return f"""{dictionary},
facts AS (SELECT id, lower(title) AS low, {cashtags("(title || ' ' || body)")} AS tags, {h} AS host FROM {articles}),
scores AS (
    SELECT id, symbol, ord,
           CASE WHEN list_contains(tags, symbol) THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END
           + CASE WHEN contains(low, lower(symbol)) OR len(list_filter(names, lambda n: contains(low, n))) > 0
                  THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END
           + CASE WHEN contains(host, 'ir.') OR contains(host, 'investor')
                       OR (ends_with(host, '.com') AND contains(host, lower(symbol)))
                  THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END{add} AS score
    FROM (SELECT * FROM facts CROSS JOIN dictionary) {table}),
best AS (
    SELECT id, list(symbol ORDER BY score DESC, ord)[1:5] AS tickers FROM scores WHERE score >= 2.0 GROUP BY id)"""


EMPTY = "CAST([] AS VARCHAR[])"

# --- analytics -----------------------------------------------------------------------------------

SQL["latest"] = f"""WITH {SCORED} SELECT ts, id, source, url, title, tickers, {SENT} AS sentiment, topics
FROM scored ORDER BY ts DESC, id LIMIT 50"""
SQL["ops_latest"] = f"""WITH {SCORED} SELECT ts, id, title, tickers, {SENT} AS sentiment, topics
FROM scored ORDER BY ts DESC, id LIMIT 50"""
_MEAN = "SELECT ticker, round(avg_sent, 6) AS avg_sent, n FROM means"
SQL["ticker_sentiment"] = f"WITH {SCORED}, {means()} {_MEAN}"
SQL["top_sentiment_pos"] = f"WITH {SCORED}, {means()} {_MEAN} ORDER BY means.avg_sent DESC, ticker LIMIT 20"
SQL["top_sentiment_neg"] = f"WITH {SCORED}, {means()} {_MEAN} ORDER BY means.avg_sent ASC, ticker LIMIT 20"
SQL["top_sentiment_ends"] = f"""WITH {SCORED}, {means(DAY)}
SELECT * FROM (SELECT ticker, round(avg_sent, 6) AS avg_sent, n, 'positive' AS side FROM means ORDER BY means.avg_sent DESC, ticker LIMIT 20)
UNION ALL
SELECT * FROM (SELECT ticker, round(avg_sent, 6) AS avg_sent, n, 'negative' AS side FROM means ORDER BY means.avg_sent ASC, ticker LIMIT 20)"""
SQL["top_movers_display"] = f"""WITH {SCORED}, {means()}
SELECT ticker, printf('%.2f', avg_sent) AS shown, n FROM means ORDER BY avg_sent DESC, ticker LIMIT 10"""
SQL["minute_series"] = f"""WITH {SCORED}
SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM scored WHERE {RECENT} GROUP BY 1"""
SQL["source_counts"] = f"""WITH {SCORED}
SELECT source, count(*) AS n FROM scored WHERE {RECENT} GROUP BY source ORDER BY n DESC, source LIMIT 10"""
SQL["topic_counts"] = f"""WITH {SCORED}
SELECT topic, count(*) AS n FROM (SELECT unnest(topics) AS topic FROM scored WHERE {RECENT})
GROUP BY topic ORDER BY n DESC, topic LIMIT 15"""
SQL["stat_cards"] = f"""WITH {SCORED}
SELECT * FROM (SELECT 'sources' AS card, source AS label, count(*) AS n FROM scored WHERE {RECENT}
               GROUP BY source ORDER BY n DESC, source LIMIT 8)
UNION ALL
SELECT * FROM (SELECT 'topics' AS card, topic AS label, count(*) AS n
               FROM (SELECT unnest(topics) AS topic FROM scored WHERE {RECENT}) GROUP BY topic ORDER BY n DESC, topic LIMIT 8)"""
_FEED = f"""{SCORED}, exploded AS (SELECT unnest(tickers) AS ticker, * FROM scored),
feed AS (SELECT ticker, CAST(row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, id DESC) AS INTEGER) AS rank,
                id, title, {SENT} AS sentiment, ts, max(ts) OVER (PARTITION BY ticker) AS newest FROM exploded),
alive AS (SELECT ticker, rank, id, title, sentiment, ts FROM feed
          WHERE rank <= 50 AND newest > (SELECT max(ts) FROM events) - INTERVAL 7 DAY)"""
SQL["ticker_feed"] = f"WITH {_FEED} SELECT * FROM alive"
SQL["ticker_feed_query"] = f"WITH {_FEED} SELECT * FROM alive WHERE ticker = 'T3' AND rank <= 20"
SQL["query_parameters"] = f"""WITH {_FEED}, {means(DAY).replace('>= 3)', '>= 100)')}
SELECT * FROM (SELECT 'latest' AS query, id AS label FROM scored ORDER BY ts DESC, id LIMIT 500)
UNION ALL SELECT 'means', ticker FROM means
UNION ALL SELECT 'feed', id FROM (SELECT ticker, id, newest, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, id DESC) AS nth FROM (SELECT ticker, id, ts, max(ts) OVER (PARTITION BY ticker) AS newest FROM exploded))
WHERE ticker = 'T3' AND nth <= 200"""
SQL["live_merge"] = f"""WITH {SCORED},
stored AS (SELECT id, title, scored_ts AS time_ms, sentiment, 0 AS priority FROM scored ORDER BY time_ms DESC, id LIMIT 100),
live AS (SELECT id, concat('live ', title) AS title, scored_ts AS time_ms, sentiment, 1 AS priority
         FROM scored WHERE source IN ('purchase', 'signup') ORDER BY time_ms DESC, id LIMIT 200),
merged AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority, time_ms DESC) AS copy
           FROM (SELECT * FROM stored UNION ALL SELECT * FROM live))
SELECT id, title, time_ms, {SENT} AS sentiment, {band('sentiment')} AS band
FROM merged WHERE copy = 1 ORDER BY time_ms DESC, id LIMIT 200"""
SQL["sentiment_band"] = f"""WITH {SCORED}
SELECT id, {band('sentiment')} AS band, CASE WHEN sentiment >= 0 THEN 'positive' ELSE 'negative' END AS sign,
       printf('%.2f', CAST(sentiment AS DOUBLE)) AS shown, strftime(ts, '%H:%M:%S') AS time FROM scored"""

# --- first-seen filters ------------------------------------------------------------------------

SQL["dedup_ttl"] = """WITH RECURSIVE walk AS (
    SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY user_id, event_type
    UNION ALL
    SELECT w.user_id, w.event_type, min(e.ts) AS ts
    FROM walk w JOIN events e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.ts >= w.ts + INTERVAL 48 HOUR
    GROUP BY w.user_id, w.event_type)
SELECT min(e.event_id) AS event_id, e.ts, e.user_id, e.event_type
FROM events e JOIN walk w ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.ts = w.ts
GROUP BY e.ts, e.user_id, e.event_type"""
SQL["dedup_ttl_sliced"] = """WITH RECURSIVE next AS (
    SELECT event_type, ts, min(ts) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS following
    FROM (SELECT DISTINCT event_type, ts FROM events)),
walk AS (
    SELECT event_type, min(ts) AS ts FROM events GROUP BY event_type
    UNION ALL
    SELECT w.event_type, n.following AS ts FROM walk w JOIN next n ON n.event_type = w.event_type AND n.ts = w.ts WHERE n.following IS NOT NULL)
SELECT min(e.event_id) AS event_id, e.ts, e.event_type
FROM events e JOIN walk w ON e.event_type = w.event_type AND e.ts = w.ts GROUP BY e.ts, e.event_type"""
SQL["dedup_history"] = """WITH keyed AS (SELECT event_id, ts, concat(user_id, '/', event_type) AS key FROM events),
past AS (SELECT key, max(ts) AS last FROM keyed WHERE ts < TIMESTAMP '2024-01-16' GROUP BY key)
SELECT event_id, ts, k.key FROM keyed k LEFT JOIN past p ON p.key = k.key
WHERE ts >= TIMESTAMP '2024-01-16' AND (p.last IS NULL OR ts - p.last >= INTERVAL 48 HOUR)"""

SQL["dedup_backfill"] = """WITH keyed AS (SELECT event_id, ts, concat(user_id, '/', event_type) AS key FROM events),
load AS (SELECT * FROM keyed WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-16'),
past AS (SELECT * FROM keyed WHERE ts < TIMESTAMP '2024-01-10' OR ts >= TIMESTAMP '2024-01-16' OR event_id % 3 = 0)
SELECT event_id, ts, key FROM load WHERE NOT EXISTS (
    SELECT 1 FROM past WHERE past.key = load.key AND past.ts <= load.ts AND load.ts - past.ts < INTERVAL 48 HOUR)"""

# --- URLs, ids, feeds and pages --------------------------------------------------------------

# The primes of XXH64.
_P1, _P2, _P3 = 11400714785074694791, 14029467366897019727, 1609587929392839161
_P4, _P5 = 9650029242287828579, 2870177450012600261
_M = "18446744073709551616::UHUGEINT"


def _mul(a: str, b: str | int) -> str:
    return f"(({a}) * {b}::UHUGEINT) % {_M}"


def _add(a: str, b: str | int) -> str:
    return f"(({a}) + {b}::UHUGEINT) % {_M}"


def _rotated(a: str, bits: int) -> str:
    return f"((({a}) * {1 << bits}::UHUGEINT) % {_M} + ({a}) // {1 << (64 - bits)}::UHUGEINT)"


def _number(pos: str, size: int) -> str:
    """The little-endian number of `size` bytes at byte `pos` (from 0) of the hex text `h`."""
    pairs = " || ".join(f"substr(h, 2 * ({pos} + {i}) + 1, 2)" for i in reversed(range(size)))
    return f"CAST(CAST('0x' || {pairs} AS UBIGINT) AS UHUGEINT)"


def xxh64(keys: str) -> str:
    """CTE `xxh(key, id)`: XXH64 with seed 0 of the distinct `key` column of a query, in whole numbers.

    `stripes` walks 32 bytes a step in four lanes, `tail` the rest by 8, 4 or 1 bytes.
    """
    lane = ", ".join(f"{_mul(_rotated(f's{i}', 31), _P1)} AS v{i}" for i in range(4))
    taken = ", ".join(f"{_add(f'v{i}', '(' + _mul(_number(f'pos + {8 * i}', 8), _P2) + ')')} AS s{i}" for i in range(4))
    joined = f"({' + '.join(_rotated(f'v{i}', r) for i, r in enumerate((1, 7, 12, 18)))}) % {_M}"
    steps = []
    for i in range(4):
        mixed = _mul(_rotated(_mul(f"v{i}", _P2), 31), _P1)
        steps.append(f"SELECT *, {_add(_mul(f'xor(x{i}, {mixed})', _P1), _P4)} AS x{i + 1}")
    nested = f"SELECT *, {joined} AS x0 FROM stripes WHERE n - pos < 32"
    for step in steps:
        nested = f"{step} FROM ({nested})"
    eight = f"xor(x, {_mul(_rotated(_mul(_number('pos', 8), _P2), 31), _P1)})"
    four = f"xor(x, {_mul(_number('pos', 4), _P1)})"
    one = f"xor(x, {_mul(_number('pos', 1), _P5)})"
    last = "SELECT key, xor(x, x // 8589934592::UHUGEINT) AS x FROM tail WHERE pos = n"
    last = f"SELECT key, {_mul('x', _P2)} AS x FROM ({last})"
    last = f"SELECT key, {_mul('xor(x, x // 536870912::UHUGEINT)', _P3)} AS x FROM ({last})"
    return f"""stripes AS (
    SELECT key, hex(encode(key)) AS h, strlen(key) AS n, 0 AS pos, {_P1 + _P2 - (1 << 64)}::UHUGEINT AS v0, {_P2}::UHUGEINT AS v1, 0::UHUGEINT AS v2, {(1 << 64) - _P1}::UHUGEINT AS v3
    FROM (SELECT DISTINCT key FROM ({keys}))
    UNION ALL
    SELECT key, h, n, pos + 32 AS pos, {lane} FROM (SELECT key, h, n, pos, {taken} FROM stripes WHERE n - pos >= 32)),
tail AS (
    SELECT key, h, n, pos, {_add(f"CASE WHEN n >= 32 THEN x4 ELSE {_P5}::UHUGEINT END", 'n')} AS x FROM ({nested})
    UNION ALL
    SELECT key, h, n, pos + step AS pos,
           CASE step WHEN 8 THEN {_add(_mul(_rotated('y', 27), _P1), _P4)} WHEN 4 THEN {_add(_mul(_rotated('y', 23), _P2), _P3)} ELSE {_mul(_rotated('y', 11), _P1)} END AS x
    FROM (SELECT *, CASE step WHEN 8 THEN {eight} WHEN 4 THEN {four} ELSE {one} END AS y
          FROM (SELECT *, CASE WHEN n - pos >= 8 THEN 8 WHEN n - pos >= 4 THEN 4 ELSE 1 END AS step FROM tail WHERE pos < n))),
xxh AS (SELECT key, lower(lpad(to_hex(CAST(xor(x, x // 4294967296::UHUGEINT) AS UBIGINT)), 16, '0')) AS id FROM ({last}))"""


SQL["normalize_url"] = f"SELECT page_id, {normalized('url')} AS url FROM pages"
SQL["url_host"] = f"""SELECT page_id, {host('url')} AS host,
       lower(split_part(list_extract(string_split(url, '://'), -1), '/', 1)) AS bare_host FROM pages"""
SQL["path_tokens"] = f"SELECT page_id, {path_words('url')} AS tokens FROM pages"
SQL["stable_id_md5"] = f"SELECT page_id, md5('crawl|' || {normalized('url')}) AS id FROM pages"
SQL["stable_id_xxh64"] = f"""WITH RECURSIVE keyed AS (SELECT page_id, 'crawl|' || {normalized('url')} AS key FROM pages), {xxh64("SELECT key FROM keyed")}
SELECT page_id, id FROM keyed JOIN xxh USING (key)"""
RAW = f"""urls AS (SELECT page_id, html, {normalized('url')} AS url FROM pages),
{xxh64("SELECT 'crawl|' || url AS key FROM urls")},
raw AS (
    SELECT xxh.id, 'crawl' AS source, url, concat('page ', page_id) AS title, '' AS body,
           CASE WHEN page_id % 3 = 0 THEN {V.AS_OF_MS} ELSE 1700000000000 + page_id END AS published_ts,
           CAST({V.AS_OF_MS} AS BIGINT) AS ingested_ts, page_id, html
    FROM urls JOIN xxh ON xxh.key = 'crawl|' || url)"""
SQL["ingest_raw"] = f"WITH RECURSIVE {RAW} SELECT * EXCLUDE (page_id, html) FROM raw"


def feed_rows(where: str = "TRUE") -> str:
    link = "concat('https://example.com/d/', md5(text))"
    return f"""SELECT source, text AS title, {link} AS link, CAST({V.AS_OF_MS} AS BIGINT) AS published_ts FROM documents WHERE {where} AND text <> ''
UNION ALL
SELECT source, source AS title, {link} || '/b' AS link, CAST({V.AS_OF_MS} AS BIGINT) AS published_ts FROM documents WHERE {where} AND doc_id % 5 <> 0"""


SQL["feed_items_rss"] = feed_rows()
SQL["feed_items_atom"] = feed_rows()
SQL["feed_items"] = feed_rows("lang IN ('en', 'fr', 'de')")
_POLLED = f"""polled AS (
    SELECT source, title, link, {V.AS_OF_MS} + doc_id * 3600000 AS polled_at FROM (
        SELECT doc_id, source, text AS title, concat('https://example.com/d/', md5(text)) AS link FROM documents
        WHERE lang IN ('en', 'fr', 'de') AND text <> ''
        UNION ALL
        SELECT doc_id, source, source AS title, concat('https://example.com/d/', md5(text), '/b') AS link FROM documents
        WHERE lang IN ('en', 'fr', 'de') AND doc_id % 5 <> 0))"""
SQL["ingest_batch"] = f"""WITH RECURSIVE {_POLLED}, walk AS (
    SELECT source, link, min(polled_at) AS polled_at FROM polled GROUP BY source, link
    UNION ALL
    SELECT w.source, w.link, min(p.polled_at) AS polled_at FROM walk w JOIN polled p
        ON p.source = w.source AND p.link = w.link AND p.polled_at >= w.polled_at + 172800000
    GROUP BY w.source, w.link)
SELECT md5(concat(source, '|', link)) AS id, source, link AS url, min(title) AS title, '' AS body, polled_at AS published_ts, polled_at AS ingested_ts
FROM polled JOIN walk USING (source, link, polled_at) GROUP BY source, link, polled_at"""
SQL["expand_feeds"] = """SELECT DISTINCT source, concat('https://feeds.example.com/', source) AS url FROM documents
UNION ALL
SELECT concat('PerTicker:', n_name) AS source, concat('https://example.com/rss?s=', n_name, '&again=', n_name) AS url FROM nation"""
SQL["fetch_ok"] = "SELECT page_id, url, CAST(200 AS INTEGER) AS status FROM pages WHERE NOT contains(url, '#')"
SQL["robots_filter"] = f"""SELECT page_id, url FROM pages
WHERE ends_with({host('url')}, '.net') OR ends_with({host('url')}, '.com')"""
_ANCHOR = """'<a href="([^"]*)">([^<]*)</a>'"""
LINKS = f"""anchors AS (
    SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, {_ANCHOR}, 1)) AS href,
           unnest(regexp_extract_all(html, {_ANCHOR}, 2)) AS label,
           unnest(range(len(regexp_extract_all(html, {_ANCHOR}, 1)))) AS spot FROM pages),
clean_anchors AS (SELECT page_id, page_url, {decoded('href')} AS link, {trimmed(decoded('label'))} AS title, spot FROM anchors)"""


def links(direction: str, n: int) -> str:
    return f"""{LINKS},
firsts AS (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY spot {direction}) AS nth
           FROM clean_anchors WHERE contains(link, '/')),
links AS (SELECT * FROM (
    SELECT page_id, page_url, title, link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY spot {direction}) - 1 AS INTEGER) AS pos
    FROM firsts WHERE nth = 1 AND title <> '') WHERE pos < {n})"""


SQL["extract_links"] = f"WITH {links('ASC', 5)} SELECT page_id, title, link, pos FROM links"
SQL["extract_links_reverse"] = f"WITH {links('DESC', 5)} SELECT page_id, title, link, pos FROM links"
SQL["extract_links_of_site"] = f"""WITH marked AS (
    SELECT page_id, replace(replace(replace(html, '<a href="/t', '<a href="//example.com/News/t'), '<a href="/d', '<a href="https://EXAMPLE.com/news/d'), '<a href="/e', '<a href="http://example.com/sport/e') AS html FROM pages),
anchors AS (
    SELECT page_id, unnest(regexp_extract_all(html, {_ANCHOR}, 1)) AS href, unnest(regexp_extract_all(html, {_ANCHOR}, 2)) AS label,
           unnest(range(len(regexp_extract_all(html, {_ANCHOR}, 1)))) AS spot FROM marked),
absolute AS (SELECT page_id, CASE WHEN starts_with(href, '//example.com') THEN 'https:' || {decoded('href')} ELSE {decoded('href')} END AS link, {trimmed(decoded('label'))} AS title, spot FROM anchors),
firsts AS (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY spot) AS nth FROM absolute WHERE contains(lower(link), 'example.com') AND contains(lower(link), '/news/'))
SELECT * FROM (SELECT page_id, title, link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY spot) - 1 AS INTEGER) AS pos FROM firsts WHERE nth = 1 AND title <> '') WHERE pos < 30"""
SQL["ingest_listing"] = f"""WITH {links('ASC', 30)},
found AS (SELECT concat('listing:', page_id) AS source, {normalized('link')} AS url, title FROM links
          WHERE NOT contains(page_url, '#') AND NOT ends_with({host('page_url')}, '.org'))
SELECT md5(concat(source, '|', url)) AS id, source, url, min(title) AS title, '' AS body,
       CAST({V.AS_OF_MS} AS BIGINT) AS published_ts, CAST({V.AS_OF_MS} AS BIGINT) AS ingested_ts
FROM found GROUP BY source, url"""

# --- cleaning ------------------------------------------------------------------------------------

SQL["extract_title"] = f"SELECT page_id, {page_title('html')} AS title FROM pages"
SQL["main_text"] = f"SELECT page_id, {page_body('html')} AS body FROM pages"
SQL["main_text_sibling_tail"] = f"""SELECT page_id,
       {trimmed(decoded("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)"))} AS body FROM pages"""
SQL["strip_nontext"] = """SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<style>.*?</style>', '', 'g'),
       '(?s)<script>.*?</script>', '', 'g') AS html FROM pages"""
CLEAN = f"""{RAW}, fresh AS (
    SELECT id, source, url, min(title) AS title, arg_min(published_ts, title) AS published_ts, arg_min(html, page_id) AS html
    FROM raw GROUP BY id, source, url),
texts AS (
    SELECT id, source, url, CASE WHEN page_title <> '' THEN page_title ELSE title END AS title, body, published_ts
    FROM (SELECT *, {page_title('html')} AS page_title, {page_body('html')} AS body FROM fresh)),
clean AS (
    SELECT *, {hints('url', 'body')} AS hints, 'en' AS language
    FROM texts WHERE {language('body')} = 'en' AND strlen(body) >= 200)"""
SQL["clean_articles"] = f"WITH RECURSIVE {CLEAN} SELECT * FROM clean"
SQL["detect_language"] = f"SELECT doc_id, {language('text')} AS language FROM documents"
SQL["filter_clean"] = f"""SELECT doc_id, CAST(strlen(text) AS INTEGER) AS n_bytes FROM documents
WHERE {language('text')} = 'en' AND strlen(text) >= 200"""

# --- enrichment ----------------------------------------------------------------------------------

WHOLE = "lower(title || chr(10) || body)"
SQL["article_hints"] = f"WITH {DOCS} SELECT id, {hints('url', 'body')} AS hints FROM docs"
_BOTH = "(title || ' ' || body)"
SQL["cashtags"] = f"WITH {DOCS} SELECT id, list_sort({cashtags(_BOTH)}) AS cashtags FROM docs"
SQL["topic_rules"] = f"WITH {DOCS}, low AS (SELECT id, {WHOLE} AS t FROM docs) SELECT id, {topics('t')} AS topics FROM low"
SQL["merge_topics"] = f"""WITH {DOCS}, low AS (SELECT id, {WHOLE} AS t, lower({model_text('title', 'body')}) AS m FROM docs)
SELECT id, list_sort(list_distinct(list_concat({topics('t')}, {topics('m')}, ['news']))) AS topics FROM low"""
SQL["topics_pipe"] = f"""WITH {DOCS}, low AS (SELECT id, {WHOLE} AS t FROM docs), found AS (SELECT id, {topics('t')} AS topics FROM low)
SELECT id, array_to_string(topics, '|') AS piped, topics AS split FROM found"""
SQL["ticker_file"] = """SELECT n_name AS symbol, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE named || ', Inc' END AS name,
       CASE WHEN n_nationkey % 5 = 0 THEN [named, region, region] ELSE [named || ', Inc', named, region] END AS aliases, CAST(n_nationkey AS INTEGER) AS ord
FROM (SELECT *, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS named, concat('Region ', n_regionkey) AS region FROM nation)"""
SQL["score_tickers"] = f"WITH {DOCS}, {scores('docs')} SELECT id, symbol, score FROM scores WHERE score > 0"
SQL["resolve_tickers"] = f"""WITH {DOCS}, {scores('docs')}
SELECT docs.id, coalesce(tickers, {EMPTY}) AS tickers FROM docs LEFT JOIN best ON best.id = docs.id"""
SQL["resolve_tickers_joined"] = SQL["resolve_tickers"]


def _letters(number: str) -> str:
    return f"translate(to_hex({number}), '0123456789ABCDEF', 'ETAOINSHRDLUCMFW')"


_LARGE = f"""dictionary AS (
    SELECT symbol, min(ord) AS ord, arg_max(names, ord) AS names FROM (
        SELECT c_custkey AS ord, {_letters('c_custkey')} AS symbol, [lower(trim(c_name))] AS names FROM customer
        UNION ALL
        SELECT 1000000000 + doc_id, 'Z' || {_letters('doc_id')}, list_filter([lower(trim(substr(text, 1, 12)))], lambda n: n <> '') FROM documents)
    GROUP BY symbol)"""
SQL["resolve_tickers_large"] = f"""WITH {DOCS}, titled AS (SELECT * REPLACE (body AS title) FROM docs), {scores('titled', dictionary=_LARGE)}
SELECT docs.id, coalesce(tickers, {EMPTY}) AS tickers FROM docs LEFT JOIN best ON best.id = docs.id"""
_TEXT = entity_text("title", "body")
SQL["fuzzy_match"] = f"""WITH RECURSIVE {DOCS}, mentions AS (SELECT id, unnest({runs(_TEXT)}) AS mention FROM docs),
{matches("SELECT mention FROM mentions")}
SELECT id, mention, alias, round(score, 6) AS score, symbol FROM mentions JOIN matches USING (mention)"""
SQL["enrich_entities"] = f"""WITH RECURSIVE {DOCS}, {entities('docs', names=True)}, {scores('docs', True)}, low AS (SELECT id, {WHOLE} AS t FROM docs)
SELECT id, entities, coalesce(tickers, {EMPTY}) AS tickers, {topics('t')} AS topics
FROM low JOIN entities USING (id) LEFT JOIN best USING (id)"""
_OWNERS = ", ".join(
    f"({i}, {_text(symbol)}, {_text(alias)})"
    for i, (symbol, name, aliases) in enumerate(V.TICKER_ROWS)
    for alias in dict.fromkeys([name, *aliases.split(";")])
)
SQL["alias_owner"] = f"""WITH {DOCS}, names(ord, symbol, alias) AS (VALUES {_OWNERS}),
owners AS (SELECT alias, arg_min(symbol, ord) AS symbol FROM names GROUP BY alias)
SELECT alias, count(*) AS n, symbol FROM owners JOIN docs ON contains(body, alias) GROUP BY alias, symbol"""

# --- scoring -------------------------------------------------------------------------------------

_E = "exp(CAST(embedding[{}] AS DOUBLE))"
_E1, _E2, _E3 = _E.format(1), _E.format(2), _E.format(3)
SQL["softmax_sentiment"] = f"""SELECT vec_id, round(({_E3} - {_E1}) / ({_E1} + {_E2} + {_E3}), 6) AS sentiment,
       round(greatest({_E1}, {_E2}, {_E3}) / ({_E1} + {_E2} + {_E3}), 6) AS confidence,
       round({_E2} / ({_E1} + {_E2} + {_E3}), 6) AS p_neutral FROM embeddings"""
_S, _C = judged("m")
SQL["score_lexicon"] = f"""WITH {DOCS}, seen AS (SELECT id, {model_text('title', 'body')} AS m FROM docs)
SELECT id, {_S} AS sentiment, {_C} AS confidence, {topics('lower(m)')} AS topics FROM seen"""


_WEIGHT = "CAST((b * {} * 40503) % 129 - 64 AS DOUBLE) / 64"
_W1, _W2, _W3 = _WEIGHT.format(1), _WEIGHT.format(2), _WEIGHT.format(3)
SQL["score_hashed"] = f"""WITH {DOCS}, seen AS (SELECT id, regexp_extract_all({model_text('title', 'body')}, '[A-Za-z]+') AS words FROM docs),
buckets AS (SELECT id, CAST('0x' || substr(md5(lower(w)), 1, 7) AS BIGINT) % 1024 AS b FROM (SELECT id, unnest(words) AS w FROM seen)),
logits AS (
    SELECT id, coalesce(sum({_W1}) / count(b), 0) AS neu, coalesce(sum({_W2}) / count(b), 0) AS pos, coalesce(sum({_W3}) / count(b), 0) AS neg
    FROM seen LEFT JOIN buckets USING (id) GROUP BY id),
shares AS (SELECT id, exp(neu) / (exp(neu) + exp(pos) + exp(neg)) AS neu, exp(pos) / (exp(neu) + exp(pos) + exp(neg)) AS pos, exp(neg) / (exp(neu) + exp(pos) + exp(neg)) AS neg FROM logits)
SELECT id, round(CAST(CAST(pos - neg AS FLOAT) AS DOUBLE), 5) AS sentiment, round(CAST(CAST(greatest(neu, pos, neg) AS FLOAT) AS DOUBLE), 5) AS confidence, {EMPTY} AS topics
FROM shares"""


def scored_rows(articles: str) -> str:
    return f"""seen AS (SELECT *, {WHOLE} AS t, {model_text('title', 'body')} AS m FROM {articles})
SELECT seen.id, source, url, title, coalesce(tickers, {EMPTY}) AS tickers, {_S} AS sentiment, {_C} AS confidence,
       list_sort(list_distinct(list_concat({topics('t')}, {topics('lower(m)')}))) AS topics,
       CAST({V.AS_OF_MS} AS BIGINT) AS scored_ts
FROM seen LEFT JOIN best ON best.id = seen.id"""


SQL["enrich_score"] = f"WITH RECURSIVE {DOCS}, {entities('docs')}, {scores('docs', True)}, {scored_rows('docs')}"
SQL["scored_pages"] = f"WITH RECURSIVE {CLEAN}, {entities('clean')}, {scores('clean', True)}, {scored_rows('clean')}"
SQL["zip_scores"] = f"""WITH {SCORED}
SELECT id, CAST(pos AS INTEGER) AS pos, topics[pos + 1] AS topic, tickers[pos + 1] AS ticker
FROM (SELECT *, unnest(range(least(len(topics), len(tickers)))) AS pos FROM scored)"""

# --- messages and sinks --------------------------------------------------------------------------

SQL["scored_json_roundtrip"] = f"""WITH {SCORED}
SELECT date_trunc('millisecond', ts) AS ts, id, source, url, title, tickers, {SENT} AS sentiment, topics, CAST(ts AS DATE) AS date FROM scored"""
SQL["archive_record"] = f"""WITH {SCORED}
SELECT id, source, url, title, tickers, {SENT} AS sentiment, topics, scored_ts FROM scored"""
# What each kind of odd message holds, by hand: (kind, id, source, url, title, tickers, sentiment, topics, scored_ts); the other kinds are skipped.
_ODD = """odd AS (SELECT event_id, event_id % 12 AS kind, CAST(event_id AS VARCHAR) AS n FROM events),
held AS (
    SELECT n AS id, NULL AS source, NULL AS url, NULL AS title, ['A', 'B'] AS tickers, 0.5 AS sentiment, CAST([] AS VARCHAR[]) AS topics, event_id AS scored_ts FROM odd WHERE kind = 0
    UNION ALL SELECT n, NULL, NULL, NULL, [], 0.0, [], 0 FROM odd WHERE kind = 4
    UNION ALL SELECT NULL, NULL, NULL, NULL, [], 0.0, [], 0 FROM odd WHERE kind = 5
    UNION ALL SELECT NULL, NULL, NULL, 't' || n, [], 0.0, [], 0 FROM odd WHERE kind = 6
    UNION ALL SELECT NULL, NULL, 'u' || n, NULL, [], 0.0, [], 0 FROM odd WHERE kind = 9
    UNION ALL SELECT NULL, 's' || n, NULL, NULL, ['C'], 0.0, ['x', 'y'], 0 FROM odd WHERE kind = 10)"""
SQL["odd_payloads_record"] = f"WITH {_ODD} SELECT id, source, url, title, tickers, CAST(sentiment AS DOUBLE) AS sentiment, topics, CAST(scored_ts AS BIGINT) AS scored_ts FROM held"
SQL["odd_payloads_table"] = f"""WITH {_ODD} SELECT CAST(epoch_ms(CAST(scored_ts AS BIGINT)) AS TIMESTAMP) AS ts, coalesce(id, '') AS id, coalesce(source, '') AS source, coalesce(url, '') AS url,
    coalesce(title, '') AS title, tickers, CAST(sentiment AS DOUBLE) AS sentiment, topics, CAST(epoch_ms(CAST(scored_ts AS BIGINT)) AS DATE) AS date FROM held"""
SQL["odd_payloads_feed"] = """WITH odd AS (SELECT event_id % 12 AS kind, CAST(event_id AS VARCHAR) AS n FROM events)
SELECT '{"id":"' || n || '","tickers":["A","B"],"sentiment":0.5,"scored_ts":' || n || '}' AS payload, n AS id, ['A', 'B'] AS tickers FROM odd WHERE kind = 0
UNION ALL SELECT '{"id":null,"url":"u' || n || '","extra":{"a":1},"tickers":[],"scored_ts":1.5}', NULL, [] FROM odd WHERE kind = 9
UNION ALL SELECT '{"source":"s' || n || '","tickers":["C"],"topics":["x","y"]}', NULL, ['C'] FROM odd WHERE kind = 10"""
SQL["hourly_archive"] = f"""WITH {SCORED}
SELECT id, source, url, title, tickers, {SENT} AS sentiment, topics, scored_ts,
       strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, strftime(ts, '%H') AS hour FROM scored"""
SQL["daily_table"] = SQL["scored_json_roundtrip"]

# --- streams -------------------------------------------------------------------------------------

SQL["stream_dedup"] = """SELECT arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts, key
FROM (SELECT event_id, ts, concat(user_id, '/', event_type) AS key FROM events) GROUP BY key"""
SQL["stream_dedup_event_time"] = """WITH RECURSIVE walk AS (
    SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY user_id, event_type
    UNION ALL
    SELECT w.user_id, w.event_type, min(e.ts) AS ts
    FROM walk w JOIN events e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.ts >= w.ts + INTERVAL 48 HOUR
    GROUP BY w.user_id, w.event_type)
SELECT min(e.event_id) AS event_id, e.ts, concat(e.user_id, '/', e.event_type) AS key
FROM events e JOIN walk w ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.ts = w.ts
GROUP BY e.ts, e.user_id, e.event_type"""
SQL["stream_minute_counts"] = "SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1"
# Windows of an hour that slide by a minute, closed by a watermark ten minutes behind the newest event.
_ENDS = "unnest([date_trunc('minute', ts) + to_minutes(i + 1) for i in range(60)]) AS window_end"
_CLOSED = "window_end <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE"
SQL["stream_ticker_sentiment"] = f"""WITH {SCORED},
exploded AS (SELECT ts, unnest(tickers) AS ticker, CAST(sentiment AS DOUBLE) AS sentiment FROM scored),
panes AS (SELECT date_trunc('minute', ts) AS ts, ticker, sum(sentiment) AS total, count(*) AS n FROM exploded GROUP BY 1, 2),
windows AS (SELECT {_ENDS}, ticker, total, n FROM panes)
SELECT window_end, ticker, round(sum(total) / sum(n), 6) AS avg_sent, CAST(sum(n) AS BIGINT) AS n FROM windows WHERE {_CLOSED} GROUP BY window_end, ticker"""
SQL["stream_topic_counts"] = f"""WITH {SCORED},
panes AS (SELECT date_trunc('minute', ts) AS ts, label, count(*) AS n FROM (SELECT ts, unnest(topics) AS label FROM scored) GROUP BY 1, 2),
windows AS (SELECT {_ENDS}, label, n FROM panes)
SELECT window_end, label, CAST(sum(n) AS BIGINT) AS n FROM windows WHERE {_CLOSED} GROUP BY window_end, label"""
SQL["stream_ticker_feed"] = f"""WITH {SCORED},
exploded AS (SELECT unnest(CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN list_append(tickers, 'HOT') ELSE tickers END) AS ticker, scored_ts, lpad(id, 12, '0') AS payload FROM scored)
SELECT * FROM (
    SELECT ticker, CAST(row_number() OVER (PARTITION BY ticker ORDER BY scored_ts DESC, payload DESC) AS INTEGER) AS rank, scored_ts, payload
    FROM exploded) WHERE rank <= 50"""
SQL["stream_scored_ingest"] = SQL["daily_table"]
SQL["stream_archive"] = SQL["hourly_archive"]
SQL["stream_articles"] = SQL["scored_pages"]
