"""SQL twins of the queries that go through readers and sinks."""

EVENTS = """e AS (SELECT event_id AS n, event_id // 100 AS board, epoch(date_trunc('second', ts))::BIGINT AS time, event_id % 17 = 0 AS bare, event_id % 13 = 0 AS odd,
    event_id % 19 = 0 AS many, event_id % 23 = 0 AS flag,
    dense_rank() OVER (PARTITION BY event_id // 100 ORDER BY event_id // 10) - 1 AS page,
    row_number() OVER (PARTITION BY event_id // 10 ORDER BY event_id) - 1 AS pos FROM events)"""
FOUND = """l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS part, sum(l_quantity)::BIGINT AS value,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS pos FROM lineitem GROUP BY l_orderkey, l_linenumber),
i AS (SELECT *, n = 3 AND o % 5 = 0 AS gone, n = 2 AND o % 7 = 0 AS bare, o % 11 = 0 AS odd FROM l),
j AS (SELECT *, CASE WHEN gone THEN 'gone' ELSE '{"itemId":"' || o || '-' || n || '","title":"part ' || part || '","price":' ||
    CASE WHEN bare THEN value::VARCHAR ELSE '{"value":"' || value || '","currency":"USD"}' END || '}' END AS json FROM i)"""
DAYS = """d AS (SELECT o_orderdate::DATE AS day, count(*) % 90 + 10 AS n, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS k
    FROM orders GROUP BY ALL)"""

SQL = {
    "catalog_threads": f"""WITH {EVENTS}
SELECT 'b' || board AS board, n AS no, time, CASE WHEN NOT many THEN n % 7 END::INT AS images,
  concat_ws(',', CASE WHEN many THEN 'images' END, CASE WHEN flag THEN 'flag' END) AS rescued
FROM e WHERE board % 10 <> 3 AND NOT bare AND NOT odd""",
    "catalog_problems": f"""WITH {EVENTS},
t AS (SELECT *, CASE WHEN bare THEN 'unreadable' WHEN odd AND many THEN 'wrong type: no, images' WHEN odd THEN 'wrong type: no'
    WHEN many THEN 'wrong type: images' END AS problem,
  CASE WHEN bare THEN n::VARCHAR ELSE '{{"no":' || CASE WHEN odd THEN '"n' || n || '"' ELSE n::VARCHAR END || ',"time":' || time ||
    ',"images":' || CASE WHEN many THEN '"many"' ELSE (n % 7)::VARCHAR END || CASE WHEN flag THEN ',"flag":"pinned"' ELSE '' END || '}}' END AS json FROM e)
SELECT 'catalog' AS input, page || '/' || pos AS place, problem, NOT bare AND NOT odd AS kept, length(json) AS chars
FROM t WHERE board % 10 <> 3 AND problem IS NOT NULL
UNION ALL SELECT 'catalog', '', 'unreadable', false, 60 FROM t WHERE board % 10 = 3 GROUP BY board""",
    "search_listings": f"""WITH {FOUND}
SELECT 'order ' || o AS title, 'US' AS site, o || '-' || n AS item_id, 'part ' || part AS text, CASE WHEN NOT bare THEN value::VARCHAR END AS value,
  CASE WHEN NOT bare THEN 'USD' END AS currency FROM j WHERE NOT odd AND NOT gone""",
    "search_problems": f"""WITH {FOUND}
SELECT 'search' AS input, pos::VARCHAR AS place, CASE WHEN gone THEN 'unreadable' ELSE 'wrong type: price' END AS problem, NOT gone AS kept,
  length(json) AS chars FROM j WHERE NOT odd AND (gone OR bare)
UNION ALL SELECT 'search', '', 'wrong type: query', false,
  length('{{"title":"order ' || o || '","site":"US","query":"first","itemSummaries":[]}}') + (sum(length(json) + CASE WHEN gone THEN 2 ELSE 0 END))::BIGINT + count(*) - 1
FROM j WHERE odd GROUP BY o""",
    "fx_rates": f"""WITH {DAYS}
SELECT day::VARCHAR AS day, currency, ('1.' || n)::DOUBLE AS per_eur FROM d, (VALUES ('USD'), ('GBP'), ('PLN'), ('CHF')) c(currency)
WHERE k % 23 <> 0 AND k % 19 <> 0 AND k % 13 <> 0 AND k % 17 <> 0""",
    "fx_problems": f"""WITH {DAYS},
t AS (SELECT *, CASE WHEN k % 23 = 0 THEN 'unreadable' WHEN k % 19 = 0 THEN 'no date' WHEN k % 13 = 0 AND k % 17 = 0 THEN 'rates: GBP, CHF'
    WHEN k % 13 = 0 THEN 'rates: GBP' WHEN k % 17 = 0 THEN 'rates: CHF' END AS problem,
  '<Envelope><Cube><Cube time="' || CASE WHEN k % 19 = 0 THEN 'soon' ELSE day::VARCHAR END || '"><Cube currency="USD" rate="1.' || n ||
    '"/><Cube currency="GBP" rate="' || CASE WHEN k % 13 = 0 THEN 'n/a' ELSE '1.' || n END || '"/><Cube currency="PLN" rate="1.' || n || '"/>' ||
    CASE WHEN k % 17 = 0 THEN '' ELSE '<Cube currency="CHF" rate="1.' || n || '"/>' END ||
    '<Cube currency="JPY" rate="170"/></Cube></Cube></Envelope>' AS line FROM d)
SELECT 'rates' AS input, '' AS place, problem, false AS kept, CASE WHEN k % 23 = 0 THEN 70 ELSE length(line) END AS chars FROM t WHERE problem IS NOT NULL""",
    "entry_items": """WITH e AS (SELECT event_id AS n, ts, value, user_id, CASE event_type WHEN 'error' THEN 'news' WHEN 'click' THEN 'reddit'
    WHEN 'view' THEN 'youtube' WHEN 'signup' THEN 'forum' ELSE 'podcast' END AS kind,
    CASE WHEN event_id % 5 <> 0 THEN CASE WHEN event_id % 7 = 0 THEN 'https://reddit.com/' || event_id
      ELSE 'https://web/' || (event_id % 50) END END AS link FROM events),
s AS (SELECT *, count(*) FILTER (kind = 'podcast') OVER (PARTITION BY user_id, link) > 1 AS shared FROM e)
SELECT 'note ' || n AS headline, CASE kind WHEN 'youtube' THEN 'YouTube: user ' || user_id WHEN 'podcast' THEN 'Podcast: user ' || user_id
    WHEN 'forum' THEN 'Forum: user ' || user_id ELSE CASE WHEN link LIKE '%reddit.com%' THEN 'r/sub' || (n % 9) ELSE 'Feed ' || user_id END END AS source,
  kind AS source_type, CASE kind WHEN 'forum' THEN CASE WHEN n % 2 = 0 THEN 'https://talk/' || n ELSE coalesce(link, '#') END
    WHEN 'podcast' THEN CASE WHEN link IS NOT NULL AND NOT shared THEN link WHEN n % 3 = 0 THEN 'https://audio/' || n ELSE coalesce(link, '#') END
    ELSE coalesce(link, '#') END AS link,
  CASE WHEN kind = 'youtube' AND floor(value - 5) >= 0 THEN floor(value - 5)::BIGINT END AS views,
  CASE WHEN n % 4 <> 0 OR n % 8 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts
FROM s WHERE n % 11 <> 0""",
    "imported_history": """SELECT 'title ' || l_partkey AS title, count(*) AS checks, sum(l_quantity::INT)::BIGINT AS copies,
  count(*) FILTER (l_linenumber <> 2) AS with_lowest, round(sum(l_discount), 6) AS medians
FROM lineitem WHERE l_linenumber <> 3 GROUP BY l_partkey""",
    "pairs_to_search": """WITH r AS (SELECT p_name AS name, split_part(p_name, ' ', 1) || ' widget' AS renamed FROM part
  GROUP BY p_name HAVING max(p_size) > 40),
t AS (SELECT renamed AS name FROM r WHERE renamed <> name EXCEPT SELECT name FROM r WHERE renamed <> name)
SELECT DISTINCT p_name AS name, site FROM part, (VALUES ('UK'), ('US')) s(site)
WHERE NOT (site = 'UK' AND p_name IN (SELECT name FROM t))""",
    "pinned_targets": """WITH p AS (SELECT p_brand AS key, CASE WHEN max(p_size) >= 50 THEN min(p_type) END AS words,
    arg_min(p_name, p_partkey) AS search FROM part GROUP BY p_brand),
w AS (SELECT words, min(key) AS key FROM p WHERE words IS NOT NULL GROUP BY words),
s AS (SELECT search, min(key) AS key FROM p GROUP BY search),
m AS (SELECT DISTINCT p_type AS key, p_name AS name FROM part)
SELECT DISTINCT m.key, coalesce(w.key, s.key, m.key) AS target FROM m LEFT JOIN w ON w.words = m.key LEFT JOIN s ON s.search = m.name""",
    "run_changes": """WITH l AS (SELECT l_partkey::VARCHAR AS title, l_suppkey::VARCHAR AS site, l_shipdate, floor(l_quantity / 10)::BIGINT AS copies,
    floor(l_discount * 20)::DOUBLE AS median, row_number() OVER w AS first, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS n
  FROM lineitem WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber))
SELECT b.title, b.site, strftime(b.l_shipdate, '%Y-%m-%d') AS day, b.copies, b.median FROM l b JOIN l a USING (title, site)
WHERE a.first = 1 AND b.first = b.n
  AND NOT (a.copies = b.copies AND a.median = b.median AND CAST(a.l_shipdate AS DATE) = CAST(b.l_shipdate AS DATE))""",
    "number_titles": r"""SELECT doc_id, title FROM documents, (VALUES ('555'), ('13'), ('7'), ('2')) n(title)
WHERE regexp_matches(text, '(?:^|[^\p{L}\p{N}\p{M}_.])' || title || '(?:$|[^\p{L}\p{N}\p{M}_.]|\.(?:$|[^0-9]))')""",
    "kept_history": """SELECT strftime(ts, '%Y-%m') AS month, event_type AS title, count(*) AS rows, round(sum(value), 4) AS value
FROM events GROUP BY ALL""",
    "left_out_titles": """SELECT DISTINCT p_name AS title FROM part WHERE p_size BETWEEN 1 AND 3 OR p_size BETWEEN 40 AND 42""",
}
