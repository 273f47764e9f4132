"""SQL twins of the mention, demand, level, archive and snapshot queries."""

from oracle import prices

KIND = """CASE event_type WHEN 'error' THEN 'news' WHEN 'click' THEN 'reddit' WHEN 'view' THEN 'youtube'
  WHEN 'signup' THEN 'forum' ELSE 'podcast' END"""
ITEMS = f"""items AS (
  SELECT event_id, ts, value, user_id, {KIND} AS source_type, {KIND} || ':' || user_id AS feed,
    'user ' || user_id AS source, 'note ' || k || ' of ' || event_type AS headline,
    'https://feeds.example/' || {KIND} || '/' || k || '/' || strftime(ts, '%Y-%m-%d') AS link,
    CASE WHEN value >= 2 THEN 'title ' || k END AS title, event_type = 'signup' AS in_body,
    event_type = 'error' AS fuzzy, value >= 20 AS remaster, value < 1 AS digital,
    CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) END AS views
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events))"""
NOW = "(SELECT max(ts) FROM events)"
NAMED = ITEMS + ", named AS (SELECT * FROM items WHERE title IS NOT NULL)"

STATS = NAMED + f""", stats AS (
  SELECT title, count(*) AS mentions, count(*) FILTER (ts >= {NOW} - INTERVAL 3 DAY) AS recent,
    count(*) FILTER (ts < {NOW} - INTERVAL 3 DAY) AS prior, count(*) FILTER (ts >= {NOW} - INTERVAL 1 DAY) AS last_day,
    count(DISTINCT feed) AS sources, CAST(coalesce(sum(views), 0) AS BIGINT) AS views, count(views) AS videos
  FROM named WHERE ts >= {NOW} - INTERVAL 14 DAY AND ts <= {NOW} + INTERVAL 1 HOUR GROUP BY title)"""

TREND = """pv AS (
  SELECT 'title ' || json_extract_string(props, '$.k') AS article, CAST(ts AS DATE) AS day,
    CAST(sum(floor(value)) AS BIGINT) AS views FROM events GROUP BY ALL),
pr AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY day DESC) AS rn FROM pv),
pt AS (SELECT article, count(*) FILTER (rn <= 14) AS n, CAST(sum(views) FILTER (rn <= 7) AS BIGINT) AS recent,
    CAST(sum(views) FILTER (rn BETWEEN 8 AND 14) AS BIGINT) AS previous FROM pr GROUP BY article),
trend AS (SELECT article, recent, previous, CASE WHEN n = 14 AND previous > 0
    THEN round_even((recent - previous) / previous * 100, 1) END AS trend_pct FROM pt)"""


def levels(staple: int, quiet: int, state: str) -> str:
    return f"""WITH {NAMED}, w AS (
  SELECT *, ts > {NOW} - INTERVAL 24 HOUR AS fresh FROM named WHERE ts > {NOW} - INTERVAL 14 DAY AND ts <= {NOW}),
a AS (SELECT title, count(*) FILTER (NOT in_body) AS mentions,
    count(DISTINCT CAST(ts AS DATE)) FILTER (NOT in_body) AS days,
    count(*) FILTER (NOT in_body AND fresh) AS recent,
    count(DISTINCT source) FILTER (NOT in_body AND fresh) AS sources,
    count(DISTINCT array_to_string(list_sort(list_distinct(string_split(headline, ' '))), ' '))
      FILTER (NOT in_body AND fresh) AS stories,
    coalesce(bool_or(NOT fuzzy) FILTER (NOT in_body AND fresh), false) AS sure,
    max(ts) FILTER (NOT in_body AND fresh) AS newest FROM w GROUP BY title),
state AS ({state}),
h AS (SELECT coalesce(a.title, state.title) AS title, coalesce(mentions, 0) AS mentions, days,
    greatest(held_until, CASE WHEN mentions - recent <= {quiet} AND sources >= 2 AND stories >= 2 AND sure
      THEN newest + INTERVAL 48 HOUR END) AS hold FROM a FULL JOIN state ON a.title = state.title),
l AS (SELECT *, CASE WHEN days >= {staple} THEN 'staple' WHEN hold > {NOW} THEN 'surging'
    WHEN days IS NOT NULL THEN 'normal' ELSE 'dormant' END AS level FROM h)
SELECT title, level, mentions, CASE WHEN level = 'surging' THEN hold END AS held_until FROM l"""


ARCHIVED = NAMED + """, arch AS (
  SELECT strftime(ts, '%Y-%m') AS month, title AS g, source AS s, headline AS h, ts AS d, source_type AS t FROM named)"""
OLD = f"ts < {NOW} - INTERVAL 10 DAY"
RECENT3 = f"ts >= {NOW} - INTERVAL 3 DAY"

MERGED = ITEMS + f""", own AS (
  SELECT link, max_by(feed, turn) AS owner FROM (
    SELECT link, feed, 0 AS turn FROM items WHERE NOT ({RECENT3})
    UNION ALL SELECT link, feed, 1 FROM items WHERE {RECENT3} AND source_type <> 'forum') GROUP BY link),
owners AS (SELECT link, feed AS owner FROM (
    SELECT link, feed, row_number() OVER (PARTITION BY link ORDER BY turn DESC, feed DESC) AS rn FROM (
      SELECT link, feed, 0 AS turn FROM items WHERE NOT ({RECENT3})
      UNION ALL SELECT link, feed, 1 FROM items WHERE {RECENT3} AND source_type <> 'forum')) WHERE rn = 1),
pool AS (
  SELECT *, 0 AS turn FROM items WHERE NOT ({RECENT3})
  UNION ALL SELECT items.*, 1 FROM items LEFT JOIN owners USING (link)
    WHERE {RECENT3} AND (source_type <> 'forum' OR owner IS NULL OR owner = feed)),
merged0 AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY turn DESC, ts DESC) AS rn FROM pool),
merged AS (SELECT * FROM merged0 WHERE rn = 1 AND ts >= {NOW} - INTERVAL 14 DAY)"""

LEVEL = """CASE sum(p_size) % 5 WHEN 0 THEN 'surging' WHEN 1 THEN 'staple' WHEN 2 THEN 'normal' WHEN 3 THEN 'dormant'
  ELSE 'rare' END"""
DUE = f"""{prices.HISTORY}, clock AS (SELECT max(l_shipdate) AS now FROM lineitem),
titles AS (SELECT p_brand AS title, {LEVEL} AS level, min(p_size) = 2 AS pinned, max(p_size) >= 50 AS watch
  FROM part GROUP BY p_brand),
market AS (SELECT * FROM (VALUES ('US', false, 0), ('UK', false, 0), ('DE', true, 4320), ('FR', true, 4320),
  ('IT', true, 4320), ('ES', true, 5760)) t(site, extra, floor)),
newest AS (SELECT title, site, max(stamp) AS checked FROM lines GROUP BY ALL),
latest AS (SELECT title, site, arg_max(copies, period) AS copies, arg_max(median, period) AS median FROM hist
  GROUP BY ALL),
steady AS (SELECT title, site, count(*) >= 3 AND max(period) - min(period) >= 4 AND min(copies) >= 2
    AND (max(copies) - min(copies)) / median(copies) <= 3 AND (max(median) - min(median)) / median(median) <= 3
    AS steady
  FROM hist WHERE period BETWEEN {prices.LAST} - 6 AND {prices.LAST} GROUP BY ALL),
base AS (SELECT t.*, m.*, n.checked, l.copies, l.median, coalesce(s.steady, false) AS steady,
    CASE level WHEN 'surging' THEN 0 WHEN 'dormant' THEN 1440 WHEN 'rare' THEN 720 ELSE 1080 END AS every,
    level = 'normal' AND m.site = 'US' AS sealed,
    date_diff('second', n.checked, (SELECT now FROM clock)) / 60.0 AS waited
  FROM titles t CROSS JOIN market m LEFT JOIN newest n ON n.title = t.title AND n.site = m.site
  LEFT JOIN latest l ON l.title = t.title AND l.site = m.site
  LEFT JOIN steady s ON s.title = t.title AND s.site = m.site),
waits AS (SELECT *, greatest(
    CASE WHEN level IN ('normal', 'staple') AND NOT pinned AND checked IS NOT NULL AND steady THEN 2880 ELSE every END,
    CASE WHEN level IN ('normal', 'staple') AND NOT pinned AND copies >= 20 AND median > 0
      AND median < CASE site WHEN 'US' THEN 10 WHEN 'UK' THEN 8 END THEN 2880 END,
    CASE WHEN extra AND level = 'dormant' AND NOT pinned AND checked IS NOT NULL THEN 10080 END,
    CASE WHEN extra AND level NOT IN ('surging', 'rare') AND NOT pinned AND checked IS NOT NULL
      AND copies IN (0, 1) THEN 2880 END,
    floor) AS wait0 FROM base),
due AS (SELECT *, CASE WHEN watch AND NOT extra AND (SELECT now FROM clock) > checked THEN least(wait0, 60)
    ELSE wait0 END AS wait FROM waits)"""

SQL = {
    "mention_stats": f"WITH {STATS} SELECT * FROM stats",
    "top_titles": f"""WITH {NAMED}, c AS (SELECT title, count(*) AS mentions FROM named GROUP BY title)
SELECT title, mentions, rank() OVER (ORDER BY mentions DESC) AS rank FROM c""",
    "last_24h": f"""WITH {NAMED} SELECT title, count(*) FILTER (NOT in_body) AS headlines,
  count(*) FILTER (in_body) AS texts, count(DISTINCT source) AS sources, count(*) FILTER (remaster) AS remasters,
  max(ts) AS latest FROM named WHERE ts BETWEEN {NOW} - INTERVAL 24 HOUR AND {NOW} + INTERVAL 1 HOUR GROUP BY title""",
    "last_24h_sources": f"""WITH {NAMED}, s AS (SELECT title, source, max(ts) AS latest FROM named
  WHERE ts >= {NOW} - INTERVAL 24 HOUR GROUP BY ALL)
SELECT title, row_number() OVER (PARTITION BY title ORDER BY latest DESC, source) AS position, source FROM s""",
    "ever_named": f"WITH {NAMED} SELECT DISTINCT title AS key, title FROM named",
    "filtered_feed": f"""WITH {NAMED} SELECT event_id, feed, headline FROM named
WHERE source_type IN ('news', 'podcast') AND (headline LIKE '%7%' OR source LIKE '%7%' OR title LIKE '%7%')
  AND feed IN (SELECT feed FROM items WHERE ts >= {NOW} - INTERVAL 1 DAY)""",
    "newest_per_feed": f"WITH {ITEMS} SELECT event_id, feed FROM items WHERE trim(headline) <> ''",
    "newest_entries": f"""WITH {ITEMS}, r AS (SELECT event_id, feed, source_type, row_number() OVER (PARTITION BY feed
  ORDER BY CASE WHEN source_type IN ('news', 'reddit') THEN NULL ELSE ts END DESC NULLS LAST, event_id) AS rank
  FROM items)
SELECT event_id, feed, rank FROM r WHERE rank <= CASE source_type WHEN 'reddit' THEN 20 ELSE 10 END""",
    "source_health": f"""WITH {ITEMS}, h AS (SELECT feed, max(ts) AS latest, arg_max(value, ts) >= 3 AS ok FROM items
  GROUP BY feed)
SELECT feed, latest, ok, CASE WHEN NOT ok THEN 'Failing'
  WHEN date_diff('day', CAST(latest AS DATE), CAST({NOW} AS DATE)) <= 14 THEN 'Active' ELSE 'Quiet' END AS badge FROM h""",
    "arrival_rate": f"""WITH {ITEMS}, h AS (SELECT feed, count(*) AS entries,
  (floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 3600.0 AS hours FROM items GROUP BY feed)
SELECT feed, entries, round(hours, 6) AS hours, round(entries / greatest(hours, 1.0 / 60), 6) AS per_hour FROM h""",
    "shared_links": f"""WITH {ITEMS} SELECT feed, link, count(*) AS entries FROM items GROUP BY ALL
HAVING count(*) > 1""",
    "feed_verdict": f"""WITH {ITEMS}, h AS (SELECT feed, source_type, arg_max(value, ts) >= 3 AS ok FROM items
  WHERE source_type IN ('news', 'reddit') GROUP BY ALL), v AS (
  SELECT count(*) AS core_feeds, count(*) FILTER (NOT ok) AS core_failures FROM h)
SELECT core_feeds, core_failures, (SELECT count(*) FROM events) AS items,
  core_feeds > 0 AND ((SELECT count(*) FROM events) = 0 OR core_failures > core_feeds // 2) AS abort FROM v""",
    "check_order": f"""WITH {STATS}, top AS (SELECT title FROM stats)
SELECT title, CAST(CASE WHEN last_day > 0 THEN 1 WHEN title IN (SELECT title FROM top) THEN 2 ELSE 3 END AS BIGINT)
  AS step, CASE WHEN last_day > 0 THEN last_day ELSE mentions END AS weight FROM stats""",
    "title_levels": levels(5, 1, "SELECT NULL AS title, CAST(NULL AS TIMESTAMP) AS held_until WHERE false"),
    "quick_levels": levels(14, 30, """SELECT title, max(ts) + INTERVAL 12 HOUR AS held_until FROM named
  WHERE source_type = 'podcast' GROUP BY title"""),
    "reader_trend": f"WITH {TREND} SELECT * FROM trend",
    "demand_index": f"""WITH {STATS}, {TREND}, {prices.HISTORY}, {prices.WEEK},
chg AS (SELECT replace(l.title, 'Brand#', 'title ') AS title,
    round_even(avg((l.median - w.week_median) / w.week_median * 100), 1) AS change_pct
  FROM latest l JOIN week w USING (title, site) WHERE l.site IN ('US', 'UK') AND l.copies >= 3 AND w.week_median > 0
  GROUP BY l.title),
top AS (SELECT * FROM stats),
sig AS (SELECT top.title, mentions, sources, views, change_pct, trend_pct,
    round_even(least(100, greatest(0, 50 + 33 * log2(((top.recent + 2) / 3) / ((top.prior + 6) / 11)))), 1) AS momentum,
    round_even(sources / (SELECT max(sources) FROM top) * 100, 1) AS breadth,
    round_even(CASE WHEN (SELECT max(views) FROM top) > 0
      THEN ln(1 + views) / ln(1 + (SELECT max(views) FROM top)) * 100 ELSE 0 END, 1) AS youtube,
    CASE WHEN change_pct IS NOT NULL THEN round_even(least(100, greatest(0, 50 + 2.5 * change_pct)), 1) END AS ebay,
    CASE WHEN trend_pct IS NOT NULL THEN round_even(least(100, greatest(0, (trend_pct + 50) / 1.5)), 1) END AS wikipedia
  FROM top LEFT JOIN chg ON chg.title = top.title LEFT JOIN trend ON trend.article = top.title)
SELECT *, round_even((momentum * 0.3::DOUBLE + breadth * 0.15::DOUBLE + youtube * 0.2::DOUBLE
    + coalesce(ebay * 0.2::DOUBLE, 0) + coalesce(wikipedia * 0.15::DOUBLE, 0))
  / (0.3::DOUBLE + 0.15::DOUBLE + 0.2::DOUBLE + CASE WHEN ebay IS NULL THEN 0 ELSE 0.2::DOUBLE END
    + CASE WHEN wikipedia IS NULL THEN 0 ELSE 0.15::DOUBLE END), 1) AS demand FROM sig""",
    "archive_months": f"""WITH {ARCHIVED}, c AS (SELECT month, g AS title, count(*) AS n FROM arch GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY n DESC, title) AS rank,
  CAST(sum(n) OVER (PARTITION BY month) AS BIGINT) AS mentions, count(*) OVER (PARTITION BY month) AS titles,
  CAST(sum(n) OVER () AS BIGINT) AS total_mentions FROM c)
SELECT month, mentions, titles, total_mentions, rank, title, n FROM r WHERE rank <= 5""",
    "archive_new": f"""WITH {ARCHIVED} SELECT month, g, s, h, min(d) AS d, min_by(t, (d, t)) AS t FROM arch
WHERE (month, g, s, h) NOT IN (SELECT month, title_, s_, h_ FROM (
  SELECT month AS month, g AS title_, s AS s_, h AS h_ FROM arch WHERE d < {NOW} - INTERVAL 10 DAY))
GROUP BY month, g, s, h""",
    "digital_stories": f"""WITH {ITEMS}, x AS (SELECT *, strftime(ts, '%Y-%m') AS month FROM items),
stored AS (SELECT month, source AS s, headline AS h, min(ts) AS d, min_by(source_type, (ts, source_type, link)) AS t,
    min_by(link, (ts, source_type, link)) AS l FROM x WHERE digital AND {OLD} GROUP BY ALL),
kept AS (SELECT * FROM stored WHERE NOT EXISTS (SELECT 1 FROM x WHERE NOT ({OLD}) AND NOT digital
  AND x.source = stored.s AND x.headline = stored.h)),
fresh AS (SELECT month, source AS s, headline AS h, min(ts) AS d, min_by(source_type, (ts, source_type, link)) AS t,
    min_by(link, (ts, source_type, link)) AS l FROM x WHERE digital AND NOT ({OLD}) GROUP BY ALL)
SELECT * FROM kept UNION ALL SELECT * FROM fresh WHERE NOT EXISTS (SELECT 1 FROM kept
  WHERE kept.month = fresh.month AND kept.s = fresh.s AND kept.h = fresh.h)""",
    "digital_archive": f"""WITH {ITEMS}, x AS (SELECT *, strftime(ts, '%Y-%m') AS month, digital AND NOT ({OLD}) AS still FROM items),
stored AS (SELECT month, source AS s, headline AS h, min(ts) AS d, min_by(source_type, (ts, source_type, link)) AS t,
    min_by(link, (ts, source_type, link)) AS l FROM x WHERE digital GROUP BY ALL),
kept AS (SELECT * FROM stored WHERE NOT EXISTS (SELECT 1 FROM x WHERE NOT still
  AND x.source = stored.s AND x.headline = stored.h)),
fresh AS (SELECT month, source AS s, headline AS h, min(ts) AS d, min_by(source_type, (ts, source_type, link)) AS t,
    min_by(link, (ts, source_type, link)) AS l FROM x WHERE still GROUP BY ALL)
SELECT * FROM kept UNION ALL SELECT * FROM fresh WHERE NOT EXISTS (SELECT 1 FROM kept
  WHERE kept.month = fresh.month AND kept.s = fresh.s AND kept.h = fresh.h)""",
    "digital_days": f"""WITH {ITEMS}, x AS (SELECT strftime(ts, '%Y-%m') AS m, strftime(ts, '%Y-%m-%d') AS d FROM items
  WHERE digital)
SELECT 'total' AS grouping, 'all' AS key, count(*) AS stories FROM x
UNION ALL SELECT 'month', m, count(*) FROM x GROUP BY m UNION ALL SELECT 'day', d, count(*) FROM x GROUP BY d""",
    "snapshot": f"""WITH {MERGED} SELECT link AS key, event_id, feed, ts, title AS matched_game,
  CASE WHEN fuzzy THEN 'fuzzy' ELSE 'exact' END AS match_method FROM merged""",
    "trimmed_snapshot": f"""WITH {MERGED}, n AS (SELECT count(*) AS n, count(title) AS named FROM merged),
c AS (SELECT CASE WHEN n <= 450 THEN 500 ELSE greatest(500, least(CAST(ceil(floor(n / 0.9) / 100) * 100 AS BIGINT), 900))
  END AS ceiling, named FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY title IS NOT NULL ORDER BY date_trunc('minute', ts) DESC, ts DESC, link)
  AS rk FROM merged)
SELECT link AS key, event_id, feed, ts, title AS matched_game,
  CASE WHEN fuzzy THEN 'fuzzy' ELSE 'exact' END AS match_method FROM r, c
WHERE rk <= CASE WHEN title IS NOT NULL THEN ceiling ELSE greatest(0, ceiling - named) END""",
    "thin_snapshot": f"""WITH {MERGED} SELECT feed, count(*) AS omitted, min(ts) AS oldest FROM merged
WHERE title IS NULL AND NOT remaster AND NOT digital GROUP BY feed""",
    "thin_rows": f"""WITH {MERGED} SELECT link AS key, event_id FROM merged
WHERE title IS NOT NULL OR remaster OR digital""",
    "snapshot_diff": f"""WITH {MERGED}, prev AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY ts DESC) AS rp
  FROM items WHERE NOT ({RECENT3})), p AS (SELECT * FROM prev WHERE rp = 1)
SELECT coalesce(p.link, m.link) AS key, CASE WHEN p.link IS NULL THEN 'added' WHEN m.link IS NULL THEN 'removed'
  WHEN p.headline <> m.headline THEN 'headline' ELSE 'source' END AS change
FROM p FULL JOIN merged m ON p.link = m.link
WHERE p.link IS NULL OR m.link IS NULL OR p.headline <> m.headline OR p.source <> m.source""",
    "snapshot_changed": f"""WITH {ITEMS}, p AS (SELECT link, max(ts) AS ts FROM items GROUP BY link)
SELECT CAST(0 AS BIGINT) AS added, count(*) FILTER (ts < {NOW} - INTERVAL 14 DAY) AS gone, false AS write FROM p""",
    "search_log": """WITH spent AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS level,
    CASE r_name WHEN 'AMERICA' THEN 'US' WHEN 'EUROPE' THEN 'UK' WHEN 'ASIA' THEN 'DE' WHEN 'AFRICA' THEN 'FR'
      ELSE 'IT' END AS site, c_name AS title
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
recent AS (SELECT * FROM spent),
g AS (SELECT day, 'total' AS grouping, NULL AS level, NULL AS site, NULL AS title, count(*) AS searches
    FROM recent GROUP BY day
  UNION ALL SELECT day, 'level_site', level, site, NULL, count(*) FROM recent GROUP BY ALL
  UNION ALL SELECT day, 'title', NULL, NULL, title, count(*) FROM recent GROUP BY ALL
  UNION ALL SELECT day, 'level_title', level, NULL, title, count(*) FROM recent GROUP BY ALL)
SELECT day, grouping, level, site, title, searches FROM g""",
    "run_verdict": f"""WITH {prices.HISTORY}, o AS (SELECT * FROM hist WHERE period = {prices.LAST} - 2),
n AS (SELECT title, site, copies, copies = 1 AS failed FROM hist WHERE period = {prices.LAST} - 1),
v AS (SELECT count(*) AS lookups, count(*) FILTER (n.site IN ('US', 'UK')) AS main,
    count(*) FILTER (n.site IN ('US', 'UK') AND failed) AS main_failed,
    count(*) FILTER (NOT failed AND o.copies > 0) AS known, count(*) FILTER (NOT failed) AS answered
  FROM n LEFT JOIN o USING (title, site))
SELECT *, CASE WHEN main_failed = main THEN 'every lookup failed' WHEN main_failed * 2 > main
  THEN 'most lookups failed' END AS reason FROM v""",
    "first_seen": f"""WITH {ITEMS} SELECT event_id, (SELECT min(ts) FROM items b WHERE b.link = a.link) AS ts
FROM items a WHERE source_type = 'forum'""",
    "sealed_due": f"""WITH {DUE}, h AS (SELECT p_brand AS title FROM part GROUP BY p_brand
  HAVING sum(p_size) % 7 <> 0 AND sum(p_size) % 5 <> 4)
SELECT h.title, string_agg(m.site, ',' ORDER BY m.site) AS sites FROM h CROSS JOIN (VALUES ('US'), ('UK')) m(site)
  LEFT JOIN newest n ON n.title = h.title AND n.site = m.site
WHERE n.checked IS NULL OR n.checked <= (SELECT now FROM clock) - INTERVAL 1410 MINUTE GROUP BY h.title""",
    "due_lookups": f"""WITH {DUE} SELECT title, site, level, CAST(wait AS BIGINT) AS wait, waited FROM (
  SELECT title, site, level, wait, CAST(waited AS DOUBLE) AS waited, sealed FROM due)
WHERE sealed OR waited IS NULL OR waited >= wait - 30""",
    "lookup_budget": f"""WITH {DUE}, q AS (SELECT *, sum(CASE WHEN sealed THEN 2 ELSE 1 END) OVER (
    ORDER BY extra, NOT sealed, level <> 'surging', NOT pinned, CASE level WHEN 'rare' THEN 2 ELSE 0 END,
      waited / greatest(every, 60) DESC NULLS FIRST, lower(title), site ROWS UNBOUNDED PRECEDING) AS spent FROM due
  WHERE sealed OR waited IS NULL OR waited >= wait - 30)
SELECT title, site, CAST(spent AS BIGINT) AS spent FROM q WHERE spent <= 50""",
}
