"""SQL twins of the streaming queries: the same rules over the finished table."""

from oracle.mentions import ITEMS, NAMED, NOW

SQL = {
    "stream_mention_counts": f"""WITH {NAMED} SELECT strftime(ts, '%Y-%m-%d') AS day, title, count(*) AS mentions
FROM named GROUP BY ALL""",
    "stream_surge_windows": f"""WITH {NAMED}, w AS (SELECT *, date_trunc('hour', ts) + INTERVAL 1 HOUR * h AS until
  FROM named, (SELECT unnest(range(1, 25)) AS h) WHERE NOT in_body)
SELECT strftime(until, '%Y-%m-%d %H') AS until, title, count(*) AS mentions, count(DISTINCT source) AS sources,
  count(DISTINCT array_to_string(list_sort(list_distinct(string_split(headline, ' '))), ' ')) AS stories FROM w GROUP BY ALL""",
    "rolling_snapshot": f"""WITH {ITEMS}, alive AS (SELECT *, ts >= {NOW} - INTERVAL 14 DAY AS fresh, hour(ts) < 12 AS early FROM items),
one AS (SELECT link, feed, ts, event_id, fresh FROM alive WHERE early
  QUALIFY row_number() OVER (PARTITION BY link ORDER BY ts DESC) = 1),
two AS (SELECT a.link, a.event_id, a.fresh FROM alive a LEFT JOIN one ON one.link = a.link AND one.fresh
  WHERE NOT early AND (a.source_type <> 'forum' OR one.feed IS NULL OR one.feed = a.feed)
  QUALIFY row_number() OVER (PARTITION BY a.link ORDER BY a.ts DESC) = 1)
SELECT link AS key, event_id FROM two WHERE fresh
UNION ALL SELECT link, event_id FROM one WHERE fresh AND link NOT IN (SELECT link FROM two)""",
    "stream_archive": f"""WITH {NAMED} SELECT strftime(ts, '%Y-%m') AS month, title AS g, source AS s, headline AS h,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS d FROM named GROUP BY month, title, source, headline""",
    "stream_surge_holds": f"""WITH {NAMED} SELECT title, strftime(max(ts) + INTERVAL 48 HOUR, '%Y-%m-%d %H:%M:%S') AS held_until
FROM named WHERE source_type = 'news' GROUP BY title""",
    "stream_source_health": """WITH f AS (SELECT user_id::VARCHAR AS feed, ts, value >= 3 AS ok FROM events),
good AS (SELECT feed, max(ts) AS last_ok FROM f WHERE ok GROUP BY feed)
SELECT feed, arg_max(ok, ts) AS ok, strftime(min(ts) FILTER (last_ok IS NULL OR ts > last_ok), '%Y-%m-%d %H:%M:%S') AS failing_since,
  strftime(max(last_ok), '%Y-%m-%d %H:%M:%S') AS latest FROM f LEFT JOIN good USING (feed) GROUP BY feed""",
    "stream_price_changes": """WITH c AS (SELECT l_partkey, l_suppkey, l_shipdate, l_quantity, l_discount,
  lag(l_shipdate) OVER w AS d0, lag(l_quantity) OVER w AS q0, lag(l_discount) OVER w AS m0 FROM lineitem
  WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_quantity, l_discount))
SELECT CAST(l_partkey AS VARCHAR) AS title, count(*) AS changes FROM c
WHERE d0 IS NULL OR CAST(d0 AS DATE) <> CAST(l_shipdate AS DATE) OR q0 <> l_quantity OR m0 <> l_discount GROUP BY l_partkey""",
}
