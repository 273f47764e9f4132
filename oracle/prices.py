"""SQL twins of the price queries."""

SITES = """sites AS (
  SELECT s_suppkey, CASE r_name WHEN 'AMERICA' THEN 'US' WHEN 'EUROPE' THEN 'UK' WHEN 'ASIA' THEN 'DE'
    WHEN 'AFRICA' THEN 'FR' ELSE 'IT' END AS site
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
LINES = SITES + """, lines AS (
  SELECT p_brand AS title, site, l_extendedprice / l_quantity AS price, l_shipdate AS stamp
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN sites ON l_suppkey = s_suppkey)"""


def _history(period: str, stamp: str) -> str:
    return LINES + f""", hist0 AS (
  SELECT title, site, CAST({period} AS INT) AS period, floor(price * 100 + 0.5) AS penny FROM lines), hist AS (
  SELECT title, site, period, count(*) AS copies, min(penny) / 100.0 AS lowest,
    floor(median(penny) + 0.5) / 100.0 AS median FROM hist0 GROUP BY ALL)"""


HISTORY = _history("year(stamp) * 12 + month(stamp) - 1", "")
DAYS = _history("date_diff('day', DATE '1970-01-01', CAST(stamp AS DATE))", "")
LAST = "(SELECT max(period) FROM hist)"


def index_of(extra: str = "") -> str:
    return HISTORY + f""", daily AS (
  SELECT site, title, period, median FROM hist WHERE copies >= 3 AND median > 0 AND period < {LAST} {extra}),
spread AS (
  SELECT site AS label, site || title AS item, period, median FROM daily
  UNION ALL
  SELECT 'PAL', site || title, period, median FROM daily WHERE site <> 'US'
    AND (SELECT count(DISTINCT site) FROM daily WHERE site <> 'US') >= 2),
prev AS (
  SELECT *, lag(period) OVER w AS p0, lag(median) OVER w AS m0 FROM spread
  WINDOW w AS (PARTITION BY label, item ORDER BY period)),
days AS (
  SELECT label AS site, period, count(*) AS priced,
    count(*) FILTER (period - p0 <= 3 AND median / m0 BETWEEN 0.5 AND 2) AS compared,
    avg(ln(median / m0)) FILTER (period - p0 <= 3 AND median / m0 BETWEEN 0.5 AND 2) AS f
  FROM prev GROUP BY ALL),
starts AS (SELECT site, min(period) AS start FROM days WHERE priced >= 10 GROUP BY site),
idx AS (
  SELECT site, period,
    round_even(100 * exp(sum(CASE WHEN period > start AND compared >= 10 THEN f ELSE 0 END)
      OVER (PARTITION BY site ORDER BY period)), 2) AS index_value,
    CASE WHEN period = start THEN priced ELSE compared END AS compared
  FROM days JOIN starts USING (site) WHERE period >= start)"""


MEMBERS = """lists AS (SELECT * FROM (VALUES ('PAL', 'UK'), ('US', 'US')) t(list, site)),
members AS (SELECT list, site, p_brand AS title, CAST(sum(p_size) * 50 AS BIGINT) AS held FROM part, lists
  GROUP BY ALL)"""

WEEK = """newest AS (SELECT title, site, max(period) AS period FROM hist GROUP BY ALL),
latest AS (SELECT hist.* FROM hist JOIN newest USING (title, site, period)),
cand AS (
  SELECT l.title, l.site, l.period, l.median, h.period AS wp, h.median AS wm,
    CASE WHEN l.period - h.period BETWEEN 7 AND 9 THEN 1 WHEN l.period - h.period BETWEEN 3 AND 6 THEN 2 END AS c
  FROM latest l LEFT JOIN hist h ON h.title = l.title AND h.site = l.site),
best AS (
  SELECT *, row_number() OVER (PARTITION BY title, site ORDER BY c NULLS LAST,
    CASE WHEN c = 1 THEN -wp ELSE wp END) AS rn FROM cand),
week AS (SELECT title, site, period, median, CASE WHEN c IS NOT NULL THEN wp END AS week_period,
  CASE WHEN c IS NOT NULL THEN wm END AS week_median FROM best WHERE rn = 1)"""

STATE = """CASE copies WHEN 1 THEN 'error' WHEN 2 THEN 'unmatched' ELSE 'ok' END"""

SQL = {
    "listing_history": f"WITH {HISTORY} SELECT title, site, period, copies, lowest, median FROM hist",
    "daily_medians": f"""WITH {HISTORY} SELECT site, title, period, median FROM hist
WHERE copies >= 3 AND median > 0 AND period < {LAST}""",
    "price_moves": f"""WITH {HISTORY}, daily AS (SELECT * FROM hist WHERE copies >= 3 AND median > 0), spread AS (
  SELECT site AS label, site || title AS item, period, median FROM daily
  UNION ALL SELECT 'PAL', site || title, period, median FROM daily WHERE site <> 'US'),
prev AS (SELECT *, lag(period) OVER w AS p0, lag(median) OVER w AS m0 FROM spread
  WINDOW w AS (PARTITION BY label, item ORDER BY period)),
ok AS (SELECT *, period - p0 <= 3 AND median / m0 BETWEEN 0.5 AND 2 AS good FROM prev)
SELECT label AS site, period, count(*) AS priced, count(*) FILTER (good) AS compared,
  round(exp(avg(ln(median / m0)) FILTER (good)), 6) AS geo_mean FROM ok GROUP BY ALL""",
    "price_index": f"WITH {index_of(chr(65) + 'ND title <> ' + chr(39) + 'Brand#13' + chr(39))} SELECT * FROM idx",
    "index_change": f"""WITH {index_of()}, last AS (
  SELECT site, max(period) AS period FROM idx GROUP BY site),
tip AS (SELECT idx.* FROM idx JOIN last USING (site, period)),
d AS (SELECT site, max(i.period) AS before_period FROM idx i JOIN last l USING (site)
  WHERE i.period < l.period GROUP BY site),
w AS (SELECT site, max(i.period) AS week_period FROM idx i JOIN last l USING (site)
  WHERE i.period <= l.period - 7 GROUP BY site)
SELECT t.site, t.period, t.index_value, t.compared, d.before_period,
  CASE WHEN t.compared >= 10 THEN round_even((t.index_value / db.index_value - 1) * 100, 4) END AS day_change,
  w.week_period,
  CASE WHEN t.compared >= 10 THEN round_even((t.index_value / wb.index_value - 1) * 100, 4) END AS week_change
FROM tip t LEFT JOIN d USING (site) LEFT JOIN idx db ON db.site = t.site AND db.period = d.before_period
LEFT JOIN w ON w.site = t.site LEFT JOIN idx wb ON wb.site = t.site AND wb.period = w.week_period""",
    "index_range": f"""WITH {index_of()} SELECT idx.* FROM idx
JOIN (SELECT site, max(period) AS last FROM idx GROUP BY site) USING (site) WHERE period >= last - 12""".replace(
        "idx.*", "site, period, index_value, compared"),
    "rare_index": f"""WITH RECURSIVE {HISTORY}, {MEMBERS},
fig AS (SELECT list, title, period, copies, median, held FROM hist JOIN members USING (site, title)
  WHERE median > 0 AND period < {LAST}),
mv AS (SELECT list, title, period, median, lag(period) OVER w AS p0, lag(median) OVER w AS m0 FROM fig
  WHERE copies >= 2 WINDOW w AS (PARTITION BY list, title ORDER BY period)),
md AS (SELECT list, period, count(*) AS priced,
    count(*) FILTER (period - p0 <= 3 AND median / m0 BETWEEN 0.5 AND 2) AS compared,
    avg(ln(median / m0)) FILTER (period - p0 <= 3 AND median / m0 BETWEEN 0.5 AND 2) AS f FROM mv GROUP BY ALL),
obs AS (SELECT list, period, row_number() OVER (PARTITION BY list ORDER BY period) AS d
  FROM (SELECT DISTINCT list, period FROM fig)),
carried AS (SELECT o.list, o.d, o.period, f.title, max(f.period) AS p FROM obs o JOIN fig f
  ON f.list = o.list AND f.period <= o.period AND f.period >= o.period - 7 GROUP BY ALL),
live AS (SELECT c.list, c.d, c.period, c.title, f.median, f.held FROM carried c
  JOIN fig f ON f.list = c.list AND f.title = c.title AND f.period = c.p),
pair AS (SELECT a.list, a.period, a.median, a.held, b.median AS m0 FROM live a
  LEFT JOIN live b ON b.list = a.list AND b.title = a.title AND b.d = a.d - 1
    AND a.median / b.median BETWEEN 0.5 AND 2),
sums AS (SELECT list, period, count(*) AS live, CAST(sum(CAST(round(median * 100) AS BIGINT) * held) AS DOUBLE) * 0.65 / 100 AS total,
    coalesce(CAST(sum(CAST(round(median * 100) AS BIGINT) * held) FILTER (held < 100000) AS DOUBLE) * 0.65 / 100, 0) AS core_total,
    coalesce(sum(median * held) FILTER (m0 IS NOT NULL) / sum(m0 * held), 1) AS r,
    coalesce(sum(median * held) FILTER (m0 IS NOT NULL AND held < 100000)
      / sum(m0 * held) FILTER (held < 100000), 1) AS core_r FROM pair GROUP BY ALL),
istart AS (SELECT list, min(period) AS s FROM md WHERE priced >= 10 GROUP BY list),
line AS (SELECT list, sums.period, live, total, core_total, r, core_r, s,
    coalesce(priced, 0) AS priced, coalesce(compared, 0) AS compared,
    round_even(100 * exp(sum(CASE WHEN sums.period > s AND compared >= 10 THEN f ELSE 0 END)
      OVER (PARTITION BY list ORDER BY sums.period)), 2) AS raw
  FROM sums LEFT JOIN md USING (list, period) JOIN istart USING (list)),
size AS (SELECT list, count(*) AS n FROM members GROUP BY list),
begun AS (SELECT list, min(period) AS b FROM line JOIN size USING (list)
  WHERE live >= 0.8 * n AND period >= s GROUP BY list),
base AS (SELECT line.list, raw AS base, total AS cap0, core_total AS core0 FROM line
  JOIN begun ON begun.list = line.list AND line.period = b)
SELECT list, period, round_even(raw / base * 100, 2) AS index_value,
  CASE WHEN period = s THEN priced ELSE compared END AS compared,
  round_even(cap0 * exp(sum(CASE WHEN period > b THEN ln(r) ELSE 0 END)
    OVER (PARTITION BY list ORDER BY period)), 0) AS cap,
  round_even(core0 * exp(sum(CASE WHEN period > b THEN ln(core_r) ELSE 0 END)
    OVER (PARTITION BY list ORDER BY period)), 0) AS core_cap, live
FROM line JOIN begun USING (list) JOIN base USING (list) WHERE period >= b""",
    "market_cap": f"""WITH {HISTORY}, {MEMBERS} SELECT list, period,
  round_even(CAST(sum(CAST(round(median * 100) AS BIGINT) * held) AS DOUBLE) * 0.65 / 100, 0) AS cap,
  round_even(coalesce(CAST(sum(CAST(round(median * 100) AS BIGINT) * held) FILTER (held < 100000) AS DOUBLE) * 0.65 / 100, 0), 0) AS core_cap, count(*) AS titles
FROM hist JOIN members USING (site, title) WHERE median > 0 GROUP BY ALL""",
    "daily_series": f"""WITH {DAYS} SELECT title, site, period, median, copies FROM hist
WHERE period >= {LAST} - 90 AND period < {LAST} AND median > 0""",
    "week_before": f"WITH {HISTORY}, {WEEK} SELECT * FROM week",
    "week_before_daily": f"WITH {DAYS}, {WEEK} SELECT * FROM week",
    "steady_pairs": f"""WITH {HISTORY} SELECT title, site, count(*) AS rows,
  count(*) >= 3 AND max(period) - min(period) >= 4 AND min(copies) >= 4 AND min(median) > 0
  AND (max(copies) - min(copies)) / median(copies) <= 0.9
  AND (max(median) - min(median)) / median(median) <= 0.6 AS steady
FROM hist WHERE period BETWEEN {LAST} - 6 AND {LAST} GROUP BY ALL""",
    "change_log": f"WITH {DAYS} SELECT title, site, period, copies, median FROM hist",
    "latest_prices": f"""WITH {HISTORY} SELECT title, site, max(period) AS period,
  arg_max(copies, period) AS copies, arg_max(lowest, period) AS lowest, arg_max(median, period) AS median
FROM hist GROUP BY ALL""",
    "latest_update": f"""WITH {HISTORY},
o AS (SELECT *, {STATE} AS status FROM hist WHERE period = {LAST} - 2 AND copies <> 1),
n AS (SELECT *, {STATE} AS status FROM hist WHERE period = {LAST} - 1 AND copies <> 1)
SELECT coalesce(n.title, o.title) AS title, coalesce(n.site, o.site) AS site, coalesce(n.status, o.status) AS status,
  coalesce(n.period, o.period) AS period,
  CASE WHEN n.status = 'unmatched' THEN NULL ELSE coalesce(n.copies, o.copies) END AS copies,
  CASE WHEN n.status = 'unmatched' THEN NULL ELSE coalesce(n.lowest, o.lowest) END AS lowest,
  CASE WHEN n.status = 'unmatched' THEN NULL ELSE coalesce(n.median, o.median) END AS median
FROM o FULL JOIN n ON o.title = n.title AND o.site = n.site""",
    "market_change": f"""WITH {HISTORY}, {WEEK}, rows AS (
  SELECT l.title, (l.median - w.week_median) / w.week_median * 100 AS pct FROM latest l JOIN week w USING (title, site)
  WHERE l.site IN ('US', 'UK') AND l.copies >= 3 AND w.week_median > 0)
SELECT title, round_even(avg(pct), 1) AS change_pct FROM rows GROUP BY title""",
}
SQL["latest_table"] = SQL["latest_update"]  # the stored table holds what the update gives
