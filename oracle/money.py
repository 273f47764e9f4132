"""SQL twins of the crowd and valuation queries."""

from oracle import prices

REPORTS = prices.SITES + """, reports AS (
  SELECT o_custkey AS account, lower(replace(p_brand, '#', ' ')) AS game, CASE site WHEN 'US' THEN 'US' ELSE 'PAL' END
    AS region, CASE l_returnflag WHEN 'A' THEN 'complete' WHEN 'R' THEN 'loose' ELSE 'sealed' END AS condition,
    CASE site WHEN 'US' THEN 'USD' WHEN 'UK' THEN 'GBP' ELSE 'EUR' END AS currency,
    floor(l_extendedprice / l_quantity * 100 + 0.5) / 100.0 AS price, strftime(l_shipdate, '%Y-%m') AS month,
    year(l_shipdate) * 12 + month(l_shipdate) - 1 AS period
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
  JOIN sites ON l_suppkey = s_suppkey)"""
PROBLEM = """CASE WHEN period < (SELECT max(period) FROM reports) - 24 THEN 'month'
  WHEN price <= 0 OR price > 20000 THEN 'price' END"""


def crowd(source: str) -> str:
    return f"""{source}, each AS (SELECT game, region, condition, currency, account,
  median(CAST(round(price * 100) AS BIGINT)) AS m FROM ok GROUP BY ALL),
mid AS (SELECT game, region, condition, currency, median(m) AS middle, count(*) AS accounts FROM each GROUP BY ALL
  HAVING count(*) >= 5),
j AS (SELECT *, m <= middle * 3 AND m * 3 >= middle AS kept FROM each JOIN mid USING (game, region, condition, currency)),
f AS (SELECT game, region, condition, currency, count(*) FILTER (kept) >= 5 AS published,
    count(*) FILTER (kept) AS reporters, count(*) FILTER (NOT kept) AS held, median(m) FILTER (kept) AS md,
    min(m) FILTER (kept) AS lo, max(m) FILTER (kept) AS hi FROM j GROUP BY ALL),
crowd AS (SELECT game, region, condition, currency, published, reporters, held,
    CASE WHEN published THEN floor(md + 0.5) / 100.0 END AS median, CASE WHEN published THEN lo / 100.0 END AS low,
    CASE WHEN published THEN hi / 100.0 END AS high FROM f)"""


OWNED = REPORTS + """, owned AS (SELECT account, game, least(99, count(*) FILTER (condition = 'sealed')) AS sealed,
    least(99, count(*) FILTER (condition = 'complete')) AS complete,
    least(99, count(*) FILTER (condition = 'loose')) AS loose FROM reports GROUP BY ALL)"""
HIST = prices.HISTORY.removeprefix(prices.SITES)
FIGURES = f"""{REPORTS}{HIST}, coll AS (
  SELECT account, game AS title, region, condition, count(*) AS qty, min(price) AS paid FROM reports GROUP BY ALL),
fig AS (SELECT lower(replace(title, '#', ' ')) AS title, site, arg_max(copies, period) AS copies,
    arg_max(median, period) AS median FROM hist GROUP BY ALL),
refs AS (SELECT game AS title, region, condition, currency, month, max(price) AS price FROM reports
  WHERE condition = 'sealed' AND currency IN ('USD', 'GBP') GROUP BY ALL),
best AS (SELECT title, region, condition, arg_max(currency, price) AS rc, max(price) AS rp FROM refs GROUP BY ALL),
valued AS (SELECT c.*, CASE c.condition WHEN 'complete' THEN f.median * 1.5 WHEN 'loose' THEN f.median END AS mv,
    CASE WHEN c.condition = 'sealed' THEN rp END AS av, rc
  FROM coll c LEFT JOIN fig f ON f.title = c.title AND f.site = CASE c.region WHEN 'US' THEN 'US' ELSE 'UK' END
    AND f.copies > 1
  LEFT JOIN best b ON b.title = c.title AND b.region = c.region AND b.condition = c.condition),
final AS (SELECT account, title, region, condition, qty, paid, coalesce(mv, av) AS value,
    CASE WHEN av IS NOT NULL THEN rc WHEN region = 'US' THEN 'USD' ELSE 'GBP' END AS currency,
    CASE WHEN mv IS NOT NULL THEN 'market' WHEN av IS NOT NULL THEN 'article' ELSE 'none' END AS priced_by FROM valued)"""

SQL = {
    "report_problems": f"""WITH {REPORTS} SELECT region, condition, currency, {PROBLEM} AS problem, count(*) AS n
FROM reports GROUP BY ALL""",
    "crowd_prices": f"WITH {crowd(REPORTS + ', ok AS (SELECT * FROM reports)')} SELECT * FROM crowd",
    "recent_crowd_prices": f"""WITH {crowd(REPORTS + f', ok AS (SELECT * FROM reports WHERE {PROBLEM} IS NULL)')}
SELECT * FROM crowd WHERE published""",
    "crowd_owners": f"""WITH {OWNED} SELECT game, count(*) AS owners, CAST(sum(sealed) AS BIGINT) AS sealed,
  CAST(sum(complete) AS BIGINT) AS complete, CAST(sum(loose) AS BIGINT) AS loose FROM owned
WHERE sealed + complete + loose > 0 GROUP BY game HAVING count(*) >= 5""",
    "wanted": f"""WITH {OWNED} SELECT game, count(DISTINCT account) AS accounts FROM owned
WHERE sealed + complete + loose > 0 GROUP BY game ORDER BY accounts DESC, game""",
    "wanted_sealed": f"""WITH {OWNED} SELECT game, count(DISTINCT account) AS accounts FROM owned
WHERE sealed > 0 GROUP BY game HAVING count(DISTINCT account) >= 2 ORDER BY accounts DESC, game""",
    "euro_history": f"""WITH {prices.HISTORY}, c AS (SELECT title, site, period, median AS amount,
    CASE site WHEN 'US' THEN 'USD' WHEN 'UK' THEN 'GBP' ELSE 'EUR' END AS currency FROM hist)
SELECT *, round(CASE currency WHEN 'USD' THEN amount / 1.25 WHEN 'GBP' THEN amount / 0.8 ELSE amount END, 6) AS eur,
  currency <> 'EUR' AS converted FROM c""",
    "collection_value": f"""WITH {FIGURES} SELECT account, title, region, condition, qty, paid,
  round(value, 4) AS value, currency, priced_by FROM final""",
    "collection_totals": f"""WITH {FIGURES} SELECT currency,
  CAST(coalesce(sum(CAST(value AS DECIMAL(18, 4)) * qty), 0) AS DOUBLE) AS worth,
  CAST(sum(CAST(paid AS DECIMAL(18, 4)) * qty) AS DOUBLE) AS paid, CAST(sum(qty) AS BIGINT) AS copies,
  CAST(coalesce(sum(qty) FILTER (value IS NULL), 0) AS BIGINT) AS unpriced FROM final GROUP BY currency""",
    "portfolio": f"""WITH {FIGURES}, held AS (SELECT title, CASE region WHEN 'US' THEN 'US' ELSE 'UK' END AS site,
    sum(qty) AS qty FROM coll GROUP BY ALL),
h AS (SELECT lower(replace(title, '#', ' ')) AS title, site, period, median FROM hist WHERE site IN ('US', 'UK')),
p AS (SELECT DISTINCT period FROM h JOIN held USING (title, site)),
firsts AS (SELECT title, site, arg_min(median, period) AS first FROM h GROUP BY ALL),
v AS (SELECT p.period, d.title, d.site, d.qty, coalesce(arg_max(h.median, h.period), any_value(f.first)) AS m
  FROM p CROSS JOIN held d JOIN firsts f ON f.title = d.title AND f.site = d.site
  LEFT JOIN h ON h.title = d.title AND h.site = d.site AND h.period <= p.period GROUP BY ALL)
SELECT period, round(sum(m * qty * CASE site WHEN 'US' THEN 0.64 ELSE 1 END), 2) AS value, count(*) AS holdings
FROM v GROUP BY period""",
    "reference_gaps": f"""WITH {FIGURES} SELECT r.title, r.condition, r.price, f.median AS value,
  round(r.price / f.median - 1, 6) AS gap FROM refs r JOIN fig f ON f.title = r.title AND f.site = 'UK'
WHERE r.region = 'PAL' AND f.median > 0""",
    "price_order": f"""WITH {FIGURES}, t AS (SELECT lower(replace(p_brand, '#', ' ')) AS title, min(p_partkey) AS position
  FROM part GROUP BY ALL),
p AS (SELECT t.title, position, max(median) FILTER (site = 'UK') AS uk, max(median) FILTER (site = 'US') AS us
  FROM t LEFT JOIN fig ON fig.title = t.title AND copies > 1 GROUP BY ALL)
SELECT title, CAST(CASE WHEN uk IS NOT NULL THEN 1 WHEN us IS NOT NULL THEN 2 ELSE 3 END AS BIGINT) AS price_class,
  coalesce(uk, us) AS price, position FROM p""",
    "rarity_order": f"""WITH {FIGURES}, t AS (SELECT lower(replace(p_brand, '#', ' ')) AS title,
    coalesce(bool_or(p_type = 'ECONOMY' AND p_size = 1), false) AS collectible FROM part GROUP BY ALL),
s AS (SELECT t.title, t.collectible, min(greatest(copies, copies + 3)) AS supply,
    coalesce(bool_or(copies <= 10 AND copies + 3 <= 10), false) AS scarce FROM t LEFT JOIN fig ON fig.title = t.title
    AND copies > 1 AND site IN ('US', 'UK') GROUP BY ALL)
SELECT title, CAST(CASE WHEN supply <= 10 THEN 1 WHEN supply <= 50 OR (supply IS NULL AND collectible) THEN 2
  WHEN supply IS NOT NULL THEN 3 ELSE 4 END AS BIGINT) AS rarity_class, collectible, supply, scarce FROM s""",
    "shared_prices": f"""WITH {prices.HISTORY}, sh AS (SELECT p_type, min(p_brand) AS shown FROM part WHERE p_size = 1
  GROUP BY p_type),
gr AS (SELECT p_brand AS title, min(shown) AS shown FROM part JOIN sh USING (p_type) WHERE p_size = 1 GROUP BY ALL),
g1 AS (SELECT * FROM gr WHERE title <> shown),
g AS (SELECT * FROM g1 UNION SELECT shown, shown FROM g1),
l AS (SELECT title, site, arg_max(copies, period) AS copies, arg_max(median, period) AS median FROM hist GROUP BY ALL
  HAVING arg_max(copies, period) > 3),
lent AS (SELECT shown, site, arg_max(median, (l.title = shown, copies, l.title)) AS lent FROM l JOIN g ON g.title = l.title
  GROUP BY ALL),
w AS (SELECT g.title, lent.site, lent.lent FROM g JOIN lent ON lent.shown = g.shown)
SELECT coalesce(w.title, l.title) AS title, coalesce(w.site, l.site) AS site, coalesce(min(l.median), max(lent)) AS median,
  min(l.median) IS NULL AS shared FROM w FULL JOIN l ON l.title = w.title AND l.site = w.site GROUP BY ALL""",
}
