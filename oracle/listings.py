"""SQL twins of the listing queries. Word tests are written out from the same fixed word lists."""

from oracle import prices
from titletide import vocab


def has(column: str, phrases) -> str:
    return f"regexp_matches(' ' || {column} || ' ', ' (?:{'|'.join(phrases)}) ')"


def by_site(column: str, lists) -> str:
    cases = " ".join(f"WHEN '{site}' THEN {has(column, phrases)}" for site, phrases in lists.items())
    return f"(CASE site {cases} ELSE false END)"


RAW = prices.SITES + """, raw AS (
  SELECT p_name AS title, site, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS item_id,
    upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1])
      || split_part(p_name, ' ', 2)[2:] || ' ' || CASE l_linenumber WHEN 1 THEN 'ps2' WHEN 2 THEN '2 ps2'
      WHEN 3 THEN 'ps2 japanese import' WHEN 4 THEN 'PS2 + soundtrack' WHEN 5 THEN 'Playstation 2 factory sealed'
      WHEN 6 THEN 'xbox edition' ELSE 'soundtrack' END || ' - ' || CASE l_returnflag
      WHEN 'A' THEN 'complete, with manual' WHEN 'R' THEN 'disc only' ELSE 'good' END
      || CASE p_type WHEN 'PROMO' THEN ' bundle' ELSE '' END AS text,
    floor(l_extendedprice / l_quantity * 100 + 0.5) / 100.0 AS value, l_linestatus = 'F' AND l_tax = 0 AS wrong_currency,
    round(l_discount * 100, 2) AS postage, CASE WHEN l_discount > 0 THEN l_orderkey END AS legacy_id, l_shipdate AS listed
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN sites ON l_suppkey = s_suppkey)"""
WORDED = RAW + """, worded AS (
  SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS w,
    CASE WHEN wrong_currency THEN NULL ELSE value END AS price,
    'https://www.ebay.' || CASE site WHEN 'US' THEN 'com' WHEN 'UK' THEN 'co.uk' ELSE lower(site) END || '/itm/'
      || legacy_id AS link FROM raw)"""
AFTER = "trim(regexp_replace(w, '^' || title, ''))"
SEQUEL = (f"(regexp_matches({AFTER}, '^[1-9]( |$)') AND NOT regexp_matches({AFTER}, "
          f"'^[1-9] (?:{'|'.join(vocab.DISC_WORDS)}|10)( |$)'))")
PLATFORM = r"'\b(?:sony )?(?:playstation ?2|play station 2|ps ?2)\b'"
WITH = vocab.COMES_WITH.replace("'", "''")
LESS_BUNDLE = [p for p in vocab.JUNK_PHRASES if p != "bundle"]
JUNK = (f"CASE WHEN title LIKE '% gear' THEN {has('w', LESS_BUNDLE)} OR ({has('w', ['bundle'])} AND NOT regexp_matches("
        f"lower(text), '{WITH}bundle\\b')) "
        f"ELSE {has('w', vocab.JUNK_PHRASES)} END")
CLASSIFIED = WORDED + f""", listed AS (
  SELECT *, CASE
    WHEN (site <> 'US' AND NOT regexp_matches(w, {PLATFORM})) OR {SEQUEL}
      OR (title LIKE 'new %' AND {has('w', ['ring edition'])}) THEN 'other_game'
    WHEN {has('w', vocab.OTHER_PLATFORMS)} THEN 'other_platform'
    WHEN ({JUNK}) OR {by_site('w', vocab.SITE_JUNK)} OR (title LIKE '% rod' AND {has('w', ['good'])})
      OR (regexp_matches({AFTER}, '^(?:(?:original|official|music|game|video|promo) )*(?:soundtracks?|ost)( |$)')
        AND NOT regexp_matches(lower(text), '[+&]\\s*soundtrack')) THEN 'not_a_copy'
    WHEN {has('w', vocab.GRADED_OR_SEALED)} AND NOT {has('w', vocab.NOT_GRADED)} THEN 'graded_or_sealed'
    WHEN {has('w', vocab.IMPORT_PHRASES)} OR {by_site('w', vocab.FOREIGN)} THEN 'import'
    WHEN {has('w', vocab.INCOMPLETE_PHRASES)} OR {by_site('w', vocab.SITE_INCOMPLETE)} THEN 'incomplete'
    WHEN price IS NULL THEN 'no_price' WHEN link IS NULL THEN 'no_link' END AS reason,
    {has('w', vocab.COMPLETE_PHRASES)} AS confirmed FROM worded)"""
PENNY = "floor(median(floor({} * 100 + 0.5)) FILTER ({}) + 0.5) / 100.0"
SUMMARY = CLASSIFIED + f""", summary AS (
  SELECT title, site, CASE WHEN count(*) FILTER (reason IS NULL) > 0 THEN 'ok'
      WHEN count(*) FILTER (reason = 'other_game') = count(*) THEN 'unmatched' ELSE 'none' END AS status,
    count(*) AS fetched, count(*) FILTER (reason IS NULL) AS counted,
    min(floor(price * 100 + 0.5)) FILTER (reason IS NULL) / 100.0 AS lowest,
    {PENNY.format('price', 'reason IS NULL')} AS median, count(postage) FILTER (reason IS NULL) AS postage_known,
    {PENNY.format('postage', 'reason IS NULL')} AS median_postage,
    count(*) FILTER (reason IS NULL AND confirmed) AS confirmed_counted,
    {PENNY.format('price', 'reason IS NULL AND confirmed')} AS confirmed_median FROM listed GROUP BY ALL)"""

PARTS = " OR ".join(f"({has('w', [p])})" for p in vocab.CONSOLE_PARTS)
SQL = {
    "listing_reasons": f"WITH {CLASSIFIED} SELECT item_id, title, site, reason, price, postage, confirmed, link FROM listed",
    "listing_summary": f"WITH {SUMMARY} SELECT * FROM summary",
    "kept_figures": f"""WITH {SUMMARY}, s AS (SELECT *, status <> 'unmatched' AS k,
  status <> 'unmatched' AND confirmed_counted >= 3 AND confirmed_counted < counted AS c FROM summary)
SELECT title, site, NOT k AS unmatched, CASE WHEN k THEN counted END AS copies, CASE WHEN k THEN lowest END AS lowest,
  CASE WHEN k THEN median END AS median, CASE WHEN k THEN median_postage END AS postage,
  CASE WHEN k THEN fetched END AS listed, CASE WHEN c THEN confirmed_counted END AS complete_copies,
  CASE WHEN c THEN confirmed_median END AS complete_median FROM s""",
    "listing_skips": f"""WITH {CLASSIFIED} SELECT title, site, reason, count(*) AS n FROM listed
WHERE reason IS NOT NULL GROUP BY ALL""",
    "listing_examples": f"""WITH {CLASSIFIED}, r AS (SELECT *, row_number() OVER (
  PARTITION BY title, site, reason ORDER BY item_id) AS rank FROM listed WHERE reason IS NOT NULL)
SELECT title, site, reason, rank, item_id, text AS example FROM r WHERE rank <= 5""",
    "cheapest_listings": f"""WITH {CLASSIFIED}, r AS (SELECT *, row_number() OVER (
  PARTITION BY title, site ORDER BY price, link) AS rank FROM listed WHERE reason IS NULL)
SELECT title, site, rank, price, link FROM r WHERE rank <= 10""",
    "two_pass_search": f"""WITH {CLASSIFIED}, f AS (SELECT *, listed.listed >= TIMESTAMP '2001-06-01' AS fresh FROM listed),
a AS (SELECT title, site, count(*) AS n, count(*) FILTER (reason = 'other_game') AS o FROM f WHERE fresh GROUP BY ALL),
b AS (SELECT title, site, count(*) AS n, count(*) FILTER (reason = 'other_game') AS o FROM f WHERE NOT fresh GROUP BY ALL),
swap AS (SELECT b.title, b.site FROM b LEFT JOIN a USING (title, site)
  WHERE a.n IS NULL OR (a.n = a.o AND b.n <> b.o)),
k AS (SELECT f.*, s.title IS NOT NULL AS swapped FROM f LEFT JOIN swap s ON s.title = f.title AND s.site = f.site)
SELECT title, site, count(*) AS listings, count(*) FILTER (reason IS NULL) AS counted FROM k
WHERE fresh <> swapped GROUP BY ALL""",
    "console_listings": f"""WITH {WORDED} , r AS (SELECT title, site, CASE
  WHEN title LIKE '%widget' AND NOT {has('w', ['large', 'small'])} THEN 'other_game'
  WHEN {has('w', vocab.OTHER_CONSOLES)} THEN 'other_platform'
  WHEN {has('w', vocab.CONSOLE_JUNK)} OR {has('w', ['ring'])} THEN 'not_a_copy'
  WHEN ({PARTS}) AND NOT {has('w', vocab.CONSOLE_WORDS)} THEN 'not_a_copy'
  WHEN price IS NULL THEN 'no_price' WHEN link IS NULL THEN 'no_link' END AS reason FROM worded)
SELECT title, site, reason, count(*) AS n FROM r GROUP BY ALL""",
}
