"""SQL twins of the text and title queries."""

from oracle import prices
from titletide import vocab


def words(column: str) -> str:
    plain = f"regexp_replace(lower(strip_accents({column})), '[''’`]', '', 'g')"
    return f"trim(regexp_replace({plain}, '[^a-z0-9]+', ' ', 'g'))"


def numerals(column: str, table) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"array_to_string(list_transform(string_split({column}, ' '), lambda t: CASE t {cases} ELSE t END), ' ')"


def without(column: str, word: str) -> str:
    return f"array_to_string(list_filter(string_split({column}, ' '), lambda t: t <> '{word}'), ' ')"


def quoted(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def squash(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


NORMALISED = numerals("trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))", vocab.ROMAN_NUMERALS)
LEFT, RIGHT = r"(?:^|[^\p{L}\p{N}\p{M}_])", r"(?:$|[^\p{L}\p{N}\p{M}_])"
STRONG = LEFT + "(?:remaster|remake|reboot|reviv|hd version|director[''’]s cut|re-?release)"
WEAK = LEFT + "(?:(?:collections?|ports?|ported|returns?)" + RIGHT + "|enhanced)"
CONTEXT = LEFT + "(?:ps2|ps 2|playstation ?2|pcsx2)" + RIGHT
stems = lambda s: "^(?:" + "|".join(s) + ")"
HEAD = "split_part(text, chr(10), 1)"

INVERTED = r"^([^:]+?),\s*(The|A|An)(:.*)?$"


def readable(c: str) -> str:
    return (f"CASE WHEN regexp_matches(trim({c}), '{INVERTED}') THEN regexp_replace(trim({c}), '{INVERTED}', '\\2 \\1\\3') "
            f"ELSE trim({c}) END")


FILED = """filed AS (SELECT p_partkey, p_name, p_size, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' ||
    upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:]
    || CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN ' II' WHEN 2 THEN ' IV' WHEN 3 THEN ' X' ELSE ' 2' END
    || CASE WHEN p_size > 25 THEN ', The' ELSE '' END || ': ' || upper(p_type[1]) || lower(p_type[2:])
    || CASE WHEN p_size > 40 THEN ' [Demo]' ELSE '' END AS title FROM part)"""
BARE = r"regexp_replace(title, '\s*\[[^\]]*\]', '', 'g')"
FORMS = FILED + f""", r AS (SELECT *, {readable('title')} AS readable, {readable(BARE)} AS clean FROM filed),
k AS (SELECT *, {words('readable')} AS key FROM r),
q AS (SELECT *, CASE WHEN regexp_matches(readable, '(?i)^(?:the|a|an)\\s') AND {without('key', 'and')} LIKE '% %'
    THEN regexp_replace({without('key', 'and')}, '^[^ ]+ ', '') ELSE {without('key', 'and')} END AS bare FROM k),
n AS (SELECT *, {numerals('bare', vocab.LISTING_NUMERALS)} AS name FROM q)"""

SPELL = """keys AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN b || ' of ' || a WHEN 1 THEN a || b
    WHEN 2 THEN a || ' ' || b || ' 04' ELSE a || ' ' || b || ' 4' END AS key
  FROM (SELECT p_size, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
  UNION SELECT DISTINCT p_name FROM part),
marked AS (SELECT key, 'l' || array_to_string(list_sort(list_filter(string_split(replace(key, '04', '4'), ' '),
    lambda t: t <> 'of')), ' ') AS shared FROM keys UNION ALL SELECT key, 'c' || replace(key, ' ', '') FROM keys),
hub AS (SELECT shared, min(key) AS b FROM marked GROUP BY shared),
edge AS (SELECT DISTINCT key AS a, b FROM marked JOIN hub USING (shared)),
link AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(key, other) AS (SELECT key, key FROM keys UNION SELECT reach.key, link.b FROM reach JOIN link ON link.a = reach.other),
roots AS (SELECT key, min(other) AS root FROM reach GROUP BY key)"""

GROUPS = "grp AS (SELECT DISTINCT p_brand AS title, 'g' || p_brand[-1] AS root FROM part)"
COPIES = """latest AS (SELECT title, site, arg_max(copies, period) AS copies, arg_max(median, period) AS median FROM hist
  GROUP BY ALL)"""
LIB = """names AS (SELECT DISTINCT p_name AS name FROM part),
lib AS (SELECT name AS other FROM names UNION SELECT p_name || ' ' || lower(p_type) ||
    CASE WHEN p_size > 25 THEN ' edition' ELSE '' END FROM part
  UNION SELECT lower(p_type) || ' ' || p_name FROM part WHERE p_size <= 10)"""



def merged(t: str, flagged: str) -> str:
    """Outcomes of a merge by first figures; ``flagged`` lists the titles that the audit keeps apart."""
    return f"""m{t} AS (SELECT t.*, root, coalesce(max(copies) FILTER (site = 'US'), 0) AS us, coalesce(max(copies) FILTER (site = 'UK'), 0) AS uk,
    count(site) FILTER (site IN ('US', 'UK')) > 0 AND level <> 'surging' AS open
  FROM t JOIN grp USING (title) LEFT JOIN firsts USING (title) GROUP BY title, level, pinned, mentions, root),
k{t} AS (SELECT root, title AS kt, us AS kus, uk AS kuk FROM m{t} WHERE open
  QUALIFY row_number() OVER (PARTITION BY root ORDER BY pinned DESC, us + uk DESC, length(title), title DESC) = 1),
j{t} AS (SELECT title, kt, CASE WHEN n = 1 THEN 'kept' WHEN kt IS NULL THEN 'apart' WHEN title = kt THEN 'kept'
    WHEN pinned OR level = 'surging' OR us > kus OR uk > kuk OR title IN ({flagged}) THEN 'apart' ELSE 'dropped' END AS outcome
  FROM m{t} JOIN (SELECT root, count(*) AS n FROM m{t} GROUP BY root) USING (root) LEFT JOIN k{t} USING (root))"""


SQL = {
    "audited_merge": f"""WITH {prices.HISTORY}, {COPIES}, {GROUPS},
firsts AS (SELECT title, site, arg_min(copies, period) AS copies FROM hist GROUP BY ALL),
t AS (SELECT p_brand AS title, CASE sum(p_size) % 4 WHEN 0 THEN 'dormant' WHEN 1 THEN 'surging' WHEN 2 THEN 'normal'
    ELSE 'staple' END AS level, min(p_size) > 1 AS pinned, count(*) AS mentions FROM part GROUP BY p_brand),
{merged('1', "SELECT NULL WHERE false")},
bad AS (SELECT DISTINCT j1.title FROM j1 JOIN latest a ON a.title = j1.title AND a.site IN ('US', 'UK')
  JOIN latest b ON b.title = kt AND b.site = a.site WHERE outcome = 'dropped' AND a.copies >= b.copies + 3 AND a.copies >= b.copies * 1.5),
{merged('2', 'SELECT title FROM bad')}
SELECT title, CASE WHEN outcome = 'dropped' THEN kt END AS keeper, outcome FROM j2""",
    "text_forms": f"""SELECT doc_id, md5({NORMALISED}) AS normalised, md5({words('text')}) AS words,
  md5({numerals(without(words('text'), 'and'), vocab.LISTING_NUMERALS)}) AS name_words FROM documents""",
    "text_tone": f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM t),
n AS (SELECT *, coalesce(max(w IN ({quoted(vocab.NEGATORS)})) OVER (PARTITION BY doc_id ORDER BY i
    ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS neg FROM u),
p AS (SELECT doc_id, sum(CASE WHEN regexp_matches(w, '{stems(vocab.POSITIVE_STEMS)}') THEN CASE WHEN neg THEN -10 ELSE 10 END
    WHEN regexp_matches(w, '{stems(vocab.NEGATIVE_STEMS)}') THEN CASE WHEN neg THEN 15 ELSE -15 END ELSE 0 END) AS pts,
    count(*) FILTER (regexp_matches(w, '{stems(vocab.HYPE_STEMS)}')) AS hype FROM n GROUP BY doc_id)
SELECT d.doc_id, CAST(least(100, greatest(10, 50 + coalesce(pts, 0))) AS BIGINT) AS tone, coalesce(hype, 0) AS hype,
  regexp_matches(text, '(?i){STRONG}') OR (coalesce(quality = 1, false) AND regexp_matches(text, '(?i){WEAK}')) AS remaster,
  regexp_matches(text, '(?i){CONTEXT}') AS context
FROM documents d LEFT JOIN p USING (doc_id) LEFT JOIN labels USING (doc_id)""",
    "headline_forms": f"""WITH h AS (SELECT doc_id, {HEAD} AS h, {squash(HEAD)} AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) <= 160 THEN s ELSE regexp_replace(s[1:160], ' [^ ]*$', '') || '…' END AS short,
  trim(regexp_replace(lower(h), '[^a-z0-9 ]+', '', 'g')) AS key,
  md5(array_to_string(list_sort(list_distinct(list_filter(string_split({words('h')}, ' '), lambda t: t <> ''))), ' '))
    AS story FROM h""",
    "page_text": f"""WITH b AS (SELECT page_id, html, {squash("regexp_replace(html, '<[^>]+>', ' ', 'g')")} AS body FROM pages),
p AS (SELECT page_id, body, replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(
    replace(html, '<wbr>', ''), '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'),
    '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS t FROM b)
SELECT page_id, md5(body) AS body, md5(array_to_string(list_filter(list_transform(string_split(replace(t, chr(13), chr(10)),
    chr(10)), lambda x: {squash('x')}), lambda x: x <> ''), chr(10))) AS post,
  md5(array_to_string(string_split(body, ' ')[1:120], ' ')) AS lead FROM p""",
    "title_forms": f"""WITH {FORMS} SELECT p_partkey, clean, readable, key, name,
  array_to_string(list_sort(list_filter(string_split(name, ' '), lambda t: t NOT IN ({quoted(vocab.LOOSE_STOP)}))), ' ')
    AS loose, CASE WHEN name <> bare THEN bare || '|' || name ELSE bare END AS queries FROM n""",
    "library": f"""WITH {FORMS}, f AS (SELECT DISTINCT clean FROM n WHERE p_size > 10)
SELECT title, (SELECT count(*) FROM f) >= 500 AS cacheable FROM (
  SELECT clean AS title FROM n WHERE p_size > 5 UNION SELECT p_name FROM part)""",
    "siblings": f"""WITH {LIB}, c AS (SELECT name, other, trim(split_part(' ' || other || ' ', ' ' || name || ' ', 1)) AS b,
    trim((' ' || other || ' ')[position(' ' || name || ' ' IN ' ' || other || ' ') + length(name) + 2:]) AS a
  FROM names JOIN lib ON other <> name AND contains(' ' || other || ' ', ' ' || name || ' ')),
e AS (SELECT *, len(list_filter(string_split(a, ' '), lambda t: t <> '' AND t NOT IN ({quoted(vocab.EDITION_WORDS)}))) > 0
  AS extra, len(list_filter(string_split(b, ' '), lambda t: t <> '' AND t NOT IN ({quoted(vocab.BRAND_WORDS)}))) > 0
  AS front FROM c)
SELECT name AS title, name, other AS sibling FROM e WHERE extra OR front""",
    "renames": """SELECT DISTINCT p_name AS name, 'UK' AS site, CASE WHEN p_name LIKE '%ring' THEN p_name || ' zero'
  ELSE 'project ' || p_name END AS renamed FROM part""",
    "group_roots": f"WITH RECURSIVE {SPELL} SELECT key, root FROM roots",
    "title_groups": f"""WITH RECURSIVE {SPELL}, w AS (SELECT key, unnest(list_distinct(string_split(key, ' '))) AS w FROM keys),
used AS (SELECT w, least(count(*), 3) AS n FROM w GROUP BY w),
rare AS (SELECT key, min(n) AS rarest FROM w JOIN used USING (w) GROUP BY key),
r AS (SELECT key, root, row_number() OVER (PARTITION BY root ORDER BY rarest DESC, length(key), key DESC) AS rk,
    count(*) OVER (PARTITION BY root) AS n FROM roots JOIN rare USING (key)),
shown AS (SELECT root, key AS shown FROM r WHERE rk = 1 AND n > 1)
SELECT key, shown FROM r JOIN shown USING (root) WHERE key <> shown""",
    "brand_components": """WITH n AS (SELECT c_name AS key, floor(c_acctbal / 100) AS v, c_nationkey AS k FROM customer
  UNION ALL SELECT s_name, floor(s_acctbal / 100), s_nationkey FROM supplier)
SELECT key, min(key) OVER (PARTITION BY v, k) AS root FROM n""",
    "spelling_merge": f"""WITH {prices.HISTORY}, {COPIES}, {GROUPS},
t AS (SELECT p_brand AS title, CASE sum(p_size) % 4 WHEN 0 THEN 'dormant' WHEN 1 THEN 'surging' WHEN 2 THEN 'normal'
    ELSE 'staple' END AS level, min(p_size) > 1 AS pinned, count(*) AS mentions FROM part GROUP BY p_brand),
m AS (SELECT t.*, root, coalesce(max(copies) FILTER (site = 'US'), 0) AS us, coalesce(max(copies) FILTER (site = 'UK'), 0) AS uk,
    count(site) FILTER (site IN ('US', 'UK')) > 0 AND level <> 'surging' AS open
  FROM t JOIN grp USING (title) LEFT JOIN latest USING (title) GROUP BY title, level, pinned, mentions, root),
k0 AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY pinned DESC, us + uk DESC, length(title), title DESC) AS rk
  FROM m WHERE open), k AS (SELECT root, title AS kt, us AS kus, uk AS kuk FROM k0 WHERE rk = 1),
s AS (SELECT root, count(*) AS n FROM m GROUP BY root),
j AS (SELECT m.*, kt, CASE WHEN n = 1 THEN 'kept' WHEN kt IS NULL THEN 'apart' WHEN title = kt THEN 'kept'
    WHEN pinned OR level = 'surging' OR us > kus OR uk > kuk THEN 'apart' ELSE 'dropped' END AS outcome
  FROM m JOIN s USING (root) LEFT JOIN k USING (root)),
p AS (SELECT kt AS title, sum(mentions) AS more, bool_or(level <> 'dormant') AS faster FROM j WHERE outcome = 'dropped'
  GROUP BY kt)
SELECT j.title, CASE WHEN outcome = 'dropped' THEN kt END AS keeper, outcome,
  CASE WHEN level = 'dormant' AND coalesce(faster, false) THEN 'normal' ELSE level END AS level,
  CAST(mentions + coalesce(more, 0) AS BIGINT) AS mentions FROM j LEFT JOIN p ON p.title = j.title""",
    "spelling_audit": f"""WITH {prices.HISTORY}, {COPIES}, {GROUPS},
k AS (SELECT root, min(title) AS keeper FROM grp GROUP BY root)
SELECT g.title AS spelling, keeper, a.site, a.copies, a.median, b.copies AS keeper_copies, b.median AS keeper_median,
  CASE WHEN b.copies IS NULL THEN 'no figure' WHEN a.copies >= b.copies + 3 AND a.copies >= b.copies * 1.5 THEN 'FLAGGED'
    ELSE 'agrees' END AS verdict
FROM grp g JOIN k USING (root) JOIN latest a ON a.title = g.title AND a.site IN ('US', 'UK')
LEFT JOIN latest b ON b.title = keeper AND b.site = a.site WHERE g.title <> keeper""",
    "genre_votes": """WITH v AS (SELECT p_name AS key, CASE p_type WHEN 'ECONOMY' THEN 'Racing' WHEN 'SMALL' THEN 'Racing'
    WHEN 'MEDIUM' THEN 'Puzzle & party' WHEN 'LARGE' THEN 'Music & dance' WHEN 'PROMO' THEN 'Other' ELSE 'Shooter' END AS genre,
    p_partkey FROM part),
c AS (SELECT key, genre, count(*) AS n, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(p_partkey)) AS rk
  FROM v GROUP BY key, genre)
SELECT key, genre, n FROM c WHERE rk = 1""",
    "keyword_genres": f"""WITH w AS (SELECT doc_id, {words('text')} AS w FROM documents)
SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(w, '{p}') THEN '{g}'" for g, p in vocab.GENRE_KEYWORDS)} END AS genre
FROM w""",
    "extra_titles": """SELECT DISTINCT p_name AS title, p_name AS key, p_name AS name, 'underrated' AS level FROM part
WHERE p_size < 10 AND p_name NOT IN (SELECT p_name FROM part WHERE p_size > 49)""",
    "collection_keys": """SELECT DISTINCT p_name AS name, p_name AS title FROM part
WHERE p_size < 25 AND p_name NOT LIKE 'old%'""",
    "listed_places": """SELECT 'PAL' AS list, p_partkey AS rank, p_name AS title,
  CASE WHEN p_size <= 40 AND (p_name LIKE '%ring' OR p_name LIKE 'hot%') THEN upper(p_name[1]) || split_part(p_name, ' ', 1)[2:]
    || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] ELSE p_name END AS placed,
  p_size <= 40 AND (p_name LIKE '%ring' OR p_name LIKE 'hot%') AS matched FROM part""",
    "fresh_labels": f"""WITH h AS (SELECT doc_id, {HEAD} AS headline, source,
    trim(regexp_replace(lower({HEAD}), '[^a-z0-9 ]+', '', 'g')) AS key FROM documents),
o AS (SELECT * FROM h WHERE doc_id IN (SELECT doc_id FROM labels)),
f AS (SELECT key, min((headline, source)) AS r FROM h WHERE key NOT IN (SELECT key FROM o) GROUP BY key)
SELECT false AS fresh, source, count(*) AS n FROM o GROUP BY source
UNION ALL SELECT true, r[2], count(*) FROM f GROUP BY r[2]""",
    "lost_mentions": """SELECT p_name, count(*) AS n FROM part WHERE p_size >= 30 GROUP BY p_name""",
}
