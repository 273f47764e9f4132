"""SQL twins of the exact matching queries."""

from oracle.titles import HEAD, numerals, quoted  # noqa: F401
from titletide import vocab


def normalised(column: str) -> str:
    return numerals(f"trim(regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))", vocab.ROMAN_NUMERALS)


STOP = quoted(vocab.STOPWORDS)
FOUR = r"'^(\S+) (\S+) (\S+) (\S+)'"
LIBRARY = f"""titles AS (
  SELECT regexp_extract(text, {FOUR}, 1) || ' ' || regexp_extract(text, {FOUR}, 2) || ': '
    || regexp_extract(text, {FOUR}, 3) || ' ' || regexp_extract(text, {FOUR}, 4) AS title FROM benchmark
  WHERE regexp_extract(text, {FOUR}, 1) <> ''
  UNION SELECT regexp_extract(text, '^(\\S+ \\S+ \\S+) ', 1) FROM documents JOIN labels USING (doc_id)
    WHERE toxic = 1 AND regexp_extract(text, '^(\\S+ \\S+ \\S+) ', 1) <> ''
  UNION SELECT upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1])
    || split_part(p_name, ' ', 2)[2:] FROM part),
normed AS (SELECT title, {normalised('title')} AS norm FROM titles),
lib AS (SELECT norm, min(title) AS title FROM normed WHERE norm <> '' AND norm NOT IN ({quoted(vocab.NOT_TITLES)})
  GROUP BY norm),
tok AS (SELECT norm, unnest(list_distinct(string_split(norm, ' '))) AS token FROM lib WHERE length(norm) >= 8),
df AS (SELECT token, count(*) AS n FROM tok GROUP BY token),
rare AS (SELECT token FROM df WHERE n <= (SELECT greatest(30, count(*) // 100) FROM lib WHERE length(norm) >= 8)
  AND token NOT IN ({STOP})),
half0 AS (SELECT title, {normalised("regexp_extract(title, '^([^:]*):', 1)")} AS gram FROM titles WHERE title LIKE '%:%'
  UNION ALL SELECT title, {normalised("regexp_extract(title, '^[^:]*:(.*)$', 1)")} FROM titles WHERE title LIKE '%:%'),
half AS (SELECT gram, min(title) AS title FROM half0 WHERE length(gram) >= 8
    AND gram NOT IN ({quoted(vocab.GENERIC_HALVES)}) AND gram NOT IN ({quoted(vocab.TITLE_ALIASES)})
    AND gram NOT IN (SELECT norm FROM lib) GROUP BY gram HAVING count(DISTINCT title) = 1),
dict AS (
  SELECT norm AS gram, title, 100::BIGINT AS score, 'exact' AS method, norm NOT LIKE '% %' AND norm NOT IN
    ({quoted(vocab.DISTINCTIVE_SHORT)}) AND (regexp_matches(norm, '^[0-9]+$') OR NOT regexp_matches(norm, '[0-9]'))
    AS needs_context FROM lib WHERE length(norm) < 8
  UNION ALL SELECT norm, title, 100, 'fuzzy', false FROM lib WHERE length(norm) >= 8
    AND len(string_split(norm, ' ')) >= 2
    AND len(list_filter(string_split(norm, ' '), lambda t: t NOT IN ({STOP}))) > 0
  UNION ALL SELECT gram, title, 92, 'variant', true FROM half
    WHERE len(list_filter(string_split(gram, ' '), lambda t: t IN (SELECT token FROM rare))) > 0)"""
LIBRARY = LIBRARY.replace(
    "WHERE len(list_filter(string_split(gram, ' '), lambda t: t IN (SELECT token FROM rare))) > 0",
    "WHERE EXISTS (SELECT 1 FROM (SELECT unnest(string_split(gram, ' ')) AS w) x JOIN rare ON rare.token = x.w)")
LEFT, RIGHT = r"(?:^|[^\p{L}\p{N}\p{M}_])", r"(?:$|[^\p{L}\p{N}\p{M}_])"
CONTEXT = f"regexp_matches(text, '(?i){LEFT}(?:ps2|ps 2|playstation ?2|pcsx2){RIGHT}')"
STOP_LIST = f"[{STOP}]"
LOOKALIKE = " OR ".join(
    f"(norm = '{known}' AND regexp_matches(' ' || gram || ' ', ' (?:{'|'.join(others)}) '))" for known, others in vocab.LOOKALIKES.items())
# The longest common subsequence, row by row: the rows and the letters of the other text travel as lists of numbers.
COMMON = """list_last(list_reduce(list_concat([list_transform(range(len(a) + 1), lambda x: 0::BIGINT)],
    list_transform(b, lambda c: [unicode(c)::BIGINT])), lambda above, c: list_reduce(
        list_concat([[0::BIGINT]], list_transform(range(1, len(a) + 1), lambda i: [i::BIGINT])),
        lambda row, i: list_append(row, CASE WHEN a[i[1]] = c[1] THEN above[i[1]] + 1 ELSE greatest(row[i[1]], above[i[1] + 1]) END))))"""


def letters(column: str) -> str:
    """A bit for each kind of letter that a text has."""
    return f"list_aggregate(list_transform(string_split({column}, ''), lambda c: 1::UBIGINT << (unicode(c) % 63)::UBIGINT), 'bit_or')"


def found(t: str, source: str) -> str:
    """Exact occurrences in ``source``, a query of doc, text and platform; its CTEs end in ``t``."""
    return f"""docs{t} AS (SELECT doc, text, platform OR {CONTEXT} AS context, string_split({normalised('text')}, ' ') AS t FROM ({source})),
reach{t} AS (SELECT greatest(6, max(len(string_split(gram, ' ')))) AS reach FROM dict),
pos{t} AS (SELECT doc, context, unnest(range(0, len(t))) AS start, unnest(list_transform(range(0, len(t)), lambda i: t[i + 1:i + reach])) AS w
  FROM docs{t}, reach{t} WHERE t <> ['']),
gram{t} AS (SELECT doc, context, start, n, array_to_string(w[1:n], ' ') AS gram
  FROM pos{t}, (SELECT unnest(range(1, reach + 1)) AS n FROM reach{t}) WHERE n <= len(w)),
found{t} AS (SELECT doc, title, method, gram, start, score FROM gram{t} JOIN dict USING (gram) WHERE NOT needs_context OR context)"""


def near(t: str, threshold: int) -> str:
    """Inexact occurrences in the same texts."""
    return f"""long{t} AS (SELECT norm, title, list_transform(string_split(norm, ''), lambda c: unicode(c)::BIGINT) AS a,
    string_split(norm, ' ') AS named, {letters('norm')} AS norm_letters FROM lib WHERE length(norm) >= 8),
run{t} AS (SELECT * FROM gram{t} WHERE n >= 2 AND length(gram) >= 8 AND len(list_filter(string_split(gram, ' '), lambda w: NOT list_contains({STOP_LIST}, w))) > 0
    AND n <= (SELECT greatest(6, max(len(named))) FROM long{t})),
pair{t} AS (SELECT gram, norm, title, a, named, string_split(gram, '') AS b
  FROM (SELECT gram, length(gram) AS size, {letters('gram')} AS gram_letters FROM (SELECT DISTINCT gram FROM run{t})) JOIN long{t}
  ON 200 * least(size, length(norm)) >= {threshold} * (size + length(norm))
  -- a letter put in or left out changes one bit at most
  WHERE bit_count(xor(gram_letters, norm_letters)) <= floor({(100 - threshold) / 100} * (size + length(norm)) + 1e-9)
    AND levenshtein(gram, norm) <= floor({(100 - threshold) / 100} * (size + length(norm)) + 1e-9)
    + octet_length(encode(gram)) - size + octet_length(encode(norm)) - length(norm)),
ratio{t} AS (SELECT gram, norm, title, named, 200.0::DOUBLE * {COMMON} / (len(a) + len(b)) AS ratio FROM pair{t}),
best{t} AS (SELECT doc, start, gram, t, norm, title, named, ratio FROM run{t} JOIN ratio{t} USING (gram) JOIN docs{t} USING (doc)
  WHERE ratio >= {threshold} AND len(list_filter(named, lambda w: NOT list_contains({STOP_LIST}, w) AND list_contains(t, w))) > 0
  QUALIFY row_number() OVER (PARTITION BY doc, start, gram ORDER BY ratio DESC, title) = 1),
near{t} AS (SELECT doc, title, 'fuzzy' AS method, gram, start, round_even(ratio, 0) AS score
  FROM (SELECT *, string_split(gram, ' ') AS spoken FROM best{t})
  WHERE gram <> norm AND len(list_filter(named, lambda w: regexp_matches(w, '[0-9]') AND NOT list_contains(t, w))) = 0 AND NOT ({LOOKALIKE})
    AND NOT (regexp_matches(named[-1], '^[0-9]+$') AND len(list_filter(spoken, lambda w: regexp_matches(w, '^[0-9]+$'))) = 0)
    AND NOT (len(named) > 1 AND ((list_contains({STOP_LIST}, spoken[1]) AND spoken[1] <> named[1])
                                 OR (list_contains({STOP_LIST}, spoken[-1]) AND spoken[-1] <> named[-1]))))"""


RANK = "list_position(['alias', 'exact', 'variant', 'fuzzy'], method)"


def standing(t: str, rows: str) -> str:
    """The claims of occurrences that stand: one spelling for each text and title, none inside a longer exact claim."""
    return f"""occ{t} AS (SELECT DISTINCT doc, title, {normalised('title')} AS norm, method, gram, start, start + len(string_split(gram, ' ')) AS stop, score FROM {rows}),
claim{t} AS (SELECT *, row_number() OVER () AS id FROM occ{t}
  QUALIFY dense_rank() OVER (PARTITION BY doc, norm ORDER BY {RANK}, score DESC, length(gram) DESC, gram) = 1),
shift{t} AS (SELECT id, doc, norm, start, stop, string_split(norm, ' ') AS named, string_split(gram, ' ') AS run,
    unnest(range(0, greatest(len(string_split(norm, ' ')) - (stop - start), 0) + 1)) AS o
  FROM claim{t} WHERE method <> 'fuzzy' OR score = 100),
spelt{t} AS (SELECT s.*, t,
    list_max(list_filter(range(0, least(start, o) + 1), lambda k: k = 0 OR t[start - k + 1:start] = named[o - k + 1:o])) AS l,
    list_max(list_filter(range(0, least(len(t) - stop, len(named) - o - len(run)) + 1),
                         lambda k: k = 0 OR t[stop + 1:stop + k] = named[o + len(run) + 1:o + len(run) + k])) AS r
  FROM shift{t} s JOIN docs{t} USING (doc) WHERE named[o + 1:o + len(run)] = run),
widest{t} AS (SELECT id, start - l AS a, stop + r AS b FROM spelt{t} QUALIFY row_number() OVER (PARTITION BY id ORDER BY l + r DESC, o) = 1),
wide{t} AS (SELECT DISTINCT doc, norm, coalesce(a, start) AS a, coalesce(b, stop) AS b
  FROM claim{t} LEFT JOIN widest{t} USING (id) WHERE method <> 'fuzzy' OR score = 100),
inside{t} AS (SELECT DISTINCT c.id FROM claim{t} c JOIN wide{t} w ON c.doc = w.doc AND c.norm <> w.norm
  AND w.a <= c.start AND c.stop <= w.b AND w.b - w.a > c.stop - c.start),
stands{t} AS (SELECT doc, title, norm, method, gram, start, score FROM claim{t}
  QUALIFY bool_and(id IN (SELECT id FROM inside{t})) OVER (PARTITION BY doc, norm) = false)"""


def ranked(t: str) -> str:
    """Each text's titles, the lead one first."""
    return f"""SELECT doc, title, max(score)::INT AS score, min(method) AS method,
    row_number() OVER (PARTITION BY doc ORDER BY min({RANK}), max(score) DESC, max(length(gram)) DESC, min(gram), title) AS position
  FROM stands{t} GROUP BY doc, title"""


WHOLE = "SELECT doc_id AS doc, text, source = 'src1' AS platform FROM documents"
ITEMS = f"""items AS (SELECT doc_id AS doc, {HEAD} AS headline, CASE WHEN text LIKE '%' || chr(10) || '%'
    THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body, source = 'src1' AS platform FROM documents)"""
FOUND = LIBRARY + ", " + found("", WHOLE)

SQL = {
    "title_dictionary": f"WITH {LIBRARY} SELECT * FROM dict",
    "dictionary_matches": f"WITH {FOUND} SELECT doc, title, method, gram, start FROM found",
    "fuzzy_matches": f"WITH {FOUND}, {near('', 88)} SELECT doc, title, score, gram, start::INT AS start FROM near",
    "exact_claims": f"WITH {FOUND}, {standing('', 'found')} SELECT DISTINCT doc, title, method FROM stands",
    "match_items": f"""WITH {LIBRARY}, {ITEMS},
      {found('1', 'SELECT doc, headline AS text, platform FROM items')}, {near('1', 88)},
      all1 AS (SELECT * FROM found1 UNION ALL SELECT * FROM near1), {standing('1', 'all1')}, heads AS ({ranked('1')}),
      quiet AS (SELECT * FROM items WHERE doc NOT IN (SELECT doc FROM heads)
        AND (platform OR {CONTEXT.replace('(text,', "(concat_ws(' ', headline, body),")})),
      {found('2', 'SELECT doc, body AS text, platform FROM quiet')}, {near('2', 93)},
      all2 AS (SELECT * FROM found2 UNION ALL SELECT * FROM near2), {standing('2', 'all2')}, bodies AS ({ranked('2')})
      SELECT *, 'title' AS matched_in FROM heads UNION ALL SELECT *, 'body' FROM bodies""",
    "matcher_eval": f"""WITH {FOUND}, {standing('', 'found')},
      good AS (SELECT doc_id AS doc FROM labels WHERE quality = 1),
      expected AS (SELECT DISTINCT doc, title FROM found JOIN good USING (doc) WHERE method = 'fuzzy'),
      named AS (SELECT DISTINCT doc, title FROM stands JOIN good USING (doc)),
      judged AS (SELECT doc, e.title IS NOT NULL AS wanted, n.title IS NOT NULL AS got
        FROM expected e FULL JOIN named n USING (doc, title)),
      bad AS (SELECT doc FROM judged GROUP BY doc HAVING NOT bool_and(wanted AND got)),
      sums AS (SELECT count_if(wanted AND got) AS hits, count_if(wanted AND NOT got) AS misses, count_if(NOT wanted) AS spurious FROM judged)
      SELECT (SELECT count(*) FROM good) AS items, (SELECT count(*) FROM good WHERE doc NOT IN (SELECT doc FROM bad)) AS exact,
        hits, misses, spurious, round(CASE WHEN hits + spurious = 0 THEN 1.0 ELSE hits / (hits + spurious) END, 6)::DOUBLE AS precision,
        round(CASE WHEN hits + misses = 0 THEN 1.0 ELSE hits / (hits + misses) END, 6)::DOUBLE AS recall FROM sums""",
    "repeat_offenders": f"""WITH {FOUND}, {standing('', 'found')}
      SELECT title, count(DISTINCT doc) AS n FROM stands JOIN labels ON doc_id = doc WHERE quality = 1 GROUP BY title HAVING n > 1""",
}
