"""SQL twins of the queries that SQL can express."""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SQL = {
    "op1_exact_dedup": f"""
        WITH low AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
        FROM low WINDOW same AS (PARTITION BY body)
    """,
    # The table of the checksum follows from its rule: eight shifts of each byte, with 0xEDB88320 where a bit falls out.
    "op2_sharding": """
        WITH steps AS (
            SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b::UBIGINT], range(8)::UBIGINT[]),
                lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS step
        ), read AS (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, hex(encode(coalesce(text, ''))) AS digits
            FROM documents
        ), sized AS (
            SELECT doc_id, size, xor(4294967295::UBIGINT, list_reduce(
                list_concat([4294967295::UBIGINT], list_transform(regexp_extract_all(digits, '..'),
                    lambda pair: ('0x' || pair)::UBIGINT)),
                lambda c, b: xor(c >> 8, step[((xor(c, b) & 255) + 1)::BIGINT])))::BIGINT AS text_crc32
            FROM read, steps
        ), summed AS (
            SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto,
                   sum(size) OVER () AS whole
            FROM sized
        ), cut AS (
            SELECT doc_id, size, text_crc32, ((2 * upto - size) * 24 // (2 * whole))::INT AS shard FROM summed
        )
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot,
               NULL::INT AS grown_shard
        FROM cut
    """,
    "op6_repeated_passages": """
        WITH read AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits, octet_length(encode(coalesce(text, ''))) AS n FROM documents
        ), pieces AS (  -- of 200 bytes and what the last string needs beyond them
            SELECT doc_id, n, part, substr(digits, 400 * part + 1, 498) AS piece
            FROM (SELECT *, unnest(range((n - 50) // 200 + 1)) AS part FROM read WHERE n >= 50)
        ), strings AS (
            SELECT doc_id, 200 * part + inside AS place, substr(piece, 2 * inside + 1, 100) AS string
            FROM (SELECT *, unnest(range(least(200, n - 49 - 200 * part))) AS inside FROM pieces)
        ), firsts AS (
            SELECT string, min(doc_id) AS first_doc FROM strings GROUP BY string HAVING count(*) > 1
        ), again AS (
            SELECT doc_id, place, coalesce(place - lag(place) OVER (PARTITION BY doc_id ORDER BY place) > 50, true) AS new
            FROM strings JOIN firsts USING (string) WHERE first_doc < doc_id
        ), runs AS (
            SELECT doc_id, place, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM again
        ), spans AS (
            SELECT doc_id, min(place) AS low, max(place) + 50 AS high FROM runs GROUP BY doc_id, run
        ), ordered AS (
            SELECT *, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before FROM spans
        ), cut AS (
            SELECT doc_id, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans, max(high) AS rest,
                   string_agg(substr(digits, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS kept
            FROM ordered JOIN read USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(digits, 2 * coalesce(rest, 0) + 1))) AS kept_sha256
        FROM read LEFT JOIN cut USING (doc_id)
    """,
    "op8_embedding_dedup": """
        WITH RECURSIVE read AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS one, b.vec_id AS other FROM read a JOIN read b
            ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
        ), reached AS (
            SELECT vec_id AS one, vec_id AS other FROM embeddings
            UNION SELECT reached.one, links.other FROM reached JOIN links ON links.one = reached.other
        ), lowest AS (
            SELECT one AS vec_id, min(other) AS component_id FROM reached GROUP BY one
        )
        SELECT vec_id, (SELECT count(*) FROM links WHERE one = vec_id) AS n_links, component_id,
               vec_id = component_id AS kept
        FROM lowest
    """,
    "op11_hard_negatives": """
        WITH read AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
            FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
                   list_inner_product(a.x, b.x)::BIGINT AS score
            FROM read a JOIN read b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
        ), positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT anchor_id, positive_id, row_number() OVER near AS rank, other_id AS negative_id, positive_score,
               score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW near AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
        QUALIFY rank <= 3
    """,
    "op12_repeated_phrases": r"""
        WITH read AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), windows AS (
            SELECT doc_id, place, array_to_string(words[place:place + 34], ' ') AS run
            FROM (SELECT *, unnest(range(1, len(words) - 33)) AS place FROM read WHERE len(words) >= 35)
        ), again AS (
            SELECT doc_id, place FROM windows JOIN (SELECT run FROM windows GROUP BY run HAVING count(*) > 1) USING (run)
        ), each AS (
            SELECT doc_id, words[place] AS word, place
            FROM (SELECT *, unnest(range(1, len(words) + 1)) AS place FROM read)
        ), judged AS (
            SELECT e.doc_id, word, e.place,
                   coalesce(e.place - max(a.place) OVER (PARTITION BY e.doc_id ORDER BY e.place) < 35, false) AS gone
            FROM each e LEFT JOIN again a ON a.doc_id = e.doc_id AND a.place = e.place
        ), kept AS (
            SELECT doc_id, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS kept
            FROM judged GROUP BY doc_id
        )
        SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM read LEFT JOIN kept USING (doc_id)
    """,
}
