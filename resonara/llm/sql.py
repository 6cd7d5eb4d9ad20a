"""DuckDB SQL for the corpus operators that SQL can express."""

EXACT_SQL = r"""
WITH n AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS norm FROM documents),
     r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) AS k FROM n)
SELECT doc_id, text, lang, source, n_chars FROM r WHERE k = 1 OR norm IS NULL
"""

#: The inverse Poisson distribution as a running sum over 0 .. 200: means are below 20 here.
MIX_SQL = """
WITH m AS (SELECT source AS src, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS mass FROM documents GROUP BY 1),
     t AS (SELECT sum(mass) AS all_mass, sum(pow(mass, 0.5)) AS all_wanted FROM m),
     r AS (SELECT src, pow(mass, 0.5) / all_wanted * all_mass / mass AS rate FROM m, t WHERE mass > 0),
     p AS (SELECT src, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM r, (SELECT unnest(range(0, 201)) AS k)),
     c AS (SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS c FROM p),
     u AS (SELECT *, CAST(('0x' || substr(md5('20240|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|1'), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
     n AS (SELECT doc_id, text, lang, source, n_chars, (SELECT count(*) FROM c WHERE c.src IS NOT DISTINCT FROM u.source AND c.c <= u.u) AS n FROM u)
SELECT doc_id, text, lang, source, n_chars, CAST(i AS INTEGER) AS copy_index
FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM n WHERE n > 0)
"""

#: BM25 with whole-number weights over all documents.
TOP_K_SQL = r"""
WITH b AS (SELECT item_id, text, CAST(row_number() OVER (PARTITION BY item_id ORDER BY text) AS INTEGER) AS query_no FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
     q AS (SELECT item_id, query_no, t AS term, count(*) AS qtf FROM (SELECT item_id, query_no, unnest(regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7f]+')) AS t FROM b) GROUP BY ALL),
     w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7f]+')) AS term FROM documents),
     l AS (SELECT doc_id, coalesce(len(regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7f]+')), 0) AS len FROM documents),
     s AS (SELECT count(*)::DOUBLE AS n, sum(len)::DOUBLE / count(*) AS mean FROM l),
     p AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL),
     f AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY 1),
     i AS (SELECT doc_id, term, CAST(floor(1000.0::DOUBLE * ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) + 0.5::DOUBLE) AS BIGINT) AS weight
           FROM p JOIN f USING (term) JOIN l USING (doc_id), s),
     c AS (SELECT item_id AS query_id, query_no, doc_id, CAST(sum(qtf * weight) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(qtf * weight) > 0),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, query_no ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM c)
SELECT query_id, query_no, rank, doc_id, score FROM r WHERE rank <= 10
"""

CHAT_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
     last AS (SELECT conv_id, max(turn) AS last_turn FROM c WHERE role = 'assistant' GROUP BY 1),
     next AS (SELECT conv_id, lead(conv_id) OVER (ORDER BY conv_id) AS follows FROM (SELECT DISTINCT conv_id FROM c)),
     answer AS (SELECT next.conv_id, max(text) AS other FROM next JOIN last ON last.conv_id = follows JOIN c ON c.conv_id = follows AND c.turn = last_turn WHERE role = 'assistant' GROUP BY 1),
     bad AS (SELECT c.conv_id, turn, role, CASE WHEN turn = last_turn AND role = 'assistant' THEN other ELSE text END AS text
             FROM c LEFT JOIN last USING (conv_id) LEFT JOIN answer USING (conv_id)
             WHERE last_turn IS NULL OR turn < last_turn OR (turn = last_turn AND (role <> 'assistant' OR other IS NOT NULL))),
     a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM c),
     b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM bad),
     m AS (SELECT a.conv_id, count(*) FILTER (WHERE same) AS n FROM
             (SELECT a.conv_id, a.k, bool_and(b.conv_id IS NOT NULL AND a.role = b.role AND a.text = b.text) OVER (PARTITION BY a.conv_id ORDER BY a.k) AS same
              FROM a LEFT JOIN b ON a.conv_id = b.conv_id AND a.k = b.k) a GROUP BY 1),
     s AS (SELECT 0 AS side, * FROM a UNION ALL SELECT 1, * FROM b),
     r AS (SELECT side, s.conv_id, k, k > n AS done, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown, text FROM s JOIN m USING (conv_id)),
     o AS (SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY side, conv_id, done ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 5 AS start FROM r),
     g AS (SELECT conv_id,
             string_agg(shown, '' ORDER BY k) FILTER (WHERE side = 0 AND NOT done) AS prompt,
             string_agg(shown, '' ORDER BY k) FILTER (WHERE side = 0 AND done) AS chosen,
             string_agg(shown, '' ORDER BY k) FILTER (WHERE side = 1 AND done) AS rejected,
             string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(text) + 7 AS BIGINT), ',' ORDER BY k) FILTER (WHERE side = 0 AND done AND role = 'assistant') AS chosen_mask,
             string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(text) + 7 AS BIGINT), ',' ORDER BY k) FILTER (WHERE side = 1 AND done AND role = 'assistant') AS rejected_mask
           FROM o GROUP BY 1)
SELECT conv_id, coalesce(prompt, '') AS prompt, CAST(n AS INTEGER) AS n_prompt_turns, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected,
       coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected_mask, '') AS rejected_mask
FROM g JOIN m USING (conv_id) WHERE conv_id IN (SELECT conv_id FROM b)
"""

#: Words in threes, each document with its own counts left out: a word's probability backs off to what the other rows have, and at last to its bytes.
LM_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
     l AS (SELECT row, list_concat(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f\v]'), [NULL]) AS ws FROM d),
     w AS (SELECT row, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM l),
     t AS (SELECT row, pos, w, coalesce(strlen(w), 0) AS size, coalesce(w, '<end>') AS c, lag('w' || w, 1, '<begin>') OVER (PARTITION BY row ORDER BY pos) AS b, lag('w' || w, 2, '<begin>') OVER (PARTITION BY row ORDER BY pos) AS a FROM w),
     n AS (SELECT row, pos, size,
             count(*) OVER (PARTITION BY w IS NULL, c) - count(*) OVER (PARTITION BY row, w IS NULL, c) AS c1,
             count(*) OVER (PARTITION BY w IS NULL, b, c) - count(*) OVER (PARTITION BY row, w IS NULL, b, c) AS c2,
             count(*) OVER (PARTITION BY w IS NULL, a, b, c) - count(*) OVER (PARTITION BY row, w IS NULL, a, b, c) AS c3,
             count(*) OVER () - count(*) OVER (PARTITION BY row) AS n0, (SELECT count(*) - 1 FROM d) AS others FROM t),
     h AS (SELECT row, size, c1::DOUBLE AS c1, c2::DOUBLE AS c2, c3::DOUBLE AS c3, n0::DOUBLE AS n0, lag(c1, 1, others) OVER o::DOUBLE AS n1, lag(c2, 1, others) OVER o::DOUBLE AS n2 FROM n WINDOW o AS (PARTITION BY row ORDER BY pos)),
     p AS (SELECT row, CASE WHEN c1 > 0 THEN ln((c3 + 4 * (c2 + 4 * (c1 + 4 * pow(2.0::DOUBLE, -8 * (size + 1))) / (n0 + 4)) / (n1 + 4)) / (n2 + 4))
                            ELSE ln(4 / (n0 + 4)) + ln(4 / (n1 + 4)) + ln(4 / (n2 + 4)) - (size + 1) * ln(256.0::DOUBLE) END AS lp FROM h),
     s AS (SELECT row, sum(lp) AS lp FROM p GROUP BY 1)
SELECT doc_id, strlen(text) AS n_bytes, round(lp, 4) AS log_prob, round(-lp / ln(2.0::DOUBLE) / (strlen(text) + 1), 6) AS bits_per_byte FROM d JOIN s USING (row)
"""

_SEGMENTS = [("h", 43, 21), ("h", 21, 22), ("h", 0, 21), ("l", 43, 21), ("l", 21, 22), ("l", 0, 21)]

#: SimHash by MD5 bits; every pair of signatures is compared, and counts if it is within 22 bits and a segment differs by at most one.
NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT row, doc_id, word, pos FROM (SELECT row, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
       FROM (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL))),
     x AS MATERIALIZED (SELECT word, length(word) AS size, ('0x' || substr(md5(word), 1, 16))::UBIGINT AS h, ('0x' || substr(md5(word), 17, 16))::UBIGINT AS l FROM (SELECT DISTINCT word FROM w)),
     q AS (SELECT DISTINCT row, doc_id, word, follows FROM (SELECT *, lead(word) OVER (PARTITION BY row ORDER BY pos) AS follows FROM w) WHERE follows IS NOT NULL),
     m AS MATERIALIZED (SELECT row, doc_id, h, l, least(6, greatest(1, size - 1)) AS weight FROM (SELECT DISTINCT row, doc_id, word FROM w) JOIN x USING (word)
           UNION ALL SELECT row, doc_id, xor(((a.h & 9223372036854775807) << 1) | (a.h >> 63), b.h), xor(((a.l & 9223372036854775807) << 1) | (a.l >> 63), b.l), 1 FROM q JOIN x a ON a.word = q.word JOIN x b ON b.word = q.follows),
     v AS (SELECT row, doc_id, b, 2 * sum(((h >> b) & 1) * weight) > sum(weight) AS hi, 2 * sum(((l >> b) & 1) * weight) > sum(weight) AS lo FROM m, (SELECT unnest(range(0, 64))::UBIGINT AS b) GROUP BY ALL),
     g AS MATERIALIZED (SELECT row, doc_id, sum(CASE WHEN hi THEN 1::UBIGINT << b ELSE 0 END)::UBIGINT AS h, sum(CASE WHEN lo THEN 1::UBIGINT << b ELSE 0 END)::UBIGINT AS l FROM v GROUP BY ALL),
     s AS MATERIALIZED (SELECT h, l, min(doc_id) AS least, count(*) AS n FROM g GROUP BY ALL),
     e AS MATERIALIZED (SELECT a.least AS u, b.least AS v FROM s a JOIN s b ON (a.h, a.l) <> (b.h, b.l)
           WHERE bit_count(xor(a.h, b.h)) + bit_count(xor(a.l, b.l)) <= 22 AND (""" + " OR ".join(f"bit_count((xor(a.{x}, b.{x}) >> {at}) & {(1 << width) - 1}) <= 1" for x, at, width in _SEGMENTS) + r""")),
     r AS (SELECT least AS node, least AS root FROM s UNION SELECT e.v, r.root FROM r JOIN e ON r.node = e.u),
     c AS (SELECT node, min(root) AS root FROM r GROUP BY 1),
     k AS (SELECT doc_id, min(root) AS keep_id FROM g JOIN s USING (h, l) JOIN c ON c.node = s.least GROUP BY 1)
SELECT doc_id, keep_id FROM k WHERE doc_id <> keep_id
"""
