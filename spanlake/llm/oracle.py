"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from spanlake.llm import mixing

ORACLE: dict[str, str] = {}

ORACLE["op1_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS keeper FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM k
"""

ORACLE["op2_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""

ORACLE["op4_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other
), n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v LEFT JOIN n USING (vec_id) JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) USING (vec_id)
"""

ORACLE["op7_topk_search"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE["op9_source_mix"] = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}'))::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), ranked AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM src
), water AS (
  SELECT *, 3 * source_size AS cap,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY 3 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), goal AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target,
    least(source_size, greatest(ceil(source_size / {mixing.BLOCK_WORDS}), {mixing.MIN_BLOCKS}))::BIGINT AS n_blocks
  FROM water
), quota AS (
  SELECT *, coalesce(least(floor(target * n_blocks / nullif(source_size, 0) + 0.5), 3 * n_blocks), 0)::BIGINT AS quota FROM goal
), placed AS (
  SELECT d.*, source_size, target, n_blocks, quota,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN quota ON d.source IS NOT DISTINCT FROM quota.source
), last_pass AS (
  SELECT *, CASE WHEN n_blocks > 0 THEN quota // n_blocks ELSE 0 END AS passes,
    CASE WHEN n_blocks > 0 THEN ((quota % n_blocks)::HUGEINT * source_size // n_blocks)::BIGINT ELSE 0 END AS edge
  FROM placed
)
SELECT doc_id, size, source_size, target, (size * passes + greatest(0, least(start + size, edge) - start))::BIGINT AS taken FROM last_pass
"""

ORACLE["op12_collocations"] = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d
), x AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest([array_to_string(w[i:i + 1], ' ') FOR i IN range(1, len(w))]) FROM p
  UNION ALL SELECT lang, 3, unnest([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) FROM p
  UNION ALL SELECT lang, 4, unnest([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) FROM p
), f AS (SELECT lang, phrase, k, count(*) AS f FROM x GROUP BY ALL
), t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (SELECT lang, phrase, string_split(phrase, ' ') AS words, k, f AS a FROM f WHERE k >= 2 AND f >= 30
), parts AS (
  SELECT *, array_to_string(words[1:j], ' ') AS first_part, array_to_string(words[j + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
), cut AS (
  SELECT parts.*, l.f AS l, r.f AS r, ((2000000 * a::HUGEINT) // (l.f + r.f))::BIGINT AS score
  FROM parts JOIN f l ON l.lang = parts.lang AND l.phrase = first_part JOIN f r ON r.lang = parts.lang AND r.phrase = rest
), best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inner_ AS (
  SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN inner_ i ON i.lang = best.lang AND i.phrase = best.phrase
  WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN t USING (lang) WHERE rank <= 2000
"""

# A feature's CRC-32: contributions of its bytes by their distance from the end, and
# the CRC of as many zero bytes (both by the step for one more zero byte).
ORACLE["op13_importance_resampling"] = r"""
WITH RECURSIVE d AS (
  SELECT 0 AS which, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), x AS (
  SELECT which, doc_id, unnest(w) AS feature FROM d
  UNION ALL
  SELECT which, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d
), y AS (SELECT which, doc_id, feature, count(*) AS n FROM x GROUP BY ALL
), e AS (SELECT DISTINCT feature, hex(encode(feature)) AS h, octet_length(encode(feature)) AS size FROM y
), step(k, b, c) AS (
  SELECT 0, b, b::UINTEGER FROM range(256) t(b)
  UNION ALL
  SELECT k + 1, b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END::UINTEGER FROM step WHERE k < 8
), low AS (SELECT b, c FROM step WHERE k = 8
), most AS (SELECT max(size) AS size FROM e
), table_(d, b, c) AS (
  SELECT 0, b, c FROM low
  UNION ALL
  SELECT t.d + 1, t.b, xor(t.c >> 8, low.c)::UINTEGER FROM table_ t JOIN low ON low.b = t.c & 255 WHERE t.d + 1 < (SELECT size FROM most)
), zeros(size, c) AS (
  SELECT 0, 4294967295::UINTEGER
  UNION ALL
  SELECT z.size + 1, xor(z.c >> 8, low.c)::UINTEGER FROM zeros z JOIN low ON low.b = z.c & 255 WHERE z.size < (SELECT size FROM most)
), bytes AS (
  SELECT feature, size, size - 1 - i AS d, ('0x' || h[2 * i + 1:2 * i + 2])::INTEGER AS b FROM (SELECT *, unnest(range(size)) AS i FROM e)
), crc AS (
  SELECT feature, xor(xor(bit_xor(t.c), any_value(z.c)), 4294967295::UINTEGER) % 10000 AS bucket
  FROM bytes JOIN table_ t USING (d, b) JOIN zeros z USING (size) GROUP BY feature
), z AS (SELECT which, doc_id, bucket, n FROM y JOIN crc USING (feature)
), s AS (
  SELECT bucket, coalesce(sum(n) FILTER (which = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (which = 1), 0)::BIGINT AS t FROM z GROUP BY bucket
), tot AS (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM s
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (ss + 10000)) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM s, tot
), sums AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM z JOIN gain USING (bucket) WHERE which = 0 GROUP BY doc_id
), w AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight,
    ('0x' || sha256('7:' || d.doc_id)[1:8])::UINTEGER AS h
  FROM d LEFT JOIN sums USING (doc_id) WHERE which = 0
), scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20
  QUALIFY rank <= 25 * count(*) OVER () // 100
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, rank FROM scored LEFT JOIN drawn USING (doc_id)
"""
