"""DuckDB SQL for the queries that SQL can express."""

#: Every quotient of every source, bundle and shard is ranked here; the operator ranks only those near the margin.
OP2_MIXING = r"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || left(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) || ':' || coalesce(text, '')), 8) AS BIGINT) AS place FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS source_rows FROM sizes GROUP BY source),
weighted AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM per_source),
filled AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS share FROM weighted
  WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(share, cap / w) AS share FROM filled WHERE share * w <= cap),
targets AS (SELECT source, coalesce('s' || source, 'n') AS s, source_size, source_rows, least(cap, w * (SELECT share FROM level)) AS target FROM filled),
placed AS (SELECT z.doc_id, z.size, z.place, t.s, t.source_size, t.target,
  greatest(1, CAST(ceil(t.source_size / 262144) AS BIGINT), CAST(ceil(t.source_rows / 65536) AS BIGINT)) AS shards FROM sizes z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source),
dealt AS (SELECT *, place % shards AS shard FROM placed),
seats AS (SELECT CAST(round(sum(target) / 16) AS BIGINT) AS n FROM targets),
source_quota AS (SELECT s, count(*) AS quota FROM (SELECT s, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, s, k) AS r FROM targets, seats, unnest(range(0, seats.n)) AS q(k) WHERE target > 0), seats WHERE r <= seats.n GROUP BY s),
shard_sizes AS (SELECT s, shard, shard // 1024 AS bundle, CAST(sum(size) AS BIGINT) AS words FROM dealt GROUP BY s, shard),
bundle_sizes AS (SELECT s, bundle, sum(words) AS words FROM shard_sizes GROUP BY s, bundle),
bundle_quota AS (SELECT s, bundle, count(*) AS quota FROM (SELECT z.s, z.bundle, g.quota, row_number() OVER (PARTITION BY z.s ORDER BY z.words / (2 * k + 1) DESC, z.bundle, k) AS r
  FROM bundle_sizes z JOIN source_quota g ON z.s = g.s, unnest(range(0, g.quota)) AS q(k) WHERE z.words > 0) WHERE r <= quota GROUP BY s, bundle),
shard_quota AS (SELECT s, shard, count(*) AS quota FROM (SELECT z.s, z.shard, g.quota, row_number() OVER (PARTITION BY z.s, z.bundle ORDER BY z.words / (2 * k + 1) DESC, z.shard, k) AS r
  FROM shard_sizes z JOIN bundle_quota g ON z.s = g.s AND z.bundle = g.bundle, unnest(range(0, g.quota)) AS q(k) WHERE z.words > 0) WHERE r <= quota GROUP BY s, shard),
shard_plan AS (SELECT z.s, z.shard, z.words, least(coalesce(g.quota, 0) * 16, 3 * z.words) AS wanted FROM shard_sizes z LEFT JOIN shard_quota g ON z.s = g.s AND z.shard = g.shard),
passes AS (SELECT *, CASE WHEN words > 0 THEN wanted // words ELSE 0 END AS passes FROM shard_plan),
extras AS (SELECT *, CAST(round((wanted - passes * words) / 16) AS BIGINT) AS extra FROM passes),
counted AS (SELECT *, greatest(1, CAST(ceil(words / 16) AS BIGINT)) AS n FROM extras),
begun AS (SELECT *, CAST('0x' || left(md5('43:' || s || ':' || shard), 8) AS BIGINT) % n AS first FROM counted),
blocks AS (SELECT s, shard, b FROM begun, unnest(range(0, n)) AS q(b) WHERE (b - first + n) % n < extra),
laid AS (SELECT d.doc_id, d.size, d.source_size, d.target, d.s, d.shard, row_number() OVER () AS n, CAST(sum(d.size) OVER (PARTITION BY d.s, d.shard ORDER BY d.place, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM dealt d),
pieces AS (SELECT l.n, CAST(sum(least((b + 1) * 16, upto) - greatest(b * 16, upto - size)) AS BIGINT) AS words FROM laid l JOIN blocks k ON k.s = l.s AND k.shard = l.shard AND k.b * 16 < l.upto AND (k.b + 1) * 16 > l.upto - l.size WHERE l.size > 0 GROUP BY l.n)
SELECT l.doc_id, l.size, l.source_size, l.target, CAST(e.passes * l.size + coalesce(p.words, 0) AS BIGINT) AS taken
FROM laid l JOIN extras e ON e.s = l.s AND e.shard = l.shard LEFT JOIN pieces p ON p.n = l.n
"""

#: Every phrase of two to five words of every piece is counted here, rare ones too.
OP11_COLLOCATIONS = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
laid AS (SELECT lang, p, unnest(w) AS w1, unnest(range(len(w))) AS i FROM worded),
ahead AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4, lead(w1, 4) OVER o AS w5 FROM laid WINDOW o AS (PARTITION BY p ORDER BY i)),
phrases AS (SELECT lang, 1 AS m, w1 AS phrase FROM ahead UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM ahead WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM ahead WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM ahead WHERE w4 IS NOT NULL
  UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM ahead WHERE w5 IS NOT NULL),
counted AS MATERIALIZED (SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS f FROM phrases GROUP BY ALL),
sizes AS (SELECT lang, sum(f) AS n FROM counted WHERE m = 1 GROUP BY lang),
found AS (SELECT * FROM counted WHERE m > 1 AND f >= 100),
cuts AS (SELECT c.lang, c.m, c.phrase, c.f AS a, k, array_to_string(string_split(c.phrase, ' ')[:k], ' ') AS first, array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') AS rest FROM found c, unnest(range(1, c.m)) AS cut(k)),
firsts AS MATERIALIZED (SELECT c.*, l.f AS l FROM cuts c JOIN counted l ON l.lang = c.lang AND l.phrase = c.first),
rests AS MATERIALIZED (SELECT c.*, r.f AS r FROM firsts c JOIN counted r ON r.lang = c.lang AND r.phrase = c.rest),
valued AS (SELECT c.lang, c.phrase, c.a, c.k, c.l, c.r, s.n, (1000 * c.a * CAST(s.n AS HUGEINT)) // (c.l * c.r) AS score FROM rests c JOIN sizes s ON s.lang = c.lang),
best AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
alone AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.lang = b.lang AND len(g.phrase) > len(b.phrase) AND 100 * g.f >= 100 * b.a AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alone)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
