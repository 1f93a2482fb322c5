"""The queries of this subpackage and their SQL, by name, for __spark_entry__.py."""

from __future__ import annotations

from .lm_scoring import op3_lm_scoring
from .media import op6_media_columns
from .mixing import op1_mix_sources
from .near_dedup import op4_near_duplicates
from .neighbours import op9_nearest_neighbours
from .pii import op5_personal_data
from .quality import op7_quality
from .repeats import op10_repeats
from .subword import op8_sentencepiece
from .toxicity import op2_toxicity

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_toxicity": op2_toxicity,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_personal_data": op5_personal_data,
    "op6_media_columns": op6_media_columns,
    "op7_quality": op7_quality,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_repeats": op10_repeats,
}
#: DuckDB SQL by plain counting, for tables of some thousand documents.
SQL: dict[str, str] = {
    "op1_mix_sources": r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, ''))[1:15])::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, count(*) AS n, sum(size) * 2.0::DOUBLE AS cap FROM w GROUP BY source),
v AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
l AS (SELECT *, (sum(total) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (SELECT *, least(cap, max(level) OVER () * weight) AS target FROM l),
g AS (SELECT source, total, target, CASE WHEN total > 0 THEN floor(target / total + 1e-9)::BIGINT ELSE 0 END AS whole, ceil(n / 256.0) AS buckets FROM t),
r AS (SELECT *, greatest(0, round(target - whole * total))::BIGINT AS rest FROM g),
d AS MATERIALIZED (SELECT w.*, r.* EXCLUDE (source), floor((h >> 8)::DOUBLE / 4503599627370496.0 * buckets)::BIGINT AS bucket FROM w JOIN r ON w.source IS NOT DISTINCT FROM r.source),
b AS (SELECT source, rest, bucket, sum(size)::BIGINT AS words FROM d GROUP BY 1, 2, 3),
c AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM b),
e AS MATERIALIZED (SELECT source, bucket AS last, rest - before AS room FROM c WHERE rest > 0 AND before <= rest AND rest < before + words),
k AS MATERIALIZED (SELECT d.source, d.h, sum(d.size)::BIGINT AS size, row_number() OVER (PARTITION BY d.source ORDER BY d.h) AS place
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.bucket = e.last GROUP BY 1, 2),
f(source, place, room, h, picked) AS (SELECT source, 0::BIGINT, room::BIGINT, NULL::BIGINT, FALSE FROM e UNION ALL
  SELECT f.source, k.place, CASE WHEN k.size <= f.room THEN f.room - k.size ELSE f.room END, k.h, k.size <= f.room FROM f JOIN k ON k.source IS NOT DISTINCT FROM f.source AND k.place = f.place + 1)
SELECT d.doc_id, d.size, d.total AS source_size, d.target, (d.whole + CASE WHEN e.last IS NULL THEN d.target > d.whole * d.total + 0.5 ELSE d.bucket < e.last OR coalesce(f.picked, FALSE) END::BIGINT) * d.size AS taken
FROM d LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN f ON f.source IS NOT DISTINCT FROM d.source AND f.h = d.h AND d.bucket = e.last""",
    "op4_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 85 * (nx.c + ny.c - common)),
r(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op10_repeats": r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
i AS (SELECT doc_id, b, unnest(range(1, n - 198)) AS s FROM b WHERE n >= 200),
h AS (SELECT doc_id, s, sha256(b[s:s + 199]) AS h FROM i),
t AS (SELECT doc_id, s FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
m AS (SELECT doc_id, s, coalesce(s - lag(s) OVER o > 200, TRUE) AS new FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
k AS (SELECT doc_id, s, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM m),
r AS (SELECT doc_id, run, min(s) AS lo, max(s) + 200 AS hi FROM k GROUP BY 1, 2),
g AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS start FROM r),
x AS (SELECT g.doc_id, list(b.b[g.start:g.lo - 1] ORDER BY g.lo) AS parts, max(g.hi) AS tail, sum(g.hi - g.lo) AS gone, count(*) AS runs FROM g JOIN b ON b.doc_id = g.doc_id GROUP BY 1)
SELECT b.doc_id, b.n::BIGINT AS n_bytes, coalesce(x.gone, 0)::BIGINT AS n_removed, coalesce(x.runs, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN x.doc_id IS NULL THEN b.b ELSE list_reduce(list_append(x.parts, b.b[x.tail:b.n]), lambda p, q: p || q) END) AS kept_sha256
FROM b LEFT JOIN x ON x.doc_id = b.doc_id""",
}
