"""DuckDB SQL for the operators that SQL can express, over the same tables."""

from __future__ import annotations

from . import hard_negatives, resampling
from .mixing import BUCKETS, MOST_PASSES, SCHEDULES, WEIGHTS
from .substring_dedup import MAX_WORDS, RUN

WORDS = r"[^\x20\x09-\x0D]+"


def _knots() -> str:
    rows = []
    for kind, knots in enumerate(SCHEDULES):
        areas = [0.0]
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            areas.append(areas[-1] + (t1 - t0) * (w0 + w1) / 2)
        points = [(t, w / areas[-1], a / areas[-1]) for (t, w), a in zip(knots, areas, strict=True)]
        for i, ((t0, w0, a0), (t1, w1, _)) in enumerate(zip(points, points[1:], strict=False)):
            rows.append(f"({kind}, {i}, {t0!r}::DOUBLE, {w0!r}::DOUBLE, {a0!r}::DOUBLE, {(w1 - w0) / (t1 - t0)!r}::DOUBLE)")
    return ", ".join(rows)


OP5 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % {len(WEIGHTS)} AS kind FROM s),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][kind + 1] AS weight FROM r),
l AS (
  SELECT *, ((sum(source_size) OVER () - {MOST_PASSES} * coalesce(sum(source_size) OVER f, 0))::DOUBLE
             / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE) AS level,
         row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS n
  FROM w WINDOW f AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fin AS (SELECT arg_min(level, n) AS level FROM l WHERE level * weight <= {MOST_PASSES} * source_size),
g AS (
  SELECT l.source, l.source_size, l.kind,
         coalesce(least(({MOST_PASSES} * l.source_size)::DOUBLE, (SELECT level FROM fin) * l.weight), ({MOST_PASSES} * l.source_size)::DOUBLE) AS target
  FROM l),
o AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.kind,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(k, 1, 8))::BIGINT % {BUCKETS}, k, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, (SELECT count(*) FROM range({MOST_PASSES}) t(i) WHERE 2 * (i * source_size + before) + size <= 2 * target) AS copies FROM o),
y AS (
  SELECT c.*, t.i AS copy, CASE WHEN target = 0 THEN 0 ELSE (t.i * source_size + before + size / 2.0::DOUBLE) / target END AS share
  FROM c LEFT JOIN range({MOST_PASSES}) t(i) ON t.i < copies),
knots(kind, i, t, w, area, slope) AS (VALUES {_knots()}),
p AS (
  SELECT y.*, k.t, k.w, k.area, k.slope, row_number() OVER (PARTITION BY y.doc_id, y.copy ORDER BY CASE WHEN k.area <= y.share THEN -k.i ELSE 1000 + k.i END) AS n
  FROM y LEFT JOIN knots k ON k.kind = y.kind),
z AS (SELECT *, round(least(1.0, t + coalesce(2 * (share - area) / nullif(w + sqrt(greatest(0.0, w * w + 2 * slope * (share - area))), 0), 0)), 6) AS place FROM p WHERE n = 1)
SELECT doc_id, size, source_size, target, size * copies AS taken, max(place) FILTER (copy = 0) AS position,
       max(place) FILTER (copy = 1) AS second_position, max(place) FILTER (copy = 2) AS third_position
FROM z GROUP BY ALL
"""

BLANK = r" \t\r\n\f\x0B"
OP3 = rf"""
WITH p AS (
  SELECT doc_id, text,
         list_filter(flatten(list_transform(
           string_split(regexp_replace(text, '([.!?]+[{BLANK}]+|[。！？]+|\n[{BLANK}]*)', '\1' || chr(1), 'g'), chr(1)),
           lambda x: CASE WHEN length(x) - length(regexp_replace(x, '[{BLANK}]', '', 'g')) >= {MAX_WORDS}
                     THEN string_split(regexp_replace(x, '((?:[^{BLANK}]+[{BLANK}]+){{{MAX_WORDS}}})', '\1' || chr(1), 'g'), chr(1)) ELSE [x] END)),
           lambda x: x <> '') AS parts
  FROM documents),
k AS (SELECT doc_id, parts, list_transform(parts, lambda x: lower(trim(regexp_replace(x, '[{BLANK}]+', ' ', 'g'), ' '))) AS keys FROM p WHERE text IS NOT NULL),
r AS (SELECT doc_id, i, keys[i:i + {RUN} - 1] AS span FROM k, unnest(range(1, len(keys) - {RUN} + 2)) AS t(i)),
o AS (SELECT *, row_number() OVER (PARTITION BY span ORDER BY doc_id, i) AS n FROM r),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM o, range({RUN}) AS t(j) WHERE n > 1),
kept AS (
  SELECT k.doc_id, coalesce(string_agg(parts[t.i], '' ORDER BY t.i) FILTER (gone.i IS NULL), '') AS text, count(gone.i)::INTEGER AS n_removed
  FROM k, unnest(range(1, len(parts) + 1)) AS t(i) LEFT JOIN gone ON gone.doc_id = k.doc_id AND gone.i = t.i GROUP BY k.doc_id)
SELECT p.doc_id, CASE WHEN coalesce(n_removed, 0) > 0 THEN kept.text ELSE p.text END AS text, coalesce(n_removed, 0)::INTEGER AS n_removed
FROM p LEFT JOIN kept ON kept.doc_id = p.doc_id
"""

OP9 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, w[i:i + 2] AS shingle FROM w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS t(i)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id
  HAVING 100 * count(*) >= 85 * ((SELECT n FROM n WHERE n.doc_id = x.doc_id) + (SELECT n FROM n WHERE n.doc_id = y.doc_id) - count(*))),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS doc_id, least(a, min(b)) AS comp FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.comp, w.doc_id) AS component_id, coalesce(c.comp, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""

OP11 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{resampling.UPPER}', '{resampling.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{resampling.UPPER}', '{resampling.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS steps),
v AS (SELECT DISTINCT unnest(w) AS word FROM (SELECT w FROM w UNION ALL SELECT w FROM q)),
x AS (SELECT word, list_prepend(4294967295, list_transform(range(length(hex(encode(word))) // 2), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)) AS bytes FROM v),
b AS MATERIALIZED (SELECT word, xor(list_reduce(bytes, lambda c, y: xor(c >> 8, steps[(xor(c, y) & 255) + 1])), 4294967295) % {resampling.BUCKETS} AS bucket FROM x, crc),
f AS (SELECT d.doc_id, b.bucket FROM (SELECT doc_id, unnest(w) AS word FROM w) d JOIN b USING (word)),
s AS (SELECT bucket, count(*) AS s FROM f GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS word FROM q) JOIN b USING (word) GROUP BY bucket),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + {resampling.BUCKETS})::DOUBLE
             / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {resampling.BUCKETS})::DOUBLE)))::BIGINT AS gain
      FROM s LEFT JOIN t ON t.bucket = s.bucket),
m AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN g USING (bucket) GROUP BY doc_id),
z AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
      FROM w LEFT JOIN m ON m.doc_id = w.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank FROM z WHERE n_features >= {resampling.LEAST_WORDS})
SELECT z.doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= (SELECT {resampling.PERCENT} * count(*) // 100 FROM r) THEN rank END AS rank
FROM z LEFT JOIN r ON r.doc_id = z.doc_id
"""

OP12 = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, list_inner_product(a.v, b.v)::BIGINT AS score, a.label = b.label AS same
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {hard_negatives.POSITIVES})
SELECT p.anchor_id, p.other_id AS positive_id, (row_number() OVER w)::INTEGER AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
     AND {hard_negatives.LOW_PERCENT} * p.score <= 100 * n.score AND 100 * n.score <= {hard_negatives.HIGH_PERCENT} * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER w <= {hard_negatives.NEGATIVES}
"""

ORACLES: dict[str, str] = {"op3_substring_dedup": OP3, "op5_mixing": OP5, "op9_near_dedup": OP9, "op11_resampling": OP11, "op12_hard_negatives": OP12}
