"""DuckDB SQL of the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = r"(SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"

SUBSTRING_DEDUP = f"""
WITH d AS {_WORDS},
win AS (SELECT doc_id, s, w[s:s + 19] AS k FROM d, unnest(range(1, len(w) - 18)) AS t(s) WHERE len(w) >= 20),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + i AS pos FROM again, range(20) AS r(i)),
kept AS (SELECT d.doc_id, string_agg(d.w[p], ' ' ORDER BY p) AS t, count(*) AS n
         FROM d, unnest(range(1, len(w) + 1)) AS u(p) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = d.doc_id AND g.pos = p) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS {_WORDS},
sh AS (SELECT doc_id, w[s:s + 4] AS k, count(*) AS c FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(s) WHERE len(w) > 0 GROUP BY ALL),
tot AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n FROM sh GROUP BY doc_id),
ov AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS o FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM ov JOIN tot x ON x.doc_id = a JOIN tot y ON y.doc_id = b WHERE CAST(o AS DOUBLE) / CAST(x.n + y.n - o AS DOUBLE) >= 0.8),
und AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(id, root) AS (SELECT doc_id, doc_id FROM tot UNION SELECT und.b, reach.root FROM reach JOIN und ON und.a = reach.id),
comp AS (SELECT id, min(root) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(comp.c, d.doc_id) AS class_id, coalesce(tot.n, 0) AS n_shingles
FROM d LEFT JOIN comp ON comp.id = d.doc_id LEFT JOIN tot ON tot.doc_id = d.doc_id"""

MIXING = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS m FROM documents),
h AS (SELECT *, CAST('0x' || substr(m, 1, 8) AS BIGINT) % 4096 AS b, CAST('0x' || substr(m, 9, 5) AS BIGINT) / 1048576.0::DOUBLE AS u FROM d),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
wt AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, ss * 3.0::DOUBLE AS cap FROM src),
step AS (SELECT *, (CAST(sum(ss) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wt),
lev AS (SELECT coalesce(arg_min(level, (cap / weight, r)), 0) AS level FROM step WHERE level * weight <= cap),
tgt AS (SELECT source, ss, least(weight * level, cap) AS target FROM wt, lev),
cell AS (SELECT source, b, CAST(sum(size) AS BIGINT) AS words FROM h GROUP BY source, b),
plan AS (SELECT c.source, c.b, t.ss, t.target, CASE WHEN t.ss > 0 THEN floor(t.target / t.ss) ELSE 0 END AS whole, c.words,
  coalesce(sum(c.words) OVER (PARTITION BY c.source ORDER BY c.b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM cell c JOIN tgt t ON c.source IS NOT DISTINCT FROM t.source),
part AS (SELECT *, CASE WHEN words > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (target - whole * ss - CAST(before AS DOUBLE)) / words)) ELSE 0 END AS part FROM plan)
SELECT h.doc_id, h.size, p.ss AS source_size, p.target, CAST(p.whole AS BIGINT) * h.size + CASE WHEN part >= 1 THEN h.size WHEN part <= 0 THEN 0
  ELSE least(h.size, CAST(floor(part * h.size + u) AS BIGINT)) END AS taken
FROM h JOIN part p ON h.source IS NOT DISTINCT FROM p.source AND h.b = p.b"""


LEXICAL_SEARCH = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
tot AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
tf AS (SELECT doc_id, t, CAST(count(*) AS BIGINT) AS tf, CAST(any_value(n) AS BIGINT) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM i) GROUP BY doc_id, t),
wt AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * tot.n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, tot GROUP BY t, tot.n),
con AS (SELECT doc_id, tf.t, w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * tf.n * tot.n) // tot.l))) AS c FROM tf JOIN wt ON wt.t = tf.t, tot),
sc AS (SELECT item_id, doc_id, CAST(sum(c) AS BIGINT) AS score FROM i JOIN con ON con.t = i.t GROUP BY item_id, doc_id),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM rk WHERE rank <= 50"""

FILTER_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
     regexp_matches(text, '[#$%&*|]'), d.doc_id > min(d.doc_id) OVER (PARTITION BY text)] AS fails
  FROM d LEFT JOIN lab ON lab.doc_id = d.doc_id),
cell AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
perm AS (SELECT [a.i, b.i, c.i, e.i, g.i] AS p FROM x a, x b, x c, x e, x g WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
step AS (SELECT p, s.i AS step, p[s.i] AS f, p[1:s.i - 1] AS before FROM perm, x s),
res AS (SELECT part, array_to_string(list_transform(p, lambda k: chr(CAST(64 + k AS INTEGER))), '') AS filter_order, step, f,
    sum(CASE WHEN NOT early AND NOT fails[f] THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT early AND fails[f] THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN early AND fails[f] THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails[f] AND len(list_filter(fails, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT early AND fails[f] THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT early AND fails[f] THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, len(list_filter(before, lambda k: fails[k])) > 0 AS early FROM cell, step) GROUP BY part, p, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM res"""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
