"""DuckDB SQL that states the results of the queries it can express, over whole tables."""

#: Words of documents, and their five-word shingles (a shorter text: one shingle of all its words).
_WORDS = r"""
w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)"""

OP1 = rf"""
WITH RECURSIVE {_WORDS},
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
both_ AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT a, b, k = x.n AND k = y.n AS same FROM both_ JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
class AS (SELECT reach.a, min(w.doc_id) AS class_id FROM reach JOIN w ON w.r = reach.b GROUP BY reach.a),
copies AS (SELECT links.a, min(w.doc_id) AS copy_id FROM links JOIN w ON w.r = links.b WHERE same GROUP BY links.a),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT w.doc_id, class.class_id, least(w.doc_id, coalesce(copy_id, w.doc_id)) AS copy_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM w JOIN class ON class.a = w.r LEFT JOIN copies ON copies.a = w.r LEFT JOIN degree ON degree.a = w.r
"""

OP6 = rf"""
WITH {_WORDS.replace("doc_id, list", "doc_id, coalesce(text, '') AS t, source, list")},
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM win) WHERE k > 1),
cover AS (SELECT r, sum(least(5, coalesce(after - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM twice) GROUP BY r),
d AS (SELECT w.r, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w JOIN lines USING (r) LEFT JOIN cover USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 100 * n_symbols > 25 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR n_dup_lines > n_words / 10 AS soft_failed FROM d),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft_failed) AS k FROM f GROUP BY source),
p0 AS (SELECT greatest(least(avg(k / n), 0.999), 0.001) AS m, coalesce(var_samp(k / n), 0) AS v, avg(n) AS size FROM h),
p1 AS (SELECT m, least(CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1) ELSE size END, size) AS s FROM p0),
ab AS (SELECT source, m * s + k AS a, (1 - m) * s + n - k AS b FROM h, p1),
bad AS (SELECT source FROM ab WHERE a / (a + b) - 2 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.6)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (soft_failed AND source IN (SELECT source FROM bad)) AS kept FROM f
"""

OP2 = rf"""
WITH {_WORDS},
i0 AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
it AS (SELECT row_number() OVER () AS item, item_id, len(w) AS size, w FROM i0 WHERE len(w) >= 5),
ig AS (SELECT item, item_id, size, i - 1 AS q, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM it)),
dg AS (SELECT r, doc_id, n, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT *, len(w) AS n, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
win AS (SELECT DISTINCT r, doc_id, item, item_id, size, p - q AS start, greatest(p - q, 0) AS begin, least(p - q + size, n) - 5 AS last FROM dg JOIN ig USING (g)),
iw AS (SELECT item, g, count(*) AS k FROM ig GROUP BY item, g),
dw AS (SELECT win.*, dg.g, count(*) AS k FROM win JOIN dg ON dg.r = win.r AND p BETWEEN begin AND last GROUP BY ALL),
j AS (SELECT r, doc_id, item, item_id, size, start, last - begin + 1 AS n, sum(least(dw.k, iw.k)) AS shared FROM dw JOIN iw USING (item, g) GROUP BY ALL),
f AS (SELECT *, round(shared / (n + size - 4 - shared), 6) AS similarity FROM j WHERE 5 * shared >= 4 * (n + size - 4 - shared)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start, shared DESC) AS k FROM f)
SELECT doc_id, item_id, start AS start_word, shared::BIGINT AS n_shared, similarity FROM b WHERE k = 1
"""

OP12 = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][number % 3 + 1] AS weight, 3 * source_size AS cap FROM s),
k AS (SELECT *, row_number() OVER (ORDER BY cap / weight, number) AS k FROM w),
c AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM k),
l AS (SELECT coalesce(min_by(level, k) FILTER (level * weight < cap), 0) AS level FROM c),
t AS (SELECT source, source_size, number, least(level * weight, cap::DOUBLE) AS target FROM w, l),
p AS (SELECT doc_id, size, source_size, number, target, floor(target)::BIGINT AS demand, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END AS rounds, CASE WHEN target > 0 THEN place / target END AS x FROM p),
q AS (SELECT *, (rounds * size + least(greatest(demand - rounds * source_size - place, 0), size))::BIGINT AS taken FROM r)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(CASE number % 3 WHEN 0 THEN 2 * x / (1.5 + sqrt(2.25 - 2 * x)) WHEN 1 THEN x ELSE 2 * x / (0.5 + sqrt(0.25 + 2 * x)) END, 9) END AS position FROM q
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
n AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM n WHERE n.lang = x.lang AND n.source = x.source), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) x),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n, 1 + (1000000000 * (coalesce(n.n, 0) + 1)) // (total + v) AS p FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
q AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 1)) // (any_value(total) + any_value(v)) AS q FROM n JOIN (SELECT lang, sum(n) AS total FROM n GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
t AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
every_ AS (SELECT 'pair' AS part, * FROM e UNION ALL SELECT 'term', * FROM t)
SELECT * FROM (SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM every_) WHERE part = 'pair' OR rank <= 200
"""
