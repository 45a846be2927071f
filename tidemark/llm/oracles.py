"""DuckDB SQL for the text operators that SQL can state."""

from __future__ import annotations

from tidemark.llm import license_scan as ls
from tidemark.llm import mixing as mx
from tidemark.llm.common import LOWER, UPPER


def license_scan(drift: int = 3, coverage: float = 0.8) -> str:
    quoted = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate([*ls.BASE, *ls.NOTICES]))
    base = len(ls.BASE)
    return f"""
WITH tpl AS (SELECT template, label, string_split(text, ' ') AS tw, len(string_split(text, ' ')) AS length FROM (VALUES {quoted}) v(template, label, text)),
 tk AS (SELECT *, CASE WHEN length >= {ls.LONG} THEN {ls.LONG} ELSE {ls.SHORT} END AS k FROM tpl),
 grams AS (SELECT template, label, length, k, t_pos, array_to_string(tw[t_pos + 1 : t_pos + k], ' ') AS gram, tw[t_pos + 1] AS t0
           FROM (SELECT *, unnest(range(length - k + 1)) AS t_pos FROM tk) x),
 docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ls.WORD}') AS w FROM documents),
 pos AS (SELECT r, w, unnest(w) AS t0, unnest(range(len(w))) AS pos FROM docs),
 near AS (SELECT r, t0, pos, w[pos + 1 : pos + {ls.LONG}] AS here FROM pos WHERE t0 IN (SELECT t0 FROM grams)),
 hits AS (SELECT r, template, label, length, k, t_pos, pos FROM near JOIN grams USING (t0) WHERE len(here) >= k AND array_to_string(here[1:k], ' ') = gram),
 diag AS (SELECT r, template, label, length, k, pos - t_pos AS d, list(t_pos) AS ts, min(pos) AS first, max(pos + k) AS stop FROM hits GROUP BY ALL),
 fresh AS (SELECT *, CASE WHEN length > {2 * ls.LONG} AND d - lag(d) OVER (PARTITION BY r, template ORDER BY d) <= {drift} THEN 0 ELSE 1 END AS f FROM diag),
 grp AS (SELECT *, sum(f) OVER (PARTITION BY r, template ORDER BY d) AS g FROM fresh),
 spans AS (SELECT r, template, label, length, k, g, flatten(list(ts)) AS ts, min(first) AS start, max(stop) AS stop FROM grp GROUP BY r, template, label, length, k, g),
 cov AS (SELECT *, len(list_distinct(flatten(list_transform(ts, lambda t: range(t, t + k))))) / length AS covered FROM spans),
 good AS (SELECT * FROM cov WHERE CASE WHEN length > {2 * ls.LONG} THEN covered >= {coverage} AND abs(stop - start - length) <= {drift} * ceil(length / 10) ELSE covered = 1.0 END),
 per AS (SELECT r, count(*) FILTER (template < {base}) AS n_base, min(start) FILTER (template < {base}) AS first_word, max(start) FILTER (template < {base}) AS last_word,
   coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (template < {base}))), ','), '') AS base_labels,
   array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(covered) AS score, count(*) AS n_spans FROM good GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
   coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score, coalesce(n_spans, 0) AS n_spans
FROM docs LEFT JOIN per USING (r)"""


#: ASCII white space as a DuckDB expression.
BLANK = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


def line_dedup(min_docs: int = 10) -> str:
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
 l AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
 k AS MATERIALIZED (SELECT r, line, pos, translate(trim(line, {BLANK}), '{UPPER}', '{LOWER}') AS key FROM l),
 hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= {min_docs}),
 per AS (SELECT r, count(*) FILTER (hot.key IS NOT NULL) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (hot.key IS NULL), '') AS kept
         FROM k LEFT JOIN hot ON k.key = hot.key GROUP BY r)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM docs JOIN per USING (r)"""


def mixing() -> str:
    weights = ", ".join(str(w) for w in mx.WEIGHTS)
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{mx.WORD}')) AS BIGINT) AS size,
   md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '/', md5(coalesce(text, '')))) AS place FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [{weights}][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(mx.WEIGHTS)} + 1]::DOUBLE AS weight FROM d GROUP BY source),
 r AS (SELECT *, {mx.LIMIT} * source_size / weight AS ratio, {mx.SHARE} * sum(source_size) OVER () AS total FROM s),
 lv AS (SELECT *, (total - {mx.LIMIT} * coalesce(sum(source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM r
   WINDOW b AS (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 rt AS (SELECT *, first_value(CASE WHEN ratio > level THEN level END IGNORE NULLS) OVER (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rate FROM lv),
 t AS (SELECT source, source_size, CASE WHEN rate IS NULL THEN {mx.LIMIT} * source_size ELSE rate * weight END AS target FROM rt),
 c AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS sid, CAST(ceil(source_size / {mx.BLOCK}) AS BIGINT) AS blocks FROM t WHERE source_size > 0),
 w AS (SELECT *, target / (source_size / blocks) AS wanted FROM c),
 h AS (SELECT *, CASE WHEN lead(sid) OVER (ORDER BY sid) IS NULL THEN 1.0 ELSE sum(wanted) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING) / sum(wanted) OVER () END AS high FROM w),
 src AS MATERIALIZED (SELECT *, coalesce(lag(high) OVER (ORDER BY sid), 0.0) AS low FROM h),
 pts AS (SELECT n AS slot, n * {mx.GOLDEN}::DOUBLE - floor(n * {mx.GOLDEN}::DOUBLE) AS point FROM range((SELECT CAST(ceil(sum(wanted)) AS BIGINT) FROM src)) x(n)),
 dealt AS (SELECT slot, sid, blocks, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS turn FROM pts JOIN src ON low <= point AND point < high),
 uses AS (SELECT sid, turn % blocks AS block, count(*) AS times FROM dealt WHERE turn < {mx.LIMIT} * blocks GROUP BY ALL),
 m AS MATERIALIZED (SELECT doc_id, place, d.size, sid, CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
   t.source_size, t.target, row_number() OVER () AS r FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN src ON src.source IS NOT DISTINCT FROM t.source),
 p AS (SELECT r, sid, start, size, unnest(range(start // {mx.BLOCK}, (start + size - 1) // {mx.BLOCK} + 1)) AS block FROM m WHERE size > 0),
 tk AS (SELECT r, CAST(sum(times * (least((block + 1) * {mx.BLOCK}, start + size) - greatest(block * {mx.BLOCK}, start))) AS BIGINT) AS taken FROM p JOIN uses USING (sid, block) GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM m LEFT JOIN tk USING (r)"""


def warc() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
   array_to_string(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(d, 1 + 5 * i, 5))::INT >> (15 - 5 * j)::INT) & 31), 1)), 'string_agg', '')), '') AS payload_digest,
   CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""


def jaccard(width: int = 4, percent: int = 85) -> str:
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS MATERIALIZED (SELECT r, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(len(w) - {width} + 1), lambda i: array_to_string(w[i + 1 : i + {width}], ' ')) END) AS sh FROM d),
 x AS MATERIALIZED (SELECT hash(sh) AS g, min(r) AS r, first(sh) AS sh FROM (SELECT r, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
 t AS MATERIALIZED (SELECT r, len(sh) AS n, hash(unnest(sh)) AS h FROM x),
 o AS (SELECT a.r AS a, b.r AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM t a JOIN t b ON a.h = b.h AND a.r < b.r AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY a.r, b.r),
 l AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * c >= {percent} * (na + nb - c)),
 e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT x.r, x.r FROM x),
 reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
 low AS (SELECT reach.a AS r, min(y.doc_id) AS component_id FROM reach JOIN x z ON z.r = reach.b JOIN (SELECT list_sort(sh) AS sh, doc_id FROM s JOIN d USING (r) WHERE len(sh) > 0) y ON y.sh = z.sh GROUP BY reach.a)
SELECT d.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, CASE WHEN len(s.sh) = 0 THEN d.doc_id ELSE low.component_id END AS component_id
FROM d JOIN s USING (r) LEFT JOIN x ON x.sh = list_sort(s.sh) LEFT JOIN low ON low.r = x.r"""


def centroids(clusters: int = 8, rounds: int = 10) -> str:
    """Every vector against every centroid, round by round."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
 d{n} AS MATERIALIZED (SELECT e.r, c.c, sum((e.x - c.x) * (e.x - c.x)) AS d FROM e JOIN c{n} c USING (i) GROUP BY ALL),
 a{n} AS MATERIALIZED (SELECT r, min(d) AS d, arg_min(c, (d, c)) AS c FROM d{n} GROUP BY r)""")
        if n < rounds:
            steps.append(f"""
 s{n} AS (SELECT a.c, e.i, sum(e.x) AS s, count(*) AS k FROM e JOIN a{n} a USING (r) GROUP BY ALL),
 c{n + 1} AS MATERIALIZED (SELECT c.c, c.i, CASE WHEN s.k IS NULL THEN c.x ELSE CAST((s.s - (s.s % s.k + s.k) % s.k) // s.k AS BIGINT) END AS x FROM c{n} c LEFT JOIN s{n} s ON s.c = c.c AND s.i = c.i)""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda t: CAST(floor(1024 * CAST(t AS DOUBLE)) AS BIGINT)) AS x
   FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda t: t IS NOT NULL AND isfinite(t))) = 64),
 e AS MATERIALIZED (SELECT r, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v),
 f AS (SELECT r, row_number() OVER (ORDER BY sha256(concat('3:', coalesce(CAST(vec_id AS VARCHAR), ''))), x) - 1 AS c FROM v),
 c0 AS MATERIALIZED (SELECT f.c, e.i, e.x FROM f JOIN e USING (r) WHERE f.c < {clusters}),{",".join(steps)},
 h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY c)
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.digest AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN h ON h.c = a.c"""
