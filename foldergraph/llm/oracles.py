"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_OP1 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

_OP2 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_lines, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM d),
w AS (SELECT doc_id, n_lines, pos, line, CASE WHEN pos + 3 <= n_lines THEN concat(line, chr(10), lead(line, 1) OVER p, chr(10), lead(line, 2) OVER p) END AS win
      FROM l WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS later FROM w),
c AS (SELECT *, bool_or(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone FROM f)
SELECT doc_id, max(n_lines) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM c GROUP BY doc_id
"""

_OP3 = r"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
p AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(CAST(len(h) // 2 - 49 AS BIGINT))) AS i FROM d)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM p),
c AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM m WHERE first < doc_id),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM c),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, span),
k AS (SELECT doc_id, a, lag(b, 1, 0) OVER w AS last, b, lead(a) OVER w AS next FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
j AS (SELECT k.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
        string_agg(concat(substr(h, 2 * last + 1, 2 * (a - last)), CASE WHEN next IS NULL THEN substr(h, 2 * b + 1) ELSE '' END), '' ORDER BY a) AS kept
      FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN j USING (doc_id)
"""

_OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM d GROUP BY source),
total AS (SELECT sum(source_size)::DOUBLE AS all_sizes FROM s),
r AS (
  SELECT 0 AS round, source, source_size, weight, false AS full_, all_sizes * weight / (SELECT sum(weight) FROM s) AS target FROM s, total
  UNION ALL
  SELECT round + 1, source, source_size, weight, now_full,
    CASE WHEN now_full THEN 3.0 * source_size
         ELSE (all_sizes - sum(CASE WHEN now_full THEN 3.0 * source_size ELSE 0 END) OVER ()) * weight / sum(CASE WHEN now_full THEN 0 ELSE weight END) OVER () END
  FROM (SELECT *, full_ OR target > 3.0 * source_size AS now_full FROM r, total) WHERE round < 30),
t AS (SELECT source, source_size, target FROM r WHERE round = 30),
k AS (
  SELECT d.doc_id, d.source, d.size, md5(d.text) AS m,
    -ln((('0x' || substr(md5(concat('7/', CAST(d.doc_id AS VARCHAR), '/', md5(d.text))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
      / (CAST(len(list_distinct(string_split(d.text, chr(10)))) AS DOUBLE) / len(string_split(d.text, chr(10)))
         / (1.0 + 20.0 * (length(d.text) - length(translate(d.text, '#*$%&|<>', ''))) / greatest(length(d.text), 1))) AS key
  FROM d),
o AS (SELECT k.*, t.source_size, t.target, floor(t.target / t.source_size) AS epochs, coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST((epochs + CASE WHEN start_ + size / 2.0 <= target - epochs * source_size AND size > 0 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM o
"""

_OP9 = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations),
a AS (SELECT conv_id, coalesce(max(i) FILTER (i > 1 AND role = 'assistant'), max(i)) AS spot FROM t GROUP BY 1),
k AS (SELECT conv_id, spot, role, text, md5(concat(role, chr(10), text)) AS key FROM a JOIN t USING (conv_id) WHERE i = spot),
d AS (SELECT key, min(role) AS role, min(text) AS text, min(conv_id) AS donor_id, row_number() OVER (ORDER BY key) - 1 AS rank FROM k GROUP BY key),
e AS (SELECT x.key, y.role AS other_role, y.text AS other_text, y.donor_id FROM d x JOIN d y ON y.rank = (x.rank + 1) % (SELECT count(*) FROM d) AND y.rank <> x.rank),
w AS (SELECT conv_id, spot, e.* FROM k LEFT JOIN e USING (key)),
x AS (SELECT conv_id, 1 AS side, i, role, text FROM t
      UNION ALL SELECT conv_id, 2, i, CASE WHEN i = spot THEN other_role ELSE role END, CASE WHEN i = spot THEN other_text ELSE text END FROM t JOIN w USING (conv_id) WHERE donor_id IS NOT NULL),
m AS (SELECT a.conv_id, CAST(coalesce(min(a.i) FILTER (a.role <> b.role OR a.text <> b.text) - 1, CASE WHEN count(b.i) = 0 THEN 0 ELSE max(a.i) END) AS INTEGER) AS n_common
      FROM (FROM x WHERE side = 1) a LEFT JOIN (FROM x WHERE side = 2) b ON a.conv_id = b.conv_id AND a.i = b.i GROUP BY 1),
r AS (SELECT x.*, n_common, concat('<|', role, '|>', chr(10), text, '<|end|>', chr(10)) AS said, length(role) + 5 AS head FROM x JOIN m USING (conv_id)),
q AS (SELECT *, CAST(sum(CASE WHEN i > n_common THEN length(said) ELSE 0 END) OVER (PARTITION BY conv_id, side ORDER BY i) AS BIGINT) AS stop FROM r)
SELECT conv_id, max(donor_id) AS donor_id, max(n_common) AS n_common,
  coalesce(string_agg(said, '' ORDER BY i) FILTER (side = 1 AND i <= n_common), '') AS prompt,
  coalesce(string_agg(said, '' ORDER BY i) FILTER (side = 1 AND i > n_common), '') AS chosen,
  CASE WHEN max(side) = 2 THEN coalesce(string_agg(said, '' ORDER BY i) FILTER (side = 2 AND i > n_common), '') END AS rejected,
  coalesce(string_agg(concat(stop - length(said) + head, ':', stop), ',' ORDER BY i) FILTER (side = 1 AND i > n_common AND role = 'assistant'), '') AS chosen_spans,
  CASE WHEN max(side) = 2 THEN coalesce(string_agg(concat(stop - length(said) + head, ':', stop), ',' ORDER BY i) FILTER (side = 2 AND i > n_common AND role = 'assistant'), '') END AS rejected_spans
FROM q JOIN w USING (conv_id) GROUP BY conv_id
"""

_OP10 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to, true AS verified
FROM g
"""




def _op11() -> str:
    """Six rounds and the last assignment as a chain of tables."""
    near = """a{k} AS MATERIALIZED (SELECT part, vec_id, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d FROM (
  SELECT p.part, vec_id, entry, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d FROM p JOIN b{k} b ON b.part = p.part) GROUP BY ALL)"""
    mean = """s{k} AS (SELECT part, entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.part, a.entry, x, unnest(range(1, len(x) + 1)) AS i FROM a{k} a JOIN p USING (part, vec_id)) GROUP BY ALL),
m{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY ALL),
b{next} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""
    rounds = ", ".join(f"{near.format(k=k)}, {mean.format(k=k, next=k + 1)}" for k in range(6))
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, e[part * len(e) // 8 + 1 : (part + 1) * len(e) // 8] AS x FROM (SELECT *, unnest(range(8)) AS part FROM v)),
b0 AS MATERIALIZED (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS BIGINT) AS entry, x AS c FROM p QUALIFY entry < 16),
{rounds}, {near.format(k=6)},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b6),
r AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), h
"""


_OP12 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o, 4294967295 - list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS h FROM documents),
g AS (SELECT *, h // 10 AS g, len(o) AS n, (h // 10) % greatest(len(o), 1) AS a FROM d),
q AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
w AS MATERIALIZED (SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE o END AS w FROM q),
f AS (SELECT doc_id, n, i, md5(array_to_string(w[i + 1 : i + 5], ' ')) AS k FROM (SELECT *, unnest(range(n - 4)) AS i FROM w WHERE n >= 6)),
m AS (SELECT y.doc_id, y.i - x.i AS lag, y.i AS i FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.k = y.k AND y.i > x.i AND 4 * (y.i - x.i) <= y.n),
s AS (SELECT doc_id, lag, min(i) AS a, max(i) + 4 AS b FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM m) GROUP BY doc_id, lag, island),
r0 AS (SELECT doc_id, a - lag AS start, b - a + lag + 1 AS length, lag AS period FROM s WHERE b - a + lag + 1 >= greatest(6, 4 * lag)),
r AS MATERIALIZED (SELECT * FROM r0 x WHERE NOT EXISTS (SELECT 1 FROM r0 y WHERE y.doc_id = x.doc_id AND y.period < x.period AND y.start <= x.start AND y.start + y.length >= x.start + x.length)),
t AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, p := period), [-length, start, period]) AS best, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs FROM r GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(w[i + 1], ' ' ORDER BY i) AS c FROM (SELECT doc_id, w, unnest(range(n)) AS i FROM w) ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM w LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _OP1, "op2_line_dedup": _OP2, "op3_suffix_dedup": _OP3, "op4_mixing": _OP4, "op9_preference": _OP9, "op10_warc": _OP10, "op11_vector_codes": _op11(), "op12_periodic_runs": _OP12}
