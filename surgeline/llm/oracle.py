"""DuckDB SQL for the operators that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


CONTAMINATION = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM documents),
b AS (SELECT item_id, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN ls WHERE len(w) >= n)),
h AS MATERIALIZED (SELECT DISTINCT dw.r, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON cov.r = d.r LEFT JOIN it ON it.r = d.r
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_words(r"[^\x20\x09-\x0D]+")} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 90 * (na.n + nb.n - p.c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(reach.b) FROM reach WHERE reach.a = d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""

FILL_MIDDLE = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS w, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, w, len(w) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:n], '') AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p),
r AS (SELECT *, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN split_part(split_part(output, '<S>', 1), '<P>', 2) || split_part(output, '<M>', 2) || split_part(split_part(output, '<M>', 1), '<S>', 2)
ELSE split_part(split_part(output, '<M>', 1), '<P>', 2) || split_part(output, '<M>', 2) || split_part(split_part(output, '<P>', 1), '<S>', 2) END AS restored FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM r
"""


def _round(k: int) -> str:
    """Assignment to the centroids c<k>, and the centroids after it."""
    return f"""
a{k} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM (SELECT x.r, c{k}.c, sum((x.x - c{k}.x) * (x.x - c{k}.x)) AS d FROM x JOIN c{k} ON c{k}.i = x.i GROUP BY 1, 2)) WHERE place = 1),
m{k} AS (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT a{k}.c, x.i, sum(x.x) AS s, count(*) AS n FROM a{k} JOIN x ON x.r = a{k}.r GROUP BY 1, 2)),
c{k + 1} AS MATERIALIZED (SELECT c{k}.c, c{k}.i, coalesce(m{k}.x, c{k}.x) AS x FROM c{k} LEFT JOIN m{k} ON m{k}.c = c{k}.c AND m{k}.i = c{k}.i)"""


CENTROIDS = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
x AS MATERIALIZED (SELECT r, i, CAST(floor(256 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT r, e, unnest(range(1, 65)) AS i FROM v)),
f AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM v),
c0 AS MATERIALIZED (SELECT f.c, x.i, x.x FROM f JOIN x ON x.r = f.r WHERE f.c < 40),{",".join(map(_round, range(6)))}
SELECT v.vec_id, CAST(a5.c AS INTEGER) AS cluster, CAST(a5.d AS BIGINT) AS distance, CAST(sum(a5.d) OVER (PARTITION BY a5.c) AS BIGINT) AS cluster_inertia, CAST(sum(a5.d) OVER () AS BIGINT) AS inertia, s.centroid_sha256
FROM v JOIN a5 ON a5.r = v.r JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c5 GROUP BY c) s ON s.c = a5.c
"""

ARCHIVES = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last OR page_id IS NULL THEN last END AS refers_to FROM m
"""
