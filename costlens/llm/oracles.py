"""SQL (DuckDB) for the corpus queries that SQL can express, over the same tables."""

from __future__ import annotations

TOP_K = """
WITH points AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
    SELECT q.vec_id AS query_id, p.vec_id AS vec_id, list_inner_product(q.v, p.v)::BIGINT AS score
    FROM points q JOIN points p ON q.vec_id <> p.vec_id AND len(q.v) = len(p.v)
    WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

JACCARD = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents WHERE doc_id IS NOT NULL
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM worded
), members AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(a, b) AS (
    SELECT doc_id, doc_id FROM sets
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (
    SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN component ON doc_id = a
"""

SUBSTRINGS = """
WITH texts AS (
    SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents WHERE doc_id IS NOT NULL
), bytes AS (
    SELECT doc_id, h, unnest(range(0, (len(h) // 2)::BIGINT)) AS i FROM texts
), strings AS (
    SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS byte,
        CASE WHEN 2 * (i + 100) <= len(h) THEN md5(substr(h, 2 * i + 1, 200)) END AS string
    FROM bytes
), repeats AS (
    SELECT doc_id, i, byte,
        (string IS NOT NULL AND row_number() OVER (PARTITION BY string ORDER BY doc_id, i) > 1)::INTEGER AS again
    FROM strings
), covered AS (
    SELECT doc_id, i, byte,
        max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone
    FROM repeats
), edges AS (
    SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before FROM covered
), found AS (
    SELECT doc_id, sum(gone) AS n_removed, sum(CASE WHEN gone = 1 AND before = 0 THEN 1 ELSE 0 END) AS n_spans,
        string_agg(CASE WHEN gone = 0 THEN byte ELSE '' END, '' ORDER BY i) AS kept
    FROM edges GROUP BY doc_id
)
SELECT t.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM texts t LEFT JOIN found USING (doc_id)
"""


def _fill(n: int, last: bool) -> str:
    """One pass of the mix: documents in rank order while they fit what their source lacks."""
    near = "OR upto - lack < lack - (upto - size)" if last else ""
    fits = "" if last else "WHERE r.size <= l.lack"
    return f"""
, order{n} AS (
    SELECT r.*, l.lack, sum(r.size) OVER (PARTITION BY r.source ORDER BY r.rank, r.doc_id) AS upto
    FROM ranked{n} r JOIN lack{n} l ON r.source IS NOT DISTINCT FROM l.source {fits}
), hits{n} AS (
    SELECT doc_id, source, size FROM order{n} WHERE upto - size < lack AND (upto <= lack {near})
), ranked{n + 1} AS (
    SELECT * FROM ranked{n} WHERE doc_id NOT IN (SELECT doc_id FROM hits{n})
), lack{n + 1} AS (
    SELECT l.source, l.lack - coalesce((SELECT sum(size) FROM hits{n} h WHERE h.source IS NOT DISTINCT FROM l.source), 0) AS lack
    FROM lack{n} l
    WHERE l.lack - coalesce((SELECT sum(size) FROM hits{n} h WHERE h.source IS NOT DISTINCT FROM l.source), 0) > 0
)"""


MIX = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        (('0x' || substr(md5('0/' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS w
    FROM sized GROUP BY source
), ordered AS (
    SELECT *, row_number() OVER (ORDER BY 3 * s / w, source IS NULL, source) AS k FROM sources
), sums AS (
    SELECT *, (SELECT sum(s) FROM sources) AS total, (SELECT sum(w) FROM sources) AS weights,
        coalesce(sum(3 * s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
        coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
    FROM ordered
), share AS (
    SELECT (total - held)::DOUBLE / (weights - gone)::DOUBLE AS each FROM sums
    WHERE 3 * s >= (total - held)::DOUBLE / (weights - gone)::DOUBLE * w ORDER BY k LIMIT 1
), targets AS (
    SELECT source, s AS source_size, least((3 * s)::DOUBLE, each * w) AS target,
        CASE WHEN s > 0 THEN least((3 * s)::DOUBLE, each * w) / s::DOUBLE ELSE 0.0 END AS ratio
    FROM sources, share
), base AS (
    SELECT d.doc_id, d.source, d.size, d.u, t.source_size, t.target, floor(t.ratio) AS sure, t.ratio - floor(t.ratio) AS p
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), ranked0 AS (
    SELECT doc_id, source, size, odds / (1 + odds) AS rank
    FROM (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS odds FROM base WHERE p > 0 AND size > 0)
), lack0 AS (
    SELECT source, target - floor(ratio) * source_size AS lack FROM targets WHERE target - floor(ratio) * source_size > 0
)""" + _fill(0, False) + _fill(1, False) + _fill(2, True) + """
, hits AS (
    SELECT doc_id FROM hits0 UNION ALL SELECT doc_id FROM hits1 UNION ALL SELECT doc_id FROM hits2
)
SELECT doc_id, size, source_size, target,
    (size * (sure + (doc_id IN (SELECT doc_id FROM hits))::INTEGER))::BIGINT AS taken,
    (sure + (doc_id IN (SELECT doc_id FROM hits))::INTEGER)::INTEGER AS copies, source
FROM base
"""

FILL_IN_MIDDLE = r"""
WITH worded AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
        sha256('1:' || doc_id::VARCHAR) AS h
    FROM documents
), drawn AS (
    SELECT *, len(w)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS b,
        CASE WHEN doc_id IS NULL OR text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
            WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM worded
), cut AS (
    SELECT *, array_to_string(w[1:least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS m,
        array_to_string(w[greatest(a, b) + 1:], '') AS s
    FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
        AS output_sha256,
    sha256(text) AS restored_sha256
FROM cut
"""

_NEAREST = """SELECT vec_id, v, arg_min(k, {'d': d, 'k': k}) AS k, min(d) AS d FROM (
    SELECT id, vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, """

CLUSTERS = """
WITH kept AS (
    SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), centroids0 AS (
    SELECT (row_number() OVER (ORDER BY h NULLS LAST, v) - 1)::INTEGER AS k, v AS c
    FROM (SELECT v, sha256('1:' || vec_id::VARCHAR) AS h FROM kept ORDER BY h NULLS LAST, v LIMIT 16)
)""" + "".join(f""", assigned{n} AS ({_NEAREST}centroids{n}) GROUP BY id, vec_id, v
), means{n} AS (
    SELECT k, list(m ORDER BY i) AS c FROM (
        SELECT k, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS m FROM assigned{n}, (SELECT unnest(range(1, 65)) AS i) GROUP BY k, i
    ) GROUP BY k
), centroids{n + 1} AS (
    SELECT k, coalesce(m.c, o.c) AS c FROM centroids{n} o LEFT JOIN means{n} m USING (k)
)""" for n in range(3)) + f""", assigned3 AS ({_NEAREST}centroids3) GROUP BY id, vec_id, v
)
SELECT vec_id, k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c, ',')) AS centroid_sha256
FROM assigned3 JOIN centroids3 USING (k)
"""

EXACT = """
WITH texts AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM texts
"""

ORACLES = {
    "op1_ball_tree_top_k": TOP_K,
    "op4_jaccard_join": JACCARD,
    "op7_suffix_dedup": SUBSTRINGS,
    "op8_pareto_mix": MIX,
    "op11_fill_in_middle": FILL_IN_MIDDLE,
    "op12_walsh_clusters": CLUSTERS,
    "op13_exact_dedup": EXACT,
}
