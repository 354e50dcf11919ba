"""Oracle SQL of the training-data queries that SQL can express."""

from __future__ import annotations

OP7_MINHASH = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM words, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * m >= 75 * (p.n + q.n - m)
), sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS node, b AS other FROM sides
  UNION SELECT r.node, e.b FROM reach r JOIN sides e ON e.a = r.other
), lowest AS (SELECT node, min(other) AS low FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON node = d.doc_id
"""

OP1_LM_SCORING = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), spots AS (
  SELECT doc_id, i, w[i] AS w0, CASE WHEN i > 1 THEN w[i - 1] END AS w1, CASE WHEN i > 2 THEN w[i - 2] END AS w2
  FROM words, unnest(generate_series(1, len(w))) AS t(i)
), c1 AS (SELECT w0, count(*) AS n FROM spots GROUP BY ALL),
c2 AS (SELECT w1, w0, count(*) AS n FROM spots WHERE w1 IS NOT NULL GROUP BY ALL),
c3 AS (SELECT w2, w1, w0, count(*) AS n FROM spots WHERE w2 IS NOT NULL GROUP BY ALL),
total AS (SELECT count(*) AS n FROM spots),
logs AS (
  SELECT doc_id, CASE
    WHEN t.n >= 2 THEN ln(t.n / cb.n)
    WHEN b.n >= 2 THEN ln(b.n / cu.n) + CASE WHEN spots.w2 IS NOT NULL THEN ln(0.4) ELSE 0 END
    ELSE ln(u.n / total.n) + CASE WHEN spots.w2 IS NOT NULL THEN 2 WHEN spots.w1 IS NOT NULL THEN 1 ELSE 0 END * ln(0.4) END AS l
  FROM spots JOIN c1 u USING (w0) CROSS JOIN total
  LEFT JOIN c3 t ON t.w2 = spots.w2 AND t.w1 = spots.w1 AND t.w0 = spots.w0
  LEFT JOIN c2 b ON b.w1 = spots.w1 AND b.w0 = spots.w0
  LEFT JOIN c2 cb ON cb.w1 = spots.w2 AND cb.w0 = spots.w1
  LEFT JOIN c1 cu ON cu.w0 = spots.w1
), sums AS (SELECT doc_id, sum(l) AS s FROM logs GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0), 4) AS log_score FROM words LEFT JOIN sums USING (doc_id)
"""

OP5_TOPK = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP8_VECTORS = """
WITH RECURSIVE fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), sides AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.9
), reach AS (
  SELECT a AS node, b AS other FROM sides
  UNION SELECT r.node, e.b FROM reach r JOIN sides e ON e.a = r.other
), lowest AS (SELECT node, min(other) AS low FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM sides GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts ON a = e.vec_id LEFT JOIN lowest ON node = e.vec_id
"""

def _vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    def nearest(book: str) -> str:
        square = "list_sum(list_transform(generate_series(1, len(x)), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
        return f"SELECT vec_id, p, x, min(d) AS d, min_by(e, (d, e)) AS e FROM (SELECT vec_id, p, x, e, coalesce({square}, 0) AS d FROM cut JOIN {book} USING (p)) GROUP BY vec_id, p, x"

    steps = []
    for r in range(rounds):
        steps.append(f"""a{r} AS ({nearest(f'c{r}')}),
means{r} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM (SELECT p, e, j, sum(x[j]) AS s, count(*) AS n FROM a{r}, unnest(generate_series(1, len(x))) AS t(j) GROUP BY p, e, j) GROUP BY p, e),
c{r + 1} AS (SELECT p, e, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN means{r} m USING (p, e))""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS (SELECT vec_id, CAST(p AS INTEGER) AS p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, unnest(generate_series(0, {parts - 1})) AS t(p)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries}),
c0 AS (SELECT p, e, x AS c FROM cut JOIN firsts USING (vec_id)),
{", ".join(steps)},
last AS ({nearest(f'c{rounds}')}),
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id) CROSS JOIN books
"""


OP11_VECTOR_CODES = _vector_codes()

def _manifest(levels: int = 7, over: int = 2) -> str:
    """Levels over rows and over groups are written out, as many as 8^7 rows a group and 64 groups need."""
    framed = lambda c: f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(framed(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    crc = "xor(4294967295, list_reduce(list_transform(generate_series(1, len(CAST(doc_id AS VARCHAR))), lambda i: CAST(ord(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)), lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295))"

    def tree(name: str, tree_of: str, most: int) -> list[str]:
        out = []
        for k in range(most):
            out.append(f"""{name}{k}s AS (SELECT {tree_of} AS t, pos, digest, count(*) OVER (PARTITION BY {tree_of}) AS n,
  coalesce(string_agg(digest, '') OVER (PARTITION BY {tree_of}, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(digest, '') OVER (PARTITION BY {tree_of}, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}),
{name}{k + 1} AS (SELECT t AS {tree_of}, pos // 8 AS pos, CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE min(digest) END AS digest FROM {name}{k}s GROUP BY t, pos // 8, n)""")
        return out

    steps = ["leaves AS (SELECT doc_id, lang, " + leaf("text") + f" AS digest, CASE WHEN {crc} % 3 = 0 THEN " + leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + " ELSE " + leaf("text") + " END AS claimed FROM documents)"]
    steps.append("a0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM leaves)")
    steps += tree("a", "lang", levels)
    steps.append(f"g0 AS (SELECT 1 AS one, lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM a{levels})")
    steps += tree("g", "one", over)
    steps.append("f0 AS (SELECT a0.doc_id, a0.digest AS leaf, a0.claimed AS f, '' AS siblings, a0.lang, a0.pos, g0.pos AS g, g0.digest AS subroot FROM a0 JOIN g0 ON g0.lang IS NOT DISTINCT FROM a0.lang)")
    for k in range(levels + over):
        side = f"a{k}s s ON s.t IS NOT DISTINCT FROM c.lang AND s.pos = c.pos // {8**k}" if k < levels else f"g{k - levels}s s ON s.pos = c.g // {8 ** (k - levels)}"
        steps.append(f"f{k + 1} AS (SELECT c.doc_id, c.leaf, CASE WHEN s.n > 1 THEN sha256(s.l || c.f || s.r) ELSE c.f END AS f, c.siblings || CASE WHEN s.n > 1 THEN s.l || s.r ELSE '' END AS siblings, c.lang, c.pos, c.g, c.subroot FROM f{k} c JOIN {side})")
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{levels + over} CROSS JOIN (SELECT digest AS root FROM g{over})"


OP12_MERKLE_MANIFEST = _manifest()

OP13_WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""

ORACLES: dict[str, str] = {"op1_lm_scoring": OP1_LM_SCORING, "op5_topk": OP5_TOPK, "op7_minhash": OP7_MINHASH, "op8_vectors": OP8_VECTORS, "op11_vector_codes": OP11_VECTOR_CODES, "op12_merkle_manifest": OP12_MERKLE_MANIFEST, "op13_warc": OP13_WARC}
