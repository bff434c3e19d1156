"""The same results in DuckDB's SQL, where SQL can express them.

Not here, with the tests that take SQL's place in tests/llm: op4 (bytes: a
brute-force scan of all windows), op5 and op9 (tokenizers: the tokenizers
library, an exact round trip, exhaustive search for bins), op6 (sampling: the
exact distribution and decoding), op8 and op10 (learned: held-out accuracy, and
distances by hand).
"""

from xylem.llm.secrets import ALLOW, CLASSES, RUN, entropy_bound, entropy_sums

_ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_VALUE = r"""(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, k: int, pattern: str, keep: str = "true") -> str:
    """Rows (doc_id, s, k, e, m) of a pattern's matches: lengths of the pieces between them and of them, summed."""
    return f"""SELECT doc_id, s, {k} AS k, s + length(m) AS e, m FROM (SELECT doc_id, m, list_sum(list_transform(p[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0)::BIGINT AS s
 FROM (SELECT doc_id, p, ms, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS ms FROM d))) WHERE {keep}"""


# RE2 has no back reference: a run of one repeated character is told by its distinct characters
_ALLOWED = " OR ".join(f"regexp_matches(m, '{p}')" for p in ALLOW if "\\1" not in p) + " OR len(list_distinct(string_split(m, ''))) = 1"


def _entropy() -> str:
    parts = []
    for j, c in enumerate(CLASSES):
        sums = "[" + ",".join(map(str, entropy_sums(c.window))) + "]"
        first = " AND ".join([f"regexp_full_match(m, '{c.runs}')", *(f"NOT regexp_full_match(m, '{b.runs}')" for b in CLASSES[:j])])
        parts.append(f"""SELECT doc_id, s + i AS a, {3 + j} AS k, {c.window} AS w FROM (SELECT doc_id, s, m, unnest(range(0, length(m) - {c.window} + 1)) AS i FROM runs WHERE {first})
 WHERE list_sum(list_transform(list_distinct(string_split(substr(m, i + 1, {c.window}), '')), lambda ch: {sums}[{c.window} - length(replace(substr(m, i + 1, {c.window}), ch, '')) + 1])) <= {entropy_bound(c.window, c.bits)}""")
    return " UNION ALL ".join(parts)


SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_spans("assign", 0, _ASSIGN, f"length(regexp_extract(m, '{_VALUE}', 1)) >= 8")} UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]{12,}")} UNION ALL {_spans("hex", 2, "[0-9a-f]{32,}")}),
found AS ({_spans("run", 9, RUN)}), runs AS (SELECT doc_id, s, m FROM found WHERE NOT ({_ALLOWED})),
hits AS ({_entropy()}),
marked AS (SELECT *, coalesce(a > max(a + w) OVER (PARTITION BY doc_id, k ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM hits),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, k ORDER BY a) AS g FROM marked),
spans AS (SELECT doc_id, s, k, e FROM base UNION ALL SELECT doc_id, min(a), k, max(a + w) FROM grouped GROUP BY doc_id, k, g),
named AS (SELECT doc_id, s, k, ['assign', 'access', 'hex', {", ".join(f"'{c.kind}'" for c in CLASSES)}][k + 1] || ':' || s || ':' || e AS x FROM spans),
totals AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2, string_agg(x, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS b, string_agg(x, ',' ORDER BY s, k) AS x FROM named GROUP BY 1)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(x, '') AS spans FROM d LEFT JOIN totals ON d.doc_id = totals.doc_id"""

NGRAMS = """WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c.k >= 80 * (a.k + b.k - c.k)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY 1) m ON m.x = d.doc_id"""

_FINE = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

TOPK = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE {_FINE}),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM p)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM k WHERE r <= 5"""

EMBEDDINGS = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS q FROM embeddings WHERE label IS NOT NULL AND {_FINE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.q) = len(b.q) WHERE list_cosine_similarity(a.q, b.q) >= 0.98),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(y, vec_id)) AS kept FROM embeddings
LEFT JOIN (SELECT x, count(*) AS n FROM e GROUP BY 1) c ON c.x = vec_id LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY 1) m ON m.x = vec_id"""

ORACLES: dict[str, str] = {"op1_secret_scans": SECRETS, "op2_ngram_jaccard_join": NGRAMS, "op3_exact_topk": TOPK, "op7_embedding_near_dedup": EMBEDDINGS}
