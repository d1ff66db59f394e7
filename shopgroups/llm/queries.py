"""The corpus queries and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from .conversations import op12_conversations
from .jaccard import PERCENT, SHINGLE, op4_jaccard
from .licences import op10_licences
from .metric_tree import SCALE as PRODUCT_SCALE
from .metric_tree import op11_products
from .orchard import ENTRIES, PARTS, ROUNDS, SCALE, op13_codes
from .packing import op5_packing
from .piecewise import op2_pieces
from .secrets import BASE, COPIED_OWNERS, COPIED_REPOS, KINDS, PLACEHOLDERS, op9_secrets
from .sharding import op7_sharding
from .token_counts import op8_token_counts
from .toxicity import op6_toxicity
from .vectors import op3_vectors
from .versions import op1_versions

QUERIES = {f.__name__: f for f in (op1_versions, op2_pieces, op3_vectors, op4_jaccard, op5_packing, op6_toxicity, op7_sharding, op8_token_counts, op9_secrets,
                                   op10_licences, op11_products, op12_conversations, op13_codes)}


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hits(no: int) -> str:
    """All matches of one kind: their texts, values, and the texts between them."""
    p = _sql_text(KINDS[no][1])
    return f"""SELECT uid, repo, owner, {no} AS kind_no, {KINDS[no][2]} AS shortest, unnest(range(1, len(m) + 1)) AS i, m, v, g
  FROM (SELECT uid, repo, owner, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, 1) AS v,
               regexp_split_to_array(text, {p}) AS g FROM t) WHERE len(m) > 0"""


_NAMES = "[" + ", ".join(_sql_text(k[0]) for k in KINDS) + "]"
_SECRETS = f"""
WITH t AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '') AS repo, coalesce(source, '') AS owner FROM documents),
h AS ({' UNION ALL '.join(_hits(no) for no in range(len(KINDS)))}),
c AS (SELECT uid, repo, owner, kind_no, v[i] AS value, regexp_replace(v[i], '[^A-Za-z0-9]', '', 'g') AS bare,
             (list_sum([length(x) for x in g[1:i]]) + list_sum([length(x) for x in m[1:i]]))::BIGINT AS stop, length(m[i]) AS n
      FROM h WHERE length(v[i]) >= shortest AND (kind_no < {BASE} OR (
        regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[a-z]') AND regexp_matches(v[i], '[A-Z]')))),
o AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT (repo, owner)) AS repos FROM c GROUP BY value),
s AS (SELECT uid, kind_no, stop - n AS start, stop, CASE WHEN owners >= {COPIED_OWNERS} OR repos >= {COPIED_REPOS} THEN 'copied'
             WHEN 2 * length(regexp_replace(bare, {_sql_text(PLACEHOLDERS)}, '', 'g')) < length(bare) THEN 'placeholder' ELSE 'live' END AS status
      FROM c JOIN o USING (value)),
f AS (SELECT *, {_NAMES}[kind_no + 1] || ':' || start || ':' || stop AS name FROM s
      WHERE kind_no < {BASE} OR (status = 'live' AND NOT EXISTS (
        SELECT 1 FROM s b WHERE b.uid = s.uid AND b.kind_no < {BASE} AND b.start < s.stop AND s.start < b.stop)))
SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex,
       sha256(coalesce(string_agg(name, ',' ORDER BY start, kind_no) FILTER (kind_no < {BASE}), '')) AS base_sha256,
       coalesce(string_agg(name, ',' ORDER BY start, kind_no), '') AS spans,
       count(*) FILTER (status = 'live') AS n_live, count(*) FILTER (status = 'copied') AS n_copied
FROM t LEFT JOIN f USING (uid) GROUP BY uid, doc_id"""

#: All pairs that share a shingle, then reachability; for tables of some thousand documents.
_JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\\x20\\x09-\\x0D]+') if x <> ''] AS words FROM documents),
d AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < {SHINGLE} THEN [array_to_string(words, ' ')]
             ELSE [array_to_string(words[i:i + {SHINGLE - 1}], ' ') for i in range(1, len(words) - {SHINGLE - 2})] END) AS grams FROM w),
u AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM d),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS shared
      FROM u a JOIN u b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p WHERE 100 * shared >= {PERCENT} * (n + m - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT d.doc_id, len(d.grams) AS n_shingles, least(d.doc_id, min(r.b)) AS component_id
FROM d JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, d.grams"""



def _finite(scale: int) -> str:
    """floor(scale * component) of the vectors without null or non-finite components."""
    return f"""SELECT *, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"""


#: Every query against every vector.
_PRODUCTS = f"""
WITH v AS ({_finite(PRODUCT_SCALE)}),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([a[1] * a[2] for a in list_zip(q.z, c.z)])::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def _rounds() -> str:
    """Each round: every part's nearest entry, then the entries' floored means."""
    steps = []
    for n in range(ROUNDS + 1):
        steps.append(f"""
d{n} AS (SELECT x.vec_id, x.part, b.entry, x.v, list_sum([(a[1] - a[2]) ** 2 for a in list_zip(x.v, b.v)])::BIGINT AS far FROM x JOIN b{n} b USING (part)),
a{n} AS (SELECT * FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY far, entry) = 1)""")
        if n < ROUNDS:
            steps.append(f"""
m{n} AS (SELECT part, entry, i, sum(c)::BIGINT AS s, count(*) AS k FROM (SELECT part, entry, unnest(v) AS c, unnest(range(1, len(v) + 1)) AS i FROM a{n}) GROUP BY ALL),
e{n} AS (SELECT part, entry, list((s - ((s % k) + k) % k) // k ORDER BY i) AS v FROM m{n} GROUP BY ALL),
b{n + 1} AS (SELECT b.part, b.entry, coalesce(e.v, b.v) AS v FROM b{n} b LEFT JOIN e{n} e USING (part, entry))""")
    return ",".join(steps)


#: All distances of parts to entries, three times.
_CODES = f"""
WITH k AS ({_finite(SCALE)}),
x AS (SELECT vec_id, label, unnest(range({PARTS})) AS part, z[part * (len(z) // {PARTS}) + 1: (part + 1) * (len(z) // {PARTS})] AS v FROM k),
b0 AS (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, v FROM x QUALIFY entry < {ENTRIES}),{_rounds()},
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
t AS (SELECT label, sum(error)::BIGINT AS label_error FROM c JOIN k USING (vec_id) GROUP BY label),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM c JOIN k USING (vec_id) JOIN t ON t.label IS NOT DISTINCT FROM k.label, h"""

ORACLE_SQL: dict[str, str] = {"op4_jaccard": _JACCARD, "op9_secrets": _SECRETS, "op11_products": _PRODUCTS, "op13_codes": _CODES}
