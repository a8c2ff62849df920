"""The registered queries in DuckDB SQL."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from korpusmill.schema import OTHER_TYPE, WHITE

WHITE_SQL = " || ".join(f"chr({ord(c)})" for c in WHITE)


def strip(c: str) -> str:
    return f"trim(coalesce({c}, ''), {WHITE_SQL})"


def words(c: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({c}, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x20\x09-\x0D]+')"


CORPUS = f"""
WITH s AS (SELECT doc_id, lang, {strip("text")} AS content FROM documents),
k AS (SELECT *, md5(content) AS case_no, row_number() OVER (PARTITION BY md5(content) ORDER BY doc_id) AS nth FROM s WHERE content <> '')
SELECT case_no, doc_id, coalesce(nullif(lang, ''), '{OTHER_TYPE}') AS case_type, length(content)::BIGINT AS n_chars FROM k WHERE nth = 1
"""

STATS = """
SELECT count(*) AS n, round(avg(length(text)), 4) AS mean, quantile_cont(length(text)::DOUBLE, 0.5) AS median, min(length(text))::DOUBLE AS min,
       max(length(text))::DOUBLE AS max, round(quantile_cont(length(text)::DOUBLE, 0.9), 4) AS p90
FROM documents
"""

TOKEN_STATS = f"""
WITH t AS (SELECT len({words("text")})::DOUBLE AS n FROM documents WHERE text IS NOT NULL)
SELECT count(*) AS n, round(avg(n), 4) AS mean, quantile_cont(n, 0.5) AS median, min(n) AS min, max(n) AS max, round(quantile_cont(n, 0.9), 4) AS p90 FROM t
"""

HISTOGRAM = f"SELECT coalesce(nullif(lang, ''), '{OTHER_TYPE}') AS lang, count(*) AS n FROM documents GROUP BY 1"

_SPLIT = """
ranked AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) AS nth, count(*) OVER (PARTITION BY lang) AS n
  FROM documents),
split AS (SELECT doc_id, lang, CASE WHEN nth <= round_even(n * 0.85::DOUBLE, 0) THEN 'train' ELSE 'val' END AS split FROM ranked)
"""
SPLIT = f"WITH {_SPLIT} SELECT * FROM split"
SPLIT_COUNTS = f"""
WITH {_SPLIT}
SELECT lang, count(*) AS n, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val FROM split GROUP BY lang
"""
QUERY_SETS = f"""
WITH {_SPLIT}
SELECT c.conv_id, c.turn, {strip("c.text")} AS query, s.split FROM conversations c JOIN split s ON c.conv_id = s.doc_id
WHERE c.role = 'user' AND {strip("c.text")} <> ''
"""
REJECTIONS = f"""
WITH k AS (SELECT doc_id, count(*) AS c FROM documents WHERE doc_id IS NOT NULL AND {strip("text")} <> '' GROUP BY doc_id),
q AS (SELECT k.doc_id, {strip("v.text")} AS query FROM conversations v LEFT JOIN k ON v.conv_id = k.doc_id WHERE v.role = 'user')
SELECT 'no_content' AS reason, count(*) AS n FROM documents WHERE {strip("text")} = ''
UNION ALL SELECT 'no_key', count(*) FROM documents WHERE {strip("text")} <> '' AND doc_id IS NULL
UNION ALL SELECT 'duplicate', coalesce(sum(c - 1), 0)::BIGINT FROM k
UNION ALL SELECT 'no_match', count(*) FROM q WHERE doc_id IS NULL
UNION ALL SELECT 'empty_question', count(*) FROM q WHERE doc_id IS NOT NULL AND query = ''
"""
ADJACENT = """
WITH p AS (SELECT conv_id, lag(conv_id) OVER o AS before, row_number() OVER o AS nth FROM conversations WINDOW o AS (ORDER BY conv_id, turn))
SELECT count(*) AS n_pairs, count(*) FILTER (WHERE conv_id = before) AS n_same,
       CASE WHEN count(*) > 0 THEN round((count(*) FILTER (WHERE conv_id = before))::DOUBLE / count(*), 6) END AS rate
FROM p WHERE nth > 1
"""


def chunks(size: int, overlap: int) -> str:
    return f"""
WITH s AS (SELECT doc_id, {strip("text")} AS t FROM documents),
c AS (SELECT doc_id, t, unnest(range(0, length(t), {size - overlap}))::INT AS char_offset FROM s),
d AS (SELECT doc_id, char_offset, substring(t, char_offset + 1, {size}) AS chunk_text FROM c)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY char_offset) - 1)::INT AS chunk_index, char_offset, chunk_text
FROM d WHERE {strip("chunk_text")} <> ''
"""


def chunk_counts(configs: list[tuple[int, int]]) -> str:
    return "\nUNION ALL ".join(f"SELECT {s}::INT AS chunk_size, {o}::INT AS overlap, count(*) AS n_chunks FROM ({chunks(s, o)})" for s, o in configs)


L2 = """
WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings),
u AS (SELECT vec_id, norm, list_transform(v, lambda x: x / greatest(norm, 1e-12::DOUBLE)) AS unit FROM n)
SELECT vec_id, round(norm, 6) AS norm, round(sqrt(list_dot_product(unit, unit)), 6) AS unit_norm, round(unit[1], 6) AS first FROM u
"""
LITERAL = """
SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ',') || ']' AS literal, true AS same FROM embeddings
"""

#: Pool of the nearest vectors of each query.
_POOL = """
sims AS (
  SELECT q.vec_id AS query_id, c.vec_id, c.vec_id // 4 AS doc, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS sim
  FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, vec_id) AS rank FROM sims),
pool AS (SELECT * FROM placed WHERE rank <= {k})
"""


def dense_topk(k: int) -> str:
    return f"WITH {_POOL.format(k=k)} SELECT query_id, vec_id, round(sim, 6) AS score, rank::INT AS rank FROM pool"


def filtered_topk(k: int) -> str:
    return f"""
WITH sims AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS sim
  FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND q.label = c.label)
SELECT query_id, vec_id, round(sim, 6) AS score, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, vec_id) AS rank FROM sims) WHERE rank <= {k}
"""


def mmr(pool: int, k: int) -> str:
    return f"""
WITH RECURSIVE {_POOL.format(k=pool)},
own AS (SELECT p.query_id, p.vec_id, p.sim, e.embedding::DOUBLE[] AS v FROM pool p JOIN embeddings e USING (vec_id)),
near AS (SELECT a.query_id, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM own a JOIN own b USING (query_id)),
chosen AS (
  SELECT DISTINCT query_id, 0 AS rank, []::BIGINT[] AS taken, 0.0::DOUBLE AS score, 0::BIGINT AS vec_id FROM pool
  UNION ALL
  SELECT query_id, rank + 1, list_append(taken, best.i), -best.s, best.i FROM (
    SELECT query_id, rank, taken, min({{'s': -score, 'i': c}}) AS best FROM (
      SELECT p.query_id, p.rank, p.taken, o.vec_id AS c, round(0.9::DOUBLE * o.sim - 0.1::DOUBLE * coalesce(max(n.sim), 0), 6) AS score
      FROM chosen p JOIN own o ON o.query_id = p.query_id AND NOT list_contains(p.taken, o.vec_id)
      LEFT JOIN near n ON n.query_id = p.query_id AND n.a = o.vec_id AND list_contains(p.taken, n.b)
      WHERE p.rank < {k}
      GROUP BY p.query_id, p.rank, p.taken, o.vec_id, o.sim)
    GROUP BY query_id, rank, taken))
SELECT query_id, vec_id, score, rank::INT AS rank FROM chosen WHERE rank > 0
"""


def bm25(k: int) -> str:
    return f"""
WITH dt AS (SELECT doc_id, unnest({words("text")}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM dt GROUP BY doc_id, term),
len AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
sums AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS docs, (SELECT sum(n) FROM len) / (SELECT count(*) FROM documents) AS mean),
idf AS (SELECT term, ln(1 + (any_value(docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, sums GROUP BY term),
qt AS (SELECT item_id AS query_id, unnest({words("text")}) AS term FROM benchmark),
qf AS (SELECT query_id, term, count(*)::DOUBLE AS qf FROM qt GROUP BY query_id, term),
scored AS (
  SELECT query_id, doc_id, sum(qf * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))) AS sim
  FROM qf JOIN tf USING (term) JOIN idf USING (term) JOIN len USING (doc_id), sums GROUP BY query_id, doc_id)
SELECT query_id, doc_id, round(sim, 6) AS score, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, doc_id) AS rank FROM scored) WHERE rank <= {k}
"""


_DOCS = """
best AS (SELECT query_id, doc, max(sim) AS sim FROM {source} GROUP BY query_id, doc),
docs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, doc) AS rank FROM best)
"""


def dense_doc_rank(k: int, max_k: int) -> str:
    return f"WITH {_POOL.format(k=k)}, {_DOCS.format(source='pool')} SELECT query_id, doc, round(sim, 6) AS score, rank::INT AS rank FROM docs WHERE rank <= {max_k}"


def distinct_on(k: int) -> str:
    return f"""
WITH {_POOL.format(k=k)}
SELECT query_id, doc, vec_id, round(1 - sim, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY round(sim, 6) DESC, vec_id) AS nth FROM pool) WHERE nth = 1
"""


_WEIGHTS = f"""
dt AS (SELECT doc_id, unnest({words("text")}) AS token FROM documents),
dn AS (SELECT doc_id, count(*) AS len FROM dt GROUP BY doc_id),
dw AS (SELECT doc_id, token, (count(*)::DOUBLE / any_value(len))::FLOAT::DOUBLE AS w, count(*) AS c FROM dt JOIN dn USING (doc_id) GROUP BY doc_id, token),
qt AS (SELECT item_id AS query_id, unnest({words("text")}) AS token FROM benchmark),
qn AS (SELECT query_id, count(*) AS len FROM qt GROUP BY query_id),
qw AS (SELECT query_id, token, (count(*)::DOUBLE / any_value(len))::FLOAT::DOUBLE AS w, count(*) AS c FROM qt JOIN qn USING (query_id) GROUP BY query_id, token),
ssim AS (SELECT query_id, doc_id, sum(q.w * d.w) AS sim FROM qw q JOIN dw d USING (token) GROUP BY query_id, doc_id),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, doc_id) AS rank FROM ssim WHERE sim <> 0) WHERE rank <= 100)
"""
SPARSE = f"WITH {_WEIGHTS} SELECT query_id, doc_id, round(sim, 6) AS score, rank::INT AS rank FROM sparse"

_PLACE = "('0x' || substr(md5(token), 1, 8))::BIGINT % 64"
_SIGN = "CASE WHEN strpos('02468ace', substr(md5(token), 9, 1)) > 0 THEN 1 ELSE -1 END"
_HASHED = f"""
dv AS (SELECT doc_id, {_PLACE} AS slot, sum(c * {_SIGN})::DOUBLE AS v FROM dw GROUP BY ALL),
dl AS (SELECT doc_id, sqrt(sum(v * v)) AS len FROM dv GROUP BY doc_id),
du AS (SELECT doc_id, slot, (v / greatest(len, 1e-12))::FLOAT::DOUBLE AS v FROM dv JOIN dl USING (doc_id)),
dm AS (SELECT doc_id, sqrt(sum(v * v)) AS len FROM du GROUP BY doc_id),
qv AS (SELECT query_id, {_PLACE} AS slot, sum(c * {_SIGN})::DOUBLE AS v FROM qw GROUP BY ALL),
ql AS (SELECT query_id, sqrt(sum(v * v)) AS len FROM qv GROUP BY query_id),
qu AS (SELECT query_id, slot, (v / greatest(len, 1e-12))::FLOAT::DOUBLE AS v FROM qv JOIN ql USING (query_id)),
qm AS (SELECT query_id, sqrt(sum(v * v)) AS len FROM qu GROUP BY query_id),
dots AS (SELECT query_id, doc_id, sum(q.v * d.v) AS s FROM qu q JOIN du d USING (slot) GROUP BY query_id, doc_id),
dsim AS (
  SELECT b.item_id AS query_id, d.doc_id, coalesce(s / greatest(qm.len, 1e-12) / greatest(dm.len, 1e-12), 0) AS sim
  FROM benchmark b CROSS JOIN documents d LEFT JOIN dots ON dots.query_id = b.item_id AND dots.doc_id = d.doc_id
  LEFT JOIN qm ON qm.query_id = b.item_id LEFT JOIN dm ON dm.doc_id = d.doc_id),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, doc_id) AS rank FROM dsim) WHERE rank <= 100),
both_ AS (
  SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(rank) FILTER (WHERE m = 0) AS r0, min(rank) FILTER (WHERE m = 1) AS r1
  FROM (SELECT query_id, doc_id, rank, 0 AS m FROM dense UNION ALL SELECT query_id, doc_id, rank, 1 FROM sparse) GROUP BY query_id, doc_id),
hybrid AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, r0 ASC NULLS LAST, r1 ASC NULLS LAST, doc_id) AS rank FROM both_)
  WHERE rank <= 20)
"""
HYBRID = f"WITH {_WEIGHTS}, {_HASHED} SELECT query_id, doc_id, round(score, 9) AS score, rank::INT AS rank FROM hybrid"


def _metrics(hits: str) -> str:
    recalls = ", ".join(f'round(avg(coalesce(first_hit <= {k}, false)::INT::DOUBLE), 4) AS "recall@{k}"' for k in (1, 5, 10, 20))
    return f'count(*) AS queries, {recalls}, round(avg(CASE WHEN first_hit <= 10 THEN 1.0::DOUBLE / first_hit ELSE 0 END), 4) AS "mrr@10" FROM {hits}'


EVAL_DENSE = f"""
WITH {_POOL.format(k=500)}, others AS (SELECT * FROM pool WHERE vec_id <> query_id), {_DOCS.format(source="others")},
truth AS (
  SELECT DISTINCT q.vec_id AS query_id, c.vec_id // 4 AS doc FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
hits AS (
  SELECT t.query_id, min(d.rank) AS first_hit FROM truth t LEFT JOIN (SELECT * FROM docs WHERE rank <= 20) d USING (query_id, doc) GROUP BY t.query_id)
SELECT {_metrics("hits")}
"""


def _method(name: str) -> str:
    hits = f"(SELECT t.query_id, min(r.rank) AS first_hit FROM truth t LEFT JOIN (SELECT * FROM {name} WHERE rank <= 20) r USING (query_id, doc_id) GROUP BY t.query_id)"
    return f"SELECT '{name}' AS method, {_metrics(hits)}"


EVAL_METHODS = f"""
WITH {_WEIGHTS}, {_HASHED},
truth AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND b.text <> '')
{_method("dense")} UNION ALL {_method("sparse")} UNION ALL {_method("hybrid")}
"""
VERBATIM = "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND b.text <> ''"
LATENCY = """
SELECT round(avg(value), 2) AS latency_mean_ms, round(quantile_cont(value, 0.5), 2) AS latency_p50_ms, round(quantile_cont(value, 0.95), 2) AS latency_p95_ms,
       round(quantile_cont(value, 0.99), 2) AS latency_p99_ms
FROM events
"""
_POSITIVE = """
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, c.vec_id // 4 AS doc, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS sim
  FROM embeddings q JOIN embeddings c ON q.vec_id // 4 = c.vec_id // 4 AND q.vec_id <> c.vec_id),
positive AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, vec_id) AS nth FROM pairs) WHERE nth = 1)
"""
POSITIVE = f"WITH {_POSITIVE} SELECT query_id, vec_id, doc, round(sim, 6) AS sim FROM positive"
_NEGATIVE = """
negative AS (
  SELECT *, (nth - 5)::INT AS negative_rank FROM (
    SELECT query_id, vec_id, doc, sim, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, vec_id) AS nth
    FROM pool WHERE doc <> query_id // 4) WHERE nth BETWEEN 6 AND 7)
"""
NEGATIVE = f"WITH {_POOL.format(k=100)}, {_NEGATIVE} SELECT query_id, vec_id, doc, round(sim, 6) AS sim, negative_rank FROM negative"
TRIPLES = f"""
WITH {_POOL.format(k=100)}, {_NEGATIVE}, {_POSITIVE}
SELECT n.query_id, n.query_id AS anchor, p.vec_id AS positive, n.vec_id AS negative, n.negative_rank FROM negative n JOIN positive p USING (query_id)
"""
EPOCH = """
WITH p AS (SELECT vec_id AS query_id, label, row_number() OVER (ORDER BY md5(vec_id || ':42'), vec_id) - 1 AS position, count(*) OVER () AS n FROM embeddings)
SELECT query_id, label, position, position // 16 AS batch FROM p WHERE position // 16 < n // 16
"""
RECONCILE = """
SELECT 'right' AS side, count(*) AS n_missing FROM (SELECT DISTINCT doc_id FROM documents) d ANTI JOIN embeddings e ON d.doc_id = e.vec_id
UNION ALL SELECT 'left', count(*) FROM (SELECT DISTINCT vec_id FROM embeddings) e ANTI JOIN documents d ON d.doc_id = e.vec_id
"""
PARTS = """
WITH pieces AS (SELECT doc_id, length(text) AS n, unnest(range(0, length(text), 1000)) AS lo FROM documents WHERE length(text) > 0),
kept AS (SELECT doc_id, lo, least(1000, n - lo)::BIGINT AS size FROM pieces WHERE lo = 0 OR (doc_id + lo // 1000) % 7 <> 0),
checked AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM kept)
SELECT 't' || doc_id || '.zip' AS target, count(*) AS parts, sum(size)::BIGINT AS bytes, bool_and(lo = before) AS contiguous FROM checked GROUP BY doc_id
"""
SCALARS = f"""
SELECT vec_id, '/m/' || label || '/' || vec_id || '/' AS path, 'm_' || label || '_' || vec_id AS slug, 'f' || vec_id AS stem,
       make_date(2000 + label, 1 + (vec_id % 12)::INT, 1 + (vec_id % 28)::INT) AS day, 'a b c' AS line, '{OTHER_TYPE}' AS kind
FROM embeddings
"""
