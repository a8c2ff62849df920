"""Queries of the training-data operators: op<N>_<name>(spark, sf_dir), and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusmill.llm import conversations, embedding_dedup, language_id, line_dedup, media, minhash, mixing, packing, resampling, sentence_pieces, suffix_dedup, toxicity, warc
from korpusmill.storage import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packer() -> packing.VectorBestFit:
    """Sequences of 4096 tokens, of up to 512 documents and of the attention cost of one full document, counted in tiles of 128 tokens; all three residuals choose."""
    return packing.VectorBestFit(4096, max_docs=512, weights=(1.0, 0.1, 0.1), tile=128, give_way=True)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents (ids of ``word_bpe_49k``, end id 1) and their places in sequences of at most 4096 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), packer=packer())


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: its ids' number and checksum, and what the decoded text is."""
    model, docs = tokenizer_file("piece_bpe_32k.model"), _table(spark, sf_dir, "documents")
    out = sentence_pieces.decode(sentence_pieces.encode(docs, model), model, text_col="decoded")
    return out.select("doc_id", "n_ids", "ids_crc32", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that a string of 100 bytes covers which also starts earlier: counts and checksum."""
    out = suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = """
WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT doc_id, unnest(range(0, n - 99)) AS s, b FROM bytes WHERE n >= 100),
hashed AS (SELECT doc_id, s, md5(hex(b[s + 1:s + 100])) AS h FROM starts),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS nth FROM hashed) WHERE nth > 1),
marked AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 1 ELSE 0 END AS new FROM again),
numbered AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM marked),
spans AS (SELECT doc_id, span, min(s) AS lo, max(s) + 100 AS hi FROM numbered GROUP BY doc_id, span),
gaps AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS z FROM spans
  UNION ALL SELECT doc_id, max(hi), 1000000000000 FROM spans GROUP BY doc_id),
rest AS (
  SELECT g.doc_id, string_agg(hex(b.b[g.a + 1:least(g.z, b.n)]), '' ORDER BY g.a) AS x FROM gaps g JOIN bytes b USING (doc_id) WHERE g.a < least(g.z, b.n) GROUP BY g.doc_id),
sums AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT b.doc_id, b.n::BIGINT AS n_bytes, coalesce(s.removed, 0)::BIGINT AS n_removed, coalesce(s.spans, 0)::BIGINT AS n_spans,
       CASE WHEN s.doc_id IS NULL THEN sha256(b.b) ELSE sha256(unhex(coalesce(r.x, ''))) END AS kept_sha256
FROM bytes b LEFT JOIN sums s USING (doc_id) LEFT JOIN rest r USING (doc_id)
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of 10 characters or more that one of smaller id holds: counts and checksum."""
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first, false) AS dropped
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key AND length(k.key) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document by a network trained on the labels that are not held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    net = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    out = toxicity.score(docs, net)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an image in an archive, read back by byte ranges: sizes, checksums, feature."""
    docs = _table(spark, sf_dir, "documents")
    folder = Scratch(spark, "media").path("archives")
    media.write_archives(docs, folder).agg(F.sum("members")).collect()
    return media.media_features(media.read_archives(spark, folder)).withColumnRenamed("id", "doc_id")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label with a cosine of 0.93 or more."""
    return embedding_dedup.embedding_links(_table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
labelled AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM labelled c LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = c.vec_id
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of a WARC archive, the archives read back: payload, digest, type, what a revisit refers to."""
    folder = Scratch(spark, "warc").path("archives")
    warc.write_warc(_table(spark, sf_dir, "pages"), folder).agg(F.sum("records")).collect()
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(encode(coalesce(html, ''))) AS h FROM pages),
last AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
digits AS (
  SELECT h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4)::INT)) & 31)), 1)), '') AS d
  FROM last)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN last USING (h) JOIN digits USING (h)
"""


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles are alike to 0.8 or more."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4)


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
items AS (SELECT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(s) AS x FROM sets)),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
pairs AS (
  SELECT c.a, c.b FROM common c JOIN sizes m ON m.doc_id = c.a JOIN sizes n ON n.doc_id = c.b WHERE 100 * c.c >= 80 * (m.n + n.n - c.c)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT r.a AS doc_id, any_value(s.n)::BIGINT AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM reach r JOIN sizes s ON s.doc_id = r.a GROUP BY r.a
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document (its source is the host) and every page (with declared language, address and host)."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    null = F.lit(None)
    rows = docs.select("doc_id", null.cast("long").alias("page_id"), "text", null.cast("string").alias("url"), "source", F.lit(False).alias("markup")).unionByName(
        pages.select(null.cast("long").alias("doc_id"), "page_id", F.col("html").alias("text"), F.coalesce("url", F.lit("")).alias("url"), null.cast("string").alias("source"), F.lit(True).alias("markup"))
    )
    return language_id.identify(rows, language_id.fit(docs), ["doc_id", "page_id"])


#: CRC-32's table by its rule (reflected polynomial 0xEDB88320), and the checksum of a string as an expression over it.
CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce(list_transform(range(8), lambda x: x::BIGINT), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i::BIGINT) ORDER BY i) AS t
  FROM range(256) r(i))"""


def _crc32_sql(text: str) -> str:
    """Of a string column ``text``, beside ``crc_table``."""
    octets = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: ('0x' || substr(hex(encode({text})), i::INT, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: xor(t[(1 + (xor(c, b) & 255))::INT], c >> 8), 4294967295::BIGINT))"


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents weighed by how near their words are to those of the benchmark texts, and the tenth of them drawn by weight and noise."""
    out = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, min_words=20, percent=10, seed=2024)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH {CRC_TABLE},
own AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents),
aim AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
vocabulary AS (SELECT DISTINCT word FROM own UNION SELECT word FROM aim),
hashed AS (SELECT word, {_crc32_sql("word")} % 10000 AS bucket FROM vocabulary, crc_table),
s AS (SELECT bucket, count(*) AS s FROM own JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aim JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM own) AS s_all, (SELECT count(*) FROM aim) AS t_all),
gains AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s.s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), sums),
per_doc AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM own JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
noisy AS (
  SELECT d.doc_id, coalesce(p.n, 0)::BIGINT AS n_features, coalesce(p.weight, 0)::BIGINT AS weight, coalesce(p.weight, 0)::BIGINT
         + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN per_doc p USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS fit FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= fit * 10 // 100 THEN place::BIGINT END AS rank FROM ranked
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, their faults and the cheapest edits that repair them."""
    out = conversations.repair(conversations.damage(_table(spark, sf_dir, "conversations")), present_col="present")
    return out.select("conv_id", *conversations.COUNTS, "audit", "repaired_sha256")


def _least(*candidates: str) -> str:
    return f"list_sort([{', '.join(candidates)}])[1]"


def _state(of: str, cost: str, letter: str, line: str | None = None) -> str:
    """A state (c, a, o): cost, audit, lines each after a line end."""
    return f"{{'c': {of}.c + {cost}, 'a': {of}.a || '{letter}', 'o': {of}.o{'' if line is None else ' || chr(10) || ' + line}}}"


def _inserted(s: str) -> str:
    """The four states after at most one insertion."""
    user = [_state(f"{s}[{q}]", "3", "I", "'user:'") for q in (1, 2, 4)]
    return f"[{s}[1], {s}[2], {_least(f'{s}[3]', *user)}, {_least(f'{s}[4]', _state(f'{s}[3]', '3', 'I', chr(39) + 'assistant:' + chr(39)))}]"


def _row(s: str) -> str:
    """The four states after a row (role, text, initial, must, pen)."""
    line, stay = "role || ':' || text", "CASE WHEN must THEN 1000000 ELSE pen END"
    kept = lambda q, initial: _state(f"{s}[{q}]", f"CASE WHEN initial = '{initial}' THEN {stay} ELSE 1000000 END", "K", line)
    given = lambda q, role: _state(f"{s}[{q}]", f"3 + {stay}", "R", f"'{role}:' || text")
    gone = [_state(f"{s}[{q}]", "4", "D") for q in (1, 2, 3, 4)]
    user = [x for q in (1, 2, 4) for x in (kept(q, "u"), given(q, "user"))]
    return f"[{gone[0]}, {_least(gone[1], kept(1, 's'))}, {_least(gone[2], *user)}, {_least(gone[3], kept(3, 'a'), given(3, 'assistant'))}]"


OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
marked AS (SELECT *, {_crc32_sql("name")} % 20 AS d FROM named, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM marked WHERE d <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, substr(role, 1, 1) AS initial
  FROM damaged),
judged AS (
  SELECT *, bare = '' AS blank, bare <> '' AND seen > 1 AS duplicate, bare <> '' AND seen = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
         count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal, max(i) AS rows
  FROM judged GROUP BY conv_id),
steps AS (SELECT conv_id, i, role, text, initial, blank OR duplicate AS must, CASE WHEN truncated THEN 3 ELSE 0 END AS pen FROM judged),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, [{{'c': 0, 'a': '', 'o': ''}}, {{'c': 1000000, 'a': '', 'o': ''}}, {{'c': 1000000, 'a': '', 'o': ''}}, {{'c': 1000000, 'a': '', 'o': ''}}] AS s FROM conversations
  UNION ALL
  SELECT conv_id, i, {_row("s2")} AS s FROM (
    SELECT *, {_inserted("s1")} AS s2 FROM (
      SELECT w.conv_id, t.i, t.role, t.text, t.initial, t.must, t.pen, {_inserted("w.s")} AS s1
      FROM walk w JOIN steps t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = w.i + 1))),
ended AS (
  SELECT conv_id, {_least("s2[1]", "s2[4]")} AS best FROM (
    SELECT conv_id, {_inserted("s1")} AS s2 FROM (
      SELECT w.conv_id, {_inserted("w.s")} AS s1 FROM walk w LEFT JOIN sums n ON w.conv_id IS NOT DISTINCT FROM n.conv_id WHERE w.i = coalesce(n.rows, 0))))
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       best.c::BIGINT AS cost, best.a AS audit, sha256(substr(best.o, 2)) AS repaired_sha256
FROM ended e LEFT JOIN sums n ON e.conv_id IS NOT DISTINCT FROM n.conv_id
"""


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a mix of all sources at weights 5, 2, 1 in turn takes of every document."""
    out = mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), percent=100, repeats=3, block_words=16, shard_words=1 << 14, seed=2024)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def _number_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def _apportioned(rows: str, by: str, key: str) -> str:
    """(by, key, quota) of ``rows`` (by, key, target, most, seats) by all quotients."""
    return f"""
  SELECT {by}, {key}, count(*) AS quota FROM (
    SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY target / (2 * k + 1) DESC, {key}) AS place
    FROM (SELECT *, unnest(range(0, least(most, seats)::BIGINT)) AS k FROM {rows}))
  WHERE place <= seats GROUP BY {by}, {key}"""


OP13_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         {_number_sql("'2024:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')")} AS h
  FROM documents),
have AS (SELECT source, sum(size)::BIGINT AS have FROM d GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM have),
weighed AS (SELECT *, [5, 2, 1][(1 + (nth - 1) % 3)::INT] AS weight, greatest(1, ceil(have / 16384))::BIGINT AS shards FROM placed),
levels AS (
  SELECT 0 AS step, (SELECT sum(have)::DOUBLE / sum(weight) FROM weighed) AS level
  UNION ALL
  SELECT l.step + 1, (sum(w.have) - coalesce(sum(3 * w.have) FILTER (WHERE w.weight * l.level > 3 * w.have), 0))::DOUBLE / sum(w.weight) FILTER (WHERE w.weight * l.level <= 3 * w.have)
  FROM levels l, weighed w WHERE l.step < 40 GROUP BY l.step, l.level),
targets AS (SELECT *, least((3 * have)::DOUBLE, weight * (SELECT max(level) FROM levels)) AS target FROM weighed),
tagged AS (SELECT d.doc_id, d.size, d.h, s.nth, d.h % s.shards AS shard FROM d JOIN targets s ON d.source IS NOT DISTINCT FROM s.source WHERE d.size > 0),
parts AS (SELECT nth, shard, sum(size)::DOUBLE AS target, greatest(1, round(sum(size)::DOUBLE / 16))::BIGINT AS blocks FROM tagged GROUP BY nth, shard),
claims AS (
  SELECT 0 AS every, t.nth, t.target, m.most, (SELECT floor((sum(target) + 0.5) / 16)::BIGINT FROM targets) AS seats
  FROM targets t JOIN (SELECT nth, 3 * sum(blocks) AS most FROM parts GROUP BY nth) m USING (nth)),
sources AS ({_apportioned("claims", "every", "nth")}),
shares AS (SELECT p.nth, p.shard, p.target, 3 * p.blocks AS most, s.quota AS seats FROM parts p JOIN sources s USING (nth)),
quotas AS ({_apportioned("shares", "nth", "shard")}),
plans AS (
  SELECT p.nth, p.shard, p.blocks, {_number_sql("'2024:' || p.nth || ':' || p.shard")} % p.blocks AS start, coalesce(q.quota, 0) // p.blocks AS times, coalesce(q.quota, 0) % p.blocks AS more
  FROM parts p LEFT JOIN quotas q USING (nth, shard)),
laid AS (SELECT *, sum(size) OVER (PARTITION BY nth, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS hi FROM tagged),
spans AS (SELECT l.doc_id, l.size, l.hi, l.hi - l.size AS lo, p.* FROM laid l JOIN plans p USING (nth, shard)),
cut AS (SELECT *, unnest(range(least(lo // 16, blocks - 1), least((hi - 1) // 16, blocks - 1) + 1)) AS k FROM spans),
taken AS (
  SELECT doc_id, sum((CASE WHEN k + 1 < blocks THEN least(hi, (k + 1) * 16) ELSE hi END - greatest(lo, k * 16)) * (times + CASE WHEN (k * 2147483629 + start) % blocks < more THEN 1 ELSE 0 END))::BIGINT AS taken
  FROM cut GROUP BY doc_id)
SELECT d.doc_id, d.size, s.have AS source_size, s.target, coalesce(t.taken, 0) AS taken FROM d JOIN targets s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN taken t USING (doc_id)
"""


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_media_columns": op6_media_columns,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_warc": op8_warc,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_language_id": op10_language_id,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_source_mixing": op13_source_mixing,
}
#: Tests hold the others against brute force: op1 (tokens, places), op2 (public library), op5 (plain network, held-out rows), op6 (plain image reader), op10 (plain fusion).
ORACLE_SQL = {
    "op3_suffix_dedup": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op7_embedding_near_dedup": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op9_minhash_near_dedup": OP9_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
    "op13_source_mixing": OP13_SQL,
}
