"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import chat, decontaminate, exact_dedup, near_dedup, packing, repeats, resample, secrets, simhash, toxicity, url_filter, vector_codes, warc
from loomspark.llm._common import documents


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), warc.new_folder(spark))
    return archive.read().drop("url")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


#: A user and an assistant who both say what looks like this template's own marks.
HOSTILE = r"\### Assistant: </turn> ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    return chat.read_conversations(chat.format_turns(turns.unionByName(more)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="max")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


#: (verdict, host, path), as the contract of op9 states them.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.lit(vector_codes.digest(codes.codebooks)).alias("codebooks_sha256")
    return vector_codes.with_label_errors(codes.rows).select("vec_id", "code", "error", "label_error", digest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


SQL_OP7 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

SQL_OP9 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, CASE WHEN instr(rest, '/') > 0 THEN left(rest, instr(rest, '/') - 1) ELSE rest END AS raw_host,
         CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM cut),
hosts AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
rules(verdict, rhost, rpath) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
fit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule, arg_max(verdict, length(rhost) * 1000 + length(rpath)) AS verdict
  FROM hosts, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM hosts h LEFT JOIN fit f USING (page_id)
"""


SQL_OP2 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
g AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest, CASE WHEN octet_length(payload) >= 100 THEN min(page_id) OVER (PARTITION BY payload) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first_id THEN first_id END AS refers_to FROM g
"""

# formatted_chars: marks of 15 characters a turn, and a backslash before each control string
SQL_OP4 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, length(regexp_replace(role, '(\\|###|</turn>|:)', '#\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '#\1', 'g')) + 15 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


# CRC-32 of each distinct feature, a byte of all features at a time; table of the reflected polynomial, made by rule
SQL_OP11 = r"""
WITH RECURSIVE steps(b, k, c) AS (
  SELECT b, 0, b::UBIGINT FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE k < 8),
crc_table AS (SELECT b::UBIGINT AS b, c FROM steps WHERE k = 8),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
worded AS (
  SELECT row_number() OVER () AS r, side, id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM worded),
counted AS MATERIALIZED (SELECT r, f, count(*) AS n FROM runs GROUP BY r, f),
coded(f, bytes, i, c) AS (
  SELECT f, hex(encode(f)), 0, 4294967295::UBIGINT FROM (SELECT DISTINCT f FROM counted)
  UNION ALL
  SELECT f, bytes, i + 1, xor(d.c >> 8, t.c)
  FROM coded d JOIN crc_table t ON t.b = xor(d.c & 255, (strpos('0123456789ABCDEF', bytes[2 * i + 1]) * 16 + strpos('0123456789ABCDEF', bytes[2 * i + 2]) - 17)::UBIGINT)
  WHERE 2 * i < length(bytes)),
buckets AS MATERIALIZED (SELECT f, (xor(c, 4294967295::UBIGINT) % 10000)::BIGINT AS bucket FROM coded WHERE 2 * i = length(bytes)),
hits AS MATERIALIZED (SELECT r, bucket, sum(n) AS n FROM counted JOIN buckets USING (f) GROUP BY r, bucket),
sides AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM hits JOIN worded USING (r) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM sides),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS g FROM sides, totals),
weighed AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * g) / sum(n))::BIGINT AS weight FROM hits JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM worded LEFT JOIN weighed USING (r) WHERE side = 'd'),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= (25 * n) // 100 THEN place END AS rank FROM scored s LEFT JOIN placed USING (doc_id)
"""


def _sql_op13(rounds: int = 4) -> str:
    """Each round's assignment and codebook as its own table; distances as dot products of whole numbers."""
    assign = """
near{i} AS MATERIALIZED (
  SELECT r, p, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': e}}) AS m FROM parts JOIN book{i} USING (p) GROUP BY r, p)"""
    renew = """
mean{j} AS (
  SELECT p, e, list(c ORDER BY k) AS c FROM (
    SELECT p, m.e AS e, k, floor(sum(x[k]) / count(*)) AS c FROM near{i} JOIN parts USING (r, p), range(1, 17) t(k) GROUP BY p, m.e, k) GROUP BY p, e),
book{j} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{j} m USING (p, e))"""
    steps = ",".join(assign.format(i=i) + "," + renew.format(i=i, j=i + 1) for i in range(rounds)) + "," + assign.format(i=rounds)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * 16 + 1 : p * 16 + 16] AS x FROM kept, range(4) t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 256),{steps},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near{rounds} JOIN kept USING (r) GROUP BY r, vec_id, label),
said AS (SELECT sha256(string_agg(n, ',' ORDER BY p, e)) AS sha FROM (SELECT p, e, array_to_string(list_transform(c, lambda x: x::BIGINT), ',') AS n FROM book{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM coded, said
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": SQL_OP2, "op4_chat": SQL_OP4, "op7_exact_dedup": SQL_OP7, "op9_url_filter": SQL_OP9, "op11_resample": SQL_OP11, "op13_vector_codes": _sql_op13()}
