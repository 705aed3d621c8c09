"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import chat, crosstok, decontam, golden, lm, mixing, pii, simhash, subword, tokens, topk, toxicity, warc


SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, strlen(h) AS payload_bytes, sha1(h) AS x FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform(range(4), lambda k:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, (5 * g + 1)::INT, 5))::BIGINT) >> ((15 - 5 * k)::INT)) & 31)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, url
FROM m""",
    "op4_chat": r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i)
), e AS (
  SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS er,
         replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS et FROM r
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         7 + 8 + sum(8 + length(er) + length(et) + 9) AS formatted_chars
  FROM e GROUP BY conv_id
), o AS (
  SELECT conv_id, role, row_number() OVER w AS n, lag(role) OVER w AS ahead, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), v AS (
  SELECT conv_id, CASE WHEN bool_and(CASE WHEN n = 1 THEN role IN ('system', 'user') ELSE (ahead, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) END)
                  THEN max(role) FILTER (back = 1) ELSE 'invalid' END AS state
  FROM o GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars, state = 'assistant' AS valid, state FROM g JOIN v USING (conv_id)""",
    "op7_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10""",
    "op10_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), r AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         row_number() OVER w AS k,
         coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source)
), l AS (
  SELECT (total - full_before)::DOUBLE / (weights - weight_before)::DOUBLE AS level FROM r
  WHERE (3 * source_size)::DOUBLE >= ((total - full_before)::DOUBLE / (weights - weight_before)::DOUBLE) * weight
  ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, CASE weight WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS a, CASE WHEN (3 * source_size)::DOUBLE < level * weight THEN (3 * source_size)::DOUBLE ELSE weight * level END AS target
  FROM s, l
), b AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.a,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies,
       CASE WHEN copies > 0 THEN CASE WHEN a = 1 THEN u ELSE 2 * u / (a + sqrt(greatest(a * a + 4 * (1 - a) * u, 0))) END END AS position
FROM (SELECT *, len(list_filter([0, 1, 2], lambda e: e * source_size + before + size / 2 < target))::BIGINT AS copies, (before + size / 2) / nullif(target, 0) AS u FROM b)""",
    "op12_golden": r"""
WITH c AS (
  SELECT coalesce(master_id, client_id) AS cluster_id, client_id, epoch_us(updated_at) AS upd, nation_id,
         CASE source WHEN 'crm' THEN 4 WHEN 'web' THEN 3 WHEN 'store' THEN 2 WHEN 'partner' THEN 1 ELSE 0 END AS trust,
         CASE WHEN regexp_matches(name, '[^\x20\x09-\x0D]') THEN name END AS name, CASE WHEN regexp_matches(email, '[^\x20\x09-\x0D]') THEN email END AS email,
         CASE WHEN regexp_matches(segment, '[^\x20\x09-\x0D]') THEN segment END AS segment, CASE WHEN regexp_matches(city, '[^\x20\x09-\x0D]') THEN city END AS city,
         CASE WHEN isfinite(balance) THEN floor(100 * balance + 0.5)::BIGINT END AS cents
  FROM clients
), r AS (
  SELECT *, coalesce(max(upd) OVER (PARTITION BY cluster_id) - upd > 60 * 24 * 3600 * 1000000::BIGINT, true) AS stale,
         first_value(segment) OVER (PARTITION BY cluster_id ORDER BY segment IS NULL, upd DESC NULLS LAST, trust DESC, client_id NULLS LAST) AS chosen FROM c
), k AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY segment IS NULL, upd DESC NULLS LAST, trust DESC, client_id NULLS LAST) AS by_segment,
         row_number() OVER (PARTITION BY cluster_id ORDER BY email IS NULL, stale, trust DESC, upd DESC NULLS LAST, client_id NULLS LAST) AS by_email,
         row_number() OVER (PARTITION BY cluster_id ORDER BY name IS NULL, length(name) DESC, stale, trust DESC, upd DESC NULLS LAST, client_id NULLS LAST) AS by_name,
         row_number() OVER (PARTITION BY cluster_id ORDER BY cents IS NULL, coalesce(segment = chosen, false) DESC, upd DESC NULLS LAST, trust DESC, client_id NULLS LAST) AS by_balance,
         row_number() OVER (PARTITION BY cluster_id ORDER BY (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT DESC, stale, trust DESC, upd DESC NULLS LAST, client_id NULLS LAST) AS by_address FROM r
)
SELECT cluster_id, count(*) AS n_records, count(*) FILTER (stale) AS n_stale,
       max(name) FILTER (by_name = 1) AS name, max(email) FILTER (by_email = 1) AS email, max(segment) FILTER (by_segment = 1) AS segment,
       max(city) FILTER (by_address = 1) AS city, max(nation_id) FILTER (by_address = 1) AS nation_id, max(cents) FILTER (by_balance = 1) AS balance_cents,
       max(client_id) FILTER (by_name = 1 AND name IS NOT NULL) AS name_from, max(client_id) FILTER (by_email = 1 AND email IS NOT NULL) AS email_from,
       max(client_id) FILTER (by_segment = 1 AND segment IS NOT NULL) AS segment_from, max(client_id) FILTER (by_balance = 1 AND cents IS NOT NULL) AS balance_from,
       max(client_id) FILTER (by_address = 1 AND (city IS NOT NULL OR nation_id IS NOT NULL)) AS address_from
FROM k GROUP BY cluster_id""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.write_and_read(spark, table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark, table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(spark, table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    made = chat.format_chats(rows)
    made = made.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("segments")))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "state",
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return made.select("doc_id", "text", *map(of_kind, pii.KINDS))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = toxicity.graded(spark, docs, table(spark, sf_dir, "labels"))
    return made.select("doc_id", "toxicity.severity", "toxicity.grade", "toxicity.chance", "toxicity.toxic")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(spark, vectors, vectors.filter("vec_id % 100 = 0"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mixture(spark, table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "source_size", "target", "taken", "copies", F.get("positions", F.lit(0)).alias("position"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tokens.store_and_read(spark, table(spark, sf_dir, "documents"), tokenizer_path())
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.scored(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.golden_records(spark, table(spark, sf_dir, "clients"))


def op13_crosstok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.aligned(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_lm": op2_lm,
        "op3_simhash": op3_simhash,
        "op4_chat": op4_chat,
        "op5_pii": op5_pii,
        "op6_toxicity": op6_toxicity,
        "op7_topk": op7_topk,
        "op8_decontamination": op8_decontamination,
        "op9_token_store": op9_token_store,
        "op10_mixing": op10_mixing,
        "op11_subword": op11_subword,
        "op12_golden": op12_golden,
        "op13_crosstok": op13_crosstok,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
