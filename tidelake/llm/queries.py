"""The queries op1_ to op10_: thin calls of the operators over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import chat, exact_dedup, mixing, order_minhash, packing, quality, sharding, simhash, token_counts, warc

#: Packages' own folders of vocabulary files are found at run time; these are the files' names.
PACKING_VOCABULARY, COUNTING_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; odd rows as in quality_scores()."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, written as archives and read back; odd rows as in records() and read_archives()."""
    folder = warc.archive_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, with_payload=False).drop("payload", "url")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken; odd rows as in mix_plan()."""
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from what was formatted; odd rows as in formatted() and digests()."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted(turns.unionByName(own)))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents; odd rows as in packed()."""
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary(PACKING_VOCABULARY))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; odd rows as in exact_groups()."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; odd rows as in edit_likeness()."""
    return order_minhash.edit_likeness(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents; odd rows as in token_counts()."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(COUNTING_VOCABULARY))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents; odd rows as in sharded()."""
    out = sharding.sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents; odd rows as in simhash_components()."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_quality_classifier, op2_warc, op3_mixing, op4_chat_formatting, op5_packing, op6_exact_dedup, op7_fingerprints, op8_token_counts, op9_sharding, op10_simhash,
    )}


# ---------------------------------------------------------------- SQL for DuckDB

OP2_SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

OP3_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           md5(md5(coalesce('v' || source, 'n')) || '|' || coalesce('v' || doc_id, 'n') || '|' || md5(coalesce('v' || text, 'n'))) AS lot
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
    SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight,
           2.0::DOUBLE * source_size AS cap
    FROM s
), b AS (
    SELECT *, coalesce(sum(cap) OVER line, 0.0::DOUBLE) AS capped_before,
           sum(weight) OVER () - coalesce(sum(weight) OVER line, 0.0::DOUBLE) AS weight_left,
           1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS total
    FROM w WINDOW line AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
    SELECT *, cap * weight_left <= weight * (total - capped_before) AS stopped FROM b
), t AS (
    SELECT source, source_size,
           CASE WHEN stopped THEN cap ELSE (total - sum(CASE WHEN stopped THEN cap ELSE 0.0::DOUBLE END) OVER ()) * weight
                / sum(CASE WHEN stopped THEN 0.0::DOUBLE ELSE weight END) OVER () END AS target
    FROM c
), n AS (
    SELECT *, count(*) OVER (PARTITION BY lot) AS alike, row_number() OVER (PARTITION BY lot) - 1 AS turn FROM d
), u AS (
    SELECT n.doc_id, n.source, n.size, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0::DOUBLE END AS rate,
           CASE WHEN alike > 1 THEN md5(lot || '#' || turn) ELSE lot END AS seed
    FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source
), e AS (
    SELECT *, CAST(CAST(('0x' || substr(md5(seed), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < rate - floor(rate) AS BIGINT) AS extra FROM u
), m AS (
    SELECT source, CAST(sum((floor(rate) + extra) * size) AS DOUBLE) - any_value(target) AS miss FROM e GROUP BY source
), l AS (
    SELECT source, size, extra, seed, row_number() OVER (PARTITION BY source ORDER BY size DESC, seed) AS rank
    FROM e WHERE size > 0 AND rate > floor(rate)
    QUALIFY rank <= 256
), f AS (
    SELECT source, CAST(0 AS BIGINT) AS rank, miss, CAST(NULL AS VARCHAR) AS seed, CAST(NULL AS BIGINT) AS now FROM m
    UNION ALL
    SELECT l.source, l.rank,
           CASE WHEN l.extra = 1 AND f.miss * 3 > l.size * 2 THEN f.miss - l.size WHEN l.extra = 0 AND f.miss * -3 > l.size * 2 THEN f.miss + l.size ELSE f.miss END,
           l.seed, CASE WHEN l.extra = 1 AND f.miss * 3 > l.size * 2 OR l.extra = 0 AND f.miss * -3 > l.size * 2 THEN 1 - l.extra END
    FROM f JOIN l ON l.source IS NOT DISTINCT FROM f.source AND l.rank = f.rank + 1
)
SELECT e.doc_id, e.size, source_size, target, CAST((floor(rate) + coalesce(f.now, e.extra)) * e.size AS BIGINT) AS taken
FROM e LEFT JOIN f ON f.seed = e.seed AND f.now IS NOT NULL
"""

OP4_SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
    SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS t,
           replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS r
    FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(t) + length(r) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP6_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(length(text), 0) AS chars,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept, text_sha256
FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
"""


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express; tests hold the others against brute force, held-out labels or round trips."""
    return {"op2_warc": OP2_SQL, "op3_mixing": OP3_SQL, "op4_chat_formatting": OP4_SQL, "op6_exact_dedup": OP6_SQL}
