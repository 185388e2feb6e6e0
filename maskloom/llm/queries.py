"""The registered queries of the operators: thin calls over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm.common import LOWER, UPPER, documents
from maskloom.llm.exact import exact_duplicates
from maskloom.llm.infill import fill_in_middle, restored
from maskloom.llm.mixing import mix_by_source
from maskloom.llm.neighbours import nearest
from maskloom.llm.packing import pack_documents
from maskloom.llm.pseudo import pseudo_likelihood
from maskloom.llm.quality import resample
from maskloom.llm.repeats import remove_repeats
from maskloom.llm.resampling import resample_to_target
from maskloom.llm.secrets import digest, find_secrets
from maskloom.llm.sharding import shard
from maskloom.llm.simhash import near_duplicates
from maskloom.llm.tokens import token_counts
from maskloom.plans.tables import Query


def tokenizer(name: str) -> str:
    """Where the public tokenizer's file lies; it is installed with the Python environment of every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir).select("doc_id", "text"), tokenizer("piece_bpe_32k.model"), limit=4096)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_by_source(documents(spark, sf_dir).select("doc_id", "text", "source"), weights=(3, 1, 2), share=1.5, most=2)


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir).select("doc_id", "text"), tokenizer("word_bpe_49k.json"), limit=4096, end_id=1)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(documents(spark, sf_dir).select("doc_id", "text"), shards=24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = nearest(vectors.select("vec_id", "embedding"), F.col("id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


OP6 = f"""
WITH keyed AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM keyed WINDOW same AS (PARTITION BY text_sha256)"""


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(documents(spark, sf_dir).select("doc_id", "text"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), label="quality")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), words=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(documents(spark, sf_dir).select("doc_id", "text")))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), length=400)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample_to_target(documents(spark, sf_dir).select("doc_id", "text"), target)


# CRC-32 by its rule: the remainder of each byte, then the bytes of a word one after the other.
OP12 = rf"""
WITH RECURSIVE rule AS (
  SELECT byte, byte AS r, 0 AS step FROM (SELECT unnest(range(256)) AS byte)
  UNION ALL
  SELECT byte, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, step + 1 FROM rule WHERE step < 8
),
remainder AS MATERIALIZED (SELECT list(r ORDER BY byte) AS of_byte FROM rule WHERE step = 8),
words AS MATERIALIZED (
  SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)
),
distinct_words AS (SELECT word, hex(encode(word)) AS code FROM words GROUP BY word),
bytes AS (
  SELECT word, list_prepend(4294967295, list_transform(range(len(code) // 2), lambda i: ('0x' || code[2 * i + 1:2 * i + 2])::BIGINT)) AS b
  FROM distinct_words
),
buckets AS MATERIALIZED (
  SELECT word, xor(list_reduce(b, lambda crc, byte: xor(crc >> 8, of_byte[(xor(crc, byte) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, remainder
),
counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN buckets USING (word) GROUP BY bucket
),
gains AS MATERIALIZED (
  SELECT bucket,
    floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000))))::BIGINT AS gain
  FROM counts
),
weighed AS (
  SELECT id, count(*) AS n, sum(gain)::BIGINT AS weight FROM words JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weighed ON doc_id = id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    (10 * count(*) FILTER (n_features >= 20) OVER ()) // 100 AS drawn
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM ranked"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"), seed=7, rate=100, spm=50)
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    digests = (sha(F.col("output")).alias("output_sha256"), sha(restored("output", "form")).alias("restored_sha256"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP13 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || doc_id) AS h FROM documents
),
drawn AS (
  SELECT *, len(units) AS n, list_transform(range(4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT) AS d FROM cut
),
placed AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS i, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS j,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 THEN 'plain'
         WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
parts AS (
  SELECT *, array_to_string(units[1:i], '') AS prefix, array_to_string(units[i + 1:j], '') AS middle, array_to_string(units[j + 1:], '') AS suffix FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""


QUERIES = [
    Query("op1_token_counts", op1_token_counts),
    Query("op2_mix_sources", op2_mix_sources),
    Query("op3_pack_sequences", op3_pack_sequences),
    Query("op4_sharding", op4_sharding),
    Query("op5_neighbours", op5_neighbours),
    Query("op6_exact_dedup", op6_exact_dedup, OP6),
    Query("op7_pseudo_likelihood", op7_pseudo_likelihood),
    Query("op8_quality", op8_quality),
    Query("op9_simhash", op9_simhash),
    Query("op10_secrets", op10_secrets),
    Query("op11_suffix_dedup", op11_suffix_dedup),
    Query("op12_target_resampling", op12_target_resampling, OP12),
    Query("op13_fill_in_middle", op13_fill_in_middle, OP13),
]
