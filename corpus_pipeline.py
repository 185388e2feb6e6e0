"""A corpus pipeline of five operators: quality, exact and near duplicates, mix, packing.

``run`` applies the stages to all of ``documents``; each stage's rows are written
as Parquet to shared storage and read again by the next. All stages but the last
return the columns of documents; a document that the mix takes twice is two rows.
Null ids, empty texts, repeated rows and empty tables are handled as each
operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm.common import documents, fresh
from maskloom.llm.exact import drop_exact_duplicates
from maskloom.llm.mixing import mix_by_source
from maskloom.llm.packing import pack_documents
from maskloom.llm.quality import keep_quality
from maskloom.llm.queries import tokenizer
from maskloom.llm.simhash import drop_near_duplicates
from maskloom.plans.tables import Query
from maskloom.sources.scratch import measured, settled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What importance resampling towards the labelled target keeps."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints link: at most 4 of 64 bits apart, met by pigeonring."""
    return drop_near_duplicates(docs, words=4, distance=4)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it.

    Rows repeated with the same id, text and source come as often as they are taken
    in all, each time with the other columns of one of them.
    """
    key, times, rows, total = (fresh(docs, name) for name in ("_key", "_times", "_rows", "_total"))
    keyed = docs.withColumn(key, F.struct("doc_id", F.xxhash64("text", "source")))
    taken = mix_by_source(keyed, id_col=key).groupBy(key).agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(rows))
    taken = settled(taken.filter(F.col(total) > 0))
    single = keyed.join(measured(taken.filter(F.col(rows) == 1)), key)
    several = keyed.join(measured(taken.filter(F.col(rows) > 1)), key).dropDuplicates([key])
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), total))
    return single.unionByName(several).withColumn(times, again).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens."""
    return pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = settled(docs)
    return docs


# Hashes, models and tokenizers are beyond SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None

QUERY = Query("pipeline", run, ORACLE_SQL)
