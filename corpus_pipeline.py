"""A corpus pipeline of five stages over the documents table. Each stage takes all rows its predecessor kept.

In every stage a null doc_id is as any other value, rows repeated whole are judged one by one unless said otherwise, a
table without rows gives none, and columns other than those of documents are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.llm.common import clean, discard, mark, settle, settle_workers, table, written
from vocalis.llm.decontaminate import contamination
from vocalis.llm.jaccard_join import similar_groups
from vocalis.llm.language import identify, learn
from vocalis.llm.line_dedup import dedup_lines
from vocalis.llm.packing import pack_documents
from vocalis.llm.registry import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: null texts and those without letters. Learns as op7 does. Without a labelled row
    there is no model, and every document is in no language."""
    settle(spark)
    settle_workers(spark)
    model = learn(docs.where("not coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)").select("text", "lang"))
    settle(spark)
    settle_workers(spark)
    return identify(docs.select(*COLUMNS), model).where("lang_pred <> 'und'").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines go from all but one document; a document whose lines all went goes too. Rows that share a doc_id are
    one document there, a null one below all others. DataFrame functions only, so no workers are settled."""
    settle(spark)
    out = dedup_lines(docs.select(*COLUMNS)).where("n_dropped < n_lines")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row stays: the least by doc_id, then by the text's hash, then by the rest.

    Rows without shingles (null, empty or blank texts) are in no group and all stay. Rows of equal doc_id are grouped by
    their texts only, and of rows repeated whole one stays.
    """
    settle(spark)
    settle_workers(spark)
    key = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", F.xxhash64("text").alias("h"))
    groups = similar_groups(docs.select(key.alias("doc_id"), "text"))
    settle(spark)  # the groups are written
    settle_workers(spark)
    first = groups.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("_id")).agg(F.when(F.max("n_shingles") > 0, F.count("*")).otherwise(1).alias("_rows"))
    kept = docs.select(*COLUMNS).withColumn("_key", key).join(first.hint("shuffle_hash"), F.col("_key") == F.col("_id"))
    repeated = kept.where("_rows > 1").groupBy("_key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return kept.where("_rows = 1").select(*COLUMNS).unionByName(repeated)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. Null and empty texts hold none; an empty benchmark has none."""
    settle(spark)
    settle_workers(spark)
    out = contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return out.where("not contaminated").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens. A null or empty text is one id."""
    settle(spark)
    settle_workers(spark)
    return pack_documents(docs, tokenizer_path())


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", packing)]
#: Language models, tokenisers and packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's table goes as soon as the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since = mark()
        done = written(stage(spark, docs, sf_dir), f"stage-{name}")
        clean(since, done)
        discard(docs)
        docs = done
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)  # its pieces are written
    return out
