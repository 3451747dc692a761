"""From raw documents to token ids: quality rules, near-duplicates, benchmark decontamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of documents. Columns that a stage doesn't know travel along untouched, whatever their names.

Defined results: a null or empty text has too few words, so the first stage drops it (later stages, called on their own,
keep it); of repeated rows and of rows with one id the near-duplicate stage keeps one, the first in the order of text; a
null id is never a duplicate; an empty table gives an empty table; an empty benchmark drops nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.llm import bpe, decontamination, near_dup, pii, quality_rules
from metrolith.llm.scratch import cut

#: Shingles of five words and a similarity of 0.8 make near-duplicates.
SHINGLE, PERCENT = 5, 80
TOKENIZER = "byte_bpe_multi_50k.tiktoken"

#: SQL can't express rule learning, latent retrieval or merges; tests compare each stage with a plain version.
ORACLE_SQL = None


def _row(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns as one struct, so that no name clashes with an operator's own."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality_rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(_row(docs), rules, keep=("__row",)).where("kept").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = near_dup.find(docs, PERCENT, SHINGLE).where("doc_id is not null")
    ids = cut(judged.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("kept").select("doc_id", "n"))
    single = docs.join(ids.where("n = 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    again = docs.join(ids.where("n > 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    one = again.groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce("text", F.lit(""))).alias("__row")).select("__row.*")
    return single.unionAll(one).unionAll(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = decontamination.mark(_row(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("__row",))
    return marked.where("not contaminated").select("__row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Marks stand in place of personal data; n_chars, where documents have it, counts the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, and decoded_sha256 of what the ids stand for."""
    path = public_tokenizers.path(TOKENIZER)
    coded = bpe.id_digest(bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True))
    return coded.select("doc_id", "ids", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", personal_data),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
