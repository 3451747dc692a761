"""The queries of this subpackage, by name: production parameters over whole tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.llm import alignment, bpe, decontamination, html_text, near_dup, periodic_runs, pii, quality_rules, substring_dedup, suffix_dedup, token_counts, url_filters, word_bpe
from metrolith.llm.scratch import let
from metrolith.llm.scratch import table as written

TOKENIZER_OP2 = "byte_bpe_50k.json"
#: Fixed values of the URL rules.
LISTED = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
TOKENIZER_OP8 = "byte_bpe_multi_50k.tiktoken"
TOKENIZERS_OP12, IDS_OP12 = ("byte_bpe_50k.json", "piece_bpe_32k.model"), 50_257
TOKENIZER_OP13 = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_OP2), public_tokenizers.PATTERN, budget=512)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), minimum=50)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.find(table(spark, sf_dir, "documents"), percent=85, shingle=3)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER_OP8)
    coded = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return bpe.id_digest(coded).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(table(spark, sf_dir, "documents")).drop("row")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract("url", r"/([0-9]+)(?:[/.?#]|$)", 1).try_cast("long")  # the document that a page shows
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("shown"), (F.col("quality") == 0).alias("bad"))
    labelled = pages.select("url", number.alias("shown")).join(labels, "shown")
    return url_filters.judge(pages, LISTED, url_filters.mine(labelled)).select("page_id", "host", "path", "rule", "verdict", "mined")


def with_cycles(docs: DataFrame) -> DataFrame:
    """doc_id and text: where crc32 of the decimal doc_id is a multiple of ten, the words from one on repeat a cycle."""
    draw = F.crc32(F.col("doc_id").cast("string"))
    rest = F.floor(draw / 10)

    def cycled(words: Column) -> Column:
        n = F.size(words)
        begin = (rest % n).cast("int")
        period = (1 + F.floor((n - begin) / (3 + rest % 8))).cast("int")
        times = F.ceil((n - begin) / period).cast("int")
        cycle = F.flatten(F.array_repeat(F.slice(words, begin + 1, period), times))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), begin), F.slice(cycle, F.lit(1), n - begin)), " ")).otherwise("")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select("doc_id", F.when(draw % 10 == 0, let(words, cycled)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(with_cycles(table(spark, sf_dir, "documents")), least=6, exponent=4)
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    top = F.when(F.size("runs") > 0, F.array_max(order)).alias("top")
    return found.select("doc_id", "runs", "collapsed", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = map(public_tokenizers.path, TOKENIZERS_OP12)
    aligned = alignment.align(table(spark, sf_dir, "documents"), a, b, public_tokenizers.PATTERN)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    aligned = written(aligned.select("doc_id", "row", "n_a", "n_b", "n_groups", "n_links", digest, "links"))
    return alignment.count_links(aligned, IDS_OP12).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = word_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_OP13), decoded=True)
    return word_bpe.id_digest(coded).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_token_counts": op2_token_counts,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_near_dup": op5_near_dup,
        "op6_decontamination": op6_decontamination,
        "op7_html_text": op7_html_text,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_pii": op9_pii,
        "op10_url_filters": op10_url_filters,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_alignment": op12_alignment,
        "op13_word_bpe": op13_word_bpe,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {}
