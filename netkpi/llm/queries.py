"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netkpi.llm import sql
from netkpi.llm.byte_bpe import digests
from netkpi.llm.common import read_table, scratch
from netkpi.llm.fill_in_middle import fill_in_middle, restore
from netkpi.llm.hard_negatives import hard_negatives
from netkpi.llm.html_cut import extract
from netkpi.llm.jaccard_join import jaccard_components
from netkpi.llm.line_dedup import dedup_lines
from netkpi.llm.mixing import mix
from netkpi.llm.packing import pack
from netkpi.llm.quality import quality_rules
from netkpi.llm.suffix_dedup import remove_repeats
from netkpi.llm.token_files import global_starts, look_up, read_ids, write_token_files
from netkpi.llm.topk import top_k
from netkpi.llm.warc import read_archives, write_archives

Query = Callable[[SparkSession, str], DataFrame]


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    files = write_token_files(docs, scratch(spark), tokenizer, added_tokens=True)
    found = read_ids(files, look_up(files, files.documents.select("doc_id", "nth")), digest=True)
    return found.join(global_starts(files), "shard").select(
        "doc_id", (F.col("before") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32"
    )


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("row.page_id", "row.url", "text", "n_chars")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    write_archives(read_table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, read_table(spark, sf_dir, "labels")).select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "score",
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=["doc_id"]).select(
        "row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle(docs).select(
        F.struct("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256")).alias("row"),
        "output",
        "form",
    )
    return restore(made).select("row.*", F.sha2("text", 256).alias("restored_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), digest=True)


def all_queries() -> dict[str, Query]:
    found = (
        op1_topk,
        op2_line_dedup,
        op3_token_files,
        op4_html_extraction,
        op5_warc,
        op6_quality,
        op7_suffix_dedup,
        op8_mixing,
        op9_byte_bpe,
        op10_jaccard_join,
        op11_fill_in_middle,
        op12_hard_negatives,
        op13_packing,
    )
    return {f.__name__: f for f in found}


def all_sql() -> dict[str, str]:
    return {
        "op1_topk": sql.TOP_K,
        "op2_line_dedup": sql.LINE_DEDUP,
        "op5_warc": sql.WARC,
        "op8_mixing": sql.MIXING,
        "op11_fill_in_middle": sql.FILL_IN_MIDDLE,
        "op12_hard_negatives": sql.HARD_NEGATIVES,
    }
