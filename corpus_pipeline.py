"""A pipeline over the documents: quality rules, line dedup, one of each near copy, mixing, token ids.

Each stage gets the documents that the one before kept, as a written table, and returns documents
with the same columns; the last one returns the digests of token ids and decoded bytes. The rows of
``run`` cannot be expressed in SQL (hashed features, hashed shingles, token ids); tests hold them
against a plain version.

Null ids, null and empty texts, repeated rows and further columns: as the operators define them. A
null text stays null. A stage of an empty table is empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netkpi.llm.byte_bpe import digests
from netkpi.llm.common import read_table, scratch, written
from netkpi.llm.jaccard_join import one_of_each
from netkpi.llm.line_dedup import dedup_lines
from netkpi.llm.mixing import mix
from netkpi.llm.quality import quality_rules

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, read_table(spark, sf_dir, "labels")).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others hold too; ``n_chars`` follows the text."""
    found = dedup_lines(docs)
    changed = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    columns = [
        F.when(F.col("n_dropped") > 0, changed[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in changed else F.col(f"row.`{c}`")
        for c in docs.columns
    ]
    return found.select(*columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity of 0.8 or more."""
    return one_of_each(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(docs).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the bytes they decode to."""
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=["doc_id", "source"]).select(
        "row.doc_id", "row.source", "n_tokens", "ids_sha256", "decoded_sha256"
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_copies),
    ("mixing", mixing),
    ("byte_bpe", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
