"""Line dedup: drop lines that several documents share.

Lines are exploded with their positions, normalised and hashed; per hash the distinct documents
are counted. Repeated lines go from all documents but the one with the largest id; each text is
put together again from the runs of lines between the dropped positions.

Only built-in functions; a hash is 128 bits. A line that a third of all documents hold costs one
row per document: counting goes over (hash, document) first, and where the lines meet the repeated
hashes, each hash is dealt to ``SALTS`` parts by document (adaptive execution can split these more).

Defined cases: a null or empty text is one empty line. A row without id is no document: it is not
counted and keeps all its lines. Rows that repeat an id are one document for the count and lose
the same lines. An empty table gives an empty table. The input's columns travel in a struct, so
their names cannot clash with those made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netkpi.llm.common import LOWER, SPACE, UPPER


#: Parts that the lines of one key are dealt to when they meet the repeated keys.
SALTS = 16


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def dedup_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``row`` (struct of the input's columns), ``n_lines``, ``n_dropped``, ``kept`` (text of the kept lines).

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents loses its lines
    in all documents but that with the largest id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("version"),  # tells rows of one id apart
    )
    lines = (
        rows.where("id IS NOT NULL")
        .select("id", "version", F.posexplode(_lines(text_col)).alias("pos", "line"))
        .select("id", "version", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "version", "pos", F.unhex(F.md5("key")).alias("key"))
    )
    repeated = (
        lines.groupBy("key")
        .agg(F.count_distinct("id").alias("n_docs"), F.max("id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("key", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    dropped = (
        lines.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        .join(repeated, ["key", "salt"])
        .where("id <> keeper")
        .groupBy("id", "version")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    )
    none = F.expr("CAST(array() AS ARRAY<INT>)")
    found = rows.join(dropped, ["id", "version"], "left").select(
        "row", F.coalesce("gone", none).alias("gone"), _lines(text_col).alias("lines")
    )
    # Runs of kept lines lie between one dropped position and the next; -1 and the end close the ends.
    runs = F.zip_with(
        F.concat(F.array(F.lit(-1)), F.col("gone")),
        F.concat(F.col("gone"), F.array(F.size("lines"))),
        lambda a, b: F.slice(F.col("lines"), a + 2, b - a - 1),
    )
    return found.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
        F.array_join(F.flatten(runs), "\n").alias("kept"),
    )


def _lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(f"row.{text_col}"), F.lit("")), "\n", -1)
