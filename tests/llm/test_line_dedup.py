from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import functions as F

from netkpi.llm.common import LOWER, UPPER
from netkpi.llm.line_dedup import dedup_lines, line_key
from tests.llm.fixtures import CLASHING, document_rows, documents

BLANKS = " \t\n\x0b\x0c\r"
FOLD = str.maketrans(UPPER, LOWER)


def plain(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)

    def key(line):
        return line.strip(BLANKS).translate(FOLD)

    for doc_id, text, _ in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text, _ in rows:
        lines = (text or "").split("\n")
        gone = [
            doc_id is not None and len(holders.get(key(x), ())) >= min_docs and doc_id != max(holders[key(x)]) for x in lines
        ]
        out.append((doc_id, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_equals_plain_version(spark):
    found = dedup_lines(documents(spark)).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    want = plain(document_rows())
    assert ordered(found) == ordered(want)
    assert sum(r[2] for r in want) >= 4


def test_clashing_columns_and_low_limits(spark):
    found = dedup_lines(documents(spark, clashing=True), min_chars=1, min_docs=2)
    assert ordered(found.select("row.doc_id", "n_lines", "n_dropped", "kept").collect()) == ordered(plain(document_rows(), 1, 2))
    assert [found.select(f"row.`{c}`").first()[0] for c in CLASHING] == [f"{c}!" for c in CLASHING]


def test_empty_table(spark):
    assert dedup_lines(documents(spark, [])).collect() == []


def test_key_changes_ascii_only(spark):
    lines = ["  ÀÉ Straße ABC\t", "Kelvin KELVIN", "ΣΑΣ Abc", "İstanbul", "\x85Z\x85", "plain É"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r[0] for r in df.select(line_key(F.col("line"))).collect()] == [x.strip(BLANKS).translate(FOLD) for x in lines]
    assert re.fullmatch("[a-z]+", LOWER)
