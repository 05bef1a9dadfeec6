from __future__ import annotations

import random
import re
from collections import defaultdict

import duckdb
import pytest

from netkpi.llm import sql
from netkpi.llm.mixing import mix, source_targets
from tests.llm.fixtures import document_rows, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def by_sql(df):
    pdf = df.toPandas()
    duck = duckdb.connect()
    duck.register("pdf", pdf)
    duck.sql("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM pdf")
    return duck.sql(sql.MIXING).fetchall()


def test_equals_sql_and_reruns_agree(spark):
    df = documents(spark)
    found = [(r.row.doc_id, r.size, r.source_size, r.target, r.size * r.copies) for r in mix(df).collect()]
    assert ordered(found) == ordered(by_sql(df))
    again = [(r.row.doc_id, r.size, r.source_size, r.target, r.size * r.copies) for r in mix(df.repartition(5)).collect()]
    assert ordered(found) == ordered(again)


def test_many_documents_come_near_their_targets(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(1, 60)), r.choice("abcdefg")) for i in range(3000)]
    rows += [(i, "w " * 5, "small") for i in range(3000, 3004)]
    found = mix(documents(spark, rows)).collect()
    taken, target, size = defaultdict(int), {}, {}
    for x in found:
        taken[x.row.source] += x.size * x.copies
        target[x.row.source], size[x.row.source] = x.target, x.source_size
        assert 0 <= x.copies <= 3
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(target[s] <= 3 * size[s] for s in target) and target["small"] == 60
    assert all(abs(taken[s] - target[s]) <= max(1, 0.001 * target[s]) for s in target)


def test_chances_differ_and_hold(spark):
    """60 sources of the same 400 documents: how often a size is drawn is what its chance says, and the chances add up."""
    r = random.Random(5)
    sizes = [r.choice([3, 40, 200, 900]) for _ in range(400)]
    texts = {n: " ".join(["w"] * n) for n in sizes}
    rows = [(1000 * s + i, texts[n], f"{s:04}") for s in range(60) for i, n in enumerate(sizes)]
    found = mix(documents(spark, rows)).select("row.source", "size", "source_size", "target", "copies", "chance").collect()
    drawn, words, wanted = defaultdict(list), defaultdict(float), {}
    for x in found:
        whole = int(x.target // x.source_size)
        assert x.copies - whole in (0, 1)
        drawn[round(x.target / x.source_size, 6), x.size, round(x.chance, 6)].append(x.copies - whole)
        words[x.source] += x.size * (whole + x.chance)
        wanted[x.source] = x.target
    assert all(words[s] == pytest.approx(wanted[s], rel=1e-9) for s in wanted)
    assert {k[0] for k in drawn} == {1.875, 0.75, 0.375}
    for ratio in (1.875, 0.75, 0.375):
        chances = [k[2] for k in sorted(drawn) if k[0] == ratio]  # by size
        assert len(chances) == 4 and chances == sorted(set(chances)) and chances[-1] - chances[0] > 0.05
    for (_, _, chance), got in drawn.items():
        assert sum(got) / len(got) == pytest.approx(chance, abs=0.05)


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 100), ("c", 100), (None, 0)], "source string, size long")
    found = {r.source: r.target for r in source_targets(sizes, (5, 2, 1), 3).collect()}
    # a is capped at 3, the null source at 0; the rest of 201 goes 2 : 1
    assert found == {"a": 3.0, "b": 132.0, "c": 66.0, None: 0.0}


def test_awkward_tables(spark):
    assert mix(documents(spark, [])).collect() == []
    assert [r.copies for r in mix(documents(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]
    found = mix(documents(spark, clashing=True)).collect()
    assert len(found) == len(document_rows()) and found[0].row.size == "size!"
