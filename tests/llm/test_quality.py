from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
import xxhash

from pyspark.sql import functions as F

from netkpi.llm.quality import UNIT, held_out, quality_rules
from tests.llm.fixtures import document_rows, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
LABELS = "doc_id long, quality int, toxic int"


def base(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def plain_scores(rows, labels, buckets):
    """Scores by loops over words; labels: id -> (quality, toxic)."""
    odd, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def features(text):
        h = [xxhash.xxh3_64_intdigest(w.encode()) for w in WORD.findall(text or "")]
        pairs = []
        for a, b in zip(h, h[1:]):
            p = (a * odd & mask) ^ b
            p = (p ^ p >> 29) * 0xBF58476D1CE4E5B9 & mask
            pairs.append(p >> 7)
        return [x % buckets for x in h + pairs]

    raw, trusted = Counter(), Counter()
    for i, text, _ in rows:
        raw.update(features(text))
        if labels.get(i) == (1, 0):
            trusted.update(features(text))
    n_raw, n_trusted = sum(raw.values()) + buckets, sum(trusted.values()) + buckets
    out = []
    for _, text, _ in rows:
        f = features(text)
        logs = [math.log((trusted[x] + 1) / n_trusted) - math.log((raw[x] + 1) / n_raw) for x in f]
        out.append(sum(round(x * UNIT) for x in logs) / max(len(f), 1) / UNIT)
    return out


def corpus():
    r = random.Random(4)
    good = [(i, prose(i, r.randint(25, 120)), "a") for i in range(300)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(5000 + i, 60).split()), "b") for i in range(60)]
    return good + bad


def test_base_columns(spark):
    rows = document_rows() + [(90, "a b c d e f g h " * 4, "r"), (91, "x\nx\n\n \n \nx\n# % & | < > * $", "r")]
    found = quality_rules(documents(spark, rows, clashing=True), spark.createDataFrame([], LABELS)).collect()
    want = sorted([(i, *base(t)) for i, t, _ in rows], key=repr)
    assert sorted(((r.row.doc_id, *(r[c] for c in COUNTS)) for r in found), key=repr) == want
    assert all(r.kept == (not r.base_failed) for r in found)  # without labels the method keeps all
    assert found[0].row.score == "score!"


def test_scores_and_threshold(spark):
    rows = corpus()
    labelled = {i: (1, 0) for i in range(0, 300, 2)} | {i: (0, 0) for i in range(1000, 1060, 2)}
    odd_ones = [(None, 1, 0), (3, None, None), (99999, 1, 0), (0, 1, 0)]
    labels = spark.createDataFrame([(i, *q) for i, q in labelled.items()] + odd_ones, LABELS)
    found = {r.row.doc_id: r for r in quality_rules(documents(spark, rows), labels, buckets=512).collect()}
    held = {r[0] for r in spark.createDataFrame([(i,) for i in labelled], "id long").where(held_out(F.col("id"))).collect()}
    counted = {i: q for i, q in labelled.items() if i not in held}
    assert 50 < sum(q == (1, 0) for q in counted.values()) < 100
    for (i, _, _), score in zip(rows, plain_scores(rows, counted, 512)):
        assert found[i].score == pytest.approx(score, abs=1e-9)
    # accuracy on held-out documents: those without a label
    assert sum(found[i].kept for i in range(1, 300, 2)) >= 146  # of 150
    assert sum(found[i].kept for i in range(1001, 1060, 2)) <= 2  # of 30


def test_empty_table(spark):
    assert quality_rules(documents(spark, []), spark.createDataFrame([(1, 1, 0)], LABELS)).collect() == []
