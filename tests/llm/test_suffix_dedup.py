from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netkpi.llm import suffix_dedup
from netkpi.llm.suffix_dedup import LoserTree, common_prefix, front_coded, remove_repeats
from tests.llm.fixtures import document_rows, documents, prose


def plain(rows, length):
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    count = Counter(b[s : s + length] for _, b in texts for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        covered = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                covered[s : s + length] = b"\1" * length
        kept = bytes(c for c, m in zip(b, covered) if not m)
        out.append((i, len(b), sum(covered), len(re.findall(b"\1+", covered)), hashlib.sha256(kept).hexdigest()))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def found(df, length):
    return remove_repeats(df, length).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()


def spliced(seed, n):
    """Texts that share passages of many lengths, with edits."""
    r = random.Random(seed)
    pool = [prose(1000 + i, 60) for i in range(8)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(pool)
            a = r.randint(0, len(p) - 50)
            parts.append(p[a : a + r.randint(20, 350)])
            if r.random() < 0.4:
                parts.append(prose(r.randint(0, 10**6), 5))
        out.append((i, "".join(parts), "a"))
    return out


@pytest.mark.parametrize("length", [200, 64])
def test_equals_plain_version(spark, length):
    rows = document_rows() + spliced(length, 40)
    want = plain(rows, length)
    assert ordered(found(documents(spark, rows, clashing=True), length)) == ordered(want)
    assert sum(w[2] for w in want) > 5000 and any(w[3] > 1 for w in want)


def test_overlaps_and_runs(spark):
    rows = [(1, "a" * 199, "s"), (2, "a" * 200 + "b", "s"), (3, "a" * 201, "s"), (4, "ab" * 300, "s"), (5, "é" * 150, "s")]
    assert ordered(found(documents(spark, rows), 200)) == ordered(plain(rows, 200))


def test_awkward_tables(spark):
    assert found(documents(spark, []), 200) == []
    rows = [(1, None, None), (2, "", "a"), (3, "short", "a"), (3, "short", "a")]
    assert ordered(found(documents(spark, rows), 200)) == ordered(plain(rows, 200))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6) | st.sampled_from([b"aaaa", b"aaab", b"aa"]), max_size=6), min_size=1, max_size=7))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    merged = list(LoserTree([front_coded(r) for r in runs]))
    assert [m[0] for m in merged] == sorted(x for r in runs for x in r)
    assert all(runs[run][at] == s for s, _, run, at in merged)
    for (a, *_), (b, shared, *_) in zip(merged, merged[1:]):
        assert shared == common_prefix(a, b)


@pytest.mark.parametrize("hot_rows", [20, 2_000])
def test_hot_grams_are_split(spark, monkeypatch, hot_rows):
    """A passage of many texts, with other surroundings in each: no range gathers its ends."""
    merge_range, biggest = suffix_dedup._merge_range, 100

    def bounded(length):
        inner = merge_range(length)

        def run(key, table):
            n = sum(len(x) for x in table.column("texts").to_pylist()) // 8
            assert n <= biggest, f"{n} rows in one range"
            return inner(key, table)

        return run

    monkeypatch.setattr(suffix_dedup, "_merge_range", bounded)
    monkeypatch.setattr(suffix_dedup, "RANGE_ROWS", 20)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot_rows, raising=False)
    monkeypatch.setattr(suffix_dedup, "HOT_IN_TASK", 10**9 if hot_rows == 20 else 16, raising=False)
    passage = prose(77, 90)
    rows = [(i, f"{prose(5000 + i, 30)} {passage} {prose(9000 + i, 30)}", "a") for i in range(300)]
    rows += [(400 + i, f"{prose(7000 + i, 9)} {passage[:260 + i]}", "a") for i in range(30)] + spliced(3, 20)
    assert ordered(found(documents(spark, rows), 200)) == ordered(plain(rows, 200))


def test_more_than_10_000_ranges(spark, monkeypatch):
    """The number of ranges has no cap: it grows with the suffixes that are compared."""
    made, make_runs = [], suffix_dedup._make_runs
    monkeypatch.setattr(suffix_dedup, "RANGE_ROWS", 0.01)
    monkeypatch.setattr(suffix_dedup, "_make_runs", lambda length, cuts: made.append(len(cuts)) or make_runs(length, cuts))
    rows = spliced(5, 60)
    assert ordered(found(documents(spark, rows), 64)) == ordered(plain(rows, 64))
    assert made[0] > 10_000


def test_texts_longer_than_a_portion(spark):
    """Texts that are cut for hashing, with repeats across the cuts, in themselves and in each other."""
    long, passage = prose(31, 220_000), prose(32, 80)
    size = suffix_dedup.PORTION
    assert len(long.encode()) > size + 10_000
    cut = long[: size - 150] + passage + long[size - 150 :]
    rows = [(1, cut, "a"), (2, prose(33, 20) + passage + prose(34, 20), "a"), (3, prose(35, 90) + long[size - 1000 : size + 1000], "a")]
    assert ordered(found(documents(spark, rows), 200)) == ordered(plain(rows, 200))


def test_many_grams_of_one_head_are_split():
    import numpy as np

    heads, grams = np.full(1000, 5), np.arange(1000) * 7919
    parts = suffix_dedup._parts(heads, grams, np.array([3, 5, 5, 5, 5, 9]))
    assert max(np.bincount(parts)) < 400 and set(parts) == {2, 3, 4, 5}
    assert suffix_dedup._parts(np.array([2, 3, 4, 6, 9]), np.zeros(5, int), np.array([3, 5, 5, 9])).tolist() == [0, 1, 1, 3, 4]
