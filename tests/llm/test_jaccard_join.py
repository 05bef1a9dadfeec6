from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from netkpi.llm import jaccard_join
from netkpi.llm.common import LOWER, UPPER
from netkpi.llm.jaccard_join import boundary, components, jaccard_components, one_of_each, overlap_needed
from netkpi.llm.common import scratch
from tests.llm.fixtures import document_rows, documents, prose

FOLD = str.maketrans(UPPER, LOWER)


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def plain(rows, width, percent):
    """(doc_id, set size, smallest id) per row, and the number of links between different sets."""
    sets = [shingles(t, width) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                links += a != sets[j]
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _, _) in enumerate(rows):
        known = least.get(find(i))
        least[find(i)] = doc_id if known is None else known if doc_id is None else min(known, doc_id)
    return [(r[0], len(s), least[find(i)] if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))], links


def edited(seed, n, sizes=(1, 90)):
    """Families of texts with some words changed, around the threshold."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(r.randint(0, n // 4), r.randint(*sizes)).split()
        words = prose(2000 + i % (n // 5), sizes[0] + (i % (n // 5)) * 3 % (sizes[1] - sizes[0] + 1)).split() if i % 2 else words
        for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
            words[r.randrange(len(words))] = r.choice(("new", "words", words[0]))
        rows.append((1000 + i, " ".join(words), "a"))
    return rows


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize(("width", "percent", "light"), [(4, 85, None), (5, 80, None), (1, 60, 6), (2, 70, 0)])
def test_equals_plain_version(spark, monkeypatch, width, percent, light):
    if light is not None:
        monkeypatch.setattr(jaccard_join, "boundary", lambda sizes, p: light)
    rows = document_rows() + edited(width * percent, 160) + edited(3, 60, (1, 12))
    want, links = plain(rows, width, percent)
    found = jaccard_components(documents(spark, rows, clashing=True), width, percent)
    assert ordered(found.select("doc_id", "n_shingles", "component_id").collect()) == ordered(want)
    assert links > 20


def test_awkward_tables(spark):
    assert jaccard_components(documents(spark, [])).collect() == []
    rows = [(1, None, None), (2, "", "a"), (3, " ", "a"), (4, "one", "a"), (5, "ONE", "b"), (None, "one", "b")]
    found = jaccard_components(documents(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(found) == ordered([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (None, 1, 4)])


def test_one_of_each(spark):
    rows = document_rows() + [(None, "alone without id, as it were", "x"), (None, "another one without id here", "x")]
    want, _ = plain(rows, 5, 80)
    kept = one_of_each(documents(spark, rows, clashing=True))
    ids = sorted(str(r.doc_id) for r in kept.collect())
    # by component: 4 stays for 5 and 6, 12 for 13; repeated ids with other texts stay
    gone = {5, 6, 13}
    expected = sorted(str(i) for i, _, _ in rows if i not in gone)
    assert ids == expected and kept.columns == documents(spark, rows, clashing=True).columns
    assert {i for i, _, c in want if i is not None and c != i} == gone


def test_boundary_is_the_cheapest():
    assert boundary({}, 85) == 0
    few, many = boundary({5: 10, 40: 1}, 85), boundary({5: 10, 20: 1000, 24: 1000}, 85)
    assert 5 <= few and 0 <= many <= jaccard_join.LARGEST_LIGHT
    assert overlap_needed(12, 12, 85) == 12 and overlap_needed(13, 13, 85) == 12


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(edges, "x long, y long"), scratch(spark)).collect()
    assert {x.node: x.root for x in found} == {x: find(x) for x in root} and len(found) == len(root)


def test_sketches_bound_the_difference():
    r = random.Random(7)
    for _ in range(200):
        n = r.randint(1, 700)
        a = {r.getrandbits(64) for _ in range(n)}
        b = set(r.sample(sorted(a), r.randint(0, n))) | {r.getrandbits(64) for _ in range(r.randint(0, n // 3))}
        small, large = sorted((a, b or {1}), key=lambda s: len(jaccard_join.sketch_of(_array(s))))
        sketches = jaccard_join._Sketches([jaccard_join.sketch_of(_array(small)), jaccard_join.sketch_of(_array(large))])
        assert sketches.apart(0, slice(1, 2))[0] <= len(small ^ large)
        assert sketches.apart(0, slice(0, 1))[0] == 0


def _array(hashes):
    return np.array(sorted(hashes), np.uint64)


def _first_round_of(lists, percent=85, light=0):
    """Hub pairs (hub, member) and kept members per list from lists of (size, position, class)."""
    rows = [(h, n << 32 | at, c) for h, members in enumerate(lists) for n, at, c in sorted(members)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["h", "what", "class"])
    hubs, kept = set(), {}
    for out in jaccard_join._first_round(percent, light)(iter([batch])):
        for kind, x, y, _ in zip(*(out.column(i).to_pylist() for i in range(4))):
            if kind == jaccard_join.HUB:
                hubs.add((x, y))
            else:
                kept.setdefault(x, set()).add(y)
    return hubs, kept


def test_sets_that_meet_by_chance_leave_the_lists():
    # sizes too far apart; positions too late; two that only a hub may link with
    chance = [[(100, 0, 1), (200, 0, 2), (400, 0, 3)], [(100, 12, 4), (101, 12, 5), (102, 12, 6)], [(100, 0, 7), (110, 1, 8), (110, 15, 9)]]
    hubs, kept = _first_round_of(chance)
    assert hubs == {(7, 8)} and kept == {}
    assert _first_round_of([[(100, 0, 1), (104, 0, 2), (105, 1, 3), (300, 0, 4)]])[1] == {0: {2, 3}}


@pytest.mark.parametrize("light", [0, 40])
def test_no_pair_that_may_link_is_lost(light):
    r = random.Random(light)
    lists = []
    for i in range(60):
        sizes = [r.randint(20, 90) for _ in range(r.choice((2, 3, 5, 30, 200)))]
        lists.append([(n, r.randrange(jaccard_join.prefix_length(n, 85)), 1000 * i + j) for j, n in enumerate(sizes)])
    hubs, kept = _first_round_of(lists, 85, light)
    looked_at = 0
    for h, members in enumerate(lists):
        members = sorted(members)
        for i, (n, at, x) in enumerate(members):
            for m, place, y in members[i + 1 :]:
                need = overlap_needed(n, m, 85)
                if m > light and need <= n and need <= n - at and need <= m - place:
                    looked_at += 1
                    assert (x, y) in hubs or {x, y} <= kept.get(h, set())
    assert looked_at > 1000
    assert 0 < sum(map(len, kept.values())) < sum(len(m) for m in lists if len(m) > 2)
