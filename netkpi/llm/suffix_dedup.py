"""Removal of repeated byte strings with a sparse suffix array, sorted and merged in parts.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Every window
of ``length`` bytes has an anchor: of its substrings of ``GRAM`` bytes the one with the least hash.
The anchor depends on the window's bytes alone, so equal windows have equal anchors at the same
distance from their start, and consecutive windows mostly share an anchor. Only the suffixes at
anchors are compared:

1. Each task finds the anchors of its texts, with the range of windows that each stands for, and
   folds equal ones (same gram, same bytes around): if there are two, all windows of both are
   repeated, and one stands for them from then on.
2. Anchors meet by gram. A gram that is alone is dropped, equal surroundings are repeated, and what
   remains are grams with different surroundings: ends of repeated passages, edits.
   Grams with many of them in one task, or in all, are hot. They take no part in 3 and 4: each
   task folds their equal windows by hash, and one of each meets the others by that hash. So a gram
   of any number of rows is dealt over all tasks.
3. For the others the suffixes from the anchor to the end of its windows are sorted per task,
   front-coded (length of the prefix shared with the one before, and the rest) and sent to ranges of the sorted
   order; where many grams begin with the same bytes, by gram. Each range merges its runs with a loser
   tree that carries the prefixes already known to be shared with the last winner, so that no byte is
   compared twice.
4. In the merged order suffixes that share r bytes are neighbours. The window that starts l bytes
   before the anchor is repeated if another one shares length - l bytes of suffix and the l bytes
   before the anchor.
5. The ranges found go back to their texts, which lose the bytes they cover.

Texts are told apart by a 64-bit hash; equal texts are one text, repeated as a whole if it is long
enough. Grams, surroundings and windows of hot grams are compared by 64-bit hashes, suffixes byte by
byte. What a task holds at once: a portion of text, the anchors of its input, the runs of one range.

Defined cases: a null or empty text has no bytes; a text shorter than ``length`` loses nothing.
Rows that repeat an id are texts of their own. The input's columns travel in a struct.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from netkpi.llm.common import scratch, workers_import, written

GRAM = 40
#: Bytes of text whose hashes a task holds at once. Longer texts are cut with overlap.
PORTION = 1 << 20
#: Bits for a place in a portion, below the bits of the hash that decide about the anchor.
PLACE_BITS = 28
#: Bytes at the start of a suffix that decide about its range.
HEAD = 7
#: Compared suffixes per range of the sorted order, on average.
RANGE_ROWS = 20_000
#: Open rows above which a gram is hot: in one task, and of all that meet.
HOT_IN_TASK, HOT_ROWS = 16, 2_000

_BASE = 0x9E3779B97F4A7C15 | 1


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


# --- anchors ------------------------------------------------------------------


_powers_known: list = []


def _powers(n: int):
    """Random values of bytes and the powers of the base and of its inverse, for n bytes or more."""
    import numpy as np

    if not _powers_known or len(_powers_known[1]) < n:
        size = max(n, 2 * PORTION + 1024)
        values = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
        base = np.full(size, _BASE, np.uint64)
        inverse = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        _powers_known[:] = values, np.multiply.accumulate(base), np.multiply.accumulate(inverse)
    return _powers_known


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of all substrings of some bytes."""

    def __init__(self, data):
        import numpy as np

        values, powers, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, starts, ends):
        return _mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def of_all(self, length: int):
        """Of the substrings of one length, by their start."""
        n = len(self.sums) - length
        return _mixed((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def sliding_least(values, width: int):
    """The least of each ``width`` consecutive values, from block-wise running minima."""
    import numpy as np

    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(table, axis=1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - width + 1
    return np.minimum(backward[:last], forward[width - 1 : width - 1 + last])


def anchors_in(data, starts, ends, length: int):
    """Anchors of texts that lie in ``data`` at [starts, ends): text number, anchor, first and last
    window, first bytes as a number, hash of the gram, hash of the bytes of all its windows."""
    import numpy as np

    none = [np.zeros(0, np.int64)] * 5 + [np.zeros(0, np.uint64)] * 2
    n = len(data)
    if n < length:
        return none
    hashes = Hashes(data)
    grams = hashes.of_all(GRAM)
    ranks = grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)
    ranks |= np.arange(len(grams), dtype=np.uint64)
    least = sliding_least(ranks, length - GRAM + 1)
    valid = np.zeros(n + 1, np.int64)
    long = ends - starts >= length
    valid[starts[long]] += 1
    valid[ends[long] - length + 1] -= 1
    windows = np.flatnonzero(np.cumsum(valid[: len(least)]))
    if not len(windows):
        return none
    anchor = (least[windows] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    first, last = windows[new], windows[np.concatenate([new[1:], [len(windows)]]) - 1]
    anchor = anchor[new]
    around = hashes.of(first, last + length) + (anchor - first).astype(np.uint64) * np.uint64(_BASE)
    text = np.searchsorted(starts, first, side="right") - 1
    head = np.zeros(len(anchor), np.int64)
    for i in range(HEAD):
        head = (head << 8) | data[anchor + i]
    return text, anchor, first, last, head, grams[anchor], around


def _portions(texts: Iterator[tuple[int, bytes]], length: int) -> Iterator[tuple]:
    """Texts laid end to end: bytes, their starts and ends, the key of each and the place in its text."""
    import numpy as np

    held: list[tuple[int, int, bytes]] = []
    size = 0

    def portion():
        lengths = np.array([len(b) for _, _, b in held], np.int64)
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(b for _, _, b in held), np.uint8)
        keys, places = np.array([k for k, _, _ in held], np.int64), np.array([p for _, p, _ in held], np.int64)
        return data, ends - lengths, ends, keys, places

    for key, text in texts:
        for place in range(0, max(len(text) - length, 0) + 1, PORTION):
            # windows that start in this part reach into the next one
            held.append((key, place, text[place : place + PORTION + length - 1]))
            size += len(held[-1][2])
            if size >= PORTION:
                yield portion()
                held, size = [], 0
    if held:
        yield portion()


#: Rows that leave step 1: repeated already, and one for all equal ones of the task.
REPEATED, OPEN = 1, 0
#: ``place`` has the anchor, its distances to the first and the last window, and the kind of row.
_ANCHOR = "gram long, around long, text long, place long, head long"
_RANGE = "text long, place long, head long, repeated boolean"
#: In ``head``: a row of a hot gram, and the row that tells others of the gram that it is hot.
HOT, TELLS_HOT = -1, -2


def packed(anchor, first, last, kind):
    return anchor << 33 | (anchor - first) << 17 | (anchor - last) << 1 | kind


def unpacked(place):
    """Anchor, first window, last window."""
    anchor = place >> 33
    return anchor, anchor - (place >> 17 & 0xFFFF), anchor - (place >> 1 & 0xFFFF)


def _folded(columns: dict) -> dict:
    """Marks equal anchors as repeated and leaves one of them open."""
    import numpy as np

    order = np.lexsort((columns["place"], columns["text"], columns["around"], columns["gram"]))
    c = {k: v[order] for k, v in columns.items()}
    same = (c["gram"][1:] == c["gram"][:-1]) & (c["around"][1:] == c["around"][:-1])
    again = np.concatenate([[False], same])[: len(order)]
    twice = again | np.concatenate([same, [False]])[: len(order)]
    # all but the first of equal ones are done; the first stays open to meet those of other tasks
    repeated = {k: v[twice] for k, v in c.items()}
    still_open = {k: v[~again] for k, v in c.items()}
    repeated["place"] = repeated["place"] | REPEATED
    return {k: np.concatenate([repeated[k], still_open[k]]) for k in c}


def _hot_apart(columns: dict, most: int) -> dict:
    """Marks open rows whose gram has more than ``most`` here, and adds one row for each such gram."""
    import numpy as np

    is_open = np.flatnonzero(columns["place"] & 1 == OPEN)
    _, first, of, n = np.unique(columns["gram"][is_open], return_index=True, return_inverse=True, return_counts=True)
    hot = n > most
    telling = {k: v[is_open[first[hot]]] for k, v in columns.items()}
    telling["head"] = np.full(len(telling["head"]), TELLS_HOT, np.int64)
    head = columns["head"].copy()
    head[is_open[hot[of]]] = HOT
    return {k: np.concatenate([head if k == "head" else v, telling[k]]) for k, v in columns.items()}


def _find_anchors(length: int, most: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        seen: set[int] = set()

        def texts() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if key not in seen:
                        seen.add(key)
                        yield key, text.as_py().encode()

        names = ["gram", "around", "text", "place", "head"]
        found: dict[str, list] = {k: [] for k in names}
        for data, starts, ends, keys, places in _portions(texts(), length):
            number, anchor, first, last, head, gram, around = anchors_in(data, starts, ends, length)
            shift = places[number] - starts[number]
            place = packed(anchor + shift, first + shift, last + shift, OPEN)
            for name, values in zip(names, (gram, around, keys[number], place, head)):
                found[name].append(values)
        if found["text"]:
            out = _hot_apart(_folded({k: np.concatenate(v) for k, v in found.items()}), most)
            for name in ("gram", "around"):
                out[name] = out[name].view(np.int64)
            for start in range(0, len(out["text"]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(out[k][start : start + 100_000]) for k in names], names=names)

    return run


def _meet(most: int):
    """Rows come ordered by gram and surroundings. Decides about grams that are complete."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = [x.split()[0] for x in _ANCHOR.split(", ")]
        out_names = [x.split()[0] for x in _RANGE.split(", ")]

        def made(parts: list[tuple]):
            columns = [np.concatenate([p[k][which] for p, which, _ in parts]) for k in out_names[:3]]
            flag = np.concatenate([np.full(int(which.sum()), f) for _, which, f in parts])
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(flag)], names=out_names)

        def decided(c: dict):
            n = len(c["gram"])
            tells = c["head"] == TELLS_HOT
            of_gram = np.cumsum(np.concatenate([[True], c["gram"][1:] != c["gram"][:-1]])[:n]) - 1
            told = (np.bincount(of_gram[tells], minlength=of_gram[-1] + 1) > 0)[of_gram]
            c, of_gram, told = {k: v[~tells] for k, v in c.items()}, of_gram[~tells], told[~tells]
            n = len(of_gram)
            new_gram = np.concatenate([[True], of_gram[1:] != of_gram[:-1]])[:n]
            new_around = new_gram | np.concatenate([[True], c["around"][1:] != c["around"][:-1]])[:n]
            of_around = np.cumsum(new_around) - 1
            n_arounds = np.bincount(of_gram[new_around], minlength=1)[of_gram] if n else of_gram
            twice = np.bincount(of_around, minlength=1)[of_around] > 1 if n else np.zeros(0, bool)
            c["head"] = np.where(told | (n_arounds > most), HOT, c["head"])
            return made([(c, twice, True), (c, new_around & (told | (n_arounds > 1)), False)])

        held = None
        for batch in batches:
            c = {k: batch.column(i).to_numpy() for i, k in enumerate(names)}
            done, hot = c["place"] & 1 == REPEATED, c["head"] == HOT
            if (done | hot).any():
                yield made([(c, done, True), (c, hot & ~done, False)])
                c = {k: v[~(done | hot)] for k, v in c.items()}
            if held is not None:
                c = {k: np.concatenate([held[k], c[k]]) for k in names}
            if not len(c["gram"]):
                continue
            end = int(np.searchsorted(c["gram"], c["gram"][-1]))  # the last gram may go on
            held = {k: v[end:] for k, v in c.items()}
            if end:
                yield decided({k: v[:end] for k, v in c.items()})
        if held is not None and len(held["gram"]):
            yield decided(held)

    return run


# --- sorted runs --------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the shared prefix, of which ``known`` bytes are shared for sure."""
    n = min(len(a), len(b))
    while known < n:
        step = min(32, n - known)
        if a[known : known + step] == b[known : known + step]:
            known += step
            continue
        while a[known] == b[known]:
            known += 1
        return known
    return n


def front_coded(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Shared prefix with the one before, and the rest, of sorted suffixes."""
    shared = [0] + [common_prefix(a, b) for a, b in zip(suffixes, suffixes[1:])]
    return shared[: len(suffixes)], [s[n:] for s, n in zip(suffixes, shared)]


class LoserTree:
    """Merges front-coded sorted runs; gives the suffix, its prefix shared with the last one, run and place.

    A run's head knows how much it shares with the last suffix given out (with the winner that
    beat it on the way up). Of two heads the one that shares more is smaller; only if both share
    the same are bytes compared, from there on.
    """

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self.runs = runs
        self.heads: list[bytes | None] = [b""] * len(runs)
        self.shared = [0] * len(runs)
        self.at = [-1] * len(runs)
        self.losers = [-1] * max(1, len(runs))
        for run in range(len(runs)):
            self._advance(run)
        self.winner = self._build(1)

    def _advance(self, run: int) -> None:
        self.at[run] += 1
        shared, rests = self.runs[run]
        if self.at[run] < len(rests):
            self.shared[run] = shared[self.at[run]]
            self.heads[run] = self.heads[run][: self.shared[run]] + rests[self.at[run]]
        else:
            self.heads[run] = None

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser then knows what it shares with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.shared[a] != self.shared[b]:
            return (a, b) if self.shared[a] > self.shared[b] else (b, a)
        n = common_prefix(x, y, self.shared[a])
        winner, loser = (a, b) if x[n:] <= y[n:] else (b, a)
        self.shared[loser] = n
        return winner, loser

    def _build(self, node: int) -> int:
        k = len(self.runs)
        if node >= k:
            return node - k
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[bytes, int, int, int]]:
        k = len(self.runs)
        while self.heads[self.winner] is not None:
            run = self.winner
            yield self.heads[run], self.shared[run], run, self.at[run]
            self._advance(run)
            node = (run + k) // 2
            while node:
                run, self.losers[node] = self._play(self.losers[node], run)
                node //= 2
            self.winner = run


# --- comparing ----------------------------------------------------------------


_RUN = (
    "range int, shared binary, rest_lengths binary, rests binary, left_lengths binary, lefts binary, "
    "texts binary, anchors binary, firsts binary, lasts binary"
)
#: Instead of a run: a window of a hot gram (``text`` is null if it is known to be repeated), or a repeated range.
_WINDOW = "window long, text long, start long, end long"


def _parts(heads, grams, cuts):
    """Numbers of ranges. A head that is a cut several times has as many ranges, dealt by gram."""
    import numpy as np

    below, upto = np.searchsorted(cuts, heads, side="left"), np.searchsorted(cuts, heads, side="right")
    return np.where(upto > below, below + 1 + grams % np.maximum(upto - below, 1), upto)


def _folded_windows(segments: list[tuple], length: int):
    """Windows of (bytes, text, start of the first window): repeated ranges, and one row for equal windows."""
    import numpy as np
    import pyarrow as pa

    lengths = np.array([len(s[0]) for s in segments], np.int64)
    texts, firsts = (np.array([s[i] for s in segments], np.int64) for i in (1, 2))
    counts = lengths - length + 1
    of = np.repeat(np.arange(len(segments)), counts)
    within = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (np.cumsum(lengths) - lengths)[of] + within
    hashes = Hashes(np.frombuffer(b"".join(s[0] for s in segments), np.uint8)).of(at, at + length)
    text, start = texts[of], firsts[of] + within
    # the same window of the same text is no repetition
    by = np.lexsort((start, text, hashes))
    h, text, start = hashes[by], text[by], start[by]
    new_hash = np.concatenate([[True], h[1:] != h[:-1]])
    own = new_hash | np.concatenate([[True], (text[1:] != text[:-1]) | (start[1:] != start[:-1])])
    h, text, start, new_hash = h[own], text[own], start[own], new_hash[own]
    first_of = np.flatnonzero(new_hash)
    n = np.diff(np.append(first_of, len(h)))
    twice = np.repeat(n > 1, n)
    by = np.lexsort((start[twice], text[twice]))
    range_text, range_start = text[twice][by], start[twice][by]
    new = np.concatenate([[True], (range_text[1:] != range_text[:-1]) | (range_start[1:] != range_start[:-1] + 1)])
    begin = np.flatnonzero(new[: len(range_text)])
    final = np.append(begin[1:], len(range_text))[: len(begin)] - 1
    known, no = twice[first_of], np.zeros(len(first_of), bool)
    nulls = np.ones(len(begin), bool)
    columns = [
        (np.append(h[first_of].view(np.int64), range_start[begin]), np.append(no, nulls)),
        (np.append(text[first_of], range_text[begin]), np.append(known, ~nulls)),
        (np.append(start[first_of], range_start[begin]), np.append(known, ~nulls)),
        (np.append(start[first_of], range_start[final]) + length, np.append(known, ~nulls)),
    ]
    return [pa.array(values, pa.int64(), mask=mask) for values, mask in columns]


def _meet_windows(batches: Iterator) -> Iterator:
    """Rows come ordered by window: those that are not alone are repeated."""
    import numpy as np
    import pyarrow as pa

    def decided(c: list):
        h, missing = c[0], c[4]
        same = h[1:] == h[:-1]
        told = (np.concatenate([[False], same]) | np.concatenate([same, [False]])) & ~missing
        return pa.RecordBatch.from_arrays([pa.array(x[told]) for x in c[1:4]], names=["text", "start", "end"])

    held = None
    for batch in batches:
        c = [batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(4)]
        c.append(batch.column(1).is_null().to_numpy(zero_copy_only=False))
        if held is not None:
            c = [np.concatenate(x) for x in zip(held, c)]
        if not len(c[0]):
            continue
        end = int(np.searchsorted(c[0], c[0][-1]))  # the last window may go on
        held = [x[end:] for x in c]
        if end:
            yield decided([x[:end] for x in c])
    if held is not None and len(held[0]):
        yield decided(held)


def _make_runs(length: int, splitters: list[int]):
    """From texts with their open anchors to front-coded sorted runs, one per range and portion, and to windows of hot grams."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = [x.split()[0] for x in f"{_RUN}, {_WINDOW}".split(", ")]
        kinds = [pa.int32(), *[pa.binary()] * 9, *[pa.int64()] * 4]
        cuts = np.array(splitters, np.int64)

        def runs(rows: list[tuple]):
            rows.sort(key=lambda r: r[0])
            heads = np.array([int.from_bytes(r[0][:HEAD], "big") for r in rows], np.int64)
            part = _parts(heads, np.array([zlib.crc32(r[0][:GRAM]) for r in rows], np.int64), cuts)
            if (part[1:] < part[:-1]).any():
                order = np.argsort(part, kind="stable")
                rows, part = [rows[i] for i in order], part[order]
            bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            out = []
            for a, b in zip(bounds, bounds[1:]):
                some = rows[a:b]
                shared, rests = front_coded([r[0] for r in some])
                out.append(
                    (
                        int(part[a]),
                        np.array(shared, np.int32).tobytes(),
                        np.array([len(x) for x in rests], np.int32).tobytes(),
                        b"".join(rests),
                        np.array([len(r[1]) for r in some], np.int32).tobytes(),
                        b"".join(r[1] for r in some),
                        *(np.array([r[i] for r in some], np.int64).tobytes() for i in range(2, 6)),
                    )
                )
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds)]
            return pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(out), t) for t in kinds[10:])], names=names)

        def windows(segments: list[tuple]):
            columns = _folded_windows(segments, length)
            for at in range(0, len(columns[0]), 100_000):
                some = [c.slice(at, 100_000) for c in columns]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some[0]), t) for t in kinds[:10]), *some], names=names)

        rows, size, seen = [], 0, set()
        segments, segments_size = [], 0
        for batch in batches:
            for key, text, places, hot in zip(
                batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ):
                if key in seen:  # copies of a text come to the same task
                    continue
                seen.add(key)
                data = text.as_py().encode()
                for anchor, first, last in map(unpacked, places):
                    rows.append((data[anchor : last + length], data[first:anchor], key, anchor, first, last))
                    size += last + length - first
                if size > 16 << 20:
                    yield runs(rows)
                    rows, size = [], 0
                for _, first, last in map(unpacked, hot):
                    segments.append((data[first : last + length], key, first))
                    segments_size += last + length - first
                    if segments_size > PORTION:
                        yield from windows(segments)
                        segments, segments_size = [], 0
        if rows:
            yield runs(rows)
        if segments:
            yield from windows(segments)

    return run


def _merge_range(length: int):
    """Merges the runs of a range and returns the windows that are repeated, as ranges."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        runs, lefts, meta = [], [], []
        for r in table.to_pylist():
            shared, rest_lengths = np.frombuffer(r["shared"], np.int32), np.frombuffer(r["rest_lengths"], np.int32)
            runs.append((shared.tolist(), _cut(r["rests"], rest_lengths)))
            lefts.append(_cut(r["lefts"], np.frombuffer(r["left_lengths"], np.int32)))
            meta.append([np.frombuffer(r[c], np.int64) for c in ("texts", "anchors", "firsts", "lasts")])
        order, shares = [], []
        for _, shared, i, at in LoserTree(runs):
            order.append((i, at))
            shares.append(shared)
        text, anchor, first, last = (
            np.array([meta[i][c][at] for i, at in order], np.int64) for c in range(4)
        )
        found = repeated_windows(np.array(shares), [lefts[i][at] for i, at in order], anchor - first, anchor - last, length)
        pairs = [(members, anchor[members] - distance) for members, distance in found]
        member = np.concatenate([text[:0], *(m for m, _ in pairs)])
        start = np.concatenate([text[:0], *(s for _, s in pairs)])
        by_place = np.lexsort((start, member))
        member, start = member[by_place], start[by_place]
        # windows that start one after the other make one range
        new = np.concatenate([[True], (member[1:] != member[:-1]) | (start[1:] != start[:-1] + 1)])[: len(start)]
        first_of = np.flatnonzero(new)
        last_of = np.concatenate([first_of[1:], [len(start)]])[: len(first_of)] - 1
        return pa.table({"text": text[member[first_of]], "start": start[first_of], "end": start[last_of] + length})

    return run


def _cut(data: bytes, lengths) -> list[bytes]:
    import numpy as np

    ends = np.cumsum(lengths).tolist()
    return [data[e - n : e] for e, n in zip(ends, lengths.tolist())]


def repeated_windows(shared, lefts: list[bytes], most, least, length: int) -> Iterator[tuple]:
    """For each distance l of a window's start before the anchor: the members whose window is repeated.

    Members are in the order of their suffixes, ``shared`` is the prefix shared with the one before;
    a member has windows at distances from ``least`` to ``most`` (below 0 if they start after it).
    """
    import numpy as np

    n = len(lefts)
    if n < 2:
        return
    # running hashes of the bytes before the anchor, going back from it
    depth = max(int(most.max()), 0)
    back = np.zeros((n, depth), np.uint8)
    for i, left in enumerate(lefts):
        back[i, : len(left)] = np.frombuffer(left[::-1], np.uint8)
    key = np.zeros(n, np.uint64)
    for distance in range(depth + 1):
        if distance:
            key = _mixed(key + back[:, distance - 1] + np.uint64(_BASE))
        # a new group starts where fewer bytes than the window has after the anchor are shared
        group = np.cumsum(shared < length - distance).astype(np.uint64)
        members = np.flatnonzero((most >= distance) & (least <= distance))
        if len(members) < 2:
            continue
        keys = _mixed(key[members] ^ (group[members] * np.uint64(_BASE)))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if twice.any():
            yield members[order[twice]], distance


# --- putting together ---------------------------------------------------------


def _joined_ranges(ranges) -> list[tuple[int, int]]:
    """Overlapping and touching ranges made one."""
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _remove(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        counts, removed, spans, digests, kept_texts = [], [], [], [], []
        for text, starts, ends, whole in zip(batch.column(1), *(c.to_pylist() for c in batch.columns[2:])):
            data = text.as_py().encode()
            ranges = [(0, len(data))] if whole else _joined_ranges(zip(starts or (), ends or ()))
            kept, at = [], 0
            for start, end in ranges:
                kept.append(data[at:start])
                at = end
            kept.append(data[at:])
            rest = b"".join(kept)
            counts.append(len(data))
            removed.append(len(data) - len(rest))
            spans.append(len(ranges))
            digests.append(hashlib.sha256(rest).hexdigest())
            kept_texts.append(rest)
        made = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]
        made += [pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *made], names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def repeated_ranges(docs: DataFrame, length: int, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts repeated as a whole (``text``), and byte ranges of texts that are repeated (``text``, ``start``, ``end``)."""
    import numpy as np

    spark = docs.sparkSession
    workers_import(spark)
    folder = scratch(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(text_key(F.col(text_col)).alias("key"), text.alias("data"))
    whole = (
        texts.where(F.octet_length("data") >= length)
        .groupBy(F.col("key").alias("text"))
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("text")
    )
    anchors = texts.mapInArrow(_find_anchors(length, HOT_IN_TASK), _ANCHOR)
    # Only open rows have to meet; what is repeated already, or of a gram known to be hot, is dealt by text.
    by = F.when((F.col("place").bitwiseAND(1) == REPEATED) | (F.col("head") == HOT), F.col("text")).otherwise(F.col("gram"))
    met = anchors.repartition(by).sortWithinPartitions("gram", "around").mapInArrow(_meet(HOT_ROWS), _RANGE)
    met = written(met, f"{folder}/met")
    place = F.col("place")
    anchor = F.shiftright(place, 33)
    first = anchor - F.shiftright(place, 17).bitwiseAND(0xFFFF)
    last = anchor - F.shiftright(place, 1).bitwiseAND(0xFFFF)
    repeated = met.where("repeated").select("text", first.alias("start"), (last + length).alias("end"))
    to_compare = met.where("NOT repeated")
    hot = F.col("head") == HOT
    n, n_hot = to_compare.agg(F.count_if(~hot), F.count_if(hot)).first()
    if not n + n_hot:
        return whole, repeated
    n_ranges = int(-(-n // RANGE_ROWS))
    splitters: list[int] = []
    if n_ranges > 1:
        # Quantiles of the first bytes: 8 bytes per 20,000 suffixes. The summary has more steps than there are ranges, or a
        # range could not be narrower than a step.
        shares = F.lit(np.arange(1, n_ranges) / n_ranges)
        steps = max(10_000, 4 * n_ranges)
        splitters = to_compare.where(~hot).select(F.percentile_approx("head", shares, F.lit(steps))).first()[0]
    places = to_compare.groupBy("text").agg(
        F.collect_set(F.when(~hot, F.col("place"))).alias("places"), F.collect_set(F.when(hot, F.col("place"))).alias("hot")
    )
    places = written(places, f"{folder}/places")
    with_places = texts.join(places, F.col("key") == F.col("text")).select("key", "data", "places", "hot")
    runs = with_places.mapInArrow(_make_runs(length, splitters), f"{_RUN}, {_WINDOW}")
    if n_hot:  # both kinds of rows come from one pass over the texts
        runs = written(runs, f"{folder}/runs")
    found = [repeated]
    if n:
        run_columns = [x.split()[0] for x in _RUN.split(", ")]
        ranges = runs.where("range IS NOT NULL").select(*run_columns).groupBy("range")
        merged = ranges.applyInArrow(_merge_range(length), "text long, start long, end long")
        found.append(written(merged, f"{folder}/ranges"))
    if n_hot:
        windows = runs.where("range IS NULL").select("window", "text", "start", "end")
        found.append(windows.where("window IS NULL").drop("window"))
        meeting = windows.where("window IS NOT NULL").repartition("window").sortWithinPartitions("window")
        met_windows = meeting.mapInArrow(_meet_windows, "text long, start long, end long")
        found.append(written(met_windows, f"{folder}/windows"))
    return whole, reduce(DataFrame.unionByName, found)


def remove_repeats(docs: DataFrame, length: int = 200, text_col: str = "text") -> DataFrame:
    """``row`` (struct of the input's columns), ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``."""
    whole, ranges = repeated_ranges(docs, length, text_col)
    by_text = ranges.groupBy("text").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    plan = by_text.join(whole.withColumn("whole", F.lit(True)), "text", "full")
    # From a written table both sides of the last join are plain shuffles, which Spark can split where
    # one text has very many copies.
    plan = written(plan, f"{scratch(docs.sparkSession)}/plan")
    rows = docs.select(
        F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("data"), text_key(F.col(text_col)).alias("text")
    )
    schema = StructType(
        [
            rows.schema["row"],
            StructField("n_bytes", LongType()),
            StructField("n_removed", LongType()),
            StructField("n_spans", LongType()),
            StructField("kept_sha256", StringType()),
        ]
    )
    found = rows.join(plan, "text", "left").select("row", "data", "starts", "ends", F.coalesce("whole", F.lit(False)).alias("whole"))
    return found.mapInArrow(_remove, schema)
