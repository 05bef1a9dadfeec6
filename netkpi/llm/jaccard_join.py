"""N-gram Jaccard join: size-aware, light for small sets and heavy for large ones.

Documents are sets of word shingles; two link if 100 * |A and B| >= percent * |A or B|. Equal sets
are one class, of which one stands for all.

Light: sets up to a boundary size enumerate subsets of fixed sizes. Sets of sizes a <= b link if
they share o = ceil(percent * (a + b) / (100 + percent)) shingles, so both enumerate their subsets
of size o, marked (a, b). Who meets there links, without a look at the sets.

Heavy: for all pairs with a larger set. Shingles have one order for all, rarer ones first. A set of
size n enters the inverted lists of its first n - ceil(percent * n / 100) + 1 shingles; linked sets
meet in the list of their first common shingle, which leaves both with at least o shingles from
there on. Lists are scanned in order of size with this bound. Scanning is in rounds, so that a large
family of near copies does not turn into all its pairs: first every member meets the nearest (by sketch) of the hubs of its
lists, then its other hubs, if they are of another family by now, and one member of another family, by chance, and linked ones are put together; in the last round all
pairs of different families are looked at, however long a list is.

Before whole sets are compared, so are their parity sketches: one bit for the parity of the number of
shingles in each of some groups. Two sketches differ in at most as many bits as the sets differ in
shingles, so a pair that differs in more is out for sure. All classes have a sketch, but only the sets
of pairs that pass it are made and moved: most texts that meet in a list by chance never are.

The boundary is the size with the least cost, from the number of sets of each small size: rows of
subsets against postings and the candidates these bring.

The order comes from counts in ``BUCKETS`` buckets of shingle hashes, a table of fixed size; any
order gives right results, this one keeps shingles that a third of all documents share out of the
lists. Links become components by alternating star operations on tables; nothing but the buckets
and the sizes' histogram goes through the driver.

Shingles and sets are compared by 64-bit hashes. Defined cases: a document without words or text
has the empty set and links with nothing. Fewer words than a shingle has are one shingle. A row
without id takes part; a component without ids has none. Rows that repeat an id are documents of
their own, with that id. Extra columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netkpi.llm.common import hashes_of, lowered, scratch, workers_import, written

#: Buckets of shingle hashes that are counted for the order, as a power of two.
BUCKET_BITS = 20
#: Sets above this size never take the light way.
LARGEST_LIGHT = 30
#: Candidates that a posting brings, each as dear as a row, for the choice of the boundary.
CANDIDATES = 8

_ODD = 0x9E3779B97F4A7C15


def overlap_needed(a, b, percent: int):
    """Common shingles that sets of two sizes need to link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


# --- sets ---------------------------------------------------------------------


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int):
    """Sorted distinct hashes of a text's shingles."""
    import numpy as np

    words = lowered((text or "").encode()).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes_of(words)
    size = min(width, len(h))
    key = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        key = (key ^ h[j : j + len(key)]) * np.uint64(_ODD)
        key ^= key >> np.uint64(32)
    key = _mixed(key)
    key.sort()
    return key[np.concatenate([[True], key[1:] != key[:-1]])]


def class_of(shingles) -> int:
    """Signed 64-bit hash of a set."""
    import xxhash

    value = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >> 63 else value


def _sizes_and_counts(width: int):
    """Per document its set's size and class, with the sketch once per task; at the end of the task the counts of the buckets."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["doc_id", "key", "n", "class", "sketch", "part", "counts"]
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        seen: set[int] = set()
        some: list = []
        held = 0

        def count() -> None:
            if some:
                found = np.concatenate(some) >> np.uint64(64 - BUCKET_BITS)
                counts[:] += np.bincount(found.astype(np.int64), minlength=len(counts))
                some.clear()

        for batch in batches:
            sizes, classes, sketches = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), width)
                sizes.append(len(s))
                classes.append(class_of(s))
                sketches.append(None)
                if classes[-1] not in seen:
                    seen.add(classes[-1])
                    some.append(s)
                    if len(s):
                        sketches[-1] = sketch_of(s)
                    held += len(s)
                    if held > 1 << 20:
                        count()
                        held = 0
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(classes, pa.int64()),
                    pa.array(sketches, pa.binary()),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                ],
                names=names,
            )
        count()
        if counts.any():
            parts = np.split(counts.astype("<i4"), 64)
            nothing = pa.nulls(64, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[nothing] * 4,
                    pa.nulls(64, pa.binary()),
                    pa.array(range(64), pa.int32()),
                    pa.array([p.tobytes() for p in parts]),
                ],
                names=names,
            )

    return run


def _added(key, pdf):
    import numpy as np
    import pandas as pd

    total = sum(np.frombuffer(c, "<i4").astype("<i8") for c in pdf["counts"])
    return pd.DataFrame({"part": [key[0]], "counts": [total.tobytes()]})


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest size that takes the light way, at the least cost."""

    def cost(x: int) -> int:
        light = sum(n * _n_subsets(s, x, percent) for s, n in sizes.items() if s <= x)
        heavy = sum(
            n * prefix_length(s, percent) * (1 + CANDIDATES)
            for s, n in sizes.items()
            if s >= -(-percent * (x + 1) // 100)
        )
        return light + heavy

    return min(range(LARGEST_LIGHT + 1), key=lambda x: (cost(x), x))


def _pairs_of_sizes(size: int, largest: int, percent: int) -> list[tuple[int, int, int]]:
    """(a, b, overlap) of the size with all others up to ``largest`` that it may link with."""
    found = []
    for other in range(1, largest + 1):
        a, b = min(size, other), max(size, other)
        need = overlap_needed(a, b, percent)
        if need <= a:
            found.append((a, b, need))
    return found


def _n_subsets(size: int, largest: int, percent: int) -> int:
    return sum(math.comb(size, need) for _, _, need in _pairs_of_sizes(size, largest, percent))


# --- lists --------------------------------------------------------------------

#: ``what`` holds the size and the position of the shingle, or for a subset the size and LIGHT + a.
LIGHT = 1 << 31
_POSTING = "h long, what long, class long"
_FOUND = "kind int, x long, y long, what long"
HUB, MEMBER, LINK = 0, 1, 2


def _postings(width: int, percent: int, light: int, order):
    """Rows of one set per class and task: prefix shingles, and subsets of small sets."""
    smallest = -(-percent * (light + 1) // 100)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ranks = order.value
        seen: set[int] = set()
        hashes, whats, classes, held = [], [], [], 0

        def out():
            arrays = [np.concatenate(hashes).view(np.int64), np.concatenate(whats), np.concatenate(classes)]
            for c in (hashes, whats, classes):
                c.clear()
            return pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=["h", "what", "class"])

        for batch in batches:
            for text in batch.column(0):
                s = shingle_set(text.as_py(), width)
                n, name = len(s), class_of(s)
                if not n or name in seen:
                    continue
                seen.add(name)
                if n <= light:
                    h, what = _subsets(s, light, percent)
                    hashes.append(h)
                    whats.append(what)
                if n >= smallest:
                    rank = ranks[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                    p = prefix_length(n, percent)
                    if p < n:  # the p least by rank, then by hash
                        least = np.argpartition(rank, p - 1)[:p]
                        edge = rank[least].max()
                        least = np.flatnonzero(rank <= edge)
                        least = least[np.argsort(rank[least], kind="stable")][:p]
                    else:
                        least = np.argsort(rank, kind="stable")
                    hashes.append(s[least])
                    whats.append(np.int64(n << 32) | np.arange(len(least), dtype=np.int64))
                for h in hashes[len(classes) :]:
                    classes.append(np.full(len(h), name, np.int64))
                    held += len(h)
                if held > 100_000:
                    yield out()
                    held = 0
        if hashes:
            yield out()

    return run


def _subsets(s, light: int, percent: int):
    """Hashes of the subsets of a small set, and its size with the smaller size of the pair."""
    import numpy as np

    n, values = len(s), [int(v) for v in _mixed(s)]
    total, mask = sum(values), (1 << 64) - 1
    found, whats = [], []
    for a, b, need in _pairs_of_sizes(n, light, percent):
        for gone in combinations(values, n - need):
            found.append((total - sum(gone)) * 3 + (a << 40) + (b << 20) & mask)
            whats.append(n << 32 | LIGHT | a)
    return _mixed(np.array(found, np.uint64)), np.array(whats, np.int64)


def _runs(batches: Iterator) -> Iterator[tuple]:
    """Lists (hash, sizes and positions, classes) from rows ordered by hash; lists of one are dropped."""
    import numpy as np

    held = None
    for batch in batches:
        c = [batch.column(i).to_numpy() for i in range(3)]
        if held is not None:
            c = [np.concatenate([a, b]) for a, b in zip(held, c)]
        if not len(c[0]):
            continue
        end = int(np.searchsorted(c[0], c[0][-1]))  # the last list may go on
        held = [x[end:] for x in c]
        yield from _runs_in([x[:end] for x in c])
    if held is not None:
        yield from _runs_in(held)


def _runs_in(c: list) -> Iterator[tuple]:
    import numpy as np

    if len(c[0]) < 2:
        return
    # a class that several tasks have seen is there more than once
    new = np.concatenate([[True], (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])])
    c = [x[new] for x in c]
    edges = np.flatnonzero(np.concatenate([[True], c[0][1:] != c[0][:-1], [True]]))
    for a, b in zip(edges[:-1][np.diff(edges) > 1].tolist(), edges[1:][np.diff(edges) > 1].tolist()):
        yield c[0][a], c[1][a:b], c[2][a:b]


def _may_link(n_x, left_x, n_y, left_y, percent: int):
    """Whether the shingles from the list's on suffice for both."""
    import numpy as np

    need = overlap_needed(n_x, n_y, percent)
    return (need <= left_x) & (need <= np.minimum(left_y, n_x))


#: Members of a list that are held against the others at once; lists of more than ``LONG`` go on as they are.
_BLOCK, LONG = 64, 4096


def _with_partner(n, left, hubs: list[int], percent: int, light: int):
    """Which members of a list, by size, may link with another one, besides the pairs of a hub with a larger one."""
    import numpy as np

    if len(n) > LONG:
        return np.ones(len(n), bool)
    found, smaller = np.zeros(len(n), bool), np.ones(len(n), bool)
    smaller[hubs] = False
    for a in range(0, len(n), _BLOCK):
        b = min(a + _BLOCK, len(n))
        end = int(np.searchsorted(n, 100 * n[b - 1] // percent, side="right"))
        i, j = np.arange(a, b)[:, None], np.arange(a, end)[None, :]
        fits = (j > i) & smaller[i] & (n[j] > light) & _may_link(n[i], left[i], n[j], left[j], percent)
        found[a:b] |= fits.any(axis=1)
        found[a:end] |= fits.any(axis=0)
    return found


def _first_round(percent: int, light: int):
    """Hub pairs and, for the other rounds, the members of lists that may link with one that is no hub; light links."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        rows: list[tuple] = []

        def out():
            columns = [np.concatenate([np.broadcast_to(r[i], np.shape(r[2])) for r in rows]) for i in range(4)]
            rows.clear()
            kinds = [np.int32, np.int64, np.int64, np.int64]
            return pa.RecordBatch.from_arrays(
                [pa.array(c.astype(k)) for c, k in zip(columns, kinds)], names=["kind", "x", "y", "what"]
            )

        size = 0
        for h, what, classes in _runs(batches):
            n, at = what >> 32, what & 0x7FFFFFFF
            if what[0] & LIGHT:
                # all of the smaller size are in front; without one of them nothing links
                if n[0] == at[0] and len(classes) > 1:
                    rows.append((LINK, classes[0], classes[1:], 0))
                    size += len(classes)
            elif n[-1] > light:
                left = n - at
                hubs = []
                todo = np.arange(len(n))
                while len(todo) > 1:  # each hub takes those of its own size range
                    hub, others = todo[0], todo[1:]
                    hubs.append(hub)
                    near = n[others] * percent <= 100 * n[hub]
                    fits = others[near & _may_link(n[hub], left[hub], n[others], left[others], percent)]
                    if len(fits):
                        rows.append((HUB, classes[hub], classes[fits], 0))
                        size += len(fits)
                    todo = others[~near]
                if len(n) > 2:
                    kept = _with_partner(n, left, hubs, percent, light)
                    if kept.any():
                        rows.append((MEMBER, h, classes[kept], what[kept]))
                        size += int(kept.sum())
            if size > 100_000:
                yield out()
                size = 0
        if rows:
            yield out()

    return run


class _Sketches:
    """Parity sketches of the members of a list, folded to each size that occurs."""

    def __init__(self, sketches: list[bytes]):
        import numpy as np

        self.sizes = [len(x) for x in sketches]
        self.tables = {}
        for size in set(self.sizes):
            table = np.zeros((len(sketches), size // 8), np.uint64)
            for i, x in enumerate(sketches):
                while len(x) > size:
                    half = len(x) // 2
                    x = (np.frombuffer(x[:half], np.uint64) ^ np.frombuffer(x[half:], np.uint64)).tobytes()
                if len(x) == size:
                    table[i] = np.frombuffer(x, np.uint64)
            self.tables[size] = table

    def apart(self, i: int, others: slice):
        """Bits in which the others, of the same size class or larger ones, differ from a member."""
        import numpy as np

        table = self.tables[self.sizes[i]]
        return np.bitwise_count(table[others] ^ table[i]).sum(axis=1)


def _scan(percent: int, light: int, one_each: bool):
    """Pairs of different families in the lists that may link: all, or one for each member as the smaller.

    Rows come ordered by list and size, with their family and sketch.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held = None

        def pairs(c: list) -> Iterator:
            edges = np.flatnonzero(np.concatenate([[True], c[0][1:] != c[0][:-1], [True]]))
            xs, ys, size = [], [], 0
            for a, b in zip(edges, edges[1:]):
                what, classes, families = (x[a:b] for x in c[1:4])
                if (families == families[0]).all():
                    continue
                n = what >> 32
                left = n - (what & 0x7FFFFFFF)
                sketches = _Sketches(c[4][a:b].tolist())
                for i in np.flatnonzero(left >= overlap_needed(n, n, percent)):  # as the smaller of a pair
                    end = i + 1 + int(np.searchsorted(n[i + 1 :], 100 * n[i] // percent, side="right"))
                    o = slice(i + 1, end)
                    fits = _may_link(n[i], left[i], n[o], left[o], percent) & (families[o] != families[i]) & (n[o] > light)
                    if fits.any():
                        fits &= sketches.apart(i, o) <= n[i] + n[o] - 2 * overlap_needed(n[i], n[o], percent)
                    found = classes[o][fits]
                    if one_each and len(found):
                        found = found[[(int(classes[i]) ^ int(c[0][a])) % len(found)]]
                    if len(found):
                        ys.append(found)
                        xs.append(np.full(len(found), classes[i]))
                        size += len(found)
                    if size > 100_000:
                        yield batch_of(xs, ys)
                        xs, ys, size = [], [], 0
            if xs:
                yield batch_of(xs, ys)

        def batch_of(xs: list, ys: list):
            x, y = np.concatenate(xs), np.concatenate(ys)
            found = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["x", "y"])

        for batch in batches:
            c = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if held is not None:
                c = [np.concatenate([a, b]) for a, b in zip(held, c)]
            if not len(c[0]):
                continue
            end = int(np.searchsorted(c[0], c[0][-1]))
            held = [x[end:] for x in c]
            if end:
                yield from pairs([x[:end] for x in c])
        if held is not None and len(held[0]):
            yield from pairs(held)

    return run


# --- verification -------------------------------------------------------------


def sketch_of(shingles) -> bytes:
    """Parities of the groups of shingles; the number of groups is a power of two, above twice the size."""
    import numpy as np

    bits = max(64, 2 << len(shingles).bit_length())
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1).tobytes()


def _stored_sets(width: int):
    """Class, size and hashes of the sets of texts, once per task."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(0):
                s = shingle_set(text.as_py(), width)
                name = class_of(s)
                if name not in seen:  # rows that repeat id and text
                    seen.add(name)
                    rows.append((name, len(s), s.tobytes()))
            columns = zip(*rows, strict=True) if rows else [()] * 3
            kinds = [pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["class", "n", "hashes"])

    return run


def _common(a: bytes, b: bytes) -> int:
    import numpy as np

    both = np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)])
    both.sort(kind="stable")  # merges the two sorted runs
    return int((both[1:] == both[:-1]).sum())


def _may_link_by_sketch(percent: int):
    """Pairs whose sketches do not differ too much, and in how many bits they do."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, y, n_x, n_y = (batch.column(i).to_numpy() for i in range(4))
            most = n_x + n_y - 2 * overlap_needed(n_x, n_y, percent)
            apart = []
            for pair in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                small, large = sorted(pair, key=len)
                apart.append(int(_Sketches([small, large]).apart(0, slice(1, 2))[0]))
            apart = np.array(apart, np.int64)
            good = apart <= most
            yield pa.RecordBatch.from_arrays([pa.array(c[good]) for c in (x, y, apart)], names=["x", "y", "apart"])

    return run


def _links(percent: int):
    """Pairs whose sets link."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, y, n_x, n_y = (batch.column(i).to_numpy() for i in range(4))
            common = [_common(a.as_py(), b.as_py()) for a, b in zip(batch.column(4), batch.column(5))]
            good = np.array(common, np.int64) >= overlap_needed(n_x, n_y, percent)
            yield pa.RecordBatch.from_arrays([pa.array(x[good]), pa.array(y[good])], names=["x", "y"])

    return run


def _with_sides(pairs: DataFrame, sets: DataFrame, part: str) -> DataFrame:
    """``x``, ``y``, sizes and one part of both sets. Both sides of the joins grow with the table: never a broadcast."""

    def side(name: str) -> DataFrame:
        return sets.select(F.col("class").alias(name), F.col("n").alias(f"n_{name}"), F.col(part).alias(f"{part}_{name}"))

    both = pairs.join(side("y").hint("merge"), "y").join(side("x").hint("merge"), "x")
    return both.select("x", "y", "n_x", "n_y", f"{part}_x", f"{part}_y")


def _of_two_families(pairs: DataFrame, families: DataFrame) -> DataFrame:
    """Pairs whose members are not connected so far."""
    of_x = families.select(F.col("node").alias("x"), F.col("root").alias("root_x"))
    of_y = families.select(F.col("node").alias("y"), F.col("root").alias("root_y"))
    both = pairs.join(of_x, "x", "left").join(of_y, "y", "left")
    return both.where(F.coalesce("root_x", "x") != F.coalesce("root_y", "y")).select("x", "y")


# --- layout -------------------------------------------------------------------

#: Words of 64 bits in a filter of keys.
FILTER_WORDS = 1 << 19


def _among(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key, a hash, may be one of ``others``; a few others pass.

    The filter is a set of bits of a fixed size, broadcast as a table of at most ``FILTER_WORDS`` words of 64 bits. It
    keeps texts and sets that are not wanted out of a shuffle; the join that follows decides.
    """

    def word(c: str) -> Column:
        return F.shiftrightunsigned(F.col(c), 6).bitwiseAND(F.lit(FILTER_WORDS - 1))

    def bit(c: str) -> Column:
        return F.col(c).bitwiseAND(F.lit(63)).cast("int")

    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(other_key))
    bits = others.select(word(other_key).alias("_word"), one.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = rows.withColumn("_of", word(key)).join(F.broadcast(bits), F.col("_of") == F.col("_word"))
    return marked.where(F.call_function("bit_get", F.col("_bits"), bit(key)) == 1).select(*rows.columns)


def bucketed(df: DataFrame, key: str, path: str) -> DataFrame:
    """Write a table once, one row per key, in buckets of its key, so that no join on the key moves it again.

    The session's catalogue knows its layout; the entry goes with the session, the files with their folder.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"buckets_{uuid.uuid4().hex}"
    df.repartition(n, key).dropDuplicates([key]).write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


# --- components ---------------------------------------------------------------


def components(edges: DataFrame, folder: str) -> DataFrame:
    """``node`` and ``root`` (the least node it is connected with) of all nodes of edges (``x``, ``y``).

    Large star and small star in turn: each node links its larger, then its smaller neighbours to the
    least one it knows, until every edge leads to a root. Each turn is a written table.
    """

    def checksum(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()

    def least(df: DataFrame, node: str, other: str) -> DataFrame:
        return df.groupBy(F.col(node).alias("of")).agg(F.min(other).alias("m"))

    edges = edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    edges = written(edges, f"{folder}/edges-0")
    before, turn = checksum(edges), 0
    while True:
        turn += 1
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        # large star: (u, v) with v > u becomes (v, m), m the least of u and its neighbours
        m = least(both, "x", "y").select("of", F.least("of", "m").alias("m"))
        large = both.where("y > x").join(m, F.col("x") == F.col("of")).select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = large.where("x <> y").distinct()
        # small star: (u, v) with v < u becomes (v, m) and (u, m), m the least of the smaller neighbours
        m = least(large, "x", "y")
        small = large.join(m, F.col("x") == F.col("of")).select(F.col("y").alias("x"), F.col("m").alias("y"))
        small = small.where("x <> y").union(m.select(F.col("of").alias("x"), F.col("m").alias("y"))).distinct()
        edges = written(small, f"{folder}/edges-{turn}")
        after = checksum(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct()
    return edges.select(F.col("x").alias("node"), F.col("y").alias("root")).union(roots)


# --- the join -----------------------------------------------------------------


def jaccard_components(
    docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``key`` (hash of the text), ``n_shingles``, ``component_id`` per row, and ``component``,
    the same for all rows of a component (null without words)."""
    spark = docs.sparkSession
    workers_import(spark)
    folder = scratch(spark)
    key: Column = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))
    first = docs.mapInArrow(
        _sizes_and_counts(width), "doc_id long, key long, n long, class long, sketch binary, part int, counts binary"
    )
    first = written(first, f"{folder}/sizes")
    rows = first.where("part IS NULL").select("doc_id", "key", "n", "class")
    classes = (
        rows.where("n > 0")
        .groupBy("class")
        .agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.min(F.struct("doc_id", "key")).alias("one"))
    )
    classes = bucketed(classes.select("class", "least", "n", F.xxhash64("one.doc_id", "one.key").alias("one")), "class", f"{folder}/classes")
    sketches = first.where("sketch IS NOT NULL").select("class", "n", "sketch")
    sketches = bucketed(sketches, "class", f"{folder}/sketches")
    order = _order(first)
    small = classes.where(F.col("n") <= LARGEST_LIGHT).groupBy("n").count().collect()
    light = boundary({r["n"]: r["count"] for r in small}, percent)
    postings = docs.select("text").mapInArrow(_postings(width, percent, light, spark.sparkContext.broadcast(order)), _POSTING)
    lists = postings.repartition("h").sortWithinPartitions("h", "what", "class")
    lists = written(lists.mapInArrow(_first_round(percent, light), _FOUND), f"{folder}/lists")

    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()

    # x is the hub, y the member
    hubs = written(lists.where((F.col("kind") == HUB) & (F.col("x") != F.col("y"))).select("x", "y").distinct(), f"{folder}/hubs")
    members = lists.where(F.col("kind") == MEMBER).select(F.col("x").alias("h"), "what", F.col("y").alias("class"))
    links = lists.where(F.col("kind") == LINK).select("x", "y")
    texts = docs.select("text", F.xxhash64("doc_id", "key").alias("one"))

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Of written pairs those whose sets link; no other set is made."""
        asked = pairs.select(F.col("x").alias("class")).union(pairs.select("y")).distinct()
        asked = written(asked.join(classes.hint("merge"), "class").select("class", "one"), f"{folder}/{name}-asked")
        made = _among(texts, "one", asked, "one").select("text").mapInArrow(_stored_sets(width), "class long, n long, hashes binary")
        sets = bucketed(_among(made, "class", asked, "class"), "class", f"{folder}/{name}-sets")
        links = _with_sides(pairs, sets, "hashes").mapInArrow(_links(percent), "x long, y long")
        return written(links, f"{folder}/{name}")

    def families_of(edges: DataFrame, name: str) -> DataFrame:
        return written(components(edges, f"{folder}/{name}"), f"{folder}/{name}/all")

    def scanned(families: DataFrame, one_each: bool) -> DataFrame:
        of_class = families.withColumnRenamed("node", "class")
        rows = members.join(of_class, "class", "left").join(sketches.select("class", "sketch").hint("merge"), "class")
        rows = rows.select("h", "what", "class", F.coalesce("root", "class").alias("family"), "sketch")
        rows = rows.repartition("h").sortWithinPartitions("h", "what")
        return ordered(rows.mapInArrow(_scan(percent, light, one_each), "x long, y long"))

    def stars(families: DataFrame) -> DataFrame:
        return families.select(F.col("node").alias("x"), F.col("root").alias("y"))

    near = _with_sides(hubs, sketches, "sketch").mapInArrow(_may_link_by_sketch(percent), "x long, y long, apart long")
    near = written(near, f"{folder}/near")
    # of the hubs that a member meets in its lists, the nearest one by sketch; the others wait for the next round
    nearest = near.groupBy("y").agg(F.min(F.struct("apart", "x")).alias("hub")).select(F.col("hub.x").alias("x"), "y")
    nearest = written(nearest, f"{folder}/nearest")
    families = families_of(linked(nearest, "first").union(links), "families")
    looked_at = ordered(nearest)
    other_hubs = _of_two_families(ordered(near), families)
    met = scanned(families, True).union(other_hubs).distinct()
    met = written(met.join(looked_at, ["x", "y"], "left_anti"), f"{folder}/met")
    families = families_of(stars(families).union(linked(met, "second")), "more-families")
    rest = scanned(families, False).join(looked_at.union(met), ["x", "y"], "left_anti")
    rest = written(rest, f"{folder}/rest")
    all_families = families_of(stars(families).union(linked(rest, "third")), "components")
    named = all_families.join(classes.select(F.col("class").alias("node"), "least"), "node")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(names, "root").select(F.col("node").alias("class"), "component_id", "root")
    result = (
        classes.select("class", "least")
        .join(of_class, "class", "left")
        .select(
            "class",
            F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
            F.coalesce("root", "class").alias("component"),
        )
    )
    result = written(result, f"{folder}/result")
    return rows.join(result, "class", "left").select(
        "doc_id",
        "key",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "component",
    )


def _order(first: DataFrame):
    """Rank of each bucket by its count, as an array."""
    import numpy as np

    parts = first.where("part IS NOT NULL").select("part", "counts").groupBy("part")
    sums = parts.applyInPandas(_added, "part int, counts binary").collect()
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in sums:
        counts.reshape(64, -1)[r["part"]] = np.frombuffer(r["counts"], "<i8")
    ranks = np.empty(len(counts), np.int32)
    ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
    return ranks


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that with the least id; same columns.

    Documents without words stay. Rows without id come last in their component. Of rows that repeat
    id and text one stays.
    """
    found = jaccard_components(docs, width, percent, id_col, text_col)
    named = found.select(F.col("doc_id").isNull().alias("k0"), F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("key").alias("k2"), "component")
    one = named.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("k0", "k1", "k2")).alias("one"))
    kept = one.select("one.*").union(named.where("component IS NULL").select("k0", "k1", "k2")).distinct()
    kept = written(kept, f"{scratch(docs.sparkSession)}/kept")
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).isNull().alias("k0"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k1"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k2"),
    )
    keys = ["k0", "k1", "k2"]
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).select("row.*")
