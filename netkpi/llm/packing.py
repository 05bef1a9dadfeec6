"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document is its token ids and an end id. Its whole windows are cut off and stand alone; what
remains, less than a window, is cut into pieces of at most ``grain`` ids, which share windows with
pieces of other documents. The pieces of a batch of documents are dealt to m windows by differencing: every
piece starts as a partial partition of its own, a descending list of window sums. The two partial
partitions of the largest imbalance (largest less smallest sum) are merged, the largest sums of one
with the smallest of the other, until one is left: its windows are nearly equal. m starts at the
least number that can hold the ids and rises whenever a window passes the capacity, by as much as
the imbalance asks for, by one at least. What is left unfilled is therefore about the imbalance per window, some tenths of a per cent of all ids.

No shuffle: each task reads its rows once, as a stream, and packs ``batch_docs`` documents at a
time, so that nothing grows with the table, a source or an id. Of a document that waits in a
batch less than a window of ids is held. Windows are numbered over all tasks from the number of windows per task.

Defined cases: a null or empty text has only the end id. A null id is kept. Rows that repeat an id
or a text are documents of their own. Only id and text are read, so other columns cannot clash. An
empty table gives no pieces. The last window of a batch is as full as the others; a short table has
short windows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netkpi.llm.common import Kept, remembers, scratch, workers_import, written
from netkpi.llm.token_files import BYTE_LETTERS

#: Documents packed together, and ids per piece of what remains after whole windows.
BATCH_DOCS, GRAIN = 1024, 256
#: Code points of a text that are cut into pieces at a time, about.
_SEGMENT = 1 << 18
#: Rows per batch that a task gives out.
_ROWS_OUT = 4096


# --- token ids ----------------------------------------------------------------

# Characters whose class does not depend on the version of Unicode: ASCII, letters of Latin-1.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGNS = "!-/:-@\\[-`{-~"
_PLAIN = re.compile(f"[\t-\r {_SIGNS}0-9{_LETTERS}]*").fullmatch
#: A blank after a plain sign or letter: no piece of the tokenizer reaches over such a place.
_CUT = re.compile(f"(?<=[{_SIGNS}0-9{_LETTERS}])(?=[\t-\r ])")
# The pieces of byte-level BPE, for plain characters.
_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
).findall
_BLANK = " ".translate(BYTE_LETTERS)


class ByteIds:
    """Ids of texts by a byte-level BPE file of the tokenizers library, without its special tokens around.

    Strings of added tokens become their ids, as the library does by default. Pieces of plain text between them are
    cut out here as the library's pre-tokenizer does, encoded once by the library's model and kept. Parts
    with other characters go through the library whole.
    """

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        longest_first = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.around_added = re.compile(f"({'|'.join(longest_first) or '(?!)'})").split
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.tokenize = self.tokenizer.model.tokenize
        self.known = Kept(self._piece)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # these stand for themselves, but for the blank
            letters = piece.replace(" ", _BLANK)
        else:
            letters = (piece if piece.isascii() else piece.encode().decode("latin-1")).translate(BYTE_LETTERS)
        return array(self.code, [t.id for t in self.tokenize(letters)]).tobytes()

    def _encoded(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _segments(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > _SEGMENT and (found := _CUT.search(text, at + _SEGMENT)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def _parts(self, text: str) -> Iterator[bytes]:
        for segment in self._segments(text):
            for part in [segment] if _PLAIN(segment) else _CUT.split(segment):
                if _PLAIN(part):
                    yield b"".join([self.known[p] for p in _PIECES(part)])
                else:
                    yield self._encoded(part)

    def of(self, text: str | None):
        import numpy as np

        found = []
        for nth, part in enumerate(self.around_added(text or "")):
            if nth % 2:
                found.append(np.array([self.added[part]], self.dtype).tobytes())
            else:
                found.extend(self._parts(part))
        return np.frombuffer(b"".join(found), self.dtype)


_encoders: dict[str, ByteIds] = {}


def byte_ids(path: str) -> ByteIds:
    """One encoder per Python worker, with what it remembers."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    remembers("packing", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = ByteIds(path)
    return _encoders[path]


# --- differencing -------------------------------------------------------------


def difference(sizes, n_windows: int):
    """Sums of ``n_windows`` windows, descending, and the numbers of the items in each."""
    import numpy as np

    if not len(sizes):
        return np.zeros(0, np.int64), []
    partial = {i: (np.array([sizes[i]]), [[i]]) for i in range(len(sizes))}
    # the largest imbalance first; an empty window is a sum of 0 that is not written down
    heap = [(-int(s) if n_windows > 1 else 0, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    for made in range(len(sizes), 2 * len(sizes) - 1):
        sums, held = partial.pop(heapq.heappop(heap)[1])
        others, more = partial.pop(heapq.heappop(heap)[1])
        meet = max(len(sums) + len(others) - n_windows, 0)
        alone, single = len(sums) - meet, len(others) - meet
        sums = np.concatenate([sums[:alone], sums[alone:] + others[single:][::-1], others[:single]])
        held = [*held[:alone], *(a + b for a, b in zip(held[alone:], reversed(more[single:]), strict=True)), *more[:single]]
        order = np.argsort(-sums, kind="stable")
        sums, held = sums[order], [held[i] for i in order]
        smallest = int(sums[-1]) if len(sums) == n_windows else 0
        partial[made] = sums, held
        heapq.heappush(heap, (smallest - int(sums[0]), made))
    return next(iter(partial.values()))


def balanced_windows(sizes, capacity: int) -> list[list[int]]:
    """Items in nearly equal windows of at most ``capacity``; no item is larger than that."""
    import numpy as np

    sizes = np.asarray(sizes, np.int64)
    total = int(sizes.sum())
    n = -(-total // capacity)
    while True:
        sums, held = difference(sizes, n)
        if not len(sums) or sums[0] <= capacity:
            return held
        over = int(sums[0]) - total / n  # how far the fullest window is above the mean
        n = max(n + 1, int(-(-total // (capacity - over))) if over < capacity else 0)


# --- packing ------------------------------------------------------------------


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 0,
    grain: int = GRAIN,
    batch_docs: int = BATCH_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (ids of its document before it), ``length``, ``ids`` or,
    with ``digest``, ``ids_crc32`` (of unsigned 32-bit little-endian integers), ``doc_tokens`` (with the end id), ``sequence_id``
    (from 0, without gaps) and ``offset`` (in the sequence, without gaps)."""
    if not 0 < grain <= capacity:
        raise ValueError("grain must be between 1 and the capacity")
    spark = docs.sparkSession
    workers_import(spark)
    made = "ids_crc32 long" if digest else "ids array<long>"
    names = ["doc_id", "start", "length", made.split()[0], "doc_tokens", "part", "nth", "offset"]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, task = byte_ids(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], encoder.dtype)
        types = [pa.int64()] * 3 + [pa.int64() if digest else pa.list_(pa.int64())] + [pa.int64()] * 4
        n_windows, rows, waiting = 0, [], []

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        def value(ids):
            return zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int64)

        def deal() -> None:
            nonlocal n_windows
            pieces = [
                (doc_id, start + at, ids[at : at + grain], total)
                for doc_id, start, ids, total in waiting
                for at in range(0, len(ids), grain)
            ]
            waiting.clear()
            for window in balanced_windows([len(p[2]) for p in pieces], capacity):
                offset = 0
                for i in sorted(window):
                    doc_id, start, ids, total = pieces[i]
                    rows.append((doc_id, start, len(ids), value(ids), total, task, n_windows, offset))
                    offset += len(ids)
                n_windows += 1

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encoder.of(text.as_py()), end])
                whole = len(ids) // capacity * capacity
                for at in range(0, whole, capacity):
                    rows.append((doc_id, at, capacity, value(ids[at : at + capacity]), len(ids), task, n_windows, 0))
                    n_windows += 1
                    if len(rows) >= _ROWS_OUT:
                        yield out()
                if whole < len(ids):
                    waiting.append((doc_id, whole, ids[whole:].copy(), len(ids)))
                if len(waiting) >= batch_docs:
                    deal()
                if len(rows) >= _ROWS_OUT:
                    yield out()
        deal()
        if rows:
            yield out()

    schema = f"doc_id long, start long, length long, {made}, doc_tokens long, part long, nth long, offset long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = written(rows.mapInArrow(run, schema), f"{scratch(spark)}/pieces")
    # the window runs over one row per task
    earlier = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy(F.col("part").alias("of")).agg((F.max("nth") + 1).alias("n"))
    before = counts.select("of", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return pieces.join(before, F.col("part") == F.col("of")).select(
        "doc_id", "start", "length", names[3], "doc_tokens", (F.col("before") + F.col("nth")).alias("sequence_id"), "offset"
    )
