"""Fill-in-the-middle: texts rearranged around a missing middle, by rotations of blocks in place.

A text is cut after two of its tokens into prefix, middle and suffix. Cuts and form come from a
hash of the id, so reruns agree. The UTF-8 bytes of the text stand in one bytearray: a scan
for the ends of tokens gives the cuts, sentinels are inserted there, and blocks change places by
rotation, which is three reversals (each block, then both together). Forms:

- ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
- ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
- ``plain``: the text as it is

``restore`` undoes it: it finds the sentinels, rotates the blocks back (a rotation by the other
block is the inverse) and deletes the sentinels. Since a text that holds a sentinel stays plain, each of them is
found once, and the bytes are those of the text exactly.

No shuffle. Rows go through as a stream; beside the row at hand a task holds one batch, and gives out results of a
bounded size at a time. Reversals swap bounded blocks, so that a long text is held once.

Defined cases: a null or empty text is plain, with an empty output. A null id is hashed as an empty one. Rows that repeat an
id are cut alike, each by its own text. A text of white space is one token. The input's columns
travel in a struct, so their names cannot clash. An empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from netkpi.llm.common import SPACE, workers_import

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes swapped at a time in a reversal, and bytes of texts per batch given out.
_SWAPPED, _BYTES_OUT = 1 << 16, 1 << 23
_SPACES = bytes(c in SPACE.encode() for c in range(256))


def reverse(block: bytearray, start: int, end: int) -> None:
    """Reverse the bytes from ``start`` to ``end`` in place."""
    while end - start > 1:
        n = min(_SWAPPED, (end - start) // 2)
        left, right = block[start : start + n], block[end - n : end]
        left.reverse()
        right.reverse()
        block[start : start + n], block[end - n : end] = right, left
        start, end = start + n, end - n


def rotate(block: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange the neighbours ``start`` to ``cut`` and ``cut`` to ``end`` in place."""
    reverse(block, start, cut)
    reverse(block, cut, end)
    reverse(block, start, end)


def token_ends(text: bytes):
    """Where each token ends: white space with the word after it, or white space at the end of the text."""
    import numpy as np

    if not text:
        return np.zeros(0, np.int64)
    blank = np.frombuffer(text.translate(_SPACES), np.bool_)
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    return np.append(ends, len(text))


def choices(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers that decide on cuts and form."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in range(0, 32, 8)]


def n_chars(data: bytes | bytearray) -> int:
    """Code points of UTF-8 bytes: all bytes but the continuing ones."""
    import numpy as np

    return int((np.frombuffer(bytes(data), np.uint8) & 0xC0 != 0x80).sum())


def transformed(
    text: bytes, doc_id: int | None, seed: int, plain_percent: int, spm_percent: int
) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of tokens, form, code points of prefix and middle, and the output."""
    ends = token_ends(text)
    first, second, apart, which = choices(doc_id, seed)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or apart % 100 >= 100 - plain_percent:
        return len(ends), "plain", None, None, text
    a, b = sorted((first % (len(ends) + 1), second % (len(ends) + 1)))
    a, b = (int(ends[n - 1]) if n else 0 for n in (a, b))
    prefix_chars, middle_chars = n_chars(text[:a]), n_chars(text[a:b])
    block = bytearray(text)
    # from the last place on, so that the places before stay where they are
    for at, sentinel in ((b, SUFFIX), (a, MIDDLE), (0, PREFIX)):
        block[at:at] = sentinel
    middle, suffix, end = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE), len(block)
    if which % 100 < spm_percent:
        rotate(block, 0, suffix, end)
        form = "spm"
    else:
        rotate(block, middle, suffix, end)
        form = "psm"
    return len(ends), form, prefix_chars, middle_chars, bytes(block)


def restored(output: bytes, form: str) -> bytes:
    """The text that ``transformed`` made ``output`` of."""
    if form == "plain":
        return output
    block = bytearray(output)
    if form == "spm":  # suffix | prefix middle
        rotate(block, 0, block.index(PREFIX), len(block))
    elif form == "psm":  # prefix | suffix | middle
        rotate(block, block.index(SUFFIX), block.index(MIDDLE), len(block))
    else:
        raise ValueError(f"not a form: {form}")
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = block.index(sentinel)
        del block[at : at + len(sentinel)]
    return bytes(block)


def _streamed(rows: DataFrame, fields: list[StructField], make) -> DataFrame:
    """``row`` and the columns that ``make`` gives for the other values of a row, in batches of a bounded size."""
    workers_import(rows.sparkSession)
    names = ["row", *(f.name for f in fields)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in fields]

        def out(batch, since: int, made: list):
            columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0).slice(since, len(made)), *columns], names=names)

        for batch in batches:
            since, made, size = 0, [], 0
            for values in zip(*batch.columns[1:], strict=True):
                made.append(make(*(v.as_py() for v in values)))
                size += sum(len(v) for v in made[-1] if isinstance(v, bytes))
                if size >= _BYTES_OUT:
                    yield out(batch, since, made)
                    since, made, size = since + len(made), [], 0
            if made:
                yield out(batch, since, made)

    return rows.mapInArrow(run, StructType([rows.schema["row"], *fields]))


def fill_in_middle(
    docs: DataFrame,
    seed: int = 42,
    plain_percent: int = 50,
    spm_percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``row`` (struct of the input's columns), ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars``, ``output``."""
    fields = [
        StructField("n", LongType()),
        StructField("form", StringType()),
        StructField("prefix_chars", LongType()),
        StructField("middle_chars", LongType()),
        StructField("output", StringType()),
    ]
    rows = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
        F.col(id_col).cast("long").alias("id"),
    )
    return _streamed(rows, fields, lambda text, doc_id: transformed(text, doc_id, seed, plain_percent, spm_percent))


def restore(made: DataFrame) -> DataFrame:
    """``row`` and ``text``, rebuilt from ``output`` and ``form``."""
    rows = made.select("row", F.col("output").cast("binary").alias("output"), "form")
    return _streamed(rows, [StructField("text", StringType())], lambda output, form: (restored(output, form),))
