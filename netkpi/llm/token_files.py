"""Token ids in binary files, with keyed access through a minimal perfect hash.

Documents are laid out by range of their id. Each range becomes a shard file: a header and the ids
of its documents, one after the other, 16 or 32 bits each. For access by key, the keys are dealt by
hash to index files of a bounded number of entries. An index file holds a minimal perfect hash of
its keys (a displacement per group of keys, in the manner of hash-and-displace) and, by slot, a
fingerprint of the key and the place of the document: shard, first id, number of ids. A look-up
computes one slot, compares one fingerprint and reads one range of one shard file.

Key: the id of a document and, where rows repeat an id, the number of the row among them (from 0).

Tasks stream: a writer holds one Arrow batch, a builder the keys of one index file, a reader one
document. All files go to the shared folder and appear complete or not at all; a task that is
repeated writes the same bytes again.

Defined cases: a null or empty text has only the end id. A null id is a key of its own, first in
order. Rows that repeat an id lie side by side, ordered by text. An empty table makes no files.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netkpi.llm.common import Kept, workers_import, written
from netkpi.llm.files import make_folders, new_file, open_file

SHARD_MAGIC, INDEX_MAGIC = b"IDSHARD1", b"IDINDEX1"
#: Magic, bytes per id.
SHARD_HEADER = "<8sQ"
#: Magic, number of keys, number of groups, salt.
INDEX_HEADER = "<8sQQQ"
#: Keys per index file and keys per group, both on average.
INDEX_KEYS, GROUP_KEYS = 65_536, 4


@dataclass(frozen=True)
class TokenFiles:
    """Where the files are, and the tables of their contents."""

    folder: str
    documents: DataFrame
    n_indexes: int


def shard_path(folder: str, number: int) -> str:
    return f"{folder}/ids/shard-{number:06d}.ids"


# --- encoding -----------------------------------------------------------------


class WordIds:
    """Ids of texts as bytes. Words between blanks or line feeds are encoded once and kept.

    The tokenizer must drop white space and must not look over it, so that the ids of a text are
    those of its parts between them. Parts of plain letters, digits and ASCII signs are cut into
    pieces here, as the tokenizer's normalizer and pre-tokenizer do, and only new pieces go to its
    model; all other parts go through the whole tokenizer. With ``added_tokens`` strings of the
    tokenizer's added tokens become their ids, as the library does by default, else they are ordinary text.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        self.has_added = re.compile("|".join(added) or r"(?!)", re.I).search
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.packed = [struct.pack("<H" if self.width == 2 else "<I", i) for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.tokenize = self.tokenizer.model.tokenize
        self.known = Kept(self._part, 50_000)
        self.pieces = Kept(self._piece, 250_000)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        return b"".join([self.packed[t.id] for t in self.tokenize(piece)])

    def _part(self, part: str) -> bytes:
        if _PLAIN(part) and not self.has_added(part):
            return b"".join([self.pieces[p] for p in _PIECES(part.lower())])
        ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return b"".join(map(self.packed.__getitem__, ids))

    def of(self, text: str | None) -> bytes:
        text = text or ""
        if _PLAIN(text) and not self.has_added(text):
            return b"".join(map(self.pieces.__getitem__, _PIECES(text.lower())))
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))


# Characters whose normal form and lower case depend on themselves alone: ASCII, letters of Latin-1.
_PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*").fullmatch
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-/:-@\\[-`{-~]+").findall
# Byte-level BPE writes printable bytes as themselves, the others from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


_tokenizers: dict[tuple[str, bool], WordIds] = {}


def _word_ids(path: str, added_tokens: bool) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = path, added_tokens
    if key not in _tokenizers:
        _tokenizers[key] = WordIds(path, added_tokens)
    return _tokenizers[key]


# --- minimal perfect hash -----------------------------------------------------


def _mix(x):
    """A mixing bijection on 64-bit integers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hashes(ids, missing, nth, salt: int):
    """64-bit hashes of keys: id (any value where missing), whether it is missing, number of the row."""
    import numpy as np

    second = _mix(nth.astype(np.uint64) * np.uint64(2) + missing.astype(np.uint64) + np.uint64(salt << 40))
    return _mix(_mix(ids.astype(np.int64).view(np.uint64)) ^ second)


class PerfectHash:
    """Slots 0..n-1 for n known keys, without storing the keys."""

    def __init__(self, n_keys: int, salt: int, displacements):
        self.n_keys, self.salt, self.displacements = n_keys, salt, displacements

    @staticmethod
    def build(ids, missing, nth) -> PerfectHash:
        import numpy as np

        salt = 0
        while True:
            hashes = key_hashes(ids, missing, nth, salt)
            if len(np.unique(hashes)) == len(hashes):
                return PerfectHash(len(ids), salt, PerfectHash._displace(hashes))
            salt += 1

    @staticmethod
    def _displace(hashes):
        """Per group a number that sends its keys to free slots; large groups choose first.

        Groups of one key take what is left: they store their slot, as -1 - slot.
        """
        import numpy as np

        n = len(hashes)
        n_groups = max(1, n // GROUP_KEYS)
        group = (hashes % np.uint64(n_groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        sizes = np.bincount(group, minlength=n_groups)
        starts = np.cumsum(sizes) - sizes
        displacements = np.zeros(n_groups, np.int64)
        free = np.ones(n, bool)
        for g in np.argsort(-sizes, kind="stable"):
            size = sizes[g]
            if size < 2:
                break
            keys = hashes[order[starts[g] : starts[g] + size]]
            first, step = 0, 32
            while True:
                tried = np.arange(first, first + step, dtype=np.uint64)
                slots = PerfectHash._slots(keys[None, :], tried[:, None], n)
                good = free[slots].all(axis=1)
                for at in np.flatnonzero(good):
                    if len(set(slots[at].tolist())) == size:
                        displacements[g] = first + at
                        free[slots[at]] = False
                        break
                else:
                    first, step = first + step, min(2 * step, 65_536)
                    continue
                break
        ones = np.flatnonzero(sizes == 1)
        displacements[ones] = -1 - np.flatnonzero(free)[: len(ones)]
        return displacements

    @staticmethod
    def _slots(hashes, displacement, n_keys: int):
        import numpy as np

        mixed = _mix(hashes ^ _mix(displacement + np.uint64(1)))
        return (mixed % np.uint64(n_keys)).astype(np.int64)

    def slots(self, hashes):
        """The slot of each hash; of keys that are not in the set, any slot."""
        import numpy as np

        found = self.displacements[(hashes % np.uint64(len(self.displacements))).astype(np.int64)]
        searched = self._slots(hashes, np.maximum(found, 0).astype(np.uint64), self.n_keys)
        return np.where(found < 0, -1 - found, searched)


def fingerprints(hashes):
    import numpy as np

    return (_mix(hashes + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype("<u4")


def _entry_type():
    import numpy as np

    return np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("start", "<u8"), ("n", "<u8")])


def _key_arrays(pdf):
    missing = pdf["doc_id"].isna().to_numpy()
    return pdf["doc_id"].fillna(0).to_numpy("int64"), missing, pdf["nth"].to_numpy("int64")


# --- writing ------------------------------------------------------------------


def _index_of(n_indexes: int):
    return F.pmod(F.xxhash64("doc_id", "nth"), F.lit(n_indexes)).cast("int")


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    added_tokens: bool = False,
) -> TokenFiles:
    """Encode all documents and write shard and index files under ``folder``."""
    workers_import(docs.sparkSession)
    make_folders(docs.sparkSession, f"{folder}/ids", f"{folder}/index")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def write(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        first = next(batches, None)
        if first is None:
            return
        encoder = _word_ids(tokenizer, added_tokens)
        end = np.array([end_id], encoder.dtype).tobytes()
        shard, start, last, nth = TaskContext.get().partitionId(), 0, object(), 0
        with new_file(shard_path(folder, shard)) as out:
            out.write(struct.pack(SHARD_HEADER, SHARD_MAGIC, encoder.width))
            while first is not None:
                rows = []
                for doc_id, text in zip(first.column(0).to_pylist(), first.column(1), strict=True):
                    ids = encoder.of(text.as_py())
                    n = len(ids) // encoder.width + 1
                    nth = nth + 1 if doc_id == last else 0
                    rows.append((doc_id, nth, shard, start, n))
                    out.write(ids)
                    out.write(end)
                    start, last = start + n, doc_id
                columns = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "nth", "shard", "start", "n"]
                )
                first = next(batches, None)

    laid_out = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    places = laid_out.mapInArrow(write, "doc_id long, nth long, shard long, start long, n long")
    places = written(places, f"{folder}/documents")
    n_indexes = max(1, -(-places.count() // INDEX_KEYS))

    def index(key, pdf):
        import numpy as np
        import pandas as pd

        ids, missing, nth = _key_arrays(pdf)
        table = PerfectHash.build(ids, missing, nth)
        hashes = key_hashes(ids, missing, nth, table.salt)
        entries = np.zeros(len(ids), _entry_type())
        slots = table.slots(hashes)
        entries["fingerprint"][slots] = fingerprints(hashes)
        for name in ("shard", "start", "n"):
            entries[name][slots] = pdf[name]
        with new_file(f"{folder}/index/index-{key[0]:06d}.mph") as out:
            out.write(struct.pack(INDEX_HEADER, INDEX_MAGIC, len(ids), len(table.displacements), table.salt))
            out.write(table.displacements.astype("<i8").tobytes())
            out.write(entries.tobytes())
        return pd.DataFrame({"index": [key[0]], "n_keys": [len(ids)]})

    indexes = places.withColumn("index", _index_of(n_indexes)).groupBy("index").applyInPandas(index, "index int, n_keys long")
    written(indexes, f"{folder}/indexes")
    return TokenFiles(folder, places, n_indexes)


# --- reading ------------------------------------------------------------------


def look_up(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """``doc_id``, ``nth``, ``shard``, ``start``, ``n`` of the keys (``doc_id``, ``nth``) that are in the index."""
    folder = files.folder

    def find(key, pdf):
        import numpy as np

        with open_file(f"{folder}/index/index-{key[0]:06d}.mph") as file:
            magic, n_keys, n_groups, salt = struct.unpack(INDEX_HEADER, file.read(struct.calcsize(INDEX_HEADER)))
            if magic != INDEX_MAGIC:
                raise ValueError(f"not an index file: {folder}, {key[0]}")
            displacements = np.frombuffer(file.read(8 * n_groups), "<i8")
            entries = np.frombuffer(file.read(n_keys * _entry_type().itemsize), _entry_type())
        hashes = key_hashes(*_key_arrays(pdf), salt)
        slots = PerfectHash(n_keys, salt, displacements).slots(hashes)
        known = entries["fingerprint"][slots] == fingerprints(hashes)
        found = pdf.loc[known, ["doc_id", "nth"]].copy()
        for name in ("shard", "start", "n"):
            found[name] = entries[name][slots[known]].astype("int64")
        return found

    keys = keys.select(F.col("doc_id").cast("long"), F.col("nth").cast("long"))
    return (
        keys.withColumn("index", _index_of(files.n_indexes))
        .groupBy("index")
        .applyInPandas(find, "doc_id long, nth long, shard long, start long, n long")
    )


def read_ids(files: TokenFiles, places: DataFrame, digest: bool = False) -> DataFrame:
    """The places with ``ids`` (unsigned 32-bit little-endian integers) or, with ``digest``, their ``ids_crc32``."""
    folder = files.folder
    names = ["doc_id", "nth", "shard", "start", "n"]
    made = "ids_crc32 long" if digest else "ids binary"

    def read(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        number, file, dtype, header = None, None, None, struct.calcsize(SHARD_HEADER)
        for batch in batches:
            values = []
            for shard, start, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if shard != number:
                    if file:
                        file.close()
                    number, file = shard, open_file(shard_path(folder, shard))
                    magic, width = struct.unpack(SHARD_HEADER, file.read_at(header, 0))
                    if magic != SHARD_MAGIC:
                        raise ValueError(f"not a shard file: {folder}, {shard}")
                    dtype = np.dtype(f"<u{width}")
                data = file.read_at(n * dtype.itemsize, header + start * dtype.itemsize)
                if len(data) != n * dtype.itemsize:
                    raise ValueError(f"shard file is too short: {folder}, {shard}")
                ids = np.frombuffer(data, dtype).astype("<u4").tobytes()
                values.append(zlib.crc32(ids) if digest else ids)
            column = pa.array(values, pa.int64() if digest else pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, column], names=[*names, "ids_crc32" if digest else "ids"]
            )
        if file:
            file.close()

    schema = f"doc_id long, nth long, shard long, start long, n long, {made}"
    near = places.select(*names).repartition("shard").sortWithinPartitions("shard", "start")
    return near.mapInArrow(read, schema)


def global_starts(files: TokenFiles) -> DataFrame:
    """``shard``, ``before``: ids in all shards before. The window runs over one row per shard file."""
    sums = files.documents.groupBy("shard").agg(F.sum("n").alias("n_ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"))
