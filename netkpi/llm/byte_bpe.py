"""Byte-level BPE encoding and decoding by prefix dynamic programming.

BPE gives every byte prefix of a piece exactly one token sequence, so a prefix has one valid last
token, and the encoding of a piece is read back from the table of these last tokens. A token may
end a prefix if it fits to the last token of the prefix before it, that is if BPE, applied to the
bytes of the two, gives these two again. An append extends the table; an edit recomputes it from
the edited place until it agrees with the old one again. Short pieces share one table, whose
entries hold all tokens of a prefix and are made when a longer prefix asks for them.

Documents are encoded where they are, without a shuffle; what a task holds is one Arrow batch and
caches of a fixed number of entries. The rank file is read by each Python worker from ``path``.

Defined cases: a null or empty text has no ids and decodes to no bytes. Special tokens are ordinary
text. Rows, their order and all columns (in the struct ``row``, unless ``keep`` names some) stay as they are, repeated ones too.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from netkpi.llm.common import Kept, remembers, workers_import

#: Bytes of the longest piece that uses the shared table of prefixes; longer ones have a table of their own.
LONGEST_SHARED = 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixEncoder:
    """Encoder and decoder for ranks and a pattern that cuts text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        import regex

        self.ranks = ranks
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.id_texts = [str(i) for i in range(len(self.token_bytes))]
        self.longest = max(map(len, ranks))
        #: Bytes of the longest token that ends in these three.
        self._longest_with_end: dict[bytes, int] = {}
        for token in ranks:
            if len(token) > self._longest_with_end.get(token[-3:], 2):
                self._longest_with_end[token[-3:]] = len(token)
        self._pieces = regex.compile(pattern).findall
        self._splits_at_blanks = pattern == public_tokenizers.PATTERN
        self._alone = Kept(lambda t: self.merged(self.token_bytes[t]) == [t])
        self._fits = Kept(self._check_pair, 250_000)
        self._of_prefix = Kept(self._encode_prefix, 50_000)
        self._of_piece = Kept(self._encode_piece, 25_000)
        self._of_chunk = Kept(self._encode_chunk, 25_000)
        self._of_word = Kept(self._encode_word, 150_000)

    # --- single pieces ---

    def merged(self, piece: bytes) -> list[int]:
        """Plain BPE: the pair of lowest rank merges first, from the left. Only for short bytes."""
        get, none = self.ranks.get, len(self.token_bytes)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            rank = min(ranks)
            if rank == none:
                break
            at = ranks.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], none)
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], none)
        return [self.ranks[p] for p in parts]

    def _check_pair(self, pair: int) -> bool:
        left, right = divmod(pair, len(self.token_bytes))
        return self.merged(self.token_bytes[left] + self.token_bytes[right]) == [left, right]

    def extend(self, piece: bytes, last: list[int], until: int | None = None) -> None:
        """Append the last tokens of the prefixes longer than the table ``last`` covers."""
        get, fits, size, longest = self.ranks.get, self._fits, len(self.token_bytes), self.longest
        for end in range(len(last), (len(piece) if until is None else until) + 1):
            for start in range(max(0, end - longest), end):
                token = get(piece[start:end])
                if token is not None and (fits[last[start] * size + token] if start else self._alone[token]):
                    last.append(token)
                    break

    def read_back(self, last: list[int]) -> list[int]:
        ids, end = [], len(last) - 1
        while end:
            ids.append(last[end])
            end -= len(self.token_bytes[last[end]])
        return ids[::-1]

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        if len(data) > LONGEST_SHARED:
            last = [0]
            self.extend(data, last)
            return tuple(self.read_back(last))
        return self._encode_prefix(data)

    def _encode_prefix(self, data: bytes) -> tuple[int, ...]:
        """Short bytes: the shorter prefix that the last token leaves is asked for in the shared table."""
        get, fits, of_prefix, size = self.ranks.get, self._fits, self._of_prefix, len(self.token_bytes)
        whole = get(data)
        if whole is not None and self._alone[whole]:
            return (whole,)
        for start in range(max(1, len(data) - self._longest_with_end.get(data[-3:], 2)), len(data)):
            token = get(data[start:])
            if token is not None:
                before = of_prefix[data[:start]]
                if fits[before[-1] * size + token]:
                    return (*before, token)
        raise ValueError(f"no tokens for {data!r}")

    # --- texts ---

    def _encode_word(self, word: str) -> tuple[int, ...]:
        """A word after a blank."""
        if word.isalpha():
            return self._encode_piece(" " + word)
        if word.endswith(_SIGNS) and word[:-1].isalpha():
            return self._of_word[word[:-1]] + self._of_piece[word[-1]]
        return self._encode_chunk(" " + word)

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        if chunk.isalpha():
            return self._encode_piece(chunk)
        pieces = self._pieces(chunk)
        if len(pieces) == 1:
            return self._of_piece[pieces[0]]
        return tuple(i for piece in pieces for i in self._of_piece[piece])

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not self._splits_at_blanks:
            return list(self._encode_chunk(text))
        # No match of the pattern reaches over the place before a blank that text follows.
        if _SPACE_AT_SPACE.search(text):
            parts = text.split(" ")
            chunks = parts[:1]
            for part in parts[1:]:
                if part and not part[0].isspace():
                    chunks.append(" " + part)
                else:
                    chunks[-1] += " " + part
            ids: list[int] = []
            for chunk in chunks:
                ids += self._of_chunk[chunk]
            return ids
        # A line feed between other characters is a match of its own.
        ids, of_word, of_chunk, feed = [], self._of_word, self._of_chunk, self._of_piece["\n"]
        for nth, line in enumerate(text.split("\n")):
            if nth:
                ids += feed
            parts = line.split(" ")
            ids += of_chunk[parts[0]]
            for part in parts[1:]:
                ids += of_word[part]
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


#: Signs that are a piece of their own after a word, if only a blank follows.
_SIGNS = tuple(".,;:!?")
#: A blank or a line feed beside other white space, or a blank at the end.
_SPACE_AT_SPACE = re.compile(r"[ \n]\s|\s\n| \Z")


class EncodedPiece:
    """A piece that can be appended to and edited without encoding it anew."""

    def __init__(self, encoder: PrefixEncoder, piece: bytes = b""):
        self.encoder, self.piece, self.last = encoder, b"", [0]
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.encoder.extend(self.piece, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in the place of the bytes from start to end; how many prefixes were computed."""
        old, shift = self.last, len(new) - (end - start)
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last = old[: start + 1]
        same, step = 0, self.encoder.longest
        for at in range(start + 1, len(self.piece) + 1):
            self.encoder.extend(self.piece, self.last, at)
            behind = at > start + len(new)
            same = same + 1 if behind and at - shift > 0 and old[at - shift] == self.last[at] else 0
            if same == step:  # all later prefixes depend on these and on bytes that stayed
                self.last += old[at - shift + 1 :]
                return at - start
        return len(self.piece) - start

    def ids(self) -> list[int]:
        return self.encoder.read_back(self.last)


_encoders: dict[tuple[str, str], PrefixEncoder] = {}


def encoder_of(path: str, pattern: str) -> PrefixEncoder:
    """One encoder per Python worker, with its caches."""
    remembers("byte_bpe", _encoders.clear)
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = PrefixEncoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


def _mapped(
    docs: DataFrame, text_col: str, fields: list[StructField], arrays: Callable, keep: Sequence[str] = ("*",)
) -> DataFrame:
    """``row`` with the columns that ``arrays(texts)`` makes for a batch."""
    workers_import(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = arrays(pa, (x.as_py() for x in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["row", *(f.name for f in fields)])

    return rows.mapInArrow(run, StructType([rows.schema["row"], *fields]))


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text") -> DataFrame:
    """``row`` and ``ids``, the token ids of the whole text."""

    def arrays(pa, texts):
        encoder = encoder_of(path, pattern)
        return [pa.array([encoder.encode(t) for t in texts], pa.list_(pa.int32()))]

    return _mapped(docs, text_col, [StructField("ids", ArrayType(IntegerType()))], arrays)


def decode(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``row`` and ``data``, the bytes of ``ids``."""
    workers_import(encoded.sparkSession)
    schema = StructType([encoded.schema["row"], StructField("data", BinaryType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = encoder_of(path, pattern)
        for batch in batches:
            data = pa.array([encoder.decode(ids.as_py() or ()) for ids in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), data], names=["row", "data"])

    return encoded.select("row", "ids").mapInArrow(run, schema)


def digests(
    docs: DataFrame,
    path: str,
    pattern: str = public_tokenizers.PATTERN,
    text_col: str = "text",
    keep: Sequence[str] = ("*",),
) -> DataFrame:
    """``row``, ``n_tokens`` and SHA-256 of the ids (decimal, one blank between) and of the decoded bytes.

    Encodes and decodes in one pass, so that the ids never leave the task. ``row`` has the columns
    ``keep``: without the text, this goes to the Python worker once and not back.
    """

    def arrays(pa, texts):
        encoder = encoder_of(path, pattern)
        counts, of_ids, of_bytes = [], [], []
        for text in texts:
            ids = encoder.encode(text)
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(" ".join(map(encoder.id_texts.__getitem__, ids)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]

    fields = [
        StructField("n_tokens", LongType()),
        StructField("ids_sha256", StringType()),
        StructField("decoded_sha256", StringType()),
    ]
    return _mapped(docs, text_col, fields, arrays, keep)
