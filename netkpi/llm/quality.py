"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into ``buckets`` features. Two multinomials are counted: raw over
all documents, trusted over the documents that labels call good. A document's score is the sum of
log(p_trusted / p_raw) over its features, divided by their number; it is kept if the score reaches
a threshold. The trusted documents and those the threshold is set on are a sample of the labelled
rows of at most ``max_labelled`` per label, the same for every run (by hash of the id); all
counts of the raw corpus and all scores cover every document.

Half of the trusted sample is counted, the other half and the bad sample set the threshold: a
document's own words raise its score, and those of documents without a label are not counted as
trusted. Of the values that turn away at most ``max_lost`` of the held-out trusted documents, the
threshold is the one that turns away most bad ones beyond what it loses of the others. Without
trusted or without bad labels nothing can be set, and the method keeps all.

Counting is one pass without a shuffle of texts: each task returns one row per feature it has
seen, and these are summed. The feature table has a fixed size, whatever the input. Log ratios are
rounded to integers, so that scores do not depend on the order of additions.

Words, lines and windows of words are compared by 64-bit hashes or as they are. Defined cases: a
null or empty text has no words and fails the base rules. A row without id is counted and scored,
but is never in a sample. Rows that repeat an id get the same label. Labels that contradict each
other count as bad. The input's columns travel in a struct, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from netkpi.llm.common import hashes_of, workers_import

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Characters of text that a task takes apart at once (a longer text is taken whole).
PORTION = 1_000_000
#: Log ratios are stored as integers of this unit.
UNIT = 1 << 20

_BLANKS = b" \t\n\x0b\x0c\r"
_ODD = 0x9E3779B97F4A7C15


@dataclass
class Portion:
    """Some texts as one array of word hashes; ``starts`` has the first word of each and the end."""

    texts: list[bytes]
    hashes: object
    starts: object


def portions(texts: Iterator[str | None]) -> Iterator[Portion]:
    import numpy as np

    held: list[bytes] = []
    size = 0

    def portion() -> Portion:
        words = [t.split() for t in held]  # bytes split at exactly the six blanks
        starts = np.zeros(len(held) + 1, np.int64)
        np.cumsum([len(w) for w in words], out=starts[1:])
        return Portion(held, hashes_of([w for ws in words for w in ws]), starts)

    for text in texts:
        held.append((text or "").encode())
        size += len(held[-1])
        if size >= PORTION:
            yield portion()
            held, size = [], 0
    if held:
        yield portion()


def _document_of(p: Portion):
    import numpy as np

    return np.repeat(np.arange(len(p.texts)), np.diff(p.starts))


def features(p: Portion, buckets: int):
    """Feature numbers and the document of each: all words, then all pairs inside documents."""
    import numpy as np

    h, doc = p.hashes, _document_of(p)
    pairs = (h[:-1] * np.uint64(_ODD)) ^ h[1:]
    pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    inside = doc[:-1] == doc[1:]
    found = np.concatenate([h, (pairs >> np.uint64(7))[inside]]) % np.uint64(buckets)
    return found.astype(np.int64), np.concatenate([doc, doc[1:][inside]])


def repeated_words(p: Portion):
    """Per text: words that lie in a window of ``WINDOW`` words which the text has twice or more."""
    import numpy as np

    n, counts = len(p.hashes), np.zeros(len(p.texts), np.int64)
    if n < WINDOW:
        return counts
    doc = _document_of(p)
    at = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    key = doc[at].astype(np.uint64) + np.uint64(1)
    for j in range(WINDOW):
        key = (key ^ p.hashes[at + j]) * np.uint64(_ODD)
        key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    first = at[order[twice]]
    edges = np.bincount(first, minlength=n + 1) - np.bincount(first + WINDOW, minlength=n + 1)
    return np.bincount(doc[np.cumsum(edges[:-1]) > 0], minlength=len(p.texts)).astype(np.int64)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) == 1 or len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def base_counts(p: Portion) -> dict:
    """The base columns of a portion's texts, as arrays."""
    import numpy as np

    def count(one):
        return np.array([one(t) for t in p.texts], np.int64)

    n_words, n_repeat = np.diff(p.starts), repeated_words(p)
    return {
        "n_words": n_words,
        # UTF-8 continues a code point with bytes 80 to BF; the rest, without blanks, starts one
        "word_chars": count(lambda t: len(t.translate(None, _NO_CHARS))),
        "n_symbols": count(lambda t: len(t) - len(t.translate(None, SYMBOLS))),
        "n_dup_lines": count(repeated_lines),
        "n_repeat_words": n_repeat,
        "base_failed": (n_words < 20) | (100 * n_repeat > 30 * n_words),
    }


_NO_CHARS = _BLANKS + bytes(range(0x80, 0xC0))


# --- fitting ------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Integer log ratios per feature and the least score of kept documents (None: keep all)."""

    ratios: object
    threshold: float | None


def held_out(doc_id: Column) -> Column:
    """Half of the ids, by hash."""
    return F.pmod(F.xxhash64(F.lit("held out"), doc_id), F.lit(2)) == 1


def _sample(labels: DataFrame, max_labelled: int) -> DataFrame:
    """At most ``max_labelled`` ids of good and as many of bad documents: ``id``, ``good``, ``held_out``."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
    one = one.agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))

    def some(which: str, good: bool) -> DataFrame:
        ids = one.where(which).select(F.col("doc_id").alias("id")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
        return ids.withColumn("good", F.lit(good)).withColumn("held_out", held_out(F.col("id")) | F.lit(not good))

    return some("quality = 1 AND toxic = 0", True).unionByName(some("quality = 0", False))


def _scores(p: Portion, ratios):
    """Sum of log ratios and number of features per text."""
    import numpy as np

    found, doc = features(p, len(ratios))
    order = np.argsort(doc, kind="stable")
    n = np.bincount(doc, minlength=len(p.texts))
    running = np.concatenate([[0], np.cumsum(ratios[found[order]])])
    ends = np.cumsum(n)
    sums = running[ends] - running[ends - n]
    return sums / np.maximum(n, 1) / UNIT


def fit(docs: DataFrame, labels: DataFrame, buckets: int, max_labelled: int, max_lost: float) -> Model:
    """``docs`` has ``id`` and ``text``."""
    import numpy as np

    sample = _sample(labels, max_labelled)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        raw, trusted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = np.array([x is True for x in batch.column(1).to_pylist()], bool)
            done = 0
            for p in portions(x.as_py() for x in batch.column(0)):
                found, doc = features(p, buckets)
                raw += np.bincount(found, minlength=buckets)
                of_good = good[done : done + len(p.texts)]
                if of_good.any():
                    trusted += np.bincount(found[of_good[doc]], minlength=buckets)
                done += len(p.texts)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(raw[seen]), pa.array(trusted[seen])], names=["feature", "raw", "trusted"]
        )

    counted = F.broadcast(sample.where("NOT held_out").select("id", "good"))
    labelled = docs.join(counted, "id", "left").select("text", "good")
    counts = labelled.mapInArrow(count, "feature long, raw long, trusted long")
    table = counts.groupBy("feature").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas()
    raw, trusted = np.zeros(buckets), np.zeros(buckets)
    raw[table["feature"]], trusted[table["feature"]] = table["raw"], table["trusted"]
    if not trusted.any():
        return Model(np.zeros(buckets, np.int64), None)
    logs = [math.log((a + 1) / (trusted.sum() + buckets)) - math.log((b + 1) / (raw.sum() + buckets)) for a, b in zip(trusted, raw)]
    ratios = np.rint(np.array(logs) * UNIT).astype(np.int64)
    calibrating = F.broadcast(sample.where("held_out").select("id", "good"))
    found = _score_rows(docs.join(calibrating, "id").select("good", "text"), ratios).collect()
    return Model(ratios, _threshold([r.score for r in found if r.good], [r.score for r in found if not r.good], max_lost))


def _score_rows(labelled: DataFrame, ratios) -> DataFrame:
    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            made = [_scores(p, ratios) for p in portions(x.as_py() for x in batch.column(1))]
            scores = np.concatenate(made) if made else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["good", "score"])

    return labelled.mapInArrow(score, "good boolean, score double")


def _threshold(good: list[float], bad: list[float], max_lost: float) -> float | None:
    import numpy as np

    if not good or not bad:
        return None
    good, bad = np.sort(good), np.sort(bad)
    # between two neighbouring scores any value does the same; one near the lower spares good documents
    scores = np.unique(np.concatenate([good, bad]))
    values = np.concatenate([scores[:1], scores[:-1] + (scores[1:] - scores[:-1]) / 4])
    lost = np.searchsorted(good, values) / len(good)
    caught = np.searchsorted(bad, values) / len(bad)
    gain = np.where(lost <= max_lost, caught - lost, -1.0)
    return float(values[np.argmax(gain)])


# --- applying -----------------------------------------------------------------


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = 1 << 16,
    max_labelled: int = 20_000,
    max_lost: float = 0.002,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``row`` (struct of the input's columns), the base columns, ``score`` and ``kept``.

    ``labels`` has ``doc_id``, ``quality`` and ``toxic``.
    """
    workers_import(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = fit(plain, labels, buckets, max_labelled, max_lost)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [StructField(c, LongType()) for c in counts]
    fields += [StructField("base_failed", BooleanType()), StructField("score", DoubleType()), StructField("kept", BooleanType())]

    def judge(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            made = []
            for p in portions(x.as_py() for x in batch.column(1)):
                columns = base_counts(p)
                columns["score"] = _scores(p, model.ratios)
                fits = columns["score"] >= model.threshold if model.threshold is not None else True
                columns["kept"] = ~columns["base_failed"] & fits
                made.append(columns)
            if made:
                arrays = [pa.array(np.concatenate([m[f.name] for m in made])) for f in fields]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["row", *(f.name for f in fields)])

    return rows.mapInArrow(judge, StructType([rows.schema["row"], *fields]))
