"""Helpers of the corpus operators."""

from __future__ import annotations

import atexit
import gc
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netkpi.sources.staging import shared_folder

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
_fallback: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder of the cluster; it goes when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or _fallback.setdefault(app, shared_folder(spark))
    folder = f"{root}/llm-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(conf)
    system.mkdirs(path)

    def drop() -> None:
        try:
            system.delete(path, True)
        except Exception:  # the session's JVM has gone before
            pass

    atexit.register(drop)
    return folder


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table once and read it from there: cuts the lineage and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package also where only the driver's ``sys.path`` has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *paths])


class Kept(dict):
    """What ``make`` gives for a key, remembered for a bounded number of keys.

    When ``most`` keys are held, they become the old ones, of which those stay that are asked for
    again before as many new ones have come. Long texts are not kept.
    """

    def __init__(self, make, most: int = 400_000, longest: int = 60):
        self.make, self.most, self.longest = make, most, longest
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if isinstance(key, (str, bytes)) and len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}


#: Operators that remember things in this Python worker, and how they forget them.
_remembered: dict[str, Callable[[], None]] = {}


def remembers(operator: str, forget: Callable[[], None]) -> None:
    """``operator`` works in this Python worker now: others, which worked here before, forget what they hold.

    Workers are used again by later stages, so else the memory of all operators of a pipeline adds up.
    """
    others = [o for o in _remembered if o != operator]
    for other in others:
        _remembered.pop(other)()
    if others:
        gc.collect()  # encoders and what they keep refer to each other
    _remembered[operator] = forget


def _hash_of(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


#: 64-bit hashes of words, remembered per Python worker by all operators together.
word_hash = Kept(_hash_of, 200_000)


def hashes_of(words):
    """64-bit hashes of words (bytes), as an array."""
    import numpy as np

    remembers("word_hash", word_hash.forget)
    return np.fromiter(map(word_hash.__getitem__, words), np.uint64, len(words))


def lowered(text: bytes) -> bytes:
    """A-Z in lower case, all else as it is."""
    return text.translate(_LOWER_BYTES)
