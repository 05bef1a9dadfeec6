"""Files of an own format in the shared folder, written and read by tasks."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator


def _at(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


@contextlib.contextmanager
def new_file(path: str) -> Iterator:
    """A binary file that appears under its name only when it is complete.

    Each attempt writes under a name of its own; an attempt that is repeated replaces the file
    with the same bytes.
    """
    system, name = _at(path)
    part = f"{name}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(part, compression=None) as out:
            yield out
    except BaseException:
        with contextlib.suppress(OSError):
            system.delete_file(part)
        raise
    system.move(part, name)


def open_file(path: str):
    """A file for reads at any place."""
    system, name = _at(path)
    return system.open_input_file(name)


def open_stream(path: str):
    """A file for reads from start to end."""
    system, name = _at(path)
    return system.open_input_stream(name, compression=None, buffer_size=1 << 20)


def make_folders(spark, *folders: str) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).mkdirs(path)


def file_paths(spark, folder: str, pattern: str):
    """A table with the path of each file; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
