"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: ASCII white space: space, and \t \n \x0b \x0c \r.  bytes.split() splits on just these.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a character class for Java, RE2 and Python patterns.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: For bytes.translate(): A-Z in lower case, the rest as it is.
LOWER_ASCII = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())

_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset a
    local session gets a temporary folder; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        found = _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="quillon-"))
    return found.rstrip("/")


#: Folders that this driver has made; they go when it ends.
_made: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """A name in the shared folder for tables and files that last as long as the driver."""
    _made.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def drop_folder(uri: str) -> None:
    with contextlib.suppress(OSError, ValueError):
        fs, path = file_system(uri)
        fs.delete_dir(path)


@atexit.register
def _drop_folders() -> None:
    for uri in _made:
        drop_folder(uri)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here, and what
    follows survives the loss of executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def trimmed(run):
    """``run`` for mapInArrow(); when a task ends, its worker, which lives on, gives unused memory back to the system."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def trim() -> None:
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def file_system(uri: str):
    """A pyarrow file system for ``uri`` and the path in it; works on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
