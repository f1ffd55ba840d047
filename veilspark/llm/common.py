"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of one Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
#: Most characters of text that one step of a Python operator holds at once (one longer text is a step of its own).
STEP_CHARS = 2 << 20
#: About the bytes that a dict entry, a short string and a small object take, beside the characters of the string.
ENTRY_BYTES = 200

_SLOT: list = [None, None]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by rows and bytes, so very long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where it is unset, one of our own if there is a single machine, else an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    return f"file://{tempfile.gettempdir()}/veilspark-shared"


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes a table into the shared folder and reads it again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker keeps from one task to the next: a single thing, so that operators which share a worker don't add up. Another key's goes first."""
    if _SLOT[0] != key:
        _SLOT[:] = [None, None]
        trim()
        _SLOT[:] = [key, make()]
    return _SLOT[1]


def trim() -> None:
    """Gives memory that is free within this process back to the system, as far as its allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Generations(dict):
    """A cache of strings bounded in bytes: once the young half is full, it becomes the old one, and what is asked for again moves back."""

    def __init__(self, most_bytes: int, entry: int = ENTRY_BYTES, per_character: int = 1):
        super().__init__()
        self._most, self._entry, self._per_character, self._bytes, self._old = most_bytes // 2, entry, per_character, 0, {}

    def absent(self, keys: Iterable) -> list:
        """The keys that neither half holds, to be put next; all others are in the young half afterwards. Halves change in this call only."""
        if self._bytes > self._most:
            self._old, self._bytes = dict(self), 0
            self.clear()
        out, old = [], self._old
        for k in keys:
            if k not in self:
                if (found := old.get(k)) is None:
                    out.append(k)
                else:
                    self.put(k, found)
        return out

    def put(self, key: str | bytes, value: Any) -> None:
        self[key] = value
        self._bytes += self._entry + len(key) * self._per_character


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow by record batch."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (out := function(batch)) is not None:
                yield out
        trim()

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_class(id_col: str, parts: int):
    """crc32 of the id as text, modulo parts (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts
