"""Shared helpers of the training-data operators.

Scratch tables go to the folder named by ``spark.checkpoint.dir`` so that every
executor can read them and a lost executor loses nothing.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataflow.sources.tables import discard, materialize, scratch_path
from strataflow.sources.tables import read as table

__all__ = ["discard", "materialize", "scratch_path", "table"]

#: ASCII white space: the bytes 0x20 and 0x09 to 0x0D (fixed values of the contracts).
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def ascii_strip(col):
    return F.btrim(col, F.lit(ASCII_SPACE))


_held: list = []


def held(cached):
    """Register an ``lru_cache`` function whose results a worker keeps between tasks."""
    _held.append(cached)
    return cached


def free_others(mine=None) -> None:
    """Forget what other operators keep in this worker: a worker serves them all in turn."""
    full = [c for c in _held if c is not mine and c.cache_info().currsize]
    for c in full:
        c.cache_clear()
    if full:
        gc.collect()


def give_back() -> None:
    """Return freed memory to the system: an idle worker else holds what its largest batch took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not a GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def lean(run, mine=None):
    """``run`` for ``mapInArrow``: it starts without what other operators kept (but for ``mine``) and leaves no free memory behind."""

    def whole(batches):
        free_others(mine)
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Plans that run inside hand ``rows`` rows at once to Python: less memory where rows are wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on a uint64 array (wraps modulo 2**64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
