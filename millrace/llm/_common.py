"""Shared plumbing: the cluster's shared folder, written intermediate tables, small helpers.

Lineage is cut by writing Parquet tables below the folder named in ``spark.checkpoint.dir``; a lost
executor then costs a re-read, never a re-run of what came before, and no block lives on one
machine only.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.components import Forest
from millrace.plans.shared import dropped, shared_path, shared_root, written

__all__ = ["Forest", "dropped", "shared_path", "shared_root", "written"]

#: Words are runs of anything but space and the ASCII controls 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())


BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, x in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(n, x, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


POWERS = Powers()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where lambdas in ``body`` use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Each of ``names`` with as many underscores more as it takes to be no column of ``docs``."""
    out = []
    for name in names:
        while name in docs.columns:
            name += "_"
        out.append(name)
    return out


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def native_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def batches(rows, limit_rows: int, limit_bytes: int):
    """Splits an iterator of Arrow batches further, so that Python holds a bounded slice."""
    for batch in rows:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(limit_rows, int(n * limit_bytes / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def freed(run):
    """``run`` over Arrow batches; its worker, which later tasks reuse, gives memory back at the end."""

    def wrapped(rows):
        if not gc.get_freeze_count():
            # What modules made stays for good, so that collections pass it by.
            gc.collect()
            gc.freeze()
        yield from run(rows)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def groups(rows, key: str):
    """From batches sorted by ``key``: tables that hold whole groups, never the half of one.

    Only the last group of a batch is carried over, so memory is one batch and the largest group.
    """
    rest: list[pa.RecordBatch] = []
    for batch in rows:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if rest and rest[-1].column(rest[-1].schema.get_field_index(key))[-1].as_py() != values[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        cut = int(np.searchsorted(values, values[-1], side="left"))
        if cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)
