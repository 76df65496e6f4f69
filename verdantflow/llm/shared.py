"""Helpers that several corpus operators use: shared tables, text slices, sums of dense vectors."""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdantflow.shared import new_path, shared_dir, written  # noqa: F401


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks, and allocators keep what they had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such function
        ctypes.CDLL(None).malloc_trim(0)


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """``make()``, once for as long as a worker's tasks ask for ``key`` alone: a worker holds one such thing, and ``drop_held`` lets it go."""
    if key not in _held:
        drop_held()
        _held[key] = make()
    return _held[key]


def drop_held() -> None:
    if _held:
        _held.clear()
        release()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20, rows: int = 1 << 16, hold: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes of text (one row at least) and at most ``rows`` rows, so that work arrays stay small.

    Unless told to ``hold`` it, what an earlier task of the worker held (a tokenizer and its known units) goes first.
    """
    if not hold:
        drop_held()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, side="right"))))
            yield batch.slice(at, to - at)
            at = to
    release()


def packed(counts: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(counts, dtype="<i8").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype="<i8")


def sum_vectors(df: DataFrame) -> DataFrame:
    """Sum equally long packed vectors per ``(name, part)``; each task holds the sum of one key at a time.

    Input and output columns: ``name string, part int, data binary``. A first sum over salts keeps one
    (name, part) from meeting in one task when a great many tasks contributed to it.
    """
    schema = "name string, part int, salt int, data binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for name, part, salt, data in zip(*(batch.column(c).to_pylist() for c in ("name", "part", "salt", "data"))):
                if key != (name, part, salt):
                    if key is not None:
                        yield _vector_row(*key, total)
                    key, total = (name, part, salt), unpacked(data).copy()
                else:
                    total += unpacked(data)
        if key is not None:
            yield _vector_row(*key, total)

    def once(x: DataFrame) -> DataFrame:
        keys = ["name", "part", "salt"]
        return x.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, schema)

    salted = df.select("name", "part", (F.abs(F.xxhash64("data")) % 16).cast("int").alias("salt"), "data")
    return once(once(salted).withColumn("salt", F.lit(0))).drop("salt")


def _vector_row(name, part, salt, total) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"name": [name], "part": [part], "salt": [salt], "data": [packed(total)]},
        schema=pa.schema([("name", pa.string()), ("part", pa.int32()), ("salt", pa.int32()), ("data", pa.binary())]),
    )


def vector_rows(name: str, counts: np.ndarray, width: int) -> Iterator[dict]:
    """Rows for :func:`sum_vectors`: ``counts`` cut into parts of ``width``; parts of zeros are left out."""
    for part in range(0, len(counts), width):
        piece = counts[part : part + width]
        if piece.any():
            yield {"name": name, "part": part // width, "data": packed(piece)}


def dense(rows, length: int, width: int) -> dict[str, np.ndarray]:
    """Collected rows of :func:`sum_vectors` as whole vectors of a length that the caller fixed."""
    out: dict[str, np.ndarray] = {}
    for r in rows:
        v = out.setdefault(r["name"], np.zeros(length, dtype=np.int64))
        piece = unpacked(bytes(r["data"]))
        v[r["part"] * width : r["part"] * width + len(piece)] = piece
    return out
