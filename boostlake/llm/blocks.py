"""Shared helpers: bounded Arrow blocks, durable intermediate tables, small numpy tools."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boostlake.session import remove as drop  # noqa: F401
from boostlake.session import stored as durable  # noqa: F401

#: Rows of an Arrow batch handed to Python; keeps a worker's memory bounded when texts are long.
BATCH_ROWS = 1000
#: Bytes of text that one numpy block works on.
BLOCK_BYTES = 2 << 20


def bounded(spark: SparkSession) -> None:
    """Limit Arrow batches of this session to BATCH_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text of ``docs``, about: twice the size of the files that it reads, or counted where that isn't known."""
    leaves = docs._jdf.queryExecution().analyzed().collectLeaves()
    known = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if known < 1 << 50:
        return 2 * known
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def sized(df: DataFrame, name: str, rows: int) -> DataFrame:
    """``df`` stored; marked for broadcast if it has at most ``rows`` rows, else joined by a shuffle that Spark can split."""
    kept = durable(df, name)
    return F.broadcast(kept) if kept.count() <= rows else kept


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a block's text is at most ``limit`` bytes (one row at least)."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply) over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the word-hash base modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 1024), 0x9E3779B97F4A7C15, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes that aren't ASCII white space) of a byte array, lower-cased A-Z: starts, ends, 64-bit hashes."""
    starts, ends = spans(~_SPACE[data])
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    low = _LOWER[data].astype(np.uint64) + np.uint64(1)
    begins = np.concatenate(([0], starts))
    offset = np.arange(len(data)) - np.repeat(begins, np.diff(np.append(begins, len(data))))
    longest = int((ends - starts).max())
    low *= powers(longest + 1)[np.minimum(offset, longest)]
    low[_SPACE[data]] = 0
    return starts, ends, mix64(np.add.reduceat(low, starts) ^ (ends - starts).astype(np.uint64))
