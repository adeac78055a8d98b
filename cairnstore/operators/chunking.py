"""Blocks of files: fixed-size in SQL, content-defined by a rolling hash in Arrow batches, and volumes of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least and most bytes of a chunk and boundary bits; one bit more has to be zero.
LEAST, MOST, BITS = 128 << 10, 16 << 20, 19
WINDOW = 64
#: Space that a volume keeps free.
SPARE = 1000


def byte_table(seed: int = 0x5EED) -> np.ndarray:
    """A 32-bit value for each byte, from a multiplicative mixer."""
    x = (np.arange(1, 257, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def rolling(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Cyclic-polynomial hash of the up to 64 bytes that end at each byte; windows double in six steps."""
    h, width = table[data], 1
    while width < WINDOW:
        turn = np.uint32(width % 32)
        back = h[:-width] if len(h) > width else h[:0]
        turned = back if not turn else (back << turn) | (back >> (np.uint32(32) - turn))
        h = h.copy()
        h[len(h) - len(back) :] ^= turned
        width *= 2
    return h


def cuts(data: np.ndarray, least: int, most: int, bits: int, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """Chunks as (start, end). A chunk ends after a boundary byte, once it has `least` bytes, or with `most`; the end
    of input ends a chunk even if it is empty. Runs of one byte hash to zero and are no boundary."""
    h = rolling(data, table) if len(data) else np.zeros(0, np.uint32)
    marks = np.flatnonzero(((h & np.uint32((1 << (bits + 1)) - 1)) == 0) & (h != 0)) + 1
    start, n = 0, len(data)
    while True:
        i = int(np.searchsorted(marks, start + max(least, 1)))
        end = int(marks[i]) if i < len(marks) else n + 1
        end = min(end, start + most)
        if end > n:
            yield start, n
            return
        yield start, end
        start = end


def content_chunks(files: DataFrame, least: int = LEAST, most: int = MOST, bits: int = BITS) -> DataFrame:
    """path, block_nr, start, content of every chunk; an empty file is one empty chunk. Parallel across files."""
    if not 0 < least <= most:
        raise ValueError("0 < least <= most")

    def run(batches):
        table = byte_table()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                data = np.frombuffer(content or b"", np.uint8)
                rows = list(cuts(data, least, most, bits, table))
                yield pa.record_batch(
                    [pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array([a for a, _ in rows], pa.int64()), pa.array([data[a:b].tobytes() for a, b in rows], pa.binary())],
                    ["path", "block_nr", "start", "content"],
                )

    return files.select("path", "content").mapInArrow(run, "path string, block_nr int, start long, content binary")


def fixed_pieces(content: Column, size: int) -> Column:
    """An array of pieces of a text or binary, at least one."""
    last = F.greatest(F.ceil(F.length(content) / size), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(content, i * size + 1, F.lit(size)))


def fixed_chunks(files: DataFrame, size: int, content: str = "content") -> DataFrame:
    """path, block_nr, start, content in blocks of `size`."""
    rows = files.select("path", F.posexplode(fixed_pieces(F.col(content), size)).alias("block_nr", "content"))
    return rows.select("path", "block_nr", (F.col("block_nr") * F.lit(size).cast("long")).alias("start"), "content")


def offsets(blocks: DataFrame, volume: str = "volume", order: list[str] | None = None, length: str = "length") -> DataFrame:
    """start: the sum of earlier lengths in the volume."""
    w = Window.partitionBy(volume).orderBy(*(order or ["ordinal"])).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("start", F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))


def pack_volumes(blocks: DataFrame, volume_bytes: int, lane: str = "lane", spare: int = SPARE) -> DataFrame:
    """Adds volume and start: blocks of a lane, by ordinal, fill a volume until the next would not fit.

    Rolling over depends on all earlier blocks, so a lane is packed in order; only lanes, ordinals and lengths go
    to Python, in bounded batches of sorted rows. More lanes pack in parallel and leave one open volume each.
    """
    rows = blocks.select(lane, "ordinal", "length").repartition(lane).sortWithinPartitions(lane, "ordinal")

    def run(batches):
        at, volume, used = None, 0, 0
        for batch in batches:
            volumes, starts = [], []
            for key, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != at:
                    at, volume, used = key, 0, 0
                if used and used + size + spare > volume_bytes:
                    volume, used = volume + 1, 0
                volumes.append(volume)
                starts.append(used)
                used += size
            yield pa.record_batch([*batch.columns, pa.array(volumes, pa.int32()), pa.array(starts, pa.int64())], [*batch.schema.names, "volume", "start"])

    kind = dict(rows.dtypes)
    return rows.mapInArrow(run, f"{lane} {kind[lane]}, ordinal {kind['ordinal']}, length {kind['length']}, volume int, start long")
