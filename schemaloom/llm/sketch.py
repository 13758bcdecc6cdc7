"""Count-min sketches of 64-bit keys: built per task, merged by Spark, read as bits.

Each of ``rows`` hash functions maps a key to one of ``2**log2_cells`` cells. A task
collects the cells of its keys and emits them as sorted, gap-coded lists per block
of cells; the blocks are the shuffle key, so no task merges more than its blocks.
Counts stop at a cap. With a cap of two, where only "seen more than once" is asked for,
the merged sketch is one bit per cell, else one byte: ``rows * 2**log2_cells`` bits or
bytes whatever the input, which bounds what is collected and broadcast. An estimate is the smallest count over the rows, so
it is never below the true count; with more keys than cells it only lets more pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from schemaloom.llm.hashing import mix
from schemaloom.llm.token_files import pack, unpack

LOG2_CELLS = 28
LOG2_BLOCKS = 7
#: Keys a task holds before it emits their cells.
FLUSH_KEYS = 4 << 20
SCHEMA = "block int, n long, control binary, data binary"


def cells(keys: np.ndarray, row: int, log2_cells: int) -> np.ndarray:
    return (mix(keys, 9000 + row) >> np.uint64(64 - log2_cells)).astype(np.int64)


class Builder:
    """Cells of one task."""

    def __init__(self, rows: int, log2_cells: int, cap: int) -> None:
        self.rows, self.log2_cells, self.cap, self.held, self.size = rows, log2_cells, cap, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(keys)
        self.size += len(keys)
        if self.size >= FLUSH_KEYS:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        keys = np.concatenate(self.held) if self.held else np.empty(0, np.uint64)
        self.held, self.size = [], 0
        width = 1 << (self.log2_cells - LOG2_BLOCKS)
        out = []
        for row in range(self.rows):
            found, counts = np.unique(cells(keys, row, self.log2_cells), return_counts=True)
            found = np.repeat(found, np.minimum(counts, self.cap))
            edges = np.searchsorted(found, np.arange(1 << LOG2_BLOCKS) * width)
            for b, part in enumerate(np.split(found, edges[1:])):
                if len(part):
                    control, data = pack(np.diff(part - b * width, prepend=0))
                    out.append((row << LOG2_BLOCKS | b, len(part), control, data))
        return pa.RecordBatch.from_arrays(
            [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
            names=["block", "n", "control", "data"])


def collect_keys(source: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], rows: int, log2_cells: int = LOG2_CELLS, cap: int = 2) -> DataFrame:
    """Sketch parts of every task; ``keys`` yields the 64-bit keys of a batch."""

    def run(batches):
        builder = Builder(rows, log2_cells, cap)
        for batch in batches:
            for found in keys(batch):
                yield from builder.add(found)
        yield builder.flush()

    return source.mapInArrow(run, SCHEMA)


def merge(parts: DataFrame, rows: int, log2_cells: int = LOG2_CELLS, cap: int = 2, tasks: int = 64) -> list[np.ndarray]:
    """One array per row: bits of the cells that were hit more than once, or counts up to the cap."""
    width = 1 << (log2_cells - LOG2_BLOCKS)

    def run(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = counts.setdefault(row["block"], np.zeros(width, np.uint8))
                at = np.cumsum(unpack(row["control"], row["data"], row["n"]).astype(np.int64))
                found, times = np.unique(at, return_counts=True)
                own[found] = np.minimum(own[found] + times, cap)
        blocks = sorted(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(blocks, pa.int32()), pa.array([(np.packbits(counts[b] > 1) if cap == 2 else counts[b]).tobytes() for b in blocks], pa.binary()),
        ], names=["block", "bits"])

    # block ids run over all rows of the sketch and are spread over the tasks in turn
    merged = parts.repartitionById(tasks, parts["block"] % tasks).mapInArrow(run, "block int, bits binary")
    size = width // 8 if cap == 2 else width
    out = [np.zeros(size << LOG2_BLOCKS, np.uint8) for _ in range(rows)]
    for r in merged.toLocalIterator():
        row, b = r["block"] >> LOG2_BLOCKS, r["block"] & ((1 << LOG2_BLOCKS) - 1)
        out[row][b * size:(b + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def repeated(bits: list[np.ndarray], keys: np.ndarray, log2_cells: int = LOG2_CELLS) -> np.ndarray:
    """Whether the estimated count of each key is more than one."""
    out = np.ones(len(keys), dtype=bool)
    for row, own in enumerate(bits):
        at = cells(keys, row, log2_cells)
        out &= (own[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def estimates(counts: list[np.ndarray], keys: np.ndarray, log2_cells: int) -> np.ndarray:
    """Estimated count of each key, up to the cap."""
    return np.min([own[cells(keys, row, log2_cells)] for row, own in enumerate(counts)], axis=0)
