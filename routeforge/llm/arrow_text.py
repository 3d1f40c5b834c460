"""Text columns as Arrow batches: bounded slices, and words as integer codes.

Everything here runs inside Spark tasks on one bounded slice of rows at a time, so memory follows
the slice (or the longest single text), never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time. It bounds memory only; no result depends on it.
SLICE_BYTES = 8_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Rows in order, joined over small batches and cut over large ones, about ``limit`` bytes of text each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit - size, side="right")))
            held.append(batch.slice(at, stop - at))
            size += int(ends[stop - 1]) - before
            at = stop
            if size >= limit or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def texts_of(table: pa.Table, column: str = "text") -> pa.Array:
    """The column as one array; null counts as empty."""
    joined = table.column(column).combine_chunks()
    if isinstance(joined, pa.ChunkedArray):
        joined = pa.concat_arrays(joined.chunks) if joined.num_chunks else pa.array([], pa.string())
    return pc.fill_null(joined, "")


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts: codes into ``distinct``, text i at starts[i]:starts[i+1]."""

    distinct: pa.Array
    codes: np.ndarray
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def owners(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def words_of(texts: pa.Array) -> Words:
    lists = pc.ascii_split_whitespace(texts)
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0] if len(starts) else np.zeros(1, np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    distinct = coded.dictionary
    # A text that starts or ends with white space gives empty words there.
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:
        real = codes != empty
        kept = np.concatenate([[0], np.cumsum(real)])
        starts, codes = kept[starts], codes[real]
    return Words(distinct, codes, starts)


def spread(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace each code by its run of ``flat`` (run k has lengths[k] items): the items, and the ends of the runs."""
    first = np.cumsum(lengths) - lengths
    sizes = lengths[codes]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(first[codes] - (ends - sizes), sizes) + np.arange(total)
    return flat[at], ends


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift steps) of unsigned integers."""
    x = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x
