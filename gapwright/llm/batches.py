"""Arrow helpers shared by the operators that work on whole texts inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE = 4 << 20             # bytes of text worked on at once
NO_ID = -(2 ** 63)          # stands for a null id inside packed records


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that ``column`` holds about ``limit`` bytes each (one longer text stays whole)."""
    limit = limit or PIECE
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(size.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def texts_of(column: pa.Array) -> pa.Array:
    """The column as large strings, null as empty.

    A cast slice keeps offsets into the whole batch, which string kernels misread; the texts are copied to buffers of their own.
    """
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    return texts.take(pa.array(np.arange(len(texts)))) if len(texts) else texts


def ids_of(column: pa.Array) -> np.ndarray:
    """The column as int64, null as ``NO_ID``."""
    return pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values and row offsets of a list array, offsets starting at 0."""
    at = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), at - at[0]


def coded(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values and the code of each value."""
    d = values.dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False)


def words_of(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the code of every word in order, and row offsets; words are runs without ``[\\x20\\x09-\\x0D]``."""
    if lower:
        texts = pc.ascii_lower(texts)
    values, at = flat(pc.ascii_split_whitespace(texts))
    distinct, codes = coded(values)
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:                                   # leading or trailing white space
        full = codes != empty
        at = np.concatenate([[0], np.cumsum(full)])[at]
        codes = codes[full]
    return distinct, codes, at


def hash64(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every distinct string."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x, seed) for x in distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))


def digest128(distinct: pa.Array) -> list[bytes]:
    """A 128-bit digest of every distinct string."""
    h = xxhash.xxh3_128_digest
    return [h(x) for x in distinct.cast(pa.large_binary()).to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start, start + 1, ...`` of every run, run after run."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
