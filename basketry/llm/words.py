"""Words of whole Arrow string columns at once: byte classes by table, runs by numpy, counts by Arrow.

A column's texts lie one behind the other in one buffer, so one pass finds the words of all of them.
Classes are chosen so that UTF-8 never splits a character: ASCII bytes, or whole sequences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at a time, so that the arrays made from them stay small. One longer text is
#: handled alone.
CHUNK_BYTES = 6 << 20

#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(chars: str, inside: int = 1, outside: int = 0) -> np.ndarray:
    """A class for each byte value: ``inside`` for the given ASCII characters."""
    table = np.full(256, outside, np.uint8)
    table[[ord(c) for c in chars]] = inside
    return table


def chunks(batches, column: str = "text", most: int = CHUNK_BYTES):
    """The incoming batches in slices of about ``most`` bytes of ``column``, one row at least."""
    for batch in batches:
        n = batch.num_rows
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column).fill_null("")), np.int64))
        at = 0
        while at < n:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): all texts of an Arrow string column one behind the other; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    n, first = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[first:first + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of marked bytes that stay within one text."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(inside))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def string_array(data: np.ndarray, lengths: np.ndarray) -> pa.LargeStringArray:
    """Strings that lie one behind the other in ``data``."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets),
                                            pa.py_buffer(np.ascontiguousarray(data)))


def coded(strings) -> tuple[np.ndarray, pa.Array]:
    """(codes, distinct): each string's place among the distinct ones."""
    found = strings.dictionary_encode()
    return np.asarray(found.indices).astype(np.int64), found.dictionary
