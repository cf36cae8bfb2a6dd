"""Word boundaries and hashes of whole Arrow batches, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 20

#: The white space of every word rule here, and ASCII lower case.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False
#: Letters, digits and every byte of a non-ASCII character.
IS_ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_R = np.uint64(33)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Low bytes kept of a partly filled block of eight, by the number of bytes.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


#: Bytes of one Arrow batch; Spark's default of 64 MB is held several times per task.
BATCH = 4 << 20


def bound_batches(df: DataFrame) -> None:
    """Have the session send texts to Python in batches of at most ``BATCH`` bytes (or one row)."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    held = conf.get(name).strip().lower().removesuffix("b")
    if not held.isdigit() or int(held) > BATCH:
        conf.set(name, str(BATCH))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> _R)
    x *= _M1
    x ^= x >> _R
    x *= _M2
    x ^= x >> _R
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; null counts as empty."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    held = column.buffers()[2]
    data = np.zeros(0, np.uint8) if held is None else np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        _, offsets = raw(batch.column(column))
        start, rows = 0, batch.num_rows
        while start < rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(rows, max(stop, start + 1))
            yield batch.slice(start, stop - start)
            start = stop


@dataclass
class Words:
    """``data`` has eight spare bytes; words of text d are ``bounds[d]`` to ``bounds[d + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def place(self) -> np.ndarray:
        """Position of each word within its text."""
        return np.arange(len(self)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))


def words(column: pa.Array, fold: bool = False, inside_word: np.ndarray = IS_WORD) -> Words:
    """Words of each text, by default ``[^\\x20\\x09-\\x0D]+``; ``fold`` lower-cases A-Z."""
    held, offsets = raw(column)
    n = len(held)
    data = np.zeros(n + 8, np.uint8)
    data[:n] = LOWER[held] if fold else held
    inside = inside_word[held]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    head, tail = offsets[:-1][filled], offsets[1:][filled] - 1
    first[head] = inside[head]
    last[tail] = inside[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of every word, eight bytes at a time."""
    n = len(w)
    length = w.ends - w.starts
    hashes = mix(length.astype(np.uint64) * _STEP + _STEP)
    if n == 0:
        return hashes
    eight = np.ndarray((len(w.data) - 7,), "<u8", w.data.data, strides=(1,))
    rows, at, left = np.arange(n), w.starts, length
    while len(rows):
        block = eight[at] & _KEEP[np.minimum(left, 8)]
        hashes[rows] = mix((hashes[rows] ^ block) * _STEP + np.uint64(1))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return hashes


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``length`` consecutive entries from each position, by doubling.

    The result is shorter than the input by ``length - 1``. Callers drop the
    windows that run over the end of a text.
    """
    done, out, span = 0, None, 1
    powers = hashes
    rest = length
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    while rest:
        if rest & 1:
            piece = powers[done : done + n]
            out = piece.copy() if out is None else mix(out * _STEP + piece)
            done += span
        rest >>= 1
        if rest:
            powers = mix(powers[:-span] * _STEP + powers[span:])
            span *= 2
    return mix(out + np.uint64(length))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` consecutive entries from each position."""
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: len(out) - (width - span)], out[width - span :])
    return out


def strings(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    return column.cast(pa.binary()).to_pylist()
