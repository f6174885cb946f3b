"""Shared vectorised text primitives for the training-data operators.

Everything here works on the raw UTF-8 buffers of Arrow string columns, so a
task handles megabytes per numpy call instead of one word per Python step.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text that one numpy pass works on; temporaries take about 40 times this.
CHUNK_BYTES = 1 << 20

#: Code points 9-13 and 32 separate words.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ODD = np.array([(0xD6E8FEB86659FD93 + 0x5851F42D4C957F2D * 2 * i) % (1 << 64) | 1 for i in range(64)], dtype=np.uint64)

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size > 8 * CHUNK_BYTES:  # one enormous text: do not keep its table
            return have[:n]
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is valid) of a string or binary column, without a copy; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, first = len(column), column.offset
    _, offs, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[first : first + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid())
    if not valid.all() and (np.diff(offsets)[~valid] > 0).any():
        column = column.fill_null("")
        return utf8(column)[:2] + (valid,)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0], valid


def chunks(offsets: np.ndarray, limit: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together, each of one whole text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (limit or CHUNK_BYTES), "right")) - 1)
        yield i, min(j, n)
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class Prefix:
    """Hashes of any byte ranges of one buffer, from one running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        terms = powers(_BASE, n) * (data.astype(np.uint64) + np.uint64(1))
        np.cumsum(terms, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of bytes start to end of each range (a pure function of those bytes)."""
        if len(start) == 0:
            return np.zeros(0, np.uint64)
        back = powers(_BASE_INV, int(np.max(start)) + 1)[start]
        return mix((self.sums[end] - self.sums[start]) * back + (end - start).astype(np.uint64) * _ODD[63])


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-byte window of the buffer."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(powers(_BASE, len(data)) * (data.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(_BASE_INV, n))


class Words:
    """Words of a run of texts: where they start and end in the buffer, and the text each is in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        solid = ~IS_SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        begins, ends = solid.copy(), solid.copy()
        if n:
            begins[1:] &= ~solid[:-1] | edge[1:n]
            ends[:-1] &= ~solid[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)  # of each text, and the end
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.count)
        self.solid = solid


def windows(hashes: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every run of k words inside one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = hashes[:n] * _ODD[0]
    for j in range(1, k):
        total = total + hashes[j : j + n] * _ODD[j]
    inside = text[:n] == text[k - 1 :]
    return mix(total[inside] + _ODD[62]), np.flatnonzero(inside)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    A text of fewer words has its whole sequence as the only one, a text without words none.
    """
    words = Words(data, offsets)
    hashes = Prefix(data).of(words.start, words.end)
    values, at = windows(hashes, words.text, k)
    cuts = np.searchsorted(at, words.first)
    out = []
    for i, n in enumerate(words.count):
        if n >= k:
            own = np.sort(values[cuts[i] : cuts[i + 1]])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif n:
            own = hashes[words.first[i] : words.first[i + 1]] * _ODD[:n]
            own = mix(own.sum(keepdims=True, dtype=np.uint64) + odd(61, int(n)))
        else:
            own = values[:0]
        out.append(own)
    return out


def _release() -> None:
    """Give freed memory back to the system: workers live on, and the next stage's would come on top."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Bytes of an Arrow batch at most: it stands in the JVM and in Python, several times over.
BATCH_BYTES = 16 << 20


#: Called before a task that uses no tokenizer: workers live on, and what they loaded for an earlier stage would stay.
MODELS: list[dict] = []


def forget() -> None:
    for loaded in MODELS:
        loaded.clear()


def lean(run, models: bool = False):
    """An Arrow function that gets small batches and whose worker keeps no freed memory before and after it.

    models: it uses the tokenizers that the worker has loaded; other functions drop them.
    """
    session = SparkSession.getActiveSession()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if session is not None and int(session.conf.get(name).rstrip("b")) > BATCH_BYTES:
        session.conf.set(name, f"{BATCH_BYTES}b")

    def wrapped(batches):
        if not models:
            forget()
        _release()
        yield from run(batches)
        _release()

    return wrapped


def u64(x: int) -> np.uint64:
    """A Python integer modulo 2**64."""
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def odd(i: int, times: int = 1) -> np.uint64:
    """The i-th fixed odd constant, times an integer."""
    return u64(int(_ODD[i]) * times)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
