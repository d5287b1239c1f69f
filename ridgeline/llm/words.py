"""Vectorised text helpers for Arrow batches: runs of rows, words, word hashes and shingles.

A column of texts is handled in runs of about RUN_BYTES bytes, so the arrays of a task stay small however large a batch is;
one text longer than that makes a run of its own.  A null text counts as empty.
"""

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

RUN_BYTES = 1 << 20
SLICE_ROWS = 1024
SHINGLE = 5
LONG_SPAN = 256
_ODD = 0x9E3779B97F4A7C15
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of a block
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU C library has it
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside the JVM of its executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each 64-bit value (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(_ODD)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def arrow_texts(column, lower: bool = False) -> pa.Array:
    """The column as large strings without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.utf8_lower(column) if lower else column


def slices(batches, rows: int):
    """A few rows of each batch at a time."""
    for batch in batches:
        for first in range(0, len(batch), rows):
            yield batch.slice(first, rows)


def text_slices(column, lower: bool = False):
    """(first row, texts as large strings without nulls) for a few rows of a batch at a time, so that no copy of the batch is made."""
    for first in range(0, len(column), SLICE_ROWS):
        yield first, arrow_texts(column.slice(first, SLICE_ROWS), lower)


def text_runs(column, lower: bool | str = False, limit: int | None = None):
    """runs of all slices of a column, with rows counted from its start; lower: in lower case, "ascii" for A to Z only."""
    for base, texts in text_slices(column, lower is True):
        for first, data, offsets in runs(texts, limit or RUN_BYTES):
            yield base + first, _LOWER[data] if lower == "ascii" else data, offsets
    give_back()


def runs(column: pa.Array, limit: int = RUN_BYTES):
    """(first row, bytes, offsets of the rows and the end) for runs of rows of a large_string array."""
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span data[start:end]; equal bytes give equal hashes wherever they stand.

    Blocks of eight bytes are mixed in one after the other, all spans at once; a span of over LONG_SPAN bytes is hashed by itself.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    block_at = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    length = ends - starts
    out = mix(length.astype(np.uint64))
    step, live = 0, np.flatnonzero((length > 0) & (length <= LONG_SPAN))
    while len(live):
        block = block_at[starts[live] + step] & _KEEP[np.minimum(length[live] - step, 8)]
        out[live] = mix(out[live] ^ block)
        step += 8
        live = live[length[live] > step]
    for k in np.flatnonzero(length > LONG_SPAN):
        out[k] = xxhash.xxh3_64_intdigest(padded[starts[k]: ends[k]].tobytes())
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (plus the total).

    A word is a run of bytes of the alphabet, by default of ASCII letters and digits and of any non-ASCII characters.
    """
    n = len(data)
    inside = alphabet[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of every run of `size` words; a shorter text has one shingle of all its words, an empty one none."""
    if len(words) == 0:
        return words[:0]
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + words[k: len(words) - size + 1 + k]
    return mix(total)


def shingle_runs(column, size: int = SHINGLE, lower: bool | str = True, alphabet: np.ndarray = _WORD):
    """For runs of rows: (first row, offsets of the rows' words, word hashes, offsets of the rows' shingles, shingle hashes).

    Shingles are those of shingle_hashes, for all rows of a run at once.
    """
    for first, data, offsets in text_runs(column, lower):
        starts, ends, bounds = word_spans(data, offsets, alphabet)
        words = span_hashes(data, starts, ends)
        count = np.diff(bounds)
        total = np.zeros(max(len(words) - size + 1, 0), np.uint64)
        for k in range(size):
            total = total * np.uint64(0xC2B2AE3D27D4EB4F) + words[k: len(words) - size + 1 + k]
        inside = np.zeros(len(words) + 1, bool)
        inside[: len(total)] = True
        for back in range(1, size):  # the last words of a row start no whole shingle
            inside[np.maximum(bounds[1:] - back, bounds[:-1])] = False
        inside[bounds[:-1][count > 0]] |= (count >= size)[count > 0]
        short = np.flatnonzero((count > 0) & (count < size))
        whole = np.zeros(len(words), np.uint64)
        whole[: len(total)] = mix(total)
        for k in short:
            whole[bounds[k]] = shingle_hashes(words[bounds[k]: bounds[k + 1]], size)[0]
            inside[bounds[k]] = True
        inside = inside[:-1]
        yield first, bounds, words, np.concatenate([[0], np.cumsum(np.maximum(count - size + 1, np.minimum(count, 1)))]), whole[inside]


def texts_of_words(column, lower: bool = True):
    """For each row in order: (row, data of its run, word starts, word ends, word hashes); starts and ends are within the run."""
    for first, data, offsets in text_runs(column, lower):
        starts, ends, bounds = word_spans(data, offsets)
        hashes = span_hashes(data, starts, ends)
        for k in range(len(offsets) - 1):
            a, b = bounds[k], bounds[k + 1]
            yield first + k, data, starts[a:b], ends[a:b], hashes[a:b]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct sorted values; 0 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - both
    return both / total if total else 0.0
