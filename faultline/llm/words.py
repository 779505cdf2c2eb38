"""Words, lines and n-grams of Arrow text batches as flat numpy arrays.

A word is a run of ``[^\\x20\\x09-\\x0D]``. Null texts count as empty. All helpers work on one
bounded slice of rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 6 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in pieces whose texts hold ``limit`` bytes, or one row if that is longer."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where the words of each text start (one more entry than texts), and all words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.values
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return before[lists.offsets.to_numpy()], words.filter(full)


def split_lines(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where the lines of each text start, and all lines; a text has one line at least."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    return lists.offsets.to_numpy().astype(np.int64), lists.values


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A code for each value, and the distinct values."""
    codes = values.dictionary_encode()
    return codes.indices.to_numpy().astype(np.int64), codes.dictionary


def hashed(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each value; each distinct value is hashed once."""
    codes, distinct = coded(values)
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(x, seed) for x in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct)
    )
    return hashes[codes] if len(codes) else np.zeros(0, np.uint64)


def hashed_twice(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The halves of a 128-bit hash of each value; each distinct value is hashed once."""
    codes, distinct = coded(values)
    distinct = pa.concat_arrays([distinct])  # from the first byte of its buffer on
    ends = np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1).tolist()
    raw = (distinct.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    digests = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True))
    halves = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    return halves[:, 0].take(codes), halves[:, 1].take(codes)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(starts: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the hashed n-grams of each text start, and all of them. A text of fewer words has one: all its words."""
    sizes = np.diff(starts)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    begins = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = starts[:-1][owner] + np.arange(len(owner)) - begins[:-1][owner]
    length = np.minimum(sizes, n)[owner]
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    total = length.astype(np.uint64)
    for k in range(n):
        total = np.where(k < length, (total + padded[first + k]) * _BASE, total)
        total ^= total >> np.uint64(29)
    return begins, mixed(total)
