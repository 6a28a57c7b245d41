"""Words of many texts at once, as positions and 64-bit hashes in NumPy arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomset.llm.workers import per_worker

# Bytes that are hashed at a time; only a longer word makes a longer stretch.
STRETCH = 1 << 18

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all 64-bit numbers, one to one."""
    x = (x ^ (x >> _SHIFT)) * _M1
    x = (x ^ (x >> _SHIFT)) * _M2
    return x ^ (x >> _SHIFT)


def lower_case(byte: int) -> int:
    """A-Z as a-z, any other byte as it is."""
    return byte + 32 if 0x41 <= byte <= 0x5A else byte


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    random = np.random.default_rng(4177)
    values = random.integers(1, 1 << 63, 256, dtype=np.uint64)
    factor = int(random.integers(1, 1 << 62)) * 2 + 1
    powers = np.full(STRETCH + 1, factor, np.uint64)
    inverse = np.full(STRETCH + 1, pow(factor, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(inverse, out=inverse)
    return values, powers, inverse


class Words(NamedTuple):
    """Words in the order of the texts: where each starts and ends, and its hash."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray


def _hash_stretch(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    values, powers, inverse = per_worker("word tables", _tables)
    running = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * powers[: len(raw)], out=running[1:])
    return mix((running[ends] - running[starts]) * inverse[starts])


def find_words(raw: bytes, inside: np.ndarray) -> Words:
    """The maximal runs of bytes that are ``inside`` a word, with their hashes."""
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    hashes = np.empty(len(starts), np.uint64)
    data = np.frombuffer(raw, np.uint8)
    first = 0
    while first < len(starts):
        at = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, at + STRETCH, side="right")))
        if ends[first] - at > STRETCH:
            word = raw[at : ends[first]]
            digest = hashlib.blake2b(word, digest_size=8).digest()
            hashes[first] = int.from_bytes(digest, "little")
            last = first + 1
        else:
            hashes[first:last] = _hash_stretch(
                data[at : ends[last - 1]], starts[first:last] - at, ends[first:last] - at
            )
        first = last
    return Words(starts, ends, hashes)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a column of strings, a null as no bytes."""
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def in_portions(
    batches: Iterator[pa.RecordBatch], text: int, size: int
) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in portions of about ``size`` bytes of text; only a longer text
    makes a larger portion."""
    held: list[pa.RecordBatch] = []
    bytes_held = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy()
        running = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = running[at - 1] if at else 0
            end = int(np.searchsorted(running, done + size - bytes_held)) + 1
            end = min(end, batch.num_rows)
            held.append(batch.slice(at, end - at))
            bytes_held += int(running[end - 1] - done)
            at = end
            if bytes_held >= size:
                yield from _joined(held)
                held, bytes_held = [], 0
    if held:
        yield from _joined(held)


def _joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def gathered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches of UTF-8 bytes from ``starts`` to ``ends`` as an array of strings."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    data = np.ascontiguousarray(raw[at])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The position of one of each distinct key, and how many there are of it."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(keys) else order
    return order[first], np.diff(np.append(first, len(keys)))
