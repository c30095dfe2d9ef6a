"""Five-word shingles of whole texts as sets of 64-bit hashes, computed over arrays of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240517)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64; kept, as far as a chunk reaches."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 2 * CHUNK_BYTES:
            _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > CHUNK_BYTES:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield part


def word_hashes(texts: list[bytes], fold: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of texts: their bytes, starts, ends and hashes of the words between white space, and each text's first
    word, with one more at the end. fold: A-Z count as a-z."""
    values = _BYTE[_LOWER] if fold else _BYTE
    for part in _chunks(texts):
        data = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        ends_of_texts = np.cumsum([len(t) + 1 for t in part])
        inside = np.concatenate(([True], _SPACE[data], [True]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        with np.errstate(over="ignore"):  # hashes wrap around
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[data] * _power(_BASE, len(data)), dtype=np.uint64)))
            words = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts]
            words = mix(words + (ends - starts).astype(np.uint64) * np.uint64(_BASE))
        yield data, starts, ends, words, np.searchsorted(starts, np.concatenate(([0], ends_of_texts)))


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of a text with fewer words, all of them as one; else none."""
    with np.errstate(over="ignore"):
        for _, _, _, words, first in word_hashes(texts, fold=True):
            whole = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
            for k in range(SHINGLE):
                whole += words[k : k + len(whole)] * _PLACE[k]
            whole = mix(whole + np.uint64(SHINGLE) * _PLACE[SHINGLE])
            for low, high in zip(first[:-1], first[1:], strict=True):
                n = high - low
                if n >= SHINGLE:
                    found = np.sort(whole[low : high - SHINGLE + 1])
                    yield found[np.concatenate(([True], found[1:] != found[:-1]))]
                elif n:
                    total = np.zeros(1, np.uint64)
                    for k in range(n):
                        total += words[low + k] * _PLACE[k]
                    yield mix(total + np.uint64(n) * _PLACE[SHINGLE])
                else:
                    yield np.zeros(0, np.uint64)


def fingerprint(found: np.ndarray) -> int:
    """Names the set; 64 bits, signed."""
    if not len(found):
        return 0
    parity = np.bitwise_xor.reduce(mix(found + np.uint64(_BASE)), keepdims=True)
    total = mix(found * np.uint64(3)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(parity * np.uint64(31) + total + np.uint64(len(found))).view(np.int64)[0])
