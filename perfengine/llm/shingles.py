"""Vectorised word and shingle hashes of whole Arrow batches of texts, and MinHash signatures.

Words are maximal runs of word bytes of the UTF-8 text with A-Z lower-cased; a word hash is a
polynomial over a table of random 64-bit numbers, taken from prefix sums, so no Python object is
made per word. Texts are handled in groups of about ``CHUNK`` bytes; a longer text is a group of
its own (about 40 bytes of memory for each of its bytes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes: all but white space (x20, x09-x0D).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Word bytes: digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and each text's offsets in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) of runs of texts of about ``size`` bytes."""
    raw, at = utf8(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_hashes(raw: np.ndarray, at: np.ndarray, word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each text's offsets in them."""
    raw = LOWER[raw]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = word[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = at[(at > 0) & (at < len(raw))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:-1], out=total[1:])
    hashes = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, at).astype(np.int64)


def shingle_hashes(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text in order (fewer words: the sequence as one), and offsets."""
    counts = np.diff(at)
    out = np.where(counts == 0, 0, np.maximum(1, counts - n + 1))
    offsets = np.concatenate([[0], np.cumsum(out)]).astype(np.int64)
    if not offsets[-1]:
        return np.zeros(0, np.uint64), offsets
    pos = np.arange(offsets[-1]) + np.repeat(at[:-1] - offsets[:-1], out)
    end = np.repeat(at[1:], out)
    acc, length = np.zeros(len(pos), np.uint64), np.zeros(len(pos), np.uint64)
    for j in range(n):
        here = pos + j < end
        acc = np.where(here, acc * np.uint64(0xD6E8FEB86659FD93) + words[np.minimum(pos + j, len(words) - 1)], acc)
        length += here.astype(np.uint64)
    return mix(acc + length), offsets


def distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted, and offsets."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:])]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def multipliers(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: np.ndarray, at: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash signatures (uint32, one row per text; texts without shingles get the largest value)."""
    full = np.flatnonzero(np.diff(at) > 0)
    out = np.full((len(at) - 1, len(factors)), 0xFFFFFFFF, np.uint32)
    if len(full):
        starts, t = at[full], np.empty_like(sets)
        low = np.empty((len(factors), len(full)), np.uint64)
        for i, a in enumerate(factors):
            np.multiply(sets, a, out=t)
            np.minimum.reduceat(t, starts, out=low[i])
        out[full] = (low >> np.uint64(32)).astype(np.uint32).T
    return out


def text_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, raw, at in chunks(texts):
        sh, so = shingle_hashes(*word_hashes(raw, at), n)
        for a, b in zip(so[:-1], so[1:]):
            yield np.unique(sh[a:b])
