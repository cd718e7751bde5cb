"""Word shingles as 64-bit hashes, and SuperMinHash signatures of their sets, with numpy."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

SHINGLE, MOST_WORDS = 4, 15
#: A word's hash is a multilinear sum over its bytes; longer words are digested instead.
LONG_WORD = 1 << 14
#: Bytes hashed at a time, so that memory does not follow the text's length.
PIECE = 1 << 21
_U = np.uint64
_RANDOM = np.random.default_rng(20_240_229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PLACE = _RANDOM.integers(1, 1 << 63, LONG_WORD, dtype=np.uint64) * _U(2) + _U(1)
_WORD = _RANDOM.integers(1, 1 << 63, MOST_WORDS + 1, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _RANDOM.integers(1, 1 << 63, 4096, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _piece_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of the words of a piece of text that cuts no word; A-Z count as a-z."""
    word = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    size = end - start
    at = np.flatnonzero(word)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(len(at)) - np.repeat(first, size)
    lower = _LOWER[raw[at]]
    sums = np.add.reduceat(_BYTE[lower] * _PLACE[np.minimum(place, LONG_WORD - 1)], first)
    for k in np.flatnonzero(size > LONG_WORD):
        sums[k] = int.from_bytes(blake2b(_LOWER[raw[start[k] : end[k]]].tobytes(), digest_size=8).digest(), "little")
    return mix(sums ^ size.astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """One hash for each word ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) <= PIECE:
        return _piece_hashes(raw)
    out, at = [], 0
    while at < len(raw):
        to = min(at + PIECE, len(raw))
        while to < len(raw) and not _SPACE[raw[to]]:
            more = np.flatnonzero(_SPACE[raw[to : to + PIECE]])
            to += int(more[0]) if len(more) else len(raw[to : to + PIECE])
        out.append(_piece_hashes(raw[at:to]))
        at = to
    return np.concatenate(out)


def shingle_set(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; with fewer words, of the whole sequence; none without words."""
    words = word_hashes(text)
    if not len(words):
        return words
    if len(words) < width:
        return mix(np.sum(words * _WORD[: len(words)], keepdims=True) + _WORD[MOST_WORDS:] * np.array([len(words)], np.uint64))
    n = len(words) - width + 1
    total = words[:n] * _WORD[0]
    for k in range(1, width):
        total += words[k : n + k] * _WORD[k]
    return np.unique(mix(total))


def superminhash(items: np.ndarray, size: int) -> np.ndarray:
    """The signature of a set of distinct hashes, as integers: step in the high half, random rank in the low.

    Each item draws a random permutation of the positions, one position a step, and offers it a rank that is below every
    rank of a later step. The ranks of an item are thus correlated, which lowers the variance. Once each position
    has a rank from the steps so far, later steps cannot change it, and drawing stops.
    """
    signature = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    order = None
    for step in range(size):
        x = mix(items + _STEP[step])
        other = step + (((x & _U(0xFFFFFFFF)) * _U(size - step)) >> _U(32)).astype(np.int64)
        if step == 0:
            position = first = other
        else:
            if order is None:  # most sets settle in the first step and need no permutations
                row = np.arange(len(items))
                order = np.tile(np.arange(size, dtype=np.int16), (len(items), 1))
                order[row, first] = 0
                order[:, 0] = first
            position = order[row, other].astype(np.int64)
            order[row, other] = order[:, step]
            order[:, step] = position
        np.minimum.at(signature, position, (x >> _U(32)) + (_U(step) << _U(32)))
        if int(signature.max()) >> 32 <= step:
            break
    return signature


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of the signature, different between bands."""
    rows = signature.reshape(bands, -1)
    total = np.arange(1, bands + 1, dtype=np.uint64) * _WORD[MOST_WORDS]
    for k in range(rows.shape[1]):
        total = mix(total + rows[:, k] * _STEP[100 + k])
    return total


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many items two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)) if len(b) else 0
