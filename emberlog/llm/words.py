"""Vectorised work on the words of a batch of texts."""

from __future__ import annotations

import hashlib

import numpy as np

#: Odd multiplier of the polynomial hash and the increments of the finalisers; any odd values do.
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = x ^ (x >> _S30)
    x = x * _M1
    x = x ^ (x >> _S27)
    x = x * _M2
    return x ^ (x >> _S31)


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


_P_INV = np.uint64(_inverse(int(_P)))


def powers(n: int, base: np.uint64 = _P) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """n + 1 sums of values[i] * P**i (mod 2**64); see span_hash."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse: np.ndarray | None = None) -> np.ndarray:
    """Hash of each span [start, end): depends on the span's values alone, not on where it is."""
    inverse = powers(len(prefix), _P_INV) if inverse is None else inverse
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _M2)


def is_space(body: np.ndarray) -> np.ndarray:
    return (body == 0x20) | ((body >= 0x09) & (body <= 0x0D))


def word_spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+ of texts, and the n + 1 offsets of each text's words."""
    n = len(body)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~is_space(body)
    cut = np.zeros(n + 1, dtype=bool)  # a text starts here
    cut[offsets[:-1][offsets[:-1] < n]] = True
    begins = inside[1:] & (~inside[:-1] | cut)
    stops = inside[:-1] & (~inside[1:] | cut)
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(body: np.ndarray) -> np.ndarray:
    return np.where((body >= 65) & (body <= 90), body + np.uint8(32), body)


#: Keys of the two lanes of a word's 128-bit name; any values do.
_LANES = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
#: Longer words go through a cryptographic hash one by one.
LONG_WORD = 512


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A lane (0 or 1) of each word's 128-bit name.

    Eight bytes at a time pass through a bijection that is no polynomial of them, so no algebra of the bytes gives two words one name; the
    names of words of up to eight bytes and one length differ for certain.
    """
    length = ends - starts
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(body) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    out = mix(length.astype(np.uint64) + _LANES[lane])
    own, at = np.arange(len(starts)), 0
    long = np.flatnonzero(length > LONG_WORD)
    if len(long):
        own = np.flatnonzero(length <= LONG_WORD)
        key = int(_LANES[lane]).to_bytes(8, "little")
        out[long] = [int.from_bytes(hashlib.blake2b(body[a:b], digest_size=8, key=key).digest(), "little") for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    while len(own):
        value = eights[starts[own] + at] & _MASKS[np.minimum(length[own] - at, 8)]
        out[own] = mix((out[own] ^ value) + _LANES[1 - lane])
        at += 8
        own = own[length[own] > at]
    return out


def joined_words(body: np.ndarray, begins: np.ndarray, ends: np.ndarray, stays: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The words that stay, each with a space behind it, and the place of each word (and of the end) in that."""
    size = ends - begins if stays is None else np.where(stays, ends - begins, 0)
    total = np.zeros(len(begins) + 1, dtype=np.int64)
    np.cumsum(size + 1 if stays is None else np.where(stays, size + 1, 0), out=total[1:])
    out = np.full(total[-1], 0x20, dtype=np.uint8)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(total[:-1], size) + inner] = body[np.repeat(begins, size) + inner]
    return out, total


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text that each item belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
