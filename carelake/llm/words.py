"""Words of texts as 64-bit hashes, a whole batch at a time.

A word is a run of bytes other than space and 0x09 to 0x0D. Its hash is a polynomial over
randomised byte values modulo 2**64, taken from prefix sums, so that the cost is a few
vector operations a byte; words over ``LONG`` bytes, for which a power-of-two modulus would
be weak, are hashed by xxh64 instead. Windows of words are hashed the same way over the
words' hashes. Equal words and windows have equal hashes everywhere; two different ones
collide with a chance of about 2**-64."""

from __future__ import annotations

import numpy as np
import xxhash

LONG = 512
_BLOCK = 1 << 20
_STEP = 0x9E3779B97F4A7C15
_WORD_STEP = 0xD6E8FEB86659FD93
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit over all (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """step**i and step**-i modulo 2**64 for i up to n."""
    if step not in _POWERS or len(_POWERS[step][0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        _POWERS[step] = tuple(
            np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, s, np.uint64))))
            for s in (step, pow(step, -1, 1 << 64)))
    return _POWERS[step]


def _hash_block(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a block that ends between words."""
    edge = np.diff(np.concatenate(([True], _BLANK[block], [True])).view(np.int8))
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    power, inverse = _powers(_STEP, len(block))
    total = np.zeros(len(block) + 1, np.uint64)
    np.cumsum(_BYTE[block] * power[:len(block)], out=total[1:])
    size = (end - start).astype(np.uint64)
    hashed = mix((total[end] - total[start]) * inverse[start] + size)
    for i in np.nonzero(end - start > LONG)[0]:
        hashed[i] = xxhash.xxh64_intdigest(block[start[i]:end[i]].tobytes())
    return hashed, start


def word_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): text i has the words hashes[offsets[i]:offsets[i + 1]].
    ``lower`` lower-cases A to Z. Null counts as empty."""
    encoded = [b"" if t is None else t.encode() for t in texts]
    data = b"\n".join(encoded)
    begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in encoded]))).astype(np.int64)
    buffer = np.frombuffer(data.lower() if lower else data, np.uint8)
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(buffer):
        end = at + _BLOCK
        while end < len(buffer):  # a block ends at white space
            gap = np.nonzero(_BLANK[buffer[end:end + _BLOCK]])[0]
            if len(gap):
                end += int(gap[0])
                break
            end += _BLOCK
        hashed, start = _hash_block(buffer[at:end])
        hashes.append(hashed)
        starts.append(start + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begin)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words, across text borders too."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    power, inverse = _powers(_WORD_STEP, min(n, _BLOCK) + length)
    for at in range(0, n, _BLOCK):
        part = words[at:min(at + _BLOCK, n) + length - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[:len(part)], out=total[1:])
        m = len(part) - length + 1
        out[at:at + m] = mix((total[length:] - total[:m]) * inverse[:m])
    return out


def inside(offsets: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of the ``n`` runs of ``length`` words lie within one text."""
    ok = np.ones(n, bool)
    for cut in offsets[1:-1]:
        ok[max(0, cut - length + 1):cut] = False
    return ok
