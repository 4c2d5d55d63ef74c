"""Words and shingles of a text as 64-bit hashes, vectorised over the UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: ``.lower()`` of A-Z only, as the contracts have it.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_LETTER = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_PIECE = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed bijection)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)


def _hash_piece(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    inside = np.flatnonzero(~space)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    at = np.arange(len(inside)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(sizes.max()) + 1, _BASE))
        return mixed(np.add.reduceat(_LETTER[a[inside]] * power[at], first) + sizes.astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """One hash per word (maximal run of bytes other than the space and 9 to 13), in order."""
    if len(data) <= 2 * _PIECE:
        return _hash_piece(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + _PIECE, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(_hash_piece(data[at:end]))
        at = end
    return np.concatenate(out)


_TURN = mixed(np.arange(1, 65, dtype=np.uint64)) | _U(1)


def combined(words: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at ``offsets`` from each position at which all of them exist."""
    n = len(words) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j, o in enumerate(offsets):
            total += words[o : o + n] * _TURN[j]
        return mixed(total + _U(len(offsets)))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter text is one run."""
    if not len(words):
        return words
    return combined(words, tuple(range(min(size, len(words)))))


def shingle_lists(texts: list[bytes], size: int) -> list[np.ndarray]:
    """``shingles`` of each text, hashed together: the texts lie in one buffer, with white space between them."""
    w = word_hashes(b"\n".join(texts))
    at, out = 0, []
    full = combined(w, tuple(range(size)))
    for n in (len(t.split()) for t in texts):
        out.append(full[at : at + n - size + 1] if n >= size else shingles(w[at : at + n], size))
        at += n
    return out
