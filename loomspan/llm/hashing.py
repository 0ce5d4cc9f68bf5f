"""Word and shingle hashes of whole texts, vectorised over bytes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_P, _M = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_P_INVERSE = pow(_P, -1, 2**64)
_POWERS = [np.ones(1, _U), np.ones(1, _U)]

#: bytes of words between ASCII white space
SPACES = np.ones(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = False


def low_bytes(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, p in enumerate((_P, _P_INVERSE)):
            _POWERS[k] = np.cumprod(np.concatenate([[_U(1)], np.full(2 * n, p, _U)]), dtype=_U)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def word_hashes(data: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word; ``inside`` tells which of the 256 bytes belong to words."""
    b = np.frombuffer(data, "u1")
    within = np.concatenate([[False], inside[b], [False]])
    edges = np.flatnonzero(within[1:] != within[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(len(b) + 1)
    total = np.concatenate([[_U(0)], np.cumsum(b * power[: len(b)], dtype=_U)])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U)), starts, ends


def pair_hashes(words: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of the pairs of words ``apart`` places from each other; of single words if ``apart`` is zero."""
    if not apart:
        return mix(words ^ _U(1))
    return mix(words[:-apart] * _U(_M) + words[apart:]) if len(words) > apart else np.zeros(0, _U)


def shingles_of(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words, repeats included."""
    n = len(words) - k + 1
    out = words[:n].copy()
    for i in range(1, k):
        out = mix(out * _U(_M)) + words[i : n + i]
    return mix(out)
