"""Numpy kernels for what is sequential or dense by nature; called on one series, frame or small matrix inside a task."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def peaks(v: np.ndarray, distance: int = 1, prominence: float = 0.0) -> np.ndarray:
    """Local maxima (the middle of a plateau), kept from the highest on at ``distance`` or more, then of enough prominence."""
    n, found, i = len(v), [], 1
    while i < n - 1:
        if v[i - 1] < v[i]:
            j = i
            while j < n - 1 and v[j + 1] == v[i]:
                j += 1
            if j < n - 1 and v[j + 1] < v[i]:
                found.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    at = np.array(found, dtype=int)
    keep = np.ones(len(at), bool)
    for k in np.argsort(v[at], kind="stable")[::-1]:
        if keep[k]:
            keep &= (np.abs(at - at[k]) >= distance) | (np.arange(len(at)) == k)
    at = at[keep]
    if prominence <= 0:
        return at
    out = []
    for p in at:
        higher = np.flatnonzero(v[:p] > v[p])
        left = v[(higher[-1] + 1 if len(higher) else 0) : p + 1].min()
        higher = np.flatnonzero(v[p + 1 :] > v[p])
        right = v[p : (p + 1 + higher[0] if len(higher) else n)].min()
        if v[p] - max(left, right) >= prominence:
            out.append(p)
    return np.array(out, dtype=int)


def butterworth(fs: float, cutoff: float, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a without its leading 1) of a Butterworth high-pass; an odd order ends in one of first order."""
    k, sections = np.tan(np.pi * cutoff / fs), []
    for i in range(order // 2):
        damping = 2 * np.sin((2 * i + 1) * np.pi / (2 * order))
        d = 1 + damping * k + k * k
        sections.append((np.array([1.0, -2.0, 1.0]) / d, np.array([2 * (k * k - 1), 1 - damping * k + k * k]) / d))
    if order % 2:
        sections.append((np.array([1.0, -1.0, 0.0]) / (1 + k), np.array([k - 1, 0.0]) / (1 + k)))
    return sections


def settled(sections: list) -> np.ndarray:
    """The states in which a constant 1 leaves the sections: no constant passes the first, so the others are at rest."""
    b, a = sections[0]
    out = np.zeros((len(sections), 2))
    out[0] = np.linalg.solve(np.array([[1 + a[0], -1.0], [a[1], 1.0]]), b[1:] - a * b[0])
    return out


@lru_cache(maxsize=512)
def _block(b: tuple[float, ...], a: tuple[float, ...], n: int) -> tuple[np.ndarray, ...]:
    """Of a section and ``n`` samples: output from input, output from the state, state from input, state from the state."""
    step, drive = np.array([[-a[0], 1.0], [-a[1], 0.0]]), np.array([b[1] - a[0] * b[0], b[2] - a[1] * b[0]])
    powers = np.empty((n + 1, 2, 2))
    powers[0] = np.eye(2)
    for k in range(n):
        powers[k + 1] = step @ powers[k]
    pulse = np.concatenate([[b[0]], powers[: n - 1, 0] @ drive])
    lag = np.subtract.outer(np.arange(n), np.arange(n))
    return np.where(lag >= 0, pulse[np.abs(lag)], 0.0), powers[:n, 0], (powers[n - 1 :: -1] @ drive).T if n else np.zeros((2, 0)), powers[n]


def through(sections: list, x: np.ndarray, state: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """One series, or the columns of several (time first), through the sections from a state (sections x 2, or x 2 x columns), and the state after it.

    A section is linear: in a block of samples the output is a fixed matrix times the input plus what the state at its start leaves, so only the states go from block to block one by one.
    """
    flat = x.ndim == 1
    s, ends = np.asarray(x, dtype=float).reshape(len(x), -1), []
    for (b, a), z in zip(sections, state):
        z, out = z.reshape(2, -1) * np.ones((1, s.shape[1])), np.empty_like(s)
        for start in range(0, len(s), block):
            u = s[start : start + block]
            reply, free, push, step = _block(tuple(map(float, b)), tuple(map(float, a)), len(u))
            out[start : start + block] = reply @ u + free @ z
            z = step @ z + push @ u
        s = out
        ends.append(z[:, 0] if flat else z)
    return s[:, 0] if flat else s, np.array(ends)


def highpass(x: np.ndarray, fs: float, cutoff: float, order: int = 2, padlen: int | None = None) -> np.ndarray:
    """Butterworth high-pass along the last axis, forward and backward, for all series at once; ends extended oddly, state settled.

    ``padlen`` is the length of the extension, by default three times ``order + 1``; series too short for it get a shorter one.
    """
    n = x.shape[-1]
    if n < 2:
        return np.zeros(x.shape)
    sections, pad = butterworth(fs, cutoff, order), extension(n, order, padlen)
    x = np.moveaxis(np.asarray(x, dtype=float), -1, 0)
    shape, x = x.shape, x.reshape(n, -1)
    s = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        s = through(sections, s, settled(sections)[:, :, None] * s[0])[0][::-1]
    return np.moveaxis(s[pad : pad + n].reshape(shape), 0, -1)


def extension(n: int, order: int, padlen: int | None) -> int:
    """Samples that each end of a series of ``n`` gets."""
    return min(3 * (order + 1) if padlen is None else padlen, n - 1)


def gauss(x: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    n = len(x)
    j = np.mod(np.arange(-r, n + r), 2 * n)
    return np.convolve(x[np.where(j >= n, 2 * n - 1 - j, j)], w / w.sum(), "valid")


def phase_shift(ref: np.ndarray, img: np.ndarray, upsample: int = 20) -> tuple[float, float]:
    """(x, y) by which ``img`` must move to lie on ``ref``: the peak of the phase correlation, refined by a small Fourier sum."""
    f = np.fft.fft2(ref) * np.conj(np.fft.fft2(img))
    f /= np.maximum(np.abs(f), 1e-12)
    c = np.abs(np.fft.ifft2(f))
    at = np.array(np.unravel_index(c.argmax(), c.shape), float)
    size = np.array(c.shape)
    at = np.where(at > size // 2, at - size, at)
    if upsample > 1:
        steps = np.arange(-upsample, upsample + 1) / upsample
        ys, xs = at[0] + steps, at[1] + steps
        ky, kx = np.fft.fftfreq(size[0]), np.fft.fftfreq(size[1])
        fine = np.abs(np.exp(2j * np.pi * np.outer(ys, ky)) @ f @ np.exp(2j * np.pi * np.outer(kx, xs)))
        i, j = np.unravel_index(fine.argmax(), fine.shape)
        at = np.array([ys[i], xs[j]])
    return float(at[1]), float(at[0])


def warp(img: np.ndarray, m: np.ndarray, fill: float = 0.0) -> np.ndarray:
    """Apply a 2 x 3 affine matrix (source to target) by inverse mapping with bilinear weights."""
    h, w = img.shape
    inv = np.linalg.inv(np.vstack([m, [0, 0, 1]]))
    y, x = np.mgrid[0:h, 0:w]
    sx = inv[0, 0] * x + inv[0, 1] * y + inv[0, 2]
    sy = inv[1, 0] * x + inv[1, 1] * y + inv[1, 2]
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros(img.shape)
    for dy in (0, 1):
        for dx in (0, 1):
            xi, yi = x0 + dx, y0 + dy
            weight = (1 - np.abs(sx - xi)) * (1 - np.abs(sy - yi))
            inside = (xi >= 0) & (xi < w) & (yi >= 0) & (yi < h)
            out += weight * np.where(inside, img[np.clip(yi, 0, h - 1), np.clip(xi, 0, w - 1)], fill)
    return out


def blur(img: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    if sigma <= 0:
        return img
    rows = np.apply_along_axis(gauss, 0, img, sigma, truncate)
    return np.apply_along_axis(gauss, 1, rows, sigma, truncate)


def area_mean(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """h x w pixels, fewer or more, each the mean of the area it covers; a pixel cut by a border counts in part."""

    def shares(n: int, m: int) -> np.ndarray:
        edge, at = np.arange(m + 1) * n / m, np.arange(n)
        return np.maximum(np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at), 0) * m / n

    return shares(img.shape[0], h) @ img @ shares(img.shape[1], w).T


def student_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|) of Student's t: the regularised incomplete beta function by its continued fraction; NaN for a missing value."""
    from math import erfc, exp, inf, isnan, lgamma, log

    if t is None or dof is None or isnan(t) or isnan(dof) or dof <= 0:
        return float("nan")
    if abs(t) == inf:
        return 0.0
    if dof == inf:
        return erfc(abs(t) / 2**0.5)
    a, b, x = dof / 2, 0.5, dof / (dof + t * t)
    if x >= 1:
        return 1.0
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = (b, a, 1 - x) if swap else (a, b, x)
    c, d = 1.0, 1 / (1 - (p + q) * z / (p + 1) or 1e-300)
    f = d
    for i in range(1, 500):
        for u in (i * (q - i) * z / ((p + 2 * i - 1) * (p + 2 * i)), -(p + i) * (p + q + i) * z / ((p + 2 * i) * (p + 2 * i + 1))):
            d = 1 / (1 + u * d or 1e-300)
            c = 1 + u / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    part = exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * log(z) + q * log(1 - z)) * f / p
    return 1 - part if swap else part


def student_limit(p: float, dof: float) -> float:
    """The t that is passed, on either side, with probability ``p``."""
    low, high = 0.0, 2.0
    while student_two_sided(high, dof) > p and high < 1e12:
        low, high = high, high * 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if student_two_sided(middle, dof) > p else (low, middle)
    return (low + high) / 2
