"""Windowed-sinc resampling of 8-bit images, widened when an image shrinks.

Each axis is one matrix product with weights made once per pair of sizes. The
weights are fixed-point numbers of 22 bits and every sum is rounded and clipped to
8 bits, so results are whole numbers that do not depend on the order of sums.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np

BITS = 22  # of a weight; a weighted sum of 8-bit samples stays far below 2^53
LOBES = 3  # of the window, at scale 1


def _kernel(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < LOBES, np.sinc(x) * np.sinc(x / LOBES), 0.0)


@lru_cache(maxsize=64)
def axis_weights(n_in: int, n_out: int) -> np.ndarray:
    """(n_out, n_in) whole-number weights of the samples of one axis."""
    scale = n_in / n_out
    wide = max(scale, 1.0)  # shrinking widens the window over all samples it stands for
    centre = (np.arange(n_out) + 0.5) * scale
    lo = np.maximum((centre - LOBES * wide + 0.5).astype(int), 0)
    hi = np.minimum((centre + LOBES * wide + 0.5).astype(int), n_in)
    at = np.arange(n_in)[None, :]
    w = np.where((at >= lo[:, None]) & (at < hi[:, None]), _kernel((at - centre[:, None] + 0.5) / wide), 0.0)
    w = w / w.sum(axis=1, keepdims=True) * (1 << BITS)
    return np.trunc(w + np.where(w < 0, -0.5, 0.5))


def _along_rows(img: np.ndarray, n_out: int) -> np.ndarray:
    """(n, n_in, c) uint8 -> (n, n_out, c) uint8."""
    n, n_in, c = img.shape
    sums = axis_weights(n_in, n_out) @ img.transpose(1, 0, 2).reshape(n_in, n * c).astype(np.float64)
    sums += 1 << (BITS - 1)  # in place: fresh pages for every step cost more than the sums
    sums *= 1 / (1 << BITS)  # a power of two: exact
    np.clip(np.floor(sums, out=sums), 0, 255, out=sums)
    return sums.astype(np.uint8).reshape(n_out, n, c).transpose(1, 0, 2)


def resize_lanczos(img: np.ndarray, out_h: int, out_w: int) -> np.ndarray:
    """(h, w, c) uint8 to (out_h, out_w, c) uint8: columns, then rows."""
    h, w = img.shape[:2]
    if w != out_w:
        img = _along_rows(img, out_w)
    if h != out_h:
        img = _along_rows(img.transpose(1, 0, 2), out_h).transpose(1, 0, 2)
    return img
