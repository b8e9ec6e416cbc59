"""Numpy helpers for one decoded image: channel order, grey, separable Lanczos resampling."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# The library defaults the hashes are compared under.
GREY_WEIGHTS = (19595, 38470, 7471)  # R, G, B in 1/65536, rounded half up
LANCZOS_LOBES = 3
WEIGHT_BITS = 22  # fixed-point bits of a resampling weight for 8-bit channels
HASH_SIDE = 8


def decode(image) -> np.ndarray:
    """Height x width x 3 RGB bytes from an image-source row (stored as BGR / BGRA / grey)."""
    raw = np.frombuffer(image.data, dtype=np.uint8)
    raw = raw.reshape(image.height, image.width, image.nChannels)
    if image.nChannels == 1:
        return np.repeat(raw, 3, axis=2)
    return raw[:, :, 2::-1]


def grey(rgb: np.ndarray) -> np.ndarray:
    weighted = rgb.astype(np.int64) @ np.array(GREY_WEIGHTS, dtype=np.int64)
    return ((weighted + (1 << 15)) >> 16).astype(np.uint8)


@lru_cache(maxsize=64)
def _weights(source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """First source pixel of each output, and its fixed-point Lanczos weights (target x taps, zeros at the end).

    An output reads only the pixels within reach, so the table has target * (6 * scale + 2) numbers at most.
    """
    scale = source / target
    stretch = max(scale, 1.0)
    reach = LANCZOS_LOBES * stretch
    middle = (np.arange(target) + 0.5) * scale
    first = np.maximum((middle - reach + 0.5).astype(np.int64), 0)
    last = np.minimum((middle + reach + 0.5).astype(np.int64), source)
    table = np.zeros((target, int((last - first).max())))
    for out in range(target):
        at = (np.arange(first[out], last[out]) - middle[out] + 0.5) / stretch
        w = np.where(np.abs(at) < LANCZOS_LOBES, np.sinc(at) * np.sinc(at / LANCZOS_LOBES), 0.0)
        w = w / w.sum()
        table[out, : len(at)] = np.trunc(w * (1 << WEIGHT_BITS) + np.copysign(0.5, w))
    return first, table


def _pass(pixels: np.ndarray, target: int) -> np.ndarray:
    """Resample axis 1 of an h x w x c byte array, rounding to bytes."""
    source = pixels.shape[1]
    if source == target:
        return pixels
    first, table = _weights(source, target)
    # whole numbers below 2**53 in every sum, so floats are exact
    total = np.full((pixels.shape[0], target, pixels.shape[2]), float(1 << (WEIGHT_BITS - 1)))
    for tap in range(table.shape[1]):
        total += table[:, tap, None] * pixels[:, np.minimum(first + tap, source - 1)]
    return np.clip(np.floor(total / (1 << WEIGHT_BITS)), 0, 255).astype(np.uint8)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Lanczos resize of h x w x c (or h x w) bytes: rows first, then columns."""
    flat = pixels.ndim == 2
    cube = pixels[:, :, None] if flat else pixels
    cube = _pass(cube, width)
    cube = _pass(cube.transpose(1, 0, 2), height).transpose(1, 0, 2)
    return cube[:, :, 0] if flat else np.ascontiguousarray(cube)


def resize_nearest(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Plain nearest-pixel resize, as fixed-size model inputs are loaded."""
    rows = ((np.arange(height) + 0.5) * pixels.shape[0] / height).astype(int)
    cols = ((np.arange(width) + 0.5) * pixels.shape[1] / width).astype(int)
    return np.ascontiguousarray(pixels[rows][:, cols])


def average_hash_hex(rgb: np.ndarray, side: int = HASH_SIDE) -> str:
    small = resize(grey(rgb), side, side).astype(np.float64)
    bits = (small > small.mean()).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):0{side * side // 4}x}"
