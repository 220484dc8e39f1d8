"""Gamma-related functions and hash-drawn numbers for numpy arrays, used inside tasks."""

from __future__ import annotations

import numpy as np

# Series are taken at x + 6, where seven terms are exact to about 1e-12.
_STEPS = np.arange(6.0)


def digamma(x: np.ndarray) -> np.ndarray:
    y = x + 6.0
    u = 1.0 / (y * y)
    series = u * (1 / 12 - u * (1 / 120 - u * (1 / 252 - u * (1 / 240 - u * (1 / 132 - u * (691 / 32760))))))
    # The sum of 1 / (x + i) for i from 0 to 5 as one fraction; all its parts are positive.
    z = x * (x + 5.0)
    return np.log(y) - 0.5 / y - series - (2.0 * x + 5.0) * ((3.0 * z + 20.0) * z + 24.0) / (((z + 10.0) * z + 24.0) * z)


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp(digamma(x)): `digamma` with one transcendental function in place of two, and in place."""
    y = x + 6.0
    half = 0.5 / y
    u = half * half
    u *= 4.0
    out = u * (691 / 32760)
    for term in (-1 / 132, 1 / 240, -1 / 252, 1 / 120, -1 / 12):
        out += term
        out *= u
    # The sum of 1 / (x + i) for i from 0 to 5, as in `digamma`.
    z = x + 5.0
    z *= x
    above = z * 3.0
    above += 20.0
    above *= z
    above += 24.0
    below = z + 10.0
    below *= z
    below += 24.0
    below *= z
    above /= below
    z = x + x
    z += 5.0
    above *= z
    out -= half
    out -= above
    np.exp(out, out=out)
    out *= y
    return out


def trigamma(x: np.ndarray) -> np.ndarray:
    y = x + 6.0
    u = 1.0 / (y * y)
    series = u / y * (1 / 6 - u * (1 / 30 - u * (1 / 42 - u * (1 / 30 - u * (5 / 66)))))
    return 1.0 / y + 0.5 * u + series + (1.0 / np.square(x[..., None] + _STEPS)).sum(axis=-1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 6.0
    u = 1.0 / (y * y)
    series = (1 / 12 - u * (1 / 360 - u * (1 / 1260 - u * (1 / 1680 - u * (1 / 1188))))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(x[..., None] + _STEPS).sum(axis=-1)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers whose bits all depend on all bits of `x`; distinct for distinct `x`."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gamma_drawn(numbers: np.ndarray, shape: float) -> np.ndarray:
    """For each number a value that follows a gamma distribution with this shape and the mean 1.

    The same number gives the same value in any task. A normal deviate is made from 64 hashed bits
    and cubed (the approximation of Wilson and Hilferty).
    """
    bits = mixed(numbers)
    first = ((bits >> np.uint64(32)).astype(float) + 0.5) / 2**32
    second = ((bits & np.uint64(0xFFFFFFFF)).astype(float) + 0.5) / 2**32
    normal = np.sqrt(-2 * np.log(first)) * np.cos(2 * np.pi * second)
    return (1 - 1 / (9 * shape) + normal / np.sqrt(9 * shape)) ** 3
