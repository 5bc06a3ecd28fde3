"""Binomial tests and draws, for any number of trials."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _tail(k: int, n: int) -> float:
    """P(X <= k) for X ~ Binomial(n, 1/2), through the incomplete beta fraction."""
    a, b, x = float(n - k), float(k + 1), 0.5
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a + b) * math.log(0.5)
    )
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b = b, a
    # modified Lentz evaluation; needs O(sqrt(n)) steps, not O(n) terms
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    steps = int(40 * math.sqrt(max(a, b))) + 1000
    for m in range(1, steps):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    else:
        raise ArithmeticError(f"no convergence for {k} of {n}")
    area = front * value / a
    return 1.0 - area if swap else area


def sign_test_value(first: int, second: int) -> float:
    """p-value for ``first`` against ``second`` discordant observations."""
    if first == second:
        return 1.0
    return min(1.0, 2.0 * _tail(min(first, second), first + second))


@F.pandas_udf(DoubleType())
def _sign_test(first: pd.Series, second: pd.Series) -> pd.Series:
    return pd.Series([sign_test_value(int(a), int(b)) for a, b in zip(first, second)])


def sign_test(first: Column, second: Column) -> Column:
    """Exact binomial p-value at 1/2; runs on one row per comparison."""
    return _sign_test(first, second)


# ------------------------------------------------------------------------ draws

#: Below this mean successes are counted by their gaps, above it by rejection.
FEW = 10.0


def key_uniform(*parts) -> float:
    """A number inside (0, 1) with 52 bits, from the md5 of the ``|``-joined parts."""
    digits = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13]
    return (int(digits, 16) + 0.5) / 2.0**52


def stirling_tail(k: float) -> float:
    """ln k! less Stirling's formula for it."""
    if k < 10:
        return math.lgamma(k + 1.0) - (0.5 * math.log(2 * math.pi) + (k + 0.5) * math.log(k + 1.0) - (k + 1.0))
    s = (k + 1.0) * (k + 1.0)
    return (1 / 12.0 - (1 / 360.0 - 1 / 1260.0 / s) / s) / (k + 1.0)


def binomial_draw(n: int, p: float, uniform: Callable[[int, str], float]) -> int:
    """A Binomial(n, p) draw from ``uniform(try, name)``; time does not depend on ``n``.

    Few expected successes are counted by the geometric gaps between them;
    otherwise a transformed uniform is accepted or rejected (Hoermann 1993).
    """
    if n == 0 or p <= 0:
        return 0
    if p >= 1:
        return n
    q = min(p, 1.0 - p)
    x = _by_gaps(n, q, uniform) if n * q < FEW else _by_rejection(n, q, uniform)
    return n - x if p > 0.5 else x


def _by_gaps(n: int, p: float, uniform) -> int:
    at, found, rate = 0, 0, math.log(1.0 - p)
    while True:
        at += math.floor(math.log(uniform(found, "g")) / rate) + 1
        if at > n:
            return found
        found += 1


def _by_rejection(n: int, p: float, uniform) -> int:
    sd = math.sqrt(n * p * (1.0 - p))
    b = 1.15 + 2.53 * sd
    a = -0.0873 + 0.0248 * b + 0.01 * p
    alpha, safe, odds = (2.83 + 5.1 / b) * sd, 0.92 - 4.2 / b, p / (1.0 - p)
    mode = math.floor((n + 1) * p)
    rest = n - mode + 1.0
    top = (mode + 0.5) * math.log((mode + 1.0) / (odds * rest)) + stirling_tail(mode) + stirling_tail(n - mode)
    attempt = 0
    while True:
        u, v = uniform(attempt, "u") - 0.5, uniform(attempt, "v")
        attempt += 1
        us = 0.5 - abs(u)
        k = math.floor((2 * a / us + b) * u + n * p + 0.5)
        if k < 0 or k > n:
            continue
        if us >= 0.07 and v <= safe:
            return k
        left = n - k + 1.0
        bound = top + (n + 1.0) * math.log(rest / left) + (k + 0.5) * math.log(left * odds / (k + 1.0)) - stirling_tail(k) - stirling_tail(n - k)
        if math.log(v * alpha / (a / (us * us) + b)) <= bound:
            return k


def split_draw(n: int, weights: list[int], *key) -> list[int]:
    """A multinomial draw: ``n`` is split in two again and again, by the weights of either half."""
    to = [0]
    for w in weights:
        to.append(to[-1] + w)
    out = [0] * len(weights)
    open_nodes = [(0, len(weights), n)]
    while open_nodes:
        lo, hi, m = open_nodes.pop()
        if hi - lo == 1:
            out[lo] = m
        elif m:
            mid = (lo + hi) // 2
            x = binomial_draw(m, (to[mid] - to[lo]) / (to[hi] - to[lo]), lambda t, name, lo=lo, hi=hi: key_uniform(*key, lo, hi, t, name))
            open_nodes += [(lo, mid, x), (mid, hi, m - x)]
    return out
