"""Randomness derived from keys.

Every draw is a function of (seed, key) alone: independent of partitioning,
repeatable after a lost executor, and equal in any engine that has ``md5``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _text(parts) -> Column:
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def digest(*parts) -> Column:
    """md5 of the ``|``-joined parts; its order is the sampling order."""
    return F.md5(_text(parts))


def hash32(*parts) -> Column:
    """First 32 bits of :func:`digest` as a BIGINT."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("bigint")


def hash60(*parts) -> Column:
    """First 60 bits of :func:`digest` as a BIGINT: for positions among more rows than 32 bits can tell apart."""
    return F.conv(F.substring(digest(*parts), 1, 15), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """A number in [0, 1)."""
    return hash32(*parts) / F.lit(TWO32)


def normal(*parts) -> Column:
    """A standard normal by Box-Muller from two hashed uniforms."""
    u1 = (hash32(*parts, "n1") + 1) / F.lit(TWO32)
    u2 = hash32(*parts, "n2") / F.lit(TWO32)
    return F.sqrt(-2.0 * F.ln(u1)) * F.cos(2.0 * math.pi * u2)


def beta_symmetric(alpha: float, *parts, steps: int = 1024) -> Column:
    """A Beta(alpha, alpha) draw: inverse distribution by table and interpolation."""
    import numpy as np

    # the substitution x = sin^2(t) removes both end point poles of the density
    t = np.linspace(0.0, np.pi / 2, 200_001)
    inner = (np.sin(t[1:-1]) * np.cos(t[1:-1])) ** (2 * alpha - 1)
    density = np.concatenate([inner[:1], inner, inner[-1:]])
    mass = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2)])
    grid = np.interp(np.linspace(0, 1, steps + 1), mass / mass[-1], np.sin(t) ** 2)
    table = F.array(*[F.lit(float(v)) for v in grid])
    u = uniform(*parts) * steps
    cell = F.floor(u).cast("int")
    left, right = F.get(table, cell), F.get(table, cell + 1)
    return left + (right - left) * (u - cell)
