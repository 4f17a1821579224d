"""Pseudorandom draws from integers, the same in DataFrame expressions, numpy and SQL.

A number is scaled, squared and scaled again modulo a prime, so that draws of neighbouring numbers have
nothing in common; every step stays below 2**63.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws are from 0 to PRIME - 1.
PRIME = 2_147_483_647
FIRST, SALT, LAST = 1_103_515_245, 69_621_007, 48_271


def draw(x: Column, salt: int) -> Column:
    """A draw for each non-negative number; other salts give other draws."""
    one = (x % PRIME * FIRST + salt * SALT) % PRIME
    return ((one * one) % PRIME * LAST + one) % PRIME


def draws(x: np.ndarray, salt: int) -> np.ndarray:
    """The same for an array."""
    one = (x.astype(np.int64) % PRIME * FIRST + salt * SALT) % PRIME
    return ((one * one) % PRIME * LAST + one) % PRIME


def draw_sql(x: str, salt: int) -> str:
    """The same as an SQL expression."""
    one = f"((CAST({x} AS BIGINT) % {PRIME} * {FIRST} + {salt * SALT}) % {PRIME})"
    return f"(({one} * {one} % {PRIME} * {LAST} + {one}) % {PRIME})"
