"""Deterministic mixing of integers with Column arithmetic; nothing here depends on rand() or an engine's own hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplier and modulus of the bijection on 32-bit ids.
MULTIPLIER, MODULUS = 2654435761, 4294967296


def priority(column: Column | str) -> Column:
    """A permutation of 32-bit ids that orders them as if at random; no ties."""
    c = F.col(column) if isinstance(column, str) else column
    return F.pmod(c.cast("long") * F.lit(MULTIPLIER), F.lit(MODULUS))


def ith_rand(i: Column, state: int = 0) -> Column:
    """Counter-based random number of 32 bits: splittable by the state."""
    x = F.pmod((i.cast("long") + F.lit(state)) * F.lit(MULTIPLIER), F.lit(MODULUS))
    x = F.pmod((x.bitwiseXOR(F.shiftright(x, 15))) * F.lit(73244475), F.lit(MODULUS))
    return F.pmod((x.bitwiseXOR(F.shiftright(x, 13))) * F.lit(41211551), F.lit(MODULUS))


def fork(state: int, i: int) -> int:
    """The state of an independent stream."""
    return (state * MULTIPLIER + i * 97 + 12345) % MODULUS


def mix32(i: Column, state: int = 0) -> Column:
    return ith_rand(i, state)


def mix64(i: Column, state: int = 0) -> Column:
    """Two independent halves side by side, kept under 2^62."""
    return ith_rand(i, state) * F.lit(1 << 30) + F.shiftright(ith_rand(i, fork(state, 1)), 2)
