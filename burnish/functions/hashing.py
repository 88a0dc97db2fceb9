"""A small integer hash that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2_147_483_647


def mix(value: Column, seed: int = 42) -> Column:
    """Spread whole numbers over [0, 2^31 - 1).

    Two squaring rounds modulo a prime: every product stays below 2^62, so the
    value is the same in any engine with 64-bit integers.
    """
    h = F.pmod(value.cast("long"), F.lit(PRIME)) * F.lit(48_271) + F.lit(seed)
    h = h % PRIME
    h = (h * h + h + F.lit(11)) % PRIME
    return (h * h + F.lit(7) * h + F.lit(13)) % PRIME


def mix_sql(value: str, seed: int = 42) -> str:
    """The same hash as SQL text."""
    p = PRIME
    a = f"((({value}) % {p}) * 48271 + {seed}) % {p}"
    b = f"(({a}) * ({a}) + ({a}) + 11) % {p}"
    return f"(({b}) * ({b}) + 7 * ({b}) + 13) % {p}"
