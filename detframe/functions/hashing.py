"""Seeded, order-free randomness: a value depends on the seed and the row's keys, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MIX = 2147483647
_WIDTH = 1 << 31
_FOLD = 40503  # so that ids that agree modulo the prime differ


def _part(key: Column) -> Column:
    key = key.cast("long")
    return F.pmod(F.pmod(key, F.lit(_MIX)) + F.pmod(F.shiftright(key, 30), F.lit(_MIX)) * F.lit(_FOLD), F.lit(_MIX))


def _start(seed: int) -> int:
    return (seed * 7919 + 17) % _MIX


def hash_key(seed: int, *keys: Column) -> Column:
    """A non-negative 62-bit key built from integer arithmetic, so SQL engines can reproduce it.

    The upper half mixes multiply-adds modulo the prime 2^31 - 1, the lower half is one linear step over all keys, which
    keeps the expression short; nothing overflows a long.
    """
    state, linear = F.lit(_start(seed)).cast("long"), F.lit(_start(seed)).cast("long")
    for i, key in enumerate(keys):
        state = F.pmod(state * F.lit(48271) + _part(key), F.lit(_MIX))
        state = F.pmod(state * F.lit(69621) + F.lit(12345), F.lit(_MIX))
        state = F.pmod(F.pmod(state, F.lit(46337)) * F.lit(44017) + F.floor(state / F.lit(46337)).cast("long")
                       * F.lit(30323), F.lit(_MIX))
        linear = linear + _part(key) * F.lit(30011 + 4 * i)
    return state * F.lit(_WIDTH) + F.pmod(F.pmod(linear, F.lit(_MIX)) * F.lit(69621) + F.lit(12345), F.lit(_MIX))


def uniform(seed: int, *keys: Column) -> Column:
    """Uniform double in [0, 1) from integer keys."""
    return hash_key(seed, *keys) / F.lit(float(_WIDTH) ** 2)


def text_key(seed: int, *keys: Column) -> Column:
    """As :func:`hash_key` for keys of any type."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 2)


def hash_key_sql(seed: int, *keys: str) -> str:
    """The same key as plain SQL text, for checks in another engine."""
    state, linear = (f"CAST({_start(seed)} AS BIGINT)" for _ in range(2))
    for i, key in enumerate(keys):
        long = f"CAST({key} AS BIGINT)"
        part = f"(({long} % {_MIX} + ({long} >> 30) % {_MIX} * {_FOLD}) % {_MIX})"
        state = f"((({state}) * 48271 + {part}) % {_MIX})"
        state = f"((({state}) * 69621 + 12345) % {_MIX})"
        state = f"((({state}) % 46337 * 44017 + (({state}) // 46337) * 30323) % {_MIX})"
        linear = f"{linear} + {part} * {30011 + 4 * i}"
    return f"({state} * {_WIDTH} + ((({linear}) % {_MIX}) * 69621 + 12345) % {_MIX})"


def uniform_sql(seed: int, *keys: str) -> str:
    return f"({hash_key_sql(seed, *keys)} / CAST({_WIDTH ** 2} AS DOUBLE))"
