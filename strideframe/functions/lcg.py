"""Seeded integer hashing that any SQL engine can repeat: two steps of a Lehmer generator."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2_147_483_647


def mixed(key: Column, seed) -> Column:
    """Pseudo-random whole number below MODULUS; intermediate products stay inside 64 bits."""
    seed = F.lit(seed) if not isinstance(seed, Column) else seed
    first = ((key % MODULUS) * 48271 + seed * 40692 + 1) % MODULUS
    return ((first * 69621) % MODULUS * 16807) % MODULUS


def mixed_values(key: np.ndarray, seed: int) -> np.ndarray:
    """The same numbers from 64-bit keys, none negative."""
    first = ((key % MODULUS) * 48271 + seed * 40692 + 1) % MODULUS
    return ((first * 69621) % MODULUS * 16807) % MODULUS


def mixed_sql(key: str, seed) -> str:
    return f"(((((({key}) % {MODULUS}) * 48271 + ({seed}) * 40692 + 1) % {MODULUS}) * 69621) % {MODULUS} * 16807) % {MODULUS}"
