"""Random draws as arithmetic, which columns, arrays and SQL texts share: the same number wherever and however often it is drawn."""

from __future__ import annotations

PRIME = 2147483647


def key(i, k, epoch, seed: int):
    """A number below PRIME from places (of a sample, a class, a round) and a seed: columns, arrays or numbers of 64 bits."""
    a = ((i + 1) * 48271 + (epoch + 1) * 7919 + seed * 104729) % PRIME
    b = (a * a + (k + 1) * 69621) % PRIME
    c = (b * b + a) % PRIME
    return (c * c + 11) % PRIME


def key_sql(i: str, k: str, epoch: str, seed: int) -> str:
    a = f"(({i} + 1) * 48271 + ({epoch} + 1) * 7919 + {seed * 104729}) % {PRIME}"
    b = f"((({a}) * ({a}) + ({k} + 1) * 69621) % {PRIME})"
    c = f"(({b} * {b} + {a}) % {PRIME})"
    return f"(({c} * {c} + 11) % {PRIME})"


def uniform(i, k, epoch, seed: int):
    """A number between 0 and 1."""
    return (key(i, k, epoch, seed) + 0.5) / PRIME


def uniform_sql(i: str, k: str, epoch: str, seed: int) -> str:
    return f"(({key_sql(i, k, epoch, seed)} + 0.5::DOUBLE) / {PRIME})"
