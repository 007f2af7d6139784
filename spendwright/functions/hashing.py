"""Deterministic SHA-256 bucketing inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNKS = 8  # a SHA-256 digest is eight 32-bit words
_WORD = 1 << 32


def sha256_bucket(text: Column, n_buckets: int) -> Column:
    """SHA-256 of ``text`` as one big integer, modulo ``n_buckets``.

    Horner's rule over the 32-bit words of the digest; every step stays below
    ``n_buckets * 2**32``, which must fit a signed long.
    """
    if not 1 <= n_buckets < (1 << 31):
        raise ValueError("n_buckets must be in [1, 2**31)")
    digest = F.sha2(text, 256)
    acc = F.lit(0).cast("bigint")
    for i in range(_CHUNKS):
        word = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")
        acc = (acc * F.lit(_WORD) + word) % F.lit(n_buckets)
    return acc


def _digits(cols: tuple[Column, ...], seed: int, n: int) -> Column:
    """The first ``n`` hexadecimal digits of the SHA-256 of values and seed, as a long."""
    text = F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.sha2(text, 256), 1, n), 16, 10).cast("bigint")


def _digits_sql(cols: Sequence[str], seed: int, n: int) -> str:
    texts = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"CAST('0x' || substr(sha256(concat_ws('|', {texts}, '{seed}')), 1, {n}) AS BIGINT)"


def unit_interval(*cols: Column, seed: int) -> Column:
    """A uniform double in [0, 1) that depends only on the values and the seed."""
    return _digits(cols, seed, 12).cast("double") * F.lit(2.0**-48)


def unit_interval_sql(cols: Sequence[str], seed: int) -> str:
    """The same as SQL."""
    return f"({_digits_sql(cols, seed, 12)} / 281474976710656.0)"


HASH_BITS = 60


def hash_order(*cols: Column, seed: int) -> Column:
    """A long of ``HASH_BITS`` bits to order rows by."""
    return _digits(cols, seed, HASH_BITS // 4)


def hash_order_sql(cols: Sequence[str], seed: int) -> str:
    """The same as SQL."""
    return _digits_sql(cols, seed, HASH_BITS // 4)


def standard_normal(*cols: Column, seed: int) -> Column:
    """A standard normal draw from two hashed uniforms (Box-Muller)."""
    u1 = F.greatest(unit_interval(*cols, seed=2 * seed), F.lit(2.0**-53))
    u2 = unit_interval(*cols, seed=2 * seed + 1)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def standard_normal_sql(cols: Sequence[str], seed: int) -> str:
    """The same as SQL."""
    u1 = f"greatest({unit_interval_sql(cols, 2 * seed)}, 1.1102230246251565e-16)"
    return f"(sqrt(-2.0 * ln({u1})) * cos(6.283185307179586 * {unit_interval_sql(cols, 2 * seed + 1)}))"
