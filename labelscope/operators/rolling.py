"""Rolling fingerprints of sequences: equal stretches are found without comparing rows pair by pair.

A row at place ``i`` of a recording has the token ``t``; the fingerprint of a stretch is the sum
of ``t * BASE**i`` modulo two primes. From sums up to every place, the fingerprint of any
stretch is one difference, so all stretches of a length are compared with a given one by
one equi-join of the sums with themselves, whatever values repeat.

Sums up to a place are made of sums inside blocks of ``BLOCK`` places and of blocks before, so
no window holds more than a block's rows, or one row for each block of a recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Primes below 2**31, so that products fit a long, and the base of the powers.
PRIMES = (2_147_483_647, 2_147_483_629)
BASE = 1_000_003
BLOCK = 4096
#: Bits of a block's number.
BLOCK_BITS = 24
EACH = range(len(PRIMES))


def _power(exponent: Column, base: int, prime: int, bits: int) -> Column:
    """``base**exponent`` modulo ``prime``, of an exponent of up to ``bits`` bits."""
    out, factor = F.lit(1).cast("long"), base % prime
    for bit in range(bits):
        out = out * F.when(exponent.bitwiseAND(F.lit(1 << bit).cast("long")) != 0, F.lit(factor).cast("long")).otherwise(F.lit(1).cast("long")) % prime
        factor = factor * factor % prime
    return out


def _inside(rows: DataFrame, by: list[str], block: int) -> DataFrame:
    """(by, i, _block, p, t) of ``rows``: the powers of the places in their block (a table of ``block`` rows), and the terms with these."""
    powers = rows.sparkSession.range(block).select(F.col("id").alias("_low"), *[_power(F.col("id"), BASE, p, block.bit_length()).alias(f"p{k}") for k, p in enumerate(PRIMES)])
    placed = rows.select(*by, "i", "token", F.floor(F.col("i") / block).alias("_block"), (F.col("i") % block).alias("_low")).join(F.broadcast(powers), "_low")
    terms = [(F.pmod(F.col("token"), F.lit(p).cast("long")) * F.col(f"p{k}") % p).alias(f"t{k}") for k, p in enumerate(PRIMES)]
    return placed.select(*by, "i", "_block", *[f"p{k}" for k in EACH], *terms)


def _blocks(inside: DataFrame, by: list[str], block: int) -> DataFrame:
    """(by, _block, s, w): the sums of whole blocks, powers of the blocks included, and these powers; a row a block."""
    sums = inside.groupBy(*by, "_block").agg(F.count("*").alias("_rows"), *[F.sum(f"t{k}").alias(f"s{k}") for k in EACH])
    powered = sums.select("*", *[_power(F.col("_block"), pow(BASE, block, p), p, BLOCK_BITS).alias(f"w{k}") for k, p in enumerate(PRIMES)])
    return powered.select(*by, "_block", "_rows", *[(F.col(f"s{k}") % p * F.col(f"w{k}") % p).alias(f"s{k}") for k, p in enumerate(PRIMES)], *[f"w{k}" for k in EACH])


def prefixes(rows: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """(by, i, h0, h1, q0, q1) of ``rows`` (by, i, token long): sums of the terms of all places up to ``i``, and ``BASE**(i + 1)``, modulo each prime."""
    inside = _inside(rows, by, block)
    upto = Window.partitionBy(*by, "_block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = _blocks(inside, by, block).select(*by, "_block", *[f"w{k}" for k in EACH], *[(F.coalesce(F.sum(f"s{k}").over(before), F.lit(0)) % p).alias(f"b{k}") for k, p in enumerate(PRIMES)])
    sums = inside.select(*by, "i", "_block", *[f"p{k}" for k in EACH], *[F.sum(f"t{k}").over(upto).alias(f"r{k}") for k in EACH])
    joined = sums.join(bases, [*by, "_block"])
    held = [((F.col(f"r{k}") % p * F.col(f"w{k}") + F.col(f"b{k}")) % p).alias(f"h{k}") for k, p in enumerate(PRIMES)]
    return joined.select(*by, "i", *held, *[(F.col(f"p{k}") * F.col(f"w{k}") % p * BASE % p).alias(f"q{k}") for k, p in enumerate(PRIMES)])


def fingerprint(rows: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """(by, length, f0, f1) of ``rows`` (by, i from 0 without gaps, token): the fingerprint of each whole sequence."""
    return _blocks(_inside(rows, by, block), by, block).groupBy(*by).agg(F.sum("_rows").alias("length"), *[(F.sum(f"s{k}") % p).alias(f"f{k}") for k, p in enumerate(PRIMES)])


def occurrences(sums: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """(by, offset) of the stretches of ``sums`` (from ``prefixes``) whose fingerprint is that of ``wanted`` (from ``fingerprint``).

    As many rows as a recording has places are compared. Different stretches have equal
    fingerprints with a chance of about 2**-61.
    """
    ends = sums.join(wanted, by).filter("i >= length - 1").select(*by, (F.col("i") - F.col("length") + 1).alias("offset"), *[f"h{k}" for k in EACH], *[f"f{k}" for k in EACH])
    starts = sums.select(*by, (F.col("i") + 1).alias("offset"), *[F.col(f"h{k}").alias(f"g{k}") for k in EACH], *[f"q{k}" for k in EACH])
    both = ends.join(starts, [*by, "offset"], "left")
    same = F.lit(True)
    for k, p in enumerate(PRIMES):
        same = same & (F.pmod(F.col(f"h{k}") - F.coalesce(F.col(f"g{k}"), F.lit(0)), F.lit(p).cast("long")) == F.col(f"f{k}") * F.coalesce(F.col(f"q{k}"), F.lit(1)) % p)
    return both.filter(same).select(*by, "offset")
