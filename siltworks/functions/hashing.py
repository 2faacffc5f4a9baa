"""Hash functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (a, b, p) of the stream hashes and the length of the Bloom filter.
STREAM_HASHES = ((1734545623, 3475864383, 426131), (1734545623, 3475864383, 434297), (9287583, 8264892, 491591))
BLOOM_BITS = 69997
MERSENNE_31 = 2147483647


def bytes_modulo(text: Column, p: int) -> Column:
    """The UTF-8 bytes of a string, read as one big-endian number, modulo p."""
    coded = F.hex(F.encode(text, "UTF-8"))
    places = F.sequence(F.lit(1), F.length(coded) - 1, F.lit(2))
    digits = F.when(F.length(coded) > 0, F.transform(places, lambda i: F.conv(F.substring(coded, i, F.lit(2)), 16, 10).cast("long")))
    return F.coalesce(F.aggregate(digits, F.lit(0).cast("long"), lambda acc, x: (acc * 256 + x) % p), F.lit(0).cast("long"))


def stream_hash(text: Column, which: int) -> Column:
    a, b, p = STREAM_HASHES[which]
    return (F.lit(a).cast("long") * bytes_modulo(text, p) + F.lit(b).cast("long")) % p


def trailing_zeros(x: Column) -> Column:
    """Trailing zero bits; 1 for 0, whose binary string is a single zero."""
    return F.when(x == 0, F.lit(1)).otherwise(F.bit_count(x.bitwiseAND(-x) - 1))


def unit_interval(n: Column, first_digit: int) -> Column:
    """A number in [0, 1) from eight hexadecimal digits of the MD5 of a number's decimal form."""
    return F.conv(F.substring(F.md5(n.cast("string").cast("binary")), first_digit, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def affine(x: Column, j: int) -> Column:
    """The j-th affine hash of a small non-negative number."""
    a, b = 1103515245 + 40692 * j, 12345 + 16807 * j
    return (F.lit(a).cast("long") * x + F.lit(b).cast("long")) % MERSENNE_31
