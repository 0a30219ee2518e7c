"""Fingerprints: file digests, 64-bit perceptual hashes as hexadecimal text, and their distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def is_hash(text: Column) -> Column:
    """Up to 16 hexadecimal digits; anything else takes no part in comparisons."""
    return F.coalesce(text, F.lit("")).rlike("^[0-9a-fA-F]{1,16}$")


def half(text: Column, which: int) -> Column:
    """The upper (0) or lower (1) 32 bits of a hash, as a long: all 64 don't fit one without a sign."""
    return F.conv(F.substring(F.lpad(F.lower(text), 16, "0"), 1 + 8 * which, 8), 16, 10).cast("long")


def with_halves(df: DataFrame, text: str = "phash") -> DataFrame:
    """df's rows with a valid hash, with its halves as hi and lo."""
    return df.where(is_hash(F.col(text))).withColumn("hi", half(F.col(text), 0)).withColumn("lo", half(F.col(text), 1))


def distance(a: str, b: str) -> Column:
    """Bits that differ between rows aliased a and b that have hi and lo."""
    return F.bit_count(F.col(f"{a}.hi").bitwiseXOR(F.col(f"{b}.hi"))) + F.bit_count(F.col(f"{a}.lo").bitwiseXOR(F.col(f"{b}.lo")))


def sign_hash(vector: Column) -> Column:
    """16 hexadecimal digits for a vector of 64 numbers: a bit is set where a number is above the vector's median, the first bit highest."""
    v = vector.cast("array<double>")
    ordered = F.sort_array(v)
    median = (F.element_at(ordered, 32) + F.element_at(ordered, 33)) / 2
    bits = lambda at, m: F.aggregate(F.slice(v, at, 32), F.lit(0).cast("long"), lambda acc, x: acc * 2 + F.when(x > m, 1).otherwise(0))
    digits = lambda at, m: F.lpad(F.lower(F.hex(bits(at, m))), 8, "0")
    # bound once: inside the fold it would be sorted for each component
    return F.when(F.size(v) == 64, F.transform(F.array(median), lambda m: F.concat(digits(1, m), digits(33, m)))[0])
