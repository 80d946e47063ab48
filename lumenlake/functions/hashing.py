"""Content digests and 64-bit perceptual hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_hex(content: Column) -> Column:
    return F.md5(content)


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def hex16(phash: Column) -> Column:
    """A 64-bit hash as 16 hex digits, independent of sign."""
    return F.lpad(F.lower(F.hex(phash)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits (HSH5)."""
    return F.bit_count(a.bitwiseXOR(b))


def similar(a: Column, b: Column, threshold: int) -> Column:
    """Within the threshold, bound included (HSH6)."""
    return hamming(a, b) <= F.lit(threshold)


def average_hash(cells: Column) -> Column:
    """64-bit average hash of an 8x8 luminance grid in row order (HSH3).

    Bit i is set when cell i is above the whole-number mean of the grid, which
    for whole-number cells is the same as 64 times the cell above the sum.  The
    sum is bound once, as the only element of an array.
    """
    total = F.aggregate(cells, F.lit(0).cast("long"), lambda acc, c: acc + c.cast("long"))

    def bits(bound: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(63)),
            F.lit(0).cast("long"),
            lambda acc, i: acc.bitwiseOR(F.call_function(
                "shiftleft", (F.get(cells, i).cast("long") * 64 > bound).cast("long"), i
            )),
        )

    return F.element_at(F.transform(F.array(total), bits), 1)
