"""Rounding of doubles by their exact values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_round(x: Column, places: int) -> Column:
    """x rounded half to even at so many places, as if its binary value were written out in full.

    x times a power of ten is taken as the rounded product and its error, which splitting x into halves of its digits
    gives exactly; the error decides where the rounded product alone looks like a tie.
    """
    scale = float(10**places)
    product = x * F.lit(scale)
    shifted = x * F.lit(134217729.0)
    high = shifted - (shifted - x)
    error = (high * F.lit(scale) - product) + (x - high) * F.lit(scale)
    nearest = F.rint(product)
    off = product - nearest
    step = F.when((off == 0.5) & (error > 0), 1.0).when((off == -0.5) & (error < 0), -1.0).otherwise(0.0)
    return (nearest + step) / F.lit(scale)
