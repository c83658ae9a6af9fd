from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A double is cut into a multiple of 2^-40 and one of 2^-93.
HIGH, LOW = 2.0 ** 40, 2.0 ** 53


def exact_sum(value: Column) -> Column:
    """Sum of doubles that does not depend on the order of its terms.

    Every term is cut into two whole numbers, which multiplying by powers of two and
    subtracting do without rounding; whole numbers are summed in decimals, exactly, and
    turned back at the end. No bit is lost of terms that are 0 or between 2^-40 and 2^22
    in size, as ratios of counts are; smaller ones lose what lies below 2^-93.
    """
    scaled = value * F.lit(HIGH)
    high = F.floor(scaled)
    low = F.floor((scaled - high.cast("double")) * F.lit(LOW))
    whole = [F.sum(part.cast("decimal(20,0)")).cast("double") for part in (high, low)]
    return whole[0] / F.lit(HIGH) + whole[1] / F.lit(HIGH * LOW)


def exact_avg(value: Column) -> Column:
    """Average of the doubles that are there, the same bits over any shuffle; NULL without any."""
    n = F.count(value)
    return F.when(n > 0, exact_sum(value) / n.cast("double"))
