"""Normal distribution as Columns.

The distribution function follows the series and continued fraction of the
incomplete gamma function in double arithmetic; the quantile refines a start
value by Newton steps. Both are plain expressions for tables of a few rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(z: Column) -> Column:
    """Probability of a standard normal value below ``z``; NULL for NULL."""
    # Taylor series around 0 for |z| < 3.5, continued fraction of the tail beyond
    near = z * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    odd = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, k: F.struct((a["t"] * z * z / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * z * z / (2 * k + 1)).alias("s")))["s"]
    size = F.abs(z)
    fraction = F.aggregate(F.sequence(F.lit(40), F.lit(1), F.lit(-1)), size, lambda a, k: size + k / a)
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) / fraction
    return F.when(size < 3.5, 0.5 + near * odd).when(z > 0, 1 - tail).otherwise(tail)


def normal_quantile_of(p: Column) -> Column:
    """Value below which a standard normal lies with probability ``p``: a rational start value and Newton steps."""
    q = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(q))
    # fixed values: Abramowitz and Stegun 26.2.23
    x = -(t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t))
    step = lambda x, _: x - (normal_cdf(x) - q) * F.exp(x * x / 2) * math.sqrt(2 * math.pi)
    x = F.aggregate(F.sequence(F.lit(1), F.lit(4)), x, step)
    return F.when(p > 0.5, -x).otherwise(x)
