"""Random draws by hash: the same in numpy, in Spark and in SQL, whatever the
partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1


def scramble(x, y):
    """Hash of two numbers below 2^31, the same in numpy and in SQL."""
    v = (x * 48271 + y * 69621 + 12345) % PRIME
    for k in (1, 2, 3):
        v = (v * v + 16807 * v + k) % PRIME
    return v


def poisson_limits(rate: float) -> list[int]:
    """A hash of at least the j-th value draws a row more than j times."""
    out, term, total = [], np.exp(-rate), 0.0
    for j in range(12):
        total += term
        if total * PRIME >= PRIME - 1:
            break
        out.append(int(total * PRIME))
        term *= rate / (j + 1)
    return out


def scramble_col(x: Column, y: Column) -> Column:
    """``scramble`` as an expression."""
    first = (x * 48271 + y.cast("long") * 69621 + 12345) % PRIME
    return F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), first, lambda v, k: (v * v + v * 16807 + k) % PRIME)


def row_number_of(*columns) -> Column:
    """A row's number for ``scramble``, from its key's text."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *columns)), 1, 8), 16, 10).cast("long") % PRIME
