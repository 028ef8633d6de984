"""Edge scores as column expressions (JVM-side, inside whole-stage codegen).

The reference computes these with row-at-a-time Python UDFs; here they are
plain arithmetic so Catalyst can push the edge filter down to them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalized_cooccurrence(count_ij, count_i, count_j) -> Column:
    """c_ij / sqrt(max(c_i * c_j, 1)) as double."""
    return _c(count_ij) / F.sqrt(F.greatest(_c(count_i) * _c(count_j), F.lit(1)).cast("double"))


def pmi(count_ij, count_i, count_j, total) -> Column:
    """ln(p_ij / (p_i p_j)); null when any probability is 0."""
    p_i = _c(count_i) / _c(total)
    p_j = _c(count_j) / _c(total)
    p_ij = _c(count_ij) / _c(total)
    ok = (p_ij != 0) & (p_i != 0) & (p_j != 0)
    return F.when(ok, F.log(p_ij / (p_i * p_j)))


def npmi(count_ij, count_i, count_j, total) -> Column:
    """pmi / -ln(p_ij); 0 when p_ij = 1; null when any probability is 0."""
    p_ij = _c(count_ij) / _c(total)
    value = pmi(count_ij, count_i, count_j, total)
    return F.when(value.isNull(), F.lit(None).cast("double")) \
        .when(p_ij < 1, value / (-F.log(p_ij))) \
        .otherwise(F.lit(0.0))
