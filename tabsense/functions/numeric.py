"""Numeric expressions that stay safe under ANSI mode (no division errors
on constant or empty columns) and match pandas' estimators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def pair_corr(a: str, b: str) -> Column:
    """Pearson r on pairwise-complete rows; NULL (not an error) when either
    side is constant."""
    both = col(a).isNotNull() & col(b).isNotNull()
    x = F.when(both, col(a))
    y = F.when(both, col(b))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
