"""Small helpers that write the DuckDB oracle SQL for per-column operators."""

from __future__ import annotations


def qi(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def per_column(src: str, cols: list[str], select: str) -> str:
    """``select`` is a template using {c} (quoted column) and {name} (literal)."""
    return union_all([f"SELECT {select.format(c=qi(c), name=c)} FROM {src}" for c in cols])


def skew_sql(c: str) -> str:
    """DuckDB ``skewness`` is the adjusted Fisher-Pearson estimate (pandas)."""
    return f"CASE WHEN count({c}) >= 3 THEN CASE WHEN stddev_pop({c}) = 0 THEN 0.0 ELSE skewness({c}) END END"


def kurt_sql(c: str) -> str:
    """DuckDB ``kurtosis`` is the bias-corrected excess kurtosis (pandas)."""
    return f"CASE WHEN count({c}) >= 4 THEN CASE WHEN stddev_pop({c}) = 0 THEN 0.0 ELSE kurtosis({c}) END END"


def corr_sql(a: str, b: str) -> str:
    """Pairwise-complete Pearson r, NULL when a side is constant."""
    x = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
    y = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
    return (f"CASE WHEN var_pop({x}) * var_pop({y}) > 0 THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END")


def words_sql(c: str) -> str:
    """Whitespace words of a text (empty pieces removed)."""
    return f"list_filter(regexp_split_to_array(trim({c}), '\\s+'), lambda w: w <> '')"
