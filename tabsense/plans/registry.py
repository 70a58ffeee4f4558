"""Named queries over the driver tables and their DuckDB oracles.

``QUERIES[name](spark, data_dir) -> DataFrame`` runs one operator over a
whole driver table (or a fixture derived from it); ``ORACLES[name]`` is the
same computation in DuckDB SQL over the same tables.  Floating-point
columns are reported at single precision on both sides (7 significant
digits) so summation order does not change the comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLOATS: dict[str, tuple[str, ...]] = {}


def report_precision(df: DataFrame) -> DataFrame:
    """Cast every double column to float (7 significant digits)."""
    from pyspark.sql import functions as F
    return df.select(*[F.col(f"`{f.name}`").cast("float").alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def query(name: str, oracle: str | None = None, floats: tuple[str, ...] = ()):
    """Register ``fn(spark, data_dir)`` under ``name`` with its oracle."""
    def wrap(fn):
        def run(spark: SparkSession, data_dir: str) -> DataFrame:
            return report_precision(fn(spark, data_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        FLOATS[name] = floats
        if oracle is not None:
            if floats:
                rep = ", ".join(f'CAST("{c}" AS FLOAT) AS "{c}"' for c in floats)
                ORACLES[name] = f"SELECT * REPLACE ({rep}) FROM ({oracle}) AS __q"
            else:
                ORACLES[name] = oracle
        return fn
    return wrap
