"""Schema helpers: the five storage types and the column-role selections
shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "row_id"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED = (T.StructType, T.ArrayType, T.MapType)


def is_numeric(dt: T.DataType) -> bool:
    """Numeric for statistics, fences and plots.  Boolean is its own role."""
    return isinstance(dt, _INTEGRAL + _FRACTIONAL)


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, _TEMPORAL)


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def data_fields(df: DataFrame, keep_row_id: bool = False) -> list[T.StructField]:
    return [f for f in df.schema.fields if keep_row_id or f.name != ROW_ID]


def numeric_cols(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in data_fields(df) if is_numeric(f.dataType) and f.name not in exclude]


def text_cols(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in data_fields(df) if is_text(f.dataType) and f.name not in exclude]


def q(name: str) -> str:
    """Back-quote a column name for SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def storage_type(dt: T.DataType) -> str:
    """The five-way storage type map (integer, float, bool, datetime, text)."""
    if isinstance(dt, _INTEGRAL):
        return "BIGINT"
    if isinstance(dt, _FRACTIONAL):
        return "DOUBLE PRECISION"
    if isinstance(dt, T.BooleanType):
        return "BOOLEAN"
    if isinstance(dt, _TEMPORAL):
        return "TIMESTAMP"
    return "TEXT"


def without_nan(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NaN -> null in the (given) float and double columns: Spark counts NaN as
    a value, statistics must not."""
    fields = [f for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and (cols is None or f.name in cols)]
    return df.withColumns({f.name: F.nanvl(F.col(q(f.name)), F.lit(None).cast(f.dataType)) for f in fields}) if fields else df


def widen(df: DataFrame) -> DataFrame:
    """Entry normalisation: integers -> long, fractions -> double with NaN
    mapped to null (pandas has one missing value, Spark two), nested
    values -> JSON text.  A single projection, no shuffle."""
    exprs = []
    for f in df.schema.fields:
        c = F.col(q(f.name))
        if isinstance(f.dataType, _INTEGRAL):
            c = c.cast("long")
        elif isinstance(f.dataType, _FRACTIONAL):
            c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        elif isinstance(f.dataType, _NESTED):
            c = F.to_json(c)
        exprs.append(c.alias(f.name))
    return df.select(*exprs)
