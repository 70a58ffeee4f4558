"""Incremental import of a landing folder.

Files dropped into ``landing`` are picked up by a file-source stream, cleaned
with the same rules as a batch import (null tokens, names, text, dates,
inferred types) inside ``foreachBatch`` and appended as Parquet.  The stream
checkpoint gives exactly-once file handling; each micro-batch write goes to
its own folder named by the batch id, so a replayed batch overwrites itself
instead of duplicating rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabsense.functions.dates import PY_DATE_FORMATS, SPARK_DATE_FORMATS, parse_any, parse_with
from tabsense.functions.numeric import col
from tabsense.functions.schema import is_temporal
from tabsense.functions.text import normalize_text, null_token
from tabsense.operators.importing import clean_import, date_formats, null_tokens, snake_case_columns
from tabsense.sources.files import infer_types, number


def landing_schema(spark: SparkSession, landing: str) -> T.StructType:
    """All-text schema from the header of the files already present."""
    header = spark.read.option("header", True).csv(landing).schema
    return T.StructType([T.StructField(f.name, T.StringType()) for f in header.fields])


def _settled(spark: SparkSession, landing: str, schema: T.StructType, checkpoint: str) -> T.StructType:
    """The cleaned schema: decided once, from the files present when the stream
    first starts, and stored beside the checkpoint, so every batch of every
    restart has the same columns and types.  A date column keeps the format
    it was recognised by in its metadata."""
    stored = f"{checkpoint.rstrip('/')}-schema"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stored)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return T.StructType.fromJson(json.loads(spark.read.text(stored).first()[0]))
    raw = spark.read.schema(schema).option("header", True).option("escape", '"').csv(landing)
    named = null_tokens(snake_case_columns(raw))
    formats = date_formats(named, [c for c in named.columns if "date" in c])
    typed = clean_import(infer_types(raw.select(*[null_token(col(c)).alias(c) for c in raw.columns])))
    target = T.StructType([T.StructField(f.name, f.dataType, True, {"format": formats.get(f.name)} if is_temporal(f.dataType) else {})
                           for f in typed.schema.fields])
    spark.createDataFrame([(target.json(),)], "value string").coalesce(1).write.text(stored)
    return target


def _clean_batch(batch: DataFrame, target: T.StructType) -> DataFrame:
    """A batch as ``target`` says; a value that does not fit its column's type is null."""
    texts = null_tokens(snake_case_columns(batch))
    exprs = []
    for f in target.fields:
        c = col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = null_token(normalize_text(c))
        elif is_temporal(f.dataType):
            fmt = (f.metadata or {}).get("format")
            c = parse_with(F.trim(c), SPARK_DATE_FORMATS[PY_DATE_FORMATS.index(fmt)]) if fmt else parse_any(c)
        elif isinstance(f.dataType, T.BooleanType):
            c = F.when(F.lower(F.trim(c)).isin("true", "false"), F.lower(F.trim(c)) == "true")
        else:
            c = number(c, f.dataType)
        exprs.append(c.alias(f.name))
    return texts.select(*exprs)


def stream_import(spark: SparkSession, landing: str, output: str, checkpoint: str,
                  schema: T.StructType | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the import stream; with ``available_now`` it processes the files
    present and stops (batch-like runs on a schedule).  Types are settled by
    the first files (see :func:`_settled`), not by each batch."""
    schema = schema or landing_schema(spark, landing)
    target = _settled(spark, landing, schema, checkpoint)
    src = (spark.readStream.schema(schema).option("header", True).option("escape", '"').option("maxFilesPerTrigger", 1000)
           .csv(landing))

    def write(batch: DataFrame, batch_id: int) -> None:
        _clean_batch(batch, target).write.mode("overwrite").parquet(f"{output.rstrip('/')}/batch={batch_id}")

    w = src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_imported(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(output).drop("batch")
