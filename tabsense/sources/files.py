"""File scans and sinks: CSV, JSON, Parquet tables, upload admission and
encoding checks.  Every scan is a distributed Spark read; type inference is
one aggregate over all columns followed by one projection."""

from __future__ import annotations

import csv
import io
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.numeric import col
from tabsense.functions.schema import ROW_ID, storage_type, widen
from tabsense.functions.text import NULL_TOKENS, READER_NULL_TOKENS
from tabsense.session import checkpoint_dir, materialize
from tabsense.sources import framing, manifest

# Fixed values of the reference's upload rules.
SUPPORTED_SUFFIXES = (".csv", ".xlsx", ".json")
FORBIDDEN_SUFFIXES = (".xlsm",)
MAX_UPLOAD_MB = 80

_NUMBER = r"^(?i)[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?$"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared checkpoint location (never a
    machine-local temporary folder)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tabsense-io/{label}-{uuid.uuid4().hex}"


def number(c: Column, kind: T.DataType) -> Column:
    """Text as a number, null when it is none.  The shape is tested first:
    Java's parsers also take suffixes (1D, 2F) as numbers."""
    shape = r"^[+-]?\d+$" if isinstance(kind, T.LongType) else _NUMBER
    return F.when(F.trim(c).rlike(shape), F.trim(c).try_cast(kind))


def infer_types(df: DataFrame) -> DataFrame:
    """pandas-like inference on text columns: all integers -> long (double
    when nulls are present), all numbers -> double, all true/false ->
    boolean, nothing but nulls -> double, else text.  One aggregate decides
    every column."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    whole = lambda c: number(col(c), T.LongType())
    real = lambda c: number(col(c), T.DoubleType())
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(texts):
        aggs += [F.count(col(c)).alias(f"n{i}"), F.count(whole(c)).alias(f"l{i}"), F.count(real(c)).alias(f"d{i}"),
                 F.count_if(F.lower(F.trim(col(c))).isin("true", "false")).alias(f"b{i}")]
    r = df.agg(*aggs).first()
    exprs = {}
    for i, c in enumerate(texts):
        n = r[f"n{i}"]
        if n == 0:
            exprs[c] = F.lit(None).cast("double")
        elif r[f"l{i}"] == n:
            exprs[c] = whole(c).cast("double") if n < r["__rows"] else whole(c)
        elif r[f"d{i}"] == n:
            exprs[c] = real(c)
        elif r[f"b{i}"] == n:
            exprs[c] = F.lower(F.trim(col(c))) == F.lit("true")
    return df.select(*[exprs[c].alias(c) if c in exprs else col(c) for c in df.columns])


def is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether every line of the files is valid UTF-8 (a distributed scan of
    lines; no file is held whole)."""
    return not spark.read.text(path).where("NOT is_valid_utf8(value)").limit(1).collect()


def with_file_order(raw: DataFrame) -> DataFrame:
    """``row_id`` in file order: files by path, then the place in the file.

    A file may be read in several blocks; rows keep their order inside a
    block, so a row's number is the rows of all blocks before its own plus
    its place in the block.  Written once, so block sizes and rows agree.
    """
    marked = materialize(raw.select(*[col(c) for c in raw.columns], F.col("_metadata.file_path").alias("__file"),
                                    F.col("_metadata.file_block_start").alias("__block"),
                                    F.monotonically_increasing_id().alias("__at")), "scan")
    blocks = marked.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("__first"))
    before = F.sum("n").over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("__file", "__block", "__first", F.coalesce(before, F.lit(0)).alias("__before"))  # one row a block
    return (marked.join(blocks, ["__file", "__block"])
            .select((F.col("__before") + F.col("__at") - F.col("__first")).cast("long").alias(ROW_ID), *[col(c) for c in raw.columns]))


_CSV = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _line_ends_in_values(spark: SparkSession, path: str) -> DataFrame | None:
    """What framing needs of each block, or nothing when every line is a record."""
    lines = framing.pieces(spark, path, framing.CsvLines.separator)
    if lines.where(F.contains("value", F.lit(b'"'))).isEmpty():
        return None
    outcomes = materialize(framing.block_outcomes(lines, framing.CsvLines()), "csv-blocks")
    # when no block that starts outside of values leaves one open at a line's end, none starts inside
    return None if outcomes.where("open0").isEmpty() else outcomes


def _safe_names(header: list[str]) -> list[str]:
    """Column names as Spark's CSV reader makes them: empty ones and repeated ones get their place."""
    low = [h.lower() for h in header]
    return [f"_c{i}" if not h else f"{h}{i}" if low.count(h.lower()) > 1 else h for i, h in enumerate(header)]


def _framed_csv(spark: SparkSession, path: str, encoding: str, outcomes: DataFrame, row_ids: bool) -> DataFrame:
    """Text columns of CSV records framed by many tasks a file, written once."""
    found = materialize(framing.records(spark, path, framing.CsvLines(), outcomes), "csv-records")
    number = F.col("before") + F.col("at")
    paths = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))
    sizes = found.groupBy("file").agg((F.max(number) + 1).alias("n"), F.max(F.when(number == 0, F.decode("text", encoding))).alias("header"))
    order = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    listed = materialize(paths.withColumn("file", F.xxhash64("path")).join(sizes, "file").select(
        "file", "path", "header", F.coalesce(F.sum(F.col("n") - 1).over(order), F.lit(0)).alias("files_before")), "csv-files")
    header = listed.orderBy("path").select("header").first()["header"]
    names = _safe_names(next(csv.reader(io.StringIO(header, newline=""))))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names]).toDDL()
    rows = found.where(number > 0)  # the first record of a file is its header
    if row_ids:
        rows = rows.join(listed.select("file", "files_before"), "file").withColumn("id", F.col("files_before") + number - 1)
    parsed = F.from_csv(F.decode("text", encoding), schema, _CSV)
    raw = rows.select(*([F.col("id").alias("__id")] if row_ids else []), parsed.alias("r"))
    return materialize(raw.select(*([F.col("__id").alias(ROW_ID)] if row_ids else []), "r.*"), "csv-rows")


def scan_csv(spark: SparkSession, path: str, encoding: str | None = None, multi_line: bool | None = None,
             row_ids: bool = False) -> DataFrame:
    """Header CSV -> missing-value tokens -> inferred types.

    Quotes inside quoted values are doubled, as common writers do; quoted
    values may hold line ends.  By default the files are looked through for
    such line ends, block by block; only when there are any, records are
    framed by a second pass (:mod:`framing`), still by many tasks a file.
    ``multi_line`` False spares the look, True frames in any case.
    ``encoding`` defaults to UTF-8 when all lines are valid UTF-8, else
    Latin-1; framing reads any encoding that keeps ASCII bytes.  ``row_ids``
    adds a ``row_id`` in file order.
    """
    encoding = encoding or ("UTF-8" if is_utf8(spark, path) else "ISO-8859-1")
    outcomes = None
    if multi_line is None:
        outcomes = _line_ends_in_values(spark, path)
    elif multi_line:
        outcomes = materialize(framing.block_outcomes(framing.pieces(spark, path, framing.CsvLines.separator), framing.CsvLines()), "csv-blocks")
    if outcomes is not None and not outcomes.isEmpty():
        raw = _framed_csv(spark, path, encoding, outcomes, row_ids)
        names = [c for c in raw.columns if not (row_ids and c == ROW_ID)]
    else:
        raw = spark.read.options(**_CSV).option("header", True).option("encoding", encoding).option("inferSchema", False).csv(path)
        names = raw.columns
        if row_ids:
            raw = with_file_order(raw)
    tokens = NULL_TOKENS + READER_NULL_TOKENS
    return infer_types(raw.select(*([ROW_ID] if row_ids else []), *[
        F.when(~col(c).isin(tokens), col(c)).alias(c) for c in names]))


def scan_json(spark: SparkSession, path: str, framed: bool | None = None) -> DataFrame:
    """JSON records, one a line, or objects in arrays or over several lines;
    nested values become JSON text; integers long, fractions double.

    Arrays and objects over several lines are framed by many tasks a file
    (:mod:`framing`) and written one a line before Spark's parser sees them.
    ``framed`` says which; by default the files' first characters and, for
    lines, the parser's verdict tell.
    """
    objects = framing.JsonObjects()
    if framed is None:
        first = framing.pieces(spark, path, objects.separator).select(F.ltrim(F.decode("value", "UTF-8"), F.lit(" \t\r\n\ufeff")).alias("v"))
        framed = not first.where(F.col("v").startswith("[")).isEmpty()
    raw = None
    if not framed:
        raw = spark.read.json(path)
        framed = "_corrupt_record" in raw.columns
    if framed:
        outcomes = materialize(framing.block_outcomes(framing.pieces(spark, path, objects.separator), objects), "json-blocks")
        found = framing.records(spark, path, objects, outcomes)
        lines = scratch_path(spark, "json-lines")
        # line ends between the tokens of a record are white space; those inside strings are escaped
        found.select(F.regexp_replace(F.decode("text", "UTF-8"), r"[\r\n]+", " ").alias("value")).write.text(lines)
        raw = spark.read.json(lines)
    if "_corrupt_record" in raw.columns or not raw.columns:
        raise ValueError("input is not a table of JSON records")
    return widen(raw)


def admit_inputs(spark: SparkSession, pattern: str, max_mb: int = MAX_UPLOAD_MB) -> DataFrame:
    """(path, length, accepted, reason) for every file matching ``pattern``.
    Only file metadata is read (the content column is pruned)."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    lower = F.lower(name)
    supported = F.lit(False)
    for s in SUPPORTED_SUFFIXES:
        supported = supported | lower.endswith(s)
    forbidden = F.lit(False)
    for s in FORBIDDEN_SUFFIXES:
        forbidden = forbidden | name.endswith(s)   # case-sensitive, as in the reference
    reason = (F.when(F.col("length").isNull() | (F.col("length") == 0), F.lit("missing"))
              .when(F.col("length") > F.lit(max_mb * 1024 * 1024), F.lit("too_large"))
              .when(forbidden, F.lit("macro_excel"))
              .when(~supported, F.lit("unsupported_format")))
    return files.select("path", "length", reason.isNull().alias("accepted"), reason.alias("reason"))


_COMPRESSED = (".gz", ".bz2", ".lz4", ".snappy", ".deflate", ".zst")


def encoding_check(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, encoding) of every file: ``utf-16`` with its byte order mark,
    ``utf-8`` (``utf-8-sig`` with a mark) when all bytes are valid UTF-8, else
    the ``latin-1`` fallback.  A distributed scan of lines over any number of
    files; no file is held whole, no statistical charset model.

    The line reader drops a UTF-8 mark, so its three bytes are those missing
    from the lines (the last one may have no line end); compressed files,
    whose length says nothing, are ``utf-8`` with or without one.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", "length", F.col("_metadata.file_path").alias("__file"))
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = (spark.read.option("lineSep", "\n").text(pattern)
             .select(F.col("_metadata.file_path").alias("__file"), "value", place.alias("__place"))
             .groupBy("__file").agg(F.bool_and(F.expr("is_valid_utf8(value)")).alias("valid"),
                                    F.sum(F.octet_length("value") + F.lit(1).cast("long")).alias("bytes"),
                                    F.min_by(F.hex(F.substring(F.col("value").cast("binary"), 1, 2)), "__place").alias("first")))
    packed = F.lit(False)
    for suffix in _COMPRESSED:
        packed = packed | F.lower("path").endswith(suffix)
    mark = ~packed & (F.col("length") - F.coalesce("bytes", F.lit(0))).isin(2, 3)
    valid = F.coalesce("valid", F.lit(True))
    enc = (F.when(F.col("first").isin("FFFE", "FEFF"), F.lit("utf-16")).when(valid & mark, F.lit("utf-8-sig"))
           .when(valid, F.lit("utf-8")).otherwise(F.lit("latin-1")))
    return files.join(lines, "__file", "left").select("path", enc.alias("encoding"))


def map_types(df: DataFrame) -> DataFrame:
    """(column, storage type) for the five storage types."""
    rows = [(f.name, storage_type(f.dataType)) for f in df.schema.fields if f.name != ROW_ID]
    return df.sparkSession.createDataFrame(rows, "column string, storage_type string")


def write_table(df: DataFrame, path: str) -> int:
    """Full replace: ``df`` becomes the newest version of the table at
    ``path`` in one commit (:mod:`manifest`); returns its number."""
    return manifest.commit(df, path)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table."""
    return manifest.open_table(spark, path)


def export_csv(df: DataFrame, path: str) -> str:
    """Header CSV without the row index; whitespace kept as is, quotes inside
    values doubled (what common readers expect)."""
    (df.drop(ROW_ID).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def export_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path
