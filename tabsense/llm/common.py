"""Helpers shared by the corpus operators: shipping the package, ordered partitions, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import os
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsense.operators.rows import with_row_index
from tabsense.session import materialize

#: Words are runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_SHIPPED = "_tabsense_llm_shipped"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once a session (they import it by name, so workers keep loaded models)."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="tabsense-code-"), "tabsense_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tabsense", os.path.relpath(full, root)))
    sc.addPyFile(target)
    setattr(sc, _SHIPPED, True)


def words(text: str) -> list[str]:
    """The words of a text, unchanged (``WORD``); encoded first, since ``str.split()`` also splits at other spaces."""
    return [w.decode("utf-8") for w in text.encode("utf-8", "surrogatepass").translate(_SPACES).split(b" ") if w]


def words_bytes(text: str) -> list[bytes]:
    """The words of a text as UTF-8."""
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_SPACES).split(b" ") if w]


_INSIDE_SPACE = re.compile(r"\s (?:\s|\Z)")


def cuttable(text: str) -> bool:
    """Whether cutting the text before each space leaves its pre-tokens as they are, for patterns of the kind
    ``' ?letters| ?digits| ?others|\\s+(?!\\S)|\\s+'``: no space may stand after white space and before white space or
    the end.  A pre-token ends wherever white space follows other characters, and the last space before a word is
    always that word's; so every other cut falls between two pre-tokens and no lookahead crosses it."""
    return _INSIDE_SPACE.search(text) is None


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def splitmix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (every output bit depends on every input bit)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps: Spark drops them when the driver's JVM collects the plans that
    made them, which a job of few, large steps may not see happen in time.  Call it after results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task, beside the next steps' tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(ctypes.CDLL(None), "malloc_trim"):  # glibc
        ctypes.CDLL(None).malloc_trim(0)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``materialize`` with no more files than keep every core busy (four a core): a table of many tiny partitions
    would cost a file, its checksum file and their permissions each."""
    return materialize(df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism), label)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str, batch_rows: int = 256) -> DataFrame:
    """``mapInArrow`` over batches of at most ``batch_rows`` rows; ``fn`` turns a batch into columns by name."""
    ship_package(df.sparkSession)
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                made = fn(batch.slice(at, batch_rows))
                for columns in made if not isinstance(made, dict) else (made,):
                    arrays = [pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array)
                              else columns[f.name].cast(f.type) for f in arrow]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        trim()

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def number_rows(df: DataFrame, key: str, out: str = "doc") -> DataFrame:
    """``df`` with distinct longs ``out`` in the order of ``key``: the key itself where all keys are distinct longs and
    none is null, else row numbers in the order of the key (null first), ties by the other columns."""
    whole = df.schema[key].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    rows, known = df.agg(F.count(F.lit(1)), F.count_distinct(F.col(key))).first()
    if whole and rows == known:
        return df.withColumn(out, F.col(key).cast("long"))
    return with_row_index(df, [key], name=out)


def ordered_parts(df: DataFrame, key: str, payload: list[str], parts: int | None = None, trailer: bool = False) -> DataFrame:
    """Deal rows to ``parts`` ranges of ``key`` (null first) and sort each range by key, then the payload.

    Adds ``part`` (ranges are in key order) and ``trailer``.  With ``trailer`` every range also gets the rows holding
    the smallest key of the next range (cyclic, an only range its own), marked true and sorted last, so a range can be
    worked off in one pass that looks one row ahead.  The bounds are quantiles of the key: one small array.
    A part always lies in one task; a task may hold several.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / n for i in range(1, n)]
    cuts = df.agg(F.percentile_approx(key, steps, max(10_000, 20 * n)).alias("q")).first()["q"] if steps else None
    cuts = sorted(set(cuts or []))
    if cuts:
        bounds = F.lit(np.array(cuts, dtype=np.int64))
        # ranges are (-inf, c0), [c0, c1), ...: the number of cuts not above the key
        place = F.when(F.col(key).isNull(), 0).otherwise(_rank_in(bounds, F.col(key), len(cuts)))
    else:
        place = F.lit(0)
    rows = df.select(key, *payload, place.cast("int").alias("part"))
    last = len(cuts)
    if not trailer:
        out = rows.withColumn("trailer", F.lit(False))
    else:
        # the smallest key of each range: at most one row a range on the driver
        firsts = sorted(tuple(r) for r in rows.groupBy("part").agg(
            F.max(F.col(key).isNull()).alias("null"), F.min(key).alias("k")).collect())
        first, before, null = np.zeros(last + 1, np.int64), np.full(last + 1, -1, np.int64), False
        for i, (p, has_null, k) in enumerate(firsts):
            first[p], before[p], null = k or 0, firsts[i - 1][0], null or has_null
        is_first = F.col(key) == F.get(F.lit(first), F.col("part"))
        if null:
            is_first = F.when(F.col("part") == 0, F.col(key).isNull()).otherwise(is_first)
        own = F.struct(F.col("part"), F.lit(False).alias("trailer"))
        also = F.struct(F.get(F.lit(before), F.col("part")).cast("int").alias("part"), F.lit(True).alias("trailer"))
        out = (rows.withColumn("_to", F.explode(F.when(is_first, F.array(own, also)).otherwise(F.array(own))))
               .select(key, *payload, "_to.part", "_to.trailer"))
    return (out.repartitionByRange(last + 1, "part")
            .sortWithinPartitions("part", "trailer", F.col(key).asc_nulls_first(), *payload))


def _rank_in(bounds, value, n: int):
    """Number of sorted bounds <= value: a binary search over the powers of two below ``n``."""
    steps = [1 << b for b in reversed(range(n.bit_length()))]
    return F.aggregate(F.lit(np.array(steps, np.int32)), F.lit(0), lambda lo, step: F.when(
        (lo + step <= n) & (F.get(bounds, lo + step - 1) <= value), lo + step).otherwise(lo))
