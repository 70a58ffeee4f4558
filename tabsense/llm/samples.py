"""Bounded, seeded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 23
_SPACE = 1 << 40


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key as text modulo ``modulus`` (null for a null key)."""
    return F.pmod(F.crc32(F.col(f"`{key}`").cast("string")), F.lit(modulus))


def hashed_rows(rows: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows (a few standard deviations more) of each label: those whose seeded key hash ``_h`` lies
    below the label's share.  One small aggregate, a row a label, and a filter; no shuffle of rows."""
    known = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    counts = known.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    wanted = per_label + 6 * per_label ** 0.5 + 20
    cuts = [(r[label], min(_SPACE, int(_SPACE * wanted / r["n"]) + 1)) for r in counts]
    kind = rows.schema[label].dataType.simpleString()
    cuts = rows.sparkSession.createDataFrame(cuts, f"`{label}` {kind}, _cut long")
    h = F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(_SPACE))
    return known.withColumn("_h", h).join(F.broadcast(cuts), label).where(F.col("_h") < F.col("_cut")).drop("_cut")


def collect_texts(sample: DataFrame, label: str, text: str, per_label: int, total_bytes: int) -> list[tuple]:
    """(label, _h, text) of a bounded sample: of each label, in the order of ``_h``, rows until ``per_label`` of them or
    the label's equal share of ``total_bytes`` is reached.  Null and empty texts don't count, nor does a text that
    alone is larger than the share.  The sizes come to the driver first, so no more texts than that ever do."""
    usable = sample.where(F.col(text).isNotNull() & (F.length(text) > 0)).withColumn("_size", F.octet_length(text))
    sizes: dict = {}
    for r in sorted(tuple(r) for r in usable.select(label, "_h", "_size").collect()):
        sizes.setdefault(r[0], []).append(r[1:])
    if not sizes:
        return []
    share, cuts = total_bytes // len(sizes), []
    for name, rows in sizes.items():
        left, taken, last = share, 0, -1
        for h, size in rows:
            if size > share:
                continue
            if taken == per_label or size > left:
                break
            left, taken, last = left - size, taken + 1, h
        cuts.append((name, last))
    kind = sample.schema[label].dataType.simpleString()
    cuts = sample.sparkSession.createDataFrame(cuts, f"`{label}` {kind}, _last long")
    chosen = usable.where(F.col("_size") <= share).join(F.broadcast(cuts), label).where(F.col("_h") <= F.col("_last"))
    return sorted(tuple(r) for r in chosen.select(label, "_h", text).collect())
