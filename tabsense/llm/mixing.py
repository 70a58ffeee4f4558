"""Mixing sources to target weights by capped water-filling.

Sources share a total by weight; one whose share exceeds ``max_epochs`` times its size is clamped there and the
excess goes to the others by weight until none is above.  That is one water level: target = min(cap, level x weight).
Each round is one aggregate over the table of sources.  Every document is then taken a whole number of times, and a
seeded part of each source once more: documents whose hash lies below the source's threshold take a whole repetition
more, those in the bucket the threshold falls in take that fraction of their words, so the words taken differ from
the target by rounding only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsense.llm.common import WORD, stored
from tabsense.operators.rows import with_row_index

#: Hash buckets a source; each holds this share of its documents.
BUCKETS = 4096


def word_count(text: str = "text"):
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: float, total: float | None = None) -> DataFrame:
    """Targets of sources, given one row a source (``source``, ``source_size``): adds ``weight`` (repeating, in code
    point order, null last), ``target`` and ``epochs`` (target / size, 0 for a source without words).

    ``total`` defaults to the sum of all sizes; it is met unless every source is clamped.
    """
    placed = with_row_index(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], tie_break=False)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = placed.select("source", "source_size", F.get(cycle, (F.col("row_id") % len(weights)).cast("int")).alias("weight"),
                         (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"))
    if total is None:
        total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("cap")
        caps, free, n = rows.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight"))),
                                 F.sum(F.when(above, 1).otherwise(0))).first()
        if not free or n == clamped:
            break
        # the level only rises: who was clamped stays clamped
        level, clamped = max(total - (caps or 0.0), 0.0) / free, n
    target = F.least(F.col("weight") * F.lit(float(level or 0.0)), F.col("cap"))
    return rows.select("source", "source_size", "weight", target.alias("target"),
                       F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("epochs"))


def mix(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3, seed: int = 17,
        key: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None) -> DataFrame:
    """``df`` with ``size`` (words), ``source_size``, ``target`` (of the document's source), ``taken`` (words taken,
    repeats counted) and ``repeats`` (repetitions as a double: whole ones and the fraction of the last).

    Columns of those names are replaced.  The choice depends on the key and the seed only, so reruns agree; repeated
    keys share their choice.  Null texts have size 0 and are never taken; a null source is a source.  A source of any
    share of the rows is fine: rows are only counted by (source, bucket) before the shuffle, and the join back is to
    one row a source and bucket.
    """
    made = ["size", "source_size", "target", "taken", "repeats"]
    kept = [c for c in df.columns if c not in made]
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))))
    part_of = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("long")
    rows = df.select(*[F.col(f"`{c}`") for c in kept], word_count(text).alias("size"), (part_of(1, 8) % BUCKETS).cast("int").alias("_bucket"),
                     (part_of(9, 5) / F.lit(float(1 << 20))).alias("_u"))
    # counted from a scan of its own: only the key, the source and the text's length are read
    cells = (rows.groupBy(F.col(f"`{source}`").alias("source"), "_bucket").agg(F.sum("size").alias("_words")))
    cells = stored(cells, "mix-cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, max_epochs, total)
    by = Window.partitionBy("source").orderBy("_bucket")
    before = F.coalesce(F.sum("_words").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.floor("epochs")
    extra = F.col("target") - share * F.col("source_size")  # words of the last, fractional repetition
    plan = (cells.withColumn("_before", before)
            .join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
            .select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), "source_size", "target", share.alias("_whole"),
                    F.when(F.col("_words") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (extra - F.col("_before")) / F.col("_words"))))
                    .otherwise(0.0).alias("_part")))
    plan = stored(plan, "mix-plan")
    joined = rows.join(plan, F.col(f"`{source}`").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    whole = F.col("_whole").cast("long") * F.col("size")
    # rounding by other bits of the hash keeps the expected number of words
    part = F.least(F.col("size"), F.floor(F.col("_part") * F.col("size") + F.col("_u")).cast("long"))
    part = F.when(F.col("_part") >= 1, F.col("size")).when(F.col("_part") <= 0, F.lit(0)).otherwise(part)
    taken = whole + part
    return joined.select(*[F.col(f"`{c}`") for c in kept], "size", "source_size", "target", taken.cast("long").alias("taken"),
                         F.when(F.col("size") > 0, taken / F.col("size")).otherwise(0.0).alias("repeats"))


def repeat_rows(mixed: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The mix itself: each row of ``mix`` as often as it is taken, whole repetitions first; the last, fractional one
    holds the first words of the text that it takes, joined by single spaces."""
    left = (F.col("taken") - F.floor("repeats") * F.col("size")).cast("int")
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rows = mixed.where("taken > 0").withColumn("_left", left).withColumn("_copies", copies)
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("_left")), " ")
    short = (F.col("_left") > 0) & (F.col("_copy") == F.col("_copies"))
    return rows.withColumn(text, F.when(short, cut).otherwise(F.col(f"`{text}`"))).select(*[F.col(f"`{c}`") for c in columns])
