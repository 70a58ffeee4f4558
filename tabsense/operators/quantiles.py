"""Exact order statistics in two scans.

``percentile``/``mode`` aggregates keep a hash map of every distinct value
in the final (single) task of a global aggregate, which does not survive
a column with billions of distinct values.  Here one mergeable quantile
sketch (``percentile_approx``) brackets every wanted rank between two values;
one exact scan counts the rows between the brackets and the distinct values
inside them, a small share of all rows; a running sum over those counts gives
the values.  Infinities are ordinary values.  A hot value (a third of all
rows) is both ends of its bracket, or one of the few values inside.  Results
equal pandas' linear-interpolation quantiles.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsense.functions.numeric import col
from tabsense.functions.schema import without_nan

# Columns with at most this many rows need no bracket: all values are inside.
EXACT_LIMIT = 4096
# Accuracy of the sketch (a rank is off by rows / accuracy at most): at least,
# one for so many rows, at most.
ACCURACY, ACCURACY_ROWS, MAX_ACCURACY = 10_000, 100_000, 1_000_000
FEW_EDGES = 16


# Aggregation buffers above ~100 fields switch whole-stage codegen off
# (spark.sql.codegen.maxFields); wide aggregates are split into column
# chunks below this budget.  Each chunk scan reads only its own columns, so
# the I/O is the same as one scan.
FIELD_BUDGET = 90


def column_ranges(df: DataFrame, cols: list[str], extra=None, extra_fields: int = 0):
    """(count, min, max) per column.  ``extra(i, c)`` may return more
    aggregate expressions for column ``i`` (``extra_fields`` buffer fields in
    total); then ``(ranges, row)`` is returned with those results too."""
    df = without_nan(df, cols)
    per = 3 + extra_fields
    size = max(1, FIELD_BUDGET // per)
    row: dict = {}
    for start in range(0, len(cols), size):
        aggs = []
        for i in range(start, min(start + size, len(cols))):
            x = col(cols[i]).cast("double")
            aggs += [F.count(x).alias(f"__n{i}"), F.min(x).alias(f"__lo{i}"), F.max(x).alias(f"__hi{i}")]
            if extra is not None:
                aggs += extra(i, cols[i])
        row.update(df.agg(*aggs).first().asDict())
    ranges = {c: (row[f"__n{i}"], row[f"__lo{i}"], row[f"__hi{i}"]) for i, c in enumerate(cols)}
    return (ranges, row) if extra is not None else ranges


def _rank_in(edges: list[float], x: Column, below: bool) -> Column:
    """How many of the sorted edges are <= x (``below``: < x): few are compared one by one (in generated code), many by
    binary search."""
    if len(edges) <= FEW_EDGES:
        return reduce(lambda a, b: a + b, [((F.lit(e) < x) if below else (F.lit(e) <= x)).cast("int") for e in edges], F.lit(0))
    n, held = len(edges), F.lit(np.array(edges, float))
    steps = [1 << b for b in reversed(range(n.bit_length()))]

    def step(at: Column, width: Column) -> Column:
        edge = F.get(held, at + width - 1)
        return F.when((at + width <= n) & ((edge < x) if below else (edge <= x)), at + width).otherwise(at)

    return F.aggregate(F.lit(np.array(steps, np.int32)), F.lit(0), step)


def _brackets(df: DataFrame, wanted: dict[str, list[int]], ranges: dict, widen: int) -> dict[str, list[tuple[float, float]]]:
    """For each column disjoint, rising intervals of values that hold the wanted ranks, from one sketch of all columns;
    ``widen`` makes them that much wider."""
    probs, ask = {}, []
    for c, ranks in wanted.items():
        n, lo, hi = ranges[c]
        if n <= EXACT_LIMIT or widen > 100:
            continue
        accuracy = min(MAX_ACCURACY, max(ACCURACY, n // ACCURACY_ROWS))
        margin = (2 * -(-n // accuracy) + 2) * widen
        probs[c] = [(max(0.0, (k - margin) / n), min(1.0, (k + margin) / n)) for k in ranks]
        ask.append(F.percentile_approx(col(c).cast("double"), [p for pair in probs[c] for p in pair], accuracy).alias(c))
    found = df.agg(*ask).first() if ask else {}
    out = {}
    for c, ranks in wanted.items():
        n, least, most = ranges[c]
        pairs = [(least, most)]
        if c in probs:
            values = list(found[c])
            pairs = [(least if p == 0.0 else a, most if q == 1.0 else b) for (p, q), a, b in zip(probs[c], values[::2], values[1::2])]
        merged: list[tuple[float, float]] = []
        for lo, hi in sorted(pairs):
            if merged and lo <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(hi, merged[-1][1])
            else:
                merged.append((lo, hi))
        out[c] = merged
    return out


def order_statistics(df: DataFrame, wanted: dict[str, set[int]],
                     ranges: dict[str, tuple[int, float, float]]) -> dict[tuple[str, int], float]:
    """Exact k-th smallest non-null value (0-based k) for each column/rank.

    A sketch of all columns brackets the ranks; then a scan counts, for each
    column, the rows of every stretch between brackets and of every value
    inside one (combined map-side, one element a row and column).  The driver
    receives one row per wanted rank.  Should a sketch miss a rank, its column
    is done again with wider brackets.
    """
    spark, df = df.sparkSession, without_nan(df, list(wanted))
    done: dict[tuple[str, int], float] = {}
    todo: dict[str, list[int]] = {}
    for c, ranks in wanted.items():
        n, lo, hi = ranges[c]
        for k in sorted(ranks) if n else ():
            if lo == hi:
                done[(c, k)] = lo
            else:
                todo.setdefault(c, []).append(k)
    widen = 1
    while todo:
        names = list(todo)
        brackets = _brackets(df, todo, ranges, widen)
        items, targets = [], []
        for i, c in enumerate(names):
            x = col(c).cast("double")
            # stretches: 0 below the first bracket, 1 inside it, 2 between it and the second, ...
            place = _rank_in([lo for lo, _ in brackets[c]], x, False) + _rank_in([hi for _, hi in brackets[c]], x, True)
            items.append(F.when(x.isNotNull(), F.struct(F.lit(i).alias("c"), place.alias("at"), x.alias("v"))))
            targets += [(i, k) for k in todo[c]]
        rows = df.select(F.explode(F.array(*items)).alias("s")).where(F.col("s").isNotNull())
        counts = (rows.select("s.c", "s.at", F.when(F.col("s.at") % 2 == 1, F.col("s.v")).alias("v"))
                  .groupBy("c", "at", "v").agg(F.count(F.lit(1)).alias("cnt")))
        run = Window.partitionBy("c").orderBy("at", "v").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("cum", F.sum("cnt").over(run))
        asked = spark.createDataFrame(targets, "c int, k long")
        picked = (counts.join(F.broadcast(asked), "c")
                  .where((F.col("v").isNotNull()) & (F.col("cum") - F.col("cnt") <= F.col("k")) & (F.col("k") < F.col("cum")))
                  .select("c", "k", "v").collect())
        for r in picked:
            done[(names[r["c"]], r["k"])] = r["v"]
        todo = {c: left for c, ks in todo.items() if (left := [k for k in ks if (c, k) not in done])}
        widen *= 10
    return done


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    ranges: dict[str, tuple[int, float, float]] | None = None) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles (pandas / numpy default) per column."""
    df = without_nan(df, cols)
    ranges = ranges or column_ranges(df, cols)
    wanted: dict[str, set[int]] = {}
    for c in cols:
        n = ranges[c][0]
        if n:
            ks = set()
            for p in probs:
                h = (n - 1) * p
                ks.update({math.floor(h), math.ceil(h)})
            wanted[c] = ks
    stats = order_statistics(df, wanted, ranges)
    out: dict[str, list[float | None]] = {}
    for c in cols:
        n = ranges[c][0]
        vals: list[float | None] = []
        for p in probs:
            if not n:
                vals.append(None)
                continue
            h = (n - 1) * p
            a, b = stats[(c, math.floor(h))], stats[(c, math.ceil(h))]
            t = h - math.floor(h)
            vals.append(a if a == b else a + (b - a) * t)  # two equal infinities have no difference
        out[c] = vals
    return out


def quartile_fences(df: DataFrame, cols: list[str], whisker: float = 1.5,
                    ranges: dict | None = None, quartiles: dict | None = None) -> dict[str, tuple]:
    """(q1, q2, q3, lower fence, upper fence) per column (from ``quartiles``
    when they are known already)."""
    qs = quartiles or exact_quantiles(df, cols, [0.25, 0.5, 0.75], ranges)
    out = {}
    for c, (q1, q2, q3) in qs.items():
        if q1 is None:
            out[c] = (None, None, None, None, None)
        else:
            iqr = q3 - q1
            out[c] = (q1, q2, q3, q1 - whisker * iqr, q3 + whisker * iqr)
    return out


def column_modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most frequent non-null value per column, smallest on ties.

    ``groupBy(column, value).count()`` is combined map-side, so a hot value
    costs nothing extra; the per-column pick is a second small aggregate.
    Columns are stacked per data type (arrays need one element type).
    """
    out: dict[str, object] = {}
    by_type: dict[str, list[str]] = defaultdict(list)
    types = dict(df.dtypes)
    for c in cols:
        by_type[types[c]].append(c)
    for _t, group in by_type.items():
        items = [F.struct(F.lit(c).alias("c"), col(c).alias("v")) for c in group]
        counts = (df.select(F.explode(F.array(*items)).alias("s"))
                  .where(F.col("s.v").isNotNull())
                  .groupBy("s.c", "s.v").agg(F.count(F.lit(1)).alias("n")))
        best = counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("v"))).alias("m"))
        for r in best.collect():
            out[r["c"]] = r["m"]["v"]
        for c in group:
            out.setdefault(c, None)
    return out
