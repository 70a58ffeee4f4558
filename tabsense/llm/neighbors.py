"""Nearest neighbours by largest inner product: cross-polytope hashing with multiprobe by norm bands, exact reranking.

Stored vectors are parted into bands of near equal norm (a factor of 1.25), where the inner product orders much as the
angle does.  Each of ``tables`` pseudo-rotations (three rounds of random signs and a fast Hadamard transform) sends a
vector's direction to its nearest signed axis; a query also looks into the buckets of its next nearest axes.  A band
whose buckets gave a query too few rows is searched whole for it, unless the band's largest norm cannot reach the
query's list.
Buckets and bands are cut into cells of bounded size, both ways, and every cell is one block product in double precision.

Equal vectors are one search: of any number of copies only the smallest ``k + 1`` ids can be among a query's ``k``
nearest (ties go to smaller ids), so copies beyond those cannot matter and no bucket fills up with them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsense.llm.common import arrow_map, arrow_schema, ship_package, stored

TABLES, PROBES = 14, 16
#: Rows of a cell: stored vectors, queries.
CELL_ROWS, CELL_QUERIES = 8192, 1024
#: Natural logarithm of the widest ratio of norms in a band.
BAND = float(np.log(1.25))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two), orthonormal."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """``x`` (rows of a power of two) under pseudo-rotation ``table``."""
    signs = np.random.default_rng([seed, table, x.shape[1]]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def axes(x: np.ndarray, table: int, seed: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes (2 x axis + sign) of the rows of ``x``, filled up to a power of two above."""
    n, d = x.shape
    wide = np.zeros((n, 1 << int(d).bit_length()))
    wide[:, :d] = x
    r = rotated(wide, table, seed)
    both = np.empty((n, 2 * r.shape[1]))
    both[:, 0::2], both[:, 1::2] = r, -r
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    probes = min(probes, both.shape[1])
    return np.argpartition(-both, probes - 1, axis=1)[:, :probes]


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``x`` (none all zero) at length 1, and the logarithms of their norms."""
    largest = np.abs(x).max(axis=1)
    x = x / largest[:, None]
    norm = np.sqrt((x * x).sum(axis=1))
    return x / norm[:, None], np.log(largest) + np.log(norm)


def usable(vector: str):
    """Vectors that take part: not null, no null or non-finite component, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(vector).isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.array([np.frombuffer(v, kind) for v in column.to_pylist()])


def nearest(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES,
            probes: int = PROBES, seed: int = 11) -> DataFrame:
    """The ``k`` nearest found for every query row (``is_query``: a condition on ``key``): query_id, rank, vec_id, score.

    Candidates are all rows but the query's own, of the query's dimension; nearest first, ties to the smaller key, the
    score being the inner product of the original vectors in double precision.  Rows with a null key, or whose vector
    ``usable`` refuses, take no part; a query with fewer candidates than ``k`` gets them all.  Of rows that share a key
    the one with the smallest vector takes part.  An empty table gives no rows; other columns don't matter.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kind = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & usable("v"))
    total, keys = rows.agg(F.count("id"), F.count_distinct("id")).first()
    if keys < total:
        rows = stored(rows.groupBy("id").agg(F.min("v").alias("v")), "ann-keys")
    copies = Window.partitionBy("v").orderBy("id")
    candidates = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("id", "v")
    asked = rows.where(is_query(F.col("id")))
    reps = stored(asked.groupBy("v").agg(F.min("id").alias("id")), "ann-queries")

    def bucketed(df: DataFrame, query: bool) -> DataFrame:
        def run(batch: pa.RecordBatch):
            lists = [np.array(v, kind) for v in batch.column("v").to_pylist()]
            sizes = np.array([len(v) for v in lists])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x, log_norm = directions(np.array([lists[i] for i in at], np.float64))
                near = np.stack([axes(x, t, seed, probes if query else 1) for t in range(tables)], axis=1)
                places = near + np.arange(tables)[None, :, None] * (1 << 20)
                yield {"id": batch.column("id").take(pa.array(at)), "v": [lists[i].tobytes() for i in at],
                       "d": np.full(len(at), d), "log_norm": log_norm, "band": np.floor(log_norm / BAND + 0.5).astype(np.int32),
                       "buckets": pa.array(places.reshape(len(at), -1).tolist(), pa.list_(pa.int64()))}

        made = arrow_map(df.select("id", "v"), run, "id long, v binary, d int, log_norm double, band int, buckets array<long>", batch_rows=2048)
        return stored(made, "ann-hashed")

    data, queries = bucketed(candidates, False), bucketed(reps, True)
    # one row a band: its size and largest norm
    bands = stored(data.groupBy("d", "band").agg(F.count(F.lit(1)).alias("n"), F.max("log_norm").alias("top")), "ann-bands")
    spread = lambda df: df.select("id", "v", "d", "band", F.explode("buckets").alias("bucket"))
    found = _search(spread(data), spread(queries.drop("band").join(bands.select("d", "band"), "d")), ["d", "band", "bucket"], k, kind)
    # the bands to search whole for a query: those that gave it too few rows, if their largest norm can reach its list
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    last = found.withColumn("r", F.row_number().over(order)).where(F.col("r") == k + 1).select(F.col("q").alias("id"), F.col("score").alias("last"))
    got = found.groupBy(F.col("q").alias("id"), "band").agg(F.count(F.lit(1)).alias("got"))
    whole = queries.select("id", "d", "log_norm").join(bands, "d").join(got, ["id", "band"], "left").join(last, "id", "left")
    whole = whole.where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k + 1), "n")).where(F.col("last").isNull() | (F.exp(F.col("log_norm") + F.col("top")) * (1 + 1e-9) >= F.col("last")))
    whole = stored(whole.select("id", "band"), "ann-whole").join(queries.drop("band"), "id")
    found = found.unionByName(_search(data, whole, ["d", "band"], k, kind)).groupBy("q", "id").agg(F.max("score").alias("score"))
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("q", "id", "score")
    # every query takes its vector's list, without itself
    members = asked.select(F.col("id").alias("query_id"), "v").join(reps.select(F.col("id").alias("q"), "v"), "v").select("query_id", "q")
    lists = members.join(found, "q").where("id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return (lists.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias("vec_id"), "score"))


def _search(data: DataFrame, queries: DataFrame, at: list[str], k: int, kind: str) -> DataFrame:
    """The k + 1 nearest in each band of what ``data`` holds at a query's places ``at``: q, band, id, score."""
    # one row a place: how many cells it needs each way
    cells = data.groupBy(at).agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("nd"))
    cells = cells.join(queries.groupBy(at).agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).cast("int").alias("nq")), at)
    cells = stored(cells, "ann-cells")
    salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    cell = [*at, "sd", "sq"]
    left = (data.join(cells, at).withColumn("sd", salt("nd"))
            .withColumn("sq", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).select(*cell, "id", "v"))
    right = (queries.join(cells, at).withColumn("sq", salt("nq"))
             .withColumn("sd", F.explode(F.sequence(F.lit(0), F.col("nd") - 1))).select(*cell, "id", "v"))
    schema = "q long, band int, id long, score double"
    arrow = arrow_schema(data.sparkSession, schema)

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        q, ids, score = _block(a, b, k, kind)
        band = np.full(len(q), a.column("band")[0].as_py() if len(q) else 0)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip((q, band, ids, score), arrow)], schema=arrow)

    found = left.groupBy(cell).cogroup(right.groupBy(cell)).applyInArrow(block, schema)
    found = found.groupBy("q", "band", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q", "band").orderBy(F.desc("score"), "id")
    return stored(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r"), "ann-found")


def _block(a: pa.Table, b: pa.Table, k: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k + 1 nearest of cell ``a`` for each query of cell ``b``."""
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not a.num_rows or not b.num_rows:
        return empty
    x, y = (_matrix(t.column("v"), kind).astype(np.float64) for t in (a, b))
    ids, asked = a.column("id").to_numpy(), b.column("id").to_numpy()
    out = []
    for at in range(0, len(y), 128):
        s = y[at:at + 128] @ x.T
        if s.shape[1] > k + 1:
            least = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1]
            # block products round a little differently: whoever may belong is summed again, the same way everywhere
            i, j = np.nonzero(s >= least[:, None] - 1e-9 * (1 + np.abs(least[:, None])))
        else:
            i, j = np.divmod(np.arange(s.size), s.shape[1])
        score = (y[at + i] * x[j]).sum(axis=1)
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place <= k
        out.append((asked[at + i[keep]], ids[j[keep]], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*out))
