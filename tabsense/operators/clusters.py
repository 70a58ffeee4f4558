"""Clustering (k-means, Ward agglomerative, DBSCAN) and cluster quality.

k-means is Spark ML.  Ward runs over clustering features, summed up by task and
merged, that stand for rows within a radius (0 for up to ``CELLS`` distinct
rows, where the result is exact); ``ward_exact`` is the plain form for at most
``MICRO`` rows.  DBSCAN: small cells whose points are all
within eps of each other make dense regions units without a pair; the rest is
compared in blocks that hand out counts and units, never pairs of points
(see :func:`cluster_dbscan`).  The silhouette is the exact Euclidean one, by
pairs of blocks; the squared form is linear.  The other indices are aggregates
over points and a k x k table of centroids (k is small).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsense.functions.numeric import col
from tabsense.functions.schema import ROW_ID
from tabsense.operators.models import SEED, assemble
from tabsense.operators.rows import with_row_index
from tabsense.session import materialize, ship_package

# Fixed values of the reference's clustering setup.
N_CLUSTERS = 3          # k-means and Ward
EPS = 0.5               # DBSCAN radius
MIN_SAMPLES = 5         # DBSCAN core threshold (the point itself included)
# Our own parameters.
MICRO = 256             # rows of the plain exact Ward
CELLS = 1024            # clustering features that Ward runs over at most
GRID_DIMS = 3           # dimensions used for DBSCAN's cells of side eps
BLOCK_ROWS = 4096       # points of a block, each side


def kmeans_model(df: DataFrame, features: list[str], k: int = N_CLUSTERS, seed: int = SEED):
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(assemble(df, features))


def cluster_kmeans(df: DataFrame, features: list[str], k: int = N_CLUSTERS) -> DataFrame:
    """row_id + features + ``cluster`` (0..k-1).  The vectors are written
    once: the fit and the labels read them instead of the columns' plans."""
    data = materialize(assemble(df, features), "kmeans-rows")
    m = KMeans(k=k, seed=SEED, featuresCol="features", predictionCol="cluster").fit(data)
    return m.transform(data).select(ROW_ID, *features, "cluster")


def _ward(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Exact Ward merge of weighted points.  The merge cost
    n_a n_b / (n_a + n_b) |c_a - c_b|^2 is kept in a matrix and updated by
    the Lance-Williams rule after each merge (O(m^2) per merge, m <= MICRO)."""
    m = len(points)
    pts = points.astype(float)
    size = weights.astype(float).copy()
    sq = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    cost = size[:, None] * size[None, :] / (size[:, None] + size[None, :]) * sq
    np.fill_diagonal(cost, np.inf)
    alive = np.ones(m, dtype=bool)
    members = {i: [i] for i in range(m)}
    for _ in range(m - k):
        flat = np.argmin(np.where(alive[:, None] & alive[None, :], cost, np.inf))
        a, b = divmod(int(flat), m)
        if a > b:
            a, b = b, a
        na, nb, nk = size[a], size[b], size
        new = ((na + nk) * cost[a] + (nb + nk) * cost[b] - nk * cost[a, b]) / (na + nb + nk)
        cost[a, :] = new
        cost[:, a] = new
        cost[a, a] = np.inf
        cost[b, :] = np.inf
        cost[:, b] = np.inf
        size[a] = na + nb
        alive[b] = False
        members[a] += members.pop(b)
    labels = np.empty(m, dtype=int)
    for lab, key in enumerate(sorted(members, key=lambda key: min(members[key]))):
        labels[members[key]] = lab
    return labels


def ward_exact(df: DataFrame, features: list[str], k: int = N_CLUSTERS, most: int = MICRO) -> DataFrame:
    """Exact Ward clustering of at most ``most`` rows (it needs all pairs); more rows
    raise ValueError."""
    data = assemble(df, features).select(ROW_ID, vector_to_array("features").alias("v"))
    rows = data.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"exact Ward clustering takes at most {most} rows")
    rows.sort(key=lambda r: r[ROW_ID])
    labels = _ward(np.array([r["v"] for r in rows]), np.ones(len(rows)), min(k, len(rows)))
    lab = df.sparkSession.createDataFrame([(r[ROW_ID], int(x)) for r, x in zip(rows, labels)], f"{ROW_ID} long, cluster int")
    return df.join(F.broadcast(lab), ROW_ID).select(ROW_ID, *features, "cluster")


class Features:
    """Clustering features: sums of bounded number, each of points near each other (weight, mean, squares around the mean,
    first row).  A point or feature joins the nearest one while the root mean square distance to the common mean stays
    within ``radius``; when there are more than ``most``, the radius grows until they are few enough again."""

    def __init__(self, dims: int, radius: float, most: int):
        self.radius, self.most, self.count = radius, most, 0
        self.n, self.mean, self.square = np.zeros(2 * most), np.zeros((2 * most, dims)), np.zeros(2 * most)
        self.first = np.zeros(2 * most, np.int64)

    def add(self, n: np.ndarray, mean: np.ndarray, square: np.ndarray, first: np.ndarray) -> None:
        for i in range(len(n)):
            if self.count:
                far = ((self.mean[:self.count] - mean[i]) ** 2).sum(axis=1)
                at = int(np.argmin(far))
                total = self.n[at] + n[i]
                spread = self.square[at] + square[i] + self.n[at] * n[i] / total * far[at]
                if spread <= self.radius ** 2 * total:
                    self.mean[at] += (mean[i] - self.mean[at]) * (n[i] / total)
                    self.n[at], self.square[at], self.first[at] = total, spread, min(self.first[at], first[i])
                    continue
            at, self.count = self.count, self.count + 1
            self.n[at], self.mean[at], self.square[at], self.first[at] = n[i], mean[i], square[i], first[i]
            if self.count > self.most:
                self._shrink()

    def _shrink(self) -> None:
        """A larger radius, about the typical distance to the nearest other one, and all features anew."""
        old = [a[:self.count].copy() for a in (self.n, self.mean, self.square, self.first)]
        some = old[1][:: max(1, self.count // 256)]
        far = ((some[:, None, :] - old[1][None, :, :]) ** 2).sum(-1)
        far[far == 0] = np.inf
        self.radius = max(2 * self.radius, float(np.sqrt(np.median(far.min(axis=1)))) / 2)
        self.count = 0
        self.add(*old)

    def rows(self) -> tuple[np.ndarray, ...]:
        return tuple(a[:self.count] for a in (self.n, self.mean, self.square, self.first))


def ward_chain(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Ward labels of weighted points by nearest-neighbour chains: time grows with the square of the points, memory with
    the points.  Merges are found out of order and then made cheapest first, which gives the same tree."""
    m, size, mean = len(points), weights.astype(float).copy(), points.astype(float).copy()
    alive, merges, chain = np.ones(m, bool), [], []
    for _ in range(m - 1):
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            a = chain[-1]
            cost = size * size[a] / (size + size[a]) * ((mean - mean[a]) ** 2).sum(axis=1)
            cost[~alive] = np.inf
            cost[a] = np.inf
            b = int(np.argmin(cost))
            if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
                b = chain[-2]
                break
            chain.append(b)
        merges.append((float(cost[b]), a, b))
        chain = chain[:-2]
        keep, gone = min(a, b), max(a, b)
        total = size[a] + size[b]
        mean[keep] = (size[a] * mean[a] + size[b] * mean[b]) / total
        size[keep], alive[gone] = total, False
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for _, a, b in sorted(merges, key=lambda t: t[0])[:max(0, m - k)]:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return np.unique([find(i) for i in range(m)], return_inverse=True)[1]


def cluster_agglomerative(df: DataFrame, features: list[str], k: int = N_CLUSTERS, radius: float = 0.0, cells: int = CELLS) -> DataFrame:
    """Ward clustering into ``k`` clusters over clustering features.

    Each task sums its rows up to features of at most ``radius`` (0: equal
    rows only), the tasks' features are summed up in groups and then in one
    task, and Ward's method runs over them; rows take the cluster of the
    nearest feature.  Up to ``cells`` distinct rows a radius of 0 holds, and
    the result is exact Ward; beyond, the radius grows until there are at
    most ``cells`` features.  Clusters are numbered by their first row.
    """
    ship_package(df.sparkSession)
    width = len(features)
    rows = df.select(ROW_ID, F.array(*[col(c).cast("double") for c in features]).alias("v"))
    kind = "n double, mean array<double>, square double, first long, radius double"
    names = ["n", "mean", "square", "first", "radius"]

    def table(held: Features) -> list[pa.Array]:
        n, mean, square, first = held.rows()
        return [pa.array(n), pa.array(list(mean), pa.list_(pa.float64())), pa.array(square), pa.array(first), pa.array(np.full(len(n), held.radius))]

    def local(batches):
        held = Features(width, radius, cells)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                held.add(np.ones(len(x)), x, np.zeros(len(x)), batch.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays(table(held), names=names)

    def merged(parts: pa.Table) -> pa.Table:
        held = Features(width, max(parts["radius"].to_pylist(), default=radius), cells)
        order = np.argsort(parts["first"].to_numpy())
        held.add(parts["n"].to_numpy()[order], _matrix(parts, "mean")[order], parts["square"].to_numpy()[order], parts["first"].to_numpy()[order])
        return pa.Table.from_arrays(table(held), names=names)

    def clustered(parts: pa.Table) -> pa.Table:
        held = merged(parts)
        mean, first = _matrix(held, "mean"), held["first"].to_numpy()
        label = ward_chain(mean, held["n"].to_numpy(), min(k, len(mean)))
        lowest = np.array([first[label == c].min() for c in range(label.max() + 1)])
        return pa.table({"mean": held["mean"], "cluster": pa.array(np.argsort(np.argsort(lowest))[label].astype(np.int32))})

    made = materialize(rows.mapInArrow(local, kind).withColumn("part", F.spark_partition_id()), "ward-features")
    groups = max(1, int(made.select("part").distinct().count() ** 0.5))
    fewer = made.groupBy(F.pmod("part", F.lit(groups)).alias("g")).applyInArrow(merged, kind)
    final = materialize(fewer.groupBy(F.lit(0).alias("g")).applyInArrow(clustered, "mean array<double>, cluster int"), "ward-clusters").collect()
    centres, labels = np.array([r["mean"] for r in final]).reshape(len(final), width), np.array([r["cluster"] for r in final], np.int32)

    def nearest(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                at = np.concatenate([((x[i:i + 64, None, :] - centres[None, :, :]) ** 2).sum(-1).argmin(axis=1) for i in range(0, len(x), 64)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels[at])], names=[ROW_ID, "cluster"])

    found = rows.mapInArrow(nearest, f"{ROW_ID} long, cluster int")  # at most ``cells`` centres travel with it
    return df.join(found, ROW_ID).select(ROW_ID, *features, "cluster")


def _components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connected components (label = smallest node id) by min-label
    propagation with pointer jumping, until nothing changes; each round is
    checkpointed."""
    und = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    lab = materialize(nodes.select(F.col("id"), F.col("id").alias("lab")))
    und = materialize(und, "edges")
    while True:
        nb = (und.join(lab.withColumnRenamed("id", "b").withColumnRenamed("lab", "lb"), "b")
              .groupBy("a").agg(F.min("lb").alias("m")))
        new = (lab.join(nb, lab["id"] == nb["a"], "left")
               .select("id", F.least("lab", F.coalesce("m", "lab")).alias("lab")))
        # pointer jumping: follow the label's own label once
        hop = new.select(F.col("id").alias("lab"), F.col("lab").alias("lab2"))
        new = new.join(hop, "lab", "left").select("id", F.least("lab", F.coalesce("lab2", "lab")).alias("lab"))
        new = materialize(new)
        changed = new.join(lab.withColumnRenamed("lab", "old"), "id").where(F.col("lab") != F.col("old")).limit(1).count()
        lab = new
        if changed == 0:
            break
    return lab


def _matrix(table: pa.Table, name: str = "v") -> np.ndarray:
    lists = table[name].combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _close(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Which points of ``x`` and ``y`` are within eps: a matrix product settles all but the pairs near the border, whose
    differences are squared."""
    sx, sy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    far = sx[:, None] + sy - 2 * (x @ y.T) - eps * eps
    close = far <= 0
    i, j = np.nonzero(np.abs(far) <= 1e-9 * (sx[:, None] + sy + eps * eps))
    if len(i):
        close[i, j] = ((x[i] - y[j]) ** 2).sum(axis=1) <= eps * eps
    return close


def _in_blocks(left: DataFrame, right: DataFrame, eps_cells: int, fn, schema: str) -> DataFrame:
    """``fn(left rows, right rows)`` for every point of ``left`` and all points of ``right`` in its cell or one beside it,
    in blocks of at most about ``BLOCK_ROWS`` rows a side: a cell of any size is split."""
    offsets = F.array(*[F.array(*[F.lit(x) for x in o]) for o in itertools.product((-1, 0, 1), repeat=eps_cells)])
    beside = left.withColumn("off", F.explode(offsets)).withColumn("cell", F.zip_with("cell", "off", lambda x, y: x + y)).drop("off")
    parts = lambda df, n: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(n))
    ways = materialize(parts(beside, "nl").join(parts(right, "nr"), "cell"), "dbscan-cells")
    salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = beside.join(ways, "cell").withColumn("sl", salt("nl")).withColumn("sr", every("nr"))
    b = right.join(ways, "cell").withColumn("sr", salt("nr")).withColumn("sl", every("nl"))
    b = b.select(*[F.col(c).alias(f"r_{c}") for c in ("cell", "sl", "sr", "id", "v", "w", "unit")])

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        return fn(x, y.rename_columns([c[2:] for c in y.column_names]))

    return (a.select("cell", "sl", "sr", "id", "v", "w", "unit").groupBy("cell", "sl", "sr")
            .cogroup(b.groupBy("r_cell", "r_sl", "r_sr")).applyInArrow(run, schema))


def cluster_dbscan(df: DataFrame, features: list[str], eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """DBSCAN labels (noise = -1, clusters 0.. ordered by their first core
    row).  Border points take the smallest neighbouring core label.

    Identical points are one weighted point.  Points in one cell of side
    eps / sqrt(features), over all features, are within eps of each other: a
    cell that holds ``min_samples`` is core as a whole, and one unit.  Only
    points of sparser cells count their neighbours.  Units are joined where a
    point of one is within eps of a core point of the other.  Both
    comparisons run over blocks of cells of side eps (the first three
    features; distances always over all) and give one row a point or a pair
    of units, so no output grows with the pairs of points.
    """
    ship_package(df.sparkSession)
    m = min(len(features), GRID_DIMS)
    pts = df.select(ROW_ID, F.array(*[col(c).cast("double") for c in features]).alias("v"))
    side = eps / len(features) ** 0.5 * (1 - 1e-9)
    uniq = pts.groupBy("v").agg(F.min(ROW_ID).alias("id"), F.count(F.lit(1)).alias("w"))
    fine = F.hash(F.transform("v", lambda x: F.floor(x / side))), F.xxhash64(F.transform("v", lambda x: F.floor(x / side)))
    uniq = materialize(uniq.select("id", "v", "w", fine[0].alias("f1"), fine[1].alias("f2"),
                                   F.array(*[F.floor(F.col("v")[j] / eps).cast("long") for j in range(m)]).alias("cell")), "dbscan-points")
    dense = uniq.groupBy("f1", "f2").agg(F.sum("w").alias("n"), F.min("id").alias("unit")).where(F.col("n") >= min_samples).select("f1", "f2", "unit")
    placed = materialize(uniq.join(dense, ["f1", "f2"], "left").drop("f1", "f2"), "dbscan-placed")

    def count(x: pa.Table, y: pa.Table) -> pa.Table:
        total = np.zeros(x.num_rows, np.int64)
        if x.num_rows and y.num_rows:
            v, other, w = _matrix(x), _matrix(y), y["w"].to_numpy()
            for at in range(0, len(v), 256):
                total[at:at + 256] = _close(v[at:at + 256], other, eps) @ w
        return pa.table({"id": x["id"].cast(pa.int64()), "n": pa.array(total)})

    sparse = placed.where("unit IS NULL")
    counts = _in_blocks(sparse, placed, m, count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    core = counts.where(F.col("n") >= min_samples).select("id", F.col("id").alias("own"))
    # every core point knows its unit: its dense cell, or itself
    known = materialize(placed.join(core, "id", "left").withColumn("unit", F.coalesce("unit", "own")).drop("own"), "dbscan-core")

    def touch(x: pa.Table, y: pa.Table) -> pa.Table:
        out: set[tuple[int, int, bool]] = set()
        if x.num_rows and y.num_rows:
            v, other, units = _matrix(x), _matrix(y), y["unit"].to_numpy()
            order = np.argsort(units, kind="stable")
            other, units = other[order], units[order]
            names, starts = np.unique(units, return_index=True)
            own = np.array([-1 if u is None else u for u in x["unit"].to_pylist()])
            ids = x["id"].to_numpy()
            # a unit against a unit: blocks, until the first close pair; other points by themselves
            for u in np.unique(own[own >= 0]):
                mine = v[own == u]
                for k, (name, start) in enumerate(zip(names, starts)):
                    theirs = other[start:starts[k + 1] if k + 1 < len(starts) else len(other)]
                    if name != u and not (name < u and (name, u, True) in out) and _touching(mine, theirs, eps):
                        out.add((max(u, name), min(u, name), True))
            for at in range(0, len(v), 256):
                rows = np.flatnonzero(own[at:at + 256] < 0) + at
                if len(rows):
                    near = np.logical_or.reduceat(_close(v[rows], other, eps), starts, axis=1)
                    out |= {(int(ids[rows[i]]), int(names[j]), False) for i, j in zip(*np.nonzero(near))}
        a, b, both = zip(*out) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "core": pa.array(both, pa.bool_())})

    cores = known.where("unit IS NOT NULL")
    links = materialize(_in_blocks(known, cores, m, touch, "a long, b long, core boolean").distinct(), "dbscan-links")
    comp = _components(links.where("core").select("a", "b"), cores.select(F.col("unit").alias("id")).distinct())
    border = links.where("NOT core").join(comp.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("lab").alias("lab"))
    labelled = cores.select("id", "unit").join(comp.withColumnRenamed("id", "unit"), "unit").select("id", "lab").unionByName(border)
    # a unit's name is its first row, so a component's label is its first core row: clusters are numbered by it
    order = with_row_index(comp.select("lab").distinct(), ["lab"], name="cluster")
    node_label = labelled.join(order.select("lab", F.col("cluster").cast("int").alias("cluster")), "lab")
    uniq_lab = uniq.select("v", "id").join(node_label.select("id", "cluster"), "id", "left")
    return (pts.join(uniq_lab, "v", "left")
            .select(ROW_ID, F.coalesce("cluster", F.lit(-1)).alias("cluster"))
            .join(df.select(ROW_ID, *features), ROW_ID)
            .select(ROW_ID, *features, "cluster"))


def _touching(x: np.ndarray, y: np.ndarray, eps: float) -> bool:
    """Whether two sets hold points within eps: boxes first, then blocks, nearest to the other set's middle first."""
    gap = np.maximum(0, np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)))
    if (gap * gap).sum() > eps * eps * (1 + 1e-9):
        return False
    x, y = (p[np.argsort(((p - q.mean(axis=0)) ** 2).sum(axis=1))] for p, q in ((x, y), (y, x)))
    for i in range(0, len(x), 256):
        for j in range(0, len(y), 256):
            if _close(x[i:i + 256], y[j:j + 256], eps).any():
                return True
    return False


def silhouette(df: DataFrame, features: list[str], label: str = "cluster") -> float | None:
    """Mean silhouette with Euclidean distance, exact: the sums of a point's
    distances by cluster come from pairs of blocks of rows, each pair taken
    once for both sides, so the output is a row a point, block and cluster.
    The work grows with the square of the rows (the index is defined so);
    :func:`silhouette_squared` is linear."""
    ship_package(df.sparkSession)
    data = df.where(col(label).isNotNull()).select(F.monotonically_increasing_id().alias("id"), col(label).cast("string").alias("k"),
                                                   F.array(*[col(c).cast("double") for c in features]).alias("v"))
    data = materialize(data, "silhouette-rows")
    sizes = data.groupBy("k").agg(F.count(F.lit(1)).alias("size"))
    if sizes.limit(2).count() < 2:
        return None
    blocks = max(1, -(-data.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    spread = data.withColumn("b", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = spread.select(F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "b", "id", "k", "v")

    def sums(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = (x.as_py() for x in key)
        b = rows["b"].to_numpy()
        sides = [rows.filter(pa.array(b == s)) for s in ((i,) if i == j else (i, j))]
        out: dict[str, list] = {"id": [], "k": [], "sum": []}
        for here, there in ((sides[0], sides[-1]),) if i == j else ((sides[0], sides[1]), (sides[1], sides[0])):
            if not here.num_rows or not there.num_rows:
                continue
            x, y = _matrix(here), _matrix(there)
            names, code = np.unique(there["k"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            member = np.zeros((len(y), len(names)))
            member[np.arange(len(y)), code] = 1
            for at in range(0, len(x), 256):
                p = x[at:at + 256]
                d = np.sqrt(np.maximum((p * p).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * p @ y.T, 0))
                if i == j:
                    d[np.arange(len(p)), at + np.arange(len(p))] = 0.0
                total = d @ member
                out["id"] += np.repeat(here["id"].to_numpy()[at:at + 256], len(names)).tolist()
                out["k"] += names.tolist() * len(p)
                out["sum"] += total.ravel().tolist()
        return pa.table({"id": pa.array(out["id"], pa.int64()), "k": pa.array(out["k"], pa.string()), "sum": pa.array(out["sum"], pa.float64())})

    found = pairs.groupBy("i", "j").applyInArrow(sums, "id long, k string, sum double").groupBy("id", "k").agg(F.sum("sum").alias("sum"))
    own = data.select("id", F.col("k").alias("own"))
    rows = found.join(sizes, "k").join(own, "id")
    mean = rows.groupBy("id").agg(
        F.max(F.when((F.col("k") == F.col("own")) & (F.col("size") > 1), F.col("sum") / (F.col("size") - 1))).alias("a"),
        F.min(F.when(F.col("k") != F.col("own"), F.col("sum") / F.col("size"))).alias("b"))
    # a point alone in its cluster has silhouette 0
    value = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return mean.agg(F.avg(value)).first()[0]


def silhouette_squared(df: DataFrame, features: list[str], label: str = "cluster") -> float | None:
    """Mean silhouette with squared Euclidean distance (Spark's linear-time form)."""
    data = assemble(df, features).withColumn(label, col(label).cast("double"))
    if data.select(label).distinct().limit(2).count() < 2:
        return None
    ev = ClusteringEvaluator(featuresCol="features", predictionCol=label, metricName="silhouette",
                             distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(data))


def _centroids(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(__k, __n, __c): size and centroid (an array) of every cluster."""
    return df.groupBy(col(label).alias("__k")).agg(F.count(F.lit(1)).alias("__n"), F.array(*[F.avg(col(c)) for c in features]).alias("__c"))


def _square(x: Column, y: Column) -> Column:
    """Squared distance of two arrays."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def davies_bouldin(df: DataFrame, features: list[str], label: str = "cluster") -> float | None:
    """mean over i of max over j != i of (S_i + S_j) / d(c_i, c_j); equal
    centroids count as infinitely far apart.  Centroids and scatters are
    aggregates; the k x k part runs over pairs of blocks of clusters and gives
    a row a cluster and block, so any number of clusters stays distributed."""
    ship_package(df.sparkSession)
    cents = materialize(_centroids(df, features, label), "centroids")
    point = F.array(*[col(c).cast("double") for c in features])
    scatter = df.join(cents, col(label) == F.col("__k")).groupBy("__k").agg(F.avg(F.sqrt(_square(point, F.col("__c")))).alias("s"))
    rows = with_row_index(cents.join(scatter, "__k").select(F.col("__k").cast("string").alias("k"), "s", F.col("__c").alias("v")), ["k"], name="id")
    count = rows.count()
    if count < 2:
        return None
    blocks = -(-count // 2048)
    left = rows.withColumn("i", F.pmod("id", F.lit(blocks))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("j", F.pmod("id", F.lit(blocks))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def worst(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "r": pa.array([], pa.float64())})
        v, other = _matrix(x), _matrix(y.rename_columns([c.removeprefix("r_") for c in y.column_names]))
        ids, theirs = x["id"].to_numpy(), y["r_id"].to_numpy()
        out = np.empty(len(v))
        for at in range(0, len(v), 64):
            far = np.sqrt(((v[at:at + 64, None, :] - other[None, :, :]) ** 2).sum(-1))
            far[far == 0] = np.inf
            ratio = (x["s"].to_numpy()[at:at + 64, None] + y["r_s"].to_numpy()[None, :]) / far
            ratio[ids[at:at + 64, None] == theirs[None, :]] = -np.inf  # j != i
            out[at:at + 64] = ratio.max(axis=1)
        return pa.table({"id": ids, "r": out})

    named = right.select(*[F.col(c).alias(f"r_{c}") for c in ("i", "j", "id", "s", "v")])
    found = left.select("i", "j", "id", "s", "v").groupBy("i", "j").cogroup(named.groupBy("r_i", "r_j")).applyInArrow(worst, "id long, r double")
    return found.groupBy("id").agg(F.max("r").alias("r")).agg(F.avg("r")).first()[0]


def calinski_harabasz(df: DataFrame, features: list[str], label: str = "cluster") -> float | None:
    """(B / (k - 1)) / (W / (n - k)); 1.0 when W is 0.  Only sums reach the driver."""
    cents = materialize(_centroids(df, features, label), "centroids")
    mean = df.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(col(c)) for c in features]).alias("g")).first()
    between = cents.agg(F.sum(F.col("__n") * _square(F.col("__c"), F.lit(np.array(mean["g"], float)))).alias("b"), F.count(F.lit(1)).alias("k")).first()
    if between["k"] < 2:
        return None
    point = F.array(*[col(c).cast("double") for c in features])
    within = df.join(cents, col(label) == F.col("__k")).agg(F.sum(_square(point, F.col("__c")))).first()[0]
    if not within:
        return 1.0
    return (between["b"] / (between["k"] - 1)) / (within / (mean["n"] - between["k"]))


def cluster_projection(df: DataFrame, features: list[str], label: str = "cluster") -> DataFrame:
    """2-D PCA coordinates (centred) + label."""
    from pyspark.ml.feature import PCA
    data = assemble(df, features)
    means = data.agg(*[F.avg(col(c)).alias(c) for c in features]).first()
    centred = assemble(df.withColumns({c: col(c).cast("double") - F.lit(means[c]) for c in features}), features)
    model = PCA(k=min(2, len(features)), inputCol="features", outputCol="pc").fit(centred)
    out = model.transform(centred).withColumn("pc", vector_to_array("pc"))
    return out.select(ROW_ID, F.col("pc")[0].alias("x"),
                      (F.col("pc")[1] if len(features) > 1 else F.lit(0.0)).alias("y"), col(label).alias("cluster"))


def cluster_report(df: DataFrame, features: list[str], models: tuple[str, ...] = ("KMeans", "AgglomerativeClustering", "DBSCAN")) -> DataFrame:
    """One row per clustering model: number of valid clusters (noise
    excluded) and the indices, or a note (any failure is raised).  The
    Euclidean silhouette's work grows with the square of the rows."""
    rows = []
    run = {"KMeans": cluster_kmeans, "AgglomerativeClustering": cluster_agglomerative, "DBSCAN": cluster_dbscan}
    for name in models:
        lab = materialize(run[name](df, features), "labels")
        k = lab.where("cluster <> -1").select("cluster").distinct().count()
        if k >= 2:
            rows.append((name, k, silhouette(lab, features), silhouette_squared(lab, features), davies_bouldin(lab, features),
                         calinski_harabasz(lab, features), None))
        else:
            rows.append((name, k, None, None, None, None, "fewer than 2 clusters"))
    return df.sparkSession.createDataFrame(
        rows, "model string, n_clusters long, silhouette double, silhouette_sq_euclidean double, davies_bouldin double, calinski_harabasz double, note string")
