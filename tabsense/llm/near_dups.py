"""Near duplicates by BagMinHash over the multiset of word shingles.

An element of weight w is a Poisson process over the levels (0, w]: levels are discretised into (0, 1], (1, 2], (2, 4],
(4, 8], ...; each interval is one process whose rate is its width, and where w lies inside an interval a point's level
(a split of that interval, halving by halving) decides whether it counts.  Every point goes to one of the signature's
places; a place keeps its earliest point.  Two multisets agree at a place with the probability of their weighted
Jaccard similarity, and points later than the last place to fill need not be made, so the cost follows the number of
elements, not their weights.

Bands of the signature give candidates, the exact multiset overlap verifies them, and verified links make classes.
Texts with equal multisets are one text from the start.  Inside a bucket pairs are not expanded: every member is
tried with the bucket's first member and with its neighbour in sorted order; then, only where a bucket still holds
more than one class, the members outside its largest class meet the members of other classes in blocks, which hand out
one verified link a member and class at most.  So every link between two texts that share a bucket is tried, unless
other links already put them in one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsense.llm.common import arrow_map, number_rows, release, ship_package, splitmix, stored
from tabsense.llm.graphs import components
from tabsense.llm.wordhash import RunHasher, batch_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Chance to miss a link of similarity 0.8: (1 - 0.8^7)^44, 3 in 100,000.
BANDS, ROWS = 44, 7
#: Places of the signature that estimate a similarity before texts are compared, and the standard deviations that an
#: estimate may lie below the threshold (a link is passed over with probability below 1 in 100,000).
SKETCH, SLACK = 256, 4.5
#: Members of a block, each side, and bytes of their multisets.
BLOCK_ROWS, BLOCK_BYTES = 4096, 64_000_000
#: Texts that get their signatures at once, and elements of a block's multisets that are compared with a text's at once.
BATCH_ROWS, COMPARED = 64, 500_000
_SHINGLE_BASE = 0x9E6C63D0876A9A47


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words; a text with fewer words is one run."""
    if not len(hashes):
        return hashes
    at = np.arange(max(1, len(hashes) - n + 1))
    return RunHasher(hashes, _SHINGLE_BASE)(at, np.minimum(at + n, len(hashes)))


def multiset(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(hashes, n), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted elements, counts); two empty ones are not alike."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    union = int(a[1].sum()) + int(b[1].sum()) - low
    return low / union if union else 0.0


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)


def bag_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, places: int) -> np.ndarray:
    """Signatures (docs x places, 64-bit) of weighted sets: rows (doc number, element hash, positive whole weight).

    Documents without elements get zeros.
    """
    out = np.zeros((docs, places), np.uint64)
    if not len(doc):
        return out
    # one process an interval: level 0 is (0, 1], level j is (2^(j-1), 2^j]
    levels = np.frexp(weight - 0.5)[1].clip(min=0) + 1
    row = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    base = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    rate = np.where(level > 0, base, 1.0)
    cut = (weight[row] - base) / rate  # share of the interval that lies below the weight; 1 or more: all of it
    owner, seed = doc[row], splitmix(element[row] + splitmix(level.astype(np.uint64) + np.uint64(0x51_7C_C1_B7)))
    total = np.bincount(doc, weights=weight, minlength=docs)
    limit = np.zeros(docs)
    limit[total > 0] = places * (np.log(places) + 3) / total[total > 0]
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[owner])
        time, count, block = np.zeros(len(live)), 0, 1
        earliest = np.full(docs * places, np.inf)
        found = []
        while len(live):  # the next points of every process at once: few at first, more for those that go on
            at = (np.arange(count, count + block, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
            key = splitmix(seed[live][:, None] + at)
            times = time[:, None] + np.cumsum(-np.log(_uniform(key)) / rate[live][:, None], axis=1)
            row, col = np.nonzero(times <= limit[owner[live]][:, None])
            key, t = key[row, col], times[row, col]
            second = splitmix(key ^ np.uint64(0xD1B54A32D192ED03))
            counts_ = _uniform(splitmix(second + np.uint64(0x8CB92BA72F3D8DD7))) <= cut[live[row]]
            cell = (owner[live[row]] * places + (second % np.uint64(places)).astype(np.int64))[counts_]
            found.append((cell, t[counts_], key[counts_]))
            np.minimum.at(earliest, cell, t[counts_])
            goes_on = times[:, -1] <= limit[owner[live]]
            live, time = live[goes_on], times[goes_on, -1]
            count, block = count + block, min(64, 2 * block)
        for cell, t, key in found:
            first = t == earliest[cell]
            out.reshape(-1)[cell[first]] = key[first]
        done = np.isfinite(earliest).reshape(docs, places).all(axis=1)
        todo &= ~done  # some place got no point in time: those documents run again for longer
        limit *= 2
    return out


def signatures(docs: DataFrame, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Rows (doc, d1, d2, total, keys): multiset digest (null without words), number of shingles, one key a band."""
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column("doc")
        for numbers, _, hashes, offsets, _, _ in batch_hashes(batch.column("text").to_pylist()):
            sets = [multiset(hashes[offsets[j]:offsets[j + 1]], n) for j in range(len(numbers))]
            sizes = np.array([len(s[0]) for s in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            element, weight = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets])
            sig = bag_min_hash(owner, element, weight, len(sets), bands * rows)
            sketch = np.ascontiguousarray((sig[:, :SKETCH] >> np.uint64(40)).astype(np.uint16)).view("<i2")
            keys = np.zeros((len(sets), bands), np.uint64)
            for r in range(rows):
                keys = splitmix(keys + sig[:, r::rows])
            keys = splitmix(keys ^ np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)
            mixed = splitmix(element + splitmix(weight.astype(np.uint64)))
            digests = []
            for salt in (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D):
                sums = np.zeros(len(sets), np.uint64)
                np.add.at(sums, owner, splitmix(mixed ^ np.uint64(salt)))
                digests.append(pa.array(sums.view(np.int64), mask=sizes == 0))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
            yield {"doc": ids.take(pa.array(numbers)), "d1": digests[0], "d2": digests[1],
                   "total": np.bincount(owner, weights=weight, minlength=len(sets)).astype(np.int64), "keys": flat,
                   "sketch": pa.array(list(sketch), pa.list_(pa.int16()))}

    return arrow_map(docs, run, "doc long, d1 long, d2 long, total long, keys array<long>, sketch array<smallint>", batch_rows=BATCH_ROWS)


def verified(pairs: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' multisets overlap enough."""
    left = texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        own: dict[int, str] = {}
        for ids, texts_ in ((a, "text_a"), (b, "text_b")):
            for i, t in zip(ids.tolist(), batch.column(texts_)):
                if i not in own:
                    own[i] = t.as_py()
        keys, sets = list(own), {}
        for numbers, _, hashes, offsets, _, _ in batch_hashes(list(own.values())):
            for j, i in enumerate(numbers):
                sets[keys[i]] = multiset(hashes[offsets[j]:offsets[j + 1]], n)
        good = np.array([overlap(sets[x], sets[y]) >= similarity for x, y in zip(a.tolist(), b.tolist())], bool)
        yield {"a": a[good], "b": b[good]}

    return arrow_map(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b"), run, "a long, b long")


def neighbours(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows that follow one another in (key, next) order and share the key.

    A global sort instead of a window by key: a key of any size is spread over the ranges (a pair on the border of
    two ranges is left to the later rounds).
    """
    ship_package(members.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            key, doc = batch.column("key").to_numpy(), batch.column("doc").to_numpy()
            if last is not None:
                key, doc = np.concatenate(([last[0]], key)), np.concatenate(([last[1]], doc))
            if len(key):
                last = key[-1], doc[-1]
            same = key[1:] == key[:-1]
            x, y = doc[:-1][same], doc[1:][same]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (members.select("key", "next", "doc").repartitionByRange(n, "key", "next", "doc")
            .sortWithinPartitions("key", "next", "doc").mapInArrow(run, "a long, b long").where("a != b"))


def near_duplicates(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Class of every text of ``docs`` (doc: distinct longs, not null; text): rows (doc, class_id, n_shingles).

    ``class_id`` is the smallest doc connected with it by links of weighted Jaccard similarity ``similarity`` or more
    between the multisets of ``n``-word shingles.  A text of fewer words is one shingle, so equal short texts are one
    class; texts without words (null, empty) are each their own class.
    """
    spark = docs.sparkSession
    sigs = stored(signatures(docs, n, bands, rows), "near-signatures")
    known = sigs.where("d1 IS NOT NULL")
    firsts = stored(known.groupBy("d1", "d2").agg(F.min("doc").alias("rep")), "near-firsts")
    distinct = known.join(firsts.select(F.col("rep").alias("doc")), "doc", "left_semi")
    exploded = distinct.select("doc", F.col("keys").alias("k"), F.posexplode("keys").alias("band", "key"))
    in_bands = exploded.select("key", F.get("k", F.pmod(F.col("band") + 1, F.lit(bands))).alias("next"), "doc")
    buckets = in_bands.groupBy("key").agg(F.min("doc").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    members = stored(in_bands.join(buckets, "key"), "near-members")
    release(spark)
    to_hub = members.where("doc != hub").select(F.col("doc").alias("a"), F.col("hub").alias("b"))
    pairs = stored(to_hub.unionByName(neighbours(members)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "near-pairs")
    texts = stored(docs.join(members.select("doc").distinct(), "doc", "left_semi").select("doc", "text"), "near-texts")
    release(spark)

    # first the most promising links of each text, which settle most classes
    best = Window.partitionBy("a").orderBy(F.desc("n"), "b")
    chosen = pairs.withColumn("place", F.row_number().over(best)).where("place <= 2").select("a", "b")
    links = stored(verified(chosen, texts, n, similarity), "near-links")
    classes = components(links)
    # then the other candidates whose ends are not in one class yet
    rest = stored(apart(pairs.join(chosen, ["a", "b"], "left_anti").select("a", "b"), classes), "near-rest")
    links = stored(links.unionByName(verified(rest, texts, n, similarity)), "near-links")
    classes = components(links)
    # then what mixed buckets still hold apart
    left = across(members.select("key", "doc"), classes, distinct.select("doc", "keys", "sketch", "total"), texts, n, similarity)
    if left is not None:
        links = stored(links.unionByName(left), "near-links")
        classes = components(links)
    release(spark)
    reps = firsts.join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left")
    reps = reps.select("d1", "d2", F.coalesce("component", "rep").alias("_class"))
    return (sigs.select("doc", "d1", "d2", "total").join(reps, ["d1", "d2"], "left")
            .select("doc", F.coalesce("_class", "doc").alias("class_id"), F.col("total").alias("n_shingles")))


def classified(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``doc`` (a distinct number in the order of ``key``), ``class_id`` (the smallest doc of its class) and
    ``n_shingles``; see ``near_duplicates``.  Columns of those names are replaced.  Rows with null or repeated keys are
    told apart and ordered by the key (null first), then by the other columns."""
    made = ["doc", "class_id", "n_shingles"]
    numbered = number_rows(df.select(*[F.col(f"`{c}`") for c in df.columns if c not in made]), key)
    classes = near_duplicates(numbered.select("doc", F.col(f"`{text}`").alias("text")))
    return numbered.join(classes, "doc")


def apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose ends are in different classes (a node without a class is its own)."""
    for end in ("a", "b"):
        own = classes.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        pairs = pairs.join(own, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return pairs.where("ca != cb").select("a", "b")


def multisets(texts: DataFrame, n: int) -> DataFrame:
    """Rows (doc, elements, weights): the multiset of each text, as 64-bit and 32-bit numbers."""
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column("doc")
        for numbers, _, hashes, offsets, _, _ in batch_hashes(batch.column("text").to_pylist()):
            sets = [multiset(hashes[offsets[j]:offsets[j + 1]], n) for j in range(len(numbers))]
            yield {"doc": ids.take(pa.array(numbers)), "elements": [e.astype("<u8").tobytes() for e, _ in sets],
                   "weights": [w.astype("<i4").tobytes() for _, w in sets]}

    return arrow_map(texts, run, "doc long, elements binary, weights binary")


def across(members: DataFrame, classes: DataFrame, sigs: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame | None:
    """Verified links (a > b) between classes that share a bucket: members outside the bucket's largest class with all
    others, for every such member and every other class one link if there is any; nothing when no bucket is mixed."""
    placed = (members.join(classes.withColumnRenamed("node", "doc"), "doc", "left")
              .select("key", "doc", F.coalesce("component", "doc").alias("c")))
    placed = stored(placed, "near-placed")
    sizes = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    largest = (sizes.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count(F.lit(1)).alias("classes"))
               .where("classes > 1").select("key", "main"))
    mixed = stored(placed.join(largest, "key"), "near-mixed")
    if mixed.isEmpty():
        return None
    docs = mixed.select("doc").distinct()
    known = stored(sigs.join(docs, "doc", "left_semi").join(multisets(texts.join(docs, "doc", "left_semi"), n), "doc"), "near-multisets")
    size = F.octet_length("elements") + F.octet_length("weights")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("size") / BLOCK_BYTES)).cast("int")
    sized = mixed.join(known.select("doc", size.alias("size")), "doc")
    ways = (sized.groupBy("key").agg(blocks.alias("na"))
            .join(sized.where("c != main").groupBy("key").agg(blocks.alias("nf")), "key"))
    whole = mixed.join(ways, "key").join(known, "doc")
    salt = lambda m: F.pmod(F.xxhash64("doc"), F.col(m)).cast("int")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    columns = ["key", "sf", "sa", "doc", "c", "main", "keys", "sketch", "total", "elements", "weights"]
    few = whole.where("c != main").withColumn("sf", salt("nf")).withColumn("sa", spread("na")).select(columns)
    every = whole.withColumn("sa", salt("na")).withColumn("sf", spread("nf")).select(*[F.col(x).alias(f"y_{x}") for x in columns])
    least = int(SKETCH * similarity - SLACK * (SKETCH * similarity * (1 - similarity)) ** 0.5)
    cell = ["key", "sf", "sa"]

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = _linked(left, right.rename_columns(left.column_names), similarity, least) if left.num_rows and right.num_rows else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return few.groupBy(cell).cogroup(every.groupBy(*[f"y_{x}" for x in cell])).applyInArrow(block, "a long, b long")


def _common(e: np.ndarray, w: np.ndarray, elements: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """What the multiset (e, w) has in common with each of some others, none empty."""
    flat, flat_w = np.concatenate(elements), np.concatenate(weights)
    at = np.minimum(np.searchsorted(e, flat), len(e) - 1)
    low = np.where(e[at] == flat, np.minimum(w[at], flat_w), 0).astype(np.int64)
    sizes = np.array([len(x) for x in elements])
    return np.add.reduceat(low, np.cumsum(sizes) - sizes)


def _linked(left: pa.Table, right: pa.Table, similarity: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row of ``left`` and every other class of ``right`` the best link.

    A pair is looked at in the first bucket that it shares, and only when the sizes allow the similarity and the
    signatures agree about often enough; then the multisets themselves decide.
    """
    def matrix(table: pa.Table, name: str, kind) -> np.ndarray:
        return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(table.num_rows, -1)

    def views(table: pa.Table, name: str, kind: str) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), kind) for x in table[name]]

    key = left["key"][0].as_py()
    keys_x, keys_y = matrix(left, "keys", np.int64), matrix(right, "keys", np.int64)
    sketch_x, sketch_y = matrix(left, "sketch", np.int16), matrix(right, "sketch", np.int16)
    x, cx, tx, main = (left[c].to_numpy() for c in ("doc", "c", "total", "main"))
    y, cy, ty = (right[c].to_numpy() for c in ("doc", "c", "total"))
    elements, weights = views(right, "elements", "<u8"), views(right, "weights", "<i4")
    lengths = np.array([len(e) for e in elements])
    own = list(zip(views(left, "elements", "<u8"), views(left, "weights", "<i4")))
    out_a, out_b = [], []
    for i in range(len(x)):
        # of two members outside the largest class only one way round
        pick = np.flatnonzero((cy != cx[i]) & ((cy == main[i]) | (x[i] > y)) & (np.minimum(ty, tx[i]) >= similarity * np.maximum(ty, tx[i])))
        pick = pick[(sketch_y[pick] == sketch_x[i]).sum(axis=1) >= least]
        shared = keys_y[pick] == keys_x[i]
        pick = pick[keys_x[i][shared.argmax(axis=1)] == key]
        if not len(pick):
            continue
        e, w = own[i]
        ends = np.cumsum(lengths[pick])
        parts = np.split(pick, np.searchsorted(ends, np.arange(COMPARED, ends[-1], COMPARED)))
        both = np.concatenate([_common(e, w, [elements[j] for j in p], [weights[j] for j in p]) for p in parts if len(p)])
        alike = both / (tx[i] + ty[pick] - both)
        good = alike >= similarity
        pick, alike = pick[good], alike[good]
        order = np.lexsort((y[pick], -alike))
        _, first = np.unique(cy[pick][order], return_index=True)
        out_a += [x[i]] * len(first)
        out_b += y[pick][order][first].tolist()
    return np.array(out_a, np.int64), np.array(out_b, np.int64)
