"""Ranked lexical search by pipelined term partitioning.

The vocabulary of the items is dealt to a few term owners, rarest terms first.  Documents are indexed in segments of
bounded size; a bundle (segment, item) carries the sparse accumulators of that item's documents in the segment through
the owners' stages: each stage cogroups the bundles with the owner's postings of the segment and adds their integer
contributions.  The rare owners come first, so the bundles that travel are thin; the last owner, which holds the common
terms, selects at once.  No task ever holds more than one segment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsense.llm.common import arrow_map, arrow_schema, release, ship_package, stored
from tabsense.llm.wordhash import word_hashes
from tabsense.operators.rows import with_row_index

#: Documents of an index segment at most (local numbers are 16 bits).
SEGMENT_DOCS = 8192
#: Items that go through the documents together (their accumulators for one segment fit a task); more items take
#: further passes.
ITEMS_A_PASS = 1024
#: Bytes of text split into terms at once.
CHUNK_BYTES = 4_000_000
#: Share of all postings that the owners up to each stage hold together.
OWNERS = (1 / 64, 1 / 16, 1 / 4, 1.0)
TOP = 50

# fixed by the contract: terms are runs of ASCII letters and digits and of everything beyond ASCII; only A-Z is lowered
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

_INDEX = "segment long, term int, docs binary, counts binary, ids array<long>, n_docs long, n_terms long"
_BUNDLES = "segment long, item int, docs binary, scores binary, ids array<long>"


def folded(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """All texts as one run of bytes with every separator a space, and where each begins."""
    parts = [(t or "").encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts]
    return b" ".join(parts), np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]


def term_places(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, first bytes, lengths) of the terms of ``data``, a chunk at a time, cut between terms."""
    at = 0
    while at < len(data):
        cut = len(data) if len(data) - at <= CHUNK_BYTES else data.find(b" ", at + CHUNK_BYTES)
        cut = len(data) if cut < 0 else cut
        hashes, first, end = word_hashes(data[at:cut])
        yield hashes, first + at, end - first
        at = cut


class Vocabulary:
    """Numbers of known terms, looked up for many terms at once; a hit has equal bytes, not only an equal hash."""

    def __init__(self, terms: list[bytes]):
        self.buffer = np.frombuffer(b"".join(terms), np.uint8)
        lengths = np.array([len(t) for t in terms], np.int64)
        hashes = np.concatenate([word_hashes(t)[0] for t in terms]) if terms else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order
        if len(np.unique(self.hashes)) != len(terms):
            raise ValueError("two terms of the vocabulary have one 64-bit hash")
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, raw: np.ndarray, hashes: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms are known, and their numbers."""
        if not len(self.hashes) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        number = self.number[place]
        same = (self.hashes[place] == hashes[maybe]) & (self.lengths[number] == lengths[maybe])
        maybe, number = maybe[same], number[same]
        if len(maybe):
            n = lengths[maybe]
            before = np.cumsum(n) - n
            step = np.arange(int(n.sum()))
            equal = raw[np.repeat(first[maybe] - before, n) + step] == self.buffer[np.repeat(self.starts[number] - before, n) + step]
            whole = np.logical_and.reduceat(equal, before)
            maybe, number = maybe[whole], number[whole]
        return maybe, number


def index(docs: DataFrame, key: str, text: str, vocabulary: list[bytes]) -> DataFrame:
    """Segments of ``docs``: a head (term null: ids, terms of each document, sums) and a row a term that it holds."""
    ship_package(docs.sparkSession)
    schema = arrow_schema(docs.sparkSession, _INDEX)

    def flush(segment: int, ids: list, lengths: list, hits: list) -> Iterator[pa.RecordBatch]:
        n = np.concatenate(lengths)
        yield pa.RecordBatch.from_arrays([
            pa.array([segment]), pa.array([None], pa.int32()), pa.array([None], pa.binary()), pa.array([n.astype("<i8").tobytes()]),
            pa.array([ids], pa.list_(pa.int64())), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], schema=schema)
        doc, term, count = (np.concatenate(x) for x in zip(*hits)) if hits else (np.zeros(0, np.int64),) * 3
        if len(doc):
            order = np.lexsort((doc, term))
            doc, term, count = doc[order], term[order], count[order]
            starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
            ends = np.append(starts[1:], len(term))
            offsets = np.append(starts, len(term))
            binary = lambda a: pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((offsets * a.itemsize).astype(np.int32)), pa.py_buffer(a)])
            none = lambda kind: pa.nulls(len(starts), kind)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(starts), segment)), pa.array(term[starts].astype(np.int32)), binary(doc.astype("<u2")),
                binary(count.astype("<i4")), none(pa.list_(pa.int64())), pa.array(ends - starts), none(pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = Vocabulary(vocabulary), None
        ids, lengths, hits = [], [], []
        for batch in batches:
            if number is None and batch.num_rows:
                number = batch.column(2)[0].as_py() << 32
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if len(ids) + part.num_rows > SEGMENT_DOCS:
                    yield from flush(number, ids, lengths, hits)
                    ids, lengths, hits, number = [], [], [], number + 1
                data, begins = folded(part.column(1).to_pylist())
                raw, n = np.frombuffer(data, np.uint8), np.zeros(part.num_rows, np.int64)
                for hashes, first, size in term_places(data):
                    doc = np.searchsorted(begins, first, "right") - 1
                    n += np.bincount(doc, minlength=part.num_rows)
                    found, term = known.find(raw, hashes, first, size)
                    cell, count = np.unique(doc[found] * len(vocabulary) + term, return_counts=True)
                    hits.append((cell // max(1, len(vocabulary)) + len(ids), cell % max(1, len(vocabulary)), count))
                ids += part.column(0).to_pylist()
                lengths.append(n)
        if ids:
            yield from flush(number, ids, lengths, hits)

    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"),
                       F.spark_partition_id().alias("part")).mapInArrow(run, _INDEX)


def item_terms(items: DataFrame, text: str) -> DataFrame:
    """Rows (item, term): the distinct terms of every item, as bytes."""
    def run(batch: pa.RecordBatch) -> dict:
        item, term = [], []
        for i, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
            for w in set(folded([t])[0].split()):
                item.append(i)
                term.append(w)
        return {"item": pa.array(item, pa.int64()), "term": pa.array(term, pa.binary())}

    return arrow_map(items.select("item", F.col(f"`{text}`").alias("text")), run, "item long, term binary")


def weight(documents: int, holding: int) -> int:
    """The contract's term weight, in doubles."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def owners(holding: np.ndarray, shares: tuple[float, ...] = OWNERS) -> np.ndarray:
    """Stage of each term: terms by rising document frequency, dealt by their share of all postings."""
    order = np.argsort(holding, kind="stable")
    upto = np.cumsum(holding[order]) / max(1, int(holding.sum()))
    stage = np.empty(len(holding), np.int64)
    stage[order] = np.minimum(np.searchsorted(np.array(shares[:-1]), upto), len(shares) - 1)
    return stage


def _add(bundles: pa.Table, postings: pa.Table, plan: dict[int, list[int]], weights: np.ndarray, average: tuple[int, int]):
    """Head of a segment, and its items' accumulators with one owner's contributions added."""
    head = bundles.slice(pc.index(bundles["item"].is_null(), True).as_py(), 1).to_pylist()[0]
    n = np.frombuffer(head["scores"], "<i8")
    m = 50 + (50 * n * average[0]) // max(1, average[1])
    held = {}
    for term, docs, counts in zip(postings["term"].to_pylist(), postings["docs"].to_pylist(), postings["counts"].to_pylist()):
        at, tf = np.frombuffer(docs, "<u2"), np.frombuffer(counts, "<i4").astype(np.int64)
        held[term] = at, int(weights[term]) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[at]))
    sums = {}
    for item, docs, scores in zip(bundles["item"].to_pylist(), bundles["docs"].to_pylist(), bundles["scores"].to_pylist()):
        if item is not None:
            sums[item] = np.frombuffer(docs, "<u2"), np.frombuffer(scores, "<i8")
    for item, terms in plan.items():
        met = [held[t] for t in terms if t in held]
        if met:
            dense = np.zeros(len(n), np.int64)
            for at, score in ([sums[item]] if item in sums else []) + met:
                dense[at] += score  # a document is once in a list
            at = np.flatnonzero(dense)
            sums[item] = at.astype("<u2"), dense[at]
    return head, sums


def _best(ids: list, at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a list by (score, id), null ids last."""
    if len(at) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at, scores = at[scores >= least], scores[scores >= least]
    own = [ids[i] for i in at.tolist()]
    order = np.lexsort(([0 if i is None else i for i in own], [i is None for i in own], -scores))[:k]
    return at[order], scores[order]


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
           item_text: str = "text", k: int = TOP, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """The ``k`` documents of highest score above 0 of every item: rows (item_id, rank, doc_id, score).

    ``docs`` has an integer key; other columns don't matter.  Null and empty texts hold no term.  Each row is a
    document of its own, also when keys repeat or are null; equal scores go by ascending key, null last.  Each row of
    ``items`` is an item; one without terms, or whose terms no document holds, gives no row, and so do empty tables.
    """
    spark = docs.sparkSession
    numbered = with_row_index(items.select(F.col(f"`{item_key}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")), ["item_id"], name="item")
    count = numbered.agg(F.max("item")).first()[0]
    kind = items.schema[item_key].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long, item long")
    for begin in range(0, -1 if count is None else count + 1, items_a_pass):
        now = numbered.where((F.col("item") >= begin) & (F.col("item") < begin + items_a_pass))
        found = _one_pass(docs, now, key, text, k)
        if found is not None:
            out = out.unionByName(found.join(now.select("item", "item_id"), "item").select("item_id", "doc_id", "score", "item"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return (out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def _one_pass(docs: DataFrame, items: DataFrame, key: str, text: str, k: int) -> DataFrame | None:
    """Best documents of each segment for a bounded number of items: rows (item, doc_id, score)."""
    spark = docs.sparkSession
    asked = sorted(tuple(r) for r in item_terms(items, "text").collect())  # of at most ITEMS_A_PASS items
    vocabulary = sorted({bytes(t) for _, t in asked})
    number = {t: i for i, t in enumerate(vocabulary)}
    if not vocabulary:
        return None
    made = stored(index(docs, key, text, vocabulary), "lexical-index")
    total = made.where("term IS NULL").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    average = total[0] or 0, total[1] or 0
    holding = np.zeros(len(vocabulary), np.int64)
    for term, n in made.where("term IS NOT NULL").groupBy("term").agg(F.sum("n_docs")).collect():  # a row a term asked for
        holding[term] = n
    weights = np.array([weight(average[0], int(h)) for h in holding])
    stage = owners(holding)
    plans = [{} for _ in OWNERS]
    for item, term in asked:
        plans[stage[number[bytes(term)]]].setdefault(item, []).append(number[bytes(term)])
    owner = spark.createDataFrame([(t, int(s)) for t, s in enumerate(stage)], "term int, owner int")
    postings = made.where("term IS NOT NULL").join(F.broadcast(owner), "term")  # a row a term asked for
    bundles = made.where("term IS NULL").select("segment", F.lit(None).cast("int").alias("item"), F.lit(None).cast("binary").alias("docs"),
                                                F.col("counts").alias("scores"), "ids")
    for at, plan in enumerate(plans[:-1]):
        if plan:
            bundles = stored(_stage(bundles, postings.where(F.col("owner") == at), plan, weights, average), f"lexical-owner{at}")
            release(spark)
    return _stage(bundles, postings.where(F.col("owner") == len(plans) - 1), plans[-1], weights, average, k)


def _stage(bundles: DataFrame, postings: DataFrame, plan: dict, weights: np.ndarray, average: tuple[int, int], k: int | None = None) -> DataFrame:
    """One owner: bundles (segment, item) with its contributions added or, with ``k``, the best documents of each."""
    kind = _BUNDLES if k is None else "item int, doc_id long, score long"
    schema = arrow_schema(bundles.sparkSession, kind)

    def carry(left: pa.Table, right: pa.Table) -> pa.Table:
        head, sums = _add(left, right, plan, weights, average)
        items = list(sums)
        return pa.Table.from_arrays([
            pa.array([head["segment"]] * (len(items) + 1)), pa.array([None, *items], pa.int32()),
            pa.array([None] + [sums[i][0].tobytes() for i in items], pa.binary()),
            pa.array([head["scores"]] + [sums[i][1].tobytes() for i in items], pa.binary()),
            pa.array([head["ids"]] + [None] * len(items), pa.list_(pa.int64()))], schema=schema)

    def select(left: pa.Table, right: pa.Table) -> pa.Table:
        head, sums = _add(left, right, plan, weights, average)
        item, doc, score = [], [], []
        for i, (at, scores) in sums.items():
            at, scores = _best(head["ids"], at, scores, k)
            item += [i] * len(at)
            doc += [head["ids"][j] for j in at.tolist()]
            score += scores.tolist()
        return pa.Table.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], schema=schema)

    own = postings.select(F.col("segment").alias("of"), "term", "docs", "counts")  # a new name: both may come from one table
    both = bundles.groupBy("segment").cogroup(own.groupBy("of"))
    return both.applyInArrow(carry if k is None else select, kind)
