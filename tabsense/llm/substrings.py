"""Substring dedup by seed and extend.

Every window of ``window`` words selects one of its k-word runs by winnowing (smallest hash, rightmost on ties); equal
windows select equal anchors at equal places.  Consecutive windows that select the same anchor form a run.  Documents
are joined on anchors that occur more than once (the seeds); each seed is extended both ways to the whole run of
windows around it.  A run that stands word for word somewhere earlier is repeated as a whole; where an anchor's runs
differ (at the edges of a repeated passage), its windows are compared one by one.  Overlapping repeated windows join
to maximal repeats of at least ``window`` words.

Nothing is paired up within a group: groups only give their earliest member, by an aggregate that is combined before
the shuffle, so a passage shared by a third of the corpus is a sum, not a list.  Runs and windows are compared by
128 bits of hash (anchor and run hash; two window hashes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import arrow_map, number_rows, release, stored
from tabsense.llm.wordhash import RunHasher, batch_hashes

WINDOW = 20
ANCHOR = 8
_RUN_BASE, _WINDOW_BASE, _SECOND_BASE = 0xC2B2AE3D27D4EB4F, 0x9E3779B185EBCA87, 0x165667B19E3779F9


def select_anchors(hashes: np.ndarray, k: int, window: int) -> np.ndarray:
    """For each window of a sequence of k-run hashes (one more than its length less the windows' span) the place of
    the k-run it selects."""
    span = window - k + 1
    n = len(hashes) - span + 1
    best, place = hashes[:n].copy(), np.arange(n)
    for j in range(1, span):
        other = hashes[j:n + j]
        better = other <= best
        best[better] = other[better]
        place[better] = np.flatnonzero(better) + j
    return place


def runs_of(hashes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Anchor hash, run hash, first window and number of windows of each run of a text, given its word hashes."""
    n = len(hashes)
    if n < window:
        return None
    hasher = RunHasher(hashes, _RUN_BASE)
    at = np.arange(n - k + 1)
    grams = hasher(at, at + k)
    place = select_anchors(grams, k, window)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    count = np.diff(np.append(first, len(place)))
    return grams[place[first]], hasher(first, first + count - 1 + window), first, count


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def all_runs(docs: DataFrame, window: int, k: int) -> DataFrame:
    """Rows (anchor, run, doc, first, count) of all texts of ``docs`` (doc, text)."""
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column("doc").to_numpy(zero_copy_only=False)
        for numbers, _, hashes, offsets, _, _ in batch_hashes(batch.column("text").to_pylist()):
            made = [(ids[i], runs_of(hashes[offsets[j]:offsets[j + 1]], window, k)) for j, i in enumerate(numbers)]
            made = [(i, r) for i, r in made if r is not None]
            if made:
                a, d, first, count = (np.concatenate(x) for x in zip(*(r for _, r in made)))
                yield {"anchor": _signed(a), "run": _signed(d), "doc": np.repeat(np.array([i for i, _ in made], np.int64), [len(r[0]) for _, r in made]),
                       "first": first.astype(np.int32), "count": count.astype(np.int32)}

    return arrow_map(docs, run, "anchor long, run long, doc long, first int, count int")


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """Windows of ``docs`` (doc: distinct longs, text) that also start earlier: rows (doc, first, count), each for
    ``count`` windows starting at words ``first``, ``first + 1``, ...  "Earlier" is a smaller doc, or an earlier start."""
    runs = all_runs(docs, window, k)
    # what counts are joined with is written first: a join of two tables can split a hot anchor, one with an aggregate can't
    often = stored(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "substring-often")
    seeds = stored(runs.join(often, "anchor", "left_semi"), "substring-seeds")
    release(docs.sparkSession)
    earliest = F.min(F.struct("doc", "first"))
    groups = stored(seeds.groupBy("anchor", "run").agg(earliest.alias("e"), F.count(F.lit(1)).alias("n")), "substring-groups")
    # anchors whose runs differ: their earliest runs are compared window by window
    mixed = stored(groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor"), "substring-mixed")
    shared = groups.where("n > 1").select("anchor", "run", F.col("e.doc").alias("e_doc"), F.col("e.first").alias("e_first"))
    again = seeds.join(shared, ["anchor", "run"]).where("doc != e_doc OR first != e_first").select("doc", "first", "count")
    whole = stored(again, "substring-runs")
    edges = stored(groups.join(mixed, "anchor", "left_semi").select("e.doc", "e.first")
                        .join(seeds.select("doc", "first", "count"), ["doc", "first"]), "substring-edges")
    release(docs.sparkSession)
    windows = stored(_windows(docs, edges, window), "substring-windows")
    release(docs.sparkSession)
    two = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "at")).alias("e"), F.count(F.lit(1)).alias("n")).where("n > 1")
    two = stored(two.select("w1", "w2", F.col("e.doc").alias("e_doc"), F.col("e.at").alias("e_at")), "substring-repeated")
    single = windows.join(two, ["w1", "w2"]).where("doc != e_doc OR at != e_at").select("doc", F.col("at").alias("first"), F.lit(1).alias("count"))
    single = stored(single, "substring-single")
    release(docs.sparkSession)
    return whole.unionByName(single)


def _windows(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """Both hashes of every window of the given runs: rows (w1, w2, doc, at)."""
    wanted = runs.groupBy("doc").agg(F.collect_list(F.struct("first", "count")).alias("runs"))  # one text's own runs
    rows = docs.join(wanted, "doc")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, texts, lists = batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("runs").to_pylist()
        for numbers, _, hashes, offsets, _, _ in batch_hashes(texts):
            out = []
            for j, i in enumerate(numbers):
                at = np.concatenate([np.arange(r["first"], r["first"] + r["count"]) for r in lists[i]])
                own = hashes[offsets[j]:offsets[j + 1]]
                out.append((RunHasher(own, _WINDOW_BASE)(at, at + window), RunHasher(own, _SECOND_BASE)(at, at + window), np.full(len(at), ids[i]), at))
            w1, w2, doc, at = (np.concatenate(x) for x in zip(*out))
            yield {"w1": _signed(w1), "w2": _signed(w2), "doc": doc, "at": at.astype(np.int32)}

    return arrow_map(rows, run, "w1 long, w2 long, doc long, at int")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """``df`` without the words covered by windows that also start earlier (a smaller key, or earlier in the same text).

    Adds ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by single spaces), replacing columns of those
    names.  Null texts have no words; texts under ``window`` words lose nothing; of one word
    repeated ``window`` times or more the first stays (every later window starts earlier, too).  Rows with null or repeated keys are told apart and ordered by the key (null first), then
    by the other columns.
    """
    made = ["n_words", "n_removed", "kept"]
    plain = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in made])
    numbered = number_rows(plain, key, "_doc")
    docs = numbered.select(F.col("_doc").alias("doc"), F.col(f"`{text}`").alias("text"))
    spans = repeated_spans(docs, window, k).groupBy("doc").agg(F.collect_list(F.struct("first", "count")).alias("_spans"))
    rows = numbered.join(spans.withColumnRenamed("doc", "_doc"), "_doc", "left")
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in plain.schema.fields]
                       + ["n_words long", "n_removed long", "kept string"])

    names = list(plain.columns)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        lists = batch.column("_spans").to_pylist()
        for numbers, data, hashes, offsets, first, end in batch_hashes(batch.column(text).to_pylist()):
            base = np.cumsum([0] + [len(d) + 1 for d in data])
            out = {"n_words": [], "n_removed": [], "kept": []}
            for j, i in enumerate(numbers):
                n = int(offsets[j + 1] - offsets[j])
                gone = np.zeros(n + 1, np.int64)
                for s in lists[i] or ():
                    gone[s["first"]] += 1
                    gone[min(n, s["first"] + s["count"] - 1 + window)] -= 1
                stays = np.cumsum(gone[:n]) == 0
                a, b = first[offsets[j]:offsets[j + 1]][stays] - base[j], end[offsets[j]:offsets[j + 1]][stays] - base[j]
                out["n_words"].append(n)
                out["n_removed"].append(n - int(stays.sum()))
                out["kept"].append(b" ".join([data[j][x:y] for x, y in zip(a.tolist(), b.tolist())]).decode("utf-8", "surrogatepass"))
            own = batch.take(pa.array(numbers))
            yield out | {c: own.column(c) for c in names}

    return arrow_map(rows, run, schema)
