"""Token-id files: blocks of ids coded by an adaptive context-mixing range coder.

A file set is a folder of Parquet files whose rows are blocks.  A block starts from an empty model and carries its own
checksums, so any block can be read alone.  Its ids are laid out in lanes (consecutive runs of equal length) that are
coded side by side, one id of every lane a step, with one model that learns from all lanes:

* order 0: counts of the ids so far;
* order 1 and order 2: for each context (the id before; a hash of the two before, in the lane) the id that followed
  last and how often it did in a row;
* mixing: each id's interval is the weighted sum of the three predictions.  The weights are adaptive too: for each pair
  of confidences, how often order 2, order 1 or neither was right so far.

Every lane has a carry-less range coder (64-bit low and range, 16-bit words).  A step's updates are applied after the
step, later lanes last, in the encoder and in the decoder alike.

Block layout (little endian): ``TIDB``, version u16, model vocabulary u32, documents u32, ids u64, lanes u32, crc32 of
all ids (as u32) u32, crc32 of the body u32; body: ids of each document u32[], keys i64[], key present u8[], words of
each lane u32[], words u16[].
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsense.llm import library_tokens
from tabsense.llm.common import arrow_map, arrow_schema, ordered_parts, ship_package

HEADER = struct.Struct("<4sHIIQIII")
MAGIC, VERSION = b"TIDB", 1
#: Ids after which a block is closed (at the end of a document).
BLOCK_IDS = 1 << 21
LANES = 8192
_HASHED = 1 << 18
_MIX = 4096
_STEP_COUNT = 24
#: The next confidence after a miss (from 0 to 15) and after a hit.
_SURER = np.array([c >> 1 for c in range(16)] + [min(c + 1, 15) for c in range(16)])
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_TOP, _BOT, _WORD, _TOP_SHIFT = np.uint64(1 << 48), np.uint64(1 << 40), np.uint64(16), np.uint64(48)


class Model:
    """The predictions; identical in encoder and decoder after equal updates."""

    def __init__(self, vocabulary: int, lanes: int):
        v = self.v = vocabulary
        self.count = np.ones(v, np.int64)
        self.fresh: list[np.ndarray] = []
        self.below = np.zeros(v + 1, np.int64)
        self.freq = np.zeros(v + 1, np.int64)  # as of the last recount, with 0 for "none"
        self.recount()
        # the id that followed a context times 16, and how often it did in a row (0 to 15); candidate v stands for
        # "none": beyond all ids, no order-0 count
        self.after1, self.after2 = np.full(v + 1, v << 4, np.int64), np.full(_HASHED, v << 4, np.int64)
        self.right2, self.right1, self.seen = np.full(512, 0.4), np.full(512, 0.2), np.full(512, 1.0)
        self.before1 = np.full(lanes, v, np.int64)
        self.before2 = np.full(lanes, v, np.int64)
        self.steps = 0

    def recount(self) -> None:
        if self.fresh:
            self.count += np.bincount(np.concatenate(self.fresh), minlength=self.v) * _STEP_COUNT
            self.fresh = []
        if self.count.sum() > 1 << 21:
            self.count = (self.count + 1) >> 1
        np.cumsum(self.count, out=self.below[1:])
        self.freq[:-1] = self.count
        self.total0 = int(self.below[-1])

    def predict(self, k: int) -> None:
        """Predictions for the first ``k`` lanes."""
        one = self.at1 = self.before1[:k]
        two = self.at2 = ((self.before2[:k] * 0x9E3779B1 + one * 0x85EBCA6B) >> 7) & (_HASHED - 1)
        a1, a2 = self.held1, self.held2 = self.after1.take(one), self.after2.take(two)
        s1, s2 = self.s1, self.s2 = a1 >> 4, a2 >> 4
        self.sure1, self.sure2 = a1 & 15, a2 & 15
        cell = self.cell = (self.sure2 * 16 + self.sure1) * 2 + (s1 == s2)
        share = (_MIX - 32) / self.seen
        weight2, weight1 = (self.right2 * share).astype(np.int64), (self.right1 * share).astype(np.int64)
        weight1[1::2] = 0  # cells of equal candidates
        self.m2, self.m1 = weight2.take(cell) * (s2 < self.v), weight1.take(cell) * (s1 < self.v)
        self.m0 = _MIX - self.m1 - self.m2

    def interval(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Low end and length of each lane's id, out of ``_MIX * total0``."""
        low = self.m0 * self.below.take(s) + ((self.s1 < s) * self.m1 + (self.s2 < s) * self.m2) * self.total0
        size = self.m0 * self.freq.take(s) + ((self.s1 == s) * self.m1 + (self.s2 == s) * self.m2) * self.total0
        return low, size

    def symbol(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id whose interval holds each lane's value, and the interval: one of the candidates', or by order 0."""
        low1, size1 = self.interval(self.s1)
        low2, size2 = self.interval(self.s2)
        in1, in2 = (value >= low1) & (value < low1 + size1), (value >= low2) & (value < low2 + size2)
        s, low, size = np.where(in1, self.s1, self.s2), np.where(in1, low1, low2), np.where(in1, size1, size2)
        lane = np.flatnonzero(~(in1 | in2))
        if len(lane):
            value, m0 = value[lane], self.m0[lane]
            lead = ((value >= low1[lane]) * self.m1[lane] + (value >= low2[lane]) * self.m2[lane]) * self.total0
            # in order, neighbours are searched next to each other
            order = np.sort(((value - lead) // m0) * len(s) + lane)
            found = np.empty(len(s), np.int64)
            found[order % len(s)] = np.searchsorted(self.below, order // len(s), side="right") - 1
            s[lane] = own = found[lane]
            low[lane], size[lane] = m0 * self.below.take(own) + lead, m0 * self.freq.take(own)
        return s, low, size

    def update(self, s: np.ndarray) -> None:
        k = len(s)
        hit1, hit2 = self.s1 == s, self.s2 == s
        seen = np.bincount(self.cell + (hit1 * 512 + hit2 * 1024), minlength=2048).reshape(2, 2, 512)
        self.seen += seen.sum(axis=(0, 1))
        self.right2 += seen[1].sum(axis=0)
        self.right1 += seen[:, 1].sum(axis=0)
        own = s << 4
        for at, hit, held, sure, after in ((self.at1, hit1, self.held1, self.sure1, self.after1), (self.at2, hit2, self.held2, self.sure2, self.after2)):
            after[at] = np.where(hit | (sure > 1), held - sure, own) + _SURER.take(hit * 16 + sure)
        self.fresh.append(s)
        self.steps += 1
        if self.steps < 16 or self.steps % 4 == 0:
            self.recount()
        self.before2[:k] = self.before1[:k]
        self.before1[:k] = s


def lanes_for(n: int) -> int:
    return max(1, min(LANES, n // 64))


def code_ids(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each lane (count) and all words, lane after lane."""
    n = len(ids)
    lanes = lanes_for(n)
    steps = -(-n // lanes)
    padded = np.zeros(steps * lanes, np.uint32)
    padded[:n] = ids
    grid = np.ascontiguousarray(padded.reshape(lanes, steps).T)  # a lane holds consecutive ids
    model = Model(vocabulary, lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _ALL)
    out = np.zeros((3 * steps + 8) * lanes, np.uint16)  # word after word, of every lane
    at = np.arange(lanes)
    for t in range(steps):
        k = min(lanes, -(-(n - t) // steps))
        s = grid[t, :k].astype(np.int64)
        model.predict(k)
        start, size = model.interval(s)
        unit = span[:k] // np.uint64(_MIX * model.total0)
        low[:k] += unit * start.view(np.uint64)
        span[:k] = unit * size.view(np.uint64)
        for lane, a in _settled(low, span, k):
            place = at[lane]
            out[place] = a >> _TOP_SHIFT
            at[lane] = place + lanes
        model.update(s)
    for _ in range(4):
        out[at] = low >> _TOP_SHIFT
        at += lanes
        low <<= _WORD
    counts = at // lanes
    used = int(counts.max())
    return counts.astype("<u4"), out[:used * lanes].reshape(used, lanes).T[np.arange(used) < counts[:, None]].astype("<u2")


def _settled(low: np.ndarray, span: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the first ``k`` lanes those whose top word can move out now, and their low ends before it does, again and
    again until there are none; too short a span is cut to a word's edge."""
    lane, a, r = None, low[:k], span[:k]
    while True:
        short = r < _BOT
        moved = np.flatnonzero(((a ^ (a + r)) < _TOP) | short)
        if not len(moved):
            return
        lane, a, r, short = moved if lane is None else lane[moved], a[moved], r[moved], short[moved]
        if short.any():
            short &= (a ^ (a + r)) >= _TOP
            r[short] = (~a[short] + np.uint64(1)) & (_BOT - np.uint64(1))
        yield lane, a
        a, r = a << _WORD, r << _WORD
        low[lane], span[lane] = a, r


def decode_ids(n: int, vocabulary: int, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The ``n`` ids that ``code_ids`` coded."""
    lanes = lanes_for(n)
    steps = -(-n // lanes)
    words = np.concatenate([words, np.zeros(8, "<u2")])
    at = np.concatenate(([0], np.cumsum(counts.astype(np.int64))[:-1]))
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << _WORD) | words[at]
        at += 1
    model = Model(vocabulary, lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _ALL)
    out = np.zeros((steps, lanes), np.uint32)
    for t in range(steps):
        k = min(lanes, -(-(n - t) // steps))
        model.predict(k)
        whole = np.uint64(_MIX * model.total0)
        unit = span[:k] // whole
        value = np.minimum((code[:k] - low[:k]) // unit, whole - np.uint64(1)).view(np.int64)
        s, start, size = model.symbol(value)
        low[:k] += unit * start.view(np.uint64)
        span[:k] = unit * size.view(np.uint64)
        for lane, _ in _settled(low, span, k):
            place = at[lane]
            code[lane] = (code[lane] << _WORD) | words[place]
            at[lane] = place + 1
        model.update(s)
        out[t, :k] = s
    return out.T.reshape(-1)[:n]


def pack_block(keys: list[int | None], docs: list[np.ndarray], vocabulary: int) -> bytes:
    """A block of documents' ids (each an array of unsigned 32-bit integers)."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError(f"id {int(ids.max())} is outside the vocabulary of {vocabulary}")
    counts, words = code_ids(ids, vocabulary) if len(ids) else (np.zeros(0, "<u4"), np.zeros(0, "<u2"))
    body = b"".join([np.array([len(d) for d in docs], "<u4").tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(),
                     np.array([k is not None for k in keys], np.uint8).tobytes(), counts.tobytes(), words.tobytes()])
    return HEADER.pack(MAGIC, VERSION, vocabulary, len(docs), len(ids), len(counts), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def unpack_block(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Keys and ids of the documents of a block; raises ValueError on any damage."""
    if len(data) < HEADER.size:
        raise ValueError("block is cut short")
    magic, version, vocabulary, n_docs, n, lanes, crc, body_crc = HEADER.unpack_from(data)
    body = data[HEADER.size:]
    if magic != MAGIC or version != VERSION or zlib.crc32(body) != body_crc:
        raise ValueError("block is damaged")
    cut = np.cumsum([0, 4 * n_docs, 8 * n_docs, n_docs, 4 * lanes])
    sizes, keys, there, counts = (np.frombuffer(body[cut[i]:cut[i + 1]], kind) for i, kind in enumerate(("<u4", "<i8", np.uint8, "<u4")))
    ids = decode_ids(n, vocabulary, counts, np.frombuffer(body[cut[4]:], "<u2")).astype("<u4") if n else np.zeros(0, "<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("block decodes to other ids")
    return ([int(k) if p else None for k, p in zip(keys, there)], np.split(ids, np.cumsum(sizes.astype(np.int64))[:-1]) if n_docs else [])


BLOCK_SCHEMA = "part int, block int, n_docs long, n_ids long, data binary"


def write_ids(df: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int | None = None, key: str = "doc_id",
              text: str = "text", rule: str = "at_spaces", parts: int | None = None) -> None:
    """Encode each text (null: empty), append ``end_id``, and write blocks in ascending key order to ``folder``.

    Null keys come first; rows with equal keys are ordered by text.  Rows are dealt to ranges of the key; the blocks
    of range p, in block order, follow those of range p - 1.  A document lies in one block, however long.
    """
    ship_package(df.sparkSession)
    arrow = arrow_schema(df.sparkSession, BLOCK_SCHEMA)
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, keys, docs = None, 0, 0, [], []

        def close() -> pa.RecordBatch:
            row = ([part], [number], [len(docs)], [held], [pack_block(keys, docs, vocabulary)])
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                coded = library_tokens.load(tokenizer, rule).encode(piece.column(text).to_pylist())
                for p, k, ids in zip(piece.column("part").to_pylist(), piece.column(key).to_pylist(), coded):
                    if docs and (p != part or held >= BLOCK_IDS):
                        yield close()
                        number, held, keys, docs = (number + 1 if p == part else 0), 0, [], []
                    elif p != part:
                        number = 0
                    part = p
                    keys.append(k)
                    docs.append(np.frombuffer(ids + tail, "<u4"))
                    held += len(docs[-1])
        if docs:
            yield close()

    (ordered_parts(df, key, [text], parts).mapInArrow(run, BLOCK_SCHEMA)
     .write.mode("errorifexists").option("compression", "none").parquet(folder))


def read_ids(spark: SparkSession, folder: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Documents of a file set: ``key``, start (ids of all documents before it), n_tokens, ids_crc32, ids (if wanted).

    Starts come from the blocks' counts (one row a block, summed by range, then over ranges); ids from the blocks.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(folder)
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ranges = sums.select(F.col("part").alias("_p"), F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_range"))
    inner = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("part", "block", inner.alias("_inner")).join(F.broadcast(ranges), F.col("part") == F.col("_p"))
    starts = starts.select(F.col("part").alias("_part"), F.col("block").alias("_block"), (F.col("_range") + F.col("_inner")).alias("first"))
    schema = f"part int, block int, place long, {key} long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part, block, data in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "data"))):
            keys, docs = unpack_block(data)
            sizes = np.array([len(d) for d in docs], np.int64)
            made = {"part": [part] * len(docs), "block": [block] * len(docs), "place": np.cumsum(sizes) - sizes, key: keys,
                    "n_tokens": sizes, "ids_crc32": [zlib.crc32(d.tobytes()) for d in docs]}
            yield made | ({"ids": pa.array([d.tolist() for d in docs], pa.list_(pa.int64()))} if with_ids else {})

    rows = arrow_map(blocks.select("part", "block", "data"), run, schema, batch_rows=1)
    rows = rows.join(starts, (F.col("part") == F.col("_part")) & (F.col("block") == F.col("_block")))
    return rows.select(key, (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
