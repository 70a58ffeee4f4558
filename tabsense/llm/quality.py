"""Quality by compression: zstandard dictionaries from good and from bad text.

A text is compressed in blocks of ``BLOCK`` bytes that each start from a dictionary alone (so a long text does not drown
it): with a dictionary trained on good text and with one trained on bad text.  The normalised difference of the two
sizes, averaged over ``PAIRS`` such pairs that were trained on different parts of the sample, says which kind it is
like, and nothing else does: a rising curve (isotonic regression, both labels weighing the same) over labelled rows that
no dictionary saw turns the difference into a probability.  Blocks and dictionaries are small, so that a block is coded
mostly by matches with the dictionary and not with itself.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import arrow_map
from tabsense.llm.samples import collect_texts, fold, hashed_rows

BLOCK = 256
PAIRS = 4
LEVEL = 3
DICTIONARY_BYTES = 32_768
#: Bounds of the labelled sample: rows of each label, and bytes of all its texts together.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 64_000_000


@dataclass
class QualityModel:
    good: list[bytes]  # dictionaries
    bad: list[bytes]
    at: np.ndarray  # differences, rising
    value: np.ndarray  # and the probability of label 1 there
    constant: float | None = None  # score of every text when one label had no rows

    def key(self) -> str:
        return hashlib.sha256(b"".join(self.good + self.bad) + self.at.tobytes() + self.value.tobytes()).hexdigest()


def blocks(data: bytes) -> list[bytes]:
    return [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; text too little to train on serves as it is."""
    parts = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    packed = zstandard.ZstdCompressionDict(content)
    packed.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=packed, write_content_size=False, write_checksum=False, write_dict_id=False)


Pairs = list[tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]]


def difference(data: bytes, pairs: Pairs) -> float:
    """Mean normalised size difference: positive when good text's dictionaries code the text in fewer bytes."""
    parts, total = blocks(data), 0.0
    for good, bad in pairs:
        a, b = sum(len(good.compress(p)) for p in parts), sum(len(bad.compress(p)) for p in parts)
        total += (b - a) / (a + b)
    return total / max(1, len(pairs))


def rising(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators, both labels weighing the same: the pools' mean ``x`` and ``y``,
    each pool with one more half row, so that no pool is certain."""
    order = np.argsort(x, kind="stable")
    weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, len(y) - y.sum())))
    pools: list[list[float]] = []  # sums of weighted x, of weighted y, of weights
    for a, b, w in zip(x[order], y[order], weight[order]):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    sums = np.array(pools)
    return sums[:, 0] / sums[:, 2], np.maximum.accumulate((sums[:, 1] + 0.5) / (sums[:, 2] + 1))


def train(sample: list[tuple[int, bytes]]) -> QualityModel:
    """From (label, text) rows: even rows make the dictionaries (each pair leaves out another part of them), odd rows the
    calibration."""
    by = {k: [t for label, t in sample if label == k] for k in (0, 1)}
    if len(by[0]) < 2 or len(by[1]) < 2:
        share = len(by[1]) / len(sample) if sample else 0.5
        return QualityModel([], [], np.zeros(1), np.zeros(1), share)
    good, bad = ([dictionary([t for i, t in enumerate(by[k][::2]) if i % PAIRS != j or len(by[k]) < 4 * PAIRS]) for j in range(PAIRS)] for k in (1, 0))
    pairs = [(compressor(a), compressor(b)) for a, b in zip(good, bad)]
    x = np.array([difference(t, pairs) for k in (0, 1) for t in by[k][1::2]])
    y = np.repeat([0.0, 1.0], [len(by[0][1::2]), len(by[1][1::2])])
    return QualityModel(good, bad, *rising(x, y))


_LOADED: dict[str, Pairs] = {}


def score_texts(model: QualityModel, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 for each text; null counts as empty."""
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    key = model.key()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = [(compressor(a), compressor(b)) for a, b in zip(model.good, model.bad)]
    x = np.array([difference((t or "").encode("utf-8", "surrogatepass"), _LOADED[key]) for t in texts])
    # the last millionth keeps the order of texts on a level stretch of the curve
    return (1 - 1e-6) * np.interp(x, model.at, model.value) + 1e-6 / (1 + np.exp(-x))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, key: str = "doc_id", text: str = "text",
        label: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Learn from labelled rows whose key's fold is not ``held``: at most ``sample_rows`` rows of each label, and
    ``sample_bytes`` of text in all.

    Rows with a null key, label or text are not learned from; repeated label rows count once each.
    """
    known = labels.select(key, label).where((fold(key, folds) != held) & F.col(label).isin(0, 1))
    chosen = hashed_rows(known, label, key, sample_rows)  # some thousands of keys
    sample = collect_texts(docs.select(key, text).join(F.broadcast(chosen), key), label, text, sample_rows, sample_bytes)
    return train([(k, t.encode("utf-8", "surrogatepass")) for k, _, t in sample])


def score(df: DataFrame, model: QualityModel, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all) of ``df`` and the score of each text as ``out`` (replacing one of that name).

    Null and empty texts get the score of an empty text; long texts are scored whole; an empty table stays empty.
    """
    kept = [f for f in df.schema.fields if f.name != out and (keep is None or f.name in keep)]
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept] + [f"`{out}` double"])
    shared = df.sparkSession.sparkContext.broadcast(model)  # eight dictionaries of at most 32 KB

    def run(batch: pa.RecordBatch) -> dict:
        return {f.name: batch.column(f.name) for f in kept} | {out: pa.array(score_texts(shared.value, batch.column(text).to_pylist()), pa.float64())}

    return arrow_map(df, run, schema)
