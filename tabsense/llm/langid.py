"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

Every letter gives three subwords (itself, with the letter before, and between both neighbours; anything that is no
letter counts as one boundary sign), hashed to ``BUCKETS`` embeddings.  A text is the mean of its subwords'
embeddings; a linear softmax names the language.  A temperature fitted on sampled rows kept from training calibrates
the probability, and the rejection threshold is the lowest at which accepted ones among those rows are right often
enough.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabsense.llm.common import arrow_map
from tabsense.llm.samples import collect_texts, fold, hashed_rows

BUCKETS = 4096
DIM = 16
UND = "und"
#: Bounds of the sample: rows of each language (all languages are learned), bytes of all its texts together.
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 64_000_000
#: Steps that training takes at least.
MIN_STEPS = 300
#: Share of accepted rows that must be right.
ACCEPTED_RIGHT = 0.995


@dataclass
class LangModel:
    langs: list[str]
    embeddings: np.ndarray  # BUCKETS x DIM
    weights: np.ndarray  # DIM x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, means: np.ndarray) -> np.ndarray:
        return (means @ self.embeddings) @ self.weights + self.bias


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000))
    return _LETTERS[0]


def subwords(texts: list[str], inside: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts (texts x BUCKETS) and the number of letters of each text.  With ``inside`` (for one text, in lower
    case already) only letters at those places count; the others are their neighbours."""
    lowered = [t.lower() for t in texts] if inside is None else texts
    lengths = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    codes = np.frombuffer(("\0" + "\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[codes]
    codes = np.where(is_letter, codes, 0).astype(np.uint32)
    at = np.flatnonzero(is_letter)
    if inside is not None:
        at = at[(at > inside[0]) & (at <= inside[1])]
    row = np.repeat(np.arange(len(texts)), lengths)[at - 1]
    here, left, right = codes[at], codes[at - 1], codes[at + 1]
    one = here * np.uint32(0x9E3779B1)
    two = (one ^ (left + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
    three = (two ^ (right + np.uint32(0x3C6EF372))) * np.uint32(0xC2B2AE35)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    cells = row * BUCKETS
    counts = np.zeros(len(texts) * BUCKETS, np.float32)
    for h in (one, two, three):
        counts += np.bincount(cells + ((h ^ (h >> np.uint32(15))) * np.uint32(0x2545F491) >> shift), minlength=len(counts))
    return counts.reshape(len(texts), BUCKETS), np.bincount(row, minlength=len(texts))


def _means(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return counts / np.maximum(3 * n, 1).astype(np.float32)[:, None]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(sample: list[tuple[str, str]], epochs: int = 6, rate: float = 2.0, seed: int = 5, batch: int = 256) -> LangModel:
    """From (language, text) rows.  Each row gives pieces of 20 to 600 code points, so short texts are seen too; one
    row in five only calibrates."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for lang, _ in sample})
    number = {lang: i for i, lang in enumerate(langs)}
    sides: tuple[list, list] = ([], [])
    for i, (lang, text) in enumerate(sample):
        for _ in range(3):
            n = int(20 * 30 ** rng.random())
            start = int(rng.integers(0, max(1, len(text) - n + 1)))
            sides[i % 5 == 0].append((number[lang], text[start:start + n]))
    model = LangModel(langs, rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, len(langs)), np.float32),
                      np.zeros(len(langs), np.float32))
    if len(langs) < 2:
        return model
    model.weights[:] = rng.normal(0, 0.3, model.weights.shape)
    rounds = -(-len(sides[0]) // batch)
    epochs = max(epochs, -(-MIN_STEPS // rounds))  # a small sample is passed over more often
    steps = epochs * rounds
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(sides[0]))
        for at in range(0, len(order), batch):
            rows = [sides[0][j] for j in order[at:at + batch]]
            x = _means(*subwords([t for _, t in rows]))
            hidden = x @ model.embeddings
            wrong = softmax(hidden @ model.weights + model.bias)
            wrong[np.arange(len(rows)), [k for k, _ in rows]] -= 1
            wrong /= len(rows)
            step = rate * max(0.05, 1 - done / steps)
            back = x.T @ (wrong @ model.weights.T)
            model.weights -= step * (hidden.T @ wrong)
            model.bias -= step * wrong.sum(axis=0)
            model.embeddings -= step * 50 * back  # a bucket appears in few of a text's subwords: its mean gradient is small
            done += 1
    if sides[1]:
        truth = np.array([k for k, _ in sides[1]])
        logits = np.concatenate([model.logits(_means(*subwords([t for _, t in sides[1][i:i + batch]]))) for i in range(0, len(sides[1]), batch)])
        loss = {t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
        model.temperature = float(min(loss, key=loss.get))
        p = softmax(logits / model.temperature)
        best, right = p.max(axis=1), p.argmax(axis=1) == truth
        order = np.argsort(-best)
        share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(share >= ACCEPTED_RIGHT)
        model.threshold = float(best[order][enough[-1]]) if len(enough) else 1.0
    return model


def predict_texts(model: LangModel, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, calibrated probability and rejection; ``und`` (score 0, rejected) for null and for texts without a letter."""
    langs = [UND] * len(texts)
    scores = np.zeros(len(texts))
    if not model.langs:
        return langs, scores, np.ones(len(texts), bool)
    start = 0
    while start < len(texts):  # as many as hold about a million code points, one at least
        end, size = start, 0
        while end < len(texts) and end - start < 256 and (end == start or size + len(texts[end] or "") <= 1_000_000):
            size += len(texts[end] or "")
            end += 1
        counts, n = _count_whole([t or "" for t in texts[start:end]])
        p = softmax(model.logits(_means(counts, n)) / model.temperature)
        for i in np.flatnonzero(n):
            langs[start + i] = model.langs[int(p[i].argmax())]
            scores[start + i] = p[i].max()
        start = end
    return langs, scores, (scores < model.threshold) | (scores == 0)


def _count_whole(texts: list[str], run: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """``subwords``, with a very long text counted in runs that see one letter over each cut, so the counts are the same."""
    if len(texts) > 1 or len(texts[0]) <= run:
        return subwords(texts)
    text, made = texts[0].lower(), []
    for i in range(0, len(text), run):
        before = min(i, 1)
        made.append(subwords([text[i - before:i + run + 1]], (before, before + min(run, len(text) - i))))
    return sum(c for c, _ in made), sum(n for _, n in made)


def fit(docs: DataFrame, folds: int = 4, held: int = 2, key: str = "doc_id", text: str = "text", lang: str = "lang",
        sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> LangModel:
    """Learn from rows whose key's fold is not ``held`` and whose language is known: at most ``sample_rows`` of each
    language, and ``sample_bytes`` of text in all.  Rows with a null key or text are not learned from."""
    known = docs.select(key, text, lang).where(fold(key, folds) != held)
    sample = collect_texts(hashed_rows(known, lang, key, sample_rows), lang, text, sample_rows, sample_bytes)
    order = sorted(sample, key=lambda r: r[1:])  # by hash: languages mixed
    return train([(k, t) for k, _, t in order])


def predict(df: DataFrame, model: LangModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all) of ``df`` with ``lang_pred``, ``score`` and ``rejected`` (replacing such columns)."""
    made = ["lang_pred", "score", "rejected"]
    kept = [f for f in df.schema.fields if f.name not in made and (keep is None or f.name in keep)]
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept]
                       + ["lang_pred string", "score double", "rejected boolean"])
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM floats: 256 KB

    def run(batch: pa.RecordBatch) -> dict:
        langs, scores, rejected = predict_texts(shared.value, batch.column(text).to_pylist())
        return {f.name: batch.column(f.name) for f in kept} | {
            "lang_pred": langs, "score": pa.array(scores, pa.float64()), "rejected": pa.array(rejected, pa.bool_())}

    return arrow_map(df, run, schema)
