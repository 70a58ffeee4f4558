"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases: each phrase is the shortest piece at the current place that is not a phrase
yet.  The set of phrases is hashed and the ``SIGNATURE`` smallest hashes are the fingerprint; the overlap of two
fingerprints estimates the Jaccard likeness of the phrase sets, which follows how well one text compresses the other.
The parse is online, so a text that shares its beginning with a parsed one resumes from that parse.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabsense.llm.bpe import hash_pieces
from tabsense.llm.common import arrow_schema, ordered_parts, ship_package

SIGNATURE = 128
_BASE = 0xA0761D6478BD642F


def parse(text: str, start: int, known: set[str], ends: list[int]) -> int:
    """Parse ``text`` from ``start``: adds the phrases to ``known`` and their ends to ``ends``.

    Returns where the unfinished last phrase starts (the rest is a phrase already), or the end.
    """
    i, n = start, len(text)
    j = i + 1
    add, end = known.add, ends.append
    while j <= n:
        phrase = text[i:j]
        if phrase in known:
            j += 1
        else:
            add(phrase)
            end(j)
            i = j
            j += 1
    return i


def phrase_hashes(text: str, start: int, ends: list[int]) -> np.ndarray:
    """32-bit hashes of the phrases that follow one another from ``start`` and end at ``ends``."""
    if not ends:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(text[start:ends[-1]].encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.diff(np.array([start, *ends], np.int64))
    return (hash_pieces(codes, lengths, _BASE) >> np.uint64(32)).astype(np.uint32)


def smallest(hashes: np.ndarray) -> np.ndarray:
    if len(hashes) > 8 * SIGNATURE:
        hashes = np.partition(hashes, 2 * SIGNATURE)[:2 * SIGNATURE]  # equal hashes are rare: 2k hold k distinct ones
        if len(np.unique(hashes)) < SIGNATURE:
            return np.unique(hashes)
    return np.unique(hashes)[:SIGNATURE]


def signature(text: str | None) -> np.ndarray:
    """Fingerprint of a text as sorted hashes; null counts as empty (no hash)."""
    ends: list[int] = []
    parse(text or "", 0, set(), ends)
    return smallest(phrase_hashes(text or "", 0, ends))


def edited_signatures(text: str, kept: int, tail: str) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``text`` and of ``text[:kept] + tail``; the shared beginning is parsed once."""
    known: set[str] = set()
    ends: list[int] = []
    at = parse(text[:kept], 0, known, ends)
    shared = phrase_hashes(text, 0, ends)
    out = []
    for whole, own in ((text[:kept] + tail, set(known)), (text, known)):
        more: list[int] = []
        parse(whole, at, own, more)
        out.append(smallest(np.concatenate([shared, phrase_hashes(whole, at, more)])))
    return out[1], out[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest hashes of both that are in both (0 to 1; two empty ones are alike)."""
    both = np.union1d(a, b)[:SIGNATURE]
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def as_text(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype("<u4").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4")


def fingerprint_chain(df: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is the next document's beginning.

    "Next" is by ascending key (null keys first, ties by text, null texts first), the first one after the last; a
    lone document follows itself.  The edited text has its last floor(n/4) code points replaced by the first as many
    (or all) of the next text.  Null texts count as empty.  Rows are dealt once to ranges of the key and worked off
    in order; each range also gets the next range's first row, so nothing looks back.  Returns ``key``, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = (f"{key} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    ship_package(df.sparkSession)
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None  # the row before, waiting for its next: part, key, text
        waiting = None  # the finished row before that, waiting for the held row's fingerprint
        for batch in batches:
            for part, follows, k, t in zip(*(batch.column(c).to_pylist() for c in ("part", "trailer", key, text))):
                t = t or ""
                if held is not None and held[0] == part:
                    made = _row(held[1], held[2], t)
                    if waiting is not None:
                        out.append((*waiting[0], likeness(waiting[1], made[1])))
                    waiting = made
                    if follows:  # the next range's first row: only its fingerprint is wanted
                        out.append((*waiting[0], likeness(waiting[1], signature(t))))
                        held = waiting = None
                        continue
                elif follows:
                    continue  # more rows with the next range's smallest key
                held = (part, k, t)
                if len(out) >= 512:
                    yield _batch(out, arrow)
                    out = []
        if out:
            yield _batch(out, arrow)

    return ordered_parts(df, key, [text], parts, trailer=True).mapInArrow(run, schema)


def _row(k, t: str, after: str) -> tuple[tuple, np.ndarray]:
    n = len(t)
    moved = n // 4
    tail = after[:moved]
    sig, edited = edited_signatures(t, n - moved, tail)
    digest = hashlib.sha256((t[:n - moved] + tail).encode("utf-8", "surrogatepass")).hexdigest()
    return (k, n, digest, as_text(sig), as_text(edited), likeness(sig, edited)), sig


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
