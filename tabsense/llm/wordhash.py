"""Word hashes of whole batches of texts in numpy, and hashes of runs of words by prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tabsense.llm.common import powers, splitmix

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_BASE = 0x9FB21C651E98DF25
#: Bytes hashed at once.
RUN_BYTES = 4_000_000


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 text (runs of anything but space, tab and line-end characters), with their
    first bytes' places and their ends."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), first, end
    lengths = end - first
    at = np.arange(len(raw))
    at[first[0]:] -= np.repeat(first, np.diff(np.append(first, len(raw))))
    longest = int(lengths.max())
    terms = (raw.astype(np.uint64) + np.uint64(1)) * powers(_BYTE_BASE, longest)[np.minimum(at, longest - 1)]
    terms[~inside[1:-1]] = 0
    return splitmix(np.add.reduceat(terms, first) + lengths.astype(np.uint64)), first, end


def byte_runs(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Runs of texts of bounded size (one text at least): their numbers and their bytes."""
    at = 0
    while at < len(texts):
        numbers, data, size = [], [], 0
        while at < len(texts) and (not numbers or size < RUN_BYTES):
            numbers.append(at)
            data.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            size += len(data[-1]) + 1
            at += 1
        yield numbers, data


def batch_hashes(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts of bounded size (one text at least): their numbers, their bytes, the word hashes of all,
    the offset of each text's first word (and the end), and the words' places in the joined bytes."""
    for numbers, data in byte_runs(texts):
        joined = b" ".join(data)
        hashes, first, end = word_hashes(joined)
        starts = np.cumsum([0] + [len(d) + 1 for d in data])
        yield numbers, data, hashes, np.searchsorted(first, starts), first, end


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First bytes' places and ends of the words of UTF-8 text."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = (raw != 0x20) & (raw - np.uint8(0x09) > 4)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


_OTHER, _BLANK, _LETTER, _DIGIT, _SIGN, _QUOTE = range(6)
_KIND = bytearray(256)
for _c in range(0x21, 0x7F):
    _KIND[_c] = _LETTER if chr(_c).isalpha() else _DIGIT if chr(_c).isdigit() else _QUOTE if _c == 0x27 else _SIGN
for _c in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
    _KIND[_c] = _BLANK
#: Whether to cut between a byte of one kind and the next byte's kind: around blanks, digits and where letters end or,
#: but not after a quote, begin.
_CUT = np.zeros((8, 8), bool)
_CUT[_LETTER, [_DIGIT, _SIGN, _QUOTE]] = _CUT[_SIGN, [_LETTER, _DIGIT]] = _CUT[_QUOTE, _DIGIT] = _CUT[_DIGIT, _LETTER:] = True
_CUT[:, _BLANK] = _CUT[_BLANK] = True
_CUTS = bytes(_CUT.reshape(-1).astype(np.uint8)) + bytes(192)


def piece_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First bytes' places and ends of the pieces of the words of UTF-8 text: runs of ASCII letters, single ASCII digits,
    and runs of other ASCII signs with, after an apostrophe, the letters that follow it.  Nothing is cut beside other
    characters."""
    kinds = np.frombuffer(b"\x01" + data.translate(bytes(_KIND)) + b"\x01", np.uint8)
    pairs = (kinds[:-1] << 3) | kinds[1:]
    edge = np.flatnonzero(np.frombuffer(pairs.tobytes().translate(_CUTS), bool))
    inside = kinds[1:].take(edge[:-1]) != _BLANK
    return edge[:-1][inside], edge[1:][inside]


def lowered(data: bytes) -> bytes:
    """UTF-8 text with A-Z in lower case where no other than an ASCII character follows (none that could join them)."""
    raw = np.frombuffer(data, np.uint8)
    upper = raw - np.uint8(0x41) < 26
    upper[:-1] &= raw[1:] < 0x80
    return (raw + upper * np.uint8(0x20)).tobytes()


class RunHasher:
    """Hash of any run of words [s, e) of a sequence, independent of where it stands."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(base, n), out=self.sums[1:])
        self.back = powers(pow(base, -1, 1 << 64), n + 1)

    def __call__(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return splitmix((self.sums[e] - self.sums[s]) * self.back[s] + (e - s).astype(np.uint64))
