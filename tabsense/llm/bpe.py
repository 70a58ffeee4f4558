"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the others by a heap over linked bytes.

A text is split by a pattern into pre-tokens.  Tier one looks all distinct pre-tokens of a batch up at once in a
minimal perfect hash of the vocabulary (two polynomial hashes, one displacement a bucket; the stored token is
compared, so a stranger never passes).  Tier two merges the bytes of a miss: linked neighbours and a heap of
(rank, position), lowest rank and leftmost first, as the rank files define.  Null texts count as empty.  A text is
never cut: long ones are worked off in runs of pre-tokens, so memory stays bounded.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tabsense.llm.common import arrow_map, cuttable, powers, splitmix

_P1, _P2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Chunks (a word with the space before it), and merged pre-tokens, that a worker remembers before it forgets them all.
REMEMBERED = 600_000
#: The same for a worker that has other steps' work to do as well (a remembered one takes some 340 bytes).
REMEMBERED_BESIDE = 100_000
#: Chunks or pre-tokens in hand at once.
RUN = 400_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order from a rank file (lines of base64 token and rank, ranks 0, 1, ...)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def hash_pieces(blob: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit polynomial hash of each piece of ``blob`` (pieces are not empty and follow one another)."""
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    at = np.arange(len(blob)) - np.repeat(starts, lengths)
    terms = (blob.astype(np.uint64) + np.uint64(1)) * powers(base, int(lengths.max()))[at]
    return splitmix(np.add.reduceat(terms, starts) + lengths.astype(np.uint64))


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys, n slots; ``find`` gives the slot's key number for any strings."""

    def __init__(self, keys: list[bytes]):
        self.keys, self.n = keys, len(keys)
        self.longest = max(map(len, keys))
        self.buckets = max(1, self.n // 2)
        a, b = self._hashes(keys)
        bucket, first, step = (a % np.uint64(self.buckets)).astype(np.int64), b % np.uint64(self.n), (b >> np.uint64(32)) | np.uint64(1)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        self.displace = np.zeros(self.buckets, np.int64)
        self.slot_key = np.full(self.n, -1, np.int64)
        for k in np.argsort(-sizes, kind="stable"):
            own = order[ends[k] - sizes[k]:ends[k]]
            if len(own) < 2:
                break
            d = 0
            while True:  # a block of displacements at once
                tries = np.arange(d, d + 256, dtype=np.uint64)
                slots = ((first[own] + tries[:, None] * step[own]) % np.uint64(self.n)).astype(np.int64)
                s = np.sort(slots, axis=1)
                fits = np.flatnonzero((self.slot_key[slots] < 0).all(axis=1) & (s[:, 1:] != s[:, :-1]).all(axis=1))
                if len(fits):
                    self.displace[k] = d + fits[0]
                    self.slot_key[slots[fits[0]]] = own
                    break
                d += 256
        free = iter(np.flatnonzero(self.slot_key < 0))
        for k in np.flatnonzero(sizes == 1):  # a lone key names its slot: -1 - slot
            slot = next(free)
            self.displace[k] = -1 - slot
            self.slot_key[slot] = order[ends[k] - 1]

    @staticmethod
    def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        blob = np.frombuffer(b"".join(keys), np.uint8)
        lengths = np.fromiter(map(len, keys), np.int64, len(keys))
        return hash_pieces(blob, lengths, _P1), hash_pieces(blob, lengths, _P2)

    def find(self, strings: list[bytes]) -> np.ndarray:
        """Key number of each (non-empty) string, -1 for one that is no key."""
        out = np.full(len(strings), -1, np.int64)
        short = [i for i, s in enumerate(strings) if len(s) <= self.longest]
        if not short:
            return out
        asked = [strings[i] for i in short] if len(short) < len(strings) else strings
        a, b = self._hashes(asked)
        d = self.displace[(a % np.uint64(self.buckets)).astype(np.int64)]
        moved = (b % np.uint64(self.n) + np.maximum(d, 0).astype(np.uint64) * ((b >> np.uint64(32)) | np.uint64(1))) % np.uint64(self.n)
        found = self.slot_key[np.where(d < 0, -1 - d, moved.astype(np.int64))]
        keys = self.keys
        same = np.fromiter((keys[k] == s for k, s in zip(found.tolist(), asked)), np.bool_, len(asked))
        out[short] = np.where(same, found, -1)
        return out


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of the token that two neighbouring tokens make, by (left rank << 20 | right rank)."""
    pairs = {}
    get = ranks.get
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left = get(token[:cut])
            if left is not None:
                right = get(token[cut:])
                if right is not None:
                    pairs[left << 20 | right] = rank
    return pairs


def merge_linked(token: list[int], pairs: dict[int, int]) -> tuple[int, ...]:
    """Ids of one pre-token, given as the ranks of its bytes: merge the neighbours whose token has the lowest rank,
    leftmost first, until no pair of neighbours is in the vocabulary."""
    n = len(token)
    get = pairs.get
    rank = [get(a << 20 | b) for a, b in zip(token, token[1:])]
    heap = [r << 40 | i for i, r in enumerate(rank) if r is not None]
    if not heap:
        return tuple(token)
    rank.append(None)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        top = pop(heap)
        i, r = top & 0xFFFFFFFFFF, top >> 40
        if rank[i] != r:
            continue  # this pair has changed since
        j = after[i]
        k = after[i] = after[j]
        rank[j] = None
        token[i] = r
        token[j] = -1
        if k < n:
            before[k] = i
            q = rank[i] = get(r << 20 | token[k])
            if q is not None:
                push(heap, q << 40 | i)
        else:
            rank[i] = None
        p = before[i]
        if p >= 0:
            q = rank[p] = get(token[p] << 20 | r)
            if q is not None:
                push(heap, q << 40 | p)
    return tuple([t for t in token if t >= 0])


class ByteBpe:
    """Encoder and decoder of one vocabulary (tokens in rank order, all 256 bytes among them)."""

    def __init__(self, tokens: list[bytes], pattern: str, remembered: int | None = None):
        self.tokens, self.remembered = tokens, remembered
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.pairs = pair_table(self.ranks)
        self.byte_rank = [self.ranks[bytes([b])] for b in range(256)]
        self.whole = PerfectHash(tokens)
        self.split = regex.compile(pattern)
        self.seen: dict[str, tuple[int, ...]] = {}
        self.merged: dict[str, tuple[int, ...]] = {}

    def lookup(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct pre-tokens: the perfect hash for those in the vocabulary, merges for the others."""
        pairs, of, merged = self.pairs, self.byte_rank, self.merged
        if len(merged) > (self.remembered or REMEMBERED):
            merged.clear()
        found = {p: merged[p] for p in pieces if p in merged}
        asked = [p for p in pieces if p not in found]
        raw = [p.encode("utf-8", "surrogatepass") for p in asked]
        for p, b, k in zip(asked, raw, self.whole.find(raw).tolist()):
            if k >= 0:
                found[p] = (k,)
            else:
                found[p] = merged[p] = merge_linked([of[x] for x in b], pairs)
        return found

    def encode_runs(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, in runs of bounded size."""
        pieces = (m.group() for m in self.split.finditer(text))
        while run := list(islice(pieces, RUN)):
            ids = self.lookup(list(dict.fromkeys(run)))
            yield list(chain.from_iterable(map(ids.__getitem__, run)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_runs(text)))

    def encode_batch(self, texts: list[str | None]) -> Iterator[Iterator[list[int]]]:
        """For each text its ids in runs.  Texts of ordinary length are cut before spaces (``cuttable``) and share one
        lookup of their distinct chunks; chunks seen lately are remembered."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            if text and (len(text) > 4 * RUN or not cuttable(text)):
                yield from self._give(held)
                held, size = [], 0
                yield self.encode_runs(text)
                continue
            held.append(text.split(" ") if text else [""])
            size += len(held[-1])
            if size > RUN:
                yield from self._give(held)
                held, size = [], 0
        yield from self._give(held)

    def _give(self, held: list[list[str]]) -> Iterator[Iterator[list[int]]]:
        """``held``: texts split at spaces; a part but the first of its text stands for the part with its space."""
        seen, split = self.seen, self.split
        if len(seen) > (self.remembered or REMEMBERED):
            seen.clear()
        new = [(p, split.findall(" " + p)) for p in dict.fromkeys(chain.from_iterable(islice(x, 1, None) for x in held)) if p not in seen]
        first = [split.findall(x[0]) for x in held]
        ids = self.lookup(list(dict.fromkeys(chain(chain.from_iterable(x for _, x in new), chain.from_iterable(first)))))
        for p, pieces in new:
            seen[p] = ids[pieces[0]] if len(pieces) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, pieces)))
        for parts, pieces in zip(held, first):
            out = list(chain.from_iterable(map(ids.__getitem__, pieces)))
            out.extend(chain.from_iterable(map(seen.__getitem__, islice(parts, 1, None))))
            yield iter((out,))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[tuple[str, str, int | None], ByteBpe] = {}


def load(path: str, pattern: str, remembered: int | None = None) -> ByteBpe:
    """The codec of a rank file, built once in each process; ``remembered`` instead of ``REMEMBERED``."""
    if (path, pattern, remembered) not in _LOADED:
        _LOADED[path, pattern, remembered] = ByteBpe(read_ranks(path), pattern, remembered)
    return _LOADED[path, pattern, remembered]


def encode_column(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of its texts as one more column (replacing one of that name); null texts give no ids.

    Columns of any supported type pass through; repeated rows stay repeated; an empty table gives an empty table.
    """
    kept = [f for f in df.schema.fields if f.name != ids]
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept] + [f"`{ids}` array<int>"])

    def run(batch: pa.RecordBatch) -> dict:
        made = [list(chain.from_iterable(runs)) for runs in load(path, pattern).encode_batch(batch.column(text).to_pylist())]
        return {f.name: batch.column(f.name) for f in kept} | {ids: pa.array(made, pa.list_(pa.int32()))}

    return arrow_map(df, run, schema)


def decode_column(df: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """``df`` with the bytes of its ids as one more column (replacing one of that name); null ids give no bytes."""
    kept = [f for f in df.schema.fields if f.name != data]
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept] + [f"`{data}` binary"])

    def run(batch: pa.RecordBatch) -> dict:
        made = [load(path, pattern).decode(x or ()) for x in batch.column(ids).to_pylist()]
        return {f.name: batch.column(f.name) for f in kept} | {data: pa.array(made, pa.binary())}

    return arrow_map(df, run, schema)


def round_trip_digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text, decode its ids again: ``key``, n_tokens, ids_sha256, decoded_sha256 and n_bytes of the decoded bytes.

    The ids stay in the task (only digests leave it), so nothing is shuffled.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"

    def run(batch: pa.RecordBatch) -> dict:
        codec = load(path, pattern)
        decimal = _decimals(len(codec.tokens))
        counts, ids_hex, data_hex, sizes = [], [], [], []
        for runs in codec.encode_batch(batch.column(text).to_pylist()):
            n = size = 0
            over_ids, over_data = hashlib.sha256(), hashlib.sha256()
            for ids in runs:
                if n and ids:
                    over_ids.update(b",")
                over_ids.update(",".join(map(decimal.__getitem__, ids)).encode())
                data = codec.decode(ids)
                over_data.update(data)
                n += len(ids)
                size += len(data)
            counts.append(n)
            sizes.append(size)
            ids_hex.append(over_ids.hexdigest())
            data_hex.append(over_data.hexdigest())
        return {key: batch.column(key), "n_tokens": counts, "ids_sha256": ids_hex, "decoded_sha256": data_hex, "n_bytes": sizes}

    return arrow_map(df.select(key, text), run, schema)


def encoded_documents(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The other columns of ``df`` with ids, n_tokens and decoded_sha256 (of the bytes that the ids decode to) of each
    text; null texts have no ids.  Columns of those names are replaced."""
    made = ["ids", "n_tokens", "decoded_sha256"]
    kept = [f for f in df.schema.fields if f.name not in (*made, text)]
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept]
                       + ["ids array<int>", "n_tokens long", "decoded_sha256 string"])

    def run(batch: pa.RecordBatch) -> dict:
        codec = load(path, pattern, REMEMBERED_BESIDE)
        arrays, digests = [], []
        for runs in codec.encode_batch(batch.column(text).to_pylist()):
            over, own = hashlib.sha256(), []
            for ids in runs:
                over.update(codec.decode(ids))
                own.append(np.array(ids, np.int32))
            arrays.append(np.concatenate(own) if own else np.zeros(0, np.int32))
            digests.append(over.hexdigest())
        sizes = np.array([len(a) for a in arrays], np.int64)
        flat = pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), flat)
        return {f.name: batch.column(f.name) for f in kept} | {"ids": lists, "n_tokens": sizes, "decoded_sha256": digests}

    return arrow_map(df, run, schema)


_DECIMALS: list[str] = []


def _decimals(n: int) -> list[str]:
    if len(_DECIMALS) < n:
        _DECIMALS[:] = map(str, range(n))
    return _DECIMALS
