"""Token ids from the tokenizers library, asked once for each distinct chunk of text instead of once for each text.

The library's time goes into merging, so texts are cut where its own pre-tokeniser cuts anyway and every distinct
chunk of a batch is encoded once; chunks seen lately are remembered (bounded).  Two rules say where to cut:

``before_spaces``  byte-level patterns of the kind ``' ?letters| ... |\\s+(?!\\S)|\\s+'`` without a normaliser
                   (see ``common.cuttable``; other texts go to the library whole);
``at_spaces``      tokenisers that drop white space: cut at (and drop) blanks, tabs and line ends.  Here a whole batch
                   is cut, hashed by eight bytes at a time and looked up in numpy (``WordIds``).  Where the file has
                   exactly the normaliser and pattern of ``FINER``, words are also cut between ASCII letters, digits
                   and signs and looked up in lower case.

Special strings hold no white space, so they stay inside one chunk and the library treats them as in the whole text.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np

from tabsense.llm.common import cuttable, splitmix
from tabsense.llm.wordhash import byte_runs, lowered, piece_places, word_places

REMEMBERED = 600_000
#: Words of a ``WordIds`` table (some 100 bytes each).
WORDS = 1_500_000
#: Bytes above which a word is hashed and compared alone.
LONG_WORD = 64
#: Normaliser and pre-tokeniser under which no token reaches across ``piece_places`` and ASCII letters count in lower case.
FINER = ({"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
         {"type": "Sequence", "pretokenizers": [
             {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
             {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})
#: Code points above which a text is worked off alone.
LONG = 2_000_000


_PIECE = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_PIECE_BASE = np.uint64(0x9FB21C651E98DF25)


class Grown:
    """A numpy array that rows are added to, at a cost in proportion to them."""

    def __init__(self, dtype, most: int = 1024):
        self.held, self.n = np.zeros(most, dtype), 0

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.held):
            self.held = np.concatenate([self.held[:self.n], np.zeros(self.n + 2 * len(rows), self.held.dtype)])
        self.held[self.n:self.n + len(rows)] = rows
        self.n += len(rows)

    @property
    def rows(self) -> np.ndarray:
        return self.held[:self.n]


class Words:
    """Words at [first, end) of ``data``, read eight bytes at a time."""

    def __init__(self, data: bytes, first: np.ndarray, end: np.ndarray):
        self.data, self.first, self.end, self.sizes = data, first, end, end - first
        self.eights = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))  # at every byte
        self.head = self.eights[first] & _PIECE.take(np.minimum(self.sizes, 8))
        self.long = np.flatnonzero(self.sizes > LONG_WORD)

    def __getitem__(self, i: int) -> bytes:
        return self.data[self.first[i]:self.end[i]]

    def tails(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For 8, 16, ... the words of more bytes (but not the long ones), and their eight bytes from there on."""
        at, some = 8, np.flatnonzero((self.sizes > 8) & (self.sizes <= LONG_WORD))
        while len(some):
            yield at, some, self.eights[self.first[some] + at] & _PIECE.take(np.minimum(self.sizes[some] - at, 8))
            at += 8
            some = some[self.sizes[some] > at]

    def hashes(self) -> np.ndarray:
        out = splitmix(self.head * _PIECE_BASE + self.sizes.astype(np.uint64))
        for _, some, piece in self.tails():
            out[some] = splitmix(out[some] * _PIECE_BASE + piece)
        for i in self.long:
            out[i] = int.from_bytes(hashlib.blake2b(self[i], digest_size=8).digest(), "little")
        return out


class WordIds:
    """Ids of words by their 64-bit hash: open addressing over numpy arrays, so a batch is looked up at once.

    All bytes of every word found are compared with the stored word's.
    """

    def __init__(self, encode, most: int = WORDS):
        self.encode, self.most = encode, most
        self.bits = max(4, (2 * most).bit_length())
        self._clear()

    def _clear(self) -> None:
        self.place = np.full(1 << self.bits, -1, np.int32)
        self.hashes, self.heads, self.sizes = Grown(np.uint64), Grown(np.uint64), Grown(np.int32)
        self.starts, self.counts, self.flat = Grown(np.int64), Grown(np.int32), Grown("<u4")
        self.spots, self.bytes = Grown(np.int64), Grown(np.uint8)

    def __len__(self) -> int:
        return self.hashes.n

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of every hash, -1 where there is none."""
        mask = np.uint64((1 << self.bits) - 1)
        at = (hashes & mask).astype(np.int64)
        entry, known = self.place.take(at), self.hashes.rows
        if not len(known):
            return entry
        todo = np.flatnonzero((entry >= 0) & (known.take(entry, mode="wrap") != hashes))
        while len(todo):
            at[todo] = (at[todo] + 1) & int(mask)
            entry[todo] = self.place[at[todo]]
            todo = todo[(entry[todo] >= 0) & (known[entry[todo]] != hashes[todo])]
        return entry

    def _learn(self, hashes: np.ndarray, words: Words, some: np.ndarray) -> None:
        raw = [words[i] for i in some]
        made = self.encode([w.decode("utf-8", "surrogatepass") for w in raw])
        counts = np.array([len(m) for m in made], np.int64)
        first, mask = len(self), (1 << self.bits) - 1
        self.starts.add(self.flat.n + np.cumsum(counts) - counts)
        self.counts.add(counts)
        self.flat.add(np.concatenate(made))
        self.hashes.add(hashes)
        self.heads.add(words.head[some])
        sizes = words.sizes[some]
        self.sizes.add(sizes)
        self.spots.add(self.bytes.n + np.cumsum(sizes) - sizes)
        self.bytes.add(np.frombuffer(b"".join(raw) + bytes(8), np.uint8))  # the last word is read by eights, too
        at, todo = (hashes & np.uint64(mask)).astype(np.int64), np.arange(len(hashes))
        while len(todo):
            free = todo[self.place[at[todo]] < 0]
            self.place[at[free]] = first + free  # of two that meet, the later one stays
            todo = todo[self.place[at[todo]] != first + todo]
            at[todo] = (at[todo] + 1) & mask

    def _same(self, words: Words, entry: np.ndarray) -> bool:
        """Whether every word is its entry's, byte by byte."""
        if (self.sizes.rows.take(entry) != words.sizes).any() or (self.heads.rows.take(entry) != words.head).any():
            return False
        held = np.ndarray(self.bytes.n - 7, "<u8", self.bytes.held, strides=(1,))
        for at, some, piece in words.tails():
            if ((held[self.spots.rows[entry[some]] + at] & _PIECE.take(np.minimum(words.sizes[some] - at, 8))) != piece).any():
                return False
        for i in words.long:
            spot = int(self.spots.rows[entry[i]])
            if self.bytes.held[spot:spot + int(words.sizes[i])].tobytes() != words[i]:
                return False
        return True

    def ids(self, data: bytes, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at [first, end) of ``data``, one after the other, and how many each has."""
        if not len(first):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        words = Words(data, first, end)
        hashes = words.hashes()
        entry = self._find(hashes)
        new = np.flatnonzero(entry < 0)
        if len(new):
            distinct, where = np.unique(hashes[new], return_index=True)
            if len(self) + len(distinct) > self.most and len(self):
                self._clear()
                distinct, new = np.unique(hashes, return_index=True)
                where = np.arange(len(new))
            if len(distinct) > self.most:
                self.bits = (2 * len(distinct)).bit_length()
                self._clear()
            self._learn(distinct, words, new[where])
            entry = self._find(hashes)
        if not self._same(words, entry):
            raise ValueError("two words have one 64-bit hash")
        counts = self.counts.rows.take(entry).astype(np.int64)
        before = np.cumsum(counts) - counts
        return self.flat.rows.take(np.repeat(self.starts.rows.take(entry) - before, counts) + np.arange(int(counts.sum()))), counts


class ChunkedLibrary:
    """Ids of texts by ``rule``; with ``counts`` only their numbers."""

    def __init__(self, path: str, rule: str, counts: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread: Spark already runs a task on every core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.rule, self.counts = rule, counts
        self.seen: dict[str, int | bytes] = {}
        at_spaces = rule == "at_spaces"
        self.parting, self.ends = self._parting() if at_spaces else None, self._ends() if at_spaces else None
        added, made = self.tokenizer.get_added_tokens_decoder().values(), json.loads(self.tokenizer.to_str())
        self.special = [t.content.encode() for t in added]
        self.finer = at_spaces and (made["normalizer"], made["pre_tokenizer"]) == FINER and not any(t.normalized for t in added)
        self.table = WordIds(self._lists)

    def _library(self, chunks: list[str]) -> list[int] | list[bytes]:
        made = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        if self.counts:
            return list(map(len, made))
        return [np.array(e.ids, "<u4").tobytes() for e in made]

    def _parting(self) -> tuple[str, int] | None:
        """A control character that stays one id of its own between blanks, and the id."""
        for sign in "\x01\x02\x03":
            alone, between = (self.tokenizer.encode(t, add_special_tokens=False).ids for t in (sign, f"a {sign} a"))
            letter = self.tokenizer.encode("a", add_special_tokens=False).ids
            if len(alone) == 1 and between == [*letter, *alone, *letter]:
                return sign, alone[0]
        return None

    def _ends(self) -> np.ndarray | None:
        """Of every id whether it ends a pre-token; nothing if the model doesn't mark that."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        vocabulary = self.tokenizer.get_vocab()
        out = np.zeros(max(vocabulary.values()) + 1, bool)
        out[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return out

    def _together(self, chunks: list[str], between: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([between.join(chunks)], add_special_tokens=False)[0].ids, "<u4")

    def _lists(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of each chunk.  A thousand chunks go to the library as one text: those of letters only parted by blanks,
        if that gives as many ends of pre-tokens as there are chunks; others parted by a control character between
        blanks, where the library cuts anyway.  Chunks that hold it or could be part of a special string, and all of a
        tokeniser that has no such character, go alone."""
        special = [c for t in self.tokenizer.get_added_tokens_decoder().values() for c in (t.content[:1], t.content[-1:])]
        out: list = [None] * len(chunks)
        if self.parting is not None:
            sign, own = self.parting
            apart = {sign, *special}
            letters = [i for i, c in enumerate(chunks) if c.isalpha() and apart.isdisjoint(c)] if self.ends is not None else []
            for at in range(0, len(letters), 1000):
                run = letters[at:at + 1000]
                ids = self._together([chunks[i] for i in run], " ")
                cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                if len(cuts) == len(run) and cuts[-1] == len(ids):
                    for i, start, end in zip(run, [0, *cuts], cuts):
                        out[i] = ids[start:end]
            plain = [i for i, c in enumerate(chunks) if out[i] is None and apart.isdisjoint(c)]
            for at in range(0, len(plain), 1000):
                run = plain[at:at + 1000]
                ids = self._together([chunks[i] for i in run], f" {sign} ")
                ends = np.append(np.flatnonzero(ids == own), len(ids)).tolist()
                start = 0
                for i, end in zip(run, ends, strict=True):
                    out[i] = ids[start:end]
                    start = end + 1
        rest = [i for i, o in enumerate(out) if o is None]
        for at in range(0, len(rest), 20_000):
            run = rest[at:at + 20_000]
            for i, e in zip(run, self.tokenizer.encode_batch_fast([chunks[i] for i in run], add_special_tokens=False)):
                out[i] = np.array(e.ids, "<u4")
        return out

    def _by_table(self, texts: list[str | None]) -> list[int] | list[bytes]:
        out: list = []
        for _, data in byte_runs(texts):
            joined = b" ".join(data)
            lower = lowered(joined) if self.finer else joined
            if self.finer and not any(s in joined or s in lower for s in self.special):
                joined = lower
                first, end = piece_places(joined)
            else:
                first, end = word_places(joined)
            ids, counts = self.table.ids(joined, first, end)
            starts = np.cumsum([0] + [len(d) + 1 for d in data])
            cuts = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(first, starts)]
            if self.counts:
                out += np.diff(cuts).tolist()
            else:
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                out += [bytes(raw[4 * a:4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return out

    def _known(self, parts: list[list[str]], lead: str) -> dict:
        seen = self.seen
        if len(seen) > REMEMBERED:
            seen.clear()
        new = [p for p in dict.fromkeys(chain.from_iterable(parts)) if p not in seen]
        for at in range(0, len(new), 20_000):
            run = new[at:at + 20_000]
            seen.update(zip(run, self._library([lead + p for p in run] if lead else run)))
        return seen

    def encode(self, texts: list[str | None]) -> list[int] | list[bytes]:
        """For each text the number of its ids, or its ids as little-endian unsigned 32-bit integers."""
        if self.rule == "at_spaces":
            return self._by_table(texts)
        out: list = [None] * len(texts)
        add = sum if self.counts else b"".join
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            text = text or ""
            if cuttable(text):
                held.append((i, text.split(" ")))
            else:
                out[i] = self._library([text])[0]
                continue
            size += len(text)
            if size > LONG:
                self._give(held, out, add)
                held, size = [], 0
        self._give(held, out, add)
        return out

    def _give(self, held: list[tuple[int, list[str]]], out: list, add) -> None:
        known = self._known([list(islice(parts, 1, None)) for _, parts in held], " ")
        first = self._library([parts[0] for _, parts in held]) if held else []
        for (i, parts), head in zip(held, first):
            out[i] = add(chain((head,), map(known.__getitem__, islice(parts, 1, None))))


_LOADED: dict[tuple[str, str, bool], ChunkedLibrary] = {}


def load(path: str, rule: str, counts: bool = False) -> ChunkedLibrary:
    """The encoder of a tokeniser file, read once in each process."""
    if (path, rule, counts) not in _LOADED:
        _LOADED[path, rule, counts] = ChunkedLibrary(path, rule, counts)
    return _LOADED[path, rule, counts]


def version(path: str) -> str:
    """Digest of the tokeniser file and the library's version: what a stored count depends on besides the text."""
    import tokenizers
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()
