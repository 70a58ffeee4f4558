import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabsense.llm import bpe, id_files, library_tokens, token_counts, wordhash

BPE, PATH3, PATH10 = (P.path(f) for f in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))
SPACED = st.text(st.sampled_from("ab'sé́ \n\t \x1c　!12Σ|<>"), max_size=40)


@pytest.fixture(scope="module")
def tiktoken_codec():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load(BPE, P.PATTERN).ranks, special_tokens={})


def ids_of(texts):
    return [[i for run in runs for i in run] for runs in bpe.load(BPE, P.PATTERN).encode_batch(texts)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(SPACED, st.text(max_size=60)))
def test_bpe_equals_tiktoken(text):
    import tiktoken
    codec = bpe.load(BPE, P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    text = text.encode("utf-8", "ignore").decode()
    assert ids_of([text])[0] == own.encode_ordinary(text)
    assert codec.decode(ids_of([text])[0]).decode() == text


def test_bpe_long_pieces_and_batches(tiktoken_codec, monkeypatch):
    texts = ["a" * 5000, None, "", "x" * 300 + " " * 700 + "b", "word " * 3000, "\n \n x   y"]
    assert ids_of(texts) == [tiktoken_codec.encode_ordinary(t or "") for t in texts]
    monkeypatch.setattr(bpe, "RUN", 50)  # long texts in runs
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    assert ids_of(texts) == [tiktoken_codec.encode_ordinary(t or "") for t in texts]


def test_documents_are_encoded_with_few_words_remembered(docs_of, monkeypatch):
    made = {}
    monkeypatch.setattr(bpe, "arrow_map", lambda df, fn, schema: made.update(fn=fn))
    monkeypatch.setattr(bpe, "REMEMBERED_BESIDE", 300)
    bpe.encoded_documents(docs_of([]).select("doc_id", "text"), BPE, P.PATTERN)
    texts = [" ".join(f"zq{i}x{j}" for j in range(100)) for i in range(40)] + [None, "the end"]
    got = [made["fn"](pa.RecordBatch.from_pydict({"doc_id": [i], "text": pa.array([t], pa.string())}))["ids"].to_pylist()[0] for i, t in enumerate(texts)]
    assert got == ids_of(texts)
    codec = bpe.load(BPE, P.PATTERN, 300)
    assert max(len(codec.seen), len(codec.merged)) <= 300 + 200  # and those of the last text


def test_perfect_hash_is_minimal_and_knows_strangers():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot_key.tolist()) == list(range(3000))
    assert h.find(keys).tolist() == list(range(3000))
    assert (h.find([f"z{i}".encode() for i in range(3000)]) == -1).all()


def test_bpe_columns(docs_of, odd_rows, tiktoken_codec):
    df = docs_of(odd_rows).withColumnRenamed("lang", "ids")  # a clashing name
    got = bpe.decode_column(bpe.encode_column(df, BPE, P.PATTERN), BPE, P.PATTERN).collect()
    assert len(got) == len(odd_rows) and got[0].asDict().keys() == {"doc_id", "text", "source", "n_chars", "ids", "data"}
    for r in got:
        assert r["ids"] == tiktoken_codec.encode_ordinary(r["text"] or "") and bytes(r["data"]).decode() == (r["text"] or "")
    digests = bpe.round_trip_digests(df, BPE, P.PATTERN).collect()
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, len(r["ids"]), hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()) for r in got)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"]) for r in digests) == want
    assert bpe.round_trip_digests(df.limit(0), BPE, P.PATTERN).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(SPACED, st.just("x <|endoftext|> <|startoftext|>y")), max_size=4))
def test_chunked_library_equals_library(texts):
    for path, rule in ((PATH3, "before_spaces"), (PATH10, "at_spaces")):
        own = library_tokens.load(path, rule)
        want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
        assert library_tokens.load(path, rule, counts=True).encode(texts) == [len(w) for w in want]


def test_token_counts_and_cache(spark, docs_of, odd_rows, tmp_path):
    df = docs_of(odd_rows).withColumnRenamed("n_chars", "n_tokens")
    cache = str(tmp_path / "cache")
    own = library_tokens.load(PATH3, "before_spaces").tokenizer
    got = token_counts.count_tokens(df, cache, PATH3, "before_spaces").collect()
    assert len(got) == len(odd_rows)
    assert all(r["n_tokens"] == len(own.encode(r["text"] or "", add_special_tokens=False).ids) for r in got)
    distinct = len({r[1] or "" for r in odd_rows})
    assert spark.read.parquet(cache).count() == distinct
    # only the new text is encoded and appended
    token_counts.count_tokens(docs_of([*odd_rows, (99, "a new text")]), cache, PATH3, "before_spaces").collect()
    assert spark.read.parquet(cache).count() == distinct + 1
    # stored counts are used as they are
    poisoned = str(tmp_path / "poisoned")
    version = library_tokens.version(PATH3)
    spark.createDataFrame([(bytearray(hashlib.sha256(b"a b c").digest()), version, 77)], token_counts.CACHE_SCHEMA).write.parquet(poisoned)
    assert token_counts.count_tokens(docs_of([(1, "a b c")]), poisoned, PATH3, "before_spaces").first()["n_tokens"] == 77
    assert token_counts.count_tokens(df.limit(0), str(tmp_path / "none"), PATH3, "before_spaces").collect() == []


def word_table(most=1000):
    asked = []

    def lengths(words):
        asked.extend(words)
        return [np.array([len(w), ord(w[0])], "<u4") for w in words]

    return library_tokens.WordIds(lengths, most), asked


def test_word_table_of_all_lengths():
    words = [c * n for n in (1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200) for c in "abé"] + ["a" * 64 + "b", "a" * 63 + "b", "aaaaaaaab", "a\0"]
    table, asked = word_table()
    text = " ".join([*words, *reversed(words)])
    for _ in range(2):
        ids, counts = table.ids(text.encode(), *wordhash.word_places(text.encode()))
        assert ids.reshape(-1, 2).tolist() == [[len(w), ord(w[0])] for w in text.split(" ")] and set(counts.tolist()) == {2}
    assert sorted(asked) == sorted(words)  # each once
    small, again = word_table(4)  # starts anew when full, and grows for a batch that is larger
    for run in ("a b c", "d e f", "a b c d e f g h"):
        ids, _ = small.ids(run.encode(), *wordhash.word_places(run.encode()))
        assert ids.reshape(-1, 2)[:, 1].tolist() == [ord(w) for w in run.split()]
    assert len(again) == 14


@pytest.mark.parametrize("other", ["cd ab", "abcdefghi abcdefghj", "x" * 70 + " " + "x" * 69 + "y"])
def test_word_table_compares_every_word(monkeypatch, other):
    """Also those that share a hash with a word of the same batch."""
    monkeypatch.setattr(library_tokens.Words, "hashes", lambda self: self.sizes.astype(np.uint64))
    with pytest.raises(ValueError, match="one 64-bit hash"):
        word_table()[0].ids(other.encode(), *wordhash.word_places(other.encode()))


def test_new_words_go_to_the_library_together(monkeypatch):
    """By blanks and a control character, not one by one; words that hold it or a special string's ends go alone."""
    own = library_tokens.ChunkedLibrary(PATH10, "at_spaces", False)
    own.finer, calls = False, []

    class Told:
        def __getattr__(self, name):
            return getattr(plain, name)

        def encode_batch_fast(self, texts, **more):
            calls.append(texts)
            return plain.encode_batch_fast(texts, **more)

    plain = own.tokenizer
    own.tokenizer = Told()
    words = [f"wörd{i}'s" for i in range(1500)] + ["\x01", "a\x01b", "<|endoftext|>", "x<y", "\x02", "Σ\u0301", "\u0301a"]
    got = own.encode([" ".join(words), None, ""])
    assert np.frombuffer(got[0], "<u4").tolist() == [i for w in words for i in plain.encode(w, add_special_tokens=False).ids]
    assert got[1:] == [b"", b""]
    assert [len(c) for c in calls] == [1, 1, 4] and calls[0][0].count(" \x01 ") == 999


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=200), max_size=6), st.integers(0, 3))
def test_blocks_round_trip(docs, repeat):
    arrays = [np.array(d * 3 ** repeat, np.uint32) for d in docs]
    keys = [None if i % 3 == 2 else i * 7 - 3 for i in range(len(docs))]
    got_keys, got = id_files.unpack_block(id_files.pack_block(keys, arrays, 61))
    assert got_keys == keys and [g.tolist() for g in got] == [a.tolist() for a in arrays]


def test_blocks_compress_and_tell_damage():
    rng = np.random.default_rng(0)
    common = rng.zipf(1.5, 60_000).clip(max=999).astype(np.uint32)
    block = id_files.pack_block([1], [common], 1000)
    assert len(block) < 2 * len(common) * 0.6
    assert (id_files.unpack_block(block)[1][0] == common).all()
    for at in (5, 40, len(block) - 3):
        with pytest.raises(ValueError):
            id_files.unpack_block(block[:at] + bytes([block[at] ^ 1]) + block[at + 1:])
    with pytest.raises(ValueError):
        id_files.unpack_block(block[:10])
    with pytest.raises(ValueError):
        id_files.pack_block([1], [common], 10)


ODD = st.text(st.one_of(st.sampled_from("abJKISD'strevmlld.,!=<|>-_3٣Ⅷ é\u030c\u0301\u0338\u0307\u20e3İǰſΣσς\x00\x01\x1c\x7f\x85\u3000\u1100\u1161 \t"), st.characters(exclude_categories=["Cs"])), max_size=30)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(ODD, st.sampled_from(["<|ENDOFTEXT|>", "x<|endoftext|>y, Z", "it's We'Ll, O'Dog 3's '3"])), max_size=5))
def test_finer_pieces_equal_library(texts):
    own = library_tokens.load(PATH10, "at_spaces")
    assert own.finer
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_meet_once_in_any_case():
    own = library_tokens.ChunkedLibrary(PATH10, "at_spaces", False)
    texts = ["Word, word. (WORD) word;word 1word2", "WORD!word's Word'S İstanbul Istanbul J\u030c j\u030c", None]
    got = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    found = {bytes(own.table.bytes.held[s:s + n]).decode() for s, n in zip(own.table.spots.rows, own.table.sizes.rows)}
    assert found == {"word", ",", ".", "(", ")", ";", "1", "2", "!", "'s", "İstanbul", "istanbul", "J\u030c", "j\u030c"} and len(own.table) == len(found)


def test_block_bytes_stay():
    """Blocks written earlier are read, and the same ids give the same bytes."""
    x = np.arange(150_000, dtype=np.int64)
    ids = np.where(x % 3, (x * x // 7) % 97, (x // 5) * 2654435761 % 3001).astype(np.uint32)
    block = id_files.pack_block([7, None], [ids[:60_001], ids[60_001:]], 3001)
    assert hashlib.sha256(block).hexdigest() == "fbf354d5067678c6573e095aeccbaed6177cb872d8dbf94ef2d45ae3940e9783"
    keys, docs = id_files.unpack_block(block)
    assert keys == [7, None] and (np.concatenate(docs) == ids).all()


def test_id_files(spark, docs_of, odd_rows, tmp_path):
    folder = str(tmp_path / "ids")
    id_files.write_ids(docs_of(odd_rows), folder, PATH10, 49_408, end_id=2, parts=3)
    got = sorted(id_files.read_ids(spark, folder).collect(), key=lambda r: r["start"])
    own = library_tokens.load(PATH10, "at_spaces").tokenizer
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = [own.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows]
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    assert [r["ids"] for r in got] == want
    assert [r["start"] for r in got] == np.cumsum([0] + [len(w) for w in want[:-1]]).tolist()
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]
    empty = str(tmp_path / "empty")
    id_files.write_ids(docs_of([]), empty, PATH10, 49_408)
    assert id_files.read_ids(spark, empty).collect() == []
