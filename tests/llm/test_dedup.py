import collections
import hashlib
import random
import tracemalloc
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabsense.llm import fingerprints, graphs, near_dups, substrings
from tests.llm.conftest import passage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(texts, window):
    seen, out = set(), []
    for t in texts:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if key in seen:
                gone[s:s + window] = [True] * window
            seen.add(key)
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def made_texts(n=60):
    """Texts with shared passages, edits inside them, periodic parts and copies."""
    rng = random.Random(4)
    shared = [passage(100 + i, 45) for i in range(4)]
    out = []
    for i in range(n):
        words = passage(i, rng.randrange(0, 90))
        for _ in range(rng.randrange(0, 3)):
            p = list(rng.choice(shared))
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = f"edit{i}"
            words[rng.randrange(len(words) + 1):0] = p[rng.randrange(10):]
        if i % 9 == 0:
            words += ["la", "di"] * 30
        out.append("  ".join(words) if i % 2 else "\n".join(words))
    return out + out[:5] + ["tick " * 100, "tick " * 40]


@pytest.mark.parametrize("window,k", [(20, 8), (6, 3)])
def test_substrings_equal_brute_force(docs_of, window, k):
    texts = made_texts()
    df = docs_of([(i * 3 - 7, t) for i, t in enumerate(texts)]).withColumn("kept", F.lit("clash")).repartition(5)
    got = sorted(substrings.remove_repeats(df, window=window, k=k).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_words"], r["n_removed"], r["kept"]) for r in got] == brute_repeats(texts, window)


def test_substrings_odd_rows(docs_of, odd_rows):
    got = substrings.remove_repeats(docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] in (5, 6, 8)}
    assert by[5]["n_removed"] == 0 and by[6]["n_removed"] == 30_000 and by[6]["kept"] == ""
    assert by[8]["n_words"] == 60 and by[8]["n_removed"] == 59
    assert {r["n_words"] for r in got if not (r["text"] or "").strip()} == {0}
    assert substrings.remove_repeats(docs_of([])).collect() == []


def brute_classes(texts, similarity=0.8):
    bags = []
    for t in texts:
        w = WORD.findall(t or "")
        bags.append(collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(bags):
        for j in range(i):
            low = sum((a & bags[j]).values())
            if low and low / (sum(a.values()) + sum(bags[j].values()) - low) >= similarity:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def edited(words, times, seed):
    rng, w = random.Random(seed), list(words)
    for _ in range(times):
        w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
    return w


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_near_duplicates_equal_brute_force(docs_of, monkeypatch, block_rows):
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", block_rows)
    texts = []
    for g in range(12):
        base = passage(g, 150)
        texts += [" ".join(base), "  ".join(base)]
        for v in range(12):  # versions of versions: chains whose ends are far apart
            base = edited(base, 2, v) if g % 2 else edited(passage(g, 150), v % 5, v)
            texts.append(" ".join(base))
    texts += ["to be or not", "to be or not", "to be", "", None, "la " * 200, "la " * 190, "la " * 100]
    df = docs_of([(i, t) for i, t in enumerate(texts)]).withColumn("class_id", F.lit("clash")).repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classified(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_near_duplicates_odd_rows(docs_of, odd_rows):
    got = near_dups.classified(docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] in (5, 6)}
    assert by[5] == by[6]
    assert len({r["class_id"] for r in got if not (r["text"] or "").strip()}) == 4  # no words: each its own
    assert near_dups.classified(docs_of([])).collect() == []


def test_bag_min_hash_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    element = rng.integers(0, 2**63, 40).astype(np.uint64)
    a, b = rng.integers(1, 30, 40), rng.integers(1, 30, 40)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    sig = near_dups.bag_min_hash(np.repeat([0, 1], 40), np.tile(element, 2), np.concatenate([a, b]), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03
    alone = near_dups.bag_min_hash(np.zeros(40, np.int64), element, a, 1, 4000)
    assert (alone[0] == sig[0]).all()  # independent of the batch


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 99), (101, 99), (5, 5), (200, 200)]
    rows = random.Random(1).sample(chain * 2, len(chain) * 2)
    got = {r["node"]: r["component"] for r in graphs.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99, 101: 99, 200: 200}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).collect() == []


def lz_phrases(text):
    out, i = set(), 0
    for j in range(1, len(text) + 1):
        if text[i:j] not in out:
            out.add(text[i:j])
            i = j
    return out


def test_fingerprints_follow_phrase_likeness():
    texts = [t for t in made_texts(30) if t]
    for a, b in zip(texts, texts[1:] + texts[:1]):
        cut = len(a) - len(a) // 4
        c = a[:cut] + b[:len(a) // 4]
        sa, sc = fingerprints.edited_signatures(a, cut, b[:len(a) // 4])
        assert (sa == fingerprints.signature(a)).all() and (sc == fingerprints.signature(c)).all()
        x, y = lz_phrases(a), lz_phrases(c)
        assert abs(fingerprints.likeness(sa, sc) - len(x & y) / len(x | y)) < 0.2
        assert (fingerprints.from_text(fingerprints.as_text(sa)) == sa).all()


def test_fingerprint_chain(docs_of, odd_rows):
    for parts in (1, 4):
        got = fingerprints.fingerprint_chain(docs_of(odd_rows).repartition(3), parts=parts).collect()
        rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        want = []
        for i, r in enumerate(rows):
            t, after = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
            q = len(t) // 4
            e = t[:len(t) - q] + after[:q]
            s, es, ns = (fingerprints.signature(x) for x in (t, e, after))
            want.append((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.as_text(s), fingerprints.as_text(es),
                         fingerprints.likeness(s, es), fingerprints.likeness(s, ns)))
        order = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
        assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)
    assert fingerprints.fingerprint_chain(docs_of([])).collect() == []
    alone = fingerprints.fingerprint_chain(docs_of([(1, "abcd efgh")])).first()
    assert alone["near_next"] == 1.0


def _peak_mb(work):
    """What ``work`` gives, and the most memory it held beyond what was there."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_signatures_hold_few_texts_at_once(docs_of, monkeypatch):
    made = {}
    monkeypatch.setattr(near_dups, "arrow_map", lambda df, fn, schema, batch_rows=256: made.update(fn=fn, rows=batch_rows))
    near_dups.signatures(docs_of([]))
    texts = [" ".join(passage(i, 400)) for i in range(512)]
    batch = pa.RecordBatch.from_pydict({"doc": list(range(512)), "text": texts})
    parts, peak = _peak_mb(lambda: [len(d["doc"]) for at in range(0, 512, made["rows"]) for d in made["fn"](batch.slice(at, made["rows"]))])
    assert sum(parts) == 512
    assert peak < 50


def test_block_links_compare_few_elements_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    n, size = 400, 2000
    sets = [np.sort(rng.choice(np.arange(size + 60, dtype=np.uint64), size, replace=False)) for _ in range(n)]

    def table(docs):
        return pa.table({"key": [7] * len(docs), "sf": [0] * len(docs), "sa": [0] * len(docs), "doc": docs, "c": docs, "main": [n] * len(docs),
                         "keys": pa.array([[7, 1]] * len(docs)), "sketch": pa.array([[1] * 256] * len(docs), pa.list_(pa.int16())), "total": [size] * len(docs),
                         "elements": [sets[d].tobytes() for d in docs], "weights": [np.ones(size, "<i4").tobytes()] * len(docs)})
    left, right = table([n - 1]), table(list(range(n)))
    whole = near_dups._linked(left, right, 0.8, 0)
    assert whole[1].tolist() == list(range(n - 1))
    monkeypatch.setattr(near_dups, "COMPARED", 7000)
    (a, b), peak = _peak_mb(lambda: near_dups._linked(left, right, 0.8, 0))
    assert (a == n - 1).all() and b.tolist() == whole[1].tolist()
    assert peak < 3
    for limit in (1, size, size + 1, n * size):
        monkeypatch.setattr(near_dups, "COMPARED", limit)
        assert near_dups._linked(left, right, 0.8, 0)[1].tolist() == whole[1].tolist()
