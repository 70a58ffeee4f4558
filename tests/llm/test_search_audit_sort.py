"""Lexical search, filter audit and content sort against plain Python."""

import collections
import hashlib
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tabsense.llm import content_sort, filter_audit, lexical
from tests.llm.conftest import passage

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, k):
    """(item_id, rank, doc_id, score) from (doc_id, text) and (item_id, text) rows."""
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            n, score = sum(b.values()), 0
            for w in set(terms(text)) & set(b):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                score += weight * ((1_000_000_000 * b[w]) // (1000 * b[w] + 20 * (50 + (50 * n * n_docs) // length)))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def made_documents(n=150):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["the", "The", "of,", "x1"]) + " " + w for w in passage(i, rng.randrange(1, 60), 300))) for i in range(n)]
    rows += [(900, None), (901, ""), (902, " .,; \n"), (903, "Été ÉTÉ été İstanbul 日本語 x1"), (904, rows[3][1]), (905, rows[3][1]), (906, "the " * 5000)]
    return rows


def test_search_equals_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", 256)
    docs = made_documents()
    items = [(1, docs[3][1]), (2, "the of"), (3, "unknownword"), (4, None), (5, "Été 日本語!"), (6, " ".join(passage(5, 30, 300))), (7, docs[3][1])]
    frame = docs_of(docs).withColumn("segment", F.lit("clash")).withColumn("term", F.lit(1))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("clash"))
    for a_pass in (2, 4096):
        got = [tuple(r) for r in lexical.search(frame.repartition(5), asked, k=7, items_a_pass=a_pass).collect()]
        assert order(got) == order(brute_search(docs, items, 7))


def test_search_index_of_merged_partitions(spark, docs_of):
    """Partitions that one task reads together are still segments of their own."""
    docs = made_documents()
    made = lexical.index(docs_of(docs).repartition(20), "doc_id", "text", [b"the"]).coalesce(2).where("term IS NULL").collect()
    assert len({r["segment"] for r in made}) == len(made) > 2 and sum(len(r["ids"]) for r in made) == len(docs)


def test_search_of_odd_and_empty_tables(spark, docs_of, odd_rows):
    docs = [(r[0], r[1]) for r in odd_rows]
    items = [(1, "the x y a other"), (2, "")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in lexical.search(docs_of(odd_rows), asked).collect()]
    assert order(got) == order(brute_search(docs, items, 50))
    assert lexical.search(docs_of([]), asked).count() == 0
    assert lexical.search(docs_of(odd_rows), asked.limit(0)).count() == 0


def test_search_chunks_of_long_texts(monkeypatch):
    texts = ["ab cd " * 40, "x" * 300, "", "ef"]
    whole = [(h.tolist(), f.tolist(), n.tolist()) for h, f, n in lexical.term_places(lexical.folded(texts)[0])]
    monkeypatch.setattr(lexical, "CHUNK_BYTES", 32)
    cut = [(h.tolist(), f.tolist(), n.tolist()) for h, f, n in lexical.term_places(lexical.folded(texts)[0])]
    assert len(cut) > 3 and [sum(x, []) for x in zip(*cut)] == [sum(x, []) for x in zip(*whole)]


def test_vocabulary_compares_bytes():
    import numpy as np
    known = lexical.Vocabulary([b"ab", b"zz"])
    raw = np.frombuffer(b"ab cd", np.uint8)
    same_hash = np.array([known.hashes[0], known.hashes[0]])
    first = np.array([0, 3])
    hit, number = known.find(raw, same_hash, first, np.array([2, 2]))
    assert len(hit) == 1 and raw[first[hit[0]]:first[hit[0]] + 2].tobytes() == [b"ab", b"zz"][number[0]]


def brute_audit(rows, labels):
    """Rows by (part, order, step) from (doc_id, text, lang) and {doc_id: (quality, toxic)}."""
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    parts = collections.defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and smallest[t] < i}
        parts[lang or ""].append((fails, labels.get(i, (None, None)) if i is not None else (None, None)))
    out, shapley = {}, collections.Counter()
    for part, docs in parts.items():
        for p in itertools.permutations("ABCDE"):
            for s, f in enumerate(p):
                left = [d for d in docs if not any(d[0][g] for g in p[:s])]
                gone = [d for d in left if d[0][f]]
                out[part, "".join(p), s + 1] = [len(left) - len(gone), len(gone), sum(d[0][f] for d in docs) - len(gone),
                                               sum(d[0][f] and sum(d[0].values()) == 1 for d in docs),
                                               sum(d[1][0] == 1 for d in gone), sum(d[1][1] == 1 for d in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_brute_force(spark, docs_of, odd_rows):
    rng = random.Random(3)
    rows = [(i, " ".join(passage(i, rng.choice([5, 150, 210, 400]), rng.choice([40, 3000])) + rng.choice([[], ["A#"], ["SHOUT"] * 20])),
             rng.choice(["en", "fr", None])) for i in range(120)]
    rows += [(200 + i, rows[i % 7][1], rng.choice(["en", "de"])) for i in range(60)] + [r[:3] for r in odd_rows]
    labels = {i: (rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 200, 2)}
    table = spark.createDataFrame([(i, q, x) for i, (q, x) in labels.items()] + [(None, 1, 1), (0, 0, 0)], "doc_id long, quality int, toxic int")
    frame = docs_of(rows).withColumn("mask", F.lit("clash")).withColumn("part", F.lit(3)).withColumn("n", F.lit("clash"))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(filter_audit.document_masks(frame.repartition(4), table), "ABCDE").collect()}
    assert got == brute_audit(rows, labels)


def test_audit_of_empty_tables(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.document_masks(docs_of([]), labels), "ABCDE").count() == 0
    assert filter_audit.audit(filter_audit.document_masks(docs_of([(1, None, None)]), labels), "ABCDE").count() == 600


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_adjacent_swaps_meet_every_order_once(n):
    now, seen = list(range(n)), []
    for swap in [None, *filter_audit.adjacent_swaps(n)]:
        if swap is not None:
            now[swap], now[swap + 1] = now[swap + 1], now[swap]
        seen.append(tuple(now))
    assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_diagram_shares_nodes():
    """All masks count alike: one node a level."""
    diagram = filter_audit.Diagram(4, {m: (1,) for m in range(16)}, 1)
    diagram.swap(1)
    nodes, level = [], {id(diagram.root): diagram.root}
    while level:
        nodes.append(len(level))
        level = {id(c): c for node in level.values() for c in node[:2] if c is not None}
    assert nodes == [1] * 5 and diagram.order == [0, 2, 1, 3]


def brute_copies(rows, largest):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted(((i, (max if largest else min)((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]),
                    hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("largest", [False, True])
def test_content_sort(spark, docs_of, odd_rows, largest):
    """A third of all rows share one text, another third one prefix."""
    rows = [(i, "hot text " * 50) for i in range(300)] + [(1000 + i, "hot text " * 50 + str(i % 200)) for i in range(300)] + [(2000 + i, f"t{i % 250}") for i in range(300)]
    rows += [(None, "hot text " * 50), (None, "only null keys"), (None, "only null keys")] + [(r[0], r[1]) for r in odd_rows]
    frame = docs_of(rows).withColumn("h", F.lit("clash")).withColumn("way", F.lit(1)).withColumn("body", F.lit(None).cast("string"))
    got = content_sort.exact_duplicates(frame.repartition(6), keep_largest=largest).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute_copies(rows, largest)
    kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_content_sort_normalises(spark, docs_of):
    got = content_sort.exact_duplicates(docs_of([(1, "A  b"), (2, "a b "), (3, "c")]), normalise=lambda c: F.trim(F.regexp_replace(F.lower(c), " +", " ")))
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()} == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)}
    assert content_sort.exact_duplicates(docs_of([])).count() == 0


def test_content_sort_shuffles_texts_once(spark, docs_of):
    plan = content_sort.exact_duplicates(docs_of([(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert "python" not in plan.lower() and "MapInArrow" not in plan
