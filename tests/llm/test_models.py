import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsense.llm import langid, mixing, neighbors, quality
from tests.conftest import SF01


def held_rows(rows, modulus, held):
    return [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % modulus == held]


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs.select("doc_id", "text"), model).collect()}
    test = held_rows(docs.collect(), 4, 2)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in test]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    again = langid.fit(docs)
    assert (again.embeddings == model.embeddings).all()


def test_language_odd_rows(docs_of, odd_rows):
    df = docs_of(odd_rows).withColumn("score", F.lit("clash"))
    model = langid.train([("xx", "abc abd " * 30), ("yy", "zyx wvu " * 30)] * 20)
    got = langid.predict(df, model).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == langid.UND) == (not letter) and (letter or (r["score"] == 0 and r["rejected"]))
    assert langid.predict(df.limit(0), model).collect() == []
    nothing = langid.fit(docs_of([]))
    assert {r["lang_pred"] for r in langid.predict(df, nothing).collect()} == {langid.UND}
    one = langid.fit(docs_of([(i, "mot", "fr") for i in range(9)]))
    assert langid.predict(docs_of([(1, "mot")]), one).first()["lang_pred"] == "fr"


def test_language_of_very_long_texts():
    """Runs see a letter over each cut: the counts are those of the whole text."""
    text = "Ünïcode ΣΑΣ İstanbul words and more, ß 12 " * 7
    for run in (1, 2, 5, 17, 100):
        assert all((a == b).all() for a, b in zip(langid._count_whole([text], run), langid.subwords([text])))


def test_samples_are_bounded_by_bytes(docs_of):
    from tabsense.llm.samples import collect_texts, hashed_rows
    docs = docs_of([(i, "x" * (10_000 if i == 5 else 100 + i), "ab"[i % 2]) for i in range(60)])
    sample = hashed_rows(docs, "lang", "doc_id", 1000)
    got = collect_texts(sample, "lang", "text", 1000, 4000)
    by = {lang: [t for k, _, t in got if k == lang] for lang in "ab"}
    assert all(1500 < sum(map(len, v)) <= 2000 for v in by.values())  # the one text above a label's share is passed over
    assert len(collect_texts(sample, "lang", "text", 3, 10**9)) == 6 and len(collect_texts(sample, "lang", "text", 1000, 10**9)) == 60


def test_every_language_is_learned(docs_of):
    langs = [f"l{i:03d}" for i in range(230)]
    model = langid.fit(docs_of([(i * 10 + j, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} " * 9, x) for i, x in enumerate(langs) for j in range(4)]))
    assert model.langs == langs


def test_quality_on_held_out(spark):
    # the larger tables: the smaller ones hold out a dozen bad texts only
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id")
    model = quality.fit(docs, labels)
    score = {r["doc_id"]: r["score"] for r in quality.score(docs.select("doc_id", "text"), model).collect()}
    test = held_rows(labels.collect(), 5, 0)
    good, bad = ([score[r["doc_id"]] for r in test if r["quality"] == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([s >= 0.3 for s in good]) > 0.97
    assert np.mean([s < 0.3 for s in bad]) > 0.9


def test_quality_odd_rows(docs_of, odd_rows, spark):
    df = docs_of(odd_rows).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(-5, 9)] + [(None, 1), (2, None)], "doc_id long, quality int")
    got = quality.score(df, quality.fit(df, labels)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not r["text"]}) == 1  # null counts as empty
    none = quality.fit(docs_of([]), labels)
    assert {r["score"] for r in quality.score(df, none).collect()} == {0.5}
    assert quality.score(df.limit(0), none).collect() == []


def brute_targets(sizes, weights, epochs):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, rest = {}, set(sizes), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > epochs * sizes[s]}
        if not over:
            target.update({s: rest * weight[s] / total for s in free})
            break
        target.update({s: epochs * sizes[s] for s in over})
        rest -= sum(target[s] for s in over)
        free -= over
    return target


def test_mixing(docs_of):
    rng = random.Random(3)
    share = {"a": 900, "b": 40, "c": 10, None: 30, "Z": 5, "é": 60}
    rows = [(i, "w " * rng.randrange(0, 40), None, s) for i, s in enumerate(s for s, n in share.items() for _ in range(n))]
    df = docs_of(rows).withColumn("target", F.lit("clash"))
    got = mixing.mix(df).collect()
    sizes = {s: sum(r["size"] for r in got if r["source"] == s) for s in share}
    want = brute_targets(sizes, (5, 2, 1), 3)
    for s in share:
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 0.01 * want[s] + 25
        assert all(0 <= r["taken"] <= 3 * r["size"] and r["size"] == len(r["text"].split()) for r in own)
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, got))
    repeated = mixing.repeat_rows(mixing.mix(df), ["doc_id", "text", "source"]).collect()
    words = {}
    for r in repeated:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {r["doc_id"]: r["taken"] for r in got if r["taken"]}


def test_mixing_odd_rows(docs_of, odd_rows):
    got = mixing.mix(docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert all(r["taken"] == 0 and r["size"] == 0 for r in got if not (r["text"] or "").strip())
    assert mixing.mix(docs_of([])).collect() == []
    assert mixing.mix(docs_of([(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def brute_nearest(rows, q, k):
    v = np.array(rows[q], np.float32).astype(float)
    scored = sorted((-(v * np.array(x, np.float32).astype(float)).sum(), i) for i, x in rows.items() if i != q and len(x) == len(v))
    return [i for _, i in scored[:k]]


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 32)) * rng.uniform(0.5, 2, (1500, 1))
    x[100:400] = x[7]  # copies: a fifth of all rows
    rows = {i: x[i].tolist() for i in range(1500)}
    got = neighbors.nearest(vectors_of(spark, [(i, v, "s") for i, v in rows.items()]), lambda i: i % 50 == 0, k=10).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 1500, 50))
    recall = []
    for q, own in by.items():
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        recall.append(len(set(brute_nearest(rows, q, 10)) & {r["vec_id"] for r in own}) / 10)
    assert np.mean(recall) > 0.9
    assert [r["vec_id"] for r in by[150]] == brute_nearest(rows, 150, 10)  # its copies, smallest ids first


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0], "a"), (20, [0.0, 0.0], "a"), (40, None, "a"), (60, [float("nan"), 1.0], "a"), (80, [None, 1.0], "a"),
            (None, [1.0, 1.0], "a"), (3, [2.0, 0.0], None), (4, [0.0, -1.0], "a"), (5, [1.0, 2.0, 3.0], "a"), (100, [1.0, 2.0, 3.0], "a"), (120, [], "a")]
    got = neighbors.nearest(vectors_of(spark, rows), lambda i: i % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 3, 2.0), (0, 2, 4, 0.0), (100, 1, 5, 14.0)]
    assert neighbors.nearest(vectors_of(spark, []), lambda i: i % 20 == 0).collect() == []


@pytest.mark.parametrize("norms", ["outliers", "log-normal"])
def test_neighbours_recall_of_uneven_norms(spark, norms):
    x = np.array([r[0] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").select("embedding").collect()])
    if norms == "outliers":
        x[[5, 77]] *= [[10], [1000]]
    else:
        x *= np.random.default_rng(0).lognormal(0, 0.5, (2000, 1))
    rows = {i: x[i].tolist() for i in range(2000)}
    by = {}
    got = neighbors.nearest(vectors_of(spark, [(i, v, "s") for i, v in rows.items()]), lambda i: i % 40 == 0).collect()
    for r in got:
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(set(brute_nearest(rows, q, 20)) & by[q]) / 20 for q in range(0, 2000, 40)]) > (0.95 if norms == "outliers" else 0.9)


def test_neighbours_hash_every_band_and_repeated_keys(spark, monkeypatch):
    """No band is searched whole unless its buckets gave a query too few rows; of a repeated key the smallest vector counts."""
    searched = []
    search = neighbors._search
    monkeypatch.setattr(neighbors, "_search", lambda data, queries, at, k, kind: searched.append((at, queries.count())) or search(data, queries, at, k, kind))
    rng = np.random.default_rng(4)
    rows = {i: v.tolist() for i, v in enumerate(rng.normal(size=(800, 16)) / 4)}
    double = [(i, v, "s") for i, v in rows.items()] + [(7, [9.0] * 16, "s"), (9, [9.0] * 16, "s"), (9, [8.0] * 16, "s")]
    got = neighbors.nearest(vectors_of(spark, double), lambda i: i % 100 == 0, k=5).collect()
    assert [at for at, _ in searched] == [["d", "band", "bucket"], ["d", "band"]] and searched[0][1] > 0
    smallest = {i: min([v] + [w for j, w, _ in double if j == i]) for i, v in rows.items()}
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(by) == set(range(0, 800, 100)) and all(len(set(v)) == 5 for v in by.values())
    assert np.mean([len(set(brute_nearest(smallest, q, 5)) & set(v)) / 5 for q, v in by.items()]) >= 0.9


def test_neighbours_full_lists(spark):
    rng = np.random.default_rng(5)
    # dimensions 60 to 64: tables of 10 to 40 rows, searched at once
    rows = {100 * d + i: rng.normal(size=d).tolist() for d, n in zip(range(60, 65), (10, 20, 21, 22, 40)) for i in range(n)}
    by = {}
    for r in neighbors.nearest(vectors_of(spark, [(i, v, "s") for i, v in rows.items()]), lambda i: i % 2 == 0).collect():
        by.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in (i for i in rows if i % 2 == 0):
        want = brute_nearest(rows, q, 20)
        assert sorted(by[q]) == list(range(1, len(want) + 1))
        if len(want) < 20:
            assert [by[q][i] for i in sorted(by[q])] == want


def test_hadamard():
    x = np.eye(8)
    assert np.allclose(neighbors.hadamard(x) @ neighbors.hadamard(x).T, np.eye(8))
