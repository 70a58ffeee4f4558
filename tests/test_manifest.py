"""Versioned tables: commits, races, pins, retention, and the catalog's actions on them."""

import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from tabsense.operators import profile
from tabsense.sources import catalog, manifest


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x long")


def found(df):
    return sorted(r["x"] for r in df.collect())


def test_replace_is_one_commit_and_versions_stay(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(LookupError):
        manifest.open_table(spark, root)
    assert manifest.commit(numbers(spark, 1, 2), root) == 1
    reader = manifest.open_table(spark, root)
    assert manifest.commit(numbers(spark, 3), root) == 2
    assert found(reader) == [1, 2] and found(manifest.open_table(spark, root)) == [3] and found(manifest.open_table(spark, root, 1)) == [1, 2]


def test_racing_writers_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    manifest.commit(numbers(spark, 0), root)
    with ThreadPoolExecutor(6) as pool:
        made = list(pool.map(lambda i: manifest.commit(numbers(spark, i), root), range(1, 7)))
    assert sorted(made) == list(range(2, 8)) == manifest.versions(spark, root)[1:]
    assert sorted(found(manifest.open_table(spark, root, v))[0] for v in made) == list(range(1, 7))
    path = f"{root}/_manifest/x.json"
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda i: manifest.create_if_absent(spark, path, str(i)), range(16))) == 1


def test_retention_keeps_pinned_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    for i in range(5):
        manifest.commit(numbers(spark, i), root)
    held = manifest.pin(spark, root, 2)
    assert manifest.retain(spark, root) == [1, 3] and manifest.versions(spark, root) == [2, 4, 5]
    assert found(manifest.open_table(spark, root, 2)) == [1]
    assert len([n for n in os.listdir(root) if n.startswith("data-")]) == 3
    with pytest.raises(LookupError):
        manifest.pin(spark, root, 1)
    manifest.unpin(spark, held)
    assert manifest.retain(spark, root, keep=1) == [2, 4] and found(manifest.open_table(spark, root)) == [4]


def test_catalog_opens_and_deletes(spark, tmp_path):
    root = str(tmp_path)
    original = spark.createDataFrame([(f"dataset_{i}", f"f{i}.csv", "csv", i) for i in range(4)], "table_name string, original_filename string, file_type string, uploaded_seq long")
    cleaned = spark.createDataFrame([("dataset_3_clean", "dataset_3", 3)], "table_name_cleaned string, original_table string, uploaded_seq long")
    transformed = spark.createDataFrame([], "table_name_transformed string, cleaned_table string, target_column string, uploaded_seq long")
    for i in range(4):
        manifest.commit(numbers(spark, i), f"{root}/dataset_{i}")
    manifest.commit(numbers(spark, 33), f"{root}/dataset_3_clean")
    assert found(catalog.open_latest_dataset(original, cleaned, root)) == [33]
    assert found(catalog.open_latest_dataset(original, cleaned.limit(0), root)) == [3]
    assert catalog.delete_tables(catalog.retention_candidates(original, cleaned, transformed), root) == 2
    assert sorted(os.listdir(root)) == ["dataset_2", "dataset_3", "dataset_3_clean"]
    with pytest.raises(LookupError):
        catalog.open_latest_dataset(original.limit(0), cleaned, root)


def test_preview_json(spark):
    df = spark.createDataFrame([(i, f"n{i}", None if i == 1 else i / 2) for i in range(10)], "row_id long, name string, v double").repartition(3)
    got = profile.preview_json(df, 3).first()
    assert (got["n_rows"], got["n_columns"]) == (10, 2)
    assert json.loads(got["first_rows"]) == [{"name": "n0", "v": 0.0}, {"name": "n1", "v": None}, {"name": "n2", "v": 1.0}]
    assert json.loads(profile.preview_json(df.limit(0)).first()["first_rows"]) == []
