"""Versioned tables: data folders that are never changed and one small manifest a version.

A writer writes a data folder of its own and then commits it by creating the next manifest, which succeeds for one
writer only; whoever comes second takes the next number.  So a replacement is one step, readers always see a whole
version, and two writers lose nothing.  A reader may pin the version it reads; retention deletes what is neither among
the newest nor pinned.

Creating a manifest needs a file system where a rename does not replace a file that is there (HDFS; local disks by a
hard link).  Only file names and manifests pass through the driver.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, where = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def _write(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _at(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    source = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with this content unless there is one; whether it was made."""
    fs, final = _at(spark, path)
    made = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    _write(spark, made, text)
    try:
        if fs.getScheme() == "file":
            try:
                os.link(_at(spark, made)[1].toUri().getPath(), final.toUri().getPath())
                return True
            except FileExistsError:
                return False
        return not fs.exists(final) and fs.rename(_at(spark, made)[1], final)
    finally:
        _delete(spark, made)


def _manifests(root: str) -> str:
    return f"{root.rstrip('/')}/_manifest"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, oldest first."""
    return [int(n[:-5]) for n in _names(spark, _manifests(root)) if n.endswith(".json") and n[:-5].isdigit()]


def commit(df: DataFrame, root: str) -> int:
    """Write ``df`` as the newest version of the table at ``root``; its number."""
    spark = df.sparkSession
    data = f"{root.rstrip('/')}/data-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(data)
    number = max(versions(spark, root), default=0) + 1
    while not create_if_absent(spark, f"{_manifests(root)}/{number:012d}.json", json.dumps({"version": number, "data": data.rsplit("/", 1)[1]})):
        number += 1
    return number


def _data(spark: SparkSession, root: str, version: int) -> str:
    return f"{root.rstrip('/')}/{json.loads(_read(spark, f'{_manifests(root)}/{version:012d}.json'))['data']}"


def open_table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest (or the given) version of a table."""
    known = versions(spark, root)
    if not known or version is not None and version not in known:
        raise LookupError(f"no version {version or ''} of {root}")
    return spark.read.parquet(_data(spark, root, known[-1] if version is None else version))


def pin(spark: SparkSession, root: str, version: int) -> str:
    """Keep a version from being deleted; returns the pin for :func:`unpin`."""
    path = f"{_manifests(root)}/pins/{version:012d}-{uuid.uuid4().hex}"
    _write(spark, path, "")
    if version not in versions(spark, root):  # deleted before the pin was there
        _delete(spark, path)
        raise LookupError(f"no version {version} of {root}")
    return path


def unpin(spark: SparkSession, path: str) -> None:
    _delete(spark, path)


def retain(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete all versions but the ``keep`` newest and pinned ones; the numbers deleted.

    A version's manifest goes first and comes back if a pin appeared meanwhile, so whoever holds a pin holds the data.
    """
    pinned = lambda: {int(n.split("-")[0]) for n in _names(spark, f"{_manifests(root)}/pins") if n[:1].isdigit()}
    gone = []
    for version in versions(spark, root)[:-keep or None]:
        if version in pinned():
            continue
        data, path = _data(spark, root, version), f"{_manifests(root)}/{version:012d}.json"
        text = _read(spark, path)
        _delete(spark, path)
        if version in pinned():
            create_if_absent(spark, path, text)
            continue
        _delete(spark, data)
        gone.append(version)
    return gone


def drop(spark: SparkSession, root: str) -> None:
    """Delete a table with all its versions."""
    _delete(spark, root)
