"""Records of CSV and JSON files that may hold line ends, framed by many tasks a file.

A file is read in pieces: lines for CSV, runs up to a closing brace for JSON.  Whether a piece starts inside a quoted
value is unknown to the task that reads a block from the middle of a file, so

1. every block is worked off from both possible starts and reports where each leads (one row a block),
2. a fold over those rows settles each block's real start,
3. every block is framed from there; what it holds of a record that other blocks begin or end travels as a fragment
   (two a block at most), and the fragments are put together.

The records go to Spark's own CSV and JSON parsers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsense.session import materialize, ship_package

_KEYS = ["file", "start", "length"]
_BLOCKS = "file long, start long, length long, to0 int, to1 int, depth0 long, depth1 long, records0 long, records1 long, open0 boolean, open1 boolean"
_STARTS = "file long, start long, length long, inside int, depth long, before long"
_FRAMED = "file long, start long, kind int, at long, text binary"
#: Kinds of framed rows: a whole record, the end (or middle) of a record begun in an earlier block, the begin of one.
WHOLE, REST, BEGIN = 0, 1, 2


class CsvLines:
    """Lines, inside or outside a quoted value.  A quote opens a value only at its start, two quotes inside stand for
    one, and after the closing quote the value runs on to the next comma, as common readers have it.  Lines end with
    ``\\n`` or ``\\r\\n``."""

    separator = "\n"

    def after(self, line: bytes, inside: int) -> int:
        """Whether a quoted value is open at the end of a line."""
        if b'"' not in line:
            return inside
        at = 0
        while True:
            if not inside:
                if line[at:at + 1] != b'"':
                    comma = line.find(b',"', at)
                    if comma < 0:
                        return 0
                    at = comma + 1
                at += 1
            at = line.find(b'"', at)
            while at >= 0 and line[at + 1:at + 2] == b'"':
                at = line.find(b'"', at + 2)
            if at < 0:
                return 1
            at, inside = line.find(b",", at + 1) + 1, 0
            if not at:
                return 0

    def outcome(self, lines: list[bytes], inside: int, depth: int) -> tuple[int, int, int, bool]:
        """(inside, depth, records begun, whether a value stayed open at some line's end) after the lines."""
        begun, opened = 0, False
        for line in lines:
            if not inside and line.strip():
                begun += 1
            inside = self.after(line, inside)
            opened |= bool(inside)
        return inside, depth, begun, opened

    def frame(self, lines: list[bytes], inside: int, depth: int, held: list[bytes] | None) -> tuple[int, int, list[bytes], list[bytes] | None]:
        """(inside, depth, finished records, the lines of an open one) after the lines; ``held``: those open before."""
        done = []
        for line in lines:
            was, inside = inside, self.after(line, inside)
            if held is not None:
                held.append(line)
            elif was or inside or line.strip():
                held = [line]
            if not inside and held is not None:
                done.append(b"\n".join(held).removesuffix(b"\r"))
                held = None
        return inside, depth, done, held


class JsonObjects:
    """Outermost objects: whether a piece, which ends before a closing brace, starts inside a string, and at what depth
    of braces.  Outside of objects there may be white space, commas and square brackets only."""

    separator = "}"
    _TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*("?)|\{', re.S)
    _STRING_END = re.compile(rb'(?:[^"\\]|\\.)*("?)', re.S)
    _BETWEEN = re.compile(rb"(?:[\s,\[\]]|\xef\xbb\xbf)*")

    def _piece(self, piece: bytes, inside: int) -> tuple[int, int, int]:
        """(inside, braces opened, place of the first of them or -1) after a piece."""
        at, opened, first = 0, 0, -1
        if inside:
            end = self._STRING_END.match(piece)
            if not end.group(1):
                return 1, 0, -1
            at = end.end()
        for token in self._TOKEN.finditer(piece, at):
            if token.group(1) is None:
                first = token.start() if first < 0 else first
                opened += 1
            elif not token.group(1):
                return 1, opened, first
        return 0, opened, first

    def outcome(self, pieces: list[bytes], inside: int, depth: int) -> tuple[int, int, int, bool]:
        for piece in pieces:
            inside, opened, _ = self._piece(piece, inside)
            depth += opened - (not inside)
        return inside, depth, 0, True

    def frame(self, pieces: list[bytes], inside: int, depth: int, held: list[bytes] | None) -> tuple[int, int, list[bytes], list[bytes] | None]:
        done = []
        for piece in pieces:
            inside, opened, first = self._piece(piece, inside)
            if depth == 0:
                between = piece if first < 0 else piece[:first]
                if self._BETWEEN.fullmatch(between) is None:
                    raise ValueError("input is not a table of JSON records")
                if first < 0:
                    continue  # what follows the last record
                piece, held = piece[first:], []
            held = [] if held is None else held
            held.append(piece)
            depth += opened - (not inside)
            if depth == 0 and not inside:
                done.append(b"}".join(held) + b"}")
                held = None
        return inside, depth, done, held


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Rows (value, file, start, length): the pieces of the files in order inside each block."""
    ship_package(spark)
    file = F.xxhash64(F.col("_metadata.file_path"))
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("value").cast("binary").alias("value"), file.alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, list[bytes], dict]]:
    """The batch's rows by block: key, values, the first row's other columns."""
    keys = list(zip(*[batch.column(batch.schema.names.index(k)).to_pylist() for k in _KEYS]))
    values, at = batch.column(0).to_pylist(), 0
    while at < len(keys):
        end = at + 1
        while end < len(keys) and keys[end] == keys[at]:
            end += 1
        yield keys[at], values[at:end], {n: batch.column(i)[at].as_py() for i, n in enumerate(batch.schema.names) if i}
        at = end


def block_outcomes(read: DataFrame, automaton) -> DataFrame:
    """One row a block: where each of both starts leads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now, state = [], None, None
        for batch in batches:
            for key, values, _ in _runs(batch):
                if key != now:
                    if now is not None:
                        rows.append((now, state))
                    now, state = key, [(0, 0, 0, False), (1, 0, 0, False)]
                for s in (0, 1):
                    inside, depth, begun, opened = state[s]
                    inside, depth, more, open_ = automaton.outcome(values, inside, depth)
                    state[s] = inside, depth, begun + more, opened or open_
        if now is not None:
            rows.append((now, state))
        flat = [(*k, s[0][0], s[1][0], s[0][1], s[1][1], s[0][2], s[1][2], s[0][3], s[1][3]) for k, s in rows]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(flat, columns=_names(_BLOCKS)), schema=_arrow(_BLOCKS), preserve_index=False)

    return read.mapInArrow(run, _BLOCKS)


def block_starts(outcomes: DataFrame) -> DataFrame:
    """The real start of every block: a fold over the rows of each file."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        inside = depth = before = 0
        out = []
        for r in frame.sort_values("start").itertuples():
            out.append((r.file, r.start, r.length, inside, depth, before))
            inside, depth, before = ((r.to1, depth + r.depth1, before + r.records1) if inside else (r.to0, depth + r.depth0, before + r.records0))
        return pd.DataFrame(out, columns=_names(_STARTS))

    return outcomes.groupBy("file").applyInPandas(run, _STARTS)


def framed(read: DataFrame, starts: DataFrame, automaton) -> DataFrame:
    """Rows (file, start, kind, at, text): the records that begin in each block and fragments of those that cross.

    ``starts`` has a row a block (32 bytes; 25 MB at 100 TB) and is broadcast.  Blocks that were not there in the first
    pass (the files or the layout of blocks changed in between) raise an error.
    """
    changed = F.raise_error(F.lit("the files or their blocks changed while they were read"))
    known = read.join(F.broadcast(starts), _KEYS, "left").select(
        "value", *_KEYS, F.when(F.col("inside").isNull(), changed).otherwise(F.col("inside")).cast("int").alias("inside"), "depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, depth, held, rest, at = None, 0, 0, None, False, 0

        def close() -> list[tuple]:
            return [] if held is None else [(now[0], now[1], REST if rest else BEGIN, at, automaton.separator.encode().join(held))]

        for batch in batches:
            rows = []
            for key, values, first in _runs(batch):
                if key != now:
                    rows += close()
                    now, inside, depth, at = key, first["inside"], first["depth"], 0
                    rest = bool(inside or depth)
                    held = [] if rest else None
                inside, depth, done, held = automaton.frame(values, inside, depth, held)
                for text in done:
                    rows.append((key[0], key[1], REST if rest else WHOLE, -1 if rest else at, text))
                    at, rest = at + (not rest), False
            yield _table(rows)
        if now is not None:
            yield _table(close())

    return known.mapInArrow(run, _FRAMED)


def records(spark: SparkSession, path: str, automaton, outcomes: DataFrame) -> DataFrame:
    """Rows (file, start, at, text, before): every record, whole, with the block where it begins and its number there
    (``before``: the records of the file's earlier blocks, where the automaton counts them).  Written once."""
    starts = materialize(block_starts(outcomes), "framing-starts")
    rows = materialize(framed(pieces(spark, path, automaton.separator), starts, automaton), "framing")
    parts = rows.where(F.col("kind") != WHOLE)
    # fragments: at most two a block
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    grouped = parts.withColumn("record", F.sum(F.when(F.col("kind") == BEGIN, 1).otherwise(0)).over(order)).groupBy("file", "record").agg(
        F.min_by(F.struct("start", "at"), F.struct("start", "kind")).alias("head"), F.sort_array(F.collect_list(F.struct("start", "kind", "text"))).alias("p"))
    joiner = F.lit(automaton.separator.encode())
    text = F.aggregate(F.slice("p", 2, F.size("p")), F.get("p", F.lit(0))["text"], lambda s, x: F.concat(s, joiner, x["text"]))
    whole = grouped.select("file", "head.start", "head.at", text.alias("text"))
    found = rows.where(F.col("kind") == WHOLE).select("file", "start", "at", "text").unionByName(whole)
    return found.join(starts.select("file", "start", "before"), ["file", "start"])


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    schema = _arrow(_FRAMED)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
