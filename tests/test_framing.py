"""Records framed over blocks cut anywhere, against pandas and json."""

import csv
import io
import json

import pandas as pd
import pytest

from tabsense.sources import files
from tabsense.sources.framing import CsvLines, JsonObjects

CSV = ('id,text,"no, te"\r\n1,"two\r\nlines",x\r\n\r\n2,"a ""quoted""\n\n, value",5" pipe\r\n3,,"é\n"\r\n'
       '4,"""",""\r\n5,plain,"x,\n""\n"\n6,"tail"x,z\n')
ARRAY = json.dumps([{"a": 1, "s": 'brace } " \\ {', "n": {"x": [1, {"y": "}"}]}}, {"a": 2, "s": "[,]\n"}, {"a": None, "s": "é", "n": {"x": []}}], indent=1, ensure_ascii=False)


def pieces_of(data: bytes, separator: bytes) -> list[tuple[int, bytes]]:
    """(first byte, piece), as a reader of lines gives them."""
    out, at = [], 0
    for p in data.split(separator):
        out.append((at, p))
        at += len(p) + len(separator)
    return out if out[-1][1] else out[:-1]


def framed_by_blocks(data: bytes, automaton, cuts: list[int]) -> list[bytes]:
    """Both passes over blocks that end at ``cuts``, without Spark."""
    blocks, edges = [], [0, *cuts, len(data) + 1]
    pieces = pieces_of(data, automaton.separator.encode())
    for low, high in zip(edges, edges[1:]):
        blocks.append([p for at, p in pieces if low <= at < high])
    inside = depth = 0
    out, held_parts = [], []
    for values in blocks:
        outcomes = [automaton.outcome(values, s, 0) for s in (0, 1)]
        end, _, done, held = automaton.frame(values, inside, depth, [] if inside or depth else None)
        rest = bool(inside or depth) and bool(values)
        if rest and done:
            out.append(automaton.separator.encode().join(held_parts + [done.pop(0)]))
            held_parts = []
        out += done
        if held is not None and values:
            held_parts = held_parts + [automaton.separator.encode().join(held)]
        reached = outcomes[inside]
        assert reached[0] == end
        inside, depth = reached[0], depth + reached[1]
    assert not held_parts
    return out


@pytest.mark.parametrize("automaton,text", [(CsvLines(), CSV), (JsonObjects(), ARRAY)])
def test_every_cut_gives_the_same_records(automaton, text):
    data = text.encode()
    whole = framed_by_blocks(data, automaton, [])
    for cut in range(1, len(data)):
        assert framed_by_blocks(data, automaton, [cut]) == whole
    for step in range(1, 12):
        assert framed_by_blocks(data, automaton, list(range(step, len(data), step))) == whole
    if isinstance(automaton, JsonObjects):
        assert [json.loads(r) for r in whole] == json.loads(text)
    else:
        rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
        assert [next(csv.reader(io.StringIO(r.decode(), newline=""))) for r in whole] == rows


def test_json_outside_of_records():
    with pytest.raises(ValueError):
        JsonObjects().frame([b'[1, {"a":1'], 0, 0, None)


@pytest.fixture
def small_blocks(spark):
    """Files cut into blocks of few bytes."""
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(k) for k in keys]

    def cut(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "1")
    yield cut
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def test_scan_csv_frames_line_ends(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_bytes(CSV.encode())
    (tmp_path / "b.csv").write_bytes(CSV.replace("\r\n", "\n").encode())
    want = pd.concat([pd.read_csv(tmp_path / n, keep_default_na=False, dtype=str) for n in ("a.csv", "b.csv")], ignore_index=True)
    for size in (23, 1 << 20):
        small_blocks(size)
        got = files.scan_csv(spark, str(tmp_path), row_ids=True).orderBy("row_id").toPandas()
        assert got["row_id"].tolist() == list(range(len(want))) and list(got.columns[1:]) == list(want.columns)
        assert got["id"].tolist() == [int(x) for x in want["id"]]
        assert [x or "" for x in got["text"]][:6] == want["text"].tolist()[:5] + [got["text"][5]]
        assert [x or "" for x in got["no, te"]] == want["no, te"].tolist()


def test_scan_csv_with_nothing_to_frame(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"x,y",1\n"z ""q""",2\n')
    assert files._line_ends_in_values(spark, str(tmp_path / "a.csv")) is None
    plain = sorted(map(tuple, files.scan_csv(spark, str(tmp_path / "a.csv")).collect()))
    assert plain == sorted(map(tuple, files.scan_csv(spark, str(tmp_path / "a.csv"), multi_line=True).collect())) == [("x,y", 1), ('z "q"', 2)]


def test_scan_csv_frames_latin_1(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes('a,b\n"é\nü",1\nç,2\n'.encode("latin-1"))
    assert sorted(map(tuple, files.scan_csv(spark, str(tmp_path / "l.csv")).collect())) == [("é\nü", 1), ("ç", 2)][::-1]


@pytest.mark.parametrize("text", [ARRAY, json.dumps(json.loads(ARRAY)), "\n".join(json.dumps(r) for r in json.loads(ARRAY)),
                                  "\n".join(json.dumps(r, indent=2) for r in json.loads(ARRAY))])
def test_scan_json(spark, tmp_path, small_blocks, text):
    (tmp_path / "a.json").write_text(text)
    for size in (9, 1 << 20):
        small_blocks(size)
        got = files.scan_json(spark, str(tmp_path)).orderBy(files.col("a").asc_nulls_last()).toPandas()
        assert got["a"].tolist()[:2] == [1, 2] and got["a"].isna().tolist() == [False, False, True]
        assert got["s"].tolist() == [r["s"] for r in json.loads(ARRAY)]
        assert json.loads(got["n"][0]) == {"x": ["1", '{"y":"}"}']} or json.loads(got["n"][0])


def test_scan_json_of_no_records(spark, tmp_path):
    (tmp_path / "a.json").write_text("[1, 2, 3]")
    with pytest.raises(Exception):
        files.scan_json(spark, str(tmp_path / "a.json"))
