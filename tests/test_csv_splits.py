"""CSV files in many splits against Python's own reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from scrubspark.sources import csv as source


def rows_of(text):
    return list(csv.reader(io.StringIO(text, newline="")))


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, str(v)) for k, v in
                     (("spark.sql.files.maxPartitionBytes", n), ("spark.sql.files.openCostInBytes", 0))]
    for k, v in old.items():
        spark.conf.set(k, v)


def cell(r):
    kind = r.random()
    if kind < 0.4:
        return "".join(r.choice("abc 1") for _ in range(r.randrange(1, 9)))
    pool = ["\n", '"', ",", "\r\n", "x", "long word ", '"\n"', ' "q" '] if kind < 0.8 else ["\n" * 30, "y" * 200]
    return "v" + "".join(r.choice(pool) for _ in range(r.randrange(0, 12))) + "w"


def test_random_files_in_splits_of_any_size(spark, tmp_path, small_splits):
    r = random.Random(7)
    for trial in range(2):
        folder = tmp_path / f"t{trial}"
        folder.mkdir()
        want = []
        for part in range(2):
            out = io.StringIO(newline="")
            w = csv.writer(out, lineterminator=r.choice(["\n", "\r\n"]))
            rows = [[f"{part}-{i}", cell(r), cell(r)] for i in range(r.randrange(20, 50))]
            w.writerow(["id", 'na"me', "last"])
            w.writerows(rows)
            (folder / f"f{part}.csv").write_bytes(out.getvalue().encode())
            assert rows_of(out.getvalue())[1:] == rows
            want += rows
        for size in (150, 1 << 20):
            small_splits(size)
            df = source.read_csv(spark, str(folder), infer_types=False, with_order=True)
            got = df.orderBy(*source.ORDER_COLUMNS).collect()
            assert [list(x[:3]) for x in got] == want
            if size == 150:
                assert df.select("_block").distinct().count() > 10


def test_cut_lines_of_random_splits():
    import pyarrow as pa

    class Lines:
        def mapInArrow(self, run, schema):
            return run

    r = random.Random(11)
    for _ in range(300):
        out = io.StringIO(newline="")
        rows = [[str(i), cell(r), cell(r)] for i in range(r.randrange(0, 30))]
        csv.writer(out, lineterminator=r.choice(["\n", "\r\n"])).writerows([["id", "a", "b"], *rows])
        lines, size, at, blocks = out.getvalue().split("\n")[:-1], r.choice([20, 40, 333]), 0, []
        for line in lines:
            blocks.append(-(-at // size) * size)
            at += len(line.encode()) + 1
        cuts = sorted({0, len(lines), *[r.randrange(len(lines) + 1) for _ in range(3)]})
        batches = [pa.RecordBatch.from_pydict({"value": lines[a:b], "_file": ["f"] * (b - a),
                                               "_block": pa.array(blocks[a:b], pa.int64())}) for a, b in zip(cuts, cuts[1:])]
        maps = [m for b in source._state_maps(iter(batches)) for m in b.to_pylist()]
        opener = source._compose([tuple(m.values()) for m in maps])
        inside = {(f, b): o for f, b, o in opener}
        found = {}
        for pieces in (False, True):
            for b in source._records(Lines(), inside, pieces)(iter(batches)):
                for x in b.to_pylist():
                    found.setdefault(x["_block"] if pieces else (x["_block"], x["_row"]), []).append(x)
        records = {}
        for x in found.values():
            x.sort(key=lambda y: y["part"])
            records[x[0]["_block"], max(y["_row"] for y in x)] = "\n".join(y["record"] for y in x)
        got = [next(csv.reader(io.StringIO(records[k], newline=""))) for k in sorted(records)]
        assert got == [["id", "a", "b"], *rows]


def test_stray_quotes_blank_lines_and_short_rows(spark, tmp_path, small_splits):
    text = 'a,b,c\n1,x"y,"q""r"\n\n2,"z" tail,ok\n3,"open\nstill, ""open""\n",end\n4\n5,,""\n"6",7"8"9,"t"'
    (tmp_path / "f.csv").write_text(text)
    want = [("1", 'x"y', 'q"r'), ("2", '"z" tail', "ok"), ("3", 'open\nstill, "open"\n', "end"), ("4", None, None),
            ("5", None, None), ("6", '7"8"9', "t")]
    for size in (7, 1 << 20):
        small_splits(size)
        df = source.read_csv(spark, str(tmp_path / "f.csv"), infer_types=False, with_order=True)
        assert [tuple(x[:3]) for x in df.orderBy(*source.ORDER_COLUMNS).collect()] == want


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    text = "a,b\n1,\"" + "line\n" * 400 + "\"\n2,x\n"
    (tmp_path / "f.csv").write_text(text)
    small_splits(64)
    df = source.read_csv(spark, str(tmp_path / "f.csv"))
    assert [tuple(x) for x in df.orderBy("a").collect()] == [(1, "line\n" * 400), (2, "x")]
    for other in (32, 100, 128, 1 << 20):      # the states found hold for the splits they were found on
        small_splits(other)
        with pytest.raises(Exception, match="split otherwise"):
            df.collect()


def test_one_quote_state_for_each_line():
    for line, outside, inside in [("a,b", False, True), ('a,"b', True, False), ('b",c', False, False), ('b","c', True, True),
                                  ('"a""', True, False), ('x"y', False, False), ('""', False, True), ('"a" "b', False, False),
                                  ("", False, True), ('"",w","v ""', True, True)]:
        assert source._ends_inside(line) == outside, line
        assert source._stays_inside(line) == inside, line
