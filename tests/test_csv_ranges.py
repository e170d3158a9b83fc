"""CSV read in ranges against Spark's one-task reader and Python's; inferred types; positions."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from sectorscope.sources import csv_ranges, files, positions


@pytest.fixture()
def small_ranges(spark):
    """Ranges of 150 bytes, so that cells, records and files cross them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("150", "40")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def _write(folder, name, header, rows, end="\n"):
    with open(f"{folder}/{name}", "w", newline="") as h:
        w = csv.writer(h, lineterminator=end)
        w.writerow(header)
        w.writerows(rows)


def test_line_states():
    rng = random.Random(2)
    for _ in range(400):
        cells = ["".join(rng.choice('ab",\n') for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 4))]
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(cells)
        inside = False
        for line in out.getvalue().split("\n"):
            assert inside or line is not None
            inside = csv_ranges.ends_inside(line, inside)
        assert not inside
    assert not csv_ranges.ends_inside('5" pipe,x', False)  # a quote inside an unquoted cell is a character
    assert csv_ranges.ends_inside('a,"b', False) and csv_ranges.ends_inside("", True)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_ranges_equal_one_task(spark, tmp_path, small_ranges, end):
    rng = random.Random(7)

    def cell():
        return "".join(rng.choice(["a", "bc", " ", "\n", '"', ",", "é", "x" * 60, "\n\n"]) for _ in range(rng.randrange(7)))

    heads = {"a.csv": ["id", "x", "y"], "b.csv": ["y", "id", "x"], "c.csv": ["id", "x"]}
    want = []
    for name, head in heads.items():
        rows = [[f"{name}{i}" if c == "id" else cell() for c in head] for i in range(60)]
        _write(tmp_path, name, head, rows, end)
        for r in rows:
            named = dict(zip(head, r))
            want.append(tuple(None if named.get(c) in (None, *files.NULL_TOKENS) else named[c] for c in ("id", "x", "y")))
    open(tmp_path / "empty.csv", "w").close()
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = files.scan(spark, str(tmp_path), "csv").select("id", "x", "y")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    placed = positions.scan_with_position(spark, str(tmp_path), "csv").select("_position", "id").collect()
    assert [r["id"] for r in sorted(placed)] == [w[0] for w in want] and sorted(r[0] for r in placed) == list(range(180))


def test_odd_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n\nx,x,,x.1\r\n1,2,3,4,5\n\n6\n"7 ""q""",,"",\n', newline="")
    got = files.scan(spark, str(tmp_path), "csv")
    assert got.columns == ["x", "x.2", "Unnamed: 2", "x.1"]
    assert sorted(map(tuple, got.collect()), key=str) == [("1", "2", "3", "4"), ("6", None, None, None), ('7 "q"', None, None, None)]
    named = files.scan(spark, str(tmp_path), "csv", columns=["a", "b"])
    assert named.columns == ["a", "b"] and named.count() == 3
    single = files.scan(spark, str(tmp_path), "csv", multi_line=False)
    assert single.count() == 3
    (tmp_path / "a.csv").write_text("")
    with pytest.raises(ValueError):
        files.scan(spark, str(tmp_path), "csv")


def test_inferred_types(spark):
    rows = [("1", "1", "1.5", "True", "x", None, "9" * 19, "1e3", "01"), (None, "2.", "-3", "false", "1", None, "1", ".5", "+2"),
            ("-7", None, None, None, "2", None, "2", "3", "3")]
    names = ["whole", "number", "number2", "truth", "text", "nothing", "huge", "number3", "whole2"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).withColumn("kept", F.lit(3))
    out = files.infer_types(df)
    assert dict(out.dtypes) == {"whole": "bigint", "number": "double", "number2": "double", "truth": "boolean", "text": "string",
                                "nothing": "string", "huge": "double", "number3": "double", "whole2": "bigint", "kept": "int"}
    assert out.columns == df.columns and out.where("whole = -7 and whole2 = 3").count() == 1
    assert files.infer_types(df.limit(0)).dtypes[0] == ("whole", "string")
