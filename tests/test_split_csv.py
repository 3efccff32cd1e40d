"""CSV with quoted newlines over many splits, against Python's reader and Spark's own."""

import csv
import io
import os
import random

import pytest

from washframe.sources import files
from washframe.sources.split_csv import LineStates, states_before

CELLS = ["a", "", "x y", 'say ""hi""', "two\nlines", "\n", "\r\nline", ",", "ünï", '""', "5' 6", "\n\n\nmany\nlines\n\n", "end,"]


def write(path, rows, end="\n"):
    """Cells are written as given, quoted when they hold what needs quotes."""
    with open(path, "w", encoding="utf-8", newline="") as f:
        for row in rows:
            f.write(",".join('"%s"' % c if any(x in c for x in '",\n\r') else c for c in row) + end)


def expected(path):
    with open(path, encoding="utf-8", newline="") as f:
        return [tuple(c or None for c in r) for r in list(csv.reader(io.StringIO(f.read(), newline="")))[1:] if r]


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_splits_equal_the_whole_file(spark, small_splits, tmp_path, end):
    rnd = random.Random(7)
    want = []
    for name, n in (("a.csv", 300), ("b.csv", 1), ("c d.csv", 150), ("e.csv", 0)):
        rows = [[f"{name}{i}", *rnd.choices(CELLS, k=2)] for i in range(n)]
        if name == "c d.csv":       # a record longer than several splits
            rows[70][1] = "long\n" * 800
        path = os.path.join(tmp_path, name)
        write(path, [["id", "p", "q"], *rows], end)
        want += expected(path)
    got = files.read_csv(spark, str(tmp_path), na_tokens=[], detect=False, position="row_no")
    assert got.columns == ["id", "p", "q", "row_no"]
    assert got.rdd.getNumPartitions() > 10
    rows = sorted(got.collect(), key=lambda r: r.row_no)
    assert [r.row_no for r in rows] == list(range(len(want)))
    assert [tuple(r)[:3] for r in rows] == want
    if end == "\n":      # Spark's reader makes a newline of the other end inside cells
        one = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path))
        assert sorted(map(str, one.collect())) == sorted(map(str, got.drop("row_no").collect()))


def test_quotes_inside_plain_cells_and_empty_lines(spark, small_splits, tmp_path):
    path = os.path.join(tmp_path, "x.csv")
    with open(path, "w", newline="") as f:
        f.write('\nk,v\n\n1,5" pipe\n2,"a\n\nb"\n' + "".join(f'{i},"6"" {i}"\n\n' for i in range(3, 200)) + "200,last")
    got = {r.k: r.v for r in files.read_csv(spark, path).collect()}
    assert got == {1: '5" pipe', 2: "a\n\nb", **{i: f'6" {i}' for i in range(3, 200)}, 200: "last"}


def test_other_separators_schema_and_empty_files(spark, tmp_path):
    path = os.path.join(tmp_path, "x.csv")
    with open(path, "w", newline="") as f:
        f.write("k;v\n1;'a;b\nc'\n2;'it''s'\n")
    got = files.read_csv(spark, path, sep=";", quote="'", escape="'", multi_line=True, position=None)
    assert got.count() == 2       # another escape: Spark's reader
    got = files.read_csv(spark, path, sep=";", quote="'", schema=got.schema)
    assert got.where("k = 1").first().v == "a;b\nc"
    with pytest.raises(ValueError):
        files.read_csv(spark, path, sep=";", position="k")
    with pytest.raises(ValueError):
        files.read_csv(spark, path, position="n", comment="#")
    empty = os.path.join(tmp_path, "only_header.csv")
    with open(empty, "w") as f:
        f.write("k,v\n")
    assert files.read_csv(spark, empty, position="n").columns == ["k", "v", "n"]
    assert files.read_csv(spark, empty).count() == 0


def test_states_follow_a_character_machine():
    import pyarrow as pa
    rnd, rule = random.Random(3), LineStates(",", '"')

    def machine(line, inside):
        state = "in" if inside else "start"
        i = 0
        while i < len(line):
            c = line[i]
            if state == "start":
                state = "in" if c == '"' else "start" if c == "," else "plain"
            elif state == "plain":
                state = "start" if c == "," else "plain"
            elif state == "in":
                if c == '"':
                    if line[i + 1:i + 2] == '"':
                        i += 1
                    else:
                        state = "plain"
            i += 1
        return int(state == "in")

    lines = ["".join(rnd.choices('a",', weights=[3, 2, 2], k=rnd.randrange(12))) for _ in range(4000)]
    maps = rule.maps(pa.array(lines))
    for k, line in enumerate(lines):
        for s in (0, 1):
            assert maps[s, k] == machine(line, s), (line, s)
    for s in (0, 1):
        state, want = s, [s]
        for line in lines:
            state = machine(line, state)
            want.append(state)
        assert states_before(maps, s).tolist() == want
