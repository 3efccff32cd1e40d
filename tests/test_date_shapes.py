"""Dates by cell shapes: no parser sees a cell that its shape excludes, and no cell
that a parser accepts is kept from it."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from washframe.operators import coerce
from washframe.report import StepLog


def dates(spark, cells, name="some_date"):
    return spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"id long, {name} string")


def parsed(frame, name="some_date"):
    return [r[name] for r in frame.orderBy("id").collect()]


@pytest.fixture(scope="module")
def messy(spark):
    rng, cells = random.Random(4), []
    for _ in range(600):
        d = dt.datetime(rng.randint(1900, 2099), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59))
        cells += [d.strftime(rng.choice(["%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d.%m.%Y", "%Y/%m/%d", "%b %d, %Y", "%d %b %Y",
                                         "%m/%d/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%d.%m.%Y %H:%M:%S", "%Y-%m-%d"]))]
    for c in cells[:300]:
        at = rng.randrange(len(c))
        cells.append(c[:at] + rng.choice("0123456789/-.: xA") + c[at + rng.randint(0, 1):])
    return dates(spark, cells + ["007/1/2020", "1/1/12020", "2/30/2020", "", " ", "13/13/2020", "Sept. 3, 2020"])


@pytest.mark.parametrize("fmt", coerce.DATE_FORMATS)
def test_shape_keeps_all_that_parses(messy, fmt):
    plain = F.try_to_timestamp("some_date", F.lit(fmt)).isNotNull().alias("plain")
    ours = coerce._parse_one(F.col("some_date"), fmt).isNotNull().alias("ours")
    assert messy.select("some_date", plain, ours).where("plain <> ours").collect() == []
    shape = re.compile(coerce.cell_shape(fmt).replace(r"\p{L}", "[A-Za-z]"))
    for r in messy.select("some_date", plain).where("plain").collect():
        assert shape.search(r.some_date)


@pytest.mark.parametrize("fmt", coerce.DATE_FORMATS)
def test_parsers_run_behind_a_shape(messy, fmt):
    """In the plan, the parser stands in a CASE branch behind the shape's match."""
    plan = messy.select(coerce._parse_one(F.col("some_date"), fmt).alias("x"))._jdf.queryExecution().analyzed().toString()
    line = next(x for x in plan.splitlines() if "to_" in x.lower() and "CASE WHEN" in x)
    assert "RLIKE" in line and line.index("RLIKE") < line.lower().index("to_")


def test_mixed_formats_are_all_kept(spark):
    log = StepLog()
    got = coerce.parse_dates(dates(spark, ["13/02/2020", "03/14/2020", "2020-01-05", None]), log=log)
    assert parsed(got) == [dt.datetime(2020, 2, 13), dt.datetime(2020, 3, 14), dt.datetime(2020, 1, 5), None]
    assert "month-first by a tie" in str(log.to_frame(spark).collect())


def test_bare_numbers_are_no_dates(spark):
    got = coerce.parse_dates(dates(spark, ["5", "x7", "2020"], "runtime"))
    assert parsed(got, "runtime") == ["5", "x7", "2020"]


def test_least_share(spark):
    cells = ["1/2/2020", "a", "b", "c"]
    assert parsed(coerce.parse_dates(dates(spark, cells))) == cells
    few = coerce.parse_dates(dates(spark, cells), min_share=0.25)
    assert parsed(few) == [dt.datetime(2020, 1, 2), None, None, None]


def test_detection_looks_behind_the_first_character(spark):
    rows = [(" 1", "\t2.5", "TRUE", "Infinity", "x1", "+3"), ("-2", "nan", "false", "1", "1", "4 ")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    assert coerce.detect_types(df) == {"a": "long", "b": "double", "c": "boolean", "d": "double", "e": "string", "f": "long"}
