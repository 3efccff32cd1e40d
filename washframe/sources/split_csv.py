"""CSV files with quoted newlines, read by many tasks a file, with row positions.

Spark's text source cuts files into splits at line ends; whether a split starts inside
a quoted cell is not known there. Two passes over the lines settle it:

1. every split is read under both assumptions. A line maps the state before it (in a
   quoted cell or not) to the state after it, so a split is such a map as well, with
   the number of records that start in it under each assumption. One small row a split;
2. a running composition over the splits of a file gives each its true start (and the
   number of records before it: positions), 25 bytes a split that every task gets.
   Each split then cuts its lines into records without a shuffle. Only records that
   span splits are put together by a shuffle, and only if a split ends inside a cell.

A quote opens a cell only at its start, as for Spark's parser; a doubled quote is a
quote. The records are parsed by ``from_csv``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washframe.session import ship_code

# Options that do not change where records end.
PLAIN_OPTIONS = {"sep", "delimiter", "quote", "nullValue", "nanValue", "emptyValue",
                 "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace"}


def can_split(options: dict) -> bool:
    """Whether the reader options leave records to quotes and line ends alone."""
    lower = {k.lower(): v for k, v in options.items()}
    if not set(lower) <= {k.lower() for k in PLAIN_OPTIONS}:
        return False
    return all(isinstance(v, str) and len(v) == 1 and v not in "\r\n"
               for k, v in lower.items() if k in ("sep", "delimiter", "quote"))


class LineStates:
    """How lines change the state 'inside a quoted cell', by patterns in linear time."""

    def __init__(self, sep: str, quote: str):
        s, q = (rf"\x{{{ord(c):x}}}" for c in (sep, quote))
        inside = f"(?:[^{q}]|{q}{q})*"
        plain = f"(?:[^{q}{s}][^{s}]*)?"      # a cell without quotes, or what follows a closing one
        cells = f"(?:(?:{q}{inside}{q})?{plain}{s})*"
        self.quote = quote
        self.opens = f"(?s)^{cells}{q}{inside}$"                        # outside -> inside
        self.stays = f"(?s)^{inside}(?:{q}{plain}{s}{cells}{q}{inside})?$"    # inside -> inside

    def maps(self, lines) -> np.ndarray:
        """(2, lines): the state after each line if it starts outside / inside."""
        import pyarrow as pa
        import pyarrow.compute as pc
        out = np.zeros((2, len(lines)), dtype=np.int8)
        out[1] = 1
        quoted = np.flatnonzero(pc.match_substring(lines, self.quote).to_numpy(zero_copy_only=False))
        if len(quoted):
            some = lines.take(pa.array(quoted))
            for k, pattern in enumerate((self.opens, self.stays)):
                out[k, quoted] = pc.match_substring_regex(some, pattern).to_numpy(zero_copy_only=False)
        return out


def states_before(maps: np.ndarray, start: int) -> np.ndarray:
    """The state before each line and, last, after all: the last line whose result does
    not depend on its start, and the lines since that swap the state, decide it."""
    n = maps.shape[1]
    fixed, swaps = maps[0] == maps[1], maps[0] > maps[1]
    last = np.maximum.accumulate(np.where(fixed, np.arange(n), -1)) if n else np.zeros(0, int)
    base = np.where(last >= 0, maps[0][last], start)
    turned = np.cumsum(swaps)
    since = turned - np.where(last >= 0, turned[last], 0)
    return np.concatenate([[start], base ^ (since & 1)]).astype(np.int8)


def _empty(lines) -> np.ndarray:
    import pyarrow as pa
    import pyarrow.compute as pc
    return pc.is_in(lines, value_set=pa.array(["", "\r"])).to_numpy(zero_copy_only=False)


def _runs(batch):
    """Parts of a batch of one split each: (lines, file, start)."""
    files, starts = (batch.column(k).to_numpy() for k in (1, 2))
    cuts = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(files)]):
        if hi > lo:
            yield batch.column(0).slice(lo, hi - lo), int(files[lo]), int(starts[lo])


def _scan(sep: str, quote: str):
    """Per split: the end state and the records started, under both assumptions."""
    def run(batches):
        import pyarrow as pa
        rule, here, ends, counts = LineStates(sep, quote), None, [0, 1], [0, 0]

        def row():
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (*here, ends[0], counts[0], ends[1], counts[1])],
                                              names=["file", "start", "end0", "n0", "end1", "n1"])

        for batch in batches:
            for lines, *split in _runs(batch):
                if split != here:
                    if here is not None:
                        yield row()
                    here, ends, counts = split, [0, 1], [0, 0]
                maps, full = rule.maps(lines), ~_empty(lines)
                for k in (0, 1):
                    before = states_before(maps, ends[k])
                    ends[k] = int(before[-1])
                    counts[k] += int(((before[:-1] == 0) & full).sum())
        if here is not None:
            yield row()
    return run


def _records(sep: str, quote: str, known, fragments: bool):
    """(position, value, start) of whole records, or (``fragments``) of the parts of records
    that span splits. A file's first record is left out."""
    keys, begins, offsets, bases = known

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        rule, here, state, done, base = LineStates(sep, quote), None, 0, 0, 0
        held, whole = None, True    # (number, lines) of a record that has not ended, and whether it starts here

        def out(texts, numbers):
            texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
            got = pa.RecordBatch.from_arrays(
                [pa.array(base - 1 + np.asarray(numbers), pa.int64()), texts, pa.array([here[1]] * len(texts), pa.int64())],
                names=["position", "value", "start"])
            return got.slice(1) if numbers[0] == 0 else got

        for batch in batches:
            for lines, *split in _runs(batch):
                if split != here:
                    if held is not None and fragments:
                        yield out(["\n".join(held[1])], [held[0]])
                    here, key = split, split_key(*split)
                    at = int(np.searchsorted(keys, key))
                    if at == len(keys) or keys[at] != key:
                        raise RuntimeError("the splits of the CSV files changed since they were scanned; read them "
                                           "again (spark.sql.files.minPartitionNum keeps them when executors come and go)")
                    state, done, base = int(begins[at]), int(offsets[at]), int(bases[at])
                    held, whole = ((done - 1, []), False) if state else (None, True)
                maps, full = rule.maps(lines), ~_empty(lines)
                before = states_before(maps, state)
                state = int(before[-1])
                outside = np.flatnonzero(before[1:] == 0)       # lines after which no cell is open
                if held is not None:
                    take = int(outside[0]) + 1 if len(outside) else len(lines)
                    held[1].extend(lines.slice(0, take).to_pylist())
                    if len(outside):
                        if whole != fragments:
                            yield out(["\n".join(held[1])], [held[0]])
                        held, whole = None, True
                begin = np.flatnonzero((before[:-1] == 0) & full)
                if not len(begin):
                    continue
                numbers = done + np.arange(len(begin))
                done += len(begin)
                if state:           # the last one goes on
                    held = (int(numbers[-1]), lines.slice(int(begin[-1])).to_pylist())
                    begin, numbers = begin[:-1], numbers[:-1]
                if fragments or not len(begin):
                    continue
                ends = outside[np.searchsorted(outside, begin)] + 1
                if (ends - begin == 1).all():
                    texts = lines.take(pa.array(begin))
                else:
                    sizes = ends - begin
                    firsts = np.concatenate([[0], np.cumsum(sizes)])
                    places = np.arange(firsts[-1]) + np.repeat(begin - firsts[:-1], sizes)
                    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), lines.take(pa.array(places))),
                                           "\n")
                yield out(texts, numbers)
        if held is not None and fragments:
            yield out(["\n".join(held[1])], [held[0]])
    return run


def split_key(file: int, start: int) -> int:
    """One number for a split (the file is a 64-bit hash of its path)."""
    return ((file ^ (start * 0x9E3779B97F4A7C15)) + (1 << 63)) % (1 << 64) - (1 << 63)


def read_records(spark: SparkSession, path, sep: str = ",", quote: str = '"') -> DataFrame:
    """(position, value): every record of the files but each file's first (the header), in
    its raw text, and its place 0, 1, ... over all files in the order of their paths.

    Empty lines are no records; lines end with a newline or a carriage return and a
    newline. A quote that is never closed makes the rest of its file one record."""
    ship_code(spark)
    split = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.option("lineSep", "\n").text(path).select("value", *split)
    files = spark.read.format("binaryFile").load(path).select("_metadata.file_path", split[0])     # a listing
    seen = lines.mapInArrow(_scan(sep, quote), "file long, start long, end0 long, n0 long, end1 long, n1 long")
    table = seen.join(files, "file").orderBy("file_path", "start").drop("file_path").toPandas()
    rows, open_ends = [], False     # (key, state, records of the file before, records of earlier files)
    file, state, count, total = None, 0, 0, 0
    for row in table.itertuples(index=False):
        open_ends |= bool(state)
        if row.file != file:
            total += max(count - 1, 0)
            file, state, count = row.file, 0, 0
        rows.append((split_key(row.file, row.start), state, count, total))
        state, n = (row.end1, row.n1) if state else (row.end0, row.n0)
        count += n
    open_ends |= bool(state)
    known = [np.array(c, dtype=t) for c, t in zip(zip(*sorted(rows)), ("i8", "i1", "i8", "i8"))] or [np.zeros(0, "i8")] * 4
    schema = "position long, value string, start long"
    found = lines.mapInArrow(_records(sep, quote, known, False), schema).drop("start")
    if open_ends:
        pieces = lines.mapInArrow(_records(sep, quote, known, True), schema)
        joined = pieces.groupBy("position").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("p"))
        found = found.unionByName(joined.select("position", F.expr("array_join(transform(p, x -> x.value), '\n')").alias("value")))
    return found.select("position", F.regexp_replace("value", "\r$", "").alias("value"))
