"""CSV read in splits although quoted fields may hold line ends.

Whether a line end ends a record depends on every quote before it.  The text source cuts large files into byte
ranges and gives each line to the range it starts in.  A first pass finds, for each range, what it does to the
state at its start, *outside* or *inside* a quoted field: the state at its end, and whether a record ends in it, for
both.  These maps, one short row a range, are composed in file order, which gives every range its true entry state.
The second pass cuts records in all ranges at once.  The piece of a record at the end of a range, and those in
the ranges after it, are put together by the range where the record began; no other row is shuffled.

Dialect: that of ``csv_sink``.  Fields are separated by commas; a quote opens a quoted field only as a field's
first character and is doubled inside; what follows a closing quote, up to the comma, belongs to the field; a
quote inside an unquoted field is an ordinary character.  Records end at LF or CR LF outside quoted fields; empty
ones are skipped.  Every file begins with a header record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Matches a line that begins outside quotes and ends inside a quoted field.  Possessive, so it never backtracks.
_ENDS_INSIDE = re.compile(r'(?s)(?:"(?:[^"]|"")*+"[^,]*+,|(?!")[^,]*+,)*+"(?:[^"]|"")*+\Z')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line, given whether one is at its start."""
    return _ENDS_INSIDE.match('"' + line if inside else line) is not None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, bool]]:
    """Runs of lines of one range (file, start, lines, whether the range begins here), in order."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column(1).to_numpy()
        files = batch.column(0).dictionary_encode()
        change = np.flatnonzero((np.diff(at) != 0) | (np.diff(files.indices.to_numpy()) != 0)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            key = (files[a].as_py(), int(at[a]))
            yield *key, batch.column(2).slice(a, b - a), key != last
            last = key


def _quoted(lines: pa.Array) -> np.ndarray:
    """Places of the lines that hold a quote: only these can change the state."""
    return np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))


def range_maps(lines: DataFrame) -> DataFrame:
    """(file, at, end_outside, end_inside, ended_outside, ended_inside) of every range: for a start outside or inside a
    quoted field, whether one is open at the end and whether a record ends in the range."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        for file, at, values, new in _ranges(batches):
            if new:
                rows.append([file, at, False, True, False, False])
            row, done = rows[-1], 0
            for i in _quoted(values).tolist():
                line = values[i].as_py()
                for entry in (0, 1):
                    if i > done and not row[2 + entry]:
                        row[4 + entry] = True
                    row[2 + entry] = ends_inside(line, row[2 + entry])
                    row[4 + entry] |= not row[2 + entry]
                done = i + 1
            for entry in (0, 1):
                row[4 + entry] |= len(values) > done and not row[2 + entry]
        columns = list(zip(*rows)) or [()] * 6
        kinds = [pa.string(), pa.int64(), *[pa.bool_()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "at", "end_outside", "end_inside", "ended_outside", "ended_inside"])

    return lines.mapInArrow(scan, "file string, at long, end_outside boolean, end_inside boolean, ended_outside boolean, ended_inside boolean")


def entered_inside(maps: DataFrame) -> DataFrame:
    """(file, at, owner) of the ranges that begin inside a record: ``owner`` is the range where that record began.

    The maps of a file's ranges are composed in order; a row stands for a whole range of the file.
    """

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        inside, owner, found = False, -1, []
        for r in rows.sort_values("at").itertuples():
            if inside:
                found.append((r.file, r.at, owner))
            ended = r.ended_inside if inside else r.ended_outside
            if ended or not inside:
                owner = r.at
            inside = r.end_inside if inside else r.end_outside
        return pd.DataFrame(found, columns=["file", "at", "owner"])

    return maps.groupBy("file").applyInPandas(compose, "file string, at long, owner long")


def _cut(lines: DataFrame, owners: dict[tuple[str, int], int]) -> DataFrame:
    """(file, owner, at, nth, header, record): whole records (owner null) and pieces of records that cross ranges."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, inside, first, nth = None, [], False, False, 0

        def rest():
            """What is left of a range at its end: the first piece of a record, or one that the range lies inside."""
            if key and open_:
                owner = owners[key] if nth == 0 and key in owners else key[1]
                yield _rows(*key, [owner], [nth], [first and owner == key[1]], ["\n".join(open_)])

        for file, at, values, new in _ranges(batches):
            if new:
                yield from rest()
                key, open_, nth = (file, at), [], 0
                inside, first = key in owners, at == 0
            done, whole = 0, []
            for i in [*_quoted(values).tolist(), len(values)]:
                if i > done:  # lines without a quote
                    plain = values.slice(done, i - done).to_pylist()
                    if inside:
                        open_ += plain
                    else:
                        whole += plain
                if i == len(values):
                    break
                line = values[i].as_py()
                inside = ends_inside(line, inside)
                open_.append(line)
                if not inside:
                    if nth == 0 and not whole and key in owners:  # the end of a record that began before
                        yield _rows(file, at, [owners[key]], [0], [False], ["\n".join(open_)])
                        nth = 1
                    else:
                        whole.append("\n".join(open_))
                    open_ = []
                done = i + 1
            whole = [w for w in whole if w not in ("", "\r")]
            if whole:
                yield _rows(file, at, [None] * len(whole), list(range(nth, nth + len(whole))), [first, *[False] * (len(whole) - 1)], whole)
                first = False
                nth += len(whole)
        yield from rest()

    return lines.mapInArrow(cut, "file string, owner long, at long, nth long, header boolean, record string")


def _rows(file: str, at: int, owner: list, nth: list, header: list, record: list) -> pa.RecordBatch:
    n = len(record)
    columns = [pa.array([file] * n, pa.string()), pa.array(owner, pa.int64()), pa.array([at] * n, pa.int64()), pa.array(nth, pa.int64()), pa.array(header, pa.bool_()), pa.array(record, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["file", "owner", "at", "nth", "header", "record"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, record) of every record of the CSV files at ``path``, as text without its line end."""
    lines = _lines(spark, path)
    owners = {(r["file"], r["at"]): r["owner"] for r in entered_inside(range_maps(lines)).collect()}  # a row per range at most
    cut = _cut(lines, owners)
    whole = cut.where("owner IS NULL").select("file", "header", "record")
    if owners:
        pieces = cut.where("owner IS NOT NULL").groupBy("file", "owner").agg(
            F.array_sort(F.collect_list(F.struct("at", "record"))).alias("p"), F.max("header").alias("header")  # the pieces of one record
        )
        whole = whole.unionByName(pieces.select("file", "header", F.array_join("p.record", "\n").alias("record")))
    else:
        whole = cut.select("file", "header", "record")
    return whole.withColumn("record", F.regexp_replace("record", "\r$", ""))
