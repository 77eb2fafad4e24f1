"""CSV files with quoted line breaks, read by byte ranges.

Whether a line break ends a record depends on how many quotes stand before it in the file: with an even number it does, with
an odd one it lies inside a quoted field. Doubled quotes count twice and change nothing. So

1. one scan counts the quotes of every byte range (a range holds whole lines; Spark splits the files),
2. a running sum over the ranges of each file (one row a range) tells which ranges begin inside a quoted field,
3. a second scan joins lines to records, every range on its own. Only a record that crosses a range comes in fragments, which
   are put together by file and place; no other row is shuffled.

The first scan also tells which files are UTF-8: lines hold whole code points, so a file of any size is checked line by line, on many
tasks, and one decision holds for the whole file. Others are read as a one-byte Western encoding.

Files must quote as RFC 4180 says: quotes only around whole fields, doubled inside them. A file with an odd number of quotes
is refused. Line ends are LF or CRLF.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from starloom.functions.text import windows_1252
from starloom.session import cut_lineage

WHOLE, HEAD, TAIL = 0, 1, 2  # a record; the end of one begun in an earlier range; the beginning of one that goes on
FOUND = "file string, start bigint, kind int, first boolean, record string"


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, start of the byte range, line); lines keep a trailing carriage return."""
    raw = spark.read.option("lineSep", "\n").text(paths)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def range_parities(lines: DataFrame) -> DataFrame:
    """(file, start, odd, odd_end, utf8): does the byte range begin, and does it end, inside a quoted field? Is the whole file UTF-8?"""
    quotes = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit('"'), F.lit("")))
    ranges = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"), F.bool_and(F.is_valid_utf8("line")).alias("utf8"))
    own = Window.partitionBy("file")
    upto = F.sum("quotes").over(own.orderBy("start"))
    odd, odd_end = (upto - F.col("quotes")) % 2 == 1, upto % 2 == 1
    return ranges.select("file", "start", odd.alias("odd"), odd_end.alias("odd_end"), F.min("utf8").over(own).alias("utf8"))


def decoded(line: Column, utf8: Column, windows: bool = True) -> Column:
    """Text of a line's bytes."""
    western = F.decode(line.cast("binary"), "ISO-8859-1")
    return F.when(utf8, line).otherwise(windows_1252(western) if windows else western)


def decoded_lines(spark: SparkSession, paths: str | list[str], windows: bool = True) -> DataFrame:
    """(file, line) of text files of any size: UTF-8 where a whole file is valid UTF-8, else a one-byte Western encoding."""
    lines = _lines(spark, paths)
    files = cut_lineage(lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("line")).alias("utf8")))
    known = lines.join(files, "file")
    return known.select("file", F.regexp_replace(decoded(F.col("line"), F.col("utf8"), windows), "\r$", "").alias("line"))


def _joined(lines: pa.Array, starts: np.ndarray) -> pa.Array:
    """Lines from each start to the next joined by line feeds."""
    if len(starts) == len(lines):
        return lines
    groups = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(lines)], pa.int32()), lines)
    return pc.binary_join(groups, "\n")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and fragments of the byte ranges of a task, whose lines come in order."""
    place, inside, held, begun = None, False, [], False  # held: lines of the record that is open; begun: it starts in this range
    fresh = False  # the file's first record is still to come

    def out(kind: int, records: pa.Array) -> Iterator[pa.RecordBatch]:
        nonlocal fresh
        if kind == WHOLE:  # blank lines are no records
            records = records.filter(pc.invert(pc.is_in(records, pa.array(["", "\r"]))))
        n = len(records)
        if n:
            first = [fresh and kind != HEAD] + [False] * (n - 1)
            fresh = fresh and kind == HEAD
            columns = [pa.array([place[0]] * n, pa.string()), pa.array([place[1]] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(first), records]
            yield pa.RecordBatch.from_arrays(columns, ["file", "start", "kind", "first", "record"])

    def closed() -> Iterator[pa.RecordBatch]:
        """The last record of a range, whole, begun or continued."""
        if held:
            kind = (TAIL if inside else WHOLE) if begun else HEAD
            yield from out(kind, pa.array(["\n".join(held)], pa.string()))

    for batch in batches:
        files, ranges = batch.column(0), batch.column(1).to_numpy()
        changes = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]] | np.r_[True, pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)]) if len(ranges) else []
        for first, last in zip(changes, [*changes[1:], len(ranges)], strict=True):
            here = (files[int(first)].as_py(), int(ranges[first]))
            if here != place:
                yield from closed()
                place, held = here, []
                odd = batch.column(3)[int(first)].as_py()
                if odd is None:
                    raise RuntimeError("byte ranges changed between two scans: fix spark.sql.files.minPartitionNum")
                inside, begun, fresh = odd, not odd, here[1] == 0
            lines = batch.column(2).slice(first, last - first)
            quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
            after = (np.cumsum(quotes) + inside) % 2 == 1
            before = np.r_[inside, after[:-1]]
            starts = np.flatnonzero(~before)
            inside = bool(after[-1])
            if not len(starts):
                held += lines.to_pylist()
                continue
            head = held + lines[: int(starts[0])].to_pylist()
            if head:
                yield from out(WHOLE if begun else HEAD, pa.array(["\n".join(head)], pa.string()))
            begun = True
            held = lines[int(starts[-1]) :].to_pylist()
            whole = _joined(lines.slice(starts[0], starts[-1] - starts[0]), starts[:-1] - starts[0])
            yield from out(WHOLE, whole)
    yield from closed()


def csv_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, first, record): the text of every record of CSV files; ``first`` marks each file's first one, its header."""
    return _records_of(spark, paths)[0]


def _records_of(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, bool]:
    """The records, and whether all files are UTF-8."""
    lines = _lines(spark, paths)
    parities = cut_lineage(range_parities(lines))
    last = parities.groupBy("file").agg(F.max_by("odd_end", "start").alias("open")).where("open").head()
    if last:
        raise ValueError(f"odd number of quotes in {last['file']}: read it as a whole file")
    # one row for each byte range of spark.sql.files.maxPartitionBytes: about a millionth of the files' size
    known = lines.join(F.broadcast(parities.select("file", "start", "odd", "utf8")), ["file", "start"], "left")
    line = decoded(F.col("line"), F.col("utf8")).alias("line")
    found = known.select("file", "start", line, "odd").mapInArrow(_records, FOUND)
    record = F.regexp_replace("record", "\r$", "").alias("record")
    whole = found.where(F.col("kind") == WHOLE).select("file", "first", record)
    marks = parities.agg(F.bool_or("odd").alias("odd"), F.bool_and("utf8").alias("utf8")).first()
    if not marks["odd"]:
        return whole, marks["utf8"] is not False
    pieces = found.where(F.col("kind") != WHOLE)
    number = F.count_if(F.col("kind") == TAIL).over(Window.partitionBy("file").orderBy("start", "kind"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("start", "kind", "record"))), lambda p: p["record"])
    crossing = pieces.withColumn("number", number).groupBy("file", "number").agg(F.bool_or("first").alias("first"), F.array_join(texts, "\n").alias("record"))
    return whole.unionByName(crossing.select("file", "first", F.regexp_replace("record", "\r$", "").alias("record"))), marks["utf8"] is not False


def read_quoted_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of CSV files with a header row (text columns named by the first file's header), and ``_file``, their file."""
    options = {"escape": '"', "multiLine": "true"}
    records, utf8 = _records_of(spark, paths)
    if utf8:
        names = spark.read.options(**options, header="true").csv(paths).columns
    else:  # Spark would read the header's bytes as UTF-8
        header = records.where("first").orderBy("file").head()
        names = next(csv.reader(io.StringIO(header["record"], newline="")))
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    parsed = records.where("not first").select(F.col("file").alias("_file"), F.from_csv("record", schema, options).alias("_row"))
    return parsed.select(*[F.col("_row").getField(name).alias(name) for name in names], "_file")
