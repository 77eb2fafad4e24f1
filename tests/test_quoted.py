"""CSV by byte ranges against Spark's whole-file reader and Python's csv module."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from starloom.sources import quoted, readers

PARTS = ["plain", "", "a,b", 'say "hi"', "two\nlines", "three\n\nlines\n", '"\n"', "\n", " spaced ", "é\n日本", 'x"y', '""', "\r\n", ",\n,", "end\n"]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def written(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few bytes, so records begin, end and go on at every place."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    for key, value in old.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("size", [7, 16, 61, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_of_any_size_give_the_rows_of_the_whole_file(spark, tmp_path, small_ranges, size, end):
    rng = random.Random(size)
    rows = [[str(k), *(rng.choice(PARTS) for _ in range(2))] for k in range(40)]
    (tmp_path / "a.csv").write_bytes(written([["key", "left side", "right\nside"], *rows], end).encode())
    small_ranges(size)
    got = readers.read_csv_strings(spark, f"{tmp_path}/a.csv")
    assert got.columns == ["key", "left side", "right\nside"]
    assert rows_of(got) == sorted(map(tuple, rows))
    if end == "\n":  # with a line feed in the header Spark's reader takes that for the line end and keeps carriage returns
        assert rows_of(got) == rows_of(readers.read_csv_strings(spark, f"{tmp_path}/a.csv", whole_files=True))


def test_a_field_may_span_many_ranges(spark, tmp_path, small_ranges):
    long = "\n".join(f"line {k}" for k in range(300))
    rows = [["1", "before"], ["2", long], ["3", "between"], ["4", long + "\n"], ["5", "after"]]
    (tmp_path / "a.csv").write_text(written([["k", "v"], *rows]))
    small_ranges(64)
    assert spark.read.text(f"{tmp_path}/a.csv").rdd.getNumPartitions() > 50
    assert rows_of(readers.read_csv_strings(spark, f"{tmp_path}/a.csv")) == sorted(map(tuple, rows))


def test_many_files_each_with_a_header(spark, tmp_path, small_ranges):
    want = []
    for f in range(7):
        rows = [[f"{f}-{k}", "x\ny" * (k % 3)] for k in range(f * 3)]
        (tmp_path / f"part{f}.csv").write_text("\n\n" * (f % 2) + written([["k", "v"], *rows]).rstrip("\n" * (f % 2)))
        want += [(*r, f"part{f}") for r in rows]
    small_ranges(50)
    got = readers.read_batch(spark, [str(tmp_path)], "csv").select("k", F.coalesce("v", F.lit("")), "target_table")
    assert rows_of(got) == sorted(want)


def test_short_and_long_rows_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n1\n\n1,2,3,4\n"x"\n,,\n\n')
    both = [rows_of(readers.read_csv_strings(spark, f"{tmp_path}/a.csv", whole_files=whole)) for whole in (True, False)]
    assert both[0] == both[1] == sorted([("1", "", ""), ("1", "2", "3"), ("x", "", ""), ("", "", "")])


def test_odd_quotes_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"open\n2,3\n')
    with pytest.raises(ValueError, match="odd number of quotes"):
        readers.read_csv_strings(spark, f"{tmp_path}/a.csv")
    assert readers.read_csv_strings(spark, f"{tmp_path}/a.csv", whole_files=True).count() == 1


def test_only_a_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n")
    assert readers.read_csv_strings(spark, f"{tmp_path}/a.csv").columns == ["a", "b"]
    assert readers.read_csv_strings(spark, f"{tmp_path}/a.csv").count() == 0


def test_parities_of_ranges(spark):
    lines = spark.createDataFrame([("f", 0, 'a"'), ("f", 0, "b"), ("f", 10, '"c"'), ("f", 20, '"'), ("g", 0, "x")], "file string, start long, line string")
    got = {(r["file"], r["start"]): (r["odd"], r["odd_end"]) for r in quoted.range_parities(lines).collect()}
    assert got == {("f", 0): (False, True), ("f", 10): (True, True), ("f", 20): (True, False), ("g", 0): (False, False)}


@pytest.mark.parametrize("size", [5, 40, 1 << 20])
def test_one_decision_for_a_whole_file(spark, tmp_path, small_ranges, size):
    """Multi-byte characters at every place of the ranges; one bad byte at the end makes the whole file Western."""
    lines = [f"{'é' * (k % 7)}€日{k}" for k in range(60)]
    (tmp_path / "utf8.txt").write_bytes("\n".join(lines).encode())
    western = "\n".join([*["é€ÿ–"] * 30, "plain"]).encode("cp1252")
    (tmp_path / "west.txt").write_bytes(western)
    (tmp_path / "late.txt").write_bytes("\n".join(lines).encode() + b"\n\xe9")
    small_ranges(size)
    got = {}
    for r in quoted.decoded_lines(spark, str(tmp_path)).collect():
        got.setdefault(r["file"].rsplit("/", 1)[-1], []).append(r["line"])
    assert sorted(got["utf8.txt"]) == sorted(lines)
    assert sorted(got["west.txt"]) == sorted(western.decode("cp1252").split("\n"))
    assert len(got["late.txt"]) == 61 and "é" in got["late.txt"] and not set(got["late.txt"]) & set(lines)
    for name in got:
        whole = readers.decode_text_files(spark, f"{tmp_path}/{name}").first()["text"]
        assert sorted(whole.split("\n")) == sorted(got[name])


def test_western_csv_with_an_accented_header(spark, tmp_path, small_ranges):
    rows = [[f"é{k}", "zwei\nZeilen ß"] for k in range(20)]
    (tmp_path / "a.csv").write_bytes(written([["clé", "größe"], *rows]).encode("cp1252"))
    small_ranges(32)
    got = readers.read_csv_strings(spark, f"{tmp_path}/a.csv")
    assert got.columns == ["clé", "größe"] and rows_of(got) == sorted(map(tuple, rows))
