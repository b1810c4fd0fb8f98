import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from fieldstats.sources.readers import read_csv
from fieldstats.sources.records import csv_records, ends_inside

CELLS = ["1", "2.5", "", "plain", "two\nlines", "a\n\n\nb", 'say "hi"', '"', "\n", ",", "x,y\nz", "NA", "é\U0001f642\nü", '""', "long " * 30]


def made(rng, rows):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["id", "a", "b"])
    for k in range(rows):
        writer.writerow([k, rng.choice(CELLS), rng.choice(CELLS)])
        if rng.random() < 0.05:
            out.write("\n")
    return out.getvalue()


def whole_file(spark, path):
    """One task a file, by the built-in reader."""
    return spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def small_parts(spark):
    for key, value in {"spark.sql.files.maxPartitionBytes": "97b", "spark.sql.files.openCostInBytes": "1b"}.items():
        spark.conf.set(key, value)
    yield
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


@pytest.mark.parametrize("seed", range(3))
def test_records_cut_anywhere_equal_the_whole_file(spark, tmp_path, small_parts, seed):
    rng = random.Random(seed)
    for k in range(2):
        (tmp_path / f"{k}.csv").write_text(made(rng, 60))
    path = str(tmp_path)
    got = csv_records(spark, path).select(F.from_csv("record", "id string, a string, b string", {"quote": '"', "escape": '"'}).alias("c")).select("c.*")
    assert got.rdd.getNumPartitions() > 20
    assert found(got) == found(whole_file(spark, path))


def test_stray_quotes_and_an_open_end(spark, tmp_path, small_parts):
    text = 'a,b\n5" pipe,1\n"x"tail,2\nq"uo"te,"3\n4"\n' + "n,5\n" * 40 + 'last,"never closed\nat all\n' + "z\n" * 60
    (tmp_path / "t.csv").write_text(text)
    path = str(tmp_path / "t.csv")
    want = [(a, b.removesuffix("\n")) for a, b in found(whole_file(spark, path))]  # a cell that is never closed ends before the last line break
    got = csv_records(spark, path).select(F.from_csv("record", "a string, b string", {"quote": '"', "escape": '"'}).alias("c")).select("c.*")
    assert found(got) == sorted(want, key=repr)


def test_header_over_several_lines_and_parts(spark, tmp_path, small_parts):
    (tmp_path / "t.csv").write_text('"id\n' + "x" * 200 + '\nrest","note"\n1,"two\nlines"\n2,plain\n')
    rows = read_csv(spark, str(tmp_path / "t.csv"))
    assert rows.columns == ["id\n" + "x" * 200 + "\nrest", "note"]
    assert found(rows) == [(1, "two\nlines"), (2, "plain")]


def test_large_cell_over_many_parts(spark, tmp_path, small_parts):
    cell = "line of a cell\n" * 300
    (tmp_path / "t.csv").write_text(f'id,note\n1,"{cell}"\n2,"after"\n3,"{cell}"\n')
    assert found(read_csv(spark, str(tmp_path / "t.csv"))) == [(1, cell), (2, "after"), (3, cell)]


def test_nothing_but_a_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,note\n")
    assert read_csv(spark, str(tmp_path / "t.csv")).collect() == []


@pytest.mark.parametrize(
    "line, inside, end",
    [
        ("a,b", False, False), ('"a', False, True), ('"a"', False, False), ('"a""', False, True), ('a"', False, False), ('a"', True, False),
        ('a"",b', True, True), ('a""",b', True, False), ('","x', True, True), ('",x', True, False), ("", True, True), ('"a"b"c,"d', False, True),
        (' "a', False, False), ('x,"', False, True), ('"",""', False, False),
    ],
)
def test_state_at_the_end_of_a_line(line, inside, end):
    assert ends_inside(line, inside) is end


def test_batches_of_lines_equal_single_lines():
    import pyarrow as pa

    from fieldstats.sources.records import _inside

    rng = random.Random(9)
    for _ in range(300):
        lines = ["".join(rng.choice('ab",,""é') for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 12))]
        for state in (False, True):
            want, now = [], state
            for line in lines:
                want.append(now)
                now = ends_inside(line, now)
            before, end = _inside(pa.array(["skipped", *lines]).slice(1), state, ",")
            assert (before.tolist(), end) == (want, now), lines
