"""Split reading of quoted text against the one-task reader."""

import random

import pytest
from pyspark.sql import functions as F

from mailsieve.session import scratch_path
from mailsieve.sources import files, quoted
from mailsieve.sources.mail import write_message_files


@pytest.fixture
def small_blocks(spark):
    """Blocks of 1,000 bytes, one a task."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(spark, texts):
    """Files with the given contents."""
    folder = scratch_path(spark, "quoted")
    rows = spark.createDataFrame([(f"{i}.csv", t) for i, t in enumerate(texts)], "name string, t string")
    write_message_files(rows.select("name", F.encode("t", "UTF-8").alias("content")), folder, "name", "content")
    return folder


def one_task(spark, path, schema, sep):
    return spark.read.options(sep=sep, **files.CSV_OPTIONS).schema(schema).csv(path)


@pytest.mark.parametrize("sep", [",", "\t"])
def test_random_files_equal_the_one_task_reader(spark, small_blocks, sep):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(['a', ' ', '\n', '"', ',', '\t', "é", "\r\nz"]) for _ in range(rng.choice([0, 1, 3, 20, 900])))) for i in range(250)]
    folder = scratch_path(spark, "quoted")
    spark.createDataFrame(rows, "id int, t string").repartition(3).write.options(sep=sep, **files.CSV_OPTIONS).csv(folder)
    got = quoted.read_quoted(spark, folder, "id int, t string", sep)
    assert quoted._lines(spark, folder).rdd.getNumPartitions() > 20
    expected = sorted(map(tuple, one_task(spark, folder, "id int, t string", sep).collect()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == expected and len(expected) == 250


def test_stray_quotes_blank_lines_and_open_ends(spark, small_blocks):
    head = "x,y\n"
    body = 'a"b,1\n\n"p\nq",2\n5" pipe,"3"\n"he said ""no""\n\n",4\n' * 40
    folder = write(spark, [head + body, head + '"only\n' + "z\n" * 300 + 'end",9\n', head])
    got = sorted(map(tuple, quoted.read_quoted(spark, folder, "x string, y int").collect()))
    assert got == sorted([('a"b', 1), ("p\nq", 2), ('5" pipe', 3), ('he said "no"\n\n', 4)] * 40 + [("only\n" + "z\n" * 300 + "end", 9)])


def test_many_open_blocks_are_joined(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(quoted, "OPEN_BLOCKS", 0)
    text = "x,y\n" + "".join(f'"{"line of text\n" * (i % 50)}",{i}\n' for i in range(200))
    got = quoted.read_quoted(spark, write(spark, [text]), "x string, y int").collect()
    assert sorted((r["y"], r["x"] or "") for r in got) == [(i, "line of text\n" * (i % 50)) for i in range(200)]


def test_line_states():
    assert quoted.ends_open('a,"b', False, ",") and not quoted.ends_open('a,"b"', False, ",")
    assert not quoted.ends_open('a"b,c', False, ",") and quoted.ends_open('x"",y', True, ",")
    assert quoted.ends_open('x",y,"z', True, ",") and not quoted.ends_open("plain", False, ",")


def test_empty_and_missing_header(spark):
    folder = write(spark, ["1,2\r\n3,4\r\n"])
    assert sorted(map(tuple, quoted.read_quoted(spark, folder, "x int, y int", header=False).collect())) == [(1, 2), (3, 4)]
    assert quoted.read_quoted(spark, write(spark, ["", "x,y\n"]), "x int, y int").collect() == []
