from __future__ import annotations

import random

import pytest
from xport_files import write_xport

from loomstat.sources.tables import read_file, read_topic
from loomstat.sources.tables import write_xport as write_folder
from loomstat.sources.xport import read_layout
from loomstat.spec import parse_spec


def test_round_trip(spark, tmp_path):
    rng = random.Random(3)
    numbers = [0.0, 1.0, -1.0, 118.5, 1e-20, -3.25e30, None, 0.1]
    rows = [(float(i), rng.choice(numbers), f"t{i % 7}") for i in range(1000)]
    path = str(tmp_path / "t.xpt")
    write_xport(path, [("SEQN", "num", 8), ("VALUE", "num", 8), ("WORD", "char", 5)], rows)
    spark_rows = read_file(spark, path).collect()
    assert [r.SEQN for r in sorted(spark_rows)] == [r[0] for r in rows]
    for got, want in zip(sorted(spark_rows), rows, strict=True):
        assert got.WORD == want[2]
        assert got.VALUE == (None if want[1] is None else pytest.approx(want[1], rel=1e-15))


def test_many_partitions_and_pruning(spark, tmp_path):
    path = str(tmp_path / "t.xpt")
    write_xport(path, [("SEQN", "num", 8), ("A", "num", 4), ("B", "num", 8)], [(float(i), 2.0, 3.0) for i in range(997)])
    from loomstat.sources.xport import XportSource

    spark.dataSource.register(XportSource)
    df = spark.read.format("xport").option("rowsPerPartition", "100").option("columns", "B,SEQN,NONE").load(path)
    assert df.columns == ["B", "SEQN"]
    assert df.rdd.getNumPartitions() == 10
    assert df.agg({"SEQN": "sum"}).first()[0] == sum(range(997))


@pytest.mark.parametrize("n", [0, 1, 4, 5, 9, 10, 11])
def test_padding_is_not_read_as_rows(spark, tmp_path, n):
    path = str(tmp_path / "t.xpt")
    write_xport(path, [("SEQN", "num", 8)], [(float(i + 1),) for i in range(n)])
    assert read_layout(path).rows == n
    assert read_file(spark, path).count() == n


def test_other_files_are_refused(tmp_path):
    path = tmp_path / "t.xpt"
    path.write_bytes(b"not a transport file".ljust(800))
    with pytest.raises(ValueError, match="not a transport file"):
        read_layout(str(path))


def test_topic(spark, tmp_path):
    path = str(tmp_path / "t.xpt")
    write_xport(path, [("SEQN", "num", 8), ("AA", "num", 8), ("ZZ", "num", 8)], [(1.0, 5.0, 6.0)])
    spec = parse_spec([{"name": "a", "source": "AA", "file": "T", "type": "numeric", "role": "target"},
                       {"name": "b", "source": "BB", "file": "T", "type": "numeric", "role": "feature"}])
    assert [r.asDict() for r in read_topic(spark, path, spec, "T").collect()] == [{"SEQN": 1.0, "a": 5.0}]


def test_sink_and_folder(spark, tmp_path):
    """Numbers come back bit for bit; words, nulls and several files of one layout."""
    rng = random.Random(5)
    values = [0.0, -0.5, 0.1, 1e-70, -3.25e70, 1 / 3, None, float("nan"), 2.0**60 + 256, 16.0, 1.0]
    rows = [(i, rng.choice(values), rng.choice(["", "word", "é", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "K long, V double, W string").repartition(3)
    folder = str(tmp_path / "out")
    write_folder(df, folder)
    write_folder(df, folder)  # overwrites
    got = read_file(spark, folder).orderBy("K").collect()
    assert len(got) == 500
    for g, (k, v, w) in zip(got, rows, strict=True):
        assert (g.K, g.V, g.W) == (k, None if v is None or v != v else v, w or "")
    assert read_file(spark, folder, columns=["V", "NONE"]).columns == ["V"]


def test_what_the_format_cannot_hold(spark, tmp_path):
    for df in (spark.createDataFrame([(1,)], "much_too_long int"), spark.sql("select array(1) a"),
               spark.sql("select 1e300 a"), spark.sql("select repeat('x', 201) a"), spark.sql("select double('inf') a")):
        with pytest.raises(Exception, match="names have|only numbers|beyond the range|more than|infinite"):
            write_folder(df, str(tmp_path / "bad"))


def test_folder_of_different_layouts_is_refused(spark, tmp_path):
    write_xport(str(tmp_path / "a.xpt"), [("A", "num", 8)], [(1.0,)])
    write_xport(str(tmp_path / "b.xpt"), [("B", "num", 8)], [(1.0,)])
    with pytest.raises(Exception, match="different columns"):
        read_file(spark, str(tmp_path)).collect()


def test_tasks_without_rows_write_no_file(spark, tmp_path):
    """A split of a file that holds no row group gives a task without any batch."""
    source, folder = str(tmp_path / "rows"), str(tmp_path / "out")
    spark.range(2000).selectExpr("cast(id as double) as SEQN").coalesce(1).write.parquet(source)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        write_folder(spark.read.parquet(source), folder)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(list((tmp_path / "out").glob("*.xpt"))) == 1
    assert read_file(spark, folder).agg({"SEQN": "sum"}).first()[0] == sum(range(2000))
