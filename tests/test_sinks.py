"""Streams into files, and lines to the caller's writers."""

import pytest

from treesift.streaming.filter import filter_stream
from treesift.streaming.sink import Writer, deliver, write_stream

NATION = "/root/testdata/sf0.001/nation.parque[t]"


def test_stream_into_files(spark, tmp_path):
    schema = spark.read.parquet(NATION).schema
    stream = filter_stream(spark.readStream.schema(schema).parquet(NATION), "nation[n_nationkey < 3]", "nation").select("n_nationkey", "n_name")
    for _ in range(2):  # a restart from the checkpoint adds nothing
        write_stream(stream, "csv:no-header:leafs=n_nationkey", "nation", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["0", "1", "2"]
    with pytest.raises(ValueError, match="no-header"):
        write_stream(stream, "csv", "nation", str(tmp_path / "b"), str(tmp_path / "c"))


def _file_writer(folder):
    class ToFile(Writer):
        def __init__(self):
            import uuid

            self.file = open(f"{folder}/{uuid.uuid4().hex}", "w")  # noqa: SIM115

        def write(self, line):
            self.file.write(line + "\n")

        def close(self):
            self.file.close()

    return ToFile


def test_writers(spark, tmp_path):
    rows = spark.range(10).selectExpr("cast(id as string) as line").repartition(3)
    deliver(rows, _file_writer(str(tmp_path)))
    assert sorted(x for p in tmp_path.iterdir() for x in p.read_text().split()) == [str(k) for k in range(10)]
    deliver(rows.limit(0), _file_writer(str(tmp_path)))


def test_writer_errors_surface(spark):
    class Broken(Writer):
        def write(self, line):
            raise OSError("disk full")

    with pytest.raises(Exception, match="disk full"):
        deliver(spark.range(1).selectExpr("cast(id as string) as line"), Broken)
