"""Encoded lines to where they go: files of a stream, or writers that the caller opens."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from treesift.shipping import ship
from treesift.sources.encoders import encode


def write_stream(stream: DataFrame, spec: str, table: str, path: str, checkpoint: str, keys: Sequence[str] = ()) -> StreamingQuery:
    """Starts a query that appends the stream's encoded rows at path, all that is there now; each row lands exactly once.

    CSV needs `no-header`: a stream has no first partition for it. Binary records go to Parquet, lines to text.
    """
    if spec.removeprefix("@").startswith("csv") and "no-header" not in spec.replace("+", ":").split(":"):
        raise ValueError("csv on a stream needs no-header")
    done = encode(stream, spec, table, keys)
    kind = "parquet" if isinstance(done.schema[0].dataType, T.BinaryType) else "text"
    return done.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Writer:
    """What a partition's lines go to; subclasses say how. Executors open one for each partition, and again if a task is tried again."""

    def write(self, line: str) -> None:
        raise NotImplementedError

    def flush(self) -> None:
        """All lines of the partition were written."""

    def close(self) -> None:
        """Called in any case."""


def deliver(lines: DataFrame, opened: Callable[[], Writer]) -> None:
    """Gives the lines of a one-column DataFrame to writers, partition by partition; at least once where tasks are tried again."""

    def send(rows: Iterable) -> None:
        writer = opened()
        try:
            for row in rows:
                writer.write(row[0])
            writer.flush()
        finally:
            writer.close()

    ship(lines.sparkSession)
    lines.foreachPartition(send)
