"""What the operators share: the cluster's shared folder, shipping of this package, bounded Arrow chunks."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one vectorised step handles at a time, in bytes.
CHUNK_BYTES = 4 << 20
#: Text that Spark puts in one Arrow batch at most, in bytes.
BATCH_BYTES = 8 << 20
_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset and all runs on one machine (tests), below a local one that becomes it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = _local_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/treesift-{uuid.uuid4().hex}"


def _local_checkpoint_dir(spark: SparkSession) -> str:
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = f"file://{tempfile.mkdtemp(prefix='treesift-ckpt-')}"
        spark.sparkContext.setCheckpointDir(own)
    return own


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session with one setting, which it gets back as it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the reliable checkpoint folder, so a lost executor costs no recomputation of its lineage; the shuffle files that made it are removed at once."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        _local_checkpoint_dir(spark)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return df.toDF(*df.columns).checkpoint(eager=True)  # a DataFrame has the setting of the time when it was made


def ship(spark: SparkSession) -> None:
    """Give the executors this package (once for each application) and bound the Arrow batches by bytes, unless the session has a bound of its own."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if sc.applicationId in _shipped:
        return
    to = Path(tempfile.mkdtemp(prefix="treesift-")) / "treesift_pkg.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, f"{_PACKAGE.name}/{p.relative_to(_PACKAGE)}")
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def read_model(path: str) -> bytes:
    """A model file's bytes, read on the driver and sent along with the tasks: executors need no copy of the file."""
    return Path(os.fspath(path)).read_bytes()


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, across its tasks."""
    module = sys.modules.setdefault("_treesift_worker_cache", ModuleType("_treesift_worker_cache"))
    return module.__dict__.setdefault("held", {})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `most` bytes of its text column, a single longer text alone."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < b.num_rows:
            done = size[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(size, done + most, side="right")))
            yield b.slice(first, last - first)
            first = last
        pa.default_memory_pool().release_unused()


def compact(a: pa.Array) -> pa.Array:
    """The array without nulls (as '') and without a slice's offset."""
    a = pc.fill_null(a, "") if a.null_count else a
    return pa.concat_arrays([a])


def by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over rows offsets[i]:offsets[i + 1], empty rows as 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def gather(starts: np.ndarray, lens: np.ndarray, codes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[starts[c] : starts[c] + lens[c]] for every c of codes, joined."""
    n = lens[codes]
    before = np.cumsum(n) - n
    return flat[np.repeat(starts[codes] - before, n) + np.arange(int(n.sum()))]


def id_field(df: DataFrame, name: str) -> str:
    """A column's type as DDL, for schemas of mapInArrow."""
    return df.schema[name].dataType.simpleString()
