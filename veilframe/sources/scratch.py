"""Scratch tables in shared storage, code shipping, table reading."""

from __future__ import annotations

import atexit
import contextvars
import io
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session without that setting (tests) gets a temporary folder, removed at exit.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="veilframe-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return a frame that reads it.

    It cuts lineage as ``checkpoint()`` does, but computes ``df`` once instead of twice and keeps
    columns prunable. A lost executor loses nothing: the files are in shared storage. They stay until ``scratch_space`` ends around the call, or
    the folder does.
    """
    path = f"{scratch_dir(df.sparkSession)}/veilframe/{name}-{uuid.uuid4().hex}"
    for made in _spaces.get():
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The lists of scratch tables of the spaces that are open, the innermost last.
_spaces: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scratch spaces", default=())


@contextmanager
def scratch_space(spark: SparkSession) -> Iterator[list[str]]:
    """Removes at its end the scratch tables that were made inside, but those that are taken off the list it gives.

    What reads such a table must be written before: ``with scratch_space(spark): query(...).write.parquet(out)``.
    """
    made: list[str] = []
    token = _spaces.set((*_spaces.get(), made))
    try:
        yield made
    finally:
        _spaces.reset(token)
        remove(spark, made)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete scratch tables by the file system they are in."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        place = jvm.org.apache.hadoop.fs.Path(p)
        place.getFileSystem(conf).delete(place, True)


def written_by(df: DataFrame) -> set[str]:
    """The folders that a frame of ``materialize`` reads."""
    return {f.rpartition("/")[0] for f in df.inputFiles()}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    folder = tempfile.mkdtemp(prefix="veilframe-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / f"{top.name}-{uuid.uuid4().hex[:8]}.zip"
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def spread(scan: DataFrame) -> DataFrame:
    """A table scan dealt out to all cores if its files are too few to occupy them, else as it is.

    For passes whose work per row is far above the cost of moving it. Large tables have more splits than cores and are never moved.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
