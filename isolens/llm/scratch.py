"""Tables written to the folder that driver and executors share, to cut lineage and to be read more than once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None
#: Paths of the tables written inside each open passing() block, innermost last.
_open: list[list[str]] = []
#: On local disks every checksum file costs two more processes (chmod) and a file; scratch tables do without.  Other file systems ignore this.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset (tests on one machine), a temporary folder removed at exit."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if _own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own = tempfile.mkdtemp(prefix="isolens-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**_PLAIN).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if _open:
        _open[-1].append(path)
    return out


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables saved inside are removed at the end, but for those given to the function that the block gets.

    What is kept belongs to the block around this one.  Nothing that reads a removed table may leave the block.
    """
    mine: list[str] = []
    _open.append(mine)
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.scratch_path)
        return df

    try:
        yield keep
    finally:
        _open.pop()
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in mine:
            if path not in kept:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
        if _open:
            _open[-1].extend(kept)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apart(docs: DataFrame, *own: str) -> DataFrame:
    """docs with all columns but own renamed, so that names that an operator adds clash with none; toDF(*docs.columns) undoes it."""
    return docs.toDF(*[c if c in own else f"kept {c}" for c in docs.columns])


def broadcast_up_to(df: DataFrame, most: int) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; beyond, a join shuffles both sides.  df should be cheap to count."""
    return F.broadcast(df) if df.count() <= most else df
