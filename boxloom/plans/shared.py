"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import pickle
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is unset; on a cluster it must name a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='boxloom-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        _delete(spark, path)


# For rows of megabytes. By default the writer first looks at its buffer after a hundred rows, whatever they hold, and a
# reader takes a row group at once.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


class Scratch:
    """Tables written below the shared folder; drop() removes those that nothing reads any more.

    The others go when the driver's Python ends: what rests on them can't be read after that.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/boxloom/{name}-{uuid.uuid4().hex}", 0
        atexit.register(_sweep, spark, self.root)

    def cut(self, df: DataFrame, large_rows: bool = False) -> DataFrame:
        """Writes df once and gives the written table, which survives the loss of executors."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._boxloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._boxloom_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows; reads no more than limit + 1 of them. For deciding on a broadcast."""
    return df.limit(limit + 1).count() <= limit


FEW = 100_000  # rows of a side that is broadcast, a few short columns each


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it has at most FEW rows, else as it is, to be joined by shuffle."""
    return F.broadcast(df) if bounded(df, FEW) else df


def shipped(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast that gives value on executors, with its classes by value: a plain one would import them there."""
    b = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(b.value)
