"""Tables written once into the shared checkpoint folder, to cut lineage and be read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and all runs on this machine, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[",)) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    global _own
    _own = _own or tempfile.mkdtemp(prefix="tickloom-")
    return _own


_own: str | None = None


def delete(spark: SparkSession, path: str) -> None:
    """Remove a written table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def local(spark: SparkSession, columns: dict[str, list], kinds: str) -> DataFrame:
    """A few rows as a table of the plan itself: rows of a Python list would be read by Python workers of their own."""
    kinds = StructType.fromDDL(kinds)
    return spark.createDataFrame(pa.table(columns, to_arrow_schema(kinds)), kinds)


class Scratch:
    """Written tables of one run. drop() those no later step reads; the rest go when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{folder(spark)}/tickloom-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._close)

    def write(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet and return it as read back."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tickloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, t._tickloom_path)

    def _close(self) -> None:
        try:
            if self.spark._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped():
                delete(self.spark, self.root)
        except Exception:  # the JVM went first; its folder is the cluster's to sweep
            pass
