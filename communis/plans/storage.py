"""Tables in the shared folder, which cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset; on a cluster it must name a shared folder")
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="communis-"))


def delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


class Tables:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    Tables of a finished step can be dropped; what is left goes when the driver's process ends, because a lazy result
    may still read it.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.top, self.n = spark, f"{shared_dir(spark)}/communis-{name}-{uuid.uuid4().hex[:12]}", 0
        app = weakref.ref(spark)
        atexit.register(_tidy, app, self.top)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._communis_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        delete(self.spark, df._communis_path)


def _tidy(app, path: str) -> None:
    try:
        spark = app()
        if spark is not None and spark.sparkContext._jsc is not None:
            delete(spark, path)
    except Exception:  # noqa: BLE001  the session has ended; the cluster's own cleaning of the folder remains
        return
