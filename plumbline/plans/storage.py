"""Intermediate tables in the folder that all machines of a cluster share.

A table written there cuts the lineage: it survives the loss of any executor, is read any number of
times without computing it again, and tells Spark its size, so that later joins are planned on facts.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Folders that this process' jobs have made.
_made: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`; on a local master without one, a folder of this session's own."""
    folder = spark.conf.get(_KEY, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="plumbline-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    folder = f"file://{own}"
    spark.conf.set(_KEY, folder)
    return folder


class Scratch:
    """Tables of one job. Tables that nothing reads any more are dropped early to keep the disk small."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex[:12]}"
        self._titles: dict[str, str] = {}
        _made.add(self.root)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Runs `df`, writes it as Parquet and returns a frame that reads it."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, slices: int, by: str, order: Sequence[str], split: str) -> DataFrame:
        """Like `table`, in `slices` files by the hash of `by`, each sorted by `order`, and one set of files for each value of `split`.

        `df` has to be partitioned by the same hash into as many partitions, so that each file holds a whole slice.
        """
        title = f"plumbline_{uuid.uuid4().hex}"
        df.write.format("parquet").partitionBy(split).bucketBy(slices, by).sortBy(*order).option("path", f"{self.root}/{name}").saveAsTable(title)
        self._titles[name] = title
        return self.spark.table(title)

    def drop(self, *names: str) -> None:
        """Deletes tables that no frame still to be run reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            if name in self._titles:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._titles.pop(name)}")
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> int:
    """Deletes all tables that this process' jobs have left in the shared folder, and returns the number of jobs. Results that were not
    written elsewhere can't be read any more."""
    conf, made = spark._jsc.hadoopConfiguration(), sorted(_made)
    for root in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)
        _made.discard(root)
    return len(made)
